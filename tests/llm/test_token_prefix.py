import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from drainwatch.llm.token_prefix import counter, count_tokens, with_prefix_counts

FILE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "'", "l", "s", "re", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "é", "日", "😀", "1", "!", "<|", "<|endoftext|>", "endo", "|>", "th", "ing", "​", "\x00", "\r\n", "'ll", "ſ", "²", "́"]


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(FILE)
    return lambda s: len(own.encode(s, add_special_tokens=False).ids)


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(15))) for _ in range(n)]


def test_every_prefix_has_the_librarys_count(library):
    own = counter(FILE)
    for t in texts(1500):
        want = [library(t[:i]) for i in range(len(t) + 1)]
        assert own.prefix_counts(t) == want, repr(t)
        for budget in (0, 1, 3, 7):
            assert own.fits(t, budget) == (want[-1], max(i for i, n in enumerate(want) if n <= budget)), repr(t)


def test_pairs_that_stay_apart_are_those_that_merging_leaves_apart():
    own = counter(FILE)
    own.prefix_counts("unthinkable reheated theories, internationally '' 1234567890 aaaaaaa")
    known = [(p, v) for p, v in own.sides.items() if p[0]]
    assert known and all((own.merged(a + b) == [a, b]) == v for (a, b), v in known)


def test_query_columns_over_odd_rows(docs, library):
    rows = [(None, None), (1, ""), (2, "<|endoftext|>"), (3, "x " * 30_000), (3, "x " * 30_000), (4, "a" * 5000), *[(100 + i, t) for i, t in enumerate(texts(200, 2))]]
    got = count_tokens(docs(rows, "n_tokens"), FILE, 1024).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        n = library(t or "")
        assert (by[i].n_bytes, by[i].n_tokens, by[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert library(("x " * 30_000)[: by[3].chars_within]) <= 1024 < library(("x " * 30_000)[: by[3].chars_within + 2])
    assert count_tokens(docs(rows).limit(0), FILE, 5).collect() == []


def test_prefix_column(docs, library):
    got = {r.doc_id: r.prefix_tokens for r in with_prefix_counts(docs([(1, "it's  two"), (2, None)]), FILE).collect()}
    assert got[1] == [library("it's  two"[:i]) for i in range(10)] and got[2] == [0]
