import hashlib
import random

from drainwatch.llm.phrase_automata import LAST, Phrases, remove_repeats


def brute(rows, window=20):
    first = {}
    words = [(LAST if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for (i, t), (n, w) in zip(rows, words, strict=True):
        gone = {s + k for s in range(len(w) - window + 1) if (n, s) > first[tuple(w[s : s + window])] for k in range(window)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["und", "die", "日本", "É"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefghij") for _ in range(3))
    passages = [[word() for _ in range(n)] for n in (20, 21, 35, 60, 19)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(5)):
            w += [word() for _ in range(rng.randrange(15))] + rng.choice(passages)
        if rng.random() < 0.2:
            w += ["echo"] * rng.randrange(70)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(100 + i, rows[rng.randrange(60)][1]) for i in range(12)]
    return rows + [(200, ""), (201, None), (202, " ".join(["x y"] * 9)), (None, rows[3][1])]


def got(frame, how=Phrases()):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(frame, how).collect()), key=str)


def test_removed_words_equal_brute_force(docs):
    for seed, how in ((1, Phrases()), (2, Phrases(stream=500))):
        rows = corpus(seed)
        random.Random(9).shuffle(rows)
        assert got(docs(rows, "n_removed"), how) == brute(rows)


def test_kept_text_repeated_rows_and_an_empty_table(docs):
    a = " ".join(f"a{i}" for i in range(30))
    rows = [(1, a), (1, a), (2, "new " + a + " end"), (3, a), (4, "short text")]
    out = remove_repeats(docs(rows)).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept_text) for r in out if r.doc_id != 1) == [(2, 30, "new end"), (3, 30, ""), (4, 0, None)]
    assert [r.n_removed for r in out if r.doc_id == 1] == [0, 0]
    assert remove_repeats(docs(rows).limit(0)).collect() == []


def test_a_very_long_text_that_repeats_itself(docs):
    text = " ".join(f"w{i % 3000}" for i in range(9000))
    assert got(docs([(5, text)])) == brute([(5, text)])


def test_prints_tell_words_apart_and_only_by_the_word():
    from drainwatch.llm.phrase_automata import prints_of

    rng = random.Random(12)
    words = [bytes(rng.choice(b"abc\x00\xff\xc3") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40, 255, 256, 257, 3000]))) for _ in range(600)] + [b"a", b"a\x00", b"a" * 8, b"a" * 9]
    seen = {}
    for _ in range(20):
        part = rng.sample(words, 150)
        for word, got in zip(part, prints_of(b" ".join(part)).tolist(), strict=True):
            assert seen.setdefault(word, got) == got
    assert len(set(seen.values())) == len(seen)
    assert len(prints_of(b"")) == 0
