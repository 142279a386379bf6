"""The stages of the pipeline on a small corpus, each against plain Python over its own input."""

import random

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from test_bottom_sketch import brute as near_brute
from test_phrase_automata import brute as repeat_brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 7)))
    vocabulary = [word() for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    passage = prose(40)
    rows, labels = [], []
    for i in range(260):
        if i % 5 == 0:
            text, good = " ".join(w.upper() + "$$$" for w in prose(80).split()), 0
        else:
            text, good = prose(rng.choice([30, 60, 120])), 1
            if i % 7 == 1:
                text += " " + passage + " " + prose(10)
        rows.append((i, text, "en", "abc"[i % 3] if i % 13 else None, len(text)))
        labels.append((i, good, 0))
    for k in range(20):
        base = rows[5 * k + 1][1].split()
        base[rng.randrange(len(base))] = word()
        rows.append((1000 + k, " ".join(base), "en", "a", 0))
    rows += [rows[2], (None, prose(50), None, "b", None), (2000, None, "en", "a", None), (2001, "", "en", None, 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_and_run(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    reached = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, corpus).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        reached[name] = (before, after)
        if k < 4:
            assert docs.columns == COLUMNS
    # Junk goes, clean documents stay.
    before, after = reached["quality"]
    kept = {r.doc_id for r in after}
    clean = {r.doc_id for r in before if r.text and "$$$" not in r.text}
    junk = {r.doc_id for r in before if r.text and "$$$" in r.text}
    assert len(kept & clean) >= 0.98 * len(clean) and not kept & junk
    # One document of each group, of all five-word sets of index 0.8 or more.
    before, after = reached["near_duplicate"]
    named = [(r.doc_id, r.text) for r in before if r.doc_id is not None]
    want = {i for i, (_, least) in near_brute(list(dict(named).items()), 5, 80).items() if i == least}
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(want)
    assert sum(r.doc_id is None for r in after) == sum(r.doc_id is None for r in before)
    # The passage stays where it stands first.
    before, after = reached["substring"]
    want = {i: (n, gone) for i, n, gone, _ in repeat_brute([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id for r in after} == {i for i, (n, gone) in want.items() if not gone or gone < n}
    assert all(len((r.text or "").split()) == want[r.doc_id][0] - want[r.doc_id][1] for r in after)
    assert sum(gone for _, gone in want.values()) > 0
    # Half as many words again, and no document more than twice.
    before, after = reached["mixing"]
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(words(after) - 1.5 * words(before)) <= 4
    assert max(sum(r.doc_id == i for r in after) for i in {r.doc_id for r in after}) <= 2
    # The ids of the library.
    before, after = reached["pieces"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.VOCABULARY))
    assert sorted((str(r.doc_id), len(library.encode(r.text)) if r.text else 0) for r in before) == sorted((str(r.doc_id), r.n_tokens) for r in after)
    assert all(r.round_trip for r in after)
    again = corpus_pipeline.run(spark, corpus)
    assert sorted(map(str, again.collect())) == sorted(map(str, after))


def test_an_empty_corpus(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, corpus).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0
