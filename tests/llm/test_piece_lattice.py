import random

import public_tokenizers
import pytest
import sentencepiece

from drainwatch.llm.piece_lattice import PieceModel, decode, encode, encode_prints

FILE = public_tokenizers.path("piece_bpe_32k.model")
PARTS = list("abcdefghijklmnopqrstuvwxyzthe") + [" ", "  ", "   ", "\n", "\t", "é", "日", "😀", "1", "2", ".", ",", "(", ")", '">', "==", "--", "▁", "the", "ing", "ation", "http", "://", "²", "².", "\x00"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(400)]
    out += ["".join(rng.choice(PARTS[:29]) for _ in range(rng.randrange(50, 300))) for _ in range(15)]
    out += [" " * k + "x" * (k % 2) for k in range(0, 70, 3)] + ["a" * k for k in (60, 61, 62, 63, 300)] + ["日本語テキスト" * 30, "lang " * 20_000]
    return out


@pytest.fixture(scope="module")
def library():
    own = sentencepiece.SentencePieceProcessor(model_file=FILE)
    return lambda t: own.encode(t) if t else []


def test_ids_are_the_librarys_and_decode_to_the_text(docs, texts, library):
    model = PieceModel(FILE)
    rows = list(enumerate(texts)) + [(None, None), (None, "null id")]
    got = decode(encode(docs(rows, "ids"), model), model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r.ids) == library(r.text), repr(r.text)
        assert r.decoded == (r.text or "").replace("▁", " ")


def test_prints_count_ids_and_tell_sequences_apart(docs, texts, library):
    model = PieceModel(FILE)
    rows = list(enumerate(texts)) + [(0, texts[0]), (1, texts[1]), (None, None), (9000, "ab ba"), (9001, "ba ab")]
    got = encode_prints(docs(rows, "copies"), model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    first = model.first_byte
    for i, t in rows:
        ids = library(t)
        assert by[i].n_tokens == len(ids) and by[i].n_byte_tokens == sum(first <= k < first + 256 for k in ids)
        assert by[i].round_trip == ("▁" not in (t or ""))
    assert by[9000].ids_print != by[9001].ids_print
    assert encode_prints(docs(rows).limit(0), model).collect() == []


def test_frequent_segments_and_the_others_give_the_same(docs, texts, monkeypatch):
    from drainwatch.llm import piece_lattice

    model, rows = PieceModel(FILE), list(enumerate(texts))[:150]
    columns = ("doc_id", "n_tokens", "ids_print", "round_trip")
    one = sorted(encode_prints(docs(rows), model).select(*columns).collect())
    monkeypatch.setattr(piece_lattice, "FREQUENT_BYTES", 2_000)
    assert sorted(encode_prints(docs(rows), model).select(*columns).collect()) == one


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception, match=""):
        PieceModel(str(tmp_path / "none.model"))


def test_the_query_gives_the_ids_and_the_decoded_text_of_every_document(spark, tmp_path, library):
    import corpus_pipeline
    from drainwatch.llm.piece_lattice import op8_sentencepiece

    rows = [(1, "Some words, and some more.", "en", "s", 0), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, "日本 ▁ x", "en", "s", 0), (None, "twice twice", "en", "s", 0), (None, "twice twice", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((str(i), library(t), (t or "").replace("▁", " "), "▁" not in (t or "")) for i, t, *_ in rows)
    got = op8_sentencepiece(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), list(r.ids), r.decoded, r.round_trip) for r in got) == want
    stage = corpus_pipeline.pieces(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in stage) == [w[:2] for w in want]


def test_documents_are_encoded_and_read_back_without_a_shuffle_of_theirs(docs, texts):
    model, rows = PieceModel(FILE), docs(list(enumerate(texts))[:20])
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (encode_prints(rows, model), decode(encode(rows, model), model))]
    assert not any("Exchange" in p or "Join" in p for p in plans)
    # One Python worker a task.
    assert plans[0].count("ArrowEvalPython") == 1


def test_segments_that_the_dictionary_lacks_are_cut_as_by_the_lexicon(spark, texts):
    import numpy as np

    from drainwatch.llm.piece_lattice import SPACE, Coder, lexicon, segments, units

    model = PieceModel(FILE)
    words = sorted({s for t in texts for u in units(t) for s in segments(u)} | {SPACE * k for k in range(1, 80)} | {"ab" * k + "é" for k in range(25, 40)} | {"no" * 5_000})
    want = {r.segment: r.ids for r in lexicon(spark.createDataFrame([(w,) for w in words], "segment string"), model).collect()}
    code = Coder({}, model.pieces, model.first_byte)
    assert {w: np.frombuffer(code.lattice(w), np.int32).tolist() for w in words} == want
    short = [w for w in words if 1 < len(w) <= 61]
    assert [code.merged(w) for w in short] == [code.folded(w) for w in short]


def test_remembered_units_give_way_and_change_no_ids(docs, texts, library, monkeypatch):
    import pyarrow as pa

    from drainwatch.llm import piece_lattice

    monkeypatch.setattr(piece_lattice, "UNITS", 7)
    model = PieceModel(FILE)
    code = piece_lattice.Coder({}, model.pieces, model.first_byte)
    assert code.sequences(pa.array([*texts, None, *texts])).to_pylist() == [library(t) for t in [*texts, "", *texts]]
    assert len(code) <= 7 and len(code.before) <= 7


def test_new_segments_are_merged_together_not_one_by_one(library):
    import sys

    import pyarrow as pa

    from drainwatch.llm import piece_lattice

    model, rng, calls = PieceModel(FILE), random.Random(4), 0
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(16)) for _ in range(4_000)]
    rows = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    code = piece_lattice.Coder({}, model.pieces, model.first_byte)

    def count(_, event, __):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = code.sequences(pa.array(rows))
    finally:
        sys.setprofile(None)
    assert got.to_pylist() == [library(t) for t in rows]
    # A word of 16 letters takes some ten merges, of several calls each if made by itself.
    assert calls < 12 * len(words)


def test_texts_are_cut_as_by_the_patterns_in_stretches_of_any_size(texts, library, monkeypatch):
    import pyarrow as pa

    from drainwatch.llm import piece_lattice
    from drainwatch.llm.piece_lattice import segments, units

    odd = [*texts, "", "áb 1́ ‍", "ß2ß", " ▁ ", "\n \n", "😀é日 "]
    found, begin = piece_lattice.cut(pa.array(odd))
    each = found.to_pylist()
    assert [each[s:e] for s, e in zip(begin, begin[1:], strict=False)] == [[s for u in units(t) for s in segments(u)] for t in odd]
    model = PieceModel(FILE)
    for most in (1, 100, 10_000):
        monkeypatch.setattr(piece_lattice, "STRETCH_BYTES", most)
        monkeypatch.setattr(piece_lattice, "MERGED", most)
        got = piece_lattice.Coder({}, model.pieces, model.first_byte, model.merges).sequences(pa.array([None, *odd]))
        assert got.to_pylist() == [library(t) for t in ["", *odd]]
