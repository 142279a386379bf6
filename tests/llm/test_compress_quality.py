import random
import zlib

import pytest
from pyspark.sql import functions as F

from drainwatch.llm.compress_quality import Training, known_labels, op2_quality_classifier, score_quality, train, training_rows

WORDS = [f"{a}{b}{c}" for a in ("tor", "ven", "lam", "qui") for b in ("is", "en", "a") for c in ("da", "mo", "r", "st")]


def corpus(n=600):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(20, 200))]
        good = i % 3 != 0
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words) if i % 2 else " | ".join(w + "$$$" for w in words)))
        labels.append((i, int(good), 0))
    return rows, labels


def out_of_training(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy_and_scores_of_odd_texts(docs, spark):
    rows, labels = corpus()
    truth = dict((i, q) for i, q, _ in labels)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    odd = [(None, None), (10_000, ""), (10_001, "x"), (10_002, "word " * 60_000), (10_003, "日本語 " * 50), (5, rows[5][1])]
    frame = docs(rows + odd, "score")
    got = score_quality(frame, train(docs(rows), lab)).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.doc_id in truth and out_of_training(r.doc_id)]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert len({r.score for r in got if r.doc_id == 5}) == 1


def test_only_rows_that_may_be_learnt_from_are_read(docs, spark):
    rows, labels = corpus(200)
    odd = [(7, 0, 0), (None, 1, 0), (8, None, 0), (9, 5, 0)]
    lab = spark.createDataFrame(labels + odd, "doc_id long, quality int, toxic int")
    known = {r.doc_id for r in known_labels(lab).collect()}
    assert 7 not in known and None not in known and not any(out_of_training(i) for i in known)
    # What is held out changes nothing, whatever its label and text.
    other = spark.createDataFrame([(i, 1 - q if out_of_training(i) else q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    changed = [(i, "###" if out_of_training(i) else t) for i, t in rows]
    one, two = train(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), train(docs(changed), other)
    assert one == two


def test_without_labels_and_without_documents(docs, spark):
    rows, labels = corpus(30)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in score_quality(docs(rows), train(docs(rows), none)).collect()} == {0.5}
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert score_quality(docs(rows).limit(0), train(docs(rows).limit(0), lab)).collect() == []


def test_the_sample_is_bounded(docs, spark):
    rows, labels = corpus(400)
    lab = known_labels(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    sample = training_rows(docs(rows), lab, Training(per_class=20, max_bytes=600)).collect()
    assert 0 < len(sample) <= 40 and all(len(r["_text"].encode()) <= 600 for r in sample)


def test_labels_whose_texts_are_all_too_long_are_an_error(docs, spark):
    rows, labels = corpus(60)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    with pytest.raises(ValueError):
        train(docs(rows), lab, Training(max_bytes=10))
    # The sample is filled with other texts where some are too long.
    long = [(i, t * 50) if i % 5 == 0 else (i, t) for i, t in rows]
    got = {r["doc_id"] for r in training_rows(docs(long), known_labels(lab), Training(per_class=10, max_bytes=5000)).collect()}
    assert len(got) == 20 and not any(i % 5 == 0 for i in got)


def test_held_out_accuracy_on_the_given_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = op2_quality_classifier(spark, sf_dir).filter("held_out").join(labels, "doc_id")
    right, n = scored.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count(F.lit(1))).first()
    assert n > 50 and right / n > 0.95
