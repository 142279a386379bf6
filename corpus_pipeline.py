"""From raw documents to encoded training data: five stages, each one operator of drainwatch.llm over all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.  All but the last return the columns of
documents; the last returns the encoding of every document of the mix.  A null in any column, empty and very long texts, repeated rows and empty tables pass through as the operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drainwatch.llm.bottom_sketch import near_duplicates
from drainwatch.llm.common import ready, settle, table
from drainwatch.llm.compress_quality import score_quality, train
from drainwatch.llm.mixing import materialise, measured, mix
from drainwatch.llm.phrase_automata import remove_repeats
from drainwatch.llm.piece_lattice import PieceModel, encode_prints

VOCABULARY = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts to be good."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).filter("predicted = 1").select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the least doc_id; of rows that repeat an id and a text, one."""
    ready(spark)
    kept = near_duplicates(docs).filter("kept").select(*docs.columns)
    # Only ids that repeat need their texts compared.
    again = settle(docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_again")), "repeated-ids")
    repeats = F.col("doc_id") == F.col("_again")
    return kept.join(again, repeats, "left_anti").union(kept.join(again, repeats, "left_semi").dropDuplicates(["doc_id", "text"]))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand earlier; a document of which nothing is left goes."""
    ready(spark)
    cut = remove_repeats(docs).filter("n_removed = 0 OR n_removed < n_words")
    changed = F.col("kept_text").isNotNull()
    cut = cut.withColumns({"text": F.coalesce("kept_text", "text"), "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))})
    return cut.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each time a document is taken."""
    ready(spark)
    return materialise(mix(measured(docs))).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoding of every row of the mix: its ids, the numbers of ids and byte ids, the print of the sequence, and whether its decoding is the text."""
    import public_tokenizers

    ready(spark)
    return encode_prints(docs, PieceModel(public_tokenizers.path(VOCABULARY))).drop("decoded")


STAGES = [("quality", quality), ("near_duplicate", near_duplicate), ("substring", substring), ("mixing", mixing), ("pieces", pieces)]

# No SQL: compressed sizes and merges of pieces are not expressible; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
