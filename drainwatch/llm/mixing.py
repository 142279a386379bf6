"""Mixing sources to target weights, in DataFrame operations only.

Every source gets a target of words.  A source is taken whole as often as its target holds it, and then a sample without replacement
fills the rest: each document draws an exponential key, scaled by its quality weight (Efraimidis and Spirakis), the documents of a
source are put in the order of their keys, and words are taken along that order until the target is reached.  The document at the border
gives only the words that are still missing, so every source meets its target to the word.

The order within a source is cut into about sqrt(n) slices of the key, so neither the sort nor the running sums need a whole source in one task.

A null source is a source of its own and ranks last; null and empty texts have size 0 and nothing to take.  Repeated rows draw the same key and
follow one another; a null id draws a key like any other.  Keys come from a hash of the id, so reruns agree.  All columns pass through, except that those named
like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drainwatch.llm.common import fresh, settle, table, word_count

SYMBOL = r"[#*$%&|<>!]"
OUTPUT = ("size", "source_size", "target", "taken", "epochs")
INTERNAL = ("_source", "_rank", "_docs", "_weights", "_key", "_slice", "_r", "_s", "_carried", "_before", "_part")


def quality_weight(text: Column) -> Column:
    """1 (a symbol for every second character or more) to 100 (none): a whole number, so that sums of it are exact."""
    symbols, chars = F.coalesce(F.regexp_count(text, F.lit(SYMBOL)), F.lit(0)), F.coalesce(F.length(text), F.lit(0))
    return F.greatest(F.lit(1), 100 - F.floor(200 * symbols / (chars + 1))).cast("int")


def measured(docs: DataFrame) -> DataFrame:
    """Add size (words) and _weight."""
    return fresh(docs, "size", "_weight").withColumns({"size": word_count(F.col("text")), "_weight": quality_weight(F.col("text"))})


def source_targets(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per source: its size, its target, and what the slices need.

    The wanted words, ``share`` of all, are split by weight; targets stop at ``most`` times the source, and what is left over is split again.
    In the order of (most * size / weight) the sources that stop come first, so one pass of running sums finds them.
    """
    total = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"), F.sum(F.col("_weight").cast("long")).alias("_weights"))
    # Windows over all sources: one row per source, whatever the number of documents.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") - 1) % len(weights) + 1).cast("long")
    ranked = total.withColumn("_rank", F.row_number().over(by_name)).withColumn("_share", cycle).withColumn("_cap", most * F.col("source_size"))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_share"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    left = ranked.select(
        "*",
        (F.sum("source_size").over(whole) * F.lit(share)).alias("_want"),
        F.coalesce(F.sum("_cap").over(before), F.lit(0)).alias("_cap_before"),
        (F.sum("_share").over(whole) - F.coalesce(F.sum("_share").over(before), F.lit(0))).alias("_share_left"),
    )
    level = (F.col("_want") - F.col("_cap_before")) / F.col("_share_left")
    stopped = left.withColumn("_stops", level * F.col("_share") >= F.col("_cap"))
    free = stopped.withColumns(
        {
            "_cap_sum": F.coalesce(F.sum(F.when(F.col("_stops"), F.col("_cap"))).over(whole), F.lit(0)),
            "_free_share": F.sum(F.when(~F.col("_stops"), F.col("_share"))).over(whole),
        }
    )
    target = F.when(F.col("_stops"), F.col("_cap").cast("double")).otherwise(F.col("_share") * (F.col("_want") - F.col("_cap_sum")) / F.col("_free_share"))
    return free.select(F.col("source").alias("_source"), "_rank", "source_size", target.alias("target"), "_docs", "_weights")


def mix(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 1) -> DataFrame:
    """``rows``: output of ``measured``.  Adds source_size, target, taken (words, repeats counted) and epochs (whole passes over the source)."""
    rows = fresh(rows, *(set(OUTPUT) - {"size"}), *INTERNAL)
    targets = source_targets(rows, weights, share, most)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
    keyed = rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_key", -F.log(uniform) * 100 / F.col("_weight"))
    # The share of keys below this one, were all weights alike: it only spreads the slices evenly.
    slices = F.ceil(F.sqrt("_docs"))
    at = F.floor((1 - F.exp(-F.col("_key") * F.col("_weights") / (100 * F.col("_docs")))) * slices)
    sliced = keyed.withColumn("_slice", F.least(slices - 1, at))

    along = Window.partitionBy("_rank").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sliced.groupBy("_rank", "_slice").agg(F.sum("size").alias("_sum")).select(F.col("_rank").alias("_r"), F.col("_slice").alias("_s"), F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_carried"))
    within = Window.partitionBy("_rank", "_slice").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced.join(carried, (F.col("_rank") == F.col("_r")) & (F.col("_slice") == F.col("_s"))).withColumn(
        "_before", F.col("_carried") + F.coalesce(F.sum("size").over(within), F.lit(0))
    )
    words = F.floor(F.col("target") + F.lit(0.5))
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0)
    placed = placed.withColumn("epochs", epochs.cast("long")).withColumn("_part", words - F.col("epochs") * F.col("source_size") - F.col("_before"))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("_part")))
    return placed.withColumn("taken", taken.cast("long")).drop("_weight", *INTERNAL)


def materialise(mixed: DataFrame) -> DataFrame:
    """The rows of a mix: a document once for each time it is taken whole, and the one at the border with its first words only."""
    columns = [c for c in mixed.columns if c not in OUTPUT]
    size, rest = F.col("size"), F.col("taken") % F.col("size")
    times = F.when(size > 0, F.ceil(F.col("taken") / size)).otherwise(F.greatest(F.lit(1), F.least(F.col("epochs"), F.lit(1))))
    copies = mixed.withColumn("_copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times.cast("int"))).otherwise(F.array().cast("array<int>"))))
    short = (size > 0) & (F.col("_copy") * size > F.col("taken"))
    words = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    cut = copies.withColumn("_cut", F.when(short, F.call_function("substring_index", words, F.lit(" "), rest.cast("int"))))
    out = {"text": F.coalesce(F.col("_cut"), F.col("text"))}
    if "n_chars" in columns:
        out["n_chars"] = F.when(F.col("_cut").isNotNull(), F.length("_cut").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumns(out).select(*columns)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(measured(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"), "mix")
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    greatest(1, 100 - floor(200 * len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>!]')) / (length(coalesce(text, '')) + 1)))::INT AS weight,
    md5('1:' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents),
total AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r, 2 * source_size AS cap FROM total),
shared AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM ranked),
run AS (
  SELECT *, (sum(source_size) OVER () * 1.5)::DOUBLE AS want, coalesce(sum(cap) OVER b, 0) AS cap_before, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_left
  FROM shared WINDOW b AS (ORDER BY cap::DOUBLE / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (SELECT *, (want - cap_before::DOUBLE) / w_left::DOUBLE * w >= cap AS stops FROM run),
target AS (
  SELECT source, source_size, CASE WHEN stops THEN cap::DOUBLE
    ELSE w * (want - coalesce(sum(cap) FILTER (stops) OVER (), 0)::DOUBLE) / (sum(w) FILTER (NOT stops) OVER ())::DOUBLE END AS target
  FROM stop),
keyed AS (
  SELECT rows.*, t.source_size, t.target,
    -ln((list_reduce(list_transform(string_split(substr(digest, 1, 13), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT), lambda a, b: a * 16 + b) + 0.5) / 4503599627370496.0::DOUBLE) * 100 / weight AS k
  FROM rows JOIN target t ON rows.source IS NOT DISTINCT FROM t.source),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    floor(target + 0.5)::BIGINT AS words FROM keyed),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, words - epochs * source_size - before)))::BIGINT AS taken FROM whole
"""
