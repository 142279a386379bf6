"""MinHash near-duplicates from bottom-k sketches of one hash function.

Every distinct shingle set keeps its k least fingerprints.  The inverted lists of the kept values generate the overlaps, an estimate from the
sketch of the union filters the pairs, and the exact Jaccard index of the full sets decides.

Which lists.  Two sets of Jaccard index t keep at least ``shared(k)`` values in common (all but about 1 in 10^8 pairs right at the limit; sets of up to k shingles
are kept whole, for them it is exact).  So it is enough to look at the few rarest kept values of each set: pairs that have enough in common meet in one
of those lists.  A list of common phrases is then only met by sets that consist mostly of them.

Long lists.  Members of a list longer than ``pairs_up_to`` are listed anew by their full sets, again only by their rarest shingles, of which two sets of index t
must share one.  What is still long there are many versions of one text.  Each such list is compared with its most typical member; members that this does not link are compared
with all others of the group, block against block, and a block gives back links, one per member, not pairs.  No list is cut and no pair of members is left out.

A set that repeats is one set.  A text without words (null, empty, blank) has the empty set, links with nothing and is kept; so does, and is, a row with a null doc_id (its component is null).
Rows that repeat a doc_id are told apart by their texts; each belongs to the component of its own set.  An empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drainwatch.llm.common import fresh, marked, settle, table
from drainwatch.llm.components import components, linked
from drainwatch.llm.shingles import shingle_set

SIGN = np.uint64(1 << 63)


@dataclass(frozen=True)
class Sketching:
    shingle: int = 5
    percent: int = 80  # least Jaccard index, in hundredths
    kept: int = 64
    pairs_up_to: int = 16  # longer lists are not paired off
    block: int = 128

    def shared(self, deviations: float = 6.4) -> int:
        """Values that two sketches of linked sets have in common, but for about one pair in 10^8: k * t less some standard deviations."""
        t = self.percent / 100
        return max(1, int(self.kept * t - deviations * (self.kept * t * (1 - t)) ** 0.5))


def signed(values: np.ndarray) -> np.ndarray:
    """As signed numbers in the same order."""
    return (values ^ SIGN).view(np.int64)


def sketches(docs: DataFrame, how: Sketching) -> DataFrame:
    """(doc_id, n_shingles, _text, _set, _sketch): _text and _set are fingerprints of the text and of the whole set."""

    @F.pandas_udf("n long, print binary, sketch array<long>")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = signed(shingle_set(t, how.shingle))
            rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), s[: how.kept]))
        return pd.DataFrame(rows, columns=["n", "print", "sketch"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"), sketched("text").alias("_s"))
    return rows.select("doc_id", "_text", F.col("_s.n").alias("n_shingles"), F.col("_s.print").alias("_set"), F.col("_s.sketch").alias("_sketch"))


def rare_keys(postings: DataFrame, size: Column, needed: Column) -> DataFrame:
    """postings: (value, id, n, m), m values per id.  Keeps per id its ``size - needed + 1`` rarest values, of those the ones that others share.

    Values that only one id has come first among the rare ones; they are dropped by the join and only counted.
    """
    often = postings.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").withColumnRenamed("value", "_v")
    met = postings.join(often, F.col("value") == F.col("_v")).drop("_v")
    own = Window.partitionBy("id")
    ranked = met.withColumn("_alone", size - F.count(F.lit(1)).over(own)).withColumn("_rank", F.row_number().over(own.orderBy("df", "value")))
    kept = ranked.filter(F.col("_rank") + F.col("_alone") <= size - needed + 1).withColumn("typical", F.avg("df").over(own))
    return kept.select("value", "id", "n", "typical")


def least_shared(n: Column, percent: int) -> Column:
    """ceil(n * t): what a set of n shares with any set that it is linked with."""
    return F.ceil(n * percent / 100).cast("int")


def size_fits(a: str, b: str, percent: int) -> Column:
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (F.col(a) > 0)


def list_sizes(keys: DataFrame) -> DataFrame:
    return keys.groupBy(F.col("value").alias("_v")).agg(F.count(F.lit(1)).alias("_members"), F.max_by("id", F.struct("typical", -F.col("id"))).alias("_centre")).filter("_members > 1")


def short_pairs(keys: DataFrame, sizes: DataFrame, how: Sketching) -> DataFrame:
    """All pairs of the lists of at most ``pairs_up_to`` members."""
    short = keys.join(sizes.filter(F.col("_members") <= how.pairs_up_to), F.col("value") == F.col("_v")).select("value", "id", "n")
    # At most pairs_up_to rows meet each row here.
    other = short.select(F.col("value").alias("_v"), F.col("id").alias("b"), F.col("n").alias("_nb"))
    fits = (F.col("value") == F.col("_v")) & (F.col("id") < F.col("b")) & size_fits("n", "_nb", how.percent)
    return short.join(other, fits).select(F.col("id").alias("a"), "b").distinct()


def estimated(pairs: DataFrame, classes: DataFrame, how: Sketching) -> DataFrame:
    """Drop pairs that the sketch of their union rules out (six standard deviations below the limit)."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("_id"))
    held = marked(classes.select("id", "_sketch"), "id", ids, "_id")
    one, two = held.select(F.col("id").alias("a"), F.col("_sketch").alias("_sa")), held.select(F.col("id").alias("b"), F.col("_sketch").alias("_sb"))
    both = pairs.join(one, "a").join(two, "b")
    union = F.slice(F.array_sort(F.array_union("_sa", "_sb")), 1, how.kept)
    both = both.withColumn("_u", F.size(union)).withColumn("_c", F.size(F.array_intersect(union, F.array_intersect("_sa", "_sb"))))
    t = how.percent / 100
    return both.filter(F.col("_c") >= F.col("_u") * t - 6 * F.sqrt(F.col("_u") * t * (1 - t))).select("a", "b")


def full_sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, how: Sketching) -> DataFrame:
    """(id, n, _full) of the given classes, from the text of the first document of each."""

    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([signed(shingle_set(t, how.shingle)) for t in texts])

    wanted = settle(classes.select("id", "n", "_first", "_text").join(ids.distinct(), "id", "left_semi"), "wanted")
    near = marked(docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_doc"), "text"), "_doc", wanted, "_first")
    texts = near.withColumn("_t", F.xxhash64("text")).join(wanted, (F.col("_doc") == F.col("_first")) & (F.col("_t") == F.col("_text")))
    return texts.groupBy("id", "n").agg(F.min("text").alias("_own")).select("id", "n", sets("_own").alias("_full"))


def verified(pairs: DataFrame, full: DataFrame, how: Sketching) -> DataFrame:
    """Pairs whose full sets have 100 * common >= percent * union."""
    one = full.select(F.col("id").alias("a"), F.col("n").alias("_na"), F.col("_full").alias("_fa"))
    two = full.select(F.col("id").alias("b"), F.col("n").alias("_nb"), F.col("_full").alias("_fb"))
    both = pairs.join(one, "a").join(two, "b").withColumn("_common", F.size(F.array_intersect("_fa", "_fb")).cast("long"))
    return both.filter(100 * F.col("_common") >= how.percent * (F.col("_na") + F.col("_nb") - F.col("_common"))).select("a", "b")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a block, some thousand shared values at a time."""
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    keep = times[which] > 1
    who, which = who[keep], shared[which[keep]]
    order = np.argsort(which, kind="stable")
    who, which = who[order], which[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for start in range(0, int(shared[-1]) + 1 if len(shared) else 0, 4096):
        low, high = np.searchsorted(which, [start, start + 4096])
        held = np.zeros((len(sets), 4096), np.float32)
        held[who[low:high], which[low:high] - start] = 1
        out += (held @ held.T).astype(np.int64)
    return out


def block_links(rows: pd.DataFrame, how: Sketching) -> pd.DataFrame:
    """One pair of blocks: a link from every member to the least one that it reaches inside."""
    sets, ids = rows["_full"].tolist(), rows["id"].to_numpy(np.int64)
    n = np.array([len(s) for s in sets])
    common = common_counts(sets)
    near = 100 * common >= how.percent * (n[:, None] + n[None, :] - common)
    return pd.DataFrame(linked(ids, near), columns=["a", "b"], dtype="int64")


def rest_links(groups: DataFrame, links: DataFrame, full: DataFrame, how: Sketching) -> DataFrame:
    """groups: (centre, id).  Compare members that are not linked with the centre with all members of their group."""
    tied = links.select(F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y")).distinct()
    near = groups.join(tied, (F.least("centre", "id") == F.col("_x")) & (F.greatest("centre", "id") == F.col("_y")), "left")
    members = near.select("centre", "id", (F.col("_x").isNotNull() | (F.col("centre") == F.col("id"))).alias("near"))
    counts = members.groupBy("centre").agg(F.count(F.when(~F.col("near"), 1)).alias("_far"), F.count(F.when(F.col("near"), 1)).alias("_near")).filter("_far > 0")
    blocks = lambda n: F.ceil(F.col(n) / how.block).cast("int")
    dealt = members.join(counts, "centre").withColumns({"_fb": blocks("_far"), "_nb": blocks("_near")})
    own = F.pmod(F.xxhash64(F.lit(5), F.col("id")), F.when(F.col("near"), F.col("_nb")).otherwise(F.col("_fb"))).cast("int")
    dealt = dealt.withColumn("_own", own)
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    with_far = F.transform(upto("_fb"), lambda k: F.struct(F.when(F.col("near"), k).otherwise(F.least(k, F.col("_own"))).alias("i"), F.when(F.col("near"), -1 - F.col("_own")).otherwise(F.greatest(k, F.col("_own"))).alias("j")))
    with_near = F.transform(upto("_nb"), lambda k: F.struct(F.col("_own").alias("i"), (-1 - k).alias("j")))
    tasks = F.when(F.col("near"), with_far).otherwise(F.concat(with_far, with_near))
    sent = dealt.select("centre", "id", F.explode(tasks).alias("_task")).join(full.select("id", "_full"), "id")
    return sent.groupBy("centre", "_task").applyInPandas(lambda rows: block_links(rows, how), "a long, b long")


def near_duplicates(docs: DataFrame, how: Sketching = Sketching()) -> DataFrame:
    """docs: doc_id, text and more.  Adds n_shingles, component_id (least doc_id reachable) and kept."""
    sets = settle(sketches(docs, how), "sketches")
    usable = sets.filter("doc_id IS NOT NULL AND n_shingles > 0").withColumn("_doc", F.col("doc_id").cast("long"))
    # One row per set, numbered once and then read from the files: sets that repeat need no comparison.
    first = usable.groupBy("_set").agg(F.min("_doc").alias("_first"), F.min_by("_text", "_doc").alias("_text"), F.first("n_shingles").alias("n"), F.first("_sketch").alias("_sketch"))
    classes = settle(first.withColumn("id", F.monotonically_increasing_id()), "sets")

    kept = F.size("_sketch")
    postings = classes.select(F.explode("_sketch").alias("value"), "id", "n", kept.alias("m"))
    keys = settle(rare_keys(postings, F.col("m"), F.least(least_shared(F.col("m"), how.percent), F.lit(how.shared()))), "keys")
    sizes = settle(list_sizes(keys), "lists")
    pairs = settle(estimated(settle(short_pairs(keys, sizes, how), "met"), classes, how), "pairs")

    crowd = keys.join(sizes.filter(F.col("_members") > how.pairs_up_to), F.col("value") == F.col("_v")).select("id").distinct()
    crowd = settle(crowd, "crowd")
    full = settle(full_sets(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).union(crowd), classes, docs, how), "full-sets")

    shingles = full.join(crowd, "id", "left_semi").select(F.explode("_full").alias("value"), "id", "n", F.col("n").alias("m"))
    keys2 = settle(rare_keys(shingles, F.col("m"), least_shared(F.col("m"), how.percent)), "full-keys")
    sizes2 = settle(list_sizes(keys2), "full-lists")
    long = keys2.join(sizes2.filter(F.col("_members") > how.pairs_up_to), F.col("value") == F.col("_v"))
    groups = settle(long.select(F.col("_centre").alias("centre"), "id").distinct(), "groups")
    stars = groups.filter("centre <> id").select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b"))
    links = settle(verified(pairs.union(short_pairs(keys2, sizes2, how)).union(stars).distinct(), full, how), "links")
    rest = settle(rest_links(groups, links, full, how), "rest-links")

    found = components(links.union(rest))
    rooted = classes.select("_set", "_first", "id").join(found, "id", "left").withColumn("_root", F.coalesce("component_id", "id"))
    least = rooted.groupBy("_root").agg(F.min("_first").alias("_least"))
    named = rooted.select("_set", "_root").join(least, "_root").select(F.col("_set").alias("_s"), "_least")
    own = sets.select("doc_id", "_text", "_set", "n_shingles").distinct().join(named, F.col("_set") == F.col("_s"), "left")
    own = own.select(F.col("doc_id").alias("_doc"), "_text", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_least", F.col("doc_id").cast("long"))).alias("component_id"))
    rows = fresh(docs, "n_shingles", "component_id", "kept", "_print", "_doc", "_text").withColumn("_print", F.xxhash64("text"))
    out = rows.join(own, rows["doc_id"].eqNullSafe(F.col("_doc")) & (F.col("_print") == F.col("_text"))).drop("_doc", "_text", "_print")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, Sketching(shingle=3, percent=85)).select("doc_id", "n_shingles", "component_id", "kept")


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b USING (shingle)
  WHERE a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM sets s JOIN least l ON l.id = s.doc_id
"""
