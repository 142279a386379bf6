"""Which creators to look up next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drainwatch.params import DEFAULTS, Params

# Fixed order of the classes, most urgent first.
CLASSES = ("suspect", "graduation", "new-creator", "known-creator")


def class_rank(name: str = "class") -> Column:
    out = F.lit(len(CLASSES))
    for i, c in enumerate(CLASSES):
        out = F.when(F.col(name) == c, i).otherwise(out)
    return out


def min_age(params: Params = DEFAULTS) -> Column:
    c = F.col("class")
    return (
        F.when(c == "suspect", params.suspect_repoll_s)
        .when(c == "graduation", params.min_refresh_s)
        .when(c == "known-creator", params.known_refresh_s)
        .otherwise(0)
    )


def classify_requests(ev: DataFrame, creators: DataFrame) -> DataFrame:
    """Launches and graduations as look-up requests.  ``creators``: creator, serial, last_asked_s.

    A token is as old as its creation, also where it is asked about because it graduated.
    """
    births = ev.filter(F.col("type") == "token_create").groupBy("mint").agg(F.min("block_time_s").alias("_born"))
    acts = ev.filter(F.col("type").isin("token_create", "graduation")).select(
        F.col("actor").alias("creator"), "mint", "type", F.col("block_time_s").alias("enqueued_s")
    )
    known = acts.join(creators.select("creator", "serial", "last_asked_s"), "creator").join(births, "mint", "left")
    name = (
        F.when(F.col("type") == "graduation", "graduation")
        .when(F.col("serial"), "suspect")
        .when(F.col("last_asked_s").isNull(), "new-creator")
        .otherwise("known-creator")
    )
    return known.select("creator", "mint", name.alias("class"), "enqueued_s", F.coalesce("_born", "enqueued_s").alias("born_s"), "last_asked_s")


def suspect_repoll(creators: DataFrame, la: DataFrame, now_s: Column, params: Params = DEFAULTS) -> DataFrame:
    """Every serial creator's newest launch, if it was not asked about lately."""
    due = creators.filter(
        F.col("serial") & (F.col("last_asked_s").isNull() | (now_s - F.col("last_asked_s") >= params.suspect_repoll_s))
    )
    newest = la.join(due.select("creator"), "creator", "left_semi").groupBy("creator").agg(
        F.max_by("mint", F.struct(F.coalesce("created_s", F.lit(-1)), F.col("mint"))).alias("mint"), F.max("created_s").alias("born_s")
    )
    return newest.join(due.select("creator", "last_asked_s"), "creator").select(
        "creator", "mint", F.lit("suspect").alias("class"), now_s.cast("bigint").alias("enqueued_s"), "born_s", "last_asked_s"
    )


def eligibility(requests: DataFrame, now_s: Column, params: Params = DEFAULTS) -> DataFrame:
    """Requests with their state: ready, too young to ask about, asked lately, or waited too long."""
    recent = F.col("last_asked_s").isNotNull() & (F.col("enqueued_s") - F.col("last_asked_s") < min_age(params))
    status = (
        F.when(recent, "recent")
        .when(now_s - F.col("enqueued_s") > params.max_wait_s, "stale")
        .when(F.col("born_s") + params.min_token_age_s > now_s, "young")
        .otherwise("ready")
    )
    return requests.withColumn("status", status)


def one_per_creator(requests: DataFrame) -> DataFrame:
    """One request per creator: its most urgent class, since its first enqueue."""
    order = F.struct(class_rank(), F.col("enqueued_s"), F.col("mint"))
    return requests.groupBy("creator").agg(
        F.min_by("class", order).alias("class"), F.min("enqueued_s").alias("enqueued_s"), F.min_by("mint", order).alias("mint")
    )


def rank_worklist(requests: DataFrame, budget: int) -> DataFrame:
    return requests.orderBy(class_rank(), "enqueued_s", "creator").limit(budget)


def worklist_stats(requests: DataFrame, now_s: Column) -> DataFrame:
    return requests.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ready").alias("ready"),
        F.count_if(F.col("status") == "stale").alias("discarded"),
        F.round(F.avg(F.when(F.col("status") == "ready", now_s - F.col("enqueued_s")))).cast("bigint").alias("mean_wait_s"),
    )


def dispatch(requests: DataFrame, now_s: Column, budget: int) -> DataFrame:
    """The ready requests with whether this run's budget takes them (``dispatched``) and how long they waited.  Only ``budget`` rows are put in order."""
    ready = one_per_creator(requests.filter("status = 'ready'"))
    taken = rank_worklist(ready, budget).select(F.col("creator").alias("_taken"))
    rows = ready.join(taken, F.col("creator").eqNullSafe(F.col("_taken")), "left")
    return rows.select("creator", "class", "enqueued_s", "mint", F.col("_taken").isNotNull().alias("dispatched"), (now_s - F.col("enqueued_s")).alias("waited_s"))


def dispatch_stats(dispatched: DataFrame) -> DataFrame:
    """Per class: dispatched, left pending, and the mean wait of the dispatched."""
    d = F.col("dispatched")
    return dispatched.groupBy("class").agg(
        F.count_if(d).alias("dispatched"), F.count_if(~d).alias("pending"), F.round(F.avg(F.when(d, F.col("waited_s")))).cast("bigint").alias("mean_wait_s")
    )
