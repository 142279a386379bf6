"""Chat formatting from an event log, in DataFrame operations only.

A conversation is kept as a log of events.  Partitioned by conversation and put in the order of ``seq``, the events fold into its final messages:

* ``delta`` (and any other or null op) appends its text to a message, opening it where it is new;
* ``edit`` replaces the text of its message, and later deltas go on from there;
* ``regenerate`` discards its message and all after it, and starts the message again with its own text.

Nothing is replayed event by event.  An event is dead if a regeneration of its message or an earlier one comes after it, which is one running maximum along the
messages; it is overwritten if an edit of its message comes after it, which is a maximum per message.  What is left is concatenated.

The messages are rendered by a template that marks turns by control strings.  Inside a text (or role) a backslash follows each backslash, and the first character of each
control string, so that a text holds no control string and its escaping can be taken back exactly.  The loss mask is a list of byte spans of the output, one for each
message of a trained role.  ``read_back`` recovers messages and trained text from the output alone.

The log is shuffled once, by conversation: all windows and aggregates share that partitioning.  A conversation is one row of the result, so it must fit a row (2 GB); rows before
that are sorted with spilling, not held in memory.

A null text is empty, a null role is empty, a null conversation is one of its own, null messages and sequence numbers come first.  Events of the same ``seq`` come in the order of op, message, role
and text, repeated events count each.  A conversation of no live events is not returned, an empty log gives no rows.  Very long texts are streamed in pieces by ``as_log``, in linear time.  Other columns of the
log are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drainwatch.llm.common import table

LOG = "conv_id long, seq long, op string, message long, role string, text string"
# Characters of one delta when a finished text is written as a stream.
DELTA_CHARS = 400


@dataclass(frozen=True)
class Template:
    """Control strings and the roles that are learnt from.  A control string must not begin or go on with a backslash."""

    open: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    # Control strings of other public templates, which a text must not hold either.
    others: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|eot_id|>")
    trained: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> list[str]:
        return [self.open, self.sep, self.close, *self.others]

    def starts(self) -> list[str]:
        return sorted({c[0] for c in self.controls})

    def escape(self, text: Column) -> Column:
        """A backslash follows each backslash, and each character that begins a control string or stands before a backslash."""
        by_start = ["(?:%s(?=%s))" % (re.escape(s), "|".join([r"\\", *[re.escape(c[1:]) for c in self.controls if c[0] == s]])) for s in self.starts()]
        return F.regexp_replace(text, "|".join([r"\\", *by_start]), "$0\\\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, "([%s])\\\\" % "".join("\\" + s for s in ["\\", *self.starts()]), "$1")


CHATML = Template()


def reconstruct(log: DataFrame) -> DataFrame:
    """The final messages of a log: (conv_id, message, role, text).  The role is the last one that is given."""
    dealt = log.select("conv_id", "seq", "op", "message", "role", "text").repartition("conv_id")
    placed = dealt.withColumn("_pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("seq", "op", "message", "role", "text")))
    op_at = lambda op, live=True: F.when((F.col("op") == op) & live, F.col("_pos"))
    # The newest regeneration of this message or one before it.
    up_to = Window.partitionBy("conv_id").orderBy("message").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = placed.withColumn("_cut", F.coalesce(F.max(op_at("regenerate")).over(up_to), F.lit(0)))
    live = cut.filter(F.col("_pos") >= F.col("_cut"))
    edited = F.coalesce(F.max(op_at("edit")).over(Window.partitionBy("conv_id", "message")), F.lit(0))
    texts = F.array_sort(F.collect_list(F.when(F.col("_pos") >= F.col("_edit"), F.struct("_pos", "text"))))
    folded = live.withColumn("_edit", edited).groupBy("conv_id", "message").agg(
        F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("_pos"))), F.lit("")).alias("role"),
        F.array_join(F.transform(texts, lambda t: t["text"]), "").alias("text"),
    )
    return folded


def render(messages: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation: ``formatted``, and ``loss_spans``, the (begin, bytes) spans of the trained texts in its UTF-8 form."""
    marked = messages.select(
        "conv_id", "message", F.col("role").isin(*template.trained).alias("_trained"),
        F.concat(F.lit(template.open), template.escape(F.col("role")), F.lit(template.sep)).alias("_head"), template.escape(F.col("text")).alias("_body"),
    )
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    sizes = marked.withColumns({"_h": F.octet_length("_head").cast("long"), "_b": F.octet_length("_body").cast("long")})
    placed = sizes.withColumn("_at", F.coalesce(F.sum(F.col("_h") + F.col("_b") + F.lit(len(template.close.encode()))).over(before), F.lit(0)) + F.col("_h"))
    part = F.struct("message", F.concat("_head", "_body", F.lit(template.close)).alias("shown"), F.when(F.col("_trained"), F.struct(F.col("_at").alias("begin"), F.col("_b").alias("bytes"))).alias("span"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("_parts", lambda p: p["shown"]), "").alias("formatted"),
        F.filter(F.transform("_parts", lambda p: p["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """From (conv_id, formatted, loss_spans) alone: ``turns``, an array of (role, text), and ``loss_texts``, the text under each span, both unescaped."""
    parts = F.split("formatted", re.escape(template.close))
    halves = lambda p: F.split(F.substring(p, len(template.open) + 1, 2**31 - 1), re.escape(template.sep))
    turns = F.transform(F.transform(F.slice(parts, 1, F.size(parts) - 1), halves), lambda h: F.struct(template.unescape(h[0]).alias("role"), template.unescape(h[1]).alias("text")))
    cut = lambda raw, s: F.decode(F.substring(raw, (s["begin"] + 1).cast("int"), s["bytes"].cast("int")), "UTF-8")
    # The bytes are bound once, so that a span costs its own length only.
    loss = F.flatten(F.transform(F.array(F.col("formatted").cast("binary")), lambda raw: F.transform("loss_spans", lambda s: template.unescape(cut(raw, s)))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_texts"))


def as_log(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """Finished conversations as the log that streamed them: a row is a message, in the order of turn (null first), role and text; its text comes in deltas."""
    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id")
    numbered = rows.withColumn("message", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"(?s).{1,%d}" % delta_chars), F.lit(0))
    streamed = numbered.select("conv_id", "message", "role", F.posexplode_outer(pieces).alias("_piece", "text"))
    seq = F.shiftleft(F.col("message"), 28) + F.coalesce("_piece", F.lit(0))
    return streamed.select("conv_id", seq.alias("seq"), F.lit("delta").alias("op"), "message", "role", "text")


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    back = read_back(render(reconstruct(as_log(given.union(added)))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.withColumn("_loss", F.array_join("loss_texts", "")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _grown(column: str) -> str:
    """Characters that escaping adds: one for each backslash, each control string, and each of their first characters before a backslash."""
    controls = "|".join(re.escape(c) for c in CHATML.controls)
    return f"len(regexp_extract_all({column}, '{controls}')) + len(regexp_extract_all({column}, '[<\\[]\\\\')) + (length({column}) - length(replace({column}, '\\', '')))"


OP11_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
plain AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM rows),
said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS turns, coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '') AS loss,
    sum({len(CHATML.open) + len(CHATML.sep) + len(CHATML.close)} + length(role) + length(text) + {_grown("role")} + {_grown("text")}) AS formatted
  FROM plain GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted::BIGINT AS formatted_chars FROM said
"""
