"""Repair of conversation structure by iterative-deepening A*.

The turns of a conversation should read ``(s?(ua)+)?`` by the first letters of their roles (system, user, assistant).  ``faults`` gives each row its first fault: blank (no character but white
space), duplicate (role and text seen earlier in the conversation) or truncated (its last such character ends no sentence).  Edits go from the first row to the last:

* Keep costs 0, Rerole to user or assistant 2, Delete 3 (a blank or duplicate row must go), Insert of an empty user or assistant turn 2; a truncated row that is not deleted adds 1.

A conversation is searched as a short string of codes, one letter a row.  The state of the search is (rows done, place in the pattern).  Depth first, in the ASCII order of the edits' initials, it
follows paths whose cost so far and least cost to come stay within a bound; where none is accepted, the bound rises to the least sum that passed it.  A table keeps, for each state, the most
that was left when it failed, so no state is searched again with less.  The first path accepted at the least bound is the cheapest, and of those the least in ASCII order.  The least cost to come
is exact within blocks of rows (over all places where a block may be entered and left) and added up over blocks, which keeps the number of bounds small for conversations of many thousand rows.

Spark groups, orders and marks the rows and puts the repaired messages together; Python sees the codes only, never a text.  Rows are shuffled once, by conversation; a conversation is one row
of the result, so it must fit a row.

Null roles and texts are one space (a text of one space is blank), null turns come first, rows of the same turn are ordered by role, text and copy.  A null conversation is one of its own.  A role that is empty or of
another initial fits no place and is reroled or deleted.  A conversation of which no row is left has cost 0 and no messages; an empty table gives no rows.  Other columns are not read, so their names cannot clash.
Very long texts stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drainwatch.llm.common import crc32_sql, table

INK = r"[^\x20\x09-\x0D]"
# Rows of a block within which the least cost to come is exact.
BLOCK = 4096
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
FAR = 1 << 60

# Places in the pattern: nothing yet, after s, after u, after a.  What each may be followed by.
BEGIN, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {BEGIN: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U}}
# The one place that an inserted or reroled turn leads to.
MADE = {BEGIN: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
TO_END = {BEGIN: 0, AFTER_S: 2 * INSERT, AFTER_U: INSERT, AFTER_A: 0}
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}


def row_edits(code: str, place: int) -> list[tuple[str, int, int]]:
    """(initial, cost, place after) of the edits that take a row, in ASCII order.  ``code``: d for a row that must go, else its initial (x: none of the three), upper case where truncated."""
    out = [("D", DELETE, place)]
    if code != "d":
        more = TRUNCATED if code.isupper() else 0
        kept = NEXT[place].get(code.lower())
        if kept is not None:
            out.append(("K", more, kept))
        out.append(("R", REROLE + more, MADE[place]))
    return out


def least_to_come(codes: str, block: int = BLOCK) -> list[tuple[int, ...]]:
    """For each number of rows done and each place, a cost that no path to the end can stay below."""
    after = tuple(TO_END[p] for p in range(4))
    out = [after]
    for i in range(len(codes) - 1, -1, -1):
        if (i + 1) % block == 0:
            # A block may be left at any place: the best of them bounds them all.
            after = (min(after),) * 4
        here = [min(cost + after[to] for _, cost, to in row_edits(codes[i], p)) for p in range(4)]
        # Inserts in front of the row; two in a row reach every place that inserts can.
        for _ in range(2):
            here = [min(here[p], INSERT + here[MADE[p]]) for p in range(4)]
        after = tuple(here)
        out.append(after)
    return out[::-1]


def repair(codes: str, block: int = BLOCK) -> tuple[int, str]:
    """(cost, initials of the edits) of the cheapest repair; of equal ones the least in ASCII order."""
    n, least = len(codes), least_to_come(codes, block)
    bound = least[0][BEGIN]
    while True:
        failed: dict[tuple[int, int], int] = {}
        beyond = FAR
        path: list[str] = []

        def ways(i: int, place: int) -> Iterator[tuple[str, int, int, int]]:
            edits = [(e, cost, i + 1, to) for e, cost, to in (row_edits(codes[i], place) if i < n else [])]
            return iter(sorted([*edits, ("I", INSERT, i, MADE[place])], key=lambda w: w[0]))

        # A stack instead of recursion: (what is left of the bound, edits still to try).
        failed[0, BEGIN] = bound
        stack = [(bound, ways(0, BEGIN))]
        if n == 0:
            return 0, ""
        while stack:
            left, rest = stack[-1]
            for edit, cost, i, place in rest:
                now = left - cost
                if now < least[i][place]:
                    beyond = min(beyond, bound - now + least[i][place])
                    continue
                # A state under way counts as failed: to come back to it only costs.
                if failed.get((i, place), -1) >= now:
                    continue
                failed[i, place] = now
                path.append(edit)
                if i == n and place in (BEGIN, AFTER_A):
                    return bound - now, "".join(path)
                stack.append((now, ways(i, place)))
                break
            else:
                stack.pop()
                if path:
                    path.pop()
        bound = beyond


def plan(codes: str, audit: str) -> list[tuple[int | None, str | None]]:
    """The repaired messages as (row, role): no row for an insert, no role for a row that is kept."""
    out, row, place = [], 0, BEGIN
    for edit in audit:
        if edit == "K":
            place = NEXT[place][codes[row].lower()]
            out.append((row, None))
        elif edit != "D":
            place = MADE[place]
            out.append((row if edit == "R" else None, ROLE[place]))
        row += edit != "I"
    return out


FOUND = "cost long, audit string, plan array<struct<row:int,role:string>>"


def search(codes: pd.Series) -> pd.DataFrame:
    known: dict[str, tuple] = {}
    out = []
    for c in codes:
        if c not in known:
            cost, audit = repair(c)
            known[c] = (cost, audit, [{"row": r, "role": role} for r, role in plan(c, audit)])
        out.append(known[c])
    return pd.DataFrame(out, columns=["cost", "audit", "plan"])


def _plain(conversations: DataFrame) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", "turn", space("role"), space("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with every twentieth dropped (``_gone``), emptied, robbed of its sentence marks, repeated next to itself, or said by the user, as a hash of its place decides."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", part("conv_id"), part("turn"))) % 20
    rows = _plain(conversations).withColumn("_kind", kind)
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.col("role").alias("_by_role"), F.col("text").alias("_by_text"), copies.alias("_copy"), (F.col("_kind") == 0).alias("_gone"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """Number the rows of each conversation and add ``fault`` (blank, duplicate, truncated or null) and ``illegal`` (its initial may not follow the one before).

    ``rows``: conv_id, turn, role, text, and optionally what ``damage`` adds: rows that are gone stay, without number or fault.
    """
    if "_gone" not in rows.columns:
        rows = _plain(rows).withColumns({"_by_role": F.col("role"), "_by_text": F.col("text"), "_copy": F.lit(0), "_gone": F.lit(False)})
    dealt = rows.repartition("conv_id")
    order = ["turn", "_by_role", "_by_text", "_copy"]
    along = Window.partitionBy("conv_id", "_gone").orderBy(*order)
    numbered = dealt.withColumn("_row", F.row_number().over(along)).withColumn("_initial", F.substring("role", 1, 1))
    pair = F.concat(F.lag("_initial").over(Window.partitionBy("conv_id", "_gone").orderBy("_row")), F.col("_initial"))
    again = F.row_number().over(Window.partitionBy("conv_id", "_gone", "role", "text").orderBy("_row")) > 1
    blank, closed = ~F.col("text").rlike(INK), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    marked = numbered.withColumns({"illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)), "_again": again})
    fault = F.when(blank, "blank").when(F.col("_again"), "duplicate").when(~closed, "truncated")
    return marked.withColumn("fault", fault).drop("_again", "_by_role", "_by_text", "_copy")


def code_of() -> Column:
    letter = F.when(F.col("_initial").isin("s", "u", "a"), F.col("_initial")).otherwise("x")
    return F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)


def repaired(marked: DataFrame) -> DataFrame:
    """``marked``: output of ``faults``.  One row per conversation: counts of faults, gaps, cost, audit and ``messages``, the repaired array of (role, text)."""
    here = ~F.col("_gone")
    n = lambda test: F.count_if(here & test)
    turn = F.when(here, F.col("turn"))
    row = F.when(here, F.struct("_row", code_of().alias("code"), "role", "text"))
    whole = marked.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1, F.lit(0)).alias("_span"),
        F.count(F.when(here & (F.col("_first") == 1), F.col("turn"))).alias("_turns"),
        *[n(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f) for f in ("blank", "duplicate", "truncated")],
        n(F.col("illegal")).alias("illegal"), F.array_sort(F.collect_list(row)).alias("_rows"),
    )
    found = whole.withColumn("_found", F.pandas_udf(search, FOUND)(F.array_join(F.transform("_rows", lambda r: r["code"]), "")))
    said = lambda p: F.struct(F.coalesce(p["role"], F.get("_rows", p["row"])["role"]).alias("role"), F.coalesce(F.get("_rows", p["row"])["text"], F.lit("")).alias("text"))
    return found.select(
        "conv_id", (F.col("_span") - F.col("_turns")).alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        F.col("_found.cost").alias("cost"), F.col("_found.audit").alias("audit"), F.transform("_found.plan", said).alias("messages"),
    )


def repair_conversations(rows: DataFrame) -> DataFrame:
    marked = faults(rows)
    # The first row of each turn, so that different turns are counted without another shuffle.
    first = F.row_number().over(Window.partitionBy("conv_id", "_gone", "turn").orderBy("_row"))
    return repaired(marked.withColumn("_first", first))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = repair_conversations(damage(table(spark, sf_dir, "conversations")))
    shown = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    return whole.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(shown, 256).alias("repaired_sha256"))


def _plus(best: str, cost: str | int, edit: str) -> str:
    """A path is text: its cost in nine digits, then its edits, so that the least text is the best path."""
    return f"(lpad((substr({best}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({best}, 10) || '{edit}')"


_U1 = f"least(u, {_plus('z', INSERT, 'I')}, {_plus('s', INSERT, 'I')}, {_plus('a', INSERT, 'I')})"
_A1 = f"least(a, {_plus('u1', INSERT, 'I')})"


def _kept(initial: str, *best: str) -> str:
    return ", ".join(f"CASE WHEN NOT must_go AND initial = '{initial}' THEN {_plus(b, 'more', 'K')} END" for b in best)


def _made(*best: str) -> str:
    return ", ".join(f"CASE WHEN NOT must_go THEN {_plus(b, f'{REROLE} + more', 'R')} END" for b in best)


# The same answer forwards, row by row: the best path to each place of the pattern.
OP13_SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place,
    dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS k FROM conversations),
kinds AS (SELECT *, {crc32_sql("place")} % 20 AS kind FROM keyed),
copies AS (SELECT *, 0 AS copy FROM kinds WHERE kind <> 0 UNION ALL SELECT *, 1 AS copy FROM kinds WHERE kind = 3),
damaged AS (
  SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM copies),
seen AS (
  SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY k, role, text ORDER BY n) AS nth, regexp_replace(text, '[ 	-
]+$', '') AS ink FROM damaged),
marked AS (
  SELECT *, CASE WHEN ink = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(initial) OVER (PARTITION BY k ORDER BY n) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM seen),
coded AS (SELECT *, fault IN ('blank', 'duplicate') AS must_go, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS more FROM marked),
counts AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n FROM coded GROUP BY k),
run AS (
  SELECT k, 0::BIGINT AS i, '000000000' AS z, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM counts
  UNION ALL
  SELECT k, i + 1, {_plus('z', DELETE, 'D')}, least({_plus('s', DELETE, 'D')}, {_kept('s', 'z')}),
    least({_plus('u1', DELETE, 'D')}, {_kept('u', 'z', 's', 'a1')}, {_made('z', 's', 'a1')}),
    least({_plus('a1', DELETE, 'D')}, {_kept('a', 'u1')}, {_made('u1')})
  FROM (
    SELECT *, {_A1} AS a1 FROM (
      SELECT r.*, {_U1} AS u1, c.initial, c.must_go, c.more FROM run r JOIN coded c ON c.k = r.k AND c.n = r.i + 1) one) two),
ended AS (SELECT k, z, a, {_U1} AS u1 FROM run JOIN counts USING (k) WHERE i = n),
best AS (SELECT k, least(z, {_A1}) AS path FROM ended),
audits AS (SELECT k, substr(path, 1, 9)::BIGINT AS cost, substr(path, 10) AS audit FROM best),
letters AS (SELECT k, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS pos FROM audits WHERE audit <> ''),
placed AS (
  SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER w AS n, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER w AS said FROM letters WINDOW w AS (PARTITION BY k ORDER BY pos)),
shown AS (
  SELECT p.k, p.pos, p.edit, p.said, c.role, c.text, max(CASE WHEN p.said = 1 AND p.edit = 'K' AND c.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.k) AS lead
  FROM placed p LEFT JOIN coded c ON c.k = p.k AND c.n = p.n WHERE p.edit <> 'D'),
texts AS (
  SELECT k, string_agg(CASE WHEN edit = 'K' THEN role WHEN (said - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS text
  FROM shown GROUP BY k)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(text, '')) AS repaired_sha256
FROM (SELECT DISTINCT k, conv_id FROM keyed) o LEFT JOIN counts c USING (k) LEFT JOIN audits USING (k) LEFT JOIN texts USING (k)
"""
