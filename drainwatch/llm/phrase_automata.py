"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is a run of ``window`` words.  A word goes if a window over it starts earlier somewhere else, in the order of (doc_id, start).

1. Candidates.  Every window has one anchor, the least fingerprint of the ``anchor``-word runs in it; equal windows have equal anchors.  Anchors that occur once in the
   corpus rule their windows out.  About one word in seven carries an anchor, so this is what the corpus-wide shuffle holds.
2. Confirmation.  The windows of recurring anchors are counted by 128-bit fingerprints, all windows around one anchor at once where they are always the same; those found twice or more, with the
   place where each comes first, are the recurring passages.
3. Automata.  Consecutive recurring windows of their first document form phrases.  Documents with recurring anchors are dealt to shards of bounded size, versions of a text to the same one, and
   each shard compiles an automaton, whose letters are words, of the anchors of the phrases that its documents can hold.
4. Location.  Every such document is streamed, whole, through the automaton of its shard; at every occurrence the windows that hold it are looked up among the recurring ones, word by word,
   and every window that is not the first of its kind marks its words.  Documents without recurring anchors hold no phrase.

Documents of the same words as one of a smaller doc_id are that document's copies: all their windows start earlier there, so they need no automaton.

Null and empty texts have no words; texts shorter than a window lose nothing.  A null doc_id comes after all others.  Rows that repeat a doc_id are one document for the order: of windows with
the same doc_id and start none is earlier, so exact repeats of a row keep or lose the same words.  Other columns pass through.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drainwatch.llm.common import fresh, marked, settle, table
from drainwatch.llm.shingles import MIX, mixed

LAST = (1 << 63) - 1
NOTHING = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Phrases:
    window: int = 20
    anchor: int = 8
    stream: int = 1_500_000  # bytes of documents that one shard takes, about: its automaton holds what can occur in them


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def pack(text: str | None) -> bytes:
    """A text's words, compressed: texts meet several small tables by shuffles."""
    return zstandard.compress(b" ".join(words_of(text)), 3)


def unpack(packed: bytes) -> list[bytes]:
    return zstandard.decompress(packed).split()


# Which bytes of eight belong to a word that has so many left; longer words than LONG are hashed alone.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG = 256


def prints_of(joined: bytes) -> np.ndarray:
    """A 64-bit print of each word of a text whose words are joined by one blank: eight bytes at a time are mixed in, for all words at once."""
    if not joined:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(joined + bytes(8), np.uint8)
    starts = np.append(0, np.flatnonzero(raw[:-8] == 0x20) + 1)
    sizes = np.diff(starts, append=len(raw) - 7) - 1
    # Every byte of the text as the first of eight.
    eights = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    out = mixed(sizes.astype(np.uint64) + MIX[2], MIX[0])
    out = mixed(out + (eights[starts] & MASKS[np.minimum(sizes, 8)]), MIX[1])
    for k in range(8, min(int(sizes.max()), LONG), 8):
        rest = np.flatnonzero(sizes > k)
        out[rest] = mixed(mixed(out[rest], MIX[0]) + (eights[starts[rest] + k] & MASKS[np.minimum(sizes[rest] - k, 8)]), MIX[1])
    for k in np.flatnonzero(sizes > LONG):
        out[k] = xxhash.xxh3_64_intdigest(joined[starts[k] : starts[k] + sizes[k]])
    return mixed(out, MIX[3])


def runs_of(prints: np.ndarray, size: int, factor: np.uint64 = MIX[2]) -> np.ndarray:
    """One print per run of ``size`` consecutive words: a polynomial in an odd factor over the words' prints."""
    n = len(prints) - size + 1
    out = prints[: max(n, 0)].copy()
    for k in range(1, size):
        out *= factor
        out += prints[k : k + n]
    return mixed(mixed(out, MIX[0]), MIX[1])


def prints_in(packed: bytes) -> np.ndarray:
    return prints_of(zstandard.decompress(packed))


def anchors_of(prints: np.ndarray, how: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """For every window, by its start: its anchor, and where the anchor stands (the leftmost, of equal ones).  Places never fall."""
    if len(prints) < how.window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    runs = runs_of(prints, how.anchor).view(np.int64)
    place = np.lib.stride_tricks.sliding_window_view(runs, how.window - how.anchor + 1).argmin(1)
    place += np.arange(len(place))
    return runs[place], place


def spans_of(prints: np.ndarray, recurring: np.ndarray, how: Phrases) -> list[tuple[int, int, int, int, int]]:
    """(anchor, print of the span, start, windows) for every stretch of windows that share one place of a recurring anchor."""
    anchors, place = anchors_of(prints, how)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    windows = np.diff(first, append=len(place))
    raw, size, out = prints.tobytes(), prints.itemsize, []
    keep = np.isin(anchors[first], recurring)
    for start, n in zip(first[keep].tolist(), windows[keep].tolist(), strict=True):
        whole = xxhash.xxh3_128_intdigest(raw[start * size : (start + n + how.window - 1) * size])
        out.append((int(anchors[start]), (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63), start, n))
    return out


def survey(docs: DataFrame, how: Phrases) -> DataFrame:
    """(doc_id, _row, n_words, whole, same, anchors): what is known of a text by itself.  An anchor that stands there more than once is listed twice."""

    @F.pandas_udf("n_words long, whole string, same binary, anchors array<long>")
    def surveyed(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words = words_of(t)
            joined = b" ".join(words)
            anchors, place = anchors_of(prints_of(joined), how)
            values, times = np.unique(anchors[np.flatnonzero(np.diff(place, prepend=-1))], return_counts=True)
            rows.append((len(words), hashlib.sha256(joined).hexdigest(), xxhash.xxh3_128_digest(joined), np.repeat(values, np.minimum(times, 2))))
        return pd.DataFrame(rows, columns=["n_words", "whole", "same", "anchors"])

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_row"), surveyed("text").alias("_s")).select("doc_id", "_row", "_s.*")


def recurring_windows(held: DataFrame, how: Phrases) -> DataFrame:
    """held: (_row, _id, packed, anchors), the recurring anchors of each.  (_row, start, windows): windows found twice or more, where each comes first.

    The windows around one place of an anchor are counted together, as one span.  Where an anchor only ever stands in equal spans, all their windows recur
    together; only the windows of anchors with different spans are counted one by one, once for each different span.
    """

    @F.pandas_udf("array<struct<anchor:long,k1:long,k2:long,start:int,windows:int>>")
    def spans(texts: pd.Series, anchors: pd.Series) -> pd.Series:
        names = ("anchor", "k1", "k2", "start", "windows")
        return pd.Series([[dict(zip(names, s, strict=True)) for s in spans_of(prints_in(t), np.asarray(own, np.int64), how)] for t, own in zip(texts, anchors, strict=True)])

    @F.pandas_udf("h1 array<long>, h2 array<long>, start array<int>, n array<long>")
    def windows(texts: pd.Series, parts: pd.Series) -> pd.DataFrame:
        rows = []
        for t, own in zip(texts, parts, strict=True):
            prints = prints_in(t)
            at = np.concatenate([np.arange(p["start"], p["start"] + p["windows"]) for p in own])
            n = np.repeat([p["n"] for p in own], [p["windows"] for p in own])
            rows.append((runs_of(prints, how.window)[at].view(np.int64), runs_of(mixed(prints, MIX[1]), how.window, MIX[3])[at].view(np.int64), at.astype(np.int32), n))
        return pd.DataFrame(rows, columns=["h1", "h2", "start", "n"])

    each = held.select("_row", "_id", F.explode(spans("packed", "anchors")).alias("_s")).select("_row", "_id", "_s.*")
    found = each.groupBy("anchor", "k1", "k2", "windows").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_id", "start", "_row")).alias("first"))
    found = settle(found.select("anchor", "windows", "n", "first.*"), "spans")
    kinds = found.groupBy(F.col("anchor").alias("_a")).agg(F.count(F.lit(1)).alias("kinds"))
    ruled = found.join(kinds, F.col("anchor") == F.col("_a"))
    alike = ruled.filter("kinds = 1 AND n > 1").select("_row", "start", "windows")

    several = ruled.filter("kinds > 1").groupBy(F.col("_row").alias("_of")).agg(F.collect_list(F.struct("start", "windows", "n")).alias("_parts"))
    one = held.select("_row", "_id", "packed").join(several, F.col("_row") == F.col("_of")).select("_row", "_id", windows("packed", "_parts").alias("_w"))
    one = one.select("_row", "_id", F.explode(F.arrays_zip("_w.h1", "_w.h2", "_w.start", "_w.n")).alias("_w")).select("_row", "_id", "_w.*")
    counted = one.groupBy("h1", "h2").agg(F.sum("n").alias("times"), F.min(F.struct("_id", "start", "_row")).alias("first")).filter("times > 1")
    return alike.union(counted.select("first._row", "first.start", F.lit(1).alias("windows")))


def phrases(firsts: DataFrame, held: DataFrame, how: Phrases) -> DataFrame:
    """(anchor, first, start, at, words, windows): consecutive recurring windows around one anchor, in the document where they come first; ``at`` is the anchor's place in the words."""

    @F.pandas_udf("array<struct<anchor:long,start:int,at:int,words:string,windows:int>>")
    def runs(texts: pd.Series, starts: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, starts, strict=True):
            words, found = unpack(t), []
            own = np.unique(np.concatenate([np.arange(p["start"], p["start"] + p["windows"]) for p in own]))
            anchors, place = anchors_of(prints_in(t), how)
            for run in np.split(own, np.flatnonzero((np.diff(own) != 1) | (np.diff(place[own]) != 0)) + 1):
                low, high = int(run[0]), int(run[-1]) + 1
                found.append({"anchor": int(anchors[low]), "start": low, "at": int(place[low]) - low, "words": b" ".join(words[low : high + how.window - 1]).decode("utf-8", "surrogatepass"), "windows": high - low})
            out.append(found)
        return pd.Series(out)

    starts = firsts.groupBy(F.col("_row").alias("_of")).agg(F.collect_list(F.struct("start", "windows")).alias("_starts"))
    both = held.select("_row", "_id", "packed").join(starts, F.col("_row") == F.col("_of"))
    return both.select(F.col("_id").alias("first"), F.explode(runs("packed", "_starts")).alias("_p")).select("first", "_p.*")


def located(held: DataFrame, known: DataFrame, how: Phrases) -> DataFrame:
    """(_row, ranges): where each document's windows repeat earlier ones, as first start, last start, and so on.

    Documents are dealt to shards by their least recurring anchor, which versions of one text mostly share, and a shard that is too large is split.
    Each shard compiles the phrases that the anchors of its documents name, and nothing else can occur in them.
    """
    docs = held.select("_row", F.col("bytes").alias("_bytes"), F.array_min("anchors").alias("_least"), "anchors")
    shards = max(1, -(-(docs.agg(F.sum("_bytes")).first()[0] or 0) // how.stream))
    docs = docs.withColumn("_shard", F.pmod(F.xxhash64(F.lit(7), F.col("_least")), F.lit(shards)).cast("int"))
    parts = docs.groupBy(F.col("_shard").alias("_s")).agg(F.ceil(F.sum("_bytes") / how.stream).cast("int").alias("_parts"))
    dealt = docs.join(parts, F.col("_shard") == F.col("_s")).withColumn("_part", F.pmod(F.xxhash64(F.lit(4), F.col("_row")), F.col("_parts")).cast("int"))
    dealt = settle(dealt.select("_row", "_shard", "_part", "anchors"), "dealt")

    named = dealt.select("_shard", "_part", F.explode("anchors").alias("_a")).distinct()
    tools = named.join(known, F.col("_a") == F.col("anchor")).select("_shard", "_part", "first", "start", "at", "words", "windows")
    to = dealt.select(F.col("_row").alias("_of"), F.col("_shard").alias("_to"), F.col("_part").alias("_nth"))
    sent = held.select("_row", "_id", "packed").join(to, F.col("_row") == F.col("_of")).drop("_of")

    def stream(own: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(occurrences(own, texts, how), columns=["_row", "ranges"])

    return tools.groupBy("_shard", "_part").cogroup(sent.groupBy("_to", "_nth")).applyInPandas(stream, "_row long, ranges array<int>")


def occurrences(known: pd.DataFrame, docs: pd.DataFrame, how: Phrases) -> list[tuple[int, list[int]]]:
    """One shard: compile the phrases' anchors, stream the documents, and at every occurrence look up the windows that hold it.

    Every window of a document is looked up once at most, whatever the number of phrases that share an anchor; the ones that come after the first of their kind count.
    """
    if not len(known) or not len(docs):
        return []
    letters: dict[bytes, str] = {}

    def letter(word: bytes) -> str:
        found = letters.get(word)
        if found is None:
            code = len(letters) + 2
            found = letters[word] = chr(code if code < 0xD800 else code + 0x800)  # beyond the surrogates
        return found

    automaton, firsts = ahocorasick.Automaton(), {}
    for first, start, at, words, windows in zip(known["first"].tolist(), known["start"].tolist(), known["at"].tolist(), known["words"], known["windows"].tolist(), strict=True):
        text = "".join(map(letter, words_of(words)))
        automaton.add_word(text[at : at + how.anchor], at)
        for k in range(windows):
            firsts[text[k : k + how.window]] = (first, start + k)
    automaton.make_automaton()
    out = []
    for row, doc, packed in zip(docs["_row"], docs["_id"], docs["packed"], strict=True):
        stream = "".join([letters.get(w, "\x01") for w in unpack(packed)])
        found: list[int] = []
        seen, last = 0, len(stream) - how.window
        for end, _ in automaton.iter(stream):
            place = end - how.anchor + 1
            for here in range(max(seen, end - how.window + 1), min(place, last) + 1):
                earlier = firsts.get(stream[here : here + how.window])
                if earlier is not None and (doc, here) > earlier:
                    if found and found[-1] == here - 1:
                        found[-1] = here
                    else:
                        found += (here, here)
            seen = max(seen, place + 1)
        if found:
            out.append((row, found))
    return out


def trimmed(held: DataFrame, marks: DataFrame, how: Phrases) -> DataFrame:
    """(_of, n_removed, kept_sha256, kept_text) of the documents that lose words."""

    @F.pandas_udf("n_removed long, kept_sha256 string, kept_text string")
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        rows = []
        for t, own in zip(texts, ranges, strict=True):
            words = unpack(t)
            step = np.zeros(len(words) + 1, np.int64)
            own = np.asarray(own, np.int64)
            np.add.at(step, own[::2], 1)
            np.add.at(step, own[1::2] + how.window, -1)
            gone = np.cumsum(step[:-1]) > 0
            kept = b" ".join([w for w, g in zip(words, gone, strict=True) if not g])
            rows.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
        return pd.DataFrame(rows, columns=["n_removed", "kept_sha256", "kept_text"])

    # A document went to one shard.
    marks = marks.withColumnRenamed("_row", "_of")
    return held.select("_row", "packed").join(marks, F.col("_row") == F.col("_of")).select("_of", cut("packed", "ranges").alias("_c")).select("_of", "_c.*")


def remove_repeats(docs: DataFrame, how: Phrases = Phrases()) -> DataFrame:
    """Add n_words, n_removed, kept_sha256 (of the kept words, one blank between) and kept_text (null where nothing was removed)."""
    last = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    known = settle(survey(docs, how).withColumn("_id", last), "survey")
    # The first document of each word sequence stands for its copies.
    leaders = known.filter(F.col("n_words") >= how.window).groupBy("same").agg(F.min(F.struct("_id", "_row")).alias("_lead"))
    leads = settle(leaders.select("same", F.col("_lead._id").alias("_lead_id"), F.col("_lead._row").alias("_lead_row")), "leads")
    copies = known.select("_row", "same").join(leads, "same").filter("_row <> _lead_row").select(F.col("_row").alias("_copy")).distinct()
    first = known.select("_row", "anchors").join(settle(copies, "copies"), F.col("_row") == F.col("_copy"), "left_anti")

    marks = first.select("_row", F.explode("anchors").alias("anchor"))
    again = marks.groupBy("anchor").agg(F.count(F.lit(1)).alias("all")).filter("all > 1").select(F.col("anchor").alias("_again"))
    again = settle(again, "recurring-anchors")
    own = marked(marks, "anchor", again, "_again").join(again, F.col("anchor") == F.col("_again")).groupBy(F.col("_row").alias("_of")).agg(F.collect_set("anchor").alias("anchors"))
    own = settle(own, "anchors")

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(pack)

    texts = marked(docs.select(F.xxhash64("doc_id", "text").alias("_row"), last.alias("_id"), "text"), "_row", own, "_of")
    texts = texts.select("_row", "_id", F.octet_length("text").alias("bytes"), packed("text").alias("packed"))
    held = settle(texts.join(own, F.col("_row") == F.col("_of")).drop("_of").dropDuplicates(["_row"]), "held")

    known_phrases = settle(phrases(settle(recurring_windows(held, how), "windows"), held, how), "phrases")
    lost = settle(trimmed(held, settle(located(held, known_phrases, how), "starts"), how), "trimmed")

    facts = known.select("_row", "_id", "n_words", "whole", "same").distinct().join(leads, "same", "left")
    copy = F.col("_id") > F.col("_lead_id")
    facts = facts.withColumn("_copy", F.coalesce(copy, F.lit(False))).join(lost, F.col("_lead_row") == F.col("_of"), "left")
    facts = facts.select(
        F.col("_row").alias("_known"),
        "n_words",
        F.when(F.col("_copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("_copy"), F.lit(NOTHING)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(F.col("_copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )
    rows = fresh(docs, "n_words", "n_removed", "kept_sha256", "kept_text", "_row", "_known").withColumn("_row", F.xxhash64("doc_id", "text"))
    return rows.join(facts, F.col("_row") == F.col("_known")).drop("_row", "_known")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP4_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS start, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i : i + 19], ' '))) AS words
  FROM words WHERE len(w) >= 20),
firsts AS (SELECT words, min((doc_id, start)) AS first FROM windows GROUP BY words HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT w.doc_id, w.start + k AS pos FROM windows w JOIN firsts f USING (words), (SELECT unnest(range(0, 20)) AS k)
  WHERE (w.doc_id, w.start) > f.first),
lost AS (SELECT doc_id, list(pos) AS lost_at FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(lost_at), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN lost_at IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(lost_at, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM words LEFT JOIN lost USING (doc_id)
"""
