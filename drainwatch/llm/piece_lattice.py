"""SentencePiece encoding and decoding as relational work.

Texts are cut into segments that no piece of the vocabulary reaches across, and every distinct segment is encoded once: its substrings of bounded length are
exploded and equi-joined to the piece table, the matches are the edges of the segment's lattice, grouped by segment, and a higher-order aggregate folds
them into the segmentation.  For a model of merges, as the public one is, the best path is the one its merges take: edges are folded in the order of their merges (the best score first, then
from the left), and an edge is taken if just two pieces stand on its span.  What stands inside a span develops alike whatever stands around it, so one pass is the library's result.

A document is the sequence of its segments' ids, and ``encode`` gives every document its own where it is read: no text and no sequence is shuffled or written.  Texts are read in Arrow batches: a stretch
of texts is cut at once, and every segment is met once a stretch.  A dictionary of the most frequent segments, of bounded size, is made by the joins above and goes to every task.  The segments it lacks meet the
piece table, which goes along, in the task that reads them, and are merged in the same order, those of a stretch together (``Merges``): sending their ids from a shuffled join back to the documents moved every sequence, more than the
input takes.  ``decode`` reads a document's whole sequence back by looking every id up among the pieces.  ``encode_prints`` is both, one after the other, with the counts, the print of the sequence and the comparison of the
decoded text with the text.

Null and empty texts have no ids and decode to the empty text.  Blanks other than the space, unknown characters and controls become byte pieces, as in the library.  A text that itself holds the
character for spaces decodes to spaces (round_trip is false for it, as with the library).  Rows that repeat an id and a text get the same result each; other columns pass through, but for those named like a result.
An empty table gives an empty one.  A very long text is one row throughout; its segments are counted and met like all others, and only short ones are remembered from text to text.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import batched, chain, compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drainwatch.llm.common import fresh, settle, table

SPACE = "▁"
# Letters with their marks, or anything else, behind the spaces in front of them.
SEGMENT = regex.compile(rf"{SPACE}*(?:[\p{{L}}\p{{M}}]+|[^\p{{L}}\p{{M}}{SPACE}]+)|{SPACE}+")
# Spaces and what follows up to the next: whole segments.
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
# Segments of up to so many characters fold in one long.
BITS = 61
# Broadcast at most: the vocabulary, and so many bytes of the most frequent segments, each with its ids and what a dictionary spends on it.
MOST_PIECES = 500_000
FREQUENT_BYTES = 48_000_000
ENTRY_BYTES = 150
# What a task remembers at most: so many segments that the dictionary lacks, of so many characters each, twice.
UNITS = 60_000
SHORT = 64
HELD_CHARS = 4_000_000
# Texts are cut in stretches of so many bytes, or one longer text; so many segments are merged at a time.
STRETCH_BYTES = 2_000_000
MERGED = 10_000
# Ranks stand above the place, in a long; none is as high as this.
NEVER = 1 << 62


class PieceModel:
    """The vocabulary file of a model of merges, read on the driver.  Its pieces are a table of fixed size."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, model = spec.normalizer_spec, sentencepiece.SentencePieceProcessor(model_file=path)
        if spec.trainer_spec.model_type != 2 or norm.name != "identity" or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces and spec.trainer_spec.byte_fallback):
            raise ValueError("only models of merges with byte pieces and the identity normalizer are supported")
        self.first_byte = model.piece_to_id("<0x00>")
        normal = [(p.piece, i, p.score) for i, p in enumerate(spec.pieces) if p.type == 1]
        order = {s: n for n, s in enumerate(sorted({s for _, _, s in normal}, reverse=True))}
        self.pieces = [(p, i, order[s]) for p, i, s in normal]
        self.longest = max(len(p) for p, _, _ in self.pieces)
        if len(self.pieces) > MOST_PIECES:
            raise ValueError("the piece table is too large to broadcast")
        if any(not SEGMENT.fullmatch(p) for p, _, _ in self.pieces if len(p) > 1):
            raise ValueError("a piece reaches across the cuts between segments")
        self.merges = Merges(self.pieces, self.first_byte)

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, rank)"""
        return spark.createDataFrame(self.pieces, "piece string, id int, rank int")


def stretches(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in parts of STRETCH_BYTES, or of one longer text."""
    texts = texts.cast(pa.string()).fill_null("")
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(texts):
        most = STRETCH_BYTES + (ends[at - 1] if at else 0)
        after = max(at + 1, int(np.searchsorted(ends, most, "right")))
        yield texts.slice(at, after - at)
        at = after


def listed(values: pa.Array) -> list:
    """As to_pylist, which makes every value by itself."""
    return values.to_numpy(zero_copy_only=False).tolist()


def units(text: str) -> list[str]:
    """A text's units; with ``segments`` the rule that ``cut`` follows."""
    return UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []


def segments(unit: str) -> list[str]:
    return SEGMENT.findall(unit)


@cache
def kinds() -> np.ndarray:
    """Of every code point: 1 for letters and marks, 2 for spaces, else 0.  A segment ends where the kind changes, but not behind spaces."""
    kind = np.zeros(0x110000, np.uint8)
    every = np.arange(len(kind), dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    for run in regex.finditer(r"[\p{L}\p{M}]+", every):
        kind[run.start() : run.end()] = 1
    kind[[ord(" "), ord(SPACE)]] = 2
    return kind


def cut(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The segments of the units of all texts in a row, and where each text's begin, and the end.  The space in front of every text but the empty ones is added."""
    texts = pc.replace_substring(texts, SPACE, " ")
    led = pc.binary_join_element_wise(pc.if_else(pc.equal(texts, ""), "", " "), texts, "")
    bounds = np.concatenate([[0], np.cumsum(pc.binary_length(led).to_numpy(zero_copy_only=False), dtype=np.int64)])
    raw = (led.buffers()[2] or pa.py_buffer(b""))[: bounds[-1]]
    kind = kinds()[np.frombuffer(raw.to_pybytes().decode().encode("utf-32-le"), np.uint32)]
    begins = np.zeros(len(kind), bool)
    begins[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 2)
    first = np.zeros(bounds[-1] + 1, bool)
    # From characters to bytes.
    first[:-1][(np.frombuffer(raw, np.uint8) & 0xC0) != 0x80] = begins
    first[bounds] = True
    # The end of all begins nothing.
    offsets = np.flatnonzero(first)
    found = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), raw).dictionary_encode()
    return pa.DictionaryArray.from_arrays(found.indices, pc.replace_substring(found.dictionary, " ", SPACE)), np.searchsorted(offsets, bounds)


def segment_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, n) of the texts, added up in the task while they fit its memory.  What is met once in such a stretch has no place in a dictionary and stays there."""

    def told(counts: Counter) -> Iterator[pa.RecordBatch]:
        words = [w for w, n in counts.items() if n > 1]
        times = [counts[w] for w in words]
        for i in range(0, len(words), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 10_000], pa.string()), pa.array(times[i : i + 10_000], pa.int64())], ["segment", "n"])

    counts: Counter = Counter()
    held = 0
    for batch in batches:
        for texts in stretches(batch.column(0)):
            # Counted in Arrow first: Python meets every segment of a stretch once.
            found, _ = cut(texts)
            counts.update(dict(zip(listed(found.dictionary), np.bincount(found.indices.to_numpy()).tolist(), strict=True)))
            # Long segments count by their size; of short ones the number is bounded.
            sizes = pc.binary_length(found.dictionary).to_numpy(zero_copy_only=False)
            held += int(sizes[sizes > SHORT].sum())
            if len(counts) >= 2 * UNITS or held >= HELD_CHARS:
                yield from told(counts)
                counts, held = Counter(), 0
    yield from told(counts)


class Merges:
    """Which two tokens become which, as sorted arrays.  A token is a piece's id, or beyond all ids a character that is no piece."""

    def __init__(self, pieces: list[tuple[str, int, int]], first_byte: int):
        ids, ranks = {p: i for p, i, _ in pieces}, {p: rank for p, _, rank in pieces if len(p) > 1}
        self.first_byte, self.known = first_byte, max(*ids.values(), first_byte + 255) + 1
        tokens = {c: self.known + ord(c) for p in ranks for c in p} | ids
        of = tokens.get
        made = sorted((a << 32 | b, rank, ids[p]) for p, rank in ranks.items() for k in range(1, len(p)) if (a := of(p[:k])) is not None and (b := of(p[k:])) is not None)
        # The last pair stands for all that become nothing.
        pairs, of_pair, into = zip(*made, ((1 << 63) - 1, NEVER >> 32, 0), strict=True)
        self.pairs, self.rank, self.into = np.array(pairs), np.array(of_pair) << 32, np.array(into)
        alone = {ord(c): i for c, i in ids.items() if len(c) == 1}
        self.alone = np.full(max(alone, default=0) + 2, -1)
        self.alone[list(alone)] = list(alone.values())

    def met(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair, above 32 bits for its place, and what it becomes."""
        pair = left << 32 | right
        at = np.searchsorted(self.pairs, pair)
        at[self.pairs[at] != pair] = len(self.pairs) - 1
        return self.rank[at], self.into[at]

    def merged(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every segment's best pair is merged, the first of equals, until none has one: the fold over the edges that have one border within, the others not being made.

        Gives the token at each place of the segments in a row, which places still begin one, and where the segments begin.  One place without a token stands in front of each segment and one at the end.
        """
        points = np.frombuffer("".join(["\0" + s for s in segments] + ["\0"]).encode("utf-32-le"), np.uint32).astype(np.int64)
        gaps = np.cumsum([0] + [len(s) + 1 for s in segments])
        tokens = self.alone[np.minimum(points, len(self.alone) - 1)]
        tokens = np.where(tokens < 0, self.known + points, tokens)
        tokens[gaps] = -1
        here = np.arange(len(tokens))
        after, before, begins = here + 1, here - 1, tokens >= 0
        rank, into = np.full(len(tokens), NEVER), np.zeros(len(tokens), np.int64)
        best, into[:-1] = self.met(tokens[:-1], tokens[1:])
        rank[:-1] = best | here[:-1]
        while True:
            best = np.minimum.reduceat(rank, gaps[:-1])
            at = best[best < NEVER] & 0xFFFFFFFF
            if not len(at):
                return tokens, begins, gaps
            gone = after[at]
            tokens[at], begins[gone], rank[gone] = into[at], False, NEVER
            after[at] = then = after[gone]
            before[then] = at
            # The merged token meets its neighbours.
            left = np.concatenate([at, before[at]])
            best, into[left] = self.met(tokens[left], tokens[after[left]])
            rank[left] = best | left

    def ids(self, segments: list[str]) -> list[bytes]:
        """The ids of every segment: its tokens, or the bytes of those that are no pieces."""
        tokens, begins, gaps = self.merged(segments)
        sizes = begins.astype(np.int64)
        raw = begins & (tokens >= self.known)
        points = tokens[raw] - self.known
        sizes[raw] = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        ids, spelt = np.repeat(tokens, sizes).astype(np.int32), np.repeat(raw, sizes)
        ids[spelt] = np.frombuffer(points.astype(np.uint32).tobytes().decode("utf-32-le").encode(), np.uint8).astype(np.int32) + self.first_byte
        packed, ends = ids.tobytes(), (4 * np.concatenate([[0], np.cumsum(sizes)])[gaps]).tolist()
        return [packed[s:e] for s, e in pairwise(ends)]


class Coder(dict):
    """Segment -> the bytes of its ids, for short segments that the dictionary lacks; of UNITS, those are kept on that are met again."""

    def __init__(self, frequent: dict[str, bytes], pieces: list[tuple[str, int, int]], first_byte: int, merges: Merges | None = None):
        self.frequent, self.first_byte, self.before = frequent, first_byte, {}
        self.ids = {p: i for p, i, _ in pieces}
        self.ranks = {p: rank for p, _, rank in pieces if len(p) > 1}
        self.longest = max(map(len, self.ranks), default=1)
        self.merges = merges or Merges(pieces, first_byte)

    def coded(self, words: list[str]) -> list[bytes]:
        """The ids of each of the segments, which differ."""
        ids = list(map(self.frequent.get, words))
        lacking = [w for w, i in zip(words, ids, strict=True) if i is None]
        met = {w: self.get(w) or self.before.get(w) for w in lacking}
        met |= self.lattices([w for w, i in met.items() if i is None])
        for word, i in met.items():
            if len(word) <= SHORT and word not in self:
                if len(self) >= UNITS:
                    self.before = dict(self)
                    self.clear()
                self[word] = i
        return [met[w] if i is None else i for w, i in zip(words, ids, strict=True)]

    def lattices(self, segments: list[str]) -> dict[str, bytes]:
        """Segment -> its ids.  Short segments are merged together, so that a step is one for all of them."""
        made = {}
        for part in batched((s for s in segments if len(s) <= BITS), MERGED):
            made.update(zip(part, self.merges.ids(part), strict=True))
        for segment in segments:
            if len(segment) > BITS:
                ids = ((self.ids[t],) if t in self.ids else (self.first_byte + b for b in t.encode()) for t in self.folded(segment))
                made[segment] = array("i", chain.from_iterable(ids)).tobytes()
        return made

    def lattice(self, segment: str) -> bytes:
        return self.lattices([segment])[segment]

    def merged(self, segment: str) -> list[str]:
        """The tokens of a short segment."""
        _, begins, _ = self.merges.merged([segment])
        return [segment[s:e] for s, e in pairwise([*np.flatnonzero(begins[1:-1]).tolist(), len(segment)])]

    def folded(self, segment: str) -> list[str]:
        """The fold of ``folds`` over all edges, in time linear to the segment."""
        ranks, n = self.ranks, len(segment)
        edges = [(ranks[p], e, -s) for s in range(n - 1) for e in range(s + 2, min(s + self.longest, n) + 1) if (p := segment[s:e]) in ranks]
        border = bytearray(b"\1") * (n + 1)
        for _, e, back in sorted(edges):
            if border[-back] and border[e] and border.count(1, 1 - back, e) == 1:
                border[1 - back : e] = bytes(e + back - 1)
        return [segment[s:e] for s, e in pairwise(compress(range(n + 1), border))]

    def sequences(self, texts: pa.Array) -> pa.ListArray:
        """Every text's whole sequence."""
        return pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *map(self.stretch, stretches(texts))])

    def stretch(self, texts: pa.Array) -> pa.ListArray:
        found, begin = cut(texts)
        packed = self.coded(listed(found.dictionary))
        ends = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
        each = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
        row = each.take(found.indices)
        return pa.ListArray.from_arrays(row.offsets.take(pa.array(begin)), row.values)


class Reader:
    """ids -> text: pieces become text, written spaces become spaces, the one in front goes."""

    def __init__(self, pieces: list[tuple[str, int, int]], first_byte: int):
        raw = {i: p.replace(SPACE, " ").encode() for p, i, _ in pieces} | {first_byte + b: bytes([b]) for b in range(256)}
        self.none = max(raw) + 1
        self.raw = pa.array([raw.get(i, b"") for i in range(self.none + 1)], pa.large_binary())

    def texts(self, ids: pa.ListArray) -> pa.Array:
        values = ids.values.fill_null(-1).to_numpy(zero_copy_only=False)
        spelt = self.raw.take(pa.array(np.where((values >= 0) & (values < self.none), values, self.none)))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), spelt), pa.scalar(b"", pa.large_binary()))
        return pa.array([read.decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ") for read in joined.to_pylist()], pa.string())


def coder(shared):
    """text -> ids, by one coder for all batches of a task, which goes with the task.  shared: a broadcast (frequent, pieces, first_byte, merges)."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        code = Coder(*shared.value)
        for texts in parts:
            yield code.sequences(texts)

    return ids


def reader(shared):
    """ids -> text.  shared: a broadcast (pieces, first_byte)."""

    @F.arrow_udf("string")
    def text(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read = Reader(*shared.value)
        for ids in parts:
            yield read.texts(ids)

    return text


def coder_and_reader(shared):
    """text -> ids, the text read back from them, and how many of them are bytes: a sequence need not leave the worker to be read.  shared: a broadcast (frequent, pieces, first_byte, merges)."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string,n_byte_tokens:bigint>")
    def both(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        code, read = Coder(*shared.value), Reader(*shared.value[1:3])
        for texts in parts:
            ids = code.sequences(texts)
            values, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
            before = np.concatenate([[0], np.cumsum((values >= code.first_byte) & (values < code.first_byte + 256))])
            yield pa.StructArray.from_arrays([ids, read.texts(ids), pa.array(np.diff(before[ends]), pa.int64())], ["ids", "decoded", "n_byte_tokens"])

    return both


def folds() -> tuple[Column, Column]:
    """The fold over _edges (rank, s, l) of a segment of _n characters: in the bits of a long, and as text for longer segments.

    Edges come by rank, then by their end, then the shortest first (which matters for runs of spaces alone: their pieces all have one rank).
    The state says which positions are borders.  An edge is taken where both its ends are borders and one border lies between.
    """
    inner = "(shiftright(b, e.s + 1) & (shiftleft(1L, e.l - 1) - 1))"
    bits = f"""aggregate(_edges, shiftleft(1L, _n + 1) - 1, (b, e) -> IF(
        (shiftright(b, e.s) & 1) = 1 AND (shiftright(b, e.s + e.l) & 1) = 1 AND {inner} <> 0 AND ({inner} & ({inner} - 1)) = 0,
        b & ~shiftleft({inner}, e.s + 1), b))"""
    text = """aggregate(_edges, repeat('1', _n + 1), (b, e) -> IF(
        substring(b, e.s + 1, 1) = '1' AND substring(b, e.s + e.l + 1, 1) = '1' AND length(replace(substring(b, e.s + 2, e.l - 1), '0', '')) = 1,
        concat(substring(b, 1, e.s + 1), repeat('0', e.l - 1), substring(b, e.s + e.l + 1)), b))"""
    return F.expr(bits), F.expr(text)


def lexicon(words: DataFrame, model: PieceModel) -> DataFrame:
    """words: (segment, ...), one row per segment.  Adds ids (array of int).

    The rows keep their partitioning throughout: all edges of a segment are made where the segment is.
    """
    kept = [c for c in words.columns if c != "segment"]
    pieces = F.broadcast(model.table(words.sparkSession))
    # An empty piece stands for the segment itself, so that segments without edges stay.
    edges = F.broadcast(model.table(words.sparkSession).filter(F.length("piece") > 1).select("piece", "rank").union(words.sparkSession.createDataFrame([("", -1)], "piece string, rank int")))
    own = words.withColumn("_n", F.length("segment"))
    starts = own.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_s"))
    longest = F.least(F.lit(model.longest), F.col("_n") - F.col("_s"))
    lengths = F.concat(F.when(F.col("_s") == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.when(longest > 1, F.sequence(F.lit(2), longest)).otherwise(F.array().cast("array<int>")))
    spans = starts.select("*", F.explode(lengths).alias("_l")).withColumn("_piece", F.col("segment").substr(F.col("_s") + 1, F.col("_l")))
    lattice = spans.join(edges, F.col("_piece") == F.col("piece")).groupBy("segment", "_n", *kept).agg(F.sort_array(F.collect_list(F.struct("rank", (F.col("_s") + F.col("_l")).alias("e"), (-F.col("_s")).alias("back"), F.col("_s").alias("s"), F.col("_l").alias("l")))).alias("_edges"))
    lattice = lattice.withColumn("_edges", F.filter("_edges", lambda e: e["rank"] >= 0))

    state_bits, state_text = folds()
    cut = lattice.withColumn("_bits", F.when(F.col("_n") <= BITS, state_bits)).withColumn("_text", F.when(F.col("_n") > BITS, state_text))
    borders = F.expr("IF(_bits IS NOT NULL, filter(sequence(0, _n), i -> (shiftright(_bits, i) & 1) = 1), filter(sequence(0, _n), i -> substring(_text, i + 1, 1) = '1'))")
    cut = cut.select("segment", *kept, borders.alias("_cut"))
    tokens = cut.select("segment", *kept, F.posexplode(F.expr("transform(sequence(0, size(_cut) - 2), i -> substring(segment, _cut[i] + 1, _cut[i + 1] - _cut[i]))")).alias("_at", "_token"))
    known = tokens.join(pieces, F.col("_token") == F.col("piece"), "left")
    raw = F.hex(F.encode("_token", "UTF-8"))
    as_bytes = F.transform(F.sequence(F.lit(0), F.octet_length("_token") - 1), lambda k: F.conv(F.substring(raw, k * 2 + 1, F.lit(2)), 16, 10).cast("int") + model.first_byte)
    own_ids = known.withColumn("_ids", F.when(F.col("id").isNotNull(), F.array("id")).otherwise(as_bytes))
    grouped = own_ids.groupBy("segment", *kept).agg(F.sort_array(F.collect_list(F.struct("_at", "_ids"))).alias("_tokens"))
    return grouped.select("segment", *kept, F.flatten(F.transform("_tokens", lambda t: t["_ids"])).alias("ids"))


def most_frequent(counted: DataFrame, model: PieceModel) -> dict[str, bytes]:
    """The most frequent segments and their ids, up to FREQUENT_BYTES.  counted: (segment, n).

    Sizes are added up by steps of an eighth of an octave of n, some hundred rows; whole steps are taken, so nothing is put in order.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    # A segment has no more ids than bytes.
    size = 5 * F.octet_length("segment") + ENTRY_BYTES
    room, least = FREQUENT_BYTES, None
    for at, taken in sorted(counted.groupBy(step).agg(F.sum(size)).collect(), reverse=True):
        room -= taken
        if room < 0:
            break
        least = at
    if least is None:
        return {}
    rows = lexicon(counted.filter(step >= least).select("segment"), model).toArrow()
    return {s: np.array(i, np.int32).tobytes() for batch in rows.to_batches() for s, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)}


def shared(docs: DataFrame, model: PieceModel):
    """What every task is sent: the most frequent segments of the texts with their ids, and the pieces."""
    counts = docs.select("text").mapInArrow(segment_counts, "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))
    return docs.sparkSession.sparkContext.broadcast((most_frequent(settle(counts, "segments"), model), model.pieces, model.first_byte, model.merges))


def encode(docs: DataFrame, model: PieceModel) -> DataFrame:
    """Add ids: every text's whole sequence."""
    rows = fresh(docs, "ids")
    return rows.withColumn("ids", coder(shared(rows, model))("text"))


def decode(rows: DataFrame, model: PieceModel) -> DataFrame:
    """Add decoded to rows with ids.

    Runs of byte pieces are put together before they are read as UTF-8.  Ids that stand for no text give none, and no ids the empty text.
    """
    pieces = rows.sparkSession.sparkContext.broadcast((model.pieces, model.first_byte))
    return fresh(rows, "decoded").withColumn("decoded", reader(pieces)("ids"))


def encode_prints(docs: DataFrame, model: PieceModel) -> DataFrame:
    """Instead of text: ids, decoded, n_tokens, n_byte_tokens, ids_print (of the sequence) and round_trip (the decoded text is the text)."""
    rows = fresh(docs, "ids", "decoded", "n_tokens", "n_byte_tokens", "ids_print", "round_trip", "_coded")
    out = rows.withColumn("_coded", coder_and_reader(shared(rows, model))("text"))
    out = out.withColumns({"ids": F.col("_coded.ids"), "decoded": F.col("_coded.decoded")})
    return out.withColumns(
        {
            "n_tokens": F.size("ids").cast("long"),
            "n_byte_tokens": F.col("_coded.n_byte_tokens"),
            "ids_print": F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(k), "ids"))), 16, "0") for k in (0, 1)]),
            "round_trip": F.col("decoded") == F.coalesce("text", F.lit("")),
        }
    ).drop("text", "_coded")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_prints(table(spark, sf_dir, "documents").select("doc_id", "text"), PieceModel(public_tokenizers.path("piece_bpe_32k.model")))
