"""Exact token counts of every prefix of a text, for a byte-level BPE vocabulary.

A sequence of tokens is what BPE makes of its bytes exactly when every two neighbours are, so the last token
of a prefix is the one token that ends there and agrees with the last token of the prefix before it.  One pass
over a piece therefore gives the token count of each of its prefixes; counts of whole pieces are added up along
the text.  Truncation and budget questions read these numbers and encode nothing again.

Null and empty texts have 0 tokens.  Special strings inside a text count as their one token, as the library
does by default.  Repeated rows give repeated results; other columns pass through.
"""

from __future__ import annotations

import json
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drainwatch.llm.common import fresh, table

# How the vocabulary's pre-tokenizer cuts a text (a fixed value of the byte-level format).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# What the library's \s matches: the White_Space property.
BLANK = r"\p{White_Space}"
# Counts kept per Python worker; beyond it the memory starts anew.
KEPT_PIECES = 600_000
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable bytes are themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


class PrefixCounter:
    """The vocabulary with its memories: counts of whole pieces, and which tokens may stand side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        plain = lambda s: bytes(letters[c] for c in s)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(plain(a), plain(b)): n for n, (a, b) in reversed(list(enumerate(pairs)))}
        self.halves = {a + b: (a, b) for a, b in self.rank}
        self.edges: tuple[dict, dict] = ({}, {})
        self.tokens = {plain(s) for s in spec["model"]["vocab"] if all(c in letters for c in s)}
        self.longest = max(map(len, self.tokens))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pattern = regex.compile(PIECES.replace(r"\s", BLANK).replace(r"(?!\S)", r"(?!\P{White_Space})"))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.whole: dict[str, int] = {}
        self.sides: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, raw: bytes) -> list[bytes]:
        """BPE by definition: join the neighbours of the lowest rank, leftmost first, until none is left.  For short strings."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, at = min((self.rank.get(p, NEVER), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """What stands at this end of the token while it is being made, each with the rank of the merge that replaces it."""
        out, after = [], NEVER
        while True:
            out.append((token, after))
            halves = self.halves.get(token)
            if halves is None:
                return out
            token, after = halves[side], self.rank[halves]

    def agree(self, left: bytes, right: bytes) -> bool:
        """Whether BPE leaves these two side by side; an empty left asks whether the right one arises at all.

        They are torn apart by a pair across the border whose merge comes before either side has moved on.  Of two
        equal merges the left one comes first.
        """
        known = self.sides.get((left, right))
        if known is None:
            if len(self.sides) > KEPT_PIECES:
                self.sides.clear()
            if left:
                for side, token in ((1, left), (0, right)):
                    if token not in self.edges[side]:
                        self.edges[side][token] = self.edge(token, side)
                known, rank = True, self.rank
                for a, a_goes in self.edges[1][left]:
                    for b, b_goes in self.edges[0][right]:
                        at = rank.get((a, b), NEVER)
                        if at < a_goes and at <= b_goes and at < NEVER:
                            known = False
            else:
                known = self.merged(right) == [right]
            self.sides[left, right] = known
        return known

    def prefixes(self, raw: bytes) -> list[int]:
        """Token counts of raw[:0], raw[:1], ... of one piece."""
        n, longest, tokens, agree = len(raw), self.longest, self.tokens, self.agree
        last, count = [b""] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - longest), end):
                token = raw[start:end]
                if token in tokens and agree(last[start], token):
                    last[end], count[end] = token, count[start] + 1
                    break
        return count

    def piece(self, piece: str) -> int:
        known = self.whole.get(piece)
        if known is None:
            if len(self.whole) > KEPT_PIECES:
                self.whole.clear()
            known = self.whole[piece] = self.prefixes(piece.encode("utf-8", "replace"))[-1]
        return known

    def pieces(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out = []
        for n, part in enumerate(self.cut.split(text)):
            out += [part] if n % 2 else self.pattern.findall(part)
        return out

    def counts(self, pieces: list[str]) -> list[int]:
        get, special = self.whole.get, self.special
        return [get(p) or (1 if p in special else self.piece(p)) for p in pieces]

    def count(self, text: str | None) -> int:
        return sum(self.counts(self.pieces(text))) if text else 0

    def inside(self, before: str, piece: str) -> list[int]:
        """Tokens of ``before`` + each prefix of the piece, less those of ``before``: for the last piece of a cut text.

        ``before`` is the piece in front, which a cut can change (a run of blanks reaches further, half a special string is plain text).
        """
        base = self.count(before)
        raw = piece.encode("utf-8", "replace")
        blank = len(piece) - len(piece.lstrip())
        if piece in self.special or piece[0] == "'" or (blank and before and before[-1].isspace()):
            return [self.count(before + piece[:i]) - base if i else 0 for i in range(len(piece) + 1)]
        at, ends = 0, [0]
        for c in piece:
            at += len(c.encode("utf-8", "replace"))
            ends.append(at)
        by_byte = self.prefixes(raw)
        return [by_byte[e] for e in ends]

    def prefix_counts(self, text: str | None) -> list[int]:
        """Exact token counts of text[:0], text[:1], ..., text[:len(text)]."""
        out, base, before = [0], 0, ""
        for piece in self.pieces(text or ""):
            own = self.inside(before, piece)
            out += [base + c for c in own[1:]]
            base, before = base + (1 if piece in self.special else self.piece(piece)), "" if piece in self.special else piece
        return out

    def fits(self, text: str | None, budget: int) -> tuple[int, int]:
        """All tokens of the text, and the length of its longest prefix of at most ``budget`` tokens."""
        if not text:
            return 0, 0
        pieces = self.pieces(text)
        counts = self.counts(pieces)
        total = sum(counts)
        if total <= budget:
            return total, len(text)
        starts, chars, over = [0], [0], len(pieces)
        for k, (piece, n) in enumerate(zip(pieces, counts, strict=True)):
            starts.append(starts[-1] + n)
            chars.append(chars[-1] + len(piece))
            if starts[-1] > budget and over == len(pieces):
                over = k
            if k > over + 1:
                break
        # A cut can change the piece in front of it, so the answer may lie one piece beyond the first that goes over.
        for k in range(min(over + 1, len(pieces) - 1), -1, -1):
            before = pieces[k - 1] if k and pieces[k - 1] not in self.special else ""
            good = [i for i, c in enumerate(self.inside(before, pieces[k])) if i and starts[k] + c <= budget]
            if good:
                return total, chars[k] + good[-1]
        return total, 0


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, budget: int, text: str = "text") -> DataFrame:
    """Add n_bytes, n_tokens, over_limit and chars_within (longest prefix, in characters, of at most ``budget`` tokens)."""

    @F.pandas_udf("n_tokens long, chars_within long")
    def counted(texts: pd.Series) -> pd.DataFrame:
        own = counter(vocabulary)
        return pd.DataFrame([own.fits(t, budget) for t in texts], columns=["n_tokens", "chars_within"])

    rows = fresh(docs, "n_bytes", "n_tokens", "over_limit", "chars_within", "_counted").withColumn("_counted", counted(F.col(text)))
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    tokens = F.col("_counted.n_tokens")
    return rows.select("*", size.alias("n_bytes"), tokens.alias("n_tokens"), (tokens > budget).alias("over_limit"), F.col("_counted.chars_within").alias("chars_within")).drop("_counted")


def with_prefix_counts(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Add prefix_tokens: an array with the exact token count of every prefix, one entry per character and one for the empty prefix."""

    @F.pandas_udf("array<int>")
    def counted(texts: pd.Series) -> pd.Series:
        own = counter(vocabulary)
        return pd.Series([own.prefix_counts(t) for t in texts])

    return fresh(docs, "prefix_tokens").withColumn("prefix_tokens", counted(F.col(text)))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024).drop("text")
