"""Quality rules, line first: judge every line by itself, remove the failures, then reject documents that lost too much.

Lines of every length meet the boilerplate and navigation rules: a line that is nothing but a menu word fails, and so does a run of short lines without an end mark.  A line is closed if
it ends in a mark or the next line goes on in lower case; where hardly any line of a text is closed, the open ones fail.  A boilerplate phrase costs the sentences of its line that hold it.

Base figures of a text are exact counts over the whole of it.  Null and empty texts have no words and
therefore fail the base rule.  Repeated rows are judged alike, one result each; other columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drainwatch.llm.common import fresh, table

BYTES = 12
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
NAVIGATION = (b"|", b">", b"\xc2\xbb", b"\xc2\xb7", b"/")
BOILERPLATE = (
    b"all rights reserved", b"click here", b"cookie policy", b"enable javascript", b"lorem ipsum", b"privacy policy", b"read more",
    b"sign up", b"subscribe to", b"terms of use", b"use cookies",
)
# Lines that are menu entries as a whole, apart from what stands around their letters.
MENU = frozenset(
    b"about|about us|all rights reserved|back|back to top|careers|click here|contact|contact us|cookie policy|cookies|disclaimer|faq|follow us|forgot password|home|learn more|leave a comment|load more|log in|"
    b"log out|login|logout|main menu|menu|more|my account|newsletter|next|next page|next post|prev|previous|previous page|previous post|print|privacy|privacy policy|read more|register|reply|rss|search|share|"
    b"share this|show more|sign in|sign out|sign up|site map|sitemap|skip to content|skip to main content|subscribe|terms|terms and conditions|terms of service|terms of use|tweet|view all".split(b"|")
)
AROUND = re.compile(rb"\A[^a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff]+\Z")
SENTENCE = re.compile(rb"(?<=[.!?])[ \t\x0b\x0c\r]+")
END_MARKS = tuple(c.encode() for c in ".!?:;,…。！？：；，、")
CLOSERS = tuple(c.encode() for c in "”’»」』）")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_removed_words long, kept boolean"


@dataclass(frozen=True)
class LineRules:
    """Thresholds.  Shares are in hundredths, compared in whole numbers."""

    min_words: int = 50
    max_repeat: int = 50
    max_lost: int = 30
    min_judged: int = 3  # words a line needs before the shape rules apply to it
    max_symbols: int = 50  # symbols per 100 words of a line
    max_navigation: int = 20  # separators standing alone per 100 words
    max_echo: int = 40  # words equal to the one before, per 100 words
    max_short: int = 4  # words of a line that may be a menu entry, of BYTES bytes each at most
    min_run: int = 3  # short lines without an end mark, one after another, that are a menu
    min_closed: int = 12  # closed lines per 100, of a text of min_run lines or more


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that the text holds at least twice."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 2_000_000:  # the product of three ids would not fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, times = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : k + len(again)] |= again
    return int(inside.sum())


def line_fails(line: bytes, words: list[bytes], earlier: bool, rules: LineRules) -> bool:
    """A line with at least one word: menu entries, repeats of an earlier line, and lines that are not prose."""
    if earlier:
        return True
    n = len(words)
    if 100 * sum(words.count(s) for s in NAVIGATION) > rules.max_navigation * n:
        return True
    if n <= rules.max_short and len(line.strip()) <= BYTES * rules.max_short and AROUND.sub(b"", b" ".join(words).lower()) in MENU:
        return True
    if n < rules.min_judged:
        return False
    if 100 * sum(line.count(s.encode()) for s in SYMBOLS) > rules.max_symbols * n:
        return True
    if len(line) - len(line.translate(None, UPPER)) > len(line) - len(line.translate(None, LOWER)):
        return True
    return 100 * sum(a == b for a, b in zip(words, words[1:], strict=False)) > rules.max_echo * n


def marked_end(line: bytes) -> bool:
    """The line ends in a mark, whatever quotes and brackets close behind it."""
    while True:
        line = line.rstrip(b" \t\x0b\x0c\r\"')]}*_")
        closer = next((c for c in CLOSERS if line.endswith(c)), None)
        if closer is None:
            return line.endswith(END_MARKS)
        line = line[: -len(closer)]


def phrase_words(line: bytes) -> int:
    """Words of the line's sentences that hold a boilerplate phrase."""
    low = line.lower()
    if not any(p in low for p in BOILERPLATE):
        return 0
    return sum(len(s.split()) for s in SENTENCE.split(low) if any(p in s for p in BOILERPLATE)) or len(low.split())


def open_lines(lines: list[tuple[bytes, list[bytes]]], rules: LineRules) -> list[bool]:
    """Which of the lines with words fail for how they end: runs of menu entries, and all open lines of a text that has hardly any closed one."""
    marked = [marked_end(line) for line, _ in lines]
    fails = [False] * len(lines)
    start = 0
    for i in range(len(lines) + 1):
        if i == len(lines) or marked[i] or len(lines[i][1]) > rules.max_short or len(lines[i][0].strip()) > BYTES * rules.max_short:
            if i - start >= rules.min_run:
                fails[start:i] = [True] * (i - start)
            start = i + 1
    goes_on = [words[0].decode("utf-8", "replace")[0].islower() for _, words in lines[1:]] + [False] * bool(lines)
    closed = [m or (g and not f) for m, g, f in zip(marked, goes_on, fails, strict=True)]
    if len(lines) >= rules.min_run and 100 * sum(closed) < rules.min_closed * len(lines):
        fails = [f or not c for f, c in zip(fails, closed, strict=True)]
    return fails


def judge(text: str | None, rules: LineRules) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # splits bytes at exactly the six ASCII blanks
    seen: set[bytes] = set()
    dup = lost = 0
    lines = [(line, own) for line in raw.split(b"\n") if (own := line.split())]
    for (line, own), is_open in zip(lines, open_lines(lines, rules), strict=True):
        earlier = line in seen
        dup += earlier
        seen.add(line)
        lost += len(own) if is_open or line_fails(line, own, earlier, rules) else phrase_words(line)
    n, repeat = len(words), repeated_words(words)
    failed = n < rules.min_words or 100 * repeat > rules.max_repeat * n
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    return n, chars, sum(text.count(c) for c in SYMBOLS), dup, repeat, failed, lost, not failed and 100 * lost <= rules.max_lost * n


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """Add the base figures, the words lost with failed lines, and the verdict."""

    @F.pandas_udf(SCHEMA)
    def judged(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(t, rules) for t in texts], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = fresh(docs, *names, "_judged").withColumn("_judged", judged(F.col(text)))
    return rows.select("*", *[F.col(f"_judged.{n}").alias(n) for n in names]).drop("_judged")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *names)
