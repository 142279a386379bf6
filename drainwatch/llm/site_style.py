"""Main text of web pages by site style trees.

All pages of a host are merged into one tree of style nodes (paths of tags with their classes).  A node is as important as its presentation
and its content vary: the entropy of the child sequences seen under it over the host's pages, and, for what stands below it, one less the entropy of each
text block's spread over the pages.  Branches of low importance (the same menu, notice or link list on page after page) are cut from every page, but never inside an article or main
element: what recurs there, as headings and table heads do, is the article's own.  Elements whose tag, class or
role says that they are not the article are cut without counting, as a host of one page has nothing to compare.  A class or id says so as a whole, not by one of its words, and neither it nor a form
hides an article that stands within and is the page's only one.  From the rest the article
is taken, or the main element, or the body, whichever is there first.

A null or empty page gives the empty text.  Pages without a host are judged by their elements alone.  Pages of a host with the same text, before any branch is cut, count once in
the tree, whatever else their html holds, so an article that was crawled many times is not taken for boilerplate.  Without an article or main element, copies that differ in a block which nothing marks as noise count as pages of their own.  Repeated rows give repeated results; other columns pass through.  Nodes nested deeper
than MAX_DEPTH share the style node of that depth (their text is kept).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drainwatch.llm.common import fresh, settle, table

MAX_DEPTH = 64
TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")
OPEN_END = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY_BLOCK = frozenset(["p"])
CLOSES_ITSELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select", "datalist")}
NOISE_TAGS = frozenset("aside button canvas datalist dialog embed footer form head iframe menu nav noframes noscript object script select style svg template textarea title video audio".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE_NAMES = frozenset(
    "ad ads adsense advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter "
    "notice notices overlay pager pagination popup promo promotion recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(frozen=True)
class StyleTree:
    min_pages: int = 5  # fewer pages of a node say nothing about it
    least: float = 0.3  # importance below which a branch is cut
    gamma: float = 0.9  # how much the descendants count for a node with few presentations


def attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


# Words that name a box and not what it says; beside them a name of noise still names noise ("site-header", "share-buttons").
BOX_WORDS = frozenset(
    "area bar block blocks body bottom box btn button buttons center col column container content desktop fixed form global group holder icons inner item items js left link links list main mobile module outer "
    "page panel posts primary region right row secondary section sidebar site slot sticky strip top unit wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A branch is text, noise by its name or as a form (which may still hold the article), or noise by its element; RESCUED is an article that stands within noise by name.
TEXT, SOFT, HARD, RESCUED = 0, 1, 2, -1


def names_noise(name: str) -> bool:
    """A class or id that says noise as a whole: a name of noise alone or among words for boxes.  "no-sidebar" and "related-work" say something else."""
    parts = [p.lower() for p in NAME_PART.findall(name)]
    return any(p in NOISE_NAMES for p in parts) and all(p in NOISE_NAMES or p in BOX_WORDS for p in parts)


def noise_of(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    if tag == "form":
        return SOFT
    if tag in NOISE_TAGS or (tag == "header" and not in_article) or "hidden" in attrs or attrs.get("role", "").lower() in NOISE_ROLES:
        return HARD
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
    if tag == "article":
        return HARD if any(p.lower() in ("comment", "comments", "reply") for n in names for p in NAME_PART.findall(n)) else TEXT
    # Ids of headings are made from their words.
    if tag in ("html", "body", "main") or tag in HEADINGS:
        return TEXT
    return SOFT if any(map(names_noise, names)) else TEXT


def parse(html: str | None) -> tuple[list[tuple[str, str, int, int]], dict[str, list[str]]]:
    """Blocks in page order (style path, text, 2 in an article / 1 in main / 0 elsewhere, kind of noise), and the children of each style node."""
    html = html or ""
    stack: list[tuple[str, str, int, int]] = []  # tag, path, noise, region
    blocks, words, styles = [], [], {}

    def flush():
        if words:
            text = " ".join(unescape("".join(words)).split())
            if text:
                _, path, noise, region = stack[-1] if stack else ("", "", TEXT, 0)
                blocks.append((path, text, region, noise))
            words.clear()

    def pop(n: int):
        if any(s[0] not in INLINE for s in stack[n:]):
            flush()
        del stack[n:]

    at = 0
    while m := TAG.search(html, at):
        if m.start() > at:
            words.append(html[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            n = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if n is not None:
                pop(n)
            elif tag == "p":  # makes an empty paragraph; other ends without a start are nothing
                flush()
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag not in INLINE:
            if stack and stack[-1][0] != "button":
                n = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in CLOSED_BY_BLOCK or stack[k][0] not in INLINE), None)
                if n is not None and stack[n][0] in CLOSED_BY_BLOCK:
                    pop(n)
            if tag in CLOSES_ITSELF:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        pop(k)
                        break
                    if stack[k][0] in CLOSES_ITSELF[tag]:
                        break
            flush()
        if tag in VOID:
            continue
        _, above, noise, region = stack[-1] if stack else ("", "", TEXT, 0)
        if tag in INLINE and not m[3]:
            stack.append((tag, above, noise, region))
            continue
        attrs = attributes(m[3]) if m[3] else {}
        own = noise_of(tag, attrs, region == 2)
        if tag in INLINE and not own:
            stack.append((tag, above, noise, region))
            continue
        label = tag + "".join(f".{c}" for c in sorted(attrs.get("class", "").split())[:3])
        path = f"{above}/{label}" if len(stack) < MAX_DEPTH else above
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if own and noise <= TEXT:
            flush()
        styles.setdefault(above, []).append(label)
        styles.setdefault(path, [])
        if noise == SOFT and own == TEXT and tag in ("article", "main"):
            kind = RESCUED
        else:
            kind = own if noise <= TEXT and own else max(noise, own) if noise > TEXT else noise
        stack.append((tag, path, kind, max(region, 2 if tag == "article" else 1 if tag == "main" else 0)))
    rest = html[at:]
    words.append(OPEN_END.sub("", rest))
    flush()
    return blocks, styles


def found_blocks(blocks: list[tuple[str, str, int, int]]) -> list[tuple[str, str, int, int]]:
    """The blocks outside noise of the article, or of the main element, or of the whole page, whichever is there first.

    An article that is less than half of its main element is a part of it, as a teaser is, not the article.  An article within noise by name counts where there is no other.
    """
    own = [b for b in blocks if b[3] == TEXT]
    for rows in (own, [b for b in blocks if b[3] == RESCUED]):
        article, main = [b for b in rows if b[2] == 2], [b for b in rows if b[2] >= 1]
        chars = [sum(len(b[1]) for b in part) for part in (article, main)]
        if chars[0] and 2 * chars[0] >= chars[1]:
            return article
        if main:
            return main
    return own


def main_text(html: str | None, cut) -> str:
    """The page's text without noise and without the branches in ``cut`` (style paths)."""
    cut = [] if cut is None else list(cut)
    kept = [b for b in found_blocks(parse(html)[0]) if b[2] or not any(b[0] == c or b[0].startswith(c + "/") for c in cut)]
    return "\n".join(b[1] for b in kept)


def _feature(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def page_features(html: str | None) -> tuple[int, list[tuple[str, bool, int]]]:
    """The print of the page's text, and (style path, is content, feature), each once per page: the child sequence of every node, the text of every block outside noise."""
    blocks, styles = parse(html)
    out = {(p, False, _feature(" ".join(dict.fromkeys(c)))) for p, c in styles.items() if p}
    out |= {(b[0], True, _feature(b[1])) for b in blocks if b[3] <= TEXT}
    return _feature("\n".join(b[1] for b in found_blocks(blocks))), sorted(out)


def branch_importance(pages: DataFrame, how: StyleTree = StyleTree()) -> DataFrame:
    """(host, path, pages, importance) of every style node of every host.  Only counts are shuffled."""

    @F.pandas_udf("text long, features array<struct<path:string,content:boolean,feature:long>>")
    def features(htmls: pd.Series) -> pd.DataFrame:
        parsed = [page_features(h) for h in htmls]
        return pd.DataFrame({"text": [t for t, _ in parsed], "features": [[{"path": p, "content": c, "feature": f} for p, c, f in own] for _, own in parsed]})

    own = pages.filter("_host IS NOT NULL AND html IS NOT NULL").select(F.xxhash64("html").alias("_html"), "_host", features("html").alias("_page"))
    # Of the pages with one text, one stands for all: each has one child sequence per node.
    each = own.groupBy("_host", F.col("_page.text").alias("_text")).agg(F.min_by("_page.features", "_html").alias("_features"))
    once = each.select("_host", F.explode("_features").alias("_f")).select("_host", "_f.*")
    # Written once: several aggregates read it, and each would parse the pages again.
    counted = settle(once.groupBy("_host", "path", "content", "feature").agg(F.count(F.lit(1)).alias("n")), "style-counts")
    # Each page has one child sequence per node, so their counts add up to the node's pages.
    shape = counted.filter(~F.col("content")).groupBy("_host", "path").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("styles"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    spread = F.when(F.col("pages") > 1, (F.log("pages") - F.col("nlogn") / F.col("pages")) / F.log("pages")).otherwise(1.0)
    shape = shape.withColumn("node", spread)
    text = counted.filter("content").groupBy("_host", "path").agg(F.sum("n").alias("blocks"), F.sum(F.col("n") * F.log("n")).alias("blogn"))
    leaf = text.join(shape.select("_host", "path", "pages"), ["_host", "path"]).withColumn("weight", F.col("blocks") - F.when(F.col("pages") > 1, F.col("blogn") / F.log("pages")).otherwise(0.0))
    steps = F.split("path", "/")
    above = leaf.select("_host", "blocks", "weight", F.explode(F.transform(F.sequence(F.lit(2), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("path"))
    content = above.groupBy("_host", "path").agg((F.sum("weight") / F.sum("blocks")).alias("content"))
    share = F.pow(F.lit(how.gamma), F.col("styles"))
    both = shape.join(content, ["_host", "path"])
    return both.select("_host", "path", "pages", ((1 - share) * F.col("node") + share * F.col("content")).alias("importance"))


def extract_text(pages: DataFrame, how: StyleTree = StyleTree()) -> DataFrame:
    """Add text and n_chars to pages (url, html).  The style trees are written once, to the shared folder, as they are needed by every page."""
    rows = fresh(pages, "text", "n_chars", "_host", "_cut_host", "_cut").withColumn("_host", F.lower(F.try_parse_url("url", F.lit("HOST"))))
    last = F.regexp_extract("path", r"([^/.]*)[^/]*$", 1)
    low = branch_importance(rows, how).filter((F.col("importance") < how.least) & (F.col("pages") >= how.min_pages) & ~last.isin("html", "body", "article", "main"))
    cuts = settle(low.groupBy(F.col("_host").alias("_cut_host")).agg(F.sort_array(F.collect_set("path")).alias("_cut")), "style-cuts")

    @F.pandas_udf("string")
    def texts(htmls: pd.Series, cut: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, c) for h, c in zip(htmls, cut, strict=True)])

    joined = rows.join(cuts, rows["_host"] == cuts["_cut_host"], "left").withColumn("text", texts("html", "_cut"))
    return joined.withColumn("n_chars", F.length("text").cast("long")).drop("_host", "_cut_host", "_cut")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
