"""Main text of web pages by a maximum-scoring subsequence.

A page is a row of words and tags. Words score, tags cost; the weights are logarithms of odds,
learned from labelled pages by the tag's name and by the element that a word stands in. One
linear scan (best sum of a contiguous run) finds the content region. Elements that are no
article text by their nature (menus, forms, scripts, adverts, comments ...) are cut out
before the scan, so they neither end a region nor get into it.

Pages are judged one by one: no shuffle, and memory is that of one Arrow batch.

Defined results. Null or empty html: empty text. A page without a region that scores above
nought: empty text. Repeated rows: one result each. Empty table: empty result; no labelled
page: neutral weights. Unclosed or overlapping elements: an end tag closes up to its match,
or nothing. Only the named columns are carried, so others cannot clash.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Elements whose content is no text, elements without content, elements that
#: end a line, elements that are no part of an article, and names that mark page furniture.
RAW = "script style textarea title xmp noembed noframes iframe".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = set("aside button canvas datalist dialog fieldset footer form head header menu nav noscript object option select svg template".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|comment-?list|consent|cookies?|disqus|footer|gdpr|header|masthead|menu|"
    r"modal|nav|navbar|navigation|newsletter|notice|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|"
    r"sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I,
)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)



def furniture(name: str, attributes: str) -> bool:
    if name in FURNITURE or HIDDEN.search(attributes):
        return True
    if name in ("html", "body", "main"):
        return False
    return any(MARKED.search(a or b or c) for a, b, c in NAMES.findall(attributes))


def pieces(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """(tag name or "", text, container, within article) in page order, furniture left out.

    A tag's piece has its name with ``/`` in front if it ends the element.
    """
    stack: list[tuple[str, bool]] = []  # open elements, and whether they began furniture
    hidden = articles = 0
    at = 0

    def text(upto: int):
        if upto > at and not hidden:
            container = next((n for n, _ in reversed(stack) if n in BLOCK), "")
            yield "", page[at:upto], container, articles > 0

    while found := TAG.search(page, at):
        yield from text(found.start())
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        if found[1] or found[4]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is None or name in VOID:
                continue
            if not hidden:
                yield "/" + name, "", name, articles > 0
            for n, mark in stack[depth:]:
                hidden -= mark
                articles -= n in ("article", "main")
            del stack[depth:]
            continue
        attributes = found[3] or found[6] or ""
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in ("article", "main") and hidden and not any(n in ("article", "main") for n, _ in stack):
            stack, hidden = [], 0  # an unclosed menu must not hold the article
        if name in BLOCK and stack and stack[-1][0] == "p":  # a block ends a paragraph
            hidden -= stack.pop()[1]
        mark = name not in VOID and furniture(name, attributes)
        if not hidden and not mark:
            yield name, "", name, articles > 0
        if name not in VOID and not attributes.endswith("/"):
            stack.append((name, mark))
            hidden += mark
            articles += name in ("article", "main")
    yield from text(len(page))


class Weights:
    """Costs of tags and scores of words by container; unknown ones get the defaults."""

    def __init__(self, tags: dict[str, float], words: dict[str, float]) -> None:
        self.tags, self.words = tags, words

    @classmethod
    def learn(cls, pages: list[str]) -> Weights:
        """From pages whose only ``article`` (or ``main``) element holds their main text."""
        inside: Counter[tuple[str, str]] = Counter()
        outside: Counter[tuple[str, str]] = Counter()
        for page in pages:
            for tag, text, container, article in pieces(page):
                key = ("tag", tag) if tag else ("word", container)
                (inside if article and tag not in ("article", "/article", "main", "/main") else outside)[key] += 1 if tag else len(text.split())
        tags, words = {}, {}
        for kind, name in inside.keys() | outside.keys():
            odds = math.log((inside[kind, name] + 0.5) / (outside[kind, name] + 0.5))
            if kind == "tag":
                tags[name] = min(-0.01, odds)
            else:
                words[name] = max(-1.0, min(1.0, odds))
        return cls(tags, words)

    def score(self, tag: str, text: str, container: str, article: bool, has_article: bool) -> float:
        if tag:
            return self.tags.get(tag, -0.5)
        n = len(text.split())
        if has_article and not article:
            return -float(n)
        return n * (self.words.get(container, 0.5) if not article else max(0.1, self.words.get(container, 0.5)))


def best_run(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous run with the largest sum above nought; (0, 0) if none."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, weights: Weights) -> str:
    parts = list(pieces(page or ""))
    has_article = any(p[3] for p in parts)
    start, end = best_run([weights.score(*p, has_article) for p in parts])
    while start > 0 and (parts[start - 1][0] not in BLOCK and parts[start - 1][0].strip("/") not in BLOCK) and (parts[start - 1][3] or not has_article):
        start -= 1  # whole blocks
    while 0 < end < len(parts) and parts[end][0].strip("/") not in BLOCK and (parts[end][3] or not has_article):
        end += 1
    out = []
    for tag, text, _, _ in parts[start:end]:
        if tag:
            if tag.strip("/") in BLOCK:
                out.append(" ")
        else:
            out.append(entities.unescape(text))
    return " ".join("".join(out).split())


MAX_LABELLED = 500


def labelled_pages(pages: DataFrame, max_labelled: int = MAX_LABELLED, html: str = "html") -> list[str]:
    """At most ``max_labelled`` different pages that mark their main text with one ``article`` element.

    Only hashes are ordered, and only the chosen pages' texts reach the driver.
    """
    one = F.col(html).rlike(r"(?i)<article[\s>]") & (F.regexp_count(html, F.lit(r"(?i)<article[\s>]")) == 1) & (F.length(html) <= 200_000)
    last = pages.filter(one).select(F.xxhash64(html).alias("_h")).distinct().orderBy("_h").limit(max_labelled).agg(F.max("_h")).first()[0]
    if last is None:
        return []
    chosen = pages.filter(F.xxhash64(html) <= last).filter(one).groupBy(F.xxhash64(html).alias("_h")).agg(F.min(html).alias("_html"))
    return [r[0] for r in chosen.orderBy("_h").select("_html").limit(max_labelled).collect()]


def extract_text(pages: DataFrame, labelled: list[str] | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` of every page."""
    weights = pages.sparkSession.sparkContext.broadcast(Weights.learn(labelled_pages(pages, html=html) if labelled is None else labelled))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights.value) for page in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(url), pa.array(texts, pa.string())], [key, url, "text"])

    rows = pages.select(key, url, html)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = rows.mapInArrow(extract, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
