"""Main text of web pages by line-block distribution.

Markup is stripped to lines: one for each block of text, with the characters of it that are not link text. Lines of
elements that are no article (navigation, headers, footers, forms, scripts, adverts, comments ...) weigh nothing and
are no text. Lengths are summed over windows of ``WINDOW`` lines; the text starts where the sums surge above ``SURGE``
characters and ends where they dive back, and between surge and dive every line is kept whole, lines of links too.

Article elements weigh in on that: where a page marks its article, each line of it weighs more than a surge by itself, and lines
outside weigh nothing and are left out. Article elements that hold less text of their own than the lines around them, which surge without
them, are teasers: then they are what weighs nothing. A page on which nothing surges gives all lines with text of their own.

Null html is an empty page: empty text, no characters. Broken markup (unclosed or crossing elements, cut references,
stray brackets) never fails. Every row gives one row; extra columns don't matter.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 86

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?>[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-z][a-z0-9:-]*+)([^<>]*+)>|<[!?][^>]*+>",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-z-]++)\s*+(?:=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+", re.IGNORECASE)
_SPACE = re.compile(r"\s+")

BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: an open one of these is closed by the next block that can't be inside it
LOOSE = frozenset("p li dt dd td th tr option".split())
NOISE_TAGS = frozenset("nav header footer aside form head select button dialog menu object embed canvas audio video map label fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status".split())
NOISE_NAMES = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising banner promo promotion "
    "sponsor sponsored cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription social share sharing "
    "related recommended breadcrumb breadcrumbs comment comments reply replies disqus widget pagination pager toolbar login signup search "
    "copyright legal disclaimer form".split()
)
ARTICLE_TAGS = frozenset(("article", "main"))


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): (value or "").strip("\"'") for name, value in _ATTRIBUTE.findall(text)}


def _is_noise(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NOISE_TAGS:
        return not (tag == "header" and in_article)
    if tag in ARTICLE_TAGS and "comment" not in attributes.lower() or tag in ("body", "html") or not attributes.strip():
        return False
    found = _attributes(attributes)
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in NOISE_ROLES:
        return True
    if "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    for name in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
        parts = re.split(r"[-_]+", name)
        if parts[0] not in ("has", "no", "with", "without") and (parts[0] in NOISE_NAMES or parts[-1] in NOISE_NAMES):
            return True
    return False


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    """Lines of a page: text, its characters outside links, whether an article element holds it. Noise has no text."""
    lines: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool]] = []
    parts: list[tuple[str, bool]] = []
    noise = article = links = at = 0
    open_: Counter[str] = Counter()

    def end_line() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(p for p, _ in parts))).strip()
            if text:
                linked = sum(len(_SPACE.sub(" ", html.unescape(p)).strip()) for p, in_link in parts if in_link)
                lines.append((text, max(0, len(text) - linked), article > 0))
            parts.clear()

    def leave() -> str:
        nonlocal noise, article, links
        tag, dropped = stack.pop()
        open_[tag] -= 1
        noise -= dropped
        article -= tag in ARTICLE_TAGS and not dropped
        links -= tag == "a"
        return tag

    for token in _TOKEN.finditer(page):
        if token.start() > at and not noise:
            parts.append((page[at : token.start()], links > 0))
        at = token.end()
        closing, tag, attributes = token.group(2, 3, 4) if token.group(3) else token.group(5, 6, 7)
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            end_line()
        if closing:
            if open_[tag]:
                while True:
                    left = leave()
                    if left == tag:
                        break
            continue
        if tag in LOOSE or tag in BLOCKS and stack and stack[-1][0] == "p":
            if stack and stack[-1][0] in LOOSE and (stack[-1][0] == tag or stack[-1][0] == "p"):
                leave()
        if tag in VOID or attributes.rstrip().endswith("/"):
            continue
        if tag in ARTICLE_TAGS and noise and not _is_noise(tag, attributes, False) and all(n in ("nav", "header", "aside") for n, d in stack if d):
            while noise:  # menu that was never closed
                leave()
        dropped = _is_noise(tag, attributes, article > 0)
        if dropped:
            end_line()
        stack.append((tag, dropped))
        open_[tag] += 1
        noise += dropped
        article += tag in ARTICLE_TAGS and not dropped
        links += tag == "a"
    if at < len(page) and not noise:
        parts.append((page[at:], links > 0))
    end_line()
    return lines


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    lines = page_lines(page or "")
    if not lines:
        return ""
    marked = np.array([inside for _, _, inside in lines])
    sizes, own = (np.array([f(line) for line in lines]) for f in (lambda x: len(x[0]), lambda x: x[1]))

    def sums(weights: np.ndarray) -> np.ndarray:  # of each line and those that follow
        return np.convolve(weights, np.ones(window, dtype=np.int64))[window - 1 :]

    around = np.where(marked, 0, own)
    teasers = marked.any() and around.sum() > own[marked].sum() and bool((sums(around) > surge).any())
    if teasers:
        member, weights = ~marked, around
    elif marked.any():
        member, weights = marked, np.where(marked, sizes + surge + 1, 0)
    else:
        member, weights = ~marked, own
    high = sums(weights) > surge
    if not high.any():
        return "\n".join(text for text, n, _ in lines if n)
    kept, inside = [], False
    for i, (text, _, _) in enumerate(lines):
        if not inside and high[i] and weights[i]:  # surge, at the first line with text of its own
            inside = True
        elif inside and not high[i] and not weights[i]:  # dive
            inside = False
        if inside and member[i]:
            kept.append(text)
    return "\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, 256)
            at += 256
            texts = [main_text(page.as_py()) for page in part.column(2)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def extracted(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return pages.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
