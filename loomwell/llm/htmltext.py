"""Main text of web pages by tag-path ratios.

A page is read once into blocks: the text between two block-level marks, under the path of open
block-level elements (with their class and id words).  Inline elements do not change the path.
For each path the text length and the punctuation per block make its ratio, lowered by the share
of link text, and PRIOR times that for a path through an element that is rarely article text
(navigation, forms, ..., or such a class, id or role).  Ratios are smoothed over neighbouring blocks
of the page, both are fused as a geometric mean, and a path is content if it reaches THRESHOLD times
the best.  What a path below the threshold shares with one above is its container: short paragraphs
and headings inside the containers of the content paths (an article or main element, or the parent
of the blocks, or the element that all of these share if that is less than the page) are content
too, unless their path is a link list or has the prior against it.

Blocks come out in page order, character references decoded, white space turned into one space,
trimmed, joined by one \\n; nothing else is dropped or capped.

Null and empty html give an empty text.  Broken markup is read to its end: unclosed elements end
with the page, an unclosed comment or script hides the rest, a stray `<` is text.  Repeated rows
are returned again; ids may be null; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import html
import math
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, trimmed

#: Share of the best fused ratio that makes a path content.
THRESHOLD = 0.35
#: What an element that is rarely article text leaves of a ratio.
PRIOR = 0.001
#: Blocks on either side that smooth a ratio.
REACH = 2

# Elements by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe svg math select object title".split())
BLOCK = set(
    "html body article section nav aside header footer main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre form fieldset figure figcaption address details summary hr head center hgroup menu dialog legend button label option".split()
)
NEVER = set("nav header footer aside form head button fieldset dialog menu label option legend".split())
#: Words of a class or id that speak against article text.
ASIDE = set(
    "ad ads advert adverts advertisement adbox adsense sponsor sponsored sponsors promo promotion banner sidebar aside nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations widget "
    "widgets toolbar pagination pager login search copyright legal".split()
)
ROLES = set("navigation banner contentinfo complementary dialog alertdialog alert search form menu menubar toolbar".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOT_P = BLOCK - {"p"}
#: What an implied end does not reach beyond.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

TAG = re.compile(r"<!--|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
ATTR = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？؟]")
WORD = re.compile(r"[A-Za-z]+")


def _mark(name: str, attrs: str) -> tuple[str, bool]:
    """Path element and whether it is rarely article text (by element, class, id or role) or hidden."""
    label, never = name, name in NEVER
    if attrs and "=" in attrs or "hidden" in attrs:
        for key, a, b, c in ATTR.findall(attrs):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                label += "." + "-".join(value.lower().split())
                never |= any(w in ASIDE for w in WORD.findall(value.lower()))
            elif key == "role":
                never |= value.strip().lower() in ROLES
            elif key == "style":
                never |= bool(HIDDEN.search(value.lower()))
            elif key == "aria-hidden":
                never |= value.strip().lower() == "true"
        never |= bool(re.search(r"(?:^|\s)hidden(?:\s|$|=)", ATTR.sub(" ", attrs)))
    if name in ("body", "html"):
        never = False
    return label, never


def blocks(page: str) -> list[tuple[tuple, str, int, bool]]:
    """(path, text, characters inside links, never article text) of each block, in page order."""
    out: list = []
    stack: list[tuple[str, str, bool]] = []  # element, label, never here or above
    text: list[str] = []
    linked = 0
    link = False
    lower = None

    def flush():
        nonlocal linked
        whole = " ".join("".join(text).split())
        if whole:
            out.append((tuple(x[1] for x in stack), whole, min(linked, len(whole)), bool(stack) and stack[-1][2]))
        text.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            text.append(raw)
            if link:
                linked += len(raw)

    def close(names: set, stop: set):
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                flush()
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m.group(0) == "<!--":
            end = page.find("-->", at)
            at = size if end < 0 else end + 3
            continue
        name = m.group(2) or m.group(5)
        if name is None:
            continue
        name, ending, attrs = name.lower(), m.group(1) or m.group(4), m.group(3) or m.group(6) or ""
        if name in RAW and not ending:
            if attrs.rstrip().endswith("/") and name not in ("script", "style", "title", "textarea"):
                continue
            lower = page.lower() if lower is None else lower
            end = lower.find("</" + name, at)
            if len(lower) != size:  # lower-casing changed lengths: search without it
                found = re.compile("</" + name, re.I).search(page, at)
                end = found.start() if found else -1
            if end < 0:
                at = size
            else:
                end = page.find(">", end)
                at = size if end < 0 else end + 1
            continue
        if name == "a":
            link = not ending
            continue
        if name == "br":
            text.append(" ")
            continue
        if name not in BLOCK:
            continue
        if ending:
            close({name}, set())
            flush() if name == "p" else None
            continue
        flush()
        if name == "hr":
            continue
        close({"p"}, NOT_P)
        if name in CLOSES:
            close(CLOSES[name], SCOPE[name])
        label, never = _mark(name, attrs)
        above = bool(stack) and stack[-1][2]
        stack.append((name, label, never or above))
    flush()
    return out


def _holder(path: tuple) -> tuple:
    """Container of a path's blocks: the innermost article or main element, else the parent."""
    marked = [k for k, label in enumerate(path) if label.split(".")[0] in ("article", "main")]
    return path[: marked[-1] + 1] if marked else path[:-1]


def _wide(path: tuple) -> bool:
    return not path or path[-1].split(".")[0] in ("body", "html")


def _ratios(rows: list) -> tuple[dict, dict, dict]:
    """Of each path: ratio (with the prior), fused ratio, and (blocks, characters, share of links, off)."""
    sums: dict = {}
    for path, text, linked, off in rows:
        n, size, marks, links, was = sums.get(path, (0, 0, 0, 0, False))
        sums[path] = (n + 1, size + len(text), marks + len(PUNCTUATION.findall(text)), links + linked, was or off)
    ratio = {p: size / n * (1 + marks / n) * (1 - links / size) * (PRIOR if off else 1) for p, (n, size, marks, links, off) in sums.items()}
    line = [ratio[r[0]] for r in rows]
    weights = [math.exp(-(d * d) / 2) for d in range(-REACH, REACH + 1)]
    smooth = [sum(w * line[i + d] for d, w in zip(range(-REACH, REACH + 1), weights) if 0 <= i + d < len(line)) / sum(weights) for i in range(len(line))]
    near: dict = {}
    for r, s in zip(rows, smooth):
        near.setdefault(r[0], []).append(s)
    fused = {p: math.sqrt(ratio[p] * sum(near[p]) / len(near[p])) for p in ratio}
    return ratio, fused, {p: (n, size, links / size, off) for p, (n, size, _, links, off) in sums.items()}


def _chosen(rows: list) -> list[bool]:
    """Which blocks are content."""
    if not rows:
        return []
    _, fused, sums = _ratios(rows)
    # the best path is the one with most text behind its ratio
    best = max(fused, key=lambda p: fused[p] * math.sqrt(sums[p][1]))
    if fused[best] <= 0:
        return [False] * len(rows)
    linked = {p: 2 * share > 1 for p, (_, _, share, _) in sums.items()}
    passed = {p for p, f in fused.items() if f >= THRESHOLD * fused[best] and not linked[p]} | {best}
    holders = {_holder(p) for p in passed if not sums[p][3]}
    # what the containers share holds them all, unless that is the page
    shared = os.path.commonprefix(list(holders))
    if not _wide(shared):
        holders = {shared}
    plain = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre")
    keep = {}
    for p in fused:
        if p in passed:
            keep[p] = True
        elif sums[p][3] or linked[p]:
            keep[p] = False
        else:
            inside = any(not _wide(p[:k]) and p[:k] in holders for k in range(len(p) + 1))
            keep[p] = inside or bool(p) and p[-1].split(".")[0] in plain and p[:-1] in holders
    return [keep[r[0]] for r in rows]


def main_text(page: str | None) -> str:
    rows = blocks(page or "")
    return "\n".join(r[1] for r, k in zip(rows, _chosen(rows)) if k)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def run(batches):
        for part in slices(batches, 512):
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html").mapInArrow(trimmed(run), "page_id long, url string, text string, n_chars long")
