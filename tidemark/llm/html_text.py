"""Main text of web pages by tag-path ratios.

Each block's root-to-leaf tag path collects text length and punctuation; the
ratios per block of a path are fused, smoothed along the page and cut at a
threshold, and so paths are chosen. Elements and class names that stand for
menus, notices, forms and the like lower the score of what they hold, unless
they hold most of the page's scored text. The article or main element that holds
most of the chosen text, or else the lowest container of all chosen blocks,
gives the article: its blocks stay, short paragraphs and headings too, but for
those of lowered regions that were not chosen.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by role.
RAW = "script|style|textarea|title|xmp|noframes"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold no text of a page.
NO_TEXT = frozenset("head button select option noscript template iframe object svg canvas audio video map script style textarea title".split())
#: Elements that stand beside an article.
LOWERED = frozenset("nav header footer aside form fieldset dialog menu".split())
#: Words of which a class, id or role consists that names a region beside the article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs"
    " sidebar footer header masthead cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup"
    " comment comments commentlist disqus reply replies share sharing social related recommended widget login search pagination pager toolbar copyright hidden".split()
)
#: Those of them that stand for what readers write.
COMMENTS = frozenset("comment comments commentlist disqus reply replies".split())
#: What is left of a score in a lowered region, and in one of comments.
LEFT, LEFT_OF_COMMENTS = 0.005, 0.0005
#: Share of the page's scored text, comments apart, that a region holds to be the article's own.
MOST = 0.6
#: A start tag of the second kind ends an open element of the first kind.
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements by which markup names an article.
MAIN = frozenset(("article", "main"))
#: Containers that are part of an article, never an article of their own.
PARTS = frozenset("ul ol dl li dt dd table thead tbody tfoot tr td th blockquote figure section p h1 h2 h3 h4 h5 h6 pre details".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LIST_EDGE = frozenset("ul ol dl table select article section div body".split())

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"<]*\"|'[^'<]*'|[^'\">])*+|[^>]*)>|<[!?][^>]*>", re.S | re.I)
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_LETTERS = re.compile(r"[a-z]+")
_PUNCT = re.compile(r"[.,;:!?…。、，！？؟؛]")


@dataclass(slots=True)
class Block:
    """A block of text: its block-level tag path, and the outermost region beside the article that holds it, if any."""

    path: tuple[str, ...]
    text: str
    region: int = -1
    comments: bool = False


def blocks(html: str) -> list[Block]:
    """All blocks with text, in page order."""
    out: list[Block] = []
    # Name, label, whether it holds no text, region, whether that is of comments.
    stack: list[tuple[str, str, bool, int, bool]] = []
    part: list[str] = []
    regions = 0

    def flush() -> None:
        text = " ".join(unescape("".join(part)).split())
        part.clear()
        if text:
            out.append(Block(tuple(x[1] for x in stack), text, *(stack[-1][3:] if stack else ())))

    def pop_to(i: int) -> None:
        flush()
        del stack[i:]

    at = 0
    for m in _TOKEN.finditer(html):
        hidden = bool(stack) and stack[-1][2]
        if m.start() > at and not hidden:
            part.append(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            part.append(" ")
        if name in VOID or name in INLINE:
            if name == "hr":
                flush()
            continue
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop_to(i)
                    break
            else:
                flush()
            continue
        if m["attrs"].endswith("/") and name in ("svg", "path"):
            continue
        flush()
        if name in CLOSES_P and stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and (stack[-1][0] == "p" or name[0] == "h"):
            stack.pop()
        elif name in CLOSES_SAME:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES_SAME[name]:
                    del stack[i:]
                    break
                if stack[i][0] in LIST_EDGE:
                    break
        names = [_LETTERS.findall(x) for g in _ATTR.findall(m["attrs"]) for x in "".join(g).lower().split()] if "=" in m["attrs"] else []
        words = {w for x in names for w in x}
        label = name + "." + min(words) if words and name in ("div", "section", "td", "ul") else name
        off, region, comments = stack[-1][2:] if stack else (False, -1, False)
        if name not in ("html", "body", "main"):
            # A heading of an article can have a header of its own.
            own = name == "header" and any(x[0] in MAIN for x in stack)
            marked = [x for x in names if x and BESIDE.issuperset(x)]
            if region < 0 and (name in LOWERED and not own or marked):
                region, regions = regions, regions + 1
            comments = comments or any(COMMENTS.intersection(x) for x in marked)
        stack.append((name, label, off or name in NO_TEXT, region, comments))
    if at < len(html) and not (stack and stack[-1][2]):
        part.append(html[at:])
    flush()
    return out


def _shared(one: tuple[str, ...], two: tuple[str, ...]) -> int:
    """Length of the common beginning of two paths."""
    return next((i for i, (x, y) in enumerate(zip(one, two)) if x != y), min(len(one), len(two)))


def _container(found: list[Block], chosen: np.ndarray) -> tuple[str, ...]:
    """The path of the container whose blocks are the article."""
    weight: dict[tuple[str, ...], int] = {}
    for b, ok in zip(found, chosen):
        for d in range(len(b.path)):
            if ok and b.path[d] in MAIN:
                weight[b.path[: d + 1]] = weight.get(b.path[: d + 1], 0) + len(b.text)
    total = sum(len(b.text) for b, ok in zip(found, chosen) if ok)
    named = sorted((p for p, w in weight.items() if w >= 0.6 * total), key=len, reverse=True)
    if named:
        # The inner one, unless an outer one adds more text that is chosen than text that is not.
        gain = np.zeros(len(named[0]) + 1, np.int64)
        for b, ok in zip(found, chosen):
            gain[_shared(b.path, named[0])] += len(b.text) if ok else -len(b.text)
        root = named[0]
        for outer in named[1:]:
            if gain[len(outer) : len(root)].sum() > 0:
                root = outer
        return root
    paths = [b.path[:-1] for b, ok in zip(found, chosen) if ok]
    root = paths[0]
    for p in paths[1:]:
        root = root[: _shared(root, p)]
    # Out of parts of an article, and past headings.
    beside = {_shared(b.path, root) for b in found if not b.path or b.path[-1] not in HEADINGS}
    while root and (root[-1].split(".")[0] in PARTS or len(root) - 1 not in beside):
        root = root[:-1]
    return root


def fused_ratios(found: list[Block]) -> np.ndarray:
    """Each block's score: text length and punctuation per block of its tag path, fused, and fused again with what smoothing along the page makes of it."""
    paths: dict[tuple[str, ...], list[float]] = {}
    for b in found:
        p = paths.setdefault(b.path, [0.0, 0.0, 0.0])
        p[0] += len(b.text)
        p[1] += len(_PUNCT.findall(b.text))
        p[2] += 1
    ratio = np.array([paths[b.path][0] / paths[b.path][2] * (1 + paths[b.path][1] / paths[b.path][2]) for b in found])
    padded = np.pad(ratio, 1, mode="edge")
    smooth = padded[:-2] / 4 + padded[1:-1] / 2 + padded[2:] / 4
    return np.sqrt(ratio * smooth)


def lowering(found: list[Block], ratios: np.ndarray) -> np.ndarray:
    """What is left of each block's score: all outside regions, and in a region that holds most of the page's scored text.

    Where markup names an article outside the regions, only what it holds counts against them.
    """
    region, comments = np.array([b.region for b in found]), np.array([b.comments for b in found])
    mass = np.array([len(b.text) for b in found]) * ratios
    named = np.array([bool(MAIN.intersection(b.path)) for b in found])
    left = np.where(region < 0, 1.0, np.where(comments, LEFT_OF_COMMENTS, LEFT))
    for r in set(region[(region >= 0) & ~comments].tolist()):
        own = (region == r) & ~comments
        elsewhere = named & (region < 0)
        if not (elsewhere.any() and not named[own].any()) and mass[own].sum() > MOST * mass[~comments].sum():
            left[own] = 1.0
    return left


def chosen_paths(found: list[Block], scores: np.ndarray, left: np.ndarray, share: float) -> np.ndarray:
    """Which blocks have a path whose mean score reaches ``share`` of the page's, each character weighing as much as is left of its score."""
    size = np.array([len(b.text) for b in found]) * left
    least = share * (scores * size).sum() / size.sum()
    _, at = np.unique(np.array(["\0".join(b.path) for b in found]), return_inverse=True)
    return (np.bincount(at, scores * left) / np.bincount(at, left))[at] >= least


def main_text(html: str, share: float = 0.2) -> str:
    """The article's blocks, joined by one newline."""
    found = blocks(html)
    if not found:
        return ""
    ratios = fused_ratios(found)
    left = lowering(found, ratios)
    chosen = chosen_paths(found, ratios * left, left, share)
    root = _container(found, chosen)
    return "\n".join(b.text for b, ok, x in zip(found, chosen, left) if b.path[: len(root)] == root and (ok or x == 1))


def extract_text(pages: DataFrame, share: float = 0.2) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``; a null or empty page has an empty text.

    Rows that repeat an id or a page each have their own row; null ids are kept;
    an empty table gives no rows; pages of any length are read whole; there are
    no ties, as a threshold decides; extra columns are ignored, whatever their names.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py() or "", share) for h in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")
