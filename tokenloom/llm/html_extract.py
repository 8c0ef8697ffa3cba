"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' shallow features.

A page is cut into text blocks at block-level tags. FEATURES of a block are its number of words and its link density
(share of words inside links), the same of the blocks before and after it, whether it ends like a sentence, whether it is
a heading, its place (in an article element, in the page's frame by tag, role or being hidden, or neither), what part of
the page's words lies in article elements if the block does not, and, under a name (class or id) of a frame, how small a part of
the page's words the named element holds: no name decides by itself, and what most of a page is under is no frame. A name
counts if it has no other words than such names have; names that main text has too are a feature of their own. A decision tree says which blocks are main text; they are joined in page order. It is trained once, on the driver,
on the blocks of TRAINING_PAGES labelled pages, which training.py lays out in many ways, with and without telling names.

A page is read in one pass: a tag without end, or with an odd quotation mark, costs one look at the rest of the page, not
one for each such tag, and open elements are counted, not searched.

Defined cases: null and empty pages, and pages without main text, give the empty text; unclosed and stray tags end where
their parent ends; a `<` that begins no tag is text; a comment, script, style, textarea or title that never ends swallows
the rest; elements that are not shown (svg, button, ...) are left out up to their end tag, if they have one; equal pages
give equal texts; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import slices

# Tags and names of page parts.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title".split())
HIDDEN_TAGS = set("noscript template select button svg iframe object canvas audio video math".split())
FRAME_TAGS = set("nav footer aside form dialog menu".split())
FRAME_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
FRAME_NAMES = set(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promoted banner cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup nav navbar "
    "navigation menu submenu breadcrumb breadcrumbs sidebar sidenav related recommended recommendations share sharing comment comments commentlist reply replies disqus respond footer masthead topbar "
    "login register pagination pager toolbar copyright".split()
)
#: Names that frames have, but main text has too.
VAGUE_NAMES = set("notice alert side widget widgets social discussion foot header search form legal disclaimer promotion".split())
#: Words that names of frames are made of besides; a name with any other word (share-economy, nav-open, no-sidebar) is none.
GLUE = set("content main article post entry page site wrapper wrap container body text box bar list item items area block section top bottom left right slot unit inner outer holder group panel column col row title heading links link thread primary secondary big small mobile desktop global local".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())

TRAINING_PAGES = 400
LEAF_ROWS = 8
DEPTH = 9

_NAME_OF_TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?=[\s/>])")
_REST = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[a-z0-9]+")
_UNSHOWN = re.compile(r"display\s*:\s*none", re.I)
_COMMENT_END = re.compile(r"--!?>")

#: What an open element counts as, besides its words.
HEADING, ARTICLE, FRAME, NAMED, VAGUE = range(5)


def marks_of(tag: str, attrs: str, in_article: bool) -> tuple[int, ...]:
    """What an element counts as, by its tag, role, class and id."""
    out = [HEADING] if tag in HEADINGS else [ARTICLE] if tag in ("article", "main") else []
    if tag in FRAME_TAGS or (tag == "header" and not in_article):
        out.append(FRAME)
    if not attrs.strip(" /") or tag in ("html", "head", "body", "main"):
        return tuple(out)
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attrs)}
    if "hidden" in found or _UNSHOWN.search(found.get("style", "")) or found.get("role") in FRAME_ROLES:
        out.append(FRAME)
    for name in " ".join(found.get(k, "") for k in ("class", "id")).split():
        words = {x for x in _NAME.findall(name) if not x.isdigit()}
        if words <= FRAME_NAMES | VAGUE_NAMES | GLUE:
            kind = NAMED if words & FRAME_NAMES else VAGUE if words & VAGUE_NAMES else None
            if kind is not None and kind not in out:
                out.append(kind)
    return tuple(out)


def tags_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it is an end tag, attributes) of the tags of a page in order; the name is empty for what is left out as a whole."""
    lower = page.lower()
    if len(lower) != len(page):  # some capital letters are two small ones
        lower = "".join(c if len(c.lower()) > 1 else c.lower() for c in page)
    at, last, quotes = 0, page.rfind(">"), True
    ends: dict[str, int] = {}

    def end_tag(name: str, start: int) -> int:
        """Where the first end tag of the name at start or later begins, or -1."""
        if ends.get(name, 0) != -1 and ends.get(name, 0) <= start:
            i = lower.find(f"</{name}", start)
            while i >= 0 and lower[i + len(name) + 2 : i + len(name) + 3] not in (">", "/", " ", "\t", "\n", "\r", "\f", ""):
                i = lower.find(f"</{name}", i + 1)
            ends[name] = i
        return ends.get(name, -1)

    pairs: dict[str, dict[int, int]] = {}

    def pair_of(name: str, start: int) -> int:
        """Where the end tag that belongs to the tag at start begins, others of the name in it set aside, or -1."""
        if name not in pairs:
            open_, found = [], pairs.setdefault(name, {})
            for m in re.finditer(rf"<(/?){name}(?=[\s/>]|$)", lower):
                if not m[1]:
                    if lower[lower.find(">", m.end()) - 1] != "/":
                        open_.append(m.start())
                elif open_:
                    found[open_.pop()] = m.start()
        return pairs[name].get(start, -1)

    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            m = _COMMENT_END.search(page, start + 2)
            at = m.end() if m else len(page)
            yield start, at, "", False, ""
            continue
        if start > last:
            return
        if page[start + 1 : start + 2] in ("!", "?"):
            at = page.index(">", start) + 1
            yield start, at, "", False, ""
            continue
        m = _NAME_OF_TAG.match(page, start + 1)
        if not m:
            at = start + 1
            continue
        rest = _REST.match(page, m.end()) if quotes else None
        if rest is None:
            quotes = False  # an odd quotation mark: from here on quotation marks do not hide the end of a tag
        stop = rest.end() if rest else page.index(">", m.end()) + 1
        name, attrs = m[2].lower(), page[m.end() : stop - 1]
        if not m[1] and name in RAW:
            i = end_tag(name, stop)
            stop = len(page) if i < 0 else (page.find(">", i) + 1 or len(page))
            yield start, stop, "", False, ""
        elif not m[1] and name in HIDDEN_TAGS and not attrs.endswith("/"):
            if (i := pair_of(name, start)) >= 0:
                stop = page.find(">", i) + 1 or len(page)
            yield start, stop, "", False, ""
        else:
            yield start, stop, name, bool(m[1]), attrs
        at = stop


def blocks_of(page: str) -> list[dict]:
    """The text blocks of a page in order, with text, label (of a data-main attribute, if any) and their own features."""
    blocks: list[dict] = []
    stack: list[tuple[str, tuple[int, ...], str | None]] = []  # tag, marks, the label that held before it
    open_: Counter[str] = Counter()
    marks = [0] * 5
    label: str | None = None
    named: dict[int, list[int]] = {NAMED: [], VAGUE: []}  # numbers of the elements so named that are open
    held: list[int] = []  # words in each of them
    article = seen = 0  # words in article and main elements, and in all
    pieces: list[str] = []
    counts = [0, 0]  # words, words in links
    link, at = 0, 0

    def text(raw: str) -> None:
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            pieces.append(plain)
            n = len(plain.split())
            counts[0] += n
            counts[1] += n * link

    def flush() -> None:
        nonlocal article, seen
        words = " ".join("".join(pieces).split())
        if words:
            blocks.append({"text": words, "label": label, "words": counts[0], "links": counts[1] / max(counts[0], 1), "stop": int(words[-1] in ".!?。！？…\"”»"), "heading": int(marks[HEADING] > 0), "place": -1 if marks[FRAME] else int(marks[ARTICLE] > 0), "named": named[NAMED][-1] if named[NAMED] else -1, "vague": named[VAGUE][-1] if named[VAGUE] else -1, "apart": 0.0 if marks[ARTICLE] else 1.0})
            article += counts[0] * (marks[ARTICLE] > 0)
            seen += counts[0]
        pieces.clear()
        counts[:] = [0, 0]

    def pop() -> None:
        nonlocal label
        tag, had, label = stack.pop()
        open_[tag] -= 1
        for k in had:
            marks[k] -= 1
            if k in named:
                number = named[k].pop()
                held[number] = seen - held[number]

    for start, stop, tag, is_end, attrs in tags_of(page):
        text(page[at:start])
        at = stop
        if not tag:
            continue
        if tag == "a":
            link = int(not is_end)
        elif tag == "br":
            pieces.append(" ")
        if tag in BLOCKS:
            flush()
        if is_end:
            if open_[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
                if tag in BLOCKS:
                    link = 0
        elif tag not in VOID and not attrs.endswith("/") and (tag in BLOCKS or attrs):
            if tag in HEADINGS or tag == "p":
                while stack and (stack[-1][0] in HEADINGS or stack[-1][0] not in BLOCKS or stack[-1][0] == "p"):
                    pop()
            elif tag == "li" and stack and stack[-1][0] == "li":
                pop()
            found = marks_of(tag, attrs, marks[ARTICLE] > 0)
            if tag != "a" or found:
                labelled = re.search(r'data-main="([01])"', attrs) if "data-main" in attrs else None
                stack.append((tag, found, label))
                open_[tag] += 1
                for k in found:
                    if k in named:
                        named[k].append(len(held))
                        held.append(seen)  # before it; what it holds when it is closed
                for k in found:
                    marks[k] += 1
                label = labelled[1] if labelled else label
    text(page[at:])
    flush()
    while stack:
        pop()
    total = max(1, sum(b["words"] for b in blocks))
    for b in blocks:
        for k in ("named", "vague"):
            b[k] = 1 - held[b[k]] / total if b[k] >= 0 else 0.0
        b["apart"] *= article / total
    return blocks


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "stop", "heading", "place", "named", "vague", "apart")


def features_of(blocks: list[dict]) -> np.ndarray:
    """FEATURES of each block; there are no words before the first and after the last."""
    own = np.asarray([[b[f] for f in FEATURES if f in b] for b in blocks], float).reshape(len(blocks), len(FEATURES) - 4)
    near = np.zeros((len(blocks), 4))
    if len(blocks):
        near[1:, :2], near[:-1, 2:] = own[:-1, :2], own[1:, :2]
    return np.concatenate([own[:, :2], near, own[:, 2:]], axis=1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> tuple | float:
    """A decision tree by Gini impurity: (feature, threshold, if at most, if above), or the share of label 1."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = (len(y) * share * (1 - share) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, total = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        left, right = total[:-1], total[-1] - total[:-1]
        impurity = left * (n - left) / n + right * (len(y) - n - right) / (len(y) - n)
        impurity[(v[1:] == v[:-1]) | (n < LEAF_ROWS) | (len(y) - n < LEAF_ROWS)] = np.inf
        k = int(impurity.argmin()) if len(n) else -1
        if k >= 0 and impurity[k] < best[0] - 1e-9:
            best = (float(impurity[k]), f, float((v[k] + v[k + 1]) / 2))
    _, f, cut = best
    if f < 0:
        return share
    low = x[:, f] <= cut
    return f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def chance(tree: tuple | float, x: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def labelled(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of pages with data-main attributes."""
    found = [blocks_of(p) for p in pages]
    return np.concatenate([features_of(b) for b in found]), np.asarray([int(x["label"]) for b in found for x in b])


@lru_cache(maxsize=1)
def tree() -> tuple | float:
    from tokenloom.llm.training import pages

    return grow(*labelled(pages(TRAINING_PAGES)))


def main_text(page: str | None, by: tuple | float | None = None) -> str:
    """The main text of one page, by the given tree or the trained one."""
    if not page:
        return ""
    blocks = blocks_of(page)
    by = tree() if by is None else by
    return "\n\n".join(b["text"] for b, x in zip(blocks, features_of(blocks).tolist(), strict=True) if chance(by, x) >= 0.5)


def extract(pages: DataFrame, id_column: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every page."""
    types = dict(pages.dtypes)
    by = tree()

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 16 << 20):
            texts = [main_text(p, by) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), batch.column(url), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_column, url, "text", "n_chars"])

    return pages.select(id_column, url, F.col(html_column).alias("html")).mapInArrow(extracted, f"{id_column} {types[id_column]}, {url} {types[url]}, text string, n_chars long")
