"""Main text of web pages by tag-path ratios.

A page is cut into text nodes, each under its root-to-leaf tag path. For every path the text
length and the punctuation a node are summed up and fused. Summed over the tree, they tell which
element holds the page's text: the deepest one with a share of 1 - `share` of it (or the article
around that one) is the content, with all paths below it. Outside it a path is content if its own ratio, fused with
what its container and the containers around that hold (smoothed by a decay a level), reaches `share`; so are headings just
above the content.

Elements that are boilerplate by tag, role or class (menus, headers, footers, sidebars, notices,
adverts, forms, comments) never take part; words that may as well mark prose (legal, notice, share) count on
containers only, not on paragraphs. A form around an article or a first heading is only a wrapper, and where
nothing is left outside marked containers, the least marked text is taken. An article's own header counts as a header.

Inside content blocks nothing is dropped: character references are decoded, white space becomes one
space, blocks are trimmed and joined by a line feed in page order.

Edge cases: null or empty html gives the empty text; html without tags is one block; unclosed
tags, stray end tags and cut-off pages are read as browsers do (an unfinished tag at the end
is dropped); very long and very deep pages are read in one pass, in time and memory in proportion to them (paths are linked
nodes); of two elements with equal shares the deeper counts; rows are independent of each other, repeated or not; a null id
is carried; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote figcaption caption td th tr tbody thead tfoot table ul ol dl figure summary".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIP_TAGS = frozenset("head nav header footer aside script style noscript template iframe svg button select option label input textarea menu dialog search canvas object title".split())
SKIP_ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog menu menubar toolbar form".split())
#: Words of class and id that mark boilerplate on any element, and those that do so on containers only.
SKIP_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense promo sponsor sponsored sponsors cookie cookies consent gdpr popup modal newsletter sidebar sidebars breadcrumb breadcrumbs menu menus nav navbar navigation pagination pager comment comments commentlist disqus".split())
CONTAINER_WORDS = frozenset("banner promotion notice notices alert overlay subscribe subscription signup login share sharing social widget widgets related recommended footer header masthead reply replies respond discussion copyright legal disclaimer toolbar".split())
KEEP_WHOLE = frozenset("html body main article".split())
#: The tag that an element of the key closes when it stands open within the same parent block.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}

_TOKEN = re.compile(r"""<!--(?:>|->)?|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?]""")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_MARKS = re.compile(r"[.,;:!?…。，；：！？]")


#: Text below an article or main element counts so many times where the page's content is looked for.
SEMANTIC = 4.0
_ARTICLE = frozenset(("article", "main"))


def _marked(tag: str, attributes: str) -> bool:
    """Whether role, class or id mark an element as boilerplate."""
    if tag in KEEP_WHOLE or not attributes:
        return False
    container = tag in BLOCK and tag not in LEAF or tag in ("ul", "ol", "dl", "table")
    for name, *values in _NAMED.findall(attributes):
        for word in "".join(values).lower().split():
            if name.lower() == "role":
                if word in SKIP_ROLES:
                    return True
                continue
            parts = re.split(r"[-_]+", word)
            for k, part in {0: parts[0], len(parts) - 1: parts[-1]}.items():
                if (part in SKIP_WORDS or (container and part in CONTAINER_WORDS)) and not (k and parts[0] in ("has", "no", "with", "without")):
                    return True
    return False


class Page:
    """Text nodes of a page, and the tree of the tag paths met; a path's parent has a lower number."""

    def __init__(self, page: str):
        self.parent = [0]
        self.container = [0]  # the nearest path, itself included, that ends in a container
        self.article = [-1]  # the outermost article above or at the path
        self.heading = [False]
        self._known: dict[tuple[int, str], int] = {}
        self.nodes: list[tuple[int, int, int, str]] = []  # path, block, marked elements around, raw text
        self._read(page)

    def _path(self, parent: int, tag: str, label: str) -> int:
        step = (parent, f"{tag}.{label}" if label else tag)
        found = self._known.get(step)
        if found is None:
            found = self._known[step] = len(self.parent)
            self.parent.append(parent)
            self.container.append(found if tag in BLOCK and tag not in LEAF else self.container[parent])
            self.article.append(found if self.article[parent] < 0 and tag in _ARTICLE else self.article[parent])
            self.heading.append(self.heading[parent] or tag in HEADING)
        return found

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int, int]] = []  # tag; path and marks before it
        open_tags: Counter[str] = Counter()
        path, marks, skipped = 0, 0, 0  # skipped: depth of the outermost element that never takes part, from 1
        forms = 0  # marks that stand for forms alone
        block, at, n = 0, 0, len(page)

        def close(depth: int) -> None:
            nonlocal path, marks, skipped
            _, path, marks = stack[depth]
            open_tags.subtract(t for t, _, _ in stack[depth:])
            del stack[depth:]
            if skipped > depth:
                skipped = 0

        def topmost(wanted: tuple[str, ...], stop) -> int:
            """Depth of the innermost open element of `wanted` above any that stops the search, or -1."""
            if any(open_tags[t] for t in wanted):
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in wanted:
                        return depth
                    if stack[depth][0] in stop:
                        break
            return -1

        while at < n:
            found = _TOKEN.search(page, at)
            end = found.start() if found else n
            if end > at and not skipped:
                self.nodes.append((path, block, marks, page[at:end]))
            if not found:
                return
            at = found.end()
            token = found[0]
            if token.startswith("<!--"):
                if not token.endswith(">"):
                    close_at = page.find("-->", at)
                    at = n if close_at < 0 else close_at + 3
                continue
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                if token[-1] != ">":  # an unfinished tag: nothing but its rest can follow
                    return
                continue
            if tag in BLOCK:
                block += 1
            if found[1] or found[4]:
                if (depth := topmost((tag,), () if tag in BLOCK else BLOCK)) >= 0:
                    close(depth)
                continue
            attributes = found[3] or found[6] or ""
            if tag in BLOCK and (depth := topmost(("p",), BLOCK)) >= 0:  # a block ends an open paragraph
                close(depth)
            if tag in HEADING and stack and stack[-1][0] in HEADING:
                close(len(stack) - 1)
            if tag in CLOSES:
                while (depth := topmost(CLOSES[tag], SCOPE[tag])) >= 0:
                    close(depth)
            if tag in VOID:
                if tag == "br" and not skipped:
                    self.nodes.append((path, block, marks, " "))
                continue
            if tag in RAW:
                last = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                at = last.start() if last else n
            if attributes.endswith("/") and tag not in BLOCK:
                continue
            label = next(("".join(v) for k, *v in _NAMED.findall(attributes) if k.lower() == "class"), "") if attributes and tag in BLOCK else ""
            stack.append((tag, path, marks))
            open_tags[tag] += 1
            if skipped:
                continue
            path = self._path(path, tag, label)
            if tag in SKIP_TAGS:
                skipped = len(stack)
            elif tag == "form":
                marks += 1
                forms = marks
            elif _marked(tag, attributes):
                marks += 1
            elif marks and marks == forms == 1 and (tag in _ARTICLE or tag == "h1"):
                # The form is a wrapper: from here on its marks don't count.
                stack = [(t, p, 0) for t, p, _ in stack]
                marks = forms = 0


def content_paths(page: Page, nodes: list[tuple[int, int, int, str]], share: float = 0.25, decay: float = 0.8) -> set[int]:
    """The paths of the content element, and those outside whose fused ratio of text and punctuation reaches `share`."""
    sums: dict[int, list[int]] = {}
    for path, _, _, text in nodes:
        if size := len(text.strip()):
            own = sums.setdefault(path, [0, 0, 0])
            own[0] += size
            own[1] += len(_MARKS.findall(text))
            own[2] += 1
    if not sums:
        return set()
    fused = {p: c / n * log2(2 + m / n) for p, (c, m, n) in sums.items()}
    paths = len(page.parent)
    held, total = [0.0] * paths, [0.0] * paths  # by a container itself, and with all below it
    for p, (c, m, n) in sums.items():
        held[page.container[p]] += c * log2(2 + m / n) * (SEMANTIC if page.article[p] >= 0 else 1.0)
    for p in range(paths - 1, 0, -1):
        total[p] += held[p]
        total[page.parent[p]] += total[p]
    total[0] += held[0]
    content = max(p for p in range(paths) if page.container[p] == p and total[p] >= (1 - share) * total[0])
    content = page.article[content] if page.article[content] >= 0 else content
    inside, smooth = [False] * paths, [0.0] * paths
    for p in range(paths):
        up = page.parent[p]
        inside[p] = p == content or (p > 0 and inside[up])
        smooth[p] = max(held[p] / total[0], smooth[up] * (decay if page.container[p] == p else 1.0))
    above = page.container[page.parent[content]]
    above = {above, page.container[page.parent[above]]}
    best = max(fused.values())
    return {p for p in sums if inside[p] or (page.heading[p] and page.container[p] in above) or 0.4 * fused[p] / best + 0.6 * smooth[page.container[p]] >= share}


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    read = Page(page)
    least = min((marks for _, _, marks, text in read.nodes if not text.isspace()), default=0)
    nodes = [x for x in read.nodes if x[2] <= least]
    chosen = content_paths(read, nodes)
    blocks: list[str] = []
    current, parts = -1, []
    for path, block, _, text in nodes:
        if block != current:
            blocks.append(html.unescape("".join(parts)))
            current, parts = block, []
        if path in chosen or text.isspace():  # white space parts words whatever its path
            parts.append(text)
    blocks.append(html.unescape("".join(parts)))
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def extract(pages: DataFrame, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in `carry`, text and n_chars (code points of text) of every page."""
    kept = pages.select(*(F.col(c) for c in carry), F.col(html_col).alias("__html"))
    fields = [f"`{x.name}` {x.dataType.simpleString()}" for x in kept.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"])

    return map_arrow(kept, run, ", ".join([*fields, "text string", "n_chars long"]))
