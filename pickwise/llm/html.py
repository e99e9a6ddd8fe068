"""Operator 9: main text of web pages by two-pass block rules.

A page is read once from left to right into blocks (runs of text between block-level
tags). Elements that are never article text (menus, footers, sidebars, forms, scripts,
styles, and elements whose class, id or role names a notice, an advert or reader comments)
are left out; where such a word is only a part of a class or id (``no-sidebar``), the
element stays if it holds most of the page's text. The remaining blocks are classified in two passes:

1. each block on its own, by link density, length and stop-word density: good, bad, or
   undecided (short, or of middling density);
2. undecided blocks inherit: the label of the nearest decided block on each side, good if
   either the two agree on good, or the nearer one is good; a heading looks forward only.

Where the page marks its article, the mark is evidence: in the first pass a block inside
``article`` counts one step better (bad, undecided, good) unless it is mostly links, one
outside of ``article`` and ``main`` one step worse; ``main`` alone changes nothing inside
it. In the second pass blocks of ``article`` inherit from each other only, and a block
outside the mark needs good neighbours on both sides. A mark with less text than the good
blocks outside of it (a teaser card) is no evidence. One page is one row; pages are independent, so the
work is a narrow map without a shuffle.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pickwise.llm.common import prepare

# Fixed sets: HTML elements by their role for extraction.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas textarea title".split())
DROPPED = frozenset("nav footer aside form button select option menu dialog head fieldset".split()) | RAW
BLOCK = frozenset(("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul").split())
CLOSES_P = BLOCK - {"br", "body", "html"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset({"article", "main"})
# Fixed set: parts of class and id names that mark what is not article text.
NEGATIVE = frozenset(("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
                      "footer gdpr login menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted "
                      "related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar "
                      "widget").split())
NEGATIVE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Fixed sets: frequent function words of four languages.
STOP_WORDS = frozenset((
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so "
    "le la les de des du un une et est en que qui dans pour pas sur au aux par plus ne ce se son sa ses avec il elle on nous vous ils sont ou mais "
    "der die das und ist von den dem des ein eine einer zu mit auf im für nicht sich auch als an es er sie wir ihr bei nach aus wie oder aber "
    "el los las del y es en por con para una un su sus lo al como más pero no se que si este esta son fue ha o"
).split())
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++))?""", re.IGNORECASE)
NAME_PARTS = re.compile(r"[a-z]+")
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    links: int          # characters inside links
    mark: int           # 1 within article, 0 within main only, -1 outside
    heading: bool


@dataclass
class _Open:
    name: str
    dropped: bool
    article: bool
    doubt: int | None   # first block, where only a part of the element's name speaks against it


class Page:
    """One left-to-right reading of a page into blocks."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.links = 0
        self.stack: list[_Open] = []
        self.open: Counter = Counter()
        self.hidden = 0
        self.depth = 0          # open article or main elements
        self.articles = 0       # open article elements
        self.doubts: list[tuple[int, int]] = []     # (first block, end) of elements in doubt
        self._read(source)
        self._flush()
        self.doubts += [(e.doubt, len(self.blocks)) for e in self.stack if e.doubt is not None]
        self._settle()

    def _read(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                return self._text(s[at:])
            if lt > at:
                self._text(s[at:lt])
            after = s[lt + 1:lt + 2]
            if after == "!" or after == "?":
                close = "-->" if s.startswith("<!--", lt) else "]]>" if s.startswith("<![CDATA[", lt) else ">"
                stop = s.find(close, lt + 2)
                at = n if stop < 0 else stop + len(close)
                continue
            m = TAG.match(s, lt) or LOOSE_TAG.match(s, lt)
            if m is None:
                self._text("<")
                at = lt + 1
                continue
            at = m.end()
            name = m[2].lower()
            if m[1]:
                self._end(name)
            else:
                self._start(name, m[3])
                if name in RAW and not m[3].endswith("/"):
                    stop = s.lower().find(f"</{name}", at) if n < 4096 else _find_end(s, name, at)
                    at = n if stop < 0 else stop

    def _settle(self) -> None:
        """Leave out the elements in doubt that do not hold most of the page's text."""
        upto = list(accumulate((len(b.text) for b in self.blocks), initial=0))
        edge = [0] * (len(self.blocks) + 1)
        for first, end in self.doubts:
            if 2 * (upto[end] - upto[first]) <= upto[-1]:
                edge[first] += 1
                edge[end] -= 1
        self.blocks = [b for b, out in zip(self.blocks, accumulate(edge), strict=False) if not out]

    def _text(self, piece: str) -> None:
        if not self.hidden:
            self.parts.append(piece)
            if self.open["a"]:
                self.links += len("".join(piece.split()))

    def _flush(self, heading: bool = False) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            if text:
                self.blocks.append(Block(text, self.links, 1 if self.articles else 0 if self.depth else -1, heading))
            self.parts = []
        self.links = 0

    def _start(self, name: str, attributes: str) -> None:
        if name in CLOSES_P and self.open["p"]:
            for e in reversed(self.stack):
                if e.name == "p":
                    self._end("p")
                    break
                if e.name in BLOCK:
                    break
        if name in BLOCK:
            self._flush(bool(self.stack) and self.stack[-1].name in HEADINGS)
        if name in VOID or attributes.endswith("/"):
            return
        against = 2 if name in DROPPED or (name == "header" and not self.depth) else _negative(attributes, name, self.depth > 0)
        drop = against == 2 or (against == 1 and name not in BLOCK)
        article = name in ARTICLE and not drop and not self.hidden
        self.stack.append(_Open(name, drop, article, len(self.blocks) if against == 1 and not drop and not self.hidden else None))
        self.open[name] += 1
        self.hidden += drop
        self.depth += article
        self.articles += article and name == "article"

    def _end(self, name: str) -> None:
        if name in BLOCK:
            self._flush(name in HEADINGS)
        if not self.open[name]:
            return
        while True:
            e = self.stack.pop()
            self.open[e.name] -= 1
            self.hidden -= e.dropped
            if e.doubt is not None or e.article:
                self._flush()
            if e.doubt is not None:
                self.doubts.append((e.doubt, len(self.blocks)))
            self.depth -= e.article
            self.articles -= e.article and e.name == "article"
            if e.name == name:
                return


def _find_end(s: str, name: str, at: int) -> int:
    m = re.compile(f"</{name}", re.IGNORECASE).search(s, at)
    return m.start() if m else -1


def _negative(attributes: str, name: str, inside: bool) -> int:
    """2: the element is no article text by a whole class or id, its role or its being hidden; 1: by a part of a name; else 0."""
    if not attributes or name in ("html", "body"):
        return 0
    found = 0
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key in ("class", "id"):
            parts = set(NAME_PARTS.findall(value))
            if parts & NEGATIVE or (not inside and "header" in parts):
                whole = set(value.split())
                if whole & NEGATIVE or (not inside and "header" in whole):
                    return 2
                found = 1
        elif key == "role":
            if value in NEGATIVE_ROLES:
                return 2
        elif value != "false" and (key == "aria-hidden" or attributes[m.start() - 1:m.start()].isspace() and (m[2] or attributes[m.end():m.end() + 1] in ("", " ", "/"))):
            return 2
    return found


GOOD, BAD, UNDECIDED = "good", "bad", "undecided"
STEPS = (BAD, UNDECIDED, GOOD)


def first_pass(block: Block, short: int, long: int, low: float, high: float, most_links: float) -> int | None:
    """Step of a block on its own (0 bad, 1 undecided, 2 good); None where links are most of it."""
    size = len(block.text)
    if block.links > most_links * max(1, size):
        return None
    if size < short:
        return 0 if block.links else 1
    words = WORD.findall(block.text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if density >= high:
        return 2 if size >= long else 1
    return 1 if density >= low else 0


def evidence(blocks: list[Block], steps: list[int | None]) -> list[int]:
    """Marks of the blocks; none where the page has none, or more good text outside than text inside."""
    inside = sum(len(b.text) for b, step in zip(blocks, steps, strict=True) if b.mark >= 0 and step is not None)
    outside = sum(len(b.text) for b, step in zip(blocks, steps, strict=True) if b.mark < 0 and step == 2)
    return [b.mark for b in blocks] if inside and inside >= outside else [0] * len(blocks)


def second_pass(blocks: list[Block], labels: list[str], marks: list[int]) -> list[bool]:
    """Undecided blocks take the label of their nearest decided neighbours; a page without any keeps them."""
    own = [i for i, mark in enumerate(marks) if mark > 0]
    if 0 < len(own) < len(blocks):
        labels = list(labels)
        for i, good in zip(own, second_pass([blocks[i] for i in own], [labels[i] for i in own], [1] * len(own)), strict=True):
            labels[i] = GOOD if good else BAD
    n = len(blocks)
    before: list[tuple[int, str] | None] = [None] * n
    after: list[tuple[int, str] | None] = [None] * n
    seen = None
    for i in range(n):
        before[i] = seen
        seen = (i, labels[i]) if labels[i] != UNDECIDED else seen
    seen = None
    for i in range(n - 1, -1, -1):
        after[i] = seen
        seen = (i, labels[i]) if labels[i] != UNDECIDED else seen
    out = []
    for i in range(n):
        if labels[i] != UNDECIDED:
            out.append(labels[i] == GOOD)
            continue
        left, right = before[i], after[i]
        if marks[i] < 0:
            out.append(bool(left and right) and left[1] == right[1] == GOOD)
        elif blocks[i].heading and right:
            out.append(right[1] == GOOD)
        elif left and right and left[1] != right[1]:
            nearer = left if i - left[0] < right[0] - i else right if right[0] - i < i - left[0] else None
            out.append(nearer is None or nearer[1] == GOOD)  # a tie goes to good
        else:
            out.append((left or right or (0, GOOD))[1] == GOOD)
    return out


def main_text(source: str | None, short: int = 70, long: int = 200, low: float = 0.15, high: float = 0.25, most_links: float = 0.4) -> str:
    """Article text of one page: blocks in page order joined by one space; empty for null or none."""
    if not source:
        return ""
    blocks = Page(source).blocks
    steps = [first_pass(b, short, long, low, high, most_links) for b in blocks]
    marks = evidence(blocks, steps)
    labels = [BAD if step is None else STEPS[max(0, min(2, step + mark))] for step, mark in zip(steps, marks, strict=True)]
    return " ".join(b.text for b, good in zip(blocks, second_pass(blocks, labels, marks), strict=True) if good)


def extract(df: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Append ``text`` and ``n_chars`` (its code points) to the columns ``keep`` (all).

    Null or empty pages and pages without article text give the empty string. Columns
    named text or n_chars are replaced. Unclosed and stray tags are read as browsers do in
    simple cases; reading time is linear in the page."""
    prepare(df.sparkSession)
    keep = [c for c in (keep or df.columns) if c not in ("text", "n_chars")]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(html_col).cast("string").alias("__html"))
    schema = StructType(list(rows.drop("__html").schema.fields)).add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=[*keep, "text", "n_chars"])

    return rows.mapInArrow(run, schema)
