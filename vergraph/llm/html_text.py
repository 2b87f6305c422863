"""Operator 6: main text of HTML pages by two passes of block rules.

A page is read as a stream of tags and text and cut into blocks at block-level
tags.  Scripts, styles, form controls and hidden elements make no block.

Pass one labels each block by its own measures - length, share of linked text,
share of stop words - as good, bad or ambiguous.  What encloses a block is
evidence that is weighed against the good text of the page:

* An article or main element marks the article if it holds a third of the good
  text; then what lies outside it goes, and inside it doubtful blocks are
  ambiguous instead of bad.
* Elements for menus, headers, footers, sidebars and forms, and containers whose
  class, id or role names them as such, or as adverts, notices, comments and so
  on, speak against their blocks.  They are pardoned, from the outermost inwards,
  if they hold the page's main element or its only article, or most of the
  good text of a page that marks no article, unless a plain name says what they
  are.  A name counts as a whole or as the end of a compound (site-header), not
  where it only describes a layout (no-sidebar).
* An element inside a line with such a name speaks against a block that has no
  text outside of such elements; in the middle of other text it is text.

Pass two lets ambiguous blocks inherit the label of the nearest decided
neighbours among the blocks that are left; where both sides differ, the nearer
one counts, and a tie is good.  Headings take the label of what follows.  With
nothing decided, what is left is the text.

Character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by one line feed.

Nulls and empties: a null or empty html gives the empty text.  Repeated rows
and extra columns pass by untouched; very long pages, deep nesting and tags
that are never closed take time in proportion to their length.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import ship

# Element names, and words by which pages name their containers.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN_TAGS = frozenset("script style noscript template head title iframe object svg math canvas video audio select button textarea input label datalist".split())
SIDE_TAGS = frozenset("form nav aside footer header menu dialog".split())
RAW_TAGS = frozenset("script style noscript template iframe title textarea svg math xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE_TAGS = frozenset(["article", "main"])
SKIPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay paywall popup promo promoted promotion related recommended respond replies search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
KEPT_CONTAINERS = frozenset("html body article main".split())
#: Parts of compounds: those that may follow a name, and those that make it a remark on a layout.
FOLLOWING = frozenset("area bar block body bottom box button buttons container content form group heading inner item items left link links list outer panel right row section slot text title top unit wrap wrapper".split())
LAYOUT = frozenset("has have hide is no not show with without".split())
STOP_WORDS = frozenset(
    (
        "the of and a to in is was that for it with as on be by are this from at he his an they not have or but were which their had has you we all one there will would can if so what who when about into more its no than then some could them these two may other do out up "
        "der die das und in zu den von ist mit des dem ein eine nicht sich auch auf für als es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde "
        "le la les de des un une et à est en que qui dans pour pas sur il elle au aux par ce se plus avec son sa ne ou mais du nous vous ils sont été cette comme tout on même leur "
        "el los las una y del se su por con para al lo como más pero sus o este ha si porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante ser es fue"
    ).split()
)
#: A quote opens a value only right after an equals sign.
VALUE = r"""(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*)"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*{VALUE}?)*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(rf"([^\s/>=]+)(?:\s*=\s*({VALUE}))?")
WORD = re.compile(r"\w+")
LONG, SHORT, LINKED, DENSE, SPARSE = 140, 60, 0.5, 0.25, 0.1
#: Share of a page's good text that makes a mark, or the pardon of a container, credible.
MARKED, MOST = 1 / 3, 1 / 2


PLAIN, COMPOUND = 1, 2


def skipped_name(name: str) -> int:
    """Whether a class or id names what holds no article text: PLAIN, COMPOUND or 0."""
    parts = [p for p in re.split(r"[^a-z0-9]+", name) if p]
    if not parts or not LAYOUT.isdisjoint(parts) or SKIPPED_NAMES.isdisjoint(parts):
        return 0
    if SKIPPED_NAMES.issuperset(parts):
        return PLAIN
    while parts[-1] in FOLLOWING or parts[-1].isdigit():
        parts.pop()
    return COMPOUND if parts[-1] in SKIPPED_NAMES else 0


def named_out(tag: str, attributes: str) -> tuple[bool, int]:
    """Whether an element is hidden, and whether its class, id or role names what
    holds no article text."""
    if tag in KEPT_CONTAINERS or not attributes or attributes.isspace():
        return False, 0
    names, seen = set(), set()
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in seen:
            continue
        seen.add(name)
        if name in ("class", "id"):
            names.update(skipped_name(x) for x in value.split())
        elif name == "role" and value in SKIPPED_ROLES:
            names.add(PLAIN)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True, 0
    return False, PLAIN if PLAIN in names else max(names, default=0)


class Container:
    """An element that speaks against its blocks.  What is counted belongs to the
    innermost one first; ``pardon`` sums it up."""

    def __init__(self, kind: int, parent: Container | None, inline: bool):
        self.kind, self.parent, self.inline = kind, parent, inline
        self.mains = self.articles = self.good = 0
        self.free = False


class Block(NamedTuple):
    text: str
    linked: int  # characters of links
    heading: bool
    inside: bool  # an article or main element
    around: Container | None  # the innermost one


class Reader:
    """Cuts a page into blocks."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.stack: list[tuple[str, bool, Container | None]] = []  # open elements that matter: name, hidden, container
        self.open: Counter = Counter()  # how many of each name are on the stack
        self.around: list[Container] = []  # open blocks that are containers
        self.inline: list[Container] = []  # open named elements inside a line
        self.containers: list[Container] = []  # all of them, outer ones before inner ones
        self.linked = self.hidden = self.breaks = 0
        self.plain = False  # whether the block has text outside of named elements inside a line
        self.named: Container | None = None  # the first of those with text in it
        self.heading = False
        self.free_mains = self.free_articles = 0  # not in any container

    def close_block(self) -> None:
        if self.parts:
            text = " ".join(unescape("".join(self.parts)).split())
            if text:
                around = self.named if not self.plain else self.around[-1] if self.around else None
                self.blocks.append(Block(text, self.linked, self.heading, self.open["article"] + self.open["main"] > 0, around))
            self.parts.clear()
        self.linked, self.plain, self.named = 0, False, None

    def add(self, raw: str) -> None:
        if raw and not self.hidden:
            self.parts.append(raw)
            if self.open["a"]:
                self.linked += len("".join(raw.split()))
            if not raw.isspace():
                self.breaks = 0
                if self.inline:
                    self.named = self.named or self.inline[0]
                else:
                    self.plain = True

    def enter(self, tag: str, hidden: bool, container: Container | None) -> None:
        self.stack.append((tag, hidden, container))
        self.open[tag] += 1
        self.hidden += hidden
        if container:
            self.containers.append(container)
            (self.inline if container.inline else self.around).append(container)

    def leave(self) -> str:
        tag, hidden, container = self.stack.pop()
        self.open[tag] -= 1
        self.hidden -= hidden
        if container:
            (self.inline if container.inline else self.around).pop()
        return tag

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            if self.breaks:
                self.close_block()
            else:
                self.add(" ")
            self.breaks += 1
            return
        is_block = tag in BLOCK_TAGS
        if is_block:
            self.close_block()
            self.breaks = 0
            self.heading = tag in HEADINGS
        if tag in VOID_TAGS:
            if tag == "img":
                self.add(" ")
            return
        if tag == "body":  # ends whatever of the head was left open
            while self.stack and self.stack[-1][0] != "html":
                self.leave()
        if tag in ("p", "li") and self.stack and self.stack[-1][0] == tag:
            self.leave()
        hidden, kind = named_out(tag, attributes)
        hidden = hidden or tag in HIDDEN_TAGS
        in_article = self.open["article"] + self.open["main"] > 0
        if tag in SIDE_TAGS and not (tag == "header" and in_article):
            kind = COMPOUND if tag == "form" and kind != PLAIN else PLAIN
        if hidden or is_block or tag == "a" or kind:
            inner = self.around[-1] if self.around else None
            if tag in ARTICLE_TAGS and not in_article and not self.hidden:
                if inner:
                    inner.mains += tag == "main"
                    inner.articles += tag == "article"
                else:
                    self.free_mains += tag == "main"
                    self.free_articles += tag == "article"
            self.enter(tag, hidden, Container(kind, inner, not is_block) if kind and not hidden else None)

    def end(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.close_block()
            self.breaks = 0
            self.heading = False
        if self.open[tag] > 0:
            while self.leave() != tag:
                pass

    def read(self, html: str) -> None:
        at, unclosed = 0, set()
        while (m := TOKEN.search(html, at)) is not None:
            self.add(html[at : m.start()])
            at, tag = m.end(), m[2]
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    self.add(m[0][9:].removesuffix("]]>"))
                continue
            tag = tag.lower()
            if m[1]:
                self.end(tag)
            elif tag in RAW_TAGS and not (tag in ("svg", "math") and m[3].endswith("/")):
                end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = len(html)
                else:
                    unclosed.add(tag)  # nor will it be closed further on
            else:
                self.start(tag, m[3])
        self.add(html[at:])
        self.close_block()


GOOD, BAD, UNSURE = 1, -1, 0


def first_pass(text: str, linked: int, inside: bool = False) -> int:
    """Label of a block by its length, share of links and share of stop words.
    Inside an article what would be bad for want of them is ambiguous."""
    size = len("".join(text.split()))
    link_share = min(1.0, linked / max(1, size))
    if link_share > LINKED:
        return UNSURE if inside and len(text) > LONG else BAD
    words = WORD.findall(text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if len(text) < SHORT:
        return UNSURE if link_share == 0 or inside else BAD
    if density >= DENSE or inside and density >= SPARSE:
        return GOOD
    if len(text) >= LONG and link_share < 0.2 and (density >= SPARSE or link_share < 0.1):
        return GOOD
    return UNSURE if link_share < 0.2 or inside else BAD


def second_pass(labels: list[int], headings: list[bool]) -> list[int]:
    """Ambiguous blocks take the label of the nearest decided ones."""
    n = len(labels)
    if not any(labels):  # nothing to go by: a short page is its text
        return [GOOD] * n
    before, after = [(BAD, n + 1)] * n, [(BAD, n + 1)] * n
    last = (BAD, -n - 1)
    for i in range(n):
        if labels[i] != UNSURE:
            last = (labels[i], i)
        before[i] = (last[0], i - last[1])
    last = (BAD, 2 * n + 1)
    for i in range(n - 1, -1, -1):
        if labels[i] != UNSURE:
            last = (labels[i], i)
        after[i] = (last[0], last[1] - i)
    out = []
    for i, own in enumerate(labels):
        if own != UNSURE:
            out.append(own)
        elif headings[i] and after[i][1] <= n:
            out.append(after[i][0])
        elif before[i][0] == after[i][0]:
            out.append(before[i][0])
        elif before[i][1] != after[i][1]:
            out.append(before[i][0] if before[i][1] < after[i][1] else after[i][0])
        else:
            out.append(GOOD)
    return out


def pardon(reader: Reader, good: list[int]) -> None:
    """Free the containers whose names are no evidence after all.  ``good``:
    characters of each block that are good by its own measures."""
    for b, n in zip(reader.blocks, good, strict=True):
        if b.around:
            b.around.good += n
    for c in reversed(reader.containers):  # inner ones come after outer ones
        if c.parent:
            c.parent.good += c.good
            c.parent.mains += c.mains
            c.parent.articles += c.articles
    marks, total = reader.free_mains + reader.free_articles, sum(good)
    for c in reader.containers:
        if c.parent is None or c.parent.free:
            c.free = not marks and (c.mains > 0 or c.articles == 1) or c.kind == COMPOUND and not marks and not c.articles and c.good > MOST * total


def main_text(html: str | None) -> str:
    if not html:
        return ""
    reader = Reader()
    reader.read(html)
    labels = [first_pass(b.text, b.linked) for b in reader.blocks]
    good = [len(b.text) if label == GOOD else 0 for b, label in zip(reader.blocks, labels, strict=True)]
    pardon(reader, good)
    left = [i for i, b in enumerate(reader.blocks) if b.around is None or b.around.free]
    inside, total = [i for i in left if reader.blocks[i].inside], sum(good[i] for i in left)
    if inside and sum(good[i] for i in inside) >= MARKED * total:
        left = inside
        labels = [first_pass(b.text, b.linked, True) for b in reader.blocks]
    keep = second_pass([labels[i] for i in left], [reader.blocks[i].heading for i in left])
    return "\n".join(reader.blocks[i].text for i, label in zip(left, keep, strict=True) if label == GOOD)


def _extract(batches):
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
