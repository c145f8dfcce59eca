"""Leaf blocks of a page: runs of text between block-level tags, with the tags above them.

Only what a page never shows as text is left out (scripts, styles, templates, the head, titles); text of formulas, drawings, media and
frames is text like other. Tags and marks above a block are kept as hashed numbers below WIDTH, so all of them count, and
a block holds WIDTH of them at most however deep it lies; blocks with the same ones share them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img br math mfrac mi mn mo mover mpadded mroot mrow ms msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
HIDDEN = frozenset("script style template head title".split())
#: An opening tag closes an open one of the same group, up to the nearest of the holders.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
P_HOLDERS = frozenset("td th li div article section body".split())
P_ENDERS = frozenset("p div ul ol dl table article section nav header footer aside main form blockquote pre figure h1 h2 h3 h4 h5 h6 hr address fieldset details menu".split())


#: Tags that mark an article, tags of what is not one, and the tag by which made training pages tell theirs.
MARKS = frozenset({"article", "main"})
FURNITURE = frozenset("nav footer aside form header".split())
LABEL_TAG = "main-part"


#: Numbers of features.
WIDTH = 1 << 13
_numbers: dict[str, int] = {}


def feature(name: str) -> int:
    got = _numbers.get(name)
    if got is None:
        got = zlib.crc32(name.encode()) & (WIDTH - 1)
        if len(_numbers) < 100_000:
            _numbers[name] = got
    return got


class Block(NamedTuple):
    text: str
    #: numbers of the tags above, and of what tells an article by name: class, id, role and the tags in MARKS
    tags: frozenset[int]
    marks: frozenset[int]
    #: innermost tag, and innermost one that marks no article
    parent: str
    plain_parent: str
    in_mark: bool
    #: under furniture inside the outermost mark
    in_furniture: bool
    #: under the tag by which made training pages tell their article
    in_label: bool
    link_chars: int


class Level(NamedTuple):
    """An open tag with what holds for everything below it, and the numbers that it adds to those above."""

    tag: str
    adds_tags: tuple[int, ...]
    adds_marks: tuple[int, ...]
    parent: str
    plain_parent: str
    in_mark: bool
    in_furniture: bool
    in_label: bool


ROOT = Level("", (), (), "", "", False, False, False)


class Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[Level] = [ROOT]
        self.places: dict[str, list[int]] = {}
        self.found: list[Block] = []
        self.parts: list[str] = []
        self.links = self.hidden = self.in_link = 0
        self.under = ROOT
        #: how many open tags add each number; sets of them that blocks share
        self.open_tags: Counter[int] = Counter()
        self.open_marks: Counter[int] = Counter()
        self.shared: dict[frozenset[int], frozenset[int]] = {}
        self.over: tuple[frozenset[int], frozenset[int]] = (frozenset(), frozenset())

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.found.append(Block(text, *self.over, *self.under[3:], self.links))
        self.parts, self.links = [], 0

    def push(self, tag: str, attrs) -> None:
        marks = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")).lower().replace("-", " ").replace("_", " ").split()
        up = self.stack[-1]
        shown = tag != LABEL_TAG
        self.places.setdefault(tag, []).append(len(self.stack))
        under, named = (feature(f"under {tag}"),) * shown, {feature(f"mark {m}") for m in marks} if shown else ()
        level = Level(
            tag, () if tag in MARKS else under, (*named, *under) if tag in MARKS else tuple(named), tag if shown else up.parent,
            tag if shown and tag not in MARKS else up.plain_parent, up.in_mark or tag in MARKS, up.in_furniture or up.in_mark and tag in FURNITURE, up.in_label or not shown,
        )
        self.stack.append(level)
        self.open_tags.update(level.adds_tags)
        self.open_marks.update(level.adds_marks)
        self.hidden += tag in HIDDEN
        self.in_link += tag == "a"

    def pop_to(self, at: int) -> None:
        for level in self.stack[at:]:
            self.places[level.tag].pop()
            for counts, numbers in ((self.open_tags, level.adds_tags), (self.open_marks, level.adds_marks)):
                for number in numbers:
                    counts[number] -= 1
                    if not counts[number]:
                        del counts[number]
            self.hidden -= level.tag in HIDDEN
            self.in_link -= level.tag == "a"
        del self.stack[at:]

    def open_at(self, tags, holders=()) -> int | None:
        """The innermost open one of these tags, unless a holder is open inside it."""
        last = lambda names: max((self.places[t][-1] for t in names if self.places.get(t)), default=0)
        at = last(tags)
        return at if at and at >= last(holders) else None

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self.flush()
        if tag == "body" and (at := self.places.get("head")):  # an unclosed head ends here
            self.pop_to(at[0])
        if tag in CLOSES and (at := self.open_at(*CLOSES[tag])) is not None:
            self.pop_to(at)
        elif tag in P_ENDERS and (at := self.open_at({"p"}, P_HOLDERS)) is not None:
            self.pop_to(at)
        if tag not in VOID:
            self.push(tag, attrs)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if (at := self.open_at({tag})) is not None:
            self.pop_to(at)

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if not self.parts:
            self.under = self.stack[-1]
            self.over = tuple(self.shared.setdefault(names, names) for names in (frozenset(self.open_tags), frozenset(self.open_marks)))
        self.parts.append(data)
        if self.in_link:
            self.links += len(data)


def leaf_blocks(html: str) -> list[Block]:
    """The blocks with text, in page order; character references decoded, white space runs made one space, trimmed."""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.found
