"""Plain packing of one page, row by row: what the expressions of the library are compared with."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate, groupby
from textwrap import wrap

# What a heading and a sentence end look like.
_HEADING = re.compile(r"^#{1,6}\s+(.*\S)")
_SENTENCE_END = re.compile(r"(?<=[.!?;:])\s+")

@dataclass
class _Page:
    """Lines of a page with what each costs, so that a chunk is a span of lines and its length a difference of sums."""

    lines: list[str]
    #: 1 where a blank line stands before the line.
    lead: list[int]
    #: End of the paragraph that has to stay together from each line on (after the line itself where it need not).
    until: list[int]
    #: Title of each heading line.
    title: list[str | None]

    def __post_init__(self) -> None:
        self.ends = list(accumulate((len(x) + 1 + gap for x, gap in zip(self.lines, self.lead, strict=True)), initial=0))
        #: Characters before the line itself; never falls, so spans are found by bisection.
        self.before = [end + gap for end, gap in zip(self.ends, [*self.lead, 0], strict=True)]

    def shortest(self, stop: int, most: int) -> int:
        """First line of the longest span that ends before `stop` and has at most `most` characters."""
        return min(stop, bisect_left(self.before, self.ends[stop] - 1 - most))

    def text(self, start: int, stop: int) -> str:
        return "\n".join("\n" * (gap and i > 0) + x for i, (x, gap) in enumerate(zip(self.lines[start:stop], self.lead[start:stop], strict=True)))


def _kind(line: str) -> str:
    return "blank" if not line else "heading" if _HEADING.match(line) else "body"


def _measured(text: str, size: int) -> _Page:
    """Runs of body lines are paragraphs; one that is too long falls into sentences, and those into words."""
    page = _Page([], [], [], [])
    for kind, run in groupby((raw.rstrip() for raw in text.splitlines()), key=_kind):
        lines = list(run)
        if kind == "blank":
            continue
        together = kind == "body" and sum(map(len, lines)) + len(lines) - 1 <= size
        if kind == "body" and not together:
            parts = [part for x in lines for part in ([x] if len(x) <= size else _SENTENCE_END.split(x))]
            lines = [y for part in parts for y in ([part] if len(part) <= size else wrap(part, size, break_on_hyphens=False))]
        first = len(page.lines)
        page.lines += lines
        page.lead += [1 if kind == "heading" else int(i == 0) for i in range(len(lines))]
        page.until += [first + len(lines) if together else first + i + 1 for i in range(len(lines))]
        page.title += [_HEADING.match(x).group(1) if kind == "heading" else None for x in lines]
    page.__post_init__()
    return page


def pack_page(text: str, section: str, size: int, overlap: int) -> tuple[list[tuple[str, str]], str]:
    """Greedy packing of one page: [(section, chunk text)] and the section in force at its end.

    A chunk is a span that grows by whole paragraphs. It ends before a heading, or where the next paragraph would not
    fit; then the next one starts with the last lines of it that fit the overlap and leave room. Headings never stand
    alone: a paragraph that does not fit behind them joins line by line.
    """
    page, out = _measured(text, size), []
    start = at = 0
    body = False
    loose = 0  # lines before this one may be parted from their paragraph
    while at < len(page.lines):
        heading, stop = page.title[at], at + 1 if at < loose else page.until[at]
        if heading is not None:
            if body:
                out.append((section, page.text(start, at)))
                start, body = at, False
            section = heading
        elif start < at and page.shortest(stop, size) > start:
            if not body and stop > at + 1:
                loose = stop
                continue
            out.append((section, page.text(start, at)))
            start = max(page.shortest(at, overlap), page.shortest(stop, size))
            start = min(start, at)
        at, body = stop, body or heading is None
        if heading is not None:
            body = False
    if start < at:
        out.append((section, page.text(start, at)))
    return out, section
