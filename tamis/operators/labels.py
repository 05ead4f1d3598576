"""Field labels of dates: which kind of label a value belongs to.

A label stands before the value on its line, else on the last line above that has letters or digits, else after it on its line. Other
values between a label and a value take the label. The labels of a line are found once, and of all labels only those between a
value and its neighbours are looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from difflib import SequenceMatcher
from functools import cached_property

from .page import Page

Span = tuple[int, int]
# Labels by kind, and digits that scanners take for letters.
LABELS = {
    "positive": ("dob", "ddn", "d.o.b", "date of birth", "birth date", "birth", "birthday", "born", "ne le", "nee le", "naissance"),
    "negative": ("exp", "expiry", "expires", "issue", "issued", "iss", "valid until", "date de delivrance", "expire le"),
}
CONFUSED = str.maketrans({"0": "o", "1": "i", "5": "s", "8": "s"})

#: A label begins outside of a word and may run into digits ("DOB1980"), not into letters.
SAID = {kind: re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(r"[ \t]+".join(map(re.escape, w.split())) for w in sorted(words, key=len, reverse=True)) + r")(?![A-Za-z])", re.I) for kind, words in LABELS.items()}
TOKEN = re.compile(r"[A-Za-z0-9]+")
JOINED = re.compile(r"([A-Za-z][A-Za-z0-9]*?)\d{4,}")


class _Kinds(dict):
    """Token: the kinds of label that it can be read as. One-word labels may be written twice or two in one; those of over three
    letters may be alike by 0.8; digits behind a token, four at the least, aren't part of it."""

    def __init__(self):
        self.single = {kind: sorted({re.sub("[^a-z]", "", w) for w in words if " " not in w}) for kind, words in LABELS.items()}
        self.forms = {kind: {w for w in ws if len(w) <= 3} | {a + b for a in ws for b in ws} for kind, ws in self.single.items()}

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) >= 300_000:
            self.clear()
        joined = JOINED.fullmatch(token)
        said = (joined.group(1) if joined else token).lower().translate(CONFUSED)
        like = lambda w: len(w) > 3 and abs(len(said) - len(w)) <= 2 and SequenceMatcher(None, said, w).ratio() >= 0.8
        found = self[token] = tuple(k for k in LABELS if said in self.forms[k] or any(map(like, self.single[k])))
        return found


KINDS = _Kinds()


def labels_in(line: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of a line's labels. A token inside a label of a kind isn't another one of it."""
    said = {kind: [m.span() for m in pattern.finditer(line)] for kind, pattern in SAID.items()}
    found = [(a, b, kind) for kind, spans in said.items() for a, b in spans]
    for m in TOKEN.finditer(line):
        for kind in KINDS[m.group()]:
            k = bisect_left(said[kind], (m.end(), 0)) - 1
            if k < 0 or said[kind][k][1] <= m.start():
                found.append((*m.span(), kind))
    return found


class FieldLabels:
    """Labels around the values of one sort on a page; `values` are the spans of all of them."""

    def __init__(self, page: Page, values: list[Span], kinds: tuple[str, ...] = tuple(LABELS)):
        self.page, self.values, self.kinds = page, sorted(values), kinds
        self._found: dict[int, tuple[list, list]] = {}

    @cached_property
    def starts(self) -> list[int]:
        return [a for a, _ in self.page.lines]

    @cached_property
    def above(self) -> list[int | None]:
        """For each line, the last one above that isn't punctuation alone."""
        out, last = [], None
        for k, (a, b) in enumerate(self.page.lines):
            out.append(last)
            if any(map(str.isalnum, self.page.text[a:b])):
                last = k
        return out

    def kinds_on(self, line: int, ending: Span | None = None, starting: Span | None = None) -> set[str]:
        """Kinds of the labels of a line that end in (a, b] or start in [a, b)."""
        if line not in self._found:
            a, b = self.page.lines[line]
            found = [(a + x, a + y, k) for x, y, k in labels_in(self.page.text[a:b]) if k in self.kinds]
            self._found[line] = sorted((y, k) for _, y, k in found), sorted((x, k) for x, _, k in found)
        ends, starts = self._found[line]
        if ending:
            return {k for _, k in ends[bisect_left(ends, (ending[0] + 1, "")) : bisect_left(ends, (ending[1] + 1, ""))]}
        return {k for _, k in starts[bisect_left(starts, (starting[0], "")) : bisect_left(starts, (starting[1], ""))]}

    def neighbours(self, start: int, end: int) -> Span:
        """(start of the last other value before, end of the first one after)."""
        at = bisect_left(self.values, (start, end))
        left, k = -1, at - 1
        while k >= 0 and left < 0:
            if self.values[k][1] <= start:
                left = self.values[k][0]
            k -= 1
        right, k = len(self.page.text) + 1, at + 1
        while k < len(self.values) and self.values[k][0] < right:
            if self.values[k][0] >= end:
                right = min(right, self.values[k][1])
            k += 1
        return left, right

    def of(self, start: int, end: int) -> str:
        """positive, negative, ambiguous (both kinds at the best place) or none."""
        left, right = self.neighbours(start, end)
        line = bisect_right(self.starts, start) - 1
        kinds = self.kinds_on(line, ending=(left, start))
        if not kinds and (up := self.above[line]) is not None:
            kinds = self.kinds_on(up, ending=(left, start))
        kinds = kinds or self.kinds_on(line, starting=(end, right))
        return "none" if not kinds else next(iter(kinds)) if len(kinds) == 1 else "ambiguous"
