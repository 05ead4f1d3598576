"""What the sequential layers ask of a text: checksums, keywords near a place, and what disowns a value.

Layers look for values first. Keywords are read only around values, in blocks that are read once each; words are compared with
keywords once per worker, so that the work on a text is proportional to its length and to nothing else.
"""

from __future__ import annotations

import re
from functools import cached_property

# ---- checks ----


def digits_of(value: str) -> str:
    return re.sub(r"\D", "", value)


def luhn(value: str, least: int = 9) -> bool:
    d = [int(c) for c in digits_of(value)]
    if len(d) < least:
        return False
    doubled = [x * 2 - 9 * (x > 4) for x in d[-2::-2]]
    return (sum(d[-1::-2]) + sum(doubled)) % 10 == 0


def valid_sin(value: str) -> bool:
    d = digits_of(value)
    return len(d) == 9 and d[0] not in "08" and luhn(d)


def valid_ssn(value: str) -> bool:
    d = digits_of(value)
    return len(d) == 9 and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def valid_ohip(value: str) -> bool:
    d = digits_of(value)
    return len(d) == 10 and d[0] != "0" and luhn(d)


def valid_bc(value: str) -> bool:
    d = digits_of(value)
    if len(d) != 10 or d[0] != "9":
        return False
    rest = 11 - sum(int(c) * w for c, w in zip(d[1:9], (2, 4, 8, 5, 10, 9, 7, 3), strict=True)) % 11
    return rest <= 9 and rest == int(d[9])


class Pattern:
    """A string that others are compared with: its letters' places are bits of one number per letter."""

    def __init__(self, text: str):
        self.text, self.full, self.bits = text, (1 << len(text)) - 1, {}
        for i, c in enumerate(text):
            self.bits[c] = self.bits.get(c, 0) | 1 << i

    def common(self, other: str) -> int:
        """Length of the longest common subsequence."""
        row = self.full
        for c in other:
            hit = row & self.bits.get(c, 0)
            row = (row + hit | row - hit) & self.full
        return len(self.text) - row.bit_count()

    def alike(self, other: str) -> bool:
        """Whether 2 x common / total length is at least 0.8."""
        return 5 * self.common(other) >= 2 * (len(self.text) + len(other))


# ---- keywords ----

# Keywords and confidence of each type; windows are 100 characters.
KEYWORDS: dict[str, tuple[tuple[str, ...], float]] = {
    "sin": (("sin", "social insurance", "social insurance number", "s.i.n"), 0.85),
    "ssn": (("ssn", "social security", "social security number", "s.s.n"), 0.85),
    "email": (("email", "e-mail", "emall", "ernail", "e mail"), 0.90),
    "phone": (("phone", "telephone", "tel", "mobile", "cell", "phane", "fone", "call", "fax"), 0.85),
    "credit_card": (("credit card", "card number", "cc", "visa", "mastercard", "amex"), 0.80),
    "postal_code_ca": (("postal", "postal code", "zip", "postcode"), 0.80),
}
PLACEHOLDERS = ("test", "demo", "example", "sample", "fake", "dummy", "do not use", "for testing", "test data", "placeholder", "template", "format", "specimen", "not real", "format like", "such as", "e.g.", "guide")
NEGATIONS = ("is not", "not a", "not an", "not a real", "does not", "do not confuse", "looks like", "resembles")

WINDOW, NEGATION_WINDOW = 100, 40
#: Characters of a block of keywords; a keyword, and a word that is like one, is far shorter than LONGEST.
BLOCK, LONGEST = 256, 64


def _alone(words: tuple[str, ...]) -> re.Pattern[str]:
    return re.compile(r"(?<![a-z0-9])(?:" + "|".join(re.escape(w) for w in words) + r")(?![a-z0-9])", re.I)


PLACEHOLDER, NEGATION = _alone(PLACEHOLDERS), _alone(NEGATIONS)
ADDRESS = re.compile(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}|https?://[^\s<>\"']+")
WORD = re.compile(r"\b\w+\b")
#: What numbers of seven digits or more, and dates, hold.
NUMBER = re.compile(r"\d[\d\s./-]{5,}\d")
KIND_OF = {word: kind for kind, (words, _) in KEYWORDS.items() for word in words}
#: A place where a keyword starts; keywords may overlap.
EXACT = re.compile(r"\b(?=(" + "|".join(re.escape(w) for w in sorted(KIND_OF, key=len, reverse=True)) + r")\b)")


class _Alike(dict):
    """Word: the types that have a keyword of over three letters which is like it, with at most two letters' difference in length."""

    def __init__(self):
        self.by_length: dict[int, list[tuple[str, Pattern]]] = {}
        for word, kind in KIND_OF.items():
            if len(word) > 3:
                for n in range(len(word) - 2, len(word) + 3):
                    self.by_length.setdefault(n, []).append((kind, Pattern(word)))

    def __missing__(self, word: str) -> frozenset[str]:
        if len(self) >= 300_000:
            self.clear()
        found = self[word] = frozenset(kind for kind, p in self.by_length.get(len(word), ()) if p.alike(word))
        return found


ALIKE = _Alike()


class Page:
    """A text with what several layers ask of it."""

    def __init__(self, text: str):
        self.text, self.low = text, text.lower()
        self._blocks: dict[int, list[tuple[int, frozenset[str]]]] = {}

    def keywords(self, block: int) -> list[tuple[int, frozenset[str]]]:
        """(start, types) of the keywords that start in a block."""
        found = self._blocks.get(block)
        if found is None:
            a, b = block * BLOCK, (block + 1) * BLOCK
            found = self._blocks[block] = []
            for m in EXACT.finditer(self.low, a, b + LONGEST):
                if m.start() >= b:
                    break
                found.append((m.start(), frozenset((KIND_OF[m.group(1)],))))
            for m in WORD.finditer(self.low, a, b + LONGEST):
                if m.start() >= b:
                    break
                if kinds := ALIKE[m.group()]:
                    found.append((m.start(), kinds))
        return found

    def close(self, kind: str, start: int, width: int = WINDOW) -> bool:
        """Whether a keyword of a type starts at most `width` characters from a place."""
        low, high = start - width, start + width
        return any(low <= at <= high and kind in kinds for k in range(max(0, low) // BLOCK, high // BLOCK + 1) for at, kinds in self.keywords(k))

    def about(self, start: int, end: int, width: int) -> str:
        return self.low[max(0, start - width) : end + width]

    def disowned(self, start: int, end: int, width: int) -> bool:
        """Whether a placeholder word, or close by a negation, says that the value isn't real."""
        wide = ADDRESS.sub(lambda m: " " * len(m.group()), self.about(start, end, width))
        return bool(PLACEHOLDER.search(wide) or NEGATION.search(self.about(start, end, NEGATION_WINDOW)))

    def alone(self, start: int, end: int) -> bool:
        beside = self.text[max(0, start - 1) : start] + self.text[end : end + 1]
        return not any(c.isalnum() or c in "-*" for c in beside)

    @cached_property
    def numbers(self) -> bool:
        """Whether there is a number of seven digits or more, or a date."""
        return NUMBER.search(self.text) is not None

    @cached_property
    def lines(self) -> list[tuple[int, int]]:
        """Spans of the lines, with their ends."""
        out, at = [], 0
        for line in self.text.splitlines(keepends=True):
            out.append((at, at + len(line)))
            at += len(line)
        return out
