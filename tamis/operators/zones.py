"""Machine-readable zones of travel documents: blocks of lines, field by field, with check digits."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

CHARS = re.compile(r"[A-Z0-9<]+")
#: format: (length of a line, lines, {field: (line, start, end)}); a field's check digit follows it. Places by ICAO 9303.
FORMATS = {
    "TD3": (44, 2, {"number": (1, 0, 9), "dob": (1, 13, 19), "expiry": (1, 21, 27)}),
    "TD2": (36, 2, {"number": (1, 0, 9), "dob": (1, 13, 19), "expiry": (1, 21, 27)}),
    "TD1": (30, 3, {"number": (0, 5, 14), "dob": (1, 0, 6), "expiry": (1, 8, 14)}),
}
# Letters read for digits, and the reverse; codes of issuers beside the countries'.
TO_DIGIT = {"O": "0", "Q": "0", "I": "1", "L": "1", "Z": "2", "S": "5", "B": "8", "G": "6"}
TO_LETTER = {"0": "O", "1": "I", "5": "S", "8": "B"}
OTHER_ISSUERS = ("UNO", "UNA", "UNK", "XOM", "XCC", "XXA", "XXB", "XXC", "XXX", "GBD", "GBN", "GBO", "GBP", "GBS", "RKS", "D")
DIGITS, LETTERS = str.maketrans(TO_DIGIT), str.maketrans(TO_LETTER)
_FILLERS = re.compile(r"(?<=<)K+|K(?=<)")


@dataclass(frozen=True)
class Gates:
    """What a block needs. states: accepted issuers, None for any of three letters and D. filler: one character < at the least.
    types: a document code that its format has. corroborated: an unproved number needs a proved date."""

    states: frozenset[str] | None = None
    filler: bool = True
    types: bool = False
    corroborated: bool = False

    def admit(self, form: str, state: str, kind: str, lines: list[str]) -> bool:
        known = state in self.states if self.states is not None else state == "D" or re.fullmatch("[A-Z]{3}", state)
        typed = not self.types or (kind[:1] == "P" if form == "TD3" else kind[:1] in ("I", "A", "C", "V"))
        return bool(known and typed and (not self.filler or any("<" in x for x in lines)))


def check_digit(field: str) -> str:
    value = lambda c: 0 if c == "<" else int(c, 36)
    return str(sum(value(c) * (7, 3, 1)[i % 3] for i, c in enumerate(field)) % 10)


def checked(field: str, digit: str) -> tuple[bool | None, str]:
    """(whether it holds, value): as read, else with one letter that is read as a digit; None where the digit is a filler."""
    if digit == "<":
        return None, field
    digit = digit.translate(DIGITS)
    for i in range(-1, len(field)):
        other = field if i < 0 else field[:i] + TO_DIGIT.get(field[i], field[i]) + field[i + 1 :]
        if check_digit(other) == digit:
            return True, other
    return False, field


class Lines:
    """A text's lines as zones have them: upper case, without white space, in compatible characters."""

    def __init__(self, text: str):
        self.lines = [re.sub(r"\s+", "", unicodedata.normalize("NFKC", x).upper()) for x in text.splitlines()]

    def at(self, i: int, n: int) -> tuple[str, int] | None:
        """A line of about n characters, and the number of the next one; one that broke in two is joined."""
        for parts in (1, 2):
            line = "".join(self.lines[i : i + parts])
            if i + parts > len(self.lines) or parts == 2 and not (self.lines[i] and len(self.lines[i]) < n - 2):
                return None
            if abs(len(line) - n) <= 2 and CHARS.fullmatch(line):
                return line, i + parts
        return None

    def blocks(self, n: int, count: int) -> Iterator[list[str | None]]:
        """Blocks of `count` lines from a first one on; of three, one of the others may be missing."""
        i = 0
        while i < len(self.lines):
            first = self.at(i, n)
            if first is None:
                i += 1
                continue
            block, nxt = [first[0]], first[1]
            while len(block) < count:
                more = self.at(nxt, n)
                block.append(more[0] if more else None)
                nxt = more[1] if more else nxt + 1
            if sum(b is not None for b in block) >= 2:
                yield block
                i = nxt
            else:
                i += 1


def mrz(text: str, gates: Gates) -> Iterator[tuple[str, str, float, dict]]:
    """Proved numbers and dates of a text's zones, and unproved numbers."""
    if "<" not in unicodedata.normalize("NFKC", text) and gates.filler:
        return
    lines = Lines(text)
    for form, (n, count, fields) in FORMATS.items():
        for block in lines.blocks(n, count):
            # K beside a filler is one; a filler makes the K after it one too
            zone = [b and _FILLERS.sub(lambda m: "<" * len(m.group()), b) for b in block]
            head = zone[0][:5].translate(LETTERS)
            kind, state = head[:2].replace("<", ""), head[2:].replace("<", "")
            if not gates.admit(form, state, kind, [b for b in block if b]):
                continue
            found = {}
            for name, (k, a, b) in fields.items():
                if zone[k] is not None:
                    field = zone[k][a:b] if name == "number" else zone[k][a:b].translate(DIGITS)
                    right, value = checked(field, zone[k][b])
                    found[name] = right, value.replace("<", "")
            extra = {"format": form, "issuing_state": state, "doc_type": kind}
            dated = any(found.get(x, (None,))[0] for x in ("dob", "expiry"))
            for name, (right, value) in found.items():
                if value and right:
                    yield "mrz_document_number" if name == "number" else f"mrz_{name}", value, 0.95, extra
                elif value and right is False and name == "number" and (dated or not gates.corroborated):
                    yield "mrz_unverified", value, 0.55, extra
