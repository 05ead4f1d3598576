"""Weighted finite-state transducers over clause symbols, and the toxicity grammar composed of them.

A transducer reads one symbol at a time, writes one, and multiplies weights. `compose` feeds what one writes to the next and
has pairs of states, made as they are reached. The grammar is tag -> what follows (read from the end) -> negation -> reported
speech -> insults -> threats; a clause's mass is the sum of its insults' and threats' weights, each times the weight of its path.
Insults named by labelled rows count by themselves, and more with a target on either side; those of the seed list, which no label
confirms, count with a target in the clause or after a predicate. Threats count with a target on either side (the most of a text
once), and in full where an intention comes before them and the addressed person after. A negation, and quotation marks with a
verb of reporting on either side, leave so little of a weight that one insult is below the threshold. A quotation goes on over the ends of
clauses, and so does the verb before it or behind it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Hashable, Iterator

#: Symbols: I insult, S seed insult, T threat, Z person addressed, Y other target, P predicate, W intention, N negation, R verb of
#: reporting, Q quotation mark, B boundary within a clause, O any other. I, S and T carry marks of what follows them in the clause
#: (y target, z person addressed, r verb of reporting). Small first letters stand for negated or reported ones.
SEED_INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "worthless", "trash", "disgusting", "pathetic", "clown")
THREATS = ("kill", "destroy", "hurt", "beat", "burn", "strangle", "stab", "shoot")
TARGETS = ("you", "your", "you're", "they", "them", "he", "she", "him", "her", "tu", "vous", "toi", "du", "dich", "sie", "usted", "ustedes")
ADDRESSED = ("you", "your", "you're", "tu", "te", "toi", "vous", "du", "dich", "sie", "usted", "ustedes")
PREDICATES = ("is", "are", "was", "were", "am", "i'm", "he's", "she's", "they're", "such", "what", "ist", "sind", "bist", "est", "es", "êtes", "eres", "son")
INTENTIONS = ("will", "gonna", "going", "shall", "i'll", "we'll", "want", "werde", "werden", "vais", "allons", "voy", "vamos")
NEGATIONS = ("not", "never", "isn't", "aren't", "wasn't", "don't", "nicht", "kein", "keine", "pas", "jamais", "nunca", "jamás")
REPORTS = ("said", "says", "wrote", "writes", "called", "quoted", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió")

#: States of `reported`: whether a verb of reporting was read, and whether quotation marks are open.
UNQUOTED = (False, False)
Step = Callable[[Hashable, str], tuple[Hashable, str, float]]


class Transducer:
    def __init__(self, start: Hashable, step: Step):
        self.start, self.step = start, step
        self.arcs: dict[tuple[Hashable, str], tuple[Hashable, str, float]] = {}

    def move(self, state: Hashable, symbol: str) -> tuple[Hashable, str, float]:
        arc = self.arcs.get((state, symbol))
        if arc is None:
            arc = self.arcs[state, symbol] = self.step(state, symbol)
        return arc

    def run(self, symbols: list[str]) -> list[tuple[str, float]]:
        state, out = self.start, []
        for s in symbols:
            state, written, weight = self.move(state, s)
            out.append((written, weight))
        return out


def compose(first: Transducer, then: Transducer) -> Transducer:
    def step(state, symbol):
        a, written, w = first.move(state[0], symbol)
        b, last, v = then.move(state[1], written)
        return (a, b), last, w * v

    return Transducer((first.start, then.start), step)


def following() -> Transducer:
    """Reads a clause from its end: insults and threats get marks of what comes after them."""

    def step(state, s):
        if s in "IST":
            return state, s + state, 1.0
        new = {"Y": "y", "Z": "yz", "R": "r"}.get(s, "")
        return "".join(sorted({*state, *new})), s, 1.0

    return Transducer("", step)


def negation(reach: int = 3, weight: float = 0.03) -> Transducer:
    """An insult or threat within `reach` symbols after a negation hardly counts."""

    def step(state, s):
        if s == "N":
            return reach, s, 1.0
        if state and s[0] in "IST":
            return state - 1, s[0].lower() + s[1:], weight
        return (0 if s == "B" else max(state - 1, 0)), s, 1.0

    return Transducer(0, step)


def reported(weight: float = 0.03) -> Transducer:
    """What stands in quotation marks before or after a verb of reporting hardly counts."""

    def step(state, s):
        said, inside = state
        if s == "R":
            return (True, inside), s, 1.0
        if s == "Q":
            return (said, not inside), s, 1.0
        if inside and s[0] in "IST" and (said or "r" in s):
            return state, s[0].lower() + s[1:], weight
        return state, s, 1.0

    return Transducer(UNQUOTED, step)


def insults(weight: float = 1.3) -> Transducer:
    """With a target in its clause an insult counts more. One of the seed list needs that, or a predicate before it."""

    def step(state, s):
        aimed, said_of = state
        if s in "YZ":
            return (True, said_of), s, 1.0
        if s == "P":
            return (aimed, True), s, 1.0
        aims = aimed or "y" in s
        if s[0] in "IS" and aims:
            return state, s, weight
        return state, s, 0.0 if s[0] in "Ss" and not aims and not said_of else 1.0

    return Transducer((False, False), step)


def threats(direct: float = 3.5) -> Transducer:
    """A threat needs a target in its clause; after an intention and before the person addressed it counts `direct` times."""

    def step(state, s):
        aimed, meant = state
        if s in "YZ":
            return (True, meant), s, 1.0
        if s == "W":
            return (aimed, True), s, 1.0
        if s[0] in "Tt":
            return state, s, direct if meant and "z" in s else 1.0 if aimed or "y" in s else 0.0
        return state, s, 1.0

    return Transducer((False, False), step)


FOLLOWING = following()
NEGATION, REPORTED, INSULTS, THREATENED = negation(), reported(), insults(), threats()
GRAMMAR = compose(compose(compose(NEGATION, REPORTED), INSULTS), THREATENED)
#: Factors of threats at least this large (negated and reported ones aren't) are those of direct ones.
DIRECT = 2.0


def paths(symbols: list[str], quoted: tuple[bool, bool] = UNQUOTED, follows: str = "") -> list[float]:
    """The weight of each symbol of a clause. quoted: the state of a quotation that goes on from the clause before; follows: what comes
    after the clause, as `following` marks it."""
    state, marked = follows, []
    for s in reversed(symbols):
        state, written, _ = FOLLOWING.move(state, s)
        marked.append(written)
    at, out = (((NEGATION.start, quoted), INSULTS.start), THREATENED.start), []
    for s in reversed(marked):
        at, _, weight = GRAMMAR.move(at, s)
        out.append(weight)
    return out


def after(symbols: list[str], quoted: tuple[bool, bool]) -> tuple[bool, bool]:
    """The state of quotations behind a clause: the verb before an open quotation stays known."""
    for s in symbols:
        quoted = REPORTED.move(quoted, s)[0]
    return quoted if quoted[1] else UNQUOTED


class Seed(float):
    """The weight of a word of the seed list that no labelled row confirms."""


TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CLAUSE = re.compile(r"[.!?;\n]+(?=\s|$)")
_IN_CLAUSE = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”«»]|[,:]")
_FIXED = {w: s for s, words in (("Y", TARGETS), ("Z", ADDRESSED), ("P", PREDICATES), ("W", INTENTIONS), ("N", NEGATIONS), ("R", REPORTS)) for w in words}
PREFIXES = range(4, 8)


def terms(token: str) -> list[str]:
    """What a lexicon may know a token by: itself, and its beginnings."""
    return [token, *(token[:k] + "*" for k in PREFIXES if len(token) > k)]


MARKS = "\"“”«»"


class Scorer:
    """score(text): 1 - (1 - base) x exp(-mass), where mass sums over clauses. lexicon: term -> weight, -ln(1 - precision)."""

    def __init__(self, lexicon: dict[str, float], base: float, threat: float = 0.3):
        self.lexicon, self.base, self.threat = lexicon, base, threat
        self.known = _Known(lexicon)

    def symbols(self, tokens: list[str], hits: set[str]) -> tuple[list[str], list[float]]:
        symbols, weights = [], []
        for t in tokens:
            weight = self.known[t] if t in hits else 0.0
            symbol = ("S" if isinstance(weight, Seed) else "I") if weight else "T" if t in THREATS else _FIXED.get(t) or ("Q" if t in MARKS else "B" if t in ",:" else "O")
            symbols.append(symbol)
            weights.append(weight)
        return symbols, weights

    def clauses(self, low: str, hits: set[str]) -> Iterator[tuple[list[str], list[float], tuple[bool, bool], str]]:
        """(symbols, weights, quotation before, what follows) of the clauses with hits."""
        if not any(q in low for q in MARKS):
            for clause in _CLAUSE.split(low):
                tokens = _IN_CLAUSE.findall(clause)
                if not hits.isdisjoint(tokens):
                    yield *self.symbols(tokens, hits), UNQUOTED, ""
            return
        every = [self.symbols(_IN_CLAUSE.findall(clause), hits) for clause in _CLAUSE.split(low)]
        before, quoted = [], UNQUOTED
        for symbols, _ in every:
            before.append(quoted)
            quoted = after(symbols, quoted)
        # a verb behind a quotation is known in all its clauses
        follows, verb = [""] * len(every), False
        for k in range(len(every) - 1, -1, -1):
            open_behind = k + 1 < len(every) and before[k + 1][1]
            follows[k] = "r" if verb and open_behind else ""
            verb = "R" in every[k][0] or bool(verb and open_behind)
        for (symbols, weights), b, f in zip(every, before, follows, strict=True):
            if any(x in "IST" for x in symbols):
                yield symbols, weights, b, f

    def mass(self, text: str) -> float:
        low = text.lower().replace("’", "'")
        hits = {t for t in set(TOKEN.findall(low)) if self.known[t] or t in THREATS}
        if not hits:
            return 0.0
        total = weak = 0.0
        for symbols, weights, before, follows in self.clauses(low, hits):
            for factor, weight, symbol in zip(paths(symbols, before, follows), weights, symbols, strict=True):
                if symbol in "IS":
                    total += factor * weight
                elif symbol == "T" and factor >= DIRECT:
                    total += factor * self.threat
                elif symbol == "T":
                    weak = max(weak, factor * self.threat)
        return total + weak

    def score(self, text: str | None) -> float:
        return 1 - (1 - self.base) * math.exp(-self.mass(text or ""))


class _Known(dict):
    """Weights of tokens, by the weightiest term that the lexicon knows; bounded memory."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, token: str) -> float:
        if len(self) >= 300_000:
            self.clear()
        w = self[token] = max(self.lexicon.get(t, 0.0) for t in terms(token))
        return w
