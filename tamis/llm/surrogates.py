"""PII surrogates: detected entities get keyed replacements of their own type, format, script and gender.

Each type has a keyed permutation of its own domain (a Feistel network with cycle walking over as many values as the format
has): digits of a phone number over digits, a card's over numbers with a right check digit, an address's letters over
letters of the same script, a listed given name over names of the same gender and script. A permutation is its own proof of
distinctness: two entities never meet in one surrogate, whatever the corpus, and the same entity has the same surrogate in
every document, so that coreference holds without a table of entities. What is permuted is an entity's canonical value: a phone number
has one surrogate in all its formats. Letters of any script go to letters of that script and case. A name that has a title
somewhere in a text is replaced at its other places in that text too, and so is each of its parts alone, where the first is a listed
given name; a part has one surrogate, alone and beside others, and none that is listed for one that isn't. Gender follows the listed name, since
a title may be missing elsewhere. Domains of addresses and countries of phone
numbers belong to the format and stay. A permutation steps along a secret cycle through its
whole domain, so that no entity is its own surrogate where its format has two values. Two checks follow: distinct entities of
each text are counted before and after, and `collisions` names a corpus's surrogates with more than one original; it finds
none, and the query runs it and fails if it does.

Defined results: null texts stay null and have no entities; empty texts stay empty; rows that repeat change alike; an empty
table gives an empty result; all other columns pass through whatever their names. Spans of kinds that overlap go to the kind listed first,
of one kind to the one that starts first. Very long texts are read whole; work grows with their length and their entities alone.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import string
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table

GIVEN = {
    ("f", "latin"): ("Mary", "Anna", "Julia", "Laura", "Sarah", "Emma", "Sofia", "Marie", "Claire", "Elena", "Lucia", "Carmen", "Alice", "Nina", "Paula", "Helen", "Ruth", "Diana", "Irene", "Clara"),
    ("m", "latin"): ("John", "Peter", "Paul", "Thomas", "Martin", "David", "Daniel", "Michael", "Robert", "James", "Carlos", "Jose", "Pierre", "Jean", "Hans", "Klaus", "Luis", "Mark", "Simon", "Victor"),
    ("f", "cyrillic"): ("Анна", "Мария", "Елена", "Ольга", "Ирина", "Наталья", "Татьяна", "Светлана"),
    ("m", "cyrillic"): ("Иван", "Пётр", "Сергей", "Андрей", "Дмитрий", "Алексей", "Николай", "Михаил"),
}
GENDER = {n: k for k, names in GIVEN.items() for n in names}
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sra": "f", "Sr": "m", "Dr": "", "Prof": ""}
_NAME = r"[^\W\d_a-zà-ÿа-яё][^\W\d_]+(?:-[^\W\d_]+)?"
#: Kinds in their order. Group "v" is the entity where a pattern has one.
PATTERNS = {
    "email": re.compile(r"(?<![\w.+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])"),
    "secret": re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?(?P<v>[A-Za-z0-9+/_-]{12,})"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"),
    "ssn": re.compile(r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"),
    "ip": re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"),
    "phone": re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d)|(?<![\w+])\+\d{8,15}(?!\d)"),
    "name": re.compile(rf"(?<!\w)(?P<t>{'|'.join(TITLES)})\.? (?P<v>{_NAME}(?: {_NAME})?)"),
}
NEEDS = {"email": "@", "secret": "", "iban": "9", "card": "9", "ssn": "9", "ip": "9", "phone": "9", "name": " "}
SPANS = "array<struct<kind:string,start:int,end:int,surrogate:string>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind: str, value: str) -> bool:
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return all(int(x) < 256 for x in value.split("."))
    if kind == "iban":
        c = value.replace(" ", "")
        return int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1
    return True


class Keyed:
    """Keyed permutations of ranges and of strings."""

    def __init__(self, key: str):
        self.key = key.encode()
        self.permute = lru_cache(maxsize=50_000)(self._permute)

    def number(self, tweak: str, data: str) -> int:
        return int.from_bytes(hmac.digest(self.key, f"{tweak}|{data}".encode(), "sha256")[:16], "big")

    def _feistel(self, tweak: str, x: int, size: int, rounds: range) -> int:
        """A permutation of range(size), or with rounds backwards its inverse: a Feistel network over an even number of bits,
        walked until it lands in the range."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, y = (1 << half) - 1, x
        back = rounds.step < 0
        while True:
            left, right = y >> half, y & mask
            for r in rounds:
                if back:
                    left, right = right ^ (self.number(tweak, f"{size}:{r}:{left}") & mask), left
                else:
                    left, right = right, left ^ (self.number(tweak, f"{size}:{r}:{right}") & mask)
            y = left << half | right
            if y < size:
                return y

    def _permute(self, tweak: str, x: int, size: int) -> int:
        """x's image under a keyed permutation without fixed points: one step along a secret cycle through the whole range."""
        if size <= 1:
            return x
        step = 1 + self.number(tweak, f"{size}:step") % (size - 1)
        y = (self._feistel(tweak, x, size, range(8)) + step) % size
        return self._feistel(tweak, y, size, range(7, -1, -1))

    def characters(self, tweak: str, text: str, classes: tuple[str, ...], ok=None) -> str:
        """Each character of a class goes to one of that class; all others stay. One permutation over all that have the format,
        walked until `ok` holds, which it has to of the text itself."""
        at = [(k, c.index(ch), c) for k, ch in enumerate(text) for c in classes if ch in c]
        size, x = 1, 0
        for _, d, c in at:
            x, size = x * len(c) + d, size * len(c)
        shape = "".join("." if not any(ch in c for c in classes) else str(next(i for i, c in enumerate(classes) if ch in c)) for ch in text)
        while True:
            x = y = self.permute(f"{tweak}|{shape}", x, size)
            out = list(text)
            for k, _, c in reversed(at):
                y, d = divmod(y, len(c))
                out[k] = c[d]
            if ok is None or ok("".join(out)):
                return "".join(out)


DIGITS, LOWER, UPPER = string.digits, string.ascii_lowercase, string.ascii_uppercase
VOWELS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоу", "бвгдзклмнпрст", "АЕИОУ", "БВГДЗКЛМНПРСТ")


#: Countries' codes of phone numbers: of one and two digits; all others have three.
COUNTRY = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")
_HEXA = re.compile(r"[0-9a-f]+|[0-9A-F]+")


@lru_cache(maxsize=1)
def alphabets() -> dict[str, str]:
    """Letter: all of its script and category that VOWELS don't list. Letters alone in theirs go with those of their category."""
    listed, by = set("".join(VOWELS)), {}
    for c in map(chr, range(0x80, 0x32000)):
        if c.isalnum() and c not in listed:
            by.setdefault((unicodedata.name(c, "").split(" ")[0].split("-")[0], unicodedata.category(c)), []).append(c)
    for key in [k for k, v in by.items() if len(v) == 1]:
        by.setdefault(("", key[1]), []).extend(by.pop(key))
    return {c: cs for v in by.values() for cs in ["".join(v)] for c in v}


def canonical(kind: str, value: str) -> str:
    """What is the same for all formats of an entity."""
    if kind == "phone":
        return "".join(c for c in value if c.isdigit() or c == "+")
    if kind in ("card", "iban"):
        return re.sub(r"[ -]", "", value)
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    return value.lower() if kind == "email" or kind == "secret" and _HEXA.fullmatch(value) else value


class Surrogates:
    def __init__(self, key: str):
        self.keyed = Keyed(key)
        self.of = lru_cache(maxsize=100_000)(self._of)

    def _of(self, kind: str, value: str) -> str:
        """The surrogate of an entity. Case isn't part of an address's or a name's identity, but of its format."""
        k = self.keyed
        if kind == "email":
            local, domain = value.rsplit("@", 1)
            low = k.characters(f"email|{domain.lower()}", local.lower(), (LOWER, DIGITS))
            new = "".join(c.upper() if o.isupper() else c for c, o in zip(low, local, strict=True))
            return f"{new}@{domain}"
        if kind == "secret":
            if _HEXA.fullmatch(value):
                low = k.characters("secret", value.lower(), ("0123456789abcdef",))
                return low if value == value.lower() else low.upper()
            return k.characters("secret", value, (LOWER, UPPER, DIGITS), lambda x: not _HEXA.fullmatch(x))
        if kind == "card":
            digits = [i for i, c in enumerate(value) if c.isdigit()]
            lead = value[digits[0]]  # the network's digit belongs to the type
            new = [lead, *k.characters(f"card|{lead}", "".join(value[i] for i in digits[1:-1]), (DIGITS,))]
            check = next(c for c in DIGITS if luhn("".join(new) + c))
            out = list(value)
            for i, c in zip(digits, [*new, check], strict=True):
                out[i] = c
            return "".join(out)
        if kind == "iban":
            plain = value.replace(" ", "")
            body = k.characters("iban", plain[4:], (UPPER, DIGITS))
            check = 98 - int("".join(str(int(x, 36)) for x in body + plain[:2] + "00")) % 97
            new = iter(f"{plain[:2]}{check:02d}{body}")
            return "".join(c if c == " " else next(new) for c in value)
        if kind == "ip":
            parts = [int(x) for x in value.split(".")]
            y = k.permute("ip", int.from_bytes(bytes(parts), "big"), 1 << 32)
            return ".".join(map(str, y.to_bytes(4, "big")))
        if kind == "name":
            return " ".join(map(self.name_part, value.split(" ")))
        if kind == "ssn":
            return k.characters(kind, value, (DIGITS,), PATTERNS["ssn"].fullmatch)
        head = COUNTRY.match(value)
        n = head.end() if head else 0
        new = iter(k.characters(kind, "".join(c for c in value[n:] if c in DIGITS), (DIGITS,)))
        return value[:n] + "".join(next(new) if c in DIGITS else c for c in value[n:])

    def name_part(self, part: str) -> str:
        listed = GENDER.get(part)
        if listed:
            names = GIVEN[listed]
            return names[self.keyed.permute(f"given|{listed}", names.index(part), len(names))]
        others = dict.fromkeys(alphabets()[c] for c in part if c in alphabets())
        return self.keyed.characters("surname", part, (*VOWELS, *others), lambda x: x not in GENDER)


class Taken:
    """Spans without overlaps."""

    def __init__(self):
        self.spans: list[tuple[int, int]] = []

    def take(self, a: int, b: int) -> bool:
        """Whether [a, b) is free; if so it is taken."""
        k = bisect_left(self.spans, (b,))
        free = k == 0 or self.spans[k - 1][1] <= a
        if free:
            self.spans.insert(k, (a, b))
        return free


#: A word, and what may go on a name from there: a part behind a hyphen, and a second word with one.
_WORDS = re.compile(r"(?<!\w)([^\W\d_]+)(?=((?:-[^\W\d_]+)?)((?: [^\W\d_]+)?)((?:-[^\W\d_]+)?))")


def mentions(text: str, names: set[str]) -> Iterator[tuple[int, int]]:
    """Spans of names as whole words, the longest that starts at a word."""
    first = {re.match(r"[^\W\d_]+", n).group() for n in names}
    for m in _WORDS.finditer(text):
        word, tail, second, more = m.groups()
        if word in first:
            for said in (word + tail + second + more, word + tail + second, word + tail, word):
                end = m.start() + len(said)
                if said in names and not re.match(r"\w", text[end : end + 1]):
                    yield m.start(), end
                    break


def spans(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, value, title) of a text's entities, without overlaps, in order."""
    found: list[tuple[int, int, str, str, str]] = []
    taken = Taken()
    digit = any(c in text for c in DIGITS)
    low = text.lower() if "=" in text or ":" in text else ""
    for kind, pattern in PATTERNS.items():
        need = NEEDS[kind]
        if (need == "9" and not digit) or (need == "@" and "@" not in text):
            continue
        if kind == "secret" and not any(h in low for h in ("passw", "secret", "token", "apikey", "api_key")):
            continue
        if kind == "name" and not any(t in text for t in TITLES):
            continue
        group = "v" if "v" in pattern.groupindex else 0
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if valid(kind, m.group(group)) and taken.take(a, b):
                found.append((a, b, kind, m.group(group), m.group("t") if kind == "name" else ""))
    names = {x[3] for x in found if x[2] == "name"}
    names |= {part for n in names if n.split(" ")[0] in GENDER for part in n.split(" ")}
    for a, b in mentions(text, names) if names else ():
        if taken.take(a, b):
            found.append((a, b, "name", text[a:b], ""))
    return sorted(found)


def replaced(text: str, maker: Surrogates) -> tuple[str, list[tuple[str, int, int, str]]]:
    out, at, what = [], 0, []
    for a, b, kind, value, _ in spans(text):
        new = maker.of(kind, value)
        out += [text[at:a], new]
        what.append((kind, a, b, new))
        at = b
    return "".join([*out, text[at:]]), what


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """docs with text replaced, all other columns as they are."""
    text_at = docs.columns.index("text")

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        maker = Surrogates(key)
        for b in batches:
            texts = [None if t is None else replaced(t, maker)[0] for t in b.column(text_at).to_pylist()]
            yield b.set_column(text_at, b.schema.field(text_at), pa.array(texts, b.schema.field(text_at).type))

    return docs.mapInArrow(of, docs.schema)


def entities(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (replaced), n_entities, n_distinct_before, n_distinct_after, spans."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker = Surrogates(key)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                new, what = (None, []) if text is None else replaced(text, maker)
                before = len({(k, text[a:e]) for k, a, e, _ in what})
                rows.append((doc_id, new, len(what), before, len({(k, s) for k, _, _, s in what}), [{"kind": k, "start": a, "end": e, "surrogate": s} for k, a, e, s in what]))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "n_entities", "n_before", "n_after", "spans"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(of, f"doc_id long, text string, n_entities int, n_before int, n_after int, spans {SPANS}")


def collisions(docs: DataFrame, key: str) -> DataFrame:
    """kind, surrogate, originals: surrogates of the corpus that stand for more than one entity (by digests of the originals)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker = Surrogates(key)
        for b in batches:
            pairs = {(k, maker.of(k, v), hashlib.sha256(canonical(k, v).encode()).hexdigest()) for text in b["text"] if text for _, _, k, v, _ in spans(text)}
            yield pd.DataFrame(sorted(pairs), columns=["kind", "surrogate", "original"])

    pairs = docs.select("text").mapInPandas(of, "kind string, surrogate string, original string").distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("originals")).where("originals > 1")


#: The key where the session's configuration has none under KEY_NAME; a real run gives its own.
KEY, KEY_NAME = "replace me", "spark.tamis.surrogates.key"


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_NAME, KEY)


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    key = key_of(spark)
    if not collisions(docs, key).isEmpty():
        raise ValueError("two entities have one surrogate")
    out = entities(docs, key)
    kinds = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "text", "n_entities", "n_before", "n_after", kinds.alias("spans"))
