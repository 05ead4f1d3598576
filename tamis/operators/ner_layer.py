"""The semantic layer around a model: chunks of a text that a model can take, and which of its answers stand.

The model itself is given by the caller: predict(list of chunks) -> for each chunk, (label, value, score) of its entities."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels, threshold, limits of chunks, characters that are read, and files that aren't prose.
LABELS = ("person", "organization", "location", "date")
THRESHOLD = 0.50
CHUNK_WORDS, CHUNK_TOKENS, OVERLAP_WORDS = 350, 1024, 50
MOST = 150_000
NOT_PROSE = ("py", "js", "json", "log", "csv", "xml", "yml", "yaml")
FIELD_LABELS = ("sin", "ssn", "dob", "phn", "ohip")
DOMAIN_ENDS = ("com", "org", "net", "ca", "io", "gov", "edu", "co", "us", "uk", "info", "biz", "me")

_WORD = re.compile(r"\S+")
_ADDRESS = re.compile(r"(?:\d{1,3}(?:\.\d{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){2,}[0-9A-Fa-f]{1,4})")
_DATE = re.compile(r"(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})")
_DOMAIN = re.compile(rf"(?:[a-zA-Z0-9-]+\.)+(?:{'|'.join(DOMAIN_ENDS)})", re.I)


def chunks(text: str, tokens: Callable[[str], int] | None = None, words: int = CHUNK_WORDS, most_tokens: int = CHUNK_TOKENS, overlap: int = OVERLAP_WORDS) -> Iterator[str]:
    """Overlapping parts of a text of at most `words` words and `most_tokens` tokens. A part that has too many tokens ends earlier, at
    a word if one fits, else inside the word; the next part begins `overlap` words before a part's end, or after a part's start
    where the part is shorter than that."""
    spans = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [a for a, _ in spans], [b for _, b in spans]
    fits = lambda a, b: tokens is None or tokens(text[a:b]) <= most_tokens
    if spans and len(spans) <= words and fits(0, len(text)):
        yield text
        return
    at, last = starts[0] if spans else 0, ends[-1] if spans else 0
    while at < last:
        first = bisect_right(ends, at)
        limit = ends[min(first + words, len(ends)) - 1]
        if not fits(at, limit):
            # the longest part that fits, at the end of a word where possible
            whole = [b for b in ends[first : first + words] if b > at]
            n = bisect_left(range(len(whole)), True, key=lambda k: not fits(at, whole[k]))
            limit = whole[n - 1] if n else at + max(1, bisect_left(range(at + 1, whole[0] + 1), True, key=lambda b: not fits(at, b)))
        yield text[at:limit]
        if limit >= last:
            return
        done = bisect_left(ends, limit) + 1
        back = starts[max(done - overlap, 0)]
        at = back if back > at else starts[first + 1] if first + 1 < done else limit


def structured(value: str) -> bool:
    """Whether a value belongs to other layers: an address or domain of the net, mostly digits (seven at least, six in ten
    characters; dates aren't), or a field's label."""
    v = value.strip()
    digits = sum(c.isdigit() for c in v)
    heavy = digits >= 7 and digits >= 0.6 * len(v) and not _DATE.match(v)
    return bool(v) and (v.lower().startswith(("http://", "https://")) or bool(_ADDRESS.fullmatch(v)) or heavy or bool(_DOMAIN.fullmatch(v)) or v.lower() in FIELD_LABELS)


def entities(answers: Iterator[tuple[str, str, float]], threshold: float = THRESHOLD) -> list[tuple[str, str, float]]:
    """The best score of each label and value, values by their first line, without those of other layers."""
    best: dict[tuple[str, str], float] = {}
    for label, value, score in answers:
        value = value.split("\n")[0].strip()
        if label in LABELS and score >= threshold and value and not structured(value):
            best[label, value] = max(score, best.get((label, value), 0.0))
    return [(label, value, score) for (label, value), score in best.items()]


def layer(load: Callable[[], tuple[Callable, Callable[[str], int] | None]]) -> Callable[[Column], Column]:
    """The `ner` of a scan. load() gives (predict, token counter) and is called once in each worker's task."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict, tokens = load()
        for texts in batches:
            out = []
            for t in texts:
                parts = list(chunks(t or "", tokens))
                found = entities(a for answers in (predict(parts) if parts else ()) for a in answers)
                out.append([{"raw_type": k, "value": v, "confidence": float(c)} for k, v, c in found])
            yield pd.Series(out)

    return F.pandas_udf(run, "array<struct<raw_type:string,value:string,confidence:double>>")
