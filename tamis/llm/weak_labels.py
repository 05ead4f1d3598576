"""Weak-label quality classifier: expectation-maximisation over heuristic labellers, then a hashed linear scorer.

Labellers vote good, bad or nothing on each text. The number of rows of each vote pattern (at most 3 ** labellers, whatever
the number of rows) is all that expectation-maximisation needs: it estimates each labeller's accuracies on both classes and the share of good
rows without any gold label, and gives a posterior for each pattern. Labellers are made to be precise: a Beta prior says that one votes bad on
`alarm` of the good texts, and weighs as much as `trust` x the number of rows. Without it (trust 0) a labeller that alone finds a kind of bad
text would be taken to be wrong about it, since the others, which look for other kinds, vote good there.

A logistic scorer over hashed word shapes and binned rates is then fit to the posteriors of at most `most` rows, those with the least hash of their
id, one of each id (a bounded sample, for fitting alone), and scores every row.

Defined results: null and empty texts have the votes and features of an empty text; rows that repeat are scored each, counted each in the
patterns, and fitted once; rows without a doc_id are counted and scored, and not fitted; ties of hashes go to the smaller doc_id; an empty table
gives an empty result; a table with one kind of rows alone keeps the prior's view, good; very long texts are read whole; columns beyond doc_id and text
aren't looked at, and `good_rows` passes them on whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialise, table

SYMBOLS = "#*$%&|<>{}[]=\\^~"
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
LABELLERS = ("capitals", "symbols", "exclaims", "adjacent", "variety", "length", "letters")
GOOD, BAD, NONE = 1, 0, 2
DIM = 1 << 12
BINNED = 8


def rates(text: str) -> dict[str, float]:
    words = text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    return {
        "words": len(words),
        "capitals": sum(map(len, UPPER.findall(text))) / chars,
        "symbols": sum(map(text.count, SYMBOLS)) / n,
        "exclaims": (text.count("!") + text.count("?")) / n,
        "variety": len(set(words)) / n,
        "adjacent": sum(map(eq, words, islice(words, 1, None))) / n,
        "length": chars / n,
        "letters": (chars - sum(map(text.count, SYMBOLS + "0123456789!?.,:;"))) / chars,
    }


def votes(r: dict[str, float]) -> list[int]:
    """One vote per labeller. A labeller says nothing where its evidence is in between."""

    def between(good: bool, bad: bool) -> int:
        return GOOD if good else BAD if bad else NONE

    return [
        between(r["capitals"] < 0.15, r["capitals"] > 0.4),
        between(r["symbols"] < 0.08, r["symbols"] > 0.2),
        between(r["exclaims"] < 0.08, r["exclaims"] > 0.3),
        between(r["adjacent"] < 0.05, r["adjacent"] > 0.3),
        between(r["variety"] > 0.4 or r["words"] < 30, r["variety"] < 0.12 * (1 if r["words"] < 1000 else 0.5)),
        between(3.5 < r["length"] < 10, r["length"] > 16 or r["length"] < 2.5),
        between(r["letters"] > 0.93, r["letters"] < 0.8),
    ]


def pattern(v: list[int]) -> int:
    return sum(x * 3**k for k, x in enumerate(v))


class Features:
    """Hashed features of a text: shares of its words' shapes, and bins of its rates."""

    def __init__(self):
        self.shapes = _Shapes()

    def of(self, text: str, r: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        at, value = [], []
        if words:
            counts = np.bincount(np.fromiter(map(self.shapes.__getitem__, words), np.int64, len(words)), minlength=1)
            where = np.flatnonzero(counts)
            at, value = where.tolist(), np.sqrt(counts[where] / len(words)).tolist()
        for name, x in r.items():
            bin_ = int(np.clip(np.log2(x + 1e-3) * 2, -24, 40))
            at.append(BINNED + zlib.crc32(f"{name}:{bin_}".encode()) % (DIM - BINNED))
            value.append(0.5)
        at.append(0)
        value.append(1.0)
        return np.array(at), np.array(value)


class _Shapes(dict):
    """A word's shape: classes of its characters, runs as one, with its last character if that isn't a letter."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        shape = []
        for c in word:
            k = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
            if not shape or shape[-1] != k:
                shape.append(k)
        v = self[word] = BINNED + zlib.crc32("".join(shape).encode()) % (DIM - BINNED)
        return v


def priors(rows: float, alarm: float, trust: float) -> np.ndarray:
    """Pseudo-votes as [class, vote]: of the good class by its Beta prior, of the bad class one each; a hundredth keeps all above 0."""
    weight = trust * rows
    prior = np.ones((2, 2))
    prior[GOOD, BAD], prior[GOOD, GOOD] = alarm * weight + 0.01, (1 - alarm) * weight + 0.01
    return prior


def log_posterior(counts: dict[int, int], table_: np.ndarray, share: float, alarm: float = 0.001, trust: float = 1.0) -> float:
    """What expectation-maximisation climbs: the log likelihood of the votes, and the logs of the priors' densities."""
    labellers = table_.shape[1]
    total = 0.0
    for p, n in counts.items():
        votes_ = [p // 3**k % 3 for k in range(labellers)]
        both = [w * math.prod(table_[c, j, v] for j, v in enumerate(votes_) if v != NONE) for c, w in ((GOOD, share), (BAD, 1 - share))]
        total += n * math.log(sum(both))
    prior = priors(sum(counts.values()), alarm, trust)
    return total + float((prior[:, None, :] * np.log(table_)).sum()) + math.log(share) + math.log(1 - share)


def em(counts: dict[int, int], labellers: int = len(LABELLERS), rounds: int = 500, alarm: float = 0.001, trust: float = 1.0) -> tuple[dict[int, float], np.ndarray, float]:
    """(posterior of good by pattern, P(vote | class) as [class, labeller, vote], share of good rows). A labeller that says nothing says
    nothing of the class."""
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    v = np.array([[p // 3**k % 3 for k in range(labellers)] for p in patterns], dtype=int).reshape(len(patterns), labellers)
    hot = np.eye(3)[v][:, :, :2]  # pattern, labeller, vote
    good = np.where((v == BAD).sum(1) == 0, 0.9, 0.1)  # start: nothing speaks against the text
    share, table_, prior = 0.8, np.zeros((2, labellers, 2)), priors(n.sum(), alarm, trust)
    for _ in range(rounds):
        for c, weight in ((GOOD, good), (BAD, 1 - good)):
            sums = np.einsum("p,pjv->jv", n * weight, hot) + prior[c]
            table_[c] = sums / sums.sum(1, keepdims=True)
        share = float(((n * good).sum() + 1) / (n.sum() + 2))
        score = np.log(share / (1 - share)) + np.einsum("pjv,jv->p", hot, np.log(table_[GOOD] / table_[BAD]))
        new = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        moved = np.abs(new - good).max(initial=0)
        good = new
        if moved < 1e-9:
            break
    return dict(zip(patterns, good.tolist(), strict=True)), table_, share


def fit(rows: list[tuple[list[int], list[float], float]], rounds: int = 200, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights for (positions, values, target) by full-batch adaptive gradients."""
    w = np.zeros(DIM)
    if not rows:
        w[0] = 1.0
        return w
    lengths = [len(a) for a, _, _ in rows]
    at, value = np.concatenate([a for a, _, _ in rows]).astype(np.int64), np.concatenate([v for _, v, _ in rows])
    row, y = np.repeat(np.arange(len(rows)), lengths), np.array([t for *_, t in rows])
    squares = np.full(DIM, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[at], len(rows)), -30, 30)))
        g = np.bincount(at, value * (p - y)[row], DIM) / len(rows) + decay * w
        squares += g * g
        w -= rate * g / np.sqrt(squares)
    return w


def train(docs: DataFrame, most: int = 8192) -> tuple[np.ndarray, dict[int, float]]:
    """(scorer's weights, posterior by pattern). Patterns are counted over all rows."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "pattern": [pattern(votes(rates(t or ""))) for t in b["text"]]})

    voted = materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(vote, "doc_id long, pattern int"), "weak-votes")
    posterior, _, _ = em({r["pattern"]: r["count"] for r in voted.groupBy("pattern").count().collect()})
    ids = voted.where("doc_id is not null").select("doc_id").distinct()
    sample = materialise(ids.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(most), "weak-sample")

    def feature(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for b in batches:
            known = [rates(t or "") for t in b["text"]]
            both = [features.of(t or "", r) for t, r in zip(b["text"], known, strict=True)]
            yield pd.DataFrame({"at": [a for a, _ in both], "value": [v for _, v in both], "pattern": [pattern(votes(r)) for r in known]})

    # `most` ids at the most are sent to the texts; one text of each id goes on, and as many rows of at most DIM numbers come back
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text")).select("text")
    found = texts.mapInPandas(feature, "at array<int>, value array<double>, pattern int").collect()
    return fit([(r["at"], r["value"], posterior[r["pattern"]]) for r in found]), posterior


def scored(docs: DataFrame, weights: np.ndarray, posterior: dict[int, float]) -> DataFrame:
    """doc_id, posterior (by the labellers), score (by the linear scorer)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for b in batches:
            out = []
            for doc_id, t in zip(b["doc_id"], b["text"], strict=True):
                r = rates(t or "")
                at, value = features.of(t or "", r)
                out.append((doc_id, posterior.get(pattern(votes(r)), 0.5), float(1 / (1 + np.exp(-np.clip((weights[at] * value).sum(), -30, 30))))))
            yield pd.DataFrame(out, columns=["doc_id", "posterior", "score"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(of, "doc_id long, posterior double, score double")


def good_rows(docs: DataFrame, threshold: float = 0.5, most: int = 8192) -> DataFrame:
    """The rows of docs that the scorer doesn't reject, all columns as they are. Texts aren't shuffled: rows are judged where they are."""
    weights, _ = train(docs, most)
    names, text_at = docs.columns, docs.columns.index("text")

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features = Features()
        for b in batches:
            keep = []
            for t in b.column(text_at).to_pylist():
                at, value = features.of(t or "", rates(t or ""))
                keep.append(bool(1 / (1 + np.exp(-np.clip((weights[at] * value).sum(), -30, 30))) >= threshold))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.select(*names).mapInArrow(of, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, *train(docs))
    return out.select("doc_id", "posterior", "score", (F.col("score") >= threshold).alias("kept"))
