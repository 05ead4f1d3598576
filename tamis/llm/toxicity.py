"""Toxicity by a weighted grammar over clauses; its lexicon is learned from labelled rows.

Labelled rows of the training folds (at most `most` of each label, those with the least digest of their id) name the terms:
words and beginnings of words of four to seven letters. A term enters the lexicon when it stands in at least `contexts`
different pairs of neighbours among toxic rows, or in as many as `share` of them (copies of a text have the same neighbours, so that one copied text can't
name a term) and its precision is high; its weight is -ln(1 - precision). Terms are counted where the rows are, and those that enter the
lexicon come to the driver: no more than the labelled rows of the sample have. Words of the seed list stay, unless they stand in `seen` labelled rows or more
without that precision; where no label confirms them, they count in clauses with a target or predicate alone.

Neither label, language, source nor doc_id enters a score. Defined results: null and empty texts get the base score, the
smoothed share of toxic rows among training rows without a term; a null doc_id is in no fold (held_out false); without labels the
lexicon is the seed list; a label whose id several rows have counts for each of them; a lexicon doesn't depend on the order of rows, ties
included; very long texts are read whole; columns beyond doc_id and text (and toxic) aren't looked at; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grammar
from .store import materialise, table

FOLDS, HELD_OUT = 4, 2


def fold(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text and toxic of the sample. Its ids number 2 x most at the most, so that they are sent to the documents."""
    order = F.xxhash64(F.lit(7), "doc_id")
    known = labels.where("toxic is not null and doc_id is not null").where(fold() != HELD_OUT)
    sample = [known.where(F.col("toxic") == y).select("doc_id", "toxic").orderBy(order, "doc_id").limit(most) for y in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(sample[0].unionAll(sample[1])), "doc_id").select("text", "toxic")


def counted_terms(rows: DataFrame) -> DataFrame:
    """term, toxic, other (rows with it) and around (a bit for each of 64 classes of neighbour pairs, in toxic rows)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            toxic, other, around = {}, {}, {}
            for text, y in zip(b["text"], b["toxic"], strict=True):
                tokens = grammar.TOKEN.findall((text or "").lower())
                seen = {x for t in set(tokens) for x in grammar.terms(t)}
                into = toxic if y == 1 else other
                for x in seen:
                    into[x] = into.get(x, 0) + 1
                if y == 1:
                    for k, t in enumerate(tokens):
                        pair = f"{tokens[k - 1] if k else ''} {tokens[k + 1] if k + 1 < len(tokens) else ''}"
                        bit = 1 << xxhash.xxh64_intdigest(pair) % 63
                        for x in grammar.terms(t):
                            around[x] = around.get(x, 0) | bit
            keys = list(toxic.keys() | other.keys())
            yield pd.DataFrame({"term": keys, "toxic": [toxic.get(x, 0) for x in keys], "other": [other.get(x, 0) for x in keys], "around": [around.get(x, 0) for x in keys]})

    return rows.mapInPandas(of, "term string, toxic long, other long, around long")


def learn(docs: DataFrame, labels: DataFrame, most: int = 4096, contexts: int = 6, share: float = 0.01, precision: float = 0.8, seen: int = 5) -> tuple[dict[str, float], float]:
    """(lexicon, base) for grammar.Scorer."""
    rows = materialise(training_rows(docs, labels, most), "toxic-sample")
    counts = counted_terms(rows).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), F.bit_or("around").alias("around"))
    sure = F.col("toxic") / (F.col("toxic") + F.col("other") + 1)
    # among many toxic rows, a term has to stand in a share of them: of rare words, some are in toxic rows alone by chance
    toxic = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0))).first()[0]
    named = (F.bit_count("around") >= min(max(contexts, share * toxic), 40)) & (sure >= precision)
    found = counts.select("term", sure.alias("sure"), "toxic", (F.col("toxic") + F.col("other")).alias("rows"), named.alias("named")).where(F.col("named") | F.col("term").isin(*grammar.SEED_INSULTS))
    found = found.select("term", "sure", "rows", "named").collect()
    lexicon = {r["term"]: -math.log(1 - r["sure"]) for r in sorted(found) if r["named"]}
    # labelled rows overrule the seed list
    harmless = {r["term"] for r in found if r["rows"] >= seen and r["sure"] < precision}
    for word in grammar.SEED_INSULTS:
        if word not in harmless:
            lexicon.setdefault(word, grammar.Seed(-math.log(1 - precision)))

    def missed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = grammar.Scorer(lexicon, 0.0)
        for b in batches:
            yield pd.DataFrame({"toxic": [int(y) for t, y in zip(b["text"], b["toxic"], strict=True) if not scorer.mass(t or "")]})

    n = rows.mapInPandas(missed, "toxic int").agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    return lexicon, (n["toxic"] + 0.5) / (n["n"] + 20)


def score_texts(docs: DataFrame, lexicon: dict[str, float], base: float, threshold: float = 0.3) -> DataFrame:
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = grammar.Scorer(lexicon, base)
        for b in batches:
            scores = [scorer.score(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": scores, "predicted": [int(s >= threshold) for s in scores]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(of, "doc_id long, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, *learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
