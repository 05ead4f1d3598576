"""Evaluation of scans against what is known of their documents, and of verdicts."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import norm

OUTCOMES = ("PASS", "DETECTOR-MISS", "EXTRACTION-LIMITED", "VALUE-MISMATCH", "CATEGORY-MISMATCH", "UNSCORED")


def multiset_difference(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """keys, missing (expected more often than found) and unexpected (found more often); equal rows are left out."""
    count = lambda df, sign: df.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, (F.col("n") * sign).alias("n"))
    both = count(expected, 1).unionByName(count(actual, -1)).groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")
    return both.select(*keys, F.greatest("n", F.lit(0)).alias("missing"), F.greatest(-F.col("n"), F.lit(0)).alias("unexpected"))


def greedy(wanted: list[str], found: list[str]) -> list[int | None]:
    """For each wanted value, the first found one, not yet given away, that holds it or is held by it."""
    free, out = list(range(len(found))), []
    for w in wanted:
        hit = next((k for k in free if w and found[k] and (w in found[k] or found[k] in w)), None)
        if hit is not None:
            free.remove(hit)
        out.append(hit)
    return out


def matched(expected: DataFrame, actual: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, hits, missed, extra: values of each document matched one to one, by overlap. A document's values are one group."""

    def of(key: tuple, want: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        hits = sum(k is not None for k in greedy(list(want["v"]), list(got["v"])))
        return pd.DataFrame({"id": [str(key[0])], "hits": [hits], "missed": [len(want) - hits], "extra": [len(got) - hits]})

    side = lambda df: df.select(F.col(id_column).cast("string").alias("id"), norm(F.col("value")).alias("v"))
    return side(expected).groupBy("id").cogroup(side(actual).groupBy("id")).applyInPandas(of, "id string, hits long, missed long, extra long")


def by_jurisdiction(rows: DataFrame) -> DataFrame:
    """doc_type, jurisdiction, total and a column for each outcome, of the positive licences and health cards."""
    own = rows.where("verdict = 'POSITIVE' and doc_type in ('drivers_licence', 'health_card')")
    return own.groupBy("doc_type", "jurisdiction").agg(F.count("*").alias("total"), *[F.count_if(F.col("outcome") == o).alias(o.lower().replace("-", "_")) for o in OUTCOMES])


def demotions(verified: DataFrame) -> DataFrame:
    """category, source, routed, demoted and kept (asked about and not lowered) of findings with verdicts."""
    asked = verified.where("routed")
    down = F.count_if(F.col("original_risk_level").isNotNull())
    return asked.groupBy("category", "source").agg(F.count("*").alias("routed"), down.alias("demoted"), (F.count("*") - down).alias("kept"))


