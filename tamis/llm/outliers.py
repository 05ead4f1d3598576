"""Quality rules with DataFrame functions alone: base counts, then robust multivariate outliers.

Each document's rates (symbols, repeated lines, repeated windows, capitals, word length; shrunk for short texts and
transformed by a root or a logarithm) are a vector. Per language and source, a minimum-covariance-determinant estimate of
centre and scatter comes from concentration steps: the rows nearest to the present estimate, `share` of them, give the next one. Steps
begin at three deterministic estimates (medians with median deviations, medians of the half of the rows that is nearest to the medians, means with
covariances); after `trial` steps of each, a group goes on from the one of the least determinant, until no determinant falls by
more than `settled` of itself. Of all estimates on that way, the one of the least determinant stays. A step is one aggregation: moments are summed per
group, start and bin of the squared distance, and running totals over bins end at the nearest `share` of rows, with the part of the
last bin that is needed. Rows are rejected by their Mahalanobis distance.

Rows meet their group's estimate by a broadcast where there are at most BROADCAST groups, and else by a salted join. Nothing
but sums per group and bin is shuffled otherwise, so that a group may hold any part of the rows.

Defined results: a null text is empty and fails the base rule; null languages and sources are groups of their own; groups
of fewer than `least_rows` rows are pooled by language, and languages of fewer than `least_rows` such rows are pooled together;
rows that repeat are judged each and count each; equal rows have equal distances; very long texts are read whole; columns beyond doc_id, text, lang and
source aren't looked at; an empty table gives an empty result. `floor` is added to the variances, one number for all or one for each
variable. The rates of rare events are 0 in most rows of a group, whose own variance is then 0 too; their floor is the scatter of a few
events in a text, so that these don't reject the rest. Capitals and word lengths vary in every group; their floors are well
below the groups' own variances and only keep a group of equal texts from a variance of 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import WORD, materialise, table, text_or_empty

X = ("x_symbols", "x_lines", "x_repeats", "x_capitals", "x_length")
P = len(X)
#: Added to the variances of X.
FLOOR = (0.01, 0.01, 0.01, 1e-5, 1e-4)
#: Bins of squared distances in an octave.
BINS = 8
#: A table of groups is broadcast up to so many rows (of some 20 numbers); beyond, each is joined in SALTS parts.
BROADCAST = 50_000
SALTS = 64


def with_groups(rows: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    """rows with what the written table `groups` holds for their keys (null-safe), without a task for all rows of a group."""
    other = groups.select(*(F.col(k).alias(f"g_{k}") for k in keys), *(c for c in groups.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"g_{k}")) for k in keys]
    if groups.count() <= BROADCAST:
        return rows.join(F.broadcast(other), on).drop(*(f"g_{k}" for k in keys))
    rows = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    other = other.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.join(other, [*on, F.col("_salt") == F.col("_part")]).drop("_salt", "_part", *(f"g_{k}" for k in keys))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more. Windows are compared by 64-bit hashes of hashes."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[h[i + k] for k in range(5)]))

    def covered(w: Column) -> Column:
        return let(F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), spread)

    def spread(pairs: Column) -> Column:
        same = lambda x, at: F.coalesce(F.get(pairs, at)["h"] == x["h"], F.lit(False))
        again = F.filter(pairs, lambda x, i: ((i > 0) & same(x, i - 1)) | same(x, i + 1))
        return let(F.sort_array(F.transform(again, lambda x: x["i"])), union)

    def union(starts: Column) -> Column:
        new = F.transform(starts, lambda x, k: F.when(k == 0, F.lit(5)).otherwise(F.least(F.lit(5), x - F.get(starts, k - 1))))
        return F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(w: Column) -> Column:
        twice = let(F.sort_array(w), lambda s: F.exists(F.transform(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x)), lambda b: b))
        return F.when(twice, covered(w)).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) < 5, F.lit(0).cast("long")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), count))
    )


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base columns, with n_lines and n_capitals."""
    t = F.col("t")
    rows = docs.select("doc_id", "lang", "source", text_or_empty().alias("t"))
    rows = rows.select(
        "doc_id", "lang", "source",
        F.regexp_extract_all(t, F.lit(WORD), 0).alias("words"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
    )
    return rows.select(
        "doc_id", "lang", "source", "n_symbols", "n_capitals",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def vectors(counts: DataFrame, prior: float = 20.0) -> DataFrame:
    """counts with X: each rate has `prior` words (or a few lines) of nothing added to it, so that short texts aren't extreme."""
    n = F.col("n_words") + prior
    return (
        counts.withColumn("x_symbols", F.sqrt(F.col("n_symbols") / n))
        .withColumn("x_lines", F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + prior / 4)))
        .withColumn("x_repeats", F.sqrt(F.col("n_repeat_words") / n))
        .withColumn("x_capitals", F.sqrt(F.col("n_capitals") / (F.col("word_chars") + 5 * prior)))
        .withColumn("x_length", F.log((F.col("word_chars") + 5 * prior) / n))
    )


def grouped(rows: DataFrame, least_rows: int) -> DataFrame:
    """rows with g, the group whose estimate judges them."""
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = F.col("n") < least_rows
    per_lang = Window.partitionBy("lang")
    sizes = sizes.withColumn("pooled", F.sum(F.when(small, F.col("n")).otherwise(0)).over(per_lang))
    key = F.when(~small, F.to_json(F.struct(F.lit("s").alias("k"), "lang", "source")))
    key = key.when(F.col("pooled") >= least_rows, F.to_json(F.struct(F.lit("l").alias("k"), "lang"))).otherwise(F.lit("rest"))
    return with_groups(rows, materialise(sizes.select("lang", "source", key.alias("g")), "quality-groups"), "lang", "source")


def factored(centres: DataFrame, floor: float | tuple[float, ...], scale: float, *keys: str) -> DataFrame:
    """From means m_i and covariances c_ij: keys, m_i, the Cholesky factor l_ij of scale x covariance + floor, and det, the log of the
    determinant."""
    out, floors = centres, floor if isinstance(floor, tuple) else (floor,) * P
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{j}{i}") * scale + (floors[i] if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(floors[i] / 100))) if i == j else rest / F.col(f"l{j}{j}"))
    det = sum((2 * F.log(f"l{i}{i}") for i in range(1, P)), 2 * F.log("l00"))
    return out.select(*keys, *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)], det.alias("det"))


def distances(rows: DataFrame, fits: DataFrame, *keys: str) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance to the estimate of their keys (by default their group)."""
    out = with_groups(rows, fits, *(keys or ("g",)))
    for i in range(P):
        y = F.col(X[i]) - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0"))
    return out.withColumn("d2", d2).select(*rows.columns, "d2")


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
SUMS = [f"s{i}" for i in range(P)] + [f"q{i}{j}" for i, j in PAIRS]


def summed() -> list[Column]:
    return [F.sum(X[i]).alias(f"s{i}") for i in range(P)] + [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}{j}") for i, j in PAIRS]


def moments(sums: DataFrame, *keys: str) -> DataFrame:
    """keys, means and covariances from n and the sums."""
    means = [(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)]
    return sums.select(*keys, *means, *[(F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") / F.col("n")).alias(f"c{i}{j}") for i, j in PAIRS])


def concentrate(rows: DataFrame, fits: DataFrame, share: float, *keys: str) -> DataFrame:
    """Means and covariances of the rows with the smallest distances, `share` of each of the keys' groups. Of the bin of distances
    in which they end, all rows count by the part that is needed."""
    bins = distances(rows, fits, *keys).withColumn("bin", F.floor(BINS * F.log2(F.col("d2") + 2.0**-20)).cast("int"))
    totals = bins.groupBy(*keys, "bin").agg(F.count("*").cast("double").alias("n"), *summed())
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    run = totals.select(*keys, "n", *SUMS, (share * F.sum("n").over(Window.partitionBy(*keys))).alias("h"), F.coalesce(F.sum("n").over(upto), F.lit(0.0)).alias("before"))
    part = F.greatest(F.least((F.col("h") - F.col("before")) / F.col("n"), F.lit(1.0)), F.lit(0.0))
    return moments(run.groupBy(*keys).agg(*[F.sum(F.col(c) * part).alias(c) for c in ("n", *SUMS)]), *keys)


def chi2_cdf(x: float, k: int) -> float:
    a, z = k / 2, x / 2
    term = total = 1 / a
    for n in range(1, 500):
        term *= z / (a + n)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 1e-9, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return low


def starts(rows: DataFrame, floor: float | tuple[float, ...]) -> DataFrame:
    """g, start and the three first estimates of each group."""
    diagonal = lambda d: [(d(i) * d(i) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    middle = materialise(rows.groupBy("g").agg(*[F.percentile_approx(x, 0.5).alias(f"m{i}") for i, x in enumerate(X)]), "mcd-median")
    off = with_groups(rows, middle, "g").groupBy("g").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(P)],
        *[(F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5) * 1.4826).alias(f"d{i}") for i, x in enumerate(X)],
    )
    means = [f"m{i}" for i in range(P)]
    medians = off.select("g", *means, *diagonal(lambda i: F.col(f"d{i}")))
    robust = materialise(factored(medians, floor, 1.0, "g"), "mcd-robust")
    near = concentrate(rows, robust, 0.5, "g")
    plain = moments(rows.groupBy("g").agg(F.count("*").cast("double").alias("n"), *summed()), "g")
    every = [x.select("g", F.lit(k).alias("start"), *means, *[f"c{i}{j}" for i, j in PAIRS]) for k, x in enumerate((medians, near, plain))]
    return every[0].unionAll(every[1]).unionAll(every[2])


def least(fits: DataFrame) -> DataFrame:
    """For each group, its estimate of the least determinant."""
    own = [c for c in fits.columns if c not in ("g", "start")]
    return fits.groupBy("g").agg(F.min_by(F.struct(*own), F.col("det")).alias("f")).select("g", "f.*")


def mcd(rows: DataFrame, share: float = 0.75, steps: int = 12, floor: float | tuple[float, ...] = FLOOR, trial: int = 2, settled: float = 1e-3) -> DataFrame:
    """The groups' estimates, one row for each g."""
    # nearest rows vary less than all; this is what makes the scatter that of a normal group
    consistent = share / chi2_cdf(chi2_quantile(share, P), P + 2)
    fits = materialise(factored(starts(rows, floor), floor, 1.0, "g", "start"), "mcd-start")
    every = rows.withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    for _ in range(min(trial, steps)):
        fits = materialise(factored(concentrate(every, fits, share, "g", "start"), floor, consistent, "g", "start"), "mcd-trial")
    best = materialise(least(fits), "mcd-step")
    for _ in range(steps - trial):
        new = materialise(factored(concentrate(rows, best, share, "g"), floor, consistent, "g"), "mcd-next")
        both = materialise(least(best.unionByName(new)), "mcd-step")
        fell = both.select("g", "det").join(best.select("g", F.col("det").alias("was")), "g").where(F.col("was") - F.col("det") > settled)
        best = both
        if fell.isEmpty():
            break
    return best


def quality_rules(docs: DataFrame, least_rows: int = 200, share: float = 0.75, steps: int = 12, tail: float = 1e-3, floor: float | tuple[float, ...] = FLOOR) -> DataFrame:
    """doc_id, the base columns, base_failed, d2 (to the group's estimate) and kept: not failed, and d2 within the chi-square tail."""
    counts = materialise(base_counts(docs), "quality-counts")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = vectors(counts).withColumn("base_failed", failed)
    rows = materialise(grouped(rows, least_rows), "quality-vectors")
    fits = mcd(rows.select("g", *X), share, steps, floor)
    kept = ~F.col("base_failed") & (F.col("d2") <= chi2_quantile(1 - tail, P))
    return distances(rows, fits).withColumn("kept", kept)


def op10_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("d2", 3).alias("distance2"))
