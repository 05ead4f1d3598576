"""Findings: detection, merging, conflicts, taxonomy, scores and summaries as DataFrame operators.

A document's findings stay together as one array up to its score, so that merging, the six conflict rules and scoring need no
shuffle. `explode_findings` makes the table of findings from it.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.spans import norm
from . import context_layers as ctx
from . import native_layers as native
from . import ner_layer, zones

EXTRA = "struct<format:string,issuing_state:string,doc_type:string,original_ocr:string,substitutions:array<struct<position:int,original:string,recovered:string>>>"
FINDING = f"struct<raw_type:string,value:string,confidence:double,source:string,layer_ord:int,pos:int,extra:{EXTRA}>"
FINDINGS = f"array<{FINDING}>"
CLASSIFIED = f"array<{FINDING[:-1]},category:string,risk_level:string>>"
CONTEXT_LAYERS = ("regex", "keyword_context", "health_card", "ocr_recovery", "drivers_license", "mrz")
ORDER = {name: i for i, name in enumerate(dims.LAYERS)}


def context_udf(layers: frozenset[str], as_of: date | None, failing: frozenset[str], gates: zones.Gates | None = None):
    """One Arrow pass over the texts for all layers that read in sequence."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ends, found, failed_ends, failed = [0], [], [0], []
            for t in texts.to_pylist():
                some, bad = ctx.detect(t, layers, as_of, failing, gates)
                found += some
                ends.append(len(found))
                failed += bad
                failed_ends.append(len(failed))
            yield pa.StructArray.from_arrays([_nested(ends, found), pa.ListArray.from_arrays(pa.array(failed_ends, pa.int32()), pa.array(failed, pa.string()))], ["found", "failed"])

    return F.arrow_udf(run, f"found {FINDINGS}, failed array<string>")


EXTRAS = ("format", "issuing_state", "doc_type", "original_ocr", "substitutions")
_SUBSTITUTIONS = pa.list_(pa.struct([("position", pa.int32()), ("original", pa.string()), ("recovered", pa.string())]))


def _nested(ends: list[int], found: list[tuple]) -> pa.ListArray:
    """Lists of findings as Arrow columns; the k-th list is found[ends[k] : ends[k + 1]]."""
    layers, kinds, values, confidences, extras = zip(*found, strict=True) if found else ((), (), (), (), ())
    first = [a for a, b in pairwise(ends) for _ in range(a, b)]
    extra = pa.StructArray.from_arrays([pa.array([x.get(k) for x in extras], _SUBSTITUTIONS if k == "substitutions" else pa.string()) for k in EXTRAS], list(EXTRAS))
    columns = {
        "raw_type": pa.array(kinds, pa.string()),
        "value": pa.array(values, pa.string()),
        "confidence": pa.array(confidences, pa.float64()),
        "source": pa.array(layers, pa.string()),
        "layer_ord": pa.array([ORDER[x] for x in layers], pa.int32()),
        "pos": pa.array([1000 + i - a for i, a in enumerate(first)], pa.int32()),
        "extra": extra,
    }
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


#: What the sequential layers can't do without: digits with nothing but separators between them, look-alikes of digits, an
#: address, a postal code, or a filler (of any width).
WORTH = r"\p{Nd}[-\s./()]*\p{Nd}|[0-9OIlSBoisb]{9}|@|[A-Za-z]\p{Nd}[A-Za-z]|[<\uFF1C\uFE64]"


def tagged(found: Column, source: str) -> Column:
    """Raw findings of a native layer, in the common shape."""
    return F.transform(
        found,
        lambda x, i: F.struct(x["raw_type"].alias("raw_type"), x["value"].alias("value"), x["confidence"].alias("confidence"), F.lit(source).alias("source"), F.lit(ORDER[source]).alias("layer_ord"), i.alias("pos"), F.lit(None).cast(EXTRA).alias("extra")),
    )


def _nothing() -> Column:
    return F.expr(f"cast(array() as {FINDINGS})")


def selected(layers) -> frozenset[str]:
    chosen = frozenset(layers if layers is not None else dims.LAYERS) & frozenset(dims.LAYERS)
    return chosen


def detect(docs: DataFrame, layers=None, as_of: date | None = None, ner=None, failing=(), text: str = "text", gates: zones.Gates | None = None) -> DataFrame:
    """docs with `raw` (all layers' findings) and `failed_layers`. A layer that isn't selected isn't in the plan.

    ner(text column) -> array of (raw_type, value, confidence) is the optional semantic layer; without one, selecting it fails that
    layer. Files whose `ext` says that they hold data or code aren't given to it. gates: what machine-readable zones need; by default
    an issuer that is a country's or one of the other known ones."""
    chosen, t = selected(layers), F.coalesce(F.col(text), F.lit(""))
    parts, failed = [], []
    if "regex" in chosen:
        parts.append(tagged(native.regex_native(t), "regex"))
    for name, layer in native.NATIVE.items():
        if name in chosen:
            parts.append(tagged(layer(t), name))
    if "gliner" in chosen:
        if ner is None:
            failed.append("gliner")
        else:
            found = tagged(ner(F.substring(t, 1, ner_layer.MOST)), "gliner")
            parts.append(F.when(F.lower("ext").isin(*ner_layer.NOT_PROSE), _nothing()).otherwise(found) if "ext" in docs.columns else found)
    sequential = chosen & frozenset(CONTEXT_LAYERS)
    out = docs
    if sequential:
        if "mrz" in sequential and gates is None:
            gates = zones.Gates(states=dims.issuers(docs.sparkSession))
        out = out.withColumn("__context", F.when(t.rlike(WORTH) | F.lit(bool(failing)), context_udf(sequential, as_of, frozenset(failing), gates)(t)))
        parts.append(F.coalesce(F.col("__context.found"), _nothing()))
    raw = F.concat(*parts) if parts else _nothing()
    bad = F.array(*[F.lit(x) for x in failed]).cast("array<string>")
    if sequential:
        bad = F.concat(bad, F.coalesce(F.col("__context.failed"), F.expr("cast(array() as array<string>)")))
    return out.withColumn("raw", raw).withColumn("failed_layers", bad).drop("__context")


def deduplicated(found: Column) -> Column:
    """One finding per type and value without case: the highest confidence, then priority, then the earlier one.

    The array is sorted by that order within its keys; the first of each key stays."""
    priority = dims.literal_map(dims.LAYERS)
    keyed = F.transform(found, lambda x: F.struct(x["raw_type"].alias("t"), norm(x["value"]).alias("n"), (-x["confidence"]).alias("c"), (-priority[x["source"]]).alias("p"), x["layer_ord"].alias("l"), x["pos"].alias("i"), x.alias("x")))
    # layer and place differ for any two, so that what stands behind them is never compared
    ordered = F.transform(F.array(F.array_sort(keyed)), lambda z: F.filter(z, lambda x, i: (i == 0) | ~((F.get(z, i - 1)["t"] == x["t"]) & (F.get(z, i - 1)["n"] == x["n"]))))[0]
    return F.transform(F.array_sort(F.transform(ordered, lambda x: F.struct(x["l"], x["i"], x["x"]))), lambda x: x["x"])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"(?U)\D", "")


def _upper_alnum(v: Column) -> Column:
    return F.regexp_replace(F.upper(v), r"[^\p{L}\p{N}]", "")


#: The conflict rules in order: (types that lose, types that win, what their values are compared by). Types by prefix.
RULES = (
    ("R1", lambda t: t == "date", lambda t: t == "dob", norm),
    ("R2", lambda t: t == "phone", lambda t: t.startswith("health_card"), _digits),
    ("R3", lambda t: t == "passport_generic", lambda t: t == "sin", _digits),
    ("R4", lambda t: t == "health_card_nb", lambda t: t.isin("sin", "sin_unverified"), _digits),
    ("R5", lambda t: t.isin("passport_ca", "passport_generic"), lambda t: t == "mrz_document_number", _upper_alnum),
    ("R6", lambda t: t.startswith("drivers_license"), lambda t: t.startswith("sin") | t.startswith("credit_card") | t.startswith("health_card") | t.startswith("phone") | t.startswith("passport"), _digits),
)


def reconciled(found: Column, rules=RULES) -> Column:
    """found without the findings that a rule gives to another type, one rule after the other."""
    def applied(loses, wins, key):
        def apply(arr: Column) -> Column:
            taken = F.filter(F.transform(F.filter(arr, lambda x: wins(x["raw_type"])), lambda x: key(x["value"])), lambda k: k != "")
            return F.transform(F.array(taken), lambda k: F.filter(arr, lambda x: ~(loses(x["raw_type"]) & F.array_contains(k, key(x["value"])))))[0]

        return apply

    out = found
    for _, loses, wins, key in rules:
        out = F.transform(F.array(out), applied(loses, wins, key))[0]
    return out


def classified(found: Column) -> Column:
    """found with category and risk_level."""
    return F.transform(found, lambda x: x.withField("category", dims.category(x["raw_type"])).withField("risk_level", dims.risk(dims.category(x["raw_type"]))))


def merge(detected: DataFrame, rules=RULES) -> DataFrame:
    """`findings` from `raw`: deduplicated, reconciled, of at least the least confidence, classified."""
    several = F.when(F.size("raw") > 1, reconciled(deduplicated(F.col("raw")), rules)).otherwise(F.col("raw"))
    kept = classified(F.filter(several, lambda x: x["confidence"] >= dims.MIN_CONFIDENCE))
    return detected.withColumn("findings", F.when(F.size("raw") > 0, kept).otherwise(F.expr(f"cast(array() as {CLASSIFIED})"))).drop("raw")


def score(found: Column) -> Column:
    """0 to 100: the band of the worst risk, its floor and increments by confidence, in decimals, so that order can't matter."""
    by = {band: dims.literal_map(r) for band, r in dims.INCREMENTS.items()}
    has = lambda risk: F.exists(found, lambda x: x["risk_level"] == risk)
    confidence = lambda x: F.least(F.greatest(F.coalesce(x["confidence"], F.lit(dims.DEFAULT_CONFIDENCE)), F.lit(0.0)), F.lit(1.0)).cast("decimal(8,6)")
    zero = F.lit(0).cast("decimal(20,6)")
    add = lambda a, x: (a + x).cast("decimal(20,6)")
    dates = F.aggregate(F.filter(found, lambda x: x["category"] == "entity.date"), zero, lambda a, x: add(a, F.lit(dims.DATE_INCREMENT).cast("decimal(4,2)") * confidence(x)))

    def banded(band: str) -> Column:
        low, high = dims.BANDS[band]
        rest = F.filter(found, lambda x: x["category"] != "entity.date")
        more = F.aggregate(rest, zero, lambda a, x: add(a, F.coalesce(by[band][x["risk_level"]], F.lit(0.0)).cast("decimal(6,2)") * confidence(x)))
        total = F.floor(F.lit(low).cast("decimal(20,6)") + more + F.least(dates, F.lit(dims.DATE_CAP).cast("decimal(20,6)")))
        return F.greatest(F.least(total, F.lit(high)), F.lit(low)).cast("int")

    return F.when(F.size(found) == 0, 0).when(has("HIGH"), banded("HIGH")).when(has("MEDIUM"), banded("MEDIUM")).otherwise(banded("LOW"))


def band(value: Column) -> Column:
    return F.when(value.isNull(), "UNKNOWN").when(value >= 70, "HIGH").when(value >= 30, "MEDIUM").when(value > 0, "LOW").otherwise("NONE")


RANK = {"HIGH": 3, "MEDIUM": 2, "LOW": 1, "UNKNOWN": 0}


def file_scores(results: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, score, band, n_findings, top_category, top_value (cut at 40)."""
    rank = dims.literal_map(RANK)
    top = F.element_at(F.array_sort(F.transform("findings", lambda x, i: F.struct((-rank[x["risk_level"]]).alias("r"), (-x["confidence"]).alias("c"), i.alias("i"), x["category"].alias("category"), x["value"].alias("value")))), 1)
    s = score(F.col("findings"))
    status = F.col("scan_status") if "scan_status" in results.columns else F.lit("scanned")
    return results.select(id_column, F.when(status == "scanned", s).alias("score"), F.size("findings").alias("n_findings"), F.when(F.size("findings") > 0, top).alias("top"), status.alias("scan_status")).select(
        id_column, "score", band(F.col("score")).alias("band"), "n_findings", F.col("top.category").alias("top_category"), F.substring("top.value", 1, 40).alias("top_value"), "scan_status"
    )


def exploded(df: DataFrame, found: Column, *keep: str) -> DataFrame:
    """keep columns and f, a row for each element of found. The optimiser would put a filter on the array below a plain explode, and
    compute the array, Python pass included, twice for it; the outer form has none."""
    return df.select(*keep, F.explode_outer(found).alias("f")).where("f is not null")


def explode_findings(results: DataFrame, id_column: str = "doc_id") -> DataFrame:
    return exploded(results, F.col("findings"), id_column).select(id_column, "f.*").withColumn("norm_value", norm(F.col("value")))


def with_metadata(results: DataFrame, layers=None) -> DataFrame:
    """results with the record of how each document was scanned."""
    chosen = selected(layers)

    def of(name: str) -> Column:
        return F.size(F.filter("findings", lambda x: x["source"] == name))

    counts = F.map_from_arrays(F.array(*[F.lit(x) for x in dims.LAYERS]), F.array(*[of(name) for name in dims.LAYERS]))
    return (
        results.withColumn("layers_used", F.array_except(F.array(*[F.lit(x) for x in dims.LAYERS if x in chosen]).cast("array<string>"), F.col("failed_layers")))
        .withColumn("disabled_layers", F.array(*[F.lit(x) for x in dims.LAYERS if x not in chosen]).cast("array<string>"))
        .withColumn("detection_degraded", F.size("failed_layers") > 0)
        .withColumn("total_detections", F.size("findings"))
        .withColumn("high_confidence", F.size(F.filter("findings", lambda x: x["confidence"] >= 0.85)))
        .withColumn("sources", counts)
    )


def source_counts(findings: DataFrame) -> DataFrame:
    """source, n: all layers, zeros included."""
    all_ = findings.sparkSession.createDataFrame([(x,) for x in dims.LAYERS], "source string")
    return all_.join(findings.groupBy("source").agg(F.count("*").alias("n")), "source", "left").select("source", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def scan_summary(scores: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    risk = lambda b: F.count_if((F.col("scan_status") == "scanned") & (F.col("band") == b))
    out = scores.agg(
        F.count_if(F.col("scan_status") == "scanned").alias("scanned"),
        F.count_if(F.col("scan_status") == "extraction_failed").alias("failed"),
        risk("HIGH").alias("high"), risk("MEDIUM").alias("medium"), risk("LOW").alias("low"), risk("NONE").alias("no_pii"),
    )
    n = skipped.agg(F.coalesce(F.sum(F.coalesce("count", F.lit(1))), F.lit(0)).alias("skipped")) if skipped is not None else None
    return out.join(F.broadcast(n)) if n is not None else out.withColumn("skipped", F.lit(0).cast("long"))


def top_files(scores: DataFrame, n: int = 10, id_column: str = "doc_id") -> DataFrame:
    return scores.where("scan_status = 'scanned'").orderBy(F.desc("score"), id_column).limit(n)


def compare_runs(before: DataFrame, after: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Files of both runs whose band changed. Runs are merged, whatever their estimated size: it follows bytes of compressed input, so that
    millions of rows pass for a table that can be broadcast, which the driver can't hold."""
    a, b = before.select(id_column, F.col("band").alias("before_band")), after.select(id_column, F.col("band").alias("after_band"))
    return a.hint("merge").join(b.hint("merge"), id_column).where("before_band <> after_band")


def evaluate(expected: DataFrame, actual: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Precision, recall and F1 per bucket and together ('all'), by multiset matching on the keys."""
    n = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias(c))
    both = n(expected, "want").join(n(actual, "got"), keys, "full").select(*keys, F.coalesce("want", F.lit(0)).alias("want"), F.coalesce("got", F.lit(0)).alias("got"))
    both = both.withColumn("hit", F.least("want", "got"))
    sums = both.rollup(bucket).agg(F.grouping(bucket).alias("g"), *[F.sum(c).alias(c) for c in ("want", "got", "hit")])
    p, r = F.try_divide("hit", "got"), F.try_divide("hit", "want")
    return sums.select(F.when(F.col("g") == 1, "all").otherwise(F.col(bucket)).alias("bucket"), "want", "got", "hit", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))
