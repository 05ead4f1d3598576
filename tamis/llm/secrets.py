"""Incremental blob ledger for secret scans.

Every version of a file or document is addressed by the SHA-256 of its content. A pair of a blob and a rule's version is scanned once:
the ledger has a row for each blob of a scan, with the rules of that scan, their versions, and the findings. A rule's version is a digest of the
rule, so that changing one rule makes all blobs unseen for that rule alone.

A scan works on narrow rows first: blobs, one of the rows that hold each of them, and what the ledger knows. Texts are then scanned where they
are read, those of the chosen rows alone (the sieve lets a few others pass, whose findings are the same), and findings are
joined back to all paths that hold the blob. No text is shuffled.

Defined results: a null content is an empty one; repeated rows get a row each; an empty table gives an empty result and
appends nothing; very long texts are scanned whole; ties can't occur, since spans of a text are ordered by start and then kind. Input columns
named blob_id or spans give way to the operator's; all others pass through. Files are appended to a ledger by one Spark write, so that a scan that
fails midway leaves whole rows or none; a pair that two scans appended counts once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sieve import sieved
from .store import materialise, new_path, table

#: Kinds in their order; (pattern, number of the group whose length counts, least length).
RULES: dict[str, tuple[str, int, int]] = {
    "assign": (r"(?a:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
    "github": (r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
    "google": (r"AIza[A-Za-z0-9_-]+", 0, 39),
}
BASE = ("assign", "access", "hex")
#: A text without any of a kind's strings (in lower case) has no match of it.
HINTS = {"assign": ("passw", "secret", "token", "apikey", "api_key"), "access": ("akia",), "github": ("gh",), "slack": ("xox",), "jwt": ("eyj",), "pem": ("-----begin ",), "google": ("aiza",)}
SPAN = "struct<kind:string,start:long,end:long>"
LEDGER = f"blob_id binary, rules map<string,string>, spans array<{SPAN}>"
#: Parts of the rows that hold one blob, when findings are joined back.
SALTS = 8


def rule_versions(rules=None) -> dict[str, str]:
    return {kind: hashlib.sha256(json.dumps(rule).encode()).hexdigest()[:16] for kind, rule in (rules or RULES).items()}


def scanner(rules=None):
    """A function from a text to its spans (kind, start, end), by start and then kind as listed."""
    rules = rules or RULES
    compiled = []
    for k, (kind, (pattern, group, least)) in enumerate(rules.items()):
        if pattern == RULES["hex"][0]:
            pattern = f"[0-9a-f]{{{least},}}"  # runs are maximal, so that shorter ones needn't be visited
        compiled.append((k, kind, re.compile(pattern), group, least, HINTS.get(kind) if rules.get(kind) == RULES.get(kind) else None))

    def scan(text: str) -> list[tuple[str, int, int]]:
        low, found = text.lower(), []
        for k, kind, pattern, group, least, hints in compiled:
            if hints is None or any(h in low for h in hints):
                found += [(m.start(), k, kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        return [(kind, start, end) for start, _, kind, end in sorted(found)]

    return scan


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(ledger)


def pairs(spark: SparkSession, ledger: str) -> DataFrame:
    """blob_id, rule, rule_version: the pairs that have been scanned."""
    return read_ledger(spark, ledger).select("blob_id", F.explode("rules").alias("rule", "rule_version")).distinct()


def found_in(spark: SparkSession, ledger: str, versions: dict[str, str]) -> DataFrame:
    """blob_id, spans: findings of the rules in these versions, by start and then kind; blobs without any have no row."""
    kinds = list(versions)
    current = F.create_map(*[F.lit(x) for kv in versions.items() for x in kv])
    now = F.filter("spans", lambda s: F.col("rules")[s["kind"]] == current[s["kind"]])
    rows = read_ledger(spark, ledger).where("size(spans) > 0").select("blob_id", now.alias("spans")).where("size(spans) > 0")
    order = F.array(*[F.lit(k) for k in kinds])
    keyed = lambda s: F.struct(s["start"], F.array_position(order, s["kind"]).alias("k"), s.alias("s"))
    every = F.array_distinct(F.flatten(F.collect_list("spans")))
    return rows.groupBy("blob_id").agg(F.transform(F.array_sort(F.transform(every, keyed)), lambda x: x["s"]).alias("spans"))


def scan_new(held: DataFrame, contents: DataFrame, ledger: str, rules=None) -> None:
    """Scans the pairs that the ledger doesn't have, and appends them. held: blob_id and mark of all rows (a written table); contents:
    the same with the text as `content`."""
    spark, rules = held.sparkSession, rules or RULES
    versions = rule_versions(rules)
    every = (1 << len(versions)) - 1
    bits = [F.when(F.col("rules")[kind] == version, F.lit(1 << k)).otherwise(0) for k, (kind, version) in enumerate(versions.items())]
    chosen = held.groupBy("blob_id").agg(F.min("mark").alias("mark"))
    known = read_ledger(spark, ledger)
    if not known.isEmpty():
        seen = known.select("blob_id", sum(bits[1:], bits[0]).alias("bits")).groupBy("blob_id").agg(F.bit_or("bits").alias("seen"))
        chosen = chosen.join(seen, "blob_id", "left").withColumn("unseen", F.lit(every).bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0))))).where("unseen <> 0").drop("seen")
    else:
        chosen = chosen.withColumn("unseen", F.lit(every))
    chosen = materialise(chosen, "secret-unseen")
    # blobs that lack the same rules are scanned together; rules are few, so that these sets are
    for row in chosen.select("unseen").distinct().collect():
        lacking = {kind: rule for k, (kind, rule) in enumerate(rules.items()) if row["unseen"] >> k & 1}
        texts = sieved(contents, "mark", chosen.where(F.col("unseen") == row["unseen"]), "mark").select("blob_id", "content")

        def of(batches: Iterator[pd.DataFrame], lacking=lacking) -> Iterator[pd.DataFrame]:
            scan = scanner(lacking)
            for b in batches:
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] for t in b["content"]]
                yield pd.DataFrame({"blob_id": b["blob_id"], "spans": spans})

        scanned = texts.mapInPandas(of, f"blob_id binary, spans array<{SPAN}>").groupBy("blob_id").agg(F.any_value("spans").alias("spans"))
        named = F.create_map(*[F.lit(x) for kind in lacking for x in (kind, versions[kind])])
        scanned.select("blob_id", named.alias("rules"), "spans").write.mode("append").parquet(ledger)


def scan_secrets(versions: DataFrame, ledger: str, rules=None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `versions` without the text, with blob_id and spans: findings of a blob come to all its paths.

    key, if there is such a column, tells the rows that hold a blob apart, so that one of them is scanned. Narrow rows
    meet findings in SALTS parts, so that no task has all rows of a blob that a third of them hold."""
    spark = versions.sparkSession
    keys = [key] if key in versions.columns else []
    marked = versions.withColumn("blob_id", blob_id(F.col(text))).withColumn("__mark", F.xxhash64("blob_id", *keys))
    others = [c for c in versions.columns if c not in (text, "blob_id", "spans")]
    paths = materialise(marked.select(*others, "blob_id", "__mark"), "secret-paths")
    contents = marked.select("blob_id", F.col("__mark").alias("mark"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    scan_new(paths.select("blob_id", F.col("__mark").alias("mark")), contents, ledger, rules)
    found = materialise(found_in(spark, ledger, rule_versions(rules)), "secret-found")
    paths = paths.drop("__mark")
    salted = found.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    parted = paths.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    return parted.join(salted, ["blob_id", "__part"], "left").select(*others, "blob_id", F.coalesce("spans", F.expr(f"cast(array() as array<{SPAN}>)")).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs, new_path(spark, "secret-ledger"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.lower(F.hex("blob_id")).alias("blob_id"))
