"""One query per operator family, with the SQL that gives the same rows.

Detectors that the documents have no hits for read texts made from keys of the star tables; TEXTS has them as SQL that
Spark and DuckDB read alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dims
from .functions.masks import mask_value
from .operators import alarm, verify
from .operators import findings as fd
from .operators import native_layers as nl
from .plans.scan import scan_documents
from .sources.extract import html_text
from .sources.files import split_files

AS_OF = date(2026, 8, 6)
_NINE = "cast(100000000 + (o_orderkey * 7919) % 899999999 as string)"
_TEN = "cast(9000000000 + (o_orderkey * 104729) % 999999999 as string)"
_SEVEN = "lpad(cast(o_orderkey % 10000000 as string), 7, '0')"
#: The check digit of AC and seven digits by weights 7, 3, 1, a wrong one for every third order.
_CHECK = "cast((106 + case when o_orderkey % 3 = 0 then 1 else 0 end + " + " + ".join(f"{w} * cast(substr({_SEVEN}, {i}, 1) as int)" for i, w in zip(range(1, 8), (1, 7, 3, 1, 7, 3, 1), strict=True)) + ") % 10 as string)"
_MD5 = "md5(cast(o_orderkey as string))"
#: Credentials: type, text, value.
SECRETS = (
    ("aws_access_key", f"concat('key AKIA', upper(substr({_MD5}, 1, 16)), ' here')", f"concat('AKIA', upper(substr({_MD5}, 1, 16)))"),
    ("aws_secret_key", f"concat('aws secret access key = ', {_MD5}, '12345678')", f"concat({_MD5}, '12345678')"),
    ("github_token", f"concat('ghp_', {_MD5}, 'abcd;')", f"concat('ghp_', {_MD5}, 'abcd')"),
    ("google_api_key", f"concat('x AIza', {_MD5}, 'abc.')", f"concat('AIza', {_MD5}, 'abc')"),
    ("stripe_key", f"concat('sk_live_', {_MD5})", f"concat('sk_live_', {_MD5})"),
    ("slack_token", f"concat('xoxb-', {_MD5}, ' is')", f"concat('xoxb-', {_MD5})"),
    ("private_key", "'-----BEGIN RSA PRIVATE KEY----- and so on'", "'-----BEGIN RSA PRIVATE KEY-----'"),
    ("jwt", f"concat('eyJ', {_MD5}, '.eyJ', {_MD5}, '.', {_MD5}, ' end')", f"concat('eyJ', {_MD5}, '.eyJ', {_MD5}, '.', {_MD5})"),
    ("access_token", f"concat('access_token: \"', {_MD5}, '\"')", _MD5),
    ("api_key", f"concat('api-key = \"', {_MD5}, '\"')", _MD5),
    ("secret", f"concat('client_secret = \"', {_MD5}, '\"')", _MD5),
    ("password", f"concat('password = \"', {_MD5}, '\"')", _MD5),
    ("uri_password", f"concat('db://user:', {_MD5}, '@host')", _MD5),
)
TEXTS = {
    "sin": f"concat('Employee SIN: ', {_NINE}, ' is on file')",
    "sin_bare": f"concat('Reference ', {_NINE}, ' was received')",
    "ssn": f"concat('SSN ', substr({_NINE}, 1, 3), '-', substr({_NINE}, 4, 2), '-', substr({_NINE}, 6, 4), ' of the applicant')",
    "card": "concat('Pay by visa ', cast(4000000000000000 + (o_orderkey * 104729) % 999999999999 as string), ' today')",
    "dates": "concat('Ordered ', cast(o_orderdate as string), ' and shipped 7/', cast(1 + o_orderkey % 12 as string), '/1998')",
    "passport": "concat(case when o_orderkey % 2 = 0 then 'Passport ' else 'Parcel ' end, 'AB', cast(100000 + o_orderkey % 899999 as string), ' was shown')",
    "uci": "concat(case when o_orderkey % 3 = 0 then 'UCI: ' else 'Ref: ' end, cast(10 + o_orderkey % 89 as string), '-', cast(1000 + o_orderkey % 8999 as string), '-', cast(1000 + (o_orderkey * 7) % 8999 as string), ' given')",
    "status": f"concat(case when o_orderkey % 2 = 0 then 'status card ' else 'parcel no ' end, {_TEN}, ' shown')",
    "health": f"concat('Patient PHN ', {_TEN}, ' on file')",
    "licence": "concat(case when o_orderkey % 2 = 0 then 'Ontario driver''s licence ' else 'Ontario parcel ' end, 'A', cast(1000 + o_orderkey % 8999 as string), '-', cast(10000 + o_orderkey % 89999 as string), '-01231 held')",
    "postal": "concat('Postal code T', cast(o_orderkey % 10 as string), 'X 1V', cast((o_orderkey * 3) % 10 as string), ' given')",
    "dob": "concat('DOB: ', cast(o_orderdate as string), ' of the applicant')",
    "both": f"concat('SIN and passport no: ', {_NINE})",
    "r2": f"concat('PHN ', {_TEN}, ' call ', substr({_TEN}, 1, 3), '-', substr({_TEN}, 4, 3), '-', substr({_TEN}, 7, 4))",
    "r4": f"concat('SIN and New Brunswick no ', substr({_NINE}, 1, 3), ' ', substr({_NINE}, 4, 3), ' ', substr({_NINE}, 7, 3))",
    "r6": f"concat('Alberta driver''s licence and health card ', {_NINE})",
    "bare": f"concat(case when o_orderkey % 2 = 0 then 'Phone: ' else 'Parcel ' end, {_TEN})",
    "mrz": f"concat('P<CANSAMPLE<<SYNTHETIC', repeat('<', 22), chr(10), 'AC', {_SEVEN}, {_CHECK}, 'CAN9001011F3001019', repeat('<', 14), '04')",
    "secrets": f"case o_orderkey % 13 {' '.join(f'when {k} then {text}' for k, (_, text, _) in enumerate(SECRETS))} end",
    "ocr": f"concat('Social Insurance Number: ', replace({_NINE}, '0', 'O'))",
}


#: Tables of fewer bytes are dealt over the cores: such a file may be one row group, which one task would read and judge alone.
SMALL = 64 << 20


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet").select(*columns or "*")
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(spark.sparkContext.defaultParallelism) if size < SMALL else df


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", "doc_id", "text")


def derived(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return orders(spark, sf).select(F.col("o_orderkey").alias("doc_id"), F.expr(TEXTS[name]).alias("text"))


def found(docs: DataFrame, *layers: str) -> DataFrame:
    rows = fd.explode_findings(scan_documents(docs, layers, AS_OF))
    return rows.select("doc_id", "raw_type", "value", F.round("confidence", 4).alias("confidence"), "category", "risk_level")


def scan_of(name: str, *layers: str):
    return lambda spark, sf: found(derived(spark, sf, name), *layers)


def layer(column, name: str = "documents"):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        docs = documents(spark, sf) if name == "documents" else derived(spark, sf, name)
        return fd.exploded(docs, column(F.coalesce(F.col("text"), F.lit(""))), "doc_id").select("doc_id", "f.raw_type", "f.value", "f.confidence")

    return query


def urls_of_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    text = F.concat(F.col("url"), F.lit(", "), F.col("html"))
    return fd.exploded(pages, nl.urls(text), "page_id").select("page_id", "f.value")


def regex_scores(spark: SparkSession, sf: str) -> DataFrame:
    return fd.file_scores(scan_documents(documents(spark, sf), ("regex",)))


def score_file(spark, sf):
    return regex_scores(spark, sf).select("doc_id", "score", "band", "n_findings")


def risk_bands(spark, sf):
    return regex_scores(spark, sf).groupBy("band").agg(F.count("*").alias("n"))


def scan_summary(spark, sf):
    return fd.scan_summary(regex_scores(spark, sf))


def source_counts(spark, sf):
    return fd.source_counts(fd.explode_findings(scan_documents(documents(spark, sf), ("regex", "secrets"))))


def top_files(spark, sf):
    return fd.top_files(regex_scores(spark, sf)).select("doc_id", "score", "band")


def taxonomy_risk(spark, sf):
    types = spark.createDataFrame([(t,) for t in (*dims.TAXONOMY, "unheard_of")], "raw_type string")
    return types.select("raw_type", dims.category(F.col("raw_type")).alias("category"), dims.risk(dims.category(F.col("raw_type"))).alias("risk_level"))


def mask_values(spark, sf):
    f = fd.explode_findings(scan_documents(documents(spark, sf), ("regex",)))
    return f.where("raw_type in ('email', 'phone', 'ip_address')").select("doc_id", "raw_type", "value", mask_value(F.col("value"), F.col("category")).alias("masked"))


_PATH = "case o_orderkey % 4 when 0 then '/in/john_passport_scan.jpg' when 1 then '/in/compass_report.txt' when 2 then '/in/prcard2.png' else '/in/MyHealthCard.pdf' end"


def mismatch_alarm(spark, sf):
    docs = orders(spark, sf).select(F.col("o_orderkey").alias("doc_id"), F.expr(_PATH).alias("path"), F.expr(f"case when o_orderkey % 5 = 0 then {TEXTS['sin_bare']} when o_orderkey % 5 = 1 then 'a birth certificate' else 'nothing here' end").alias("text"))
    out = alarm.alarms(scan_documents(docs, ("regex",), keep=("doc_id", "path", "text")), path="path")
    return out.groupBy("file", "triggered_by").agg(F.count("*").alias("n"))


def _passport_findings(spark, sf):
    return fd.explode_findings(scan_documents(derived(spark, sf, "passport"), ("passport",)))


def _verified(spark, sf):
    f = _passport_findings(spark, sf)
    verdicts = f.select("doc_id", "norm_value", "category", F.when(F.col("doc_id") % 6 == 0, "FALSE_POSITIVE").when(F.col("doc_id") % 6 == 2, "LEGITIMATE").otherwise("ERROR").alias("verdict")).distinct()
    return verify.apply_verdicts(f, verdicts)


def verify_demote(spark, sf):
    return _verified(spark, sf).select("doc_id", "value", "risk_level", "original_risk_level", "llm_verified")


def verification_summary(spark, sf):
    return verify.summary(_verified(spark, sf))


def compare_runs(spark, sf):
    docs = derived(spark, sf, "passport")
    return fd.compare_runs(fd.file_scores(scan_documents(docs, ("regex",))), fd.file_scores(scan_documents(docs, ("regex", "passport"))))


def eval_prf(spark, sf):
    want = derived(spark, sf, "passport").select("doc_id", F.lit("passport_ca").alias("raw_type"), F.regexp_extract("text", "AB[0-9]{6}", 0).alias("value"))
    got = _passport_findings(spark, sf).select("doc_id", "raw_type", "value")
    return fd.evaluate(want, got, ["doc_id", "raw_type", "value"], "raw_type")


def ext_filter(spark, sf):
    files = orders(spark, sf).select(F.expr(_PATH).alias("path"), F.lit(1).cast("long").alias("length"), F.lit(0.0).alias("size_mb"), F.lit(None).cast("binary").alias("content"))
    kept, _ = split_files(files.withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))), ("txt", "pdf"))
    return kept.groupBy("path").agg(F.count("*").alias("n"))


def size_filter(spark, sf):
    size = F.octet_length("html").cast("long")
    pages = table(spark, sf, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".txt")).alias("path"), F.lit("txt").alias("ext"), size.alias("length"), F.round(size / 1048576, 2).alias("size_mb"), F.col("html").cast("binary").alias("content"))
    _, skipped = split_files(pages, max_mb=2048 / 1048576)
    return skipped.select("path", "reason", "size_mb", "count")


def mask_identifiers(spark, sf):
    docs = derived(spark, sf, "card").unionAll(derived(spark, sf, "sin_bare"))
    f = fd.explode_findings(scan_documents(docs, ("regex",)))
    return f.select("doc_id", "raw_type", mask_value(F.col("value"), F.col("category")).alias("masked"))


def score_high(spark, sf):
    return fd.file_scores(scan_documents(derived(spark, sf, "sin"), ("regex", "keyword_context"), AS_OF)).select("doc_id", "score", "band", "n_findings", "top_category")


def html_strip(spark, sf):
    def strip(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: html_text(x or ""))

    return table(spark, sf, "pages").select("page_id", F.pandas_udf(strip, "string")("html").alias("text"))


def full_scan(spark, sf):
    layers = [x for x in dims.LAYERS if x != "gliner"]
    return fd.file_scores(scan_documents(documents(spark, sf), layers)).select("doc_id", "score", "band", "n_findings", "top_category")


QUERIES = {
    "full_scan": full_scan,
    "layer_email": layer(nl.emails),
    "layer_phone": layer(nl.phones),
    "layer_ip": layer(nl.addresses),
    "layer_secrets": layer(nl.secrets),
    "layer_url": urls_of_pages,
    "layer_dates": layer(nl.dates, "dates"),
    "layer_card": scan_of("card", "regex"),
    "layer_sin": scan_of("sin", "regex", "keyword_context"),
    "layer_sin_unverified": scan_of("sin_bare", "regex"),
    "layer_ssn": scan_of("ssn", "keyword_context"),
    "layer_postal": scan_of("postal", "keyword_context"),
    "layer_dob": scan_of("dob", "keyword_context"),
    "layer_passport": layer(nl.passports, "passport"),
    "layer_uci": layer(nl.ucis, "uci"),
    "layer_status_card": layer(nl.status_cards, "status"),
    "layer_health_card": scan_of("health", "health_card"),
    "layer_drivers_license": scan_of("licence", "drivers_license"),
    "layer_ocr_recovery": scan_of("ocr", "ocr_recovery"),
    "layer_mrz": scan_of("mrz", "mrz"),
    "layer_phone_bare": layer(nl.phones, "bare"),
    "layer_secret_types": layer(nl.secrets, "secrets"),
    "reconcile_r2": scan_of("r2", "regex", "health_card"),
    "reconcile_r4": scan_of("r4", "regex", "health_card"),
    "reconcile_r6": scan_of("r6", "drivers_license", "health_card"),
    "mask_identifiers": mask_identifiers,
    "score_high": score_high,
    "merge_dedup": scan_of("dob", "regex", "keyword_context"),
    "reconcile_rules": scan_of("both", "regex", "passport"),
    "taxonomy_risk": taxonomy_risk,
    "score_file": score_file,
    "risk_bands": risk_bands,
    "scan_summary": scan_summary,
    "source_counts": source_counts,
    "top_files": top_files,
    "mask_values": mask_values,
    "mismatch_alarm": mismatch_alarm,
    "verify_demote": verify_demote,
    "verification_summary": verification_summary,
    "compare_runs": compare_runs,
    "eval_prf": eval_prf,
    "ext_filter": ext_filter,
    "size_filter": size_filter,
    "html_strip": html_strip,
}
