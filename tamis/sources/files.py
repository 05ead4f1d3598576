"""Files as tables: the scan of a folder, the rows that are skipped and why, and the texts of the rest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import SUPPORTED, TEXT, extract_all, looks_binary

MAX_MB = 10


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """path, ext, size_mb, content of all files below root, by Spark's own reader: any store that it reads will do.

    content is read only where a later step asks for it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", ext.alias("ext"), F.round(F.col("length") / 1048576, 2).alias("size_mb"), "length", "content")


def split_files(files: DataFrame, extensions=None, max_mb: float = MAX_MB) -> tuple[DataFrame, DataFrame]:
    """(files to read, skipped): a file of another type is filtered, a text file with binary content binary, one over the limit too large.
    Filtered files are one row with their number. Sizes and types are known without contents; of contents, only text files' are
    looked at."""
    wanted = sorted(set(SUPPORTED) & set(extensions)) if extensions is not None else sorted(SUPPORTED)

    def binary(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for heads in batches:
            yield pa.array([looks_binary(h or b"") for h in heads.to_pylist()], pa.bool_())

    head = F.when(F.col("ext").isin(*TEXT), F.expr("substring(content, 1, 8192)"))
    odd = F.when(F.col("ext").isin(*TEXT), F.arrow_udf(binary, "boolean")(head)).otherwise(F.lit(False))
    marked = files.where(F.col("ext").isin(*wanted)).withColumn("reason", F.when(odd, "binary content").when(F.col("length") > max_mb * 1048576, "too_large"))
    filtered = files.where(~F.col("ext").isin(*wanted)).agg(F.count("*").alias("count")).where("count > 0")
    skipped = marked.where("reason is not null").select("path", "reason", F.when(F.col("reason") == "too_large", F.col("size_mb")).alias("size_mb"), F.lit(1).cast("long").alias("count"))
    return marked.where("reason is null").drop("reason"), skipped.unionByName(filtered.select(F.lit(None).cast("string").alias("path"), F.lit("filtered").alias("reason"), F.lit(None).cast("double").alias("size_mb"), "count"))


TEXTS = "doc_id string, path string, ext string, text string, scan_status string, failure_reason string, metadata map<string,string>, faces_detected int, ocr_attempted boolean, ocr_confidence double"


def rows_of(paths, exts, contents, backends: dict | None) -> pd.DataFrame:
    """Texts and metadata of files, by their bytes; an exception in their place is a failure."""
    rows = []
    for path, ext, data in zip(paths, exts, contents, strict=True):
        failed = isinstance(data, Exception)
        text, status, reason, known = (None, "extraction_failed", f"{type(data).__name__}: {data}", {}) if failed else extract_all(ext, bytes(data), backends)
        confidence, faces = known.get("ocr_confidence"), known.get("faces_detected")
        rows.append((path, path, ext, text, status, reason, known, int(faces) if faces is not None else None, "ocr_attempted" in known, float(confidence) if confidence is not None else None))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in TEXTS.replace("map<string,string>", "map").split(", ")]).astype({"faces_detected": "Int32"})


def read_texts(files: DataFrame, backends: dict | None = None) -> DataFrame:
    """doc_id (the path), path, ext, text, scan_status, failure_reason, metadata, and what an OCR back end says. A file that can't be read is a row
    with its reason."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield rows_of(b["path"], b["ext"], b["content"], backends)

    return files.select("path", "ext", "content").mapInPandas(of, TEXTS)
