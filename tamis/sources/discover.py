"""Local folders as tables of files: links, reports and logs are left out, and what can't be read is a row with its reason.

The walk is done by the driver (Hadoop's listing follows links); a store that only Spark reads goes through `files.scan_files`."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import SUPPORTED, TEXT, looks_binary

FILES = "path string, ext string, length long"
SKIPPED = "path string, reason string, size_mb double, count long"
HEAD = 8192


def extension(name: str) -> str:
    return os.path.splitext(name.lower())[1][1:]


def files_below(folder: str) -> int:
    return sum(len(names) for _, _, names in os.walk(folder, followlinks=False))


def walk(root: str, excluded: tuple[str, ...] = ()) -> tuple[list[tuple[str, str]], list[tuple[str, str]], int]:
    """(paths and extensions in order, skipped paths and reasons, number of excluded files). Links are skipped, whatever they
    point to; `excluded` are folders and files of the scanner's own, by their real paths."""
    root, own = os.path.abspath(root), {os.path.realpath(x) for x in excluded}
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    if os.path.isfile(root):
        return [(root, extension(root))], [], 0
    found, skipped, left_out = [], [], 0
    for folder, folders, names in os.walk(root, followlinks=False):
        if os.path.realpath(folder) in own:
            left_out += files_below(folder)
            folders[:] = []
            continue
        for name in [*folders, *names]:
            if os.path.islink(os.path.join(folder, name)):
                skipped.append((os.path.join(folder, name), "symlink"))
        folders[:] = [n for n in folders if not os.path.islink(os.path.join(folder, n))]
        for path in (os.path.join(folder, n) for n in names if not os.path.islink(os.path.join(folder, n))):
            if os.path.realpath(path) in own:
                left_out += 1
            else:
                found.append((path, extension(path)))
    return sorted(found), sorted(skipped), left_out


def discover(spark: SparkSession, root: str, extensions=None, max_mb: float = 10, excluded: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, int]:
    """(files to read, skipped, number of excluded files). A requested extension counts if it is a supported one; files of other supported ones are
    one row, with their number; files of no supported one aren't looked at. A file that may not be looked at is skipped; one that
    is gone is left out. A text file with binary content is skipped before its size is asked."""
    found, skipped, left_out = walk(root, excluded)
    wanted = set(SUPPORTED) & {e.lower().lstrip(".") for e in extensions} if extensions is not None else set(SUPPORTED)
    supported = [(p, e) for p, e in found if e in SUPPORTED]
    paths = [(p, e) for p, e in supported if e in wanted]
    filtered = len(supported) - len(paths)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, ext in zip(b["path"], b["ext"], strict=True):
                try:
                    size, head = os.path.getsize(path), b""
                    if ext in TEXT:
                        with open(path, "rb") as f:
                            head = f.read(HEAD)
                except FileNotFoundError:
                    continue
                except OSError:
                    rows.append((path, ext, None, "permission denied"))
                    continue
                reason = "binary content" if ext in TEXT and looks_binary(head) else "too_large" if size > max_mb * 1048576 else None
                rows.append((path, ext, size, reason))
            yield pd.DataFrame(rows, columns=["path", "ext", "length", "reason"]).astype({"length": "Int64"})

    parts = max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism))
    table = spark.createDataFrame(paths, "path string, ext string").repartition(parts)
    looked = table.mapInPandas(look, f"{FILES}, reason string")
    size = F.when(F.col("reason") == "too_large", F.round(F.col("length") / 1048576, 2))
    rows = looked.where("reason is not null").select("path", "reason", size.alias("size_mb"), F.lit(1).cast("long").alias("count"))
    more = [(p, r, None, 1) for p, r in skipped] + ([(None, "filtered", None, filtered)] if filtered else [])
    return looked.where("reason is null").drop("reason"), rows.unionByName(spark.createDataFrame(more, SKIPPED)), left_out


def read_local(files: DataFrame, backends: dict | None = None) -> DataFrame:
    """The texts of discovered files, as `files.read_texts` gives them: a file that has gone since, or can't be read, is a failed one."""
    from .files import TEXTS, rows_of

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            contents = []
            for path in b["path"]:
                try:
                    with open(path, "rb") as f:
                        contents.append(f.read())
                except OSError as e:
                    contents.append(e)
            yield rows_of(b["path"], b["ext"], contents, backends)

    return files.select("path", "ext").mapInPandas(of, TEXTS)
