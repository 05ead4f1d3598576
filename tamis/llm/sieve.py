"""Joins of large tables with few of their keys, and of keys that many rows share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise

#: The most words of 64 marks in a table; it is broadcast, two numbers a word.
WORDS = 1 << 20


def sieved(df: DataFrame, key: str, nodes: DataFrame, column: str = "node", marks: int = 32) -> DataFrame:
    """The rows of df whose key is among those of `nodes` (a written table), and a few others: marks of the nodes are broadcast and rows
    looked up in them. A join on the key leaves the right rows.

    The table has `marks` marks a node, so that about one in `marks` of the other rows passes, up to WORDS words (two million nodes at
    32 marks); with more nodes more of the others pass, one in four at 20 million and nearly all at 300 million. Results don't
    depend on it."""
    words = 1 << max(10, min(WORDS.bit_length() - 1, (nodes.count() * marks // 64).bit_length()))
    at, mark = (lambda c: F.expr(f"pmod(shiftright(xxhash64({c}), 6), {words}L)")), (lambda c: F.expr(f"shiftleft(1L, int(xxhash64({c}) & 63))"))
    table = nodes.select(at(column).alias("_at"), mark(column).alias("_mark")).groupBy("_at").agg(F.bit_or("_mark").alias("_marks"))
    return df.join(F.broadcast(table), at(key) == F.col("_at")).where(F.col("_marks").bitwiseAND(mark(key)) != 0).select(*df.columns)


#: Keys that a join splits number fewer than this.
HOT = 100_000


def met(left: DataFrame, right: DataFrame, key: str, part: int, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """left (a written table) joined with right, which has one row a key. A key of more than `part` rows of left is dealt over tasks in
    parts of about that many rows, and its row of right goes to each part.

    counts: key and n, if they are known. At least a HOT-th of all rows make a key hot, so that hot keys are few whatever the
    number of rows, and can be broadcast."""
    counts = counts if counts is not None else left.groupBy(key).agg(F.count("*").alias("n"))
    counts = materialise(counts.where(F.col("n") > part), "hot-keys")
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return left.join(right, key, how)
    hot = counts.where(F.col("n") > max(part, total // HOT)).select(F.col(key).alias("_key"), F.ceil(F.col("n") / part).cast("int").alias("_parts"))
    spread = left.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left")
    spread = spread.withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_parts")), F.lit(0)).cast("int")).drop("_key", "_parts")
    copied = right.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left")
    copied = copied.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_key", "_parts")
    return spread.join(copied, [key, "_part"], how).drop("_part")
