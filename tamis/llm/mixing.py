"""Mixing sources to target weights, with DataFrame functions alone.

Word counts are summed per source, targets are found by water filling (no source may exceed `max_repeats` times its
words), and each document is taken floor(rate) times plus one hash-seeded Bernoulli copy. The draw of a document is a hash
of its id and the seed; its copy is taken when the draw lies below the source's threshold. Unconditioned, that threshold
is the fraction of the rate, and copies are independent. With calibrate=True it is the draw at which the words below it reach fraction x words, so
that the words of a source miss the target by half a document rather than by a sampling error. The threshold then depends on the draws
themselves: over seeds, a document's probability is the fraction up to about its own share of its source's words, and the copies of one source
aren't quite independent.

Defined results: a null text has size 0; a null source is a source of its own and sorts last; sources without words get
target 0 and rate 0; rows that repeat a doc_id share one draw, as do rows without one; ties of draws are taken or left together; very long
texts are counted whole; an empty table gives an empty result. Columns that the operator adds replace input columns of the same name in `mix_plan`; `mix_emit` returns the
input columns alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import WORD, materialise, table

#: Draws are dealt into this many bins per source; only the bin at the threshold is sorted.
BINS = 4096


def drawn(seed: int):
    """A number from 0 to below 1 that depends on doc_id and the seed alone: the first 52 bits of a digest, exact as a double."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        drawn(seed).alias("draw"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, max_repeats: float) -> DataFrame:
    """One row per source: source, source_size, target. Works on the table of sources, whatever the number of documents.

    Water filling in closed form: with sources in order of cap / weight, the first k are capped, where k is the smallest
    number for which the level left, (total - caps of the k) / (weights of the others), is under the next cap / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", max_repeats * F.col("source_size"))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before_cap", F.coalesce(F.sum("cap").over(fill), F.lit(0.0)))
    per = per.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
    per = per.withColumn("level", (F.least(budget * F.sum("source_size").over(everything), F.sum("cap").over(everything)) - F.col("before_cap")) / F.col("left_weight"))
    per = per.withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    per = per.withColumn("level", F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("weight")).alias("order"), "level"))).over(everything)["level"])
    target = F.least(F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"), F.col("cap"))
    return per.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame, calibrate: bool) -> DataFrame:
    """goals with whole (copies that all documents get) and threshold (draws below it get one more)."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.withColumn("whole", F.floor(rate).cast("long")).withColumn("fraction", rate - F.floor(rate))
    if not calibrate:
        return goals.withColumn("threshold", F.col("fraction"))
    bins = sizes.groupBy("source", F.floor(F.col("draw") * BINS).alias("bin")).agg(F.sum("size").alias("words"))
    by_bin = Window.partitionBy("source").orderBy("bin")
    wanted = F.col("fraction") * F.col("source_size")
    at = (
        bins.withColumn("upto", F.sum("words").over(by_bin))
        .withColumnRenamed("source", "bin_source")
        .join(goals, F.col("bin_source").eqNullSafe(F.col("source")))
        .where((F.col("upto") >= wanted) & (F.col("upto") - F.col("words") < wanted))
        .select(F.col("bin_source").alias("at_source"), "bin", (F.col("upto") - F.col("words")).alias("below"), wanted.alias("wanted"))
    )
    inside = (
        sizes.select("source", "size", "draw", F.floor(F.col("draw") * BINS).alias("draw_bin"))
        .join(at, F.col("source").eqNullSafe(F.col("at_source")) & (F.col("draw_bin") == F.col("bin")))
        .groupBy("at_source", "draw", "below", "wanted")
        .agg(F.sum("size").alias("size"))
    )
    by_draw = Window.partitionBy("at_source").orderBy("draw")
    # the document at the threshold is taken when more than half of it is wanted
    edge = (
        inside.withColumn("upto", F.col("below") + F.sum("size").over(by_draw))
        .groupBy("at_source")
        .agg(
            F.max(F.when(F.col("upto") - F.col("size") / 2 <= F.col("wanted"), F.col("draw"))).alias("last_in"),
            F.min("draw").alias("first"),
        )
        .select("at_source", F.coalesce(F.col("last_in") + F.lit(2.0**-52), F.col("first")).alias("threshold"))
    )
    return (
        goals.join(edge, F.col("source").eqNullSafe(F.col("at_source")), "left")
        .drop("at_source")
        .withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
    )


def mix_plan(docs: DataFrame, weights=(5, 2, 1), budget: float = 1.5, max_repeats: float = 2.0, seed: int = 17, calibrate: bool = True) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per row of docs."""
    # the narrow table is written once: later steps don't read texts again
    sizes = materialise(sized(docs, seed), "mix-sizes")
    goals = materialise(targets(sizes, tuple(weights), budget, max_repeats), "mix-targets")
    rates = materialise(thresholds(sizes, goals, calibrate), "mix-rates").withColumnRenamed("source", "rate_source")
    copies = F.least(F.col("whole") + F.when(F.col("draw") < F.col("threshold"), 1).otherwise(0), F.lit(int(max_repeats)))
    return (
        sizes.join(rates, F.col("source").eqNullSafe(F.col("rate_source")))
        .withColumn("copies", copies.cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "draw")
    )


def mix_emit(docs: DataFrame, weights=(5, 2, 1), budget: float = 1.5, max_repeats: float = 2.0, seed: int = 17, calibrate: bool = True) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Texts aren't shuffled: the rates of sources come to them."""
    sizes = materialise(sized(docs, seed), "mix-sizes")
    goals = materialise(targets(sizes, tuple(weights), budget, max_repeats), "mix-targets")
    rates = materialise(thresholds(sizes, goals, calibrate), "mix-rates")
    rates = rates.select(F.col("source").alias("__source"), F.col("whole").alias("__whole"), F.col("threshold").alias("__threshold"))
    copies = F.least(F.col("__whole") + F.when(drawn(seed) < F.col("__threshold"), 1).otherwise(0), F.lit(int(max_repeats)))
    return (
        docs.join(rates, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("__copies", copies.cast("int"))
        .where("__copies > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
        .select(*docs.columns)
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
