"""MinHash near-duplicates: fast similarity sketches, banding, and exact verification on full shingle sets.

1. One pass over the texts gives each document its set's size, a fingerprint of the whole set, and a sketch.
2. Documents with equal sets are one class, named by the smallest doc_id. Later steps work on classes.
3. Classes that agree in a band are candidates. In each bucket all are compared with one member, the one with the most company in all its
   buckets (of a text and its altered copies, that is mostly the text), which joins most of a large group with as many comparisons as it has
   members, whatever the order of ids. Such a pair is dropped when its sizes or sketches
   rule the threshold out (by eight standard deviations), and else confirmed on full sets.
4. After components are known, members of buckets that still hold several components are compared across components. Two
   sets at the threshold share a shingle among each one's rarest fifth or so (in any order that all sets use, here rarest
   among these members first), so that pairs are met at those shingles alone and none at the threshold is left out; they are
   confirmed on full sets too. A group of texts that are near 0.6 to 0.8 alike thus doesn't make the square of its size of
   pairs, as long as what sets its texts apart is theirs alone. Buckets have no cap.

With 40 bands of 6 rows, a pair at the threshold of 0.8 is missed with probability 6e-6.

Defined results: null and empty texts, and those without words, have an empty set, link with nothing and are their own
component; rows that repeat a doc_id are copies of each other; rows without a doc_id join those with an equal set alone (a table
with such rows needs a row key in its place, as the pipeline gives one), are never a component's name unless it has no other, and
are kept then; an empty table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch
from .components import components
from .sieve import met, sieved
from .store import materialise, table

#: Rows of a key that one task joins: pairs with their sketches or sets, and narrow rows.
SETS_PART, NARROW_PART = 256, 1 << 14
#: The table of how often shingles occur has 2 ** COUNTED entries, by a shingle's first bits; it only orders them.
COUNTED = 20
SETS = "doc_id long, n long, print binary, bands array<long>, bytes binary"


def shingle_sets(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketcher = sketch.Shingler(width), sketch.Sketcher(bands * rows)
        for b in batches:
            bins, sizes, prints = [], [], []
            for s in shingler.of(b.column("text")):
                sizes.append(len(s))
                prints.append(sketch.fingerprint(s) if len(s) else None)
                if len(s):
                    bins.append(sketcher.of(s))
            bins = np.array(bins, np.uint64).reshape(-1, bands * rows)
            full = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64) > 0)))
            keys = pa.ListArray.from_arrays(pa.array(full * bands, pa.int32()), pa.array(sketch.band_keys(bins, rows).ravel()))
            small = pa.py_buffer(sketch.one_byte(bins).tobytes())
            small = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((full * bands * rows).astype(np.int32).tobytes()), small])
            columns = [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), keys, small]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "print", "bands", "bytes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, SETS)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = sketch.Shingler(width)
        for b in batches:
            sets = [s.tobytes() for s in shingler.of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return docs.mapInArrow(of, "node long, shingles binary")


def with_ends(pairs: DataFrame, own: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """pairs (a, b) with the columns of own(nodes), a row for each node, for both ends, as c_a and c_b. The ends b come first, each mostly
    in few pairs; the hubs a, which are few, meet their pairs in parts, so that neither a task nor a shuffle has a hub's columns
    once for each pair."""
    out = pairs
    for c in ("b", "a"):
        counts = materialise(pairs.groupBy(c).agg(F.count("*").alias("n")), "near-ends")
        rows = own(counts.select(F.col(c).alias("node")))
        out = met(out, rows.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in rows.columns if x != "node")), c, SETS_PART, counts)
    return out


def likely(pairs: DataFrame, sketches: DataFrame, percent: int, t: int) -> DataFrame:
    """Pairs whose sketches don't rule the threshold out. Bytes of unequal coordinates agree once in 256 times."""
    low = max(0.0, percent / 100 - 8 * np.sqrt(percent / 100 * (1 - percent / 100) / t))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b[c]), np.uint8).reshape(len(b), t) for c in ("bytes_a", "bytes_b"))
                yield b.loc[(x == y).mean(axis=1) >= low, ["a", "b"]]

    rows = sketches.select(F.col("doc_id").alias("node"), "n", "bytes").where("n > 0")
    own = lambda nodes: sieved(rows, "node", nodes).dropDuplicates(["node"])
    fits = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return with_ends(pairs, own).where(fits).select("a", "b", "bytes_a", "bytes_b").mapInPandas(of, "a long, b long")


def sets_of(nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """node, shingles: one full set for each of nodes(node), and for a few other documents."""
    texts = sieved(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", nodes)
    return full_sets(texts, width).dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold. sets(nodes) has them as node and s."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["s_a"], b["s_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = sketch.overlap(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.loc[keep, ["a", "b"]]

    return materialise(with_ends(pairs, sets).mapInPandas(of, "a long, b long"), "near-links")


def occurrences(sets: DataFrame) -> np.ndarray:
    """How many shingles of sets begin with each run of COUNTED bits; a table of that size, whatever the number of sets."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << COUNTED, np.int64)
        for b in batches:
            for s in b.column("shingles").to_pylist():
                np.add.at(seen, np.frombuffer(s, np.uint64) >> np.uint64(64 - COUNTED), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["at", "n"])

    found = sets.select("shingles").mapInArrow(of, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNTED, np.int64)
    counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return np.minimum(counts, 2**31 - 1).astype(np.int32)


def meetings(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with different labels that share one of their rarest shingles: all those at the threshold, and others."""
    counts = occurrences(sets)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, places, tokens, rows = [], [], [], []
            for row, s in enumerate(b.column("shingles").to_pylist()):
                s = np.frombuffer(s, np.uint64)
                seen = counts[s >> np.uint64(64 - COUNTED)]
                rarest = np.lexsort((s, seen))[: len(s) + 1 + (-percent * len(s)) // 100]
                at = np.flatnonzero(seen[rarest] > 1)  # what occurs once is met by no other set
                places.append(at)
                tokens.append(s[rarest[at]].view(np.int64))
                sizes.append(np.full(len(at), len(s)))
                rows.append(np.full(len(at), row))
            if rows:
                rows = pa.array(np.concatenate(rows), pa.int64())
                numbers = [pa.array(np.concatenate(x), pa.int64()) for x in (sizes, places, tokens)]
                yield pa.RecordBatch.from_arrays([b.column("node").take(rows), b.column("label").take(rows), *numbers], ["node", "label", "n", "at", "token"])

    rare = sets.join(labels, "node").mapInArrow(of, "node long, label long, n long, at long, token long")
    rare = materialise(rare, "near-rare")
    side = lambda c: rare.select("token", *(F.col(k).alias(v) for k, v in (("node", c), ("label", f"label_{c}"), ("n", f"n_{c}"), ("at", f"at_{c}"))))
    # a pair is met at the first shingle that it shares: no more can be shared than the shorter part from there on has
    most = "least(n_a - at_a, n_b - at_b)"
    fits = f"a < b and label_a <> label_b and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and (100 + {percent}) * {most} >= {percent} * (n_a + n_b)"
    return side("a").join(side("b"), "token").where(fits).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, bands: int = 40, rows: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    sets = materialise(shingle_sets(docs, width, bands, rows), "near-sketches")
    classes = materialise(sets.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("node")), "near-classes")
    named = materialise(classes.select("node").where("node is not null").distinct(), "near-named")

    # copies that pass the sieve beside the names of their classes go when few rows are left
    keyed = sieved(sets.where("n > 0").select(F.col("doc_id").alias("node"), "bands"), "node", named, marks=8).select(F.explode("bands").alias("key"), "node")
    sizes = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-sizes")
    # only rows of buckets with company go on; an inner join, since the optimiser moves a semi-join below the sieve
    buckets = met(sieved(keyed, "key", sizes, "key", marks=8), sizes, "key", NARROW_PART, sizes).join(named, "node")
    # a class's weight is the company that it has in all its buckets, of which there are `bands` at the most
    known = buckets.groupBy("node").agg(F.collect_list(F.struct("key", "n")).alias("all"), F.sum("n").alias("weight"))
    buckets = materialise(known.select("node", "weight", F.explode("all").alias("one")).select("one.key", "node", "weight", F.col("one.n").alias("members")), "near-buckets")
    hubs = buckets.groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("hub"))
    first = met(buckets, hubs, "key", NARROW_PART, sizes).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    first = materialise(likely(materialise(first, "near-first"), sets, percent, bands * rows), "near-likely")
    renamed = lambda sets: sets.withColumnRenamed("shingles", "s")
    links = confirmed(first, lambda nodes: renamed(sets_of(nodes, docs, width)), percent)

    labels = final = materialise(components(links), "near-labels")
    placed = buckets.where("members > 2").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    placed = materialise(placed, "near-placed")
    several = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    mixed = materialise(met(placed, several, "key", NARROW_PART, sizes).select("node", "label").distinct(), "near-mixed")
    if not mixed.isEmpty():
        full = materialise(sets_of(mixed.select("node"), docs, width), "near-sets")
        more = confirmed(materialise(meetings(full, mixed, percent), "near-rest"), lambda _: renamed(full), percent)
        if not more.isEmpty():
            final = materialise(components(links.unionAll(more)), "near-labels")

    parts = classes.join(final, "node", "left").select("print", F.coalesce("label", "node").alias("component"))
    own = sets.select("doc_id", F.col("n").alias("n_shingles"), "print")
    joined = met(own.where("n_shingles > 0"), parts, "print", NARROW_PART).select("doc_id", "n_shingles", "component")
    out = joined.unionAll(own.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long")))
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
