"""Best-two-fit packing into sequences of at most `capacity` tokens.

Lengths are integers from 1 to the capacity, so that the number of pieces of each length says all that a packer needs to
know. The steps are: tokenize and cut (one pass over the texts), count lengths, pack the counts on the driver (state: one
number per length, whatever the number of documents), and deal pieces to slots by their rank among pieces of their length.
Ranks come from counts per task, so that a length that a third of all pieces share isn't gathered anywhere.

Packing a bin: fill greedily with the longest piece that fits; then try to replace the bin's smallest document by two
unpacked ones that fit its gap more tightly. A bin pattern is repeated as often as the counts allow.

Defined results: null and empty texts are the end token alone; rows that repeat, or lack a doc_id, are packed each; an empty table packs to
nothing; ties of length go by task and place within it, so that a rerun over the same files gives the same places; columns beyond doc_id and
text aren't looked at. Very long texts are tokenized whole and cut into pieces; pieces that are as long as the capacity are sequences of
their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialise, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: the first is what is left beside full ones."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .tokens import Encoder

        encoder, end, task = Encoder(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)  # pieces of each length that this task has had
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encoder.ids(text or "") + end
                for i, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, i, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), task, seen[n]))
                    seen[n] += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(of, PIECES)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins), in all using up counts. A step uses up a length or moves to another bin."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in counts.items():
        left[n] = k
    bins: list[tuple[list[int], int]] = []
    while left.any():
        lengths = np.flatnonzero(left)
        used: dict[int, int] = {}
        held: list[int] = []
        gap = capacity

        def free(n: int) -> int:
            return int(left[n]) - used.get(n, 0)  # noqa: B023

        at = len(lengths) - 1
        while gap > 0:
            at = min(at, int(np.searchsorted(lengths, gap, side="right")) - 1)
            while at >= 0 and free(int(lengths[at])) <= 0:
                at -= 1
            if at < 0:
                break
            n = int(lengths[at])
            held.append(n)
            used[n] = used.get(n, 0) + 1
            gap -= n
        if gap > 0 and len(held) > 1:
            smallest = held[-1]
            room = gap + smallest
            best = None
            # the pair with the largest sum in (smallest, room]: two pointers over the lengths that are left
            i, j = 0, len(lengths) - 1
            while i <= j and best != room:
                a, b = int(lengths[i]), int(lengths[j])
                if a + b > room:
                    j -= 1
                    continue
                if free(a) > 0 and free(b) > (1 if a == b else 0) and a + b > (best or smallest):
                    best, pair = a + b, (a, b)
                i += 1
            if best:
                held.pop()
                used[smallest] -= 1
                for n in pair:
                    held.append(n)
                    used[n] = used.get(n, 0) + 1
        times = min(int(left[n]) // k for n, k in used.items() if k)
        for n, k in used.items():
            left[n] -= k * times
        bins.append((held, times))
    return bins


def slots(bins: list[tuple[list[int], int]]) -> pd.DataFrame:
    """Per length and rank range: the bins and offsets that the pieces get. As many rows as patterns have distinct lengths."""
    taken: dict[int, int] = {}
    rows, first = [], 0
    for held, times in bins:
        offset, by_length = 0, {}
        for n in held:
            by_length.setdefault(n, []).append(offset)
            offset += n
        for n, offsets in by_length.items():
            rows.append((n, taken.get(n, 0), first, offsets))
            taken[n] = taken.get(n, 0) + len(offsets) * times
        first += times
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "offsets"])


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    cut_up = materialise(pieces(docs, tokenizer, capacity, end_id), "pack-pieces")
    per_task = materialise(cut_up.groupBy("length", "task").agg(F.count("*").alias("n")), "pack-counts")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = slots(best_two_fit(counts, capacity)).sort_values(["length", "rank"])
    # (length, rank) as one number, so that one search finds a piece's slot
    starts = plan["length"].to_numpy(np.int64) << 40 | plan["rank"].to_numpy(np.int64)
    sequence, lengths = plan["sequence"].to_numpy(np.int64), plan["rank"].to_numpy(np.int64)
    width = plan["offsets"].map(len).to_numpy(np.int64)
    first = np.concatenate([[0], np.cumsum(width)])[:-1].astype(np.int64)
    offsets = np.array([x for o in plan["offsets"] for x in o], dtype=np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((starts, sequence, lengths, width, first, offsets))

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # a task's counts come together as one row: what each task needs is as long as the capacity
    by_task = before.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("before"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, sequence, ranks, width, first, offsets = sent.value
        for b in batches:
            rank = b.pop("rank").to_numpy(np.int64)
            at = np.searchsorted(starts, b["length"].to_numpy(np.int64) << 40 | rank, side="right") - 1
            k = rank - ranks[at]
            yield b.assign(sequence_id=sequence[at] + k // width[at], offset=offsets[first[at] + k % width[at]])

    ranked = cut_up.join(by_task, "task").select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("before")[F.col("length")]).alias("rank")
    )
    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
