"""Matches with offsets and windows of context, as columns.

A match is marked in the text by U+0001 and U+0002 (which texts lose first), the marks cut the text, and lengths of the
pieces before a match add up to its place. Assertions of a pattern see the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<value:string,start:int,end:int>>"


def spans(text: Column, pattern: str) -> Column:
    """array of (value, start, end) of a pattern's matches; (?U) gives \\d, \\w, \\b and \\s their Unicode meaning."""
    marked = F.regexp_replace(F.translate(text, "\u0001\u0002", "  "), f"(?U)({pattern})", "\u0001$1\u0002")
    pieces = F.split(marked, "[\u0001\u0002]", -1)
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("found"), F.lit(0).alias("n"))

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.char_length(piece)
        own = F.array(F.struct(piece.alias("value"), state["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(state["n"] % 2 == 1, F.concat(state["found"], own)).otherwise(state["found"]).alias("found"), (state["n"] + 1).alias("n"))

    # texts without a match aren't cut
    return F.when(F.coalesce(text, F.lit("")).rlike(f"(?U)(?:{pattern})"), F.aggregate(pieces, start, step, lambda s: s["found"])).otherwise(F.expr(f"cast(array() as {SPAN})"))


def values(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"(?U)({pattern})"), 1), F.expr("cast(array() as array<string>)"))


def window(text: Column, span: Column, width: int) -> Column:
    """The text from `width` characters before a span to `width` after it."""
    first = F.greatest(span["start"] - width, F.lit(0))
    return F.substring(text, first + 1, span["end"] + width - first)


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def norm(value: Column) -> Column:
    return F.lower(strip(value))
