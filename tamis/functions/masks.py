"""Masked values for shared reports, and other display functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _places(value: Column, keep) -> Column:
    """Letters and digits that keep(rank, number of them) doesn't hold for become stars; separators stay."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    is_alnum = lambda c: c.rlike(r"(?U)^[\p{L}\p{N}]$")
    n = F.size(F.filter(chars, is_alnum))
    rank = lambda i: F.size(F.filter(F.slice(chars, 1, i), is_alnum))
    return F.array_join(F.transform(chars, lambda c, i: F.when(~is_alnum(c) | keep(rank(i), n), c).otherwise(F.lit("*"))), "")


def _card(value: Column) -> Column:
    d = F.regexp_replace(value, r"(?U)\D", "")
    masked = F.concat(F.repeat(F.lit("*"), F.greatest(F.length(d) - 4, F.lit(0))), F.right(d, F.lit(4)))
    return F.when(F.length(d) == 0, F.lit("***")).otherwise(F.regexp_replace(masked, r"(.{4})(?=.)", "$1 "))


def _generic(value: Column) -> Column:
    return F.concat(F.substring(value, 1, 1), F.lit("***"), F.right(value, F.lit(1)))


def mask_value(value: Column, category: Column) -> Column:
    at = F.instr(value, "@")
    email = F.when(at <= 1, _generic(value)).otherwise(F.concat(F.substring(value, 1, 1), F.repeat(F.lit("*"), at - 2), F.substring(value, at, F.char_length(value))))
    return (
        F.when(F.coalesce(F.char_length(value), F.lit(0)) < 4, F.lit("***"))
        .when(F.contains(category, F.lit("credit_card")), _card(value))
        .when(category.startswith("contact.email"), email)
        .when(category.startswith("contact.phone"), _places(value, lambda i, n: i >= n - 4))
        .when(category.startswith("identifier."), _places(value, lambda i, n: (i < 3) | (i >= n - 1)))
        .otherwise(_generic(value))
    )


# Segments that are written in capitals.
ACRONYMS = ("ssn", "sin", "dob", "iban", "url", "ip", "aws", "jwt", "api", "ca", "on", "bc", "ab", "sk", "mb", "nb", "ns", "pe", "nl", "nu", "yt", "qc", "nt")


def pretty_type(category: Column) -> Column:
    word = lambda w: F.when(w.isin(*ACRONYMS), F.upper(w)).otherwise(F.initcap(w))
    return F.array_join(F.transform(F.split(category, r"\."), lambda s: F.array_join(F.transform(F.split(s, "_"), word), " ")), " / ")


def file_anchor(path: Column) -> Column:
    return F.substring(F.sha1(path.cast("binary")), 1, 10)


def slug(path: Column) -> Column:
    base = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.substring(F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)
