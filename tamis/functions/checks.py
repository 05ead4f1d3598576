"""Checksums and validity tests as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def luhn(value: Column, least: int = 13) -> Column:
    """Numbers of at least `least` digits with a right check digit; texts of over 38 characters aren't looked at."""
    d = digits(value)
    return F.coalesce((F.char_length(value) <= 38) & (F.length(d) >= least) & F.call_function("luhn_check", d), F.lit(False))


def valid_sin(value: Column) -> Column:
    d = digits(value)
    return F.coalesce((F.length(d) == 9) & ~F.substring(d, 1, 1).isin("0", "8") & F.call_function("luhn_check", d), F.lit(False))


def valid_ssn(value: Column) -> Column:
    d = digits(value)
    area, group, serial = F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4)
    return F.coalesce((F.length(d) == 9) & ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000"), F.lit(False))


def valid_ohip(value: Column) -> Column:
    """Ontario's rule is Luhn's on ten digits, without a leading 0."""
    d = digits(value)
    return F.coalesce((F.length(d) == 10) & ~d.startswith("0") & F.call_function("luhn_check", d), F.lit(False))


def valid_bc_phn(value: Column) -> Column:
    """Weights of digits two to nine; what 11 lacks is the last digit."""
    d = digits(value)
    weights = F.array(*[F.lit(w) for w in (2, 4, 8, 5, 10, 9, 7, 3)])
    total = F.aggregate(F.transform(weights, lambda w, i: w * F.substring(d, i + 2, 1).try_cast("int")), F.lit(0), lambda a, x: a + x)
    rest = 11 - total % 11
    return F.when((F.length(d) == 10) & d.startswith("9"), (rest <= 9) & (rest == F.substring(d, 10, 1).try_cast("int"))).otherwise(F.lit(False))


def valid_ipv4(value: Column) -> Column:
    parts = F.split(value, r"\.")
    return F.coalesce((F.size(parts) == 4) & F.forall(parts, lambda p: p.try_cast("int").between(0, 255)), F.lit(False))


def icao_digit(field: Column) -> Column:
    """Check digit of a machine-readable field: weights 7, 3, 1 over 0-9, A-Z as 10-35, filler as 0."""
    value = lambda c: F.greatest(F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1, F.lit(0))
    weights = F.array(F.lit(7), F.lit(3), F.lit(1))
    return F.aggregate(F.transform(F.split(field, ""), lambda c, i: value(c) * weights[i % 3]), F.lit(0), lambda a, x: a + x) % 10
