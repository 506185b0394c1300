"""Scalar expressions. Every function maps Columns to a Column, JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Percent change reported where activity appears from a silent baseline.
FROM_SILENCE_PCT = 1e6


def pair_number(name: Column) -> Column:
    """Trailing ``_#N`` or ``#N`` as a number; NULL when absent."""
    return F.when(name.rlike(r"#\d+$"), F.regexp_extract(name, r"#(\d+)$", 1).cast("bigint"))


def require_pair_number(name: Column) -> Column:
    """As ``pair_number`` but failing the query on a name without a suffix."""
    return F.coalesce(pair_number(name), F.raise_error(
        F.concat(F.lit("no #N suffix in "), name)).cast("bigint"))


def safe_name(name: Column) -> Column:
    return F.translate(name, "-#", "__")


def _three_decimals(p: Column) -> Column:
    """``%.3f`` of 0.001 <= p, rounding the exact binary value (Java rounds the
    shortest decimal, so 0.0075 would become 0.008)."""
    shift = 52 - F.floor(F.log2(p))
    scale = F.pow(F.lit(2.0), shift)
    whole = F.floor(p * 1000).cast("bigint")

    def exact(x: Column) -> Column:
        return x.cast("bigint").cast("decimal(20,0)")

    twice = exact(p * scale) * F.lit(2000).cast("decimal(4,0)")
    half = (2 * whole + 1).cast("decimal(12,0)") * exact(scale)
    up = (twice > half) | ((twice == half) & (whole % 2 == 1))
    k = whole + F.when(up, 1).otherwise(0)
    return F.format_string("%d.%03d", F.floor(k / 1000), k % 1000)


def p_text(p: Column) -> Column:
    p = p.cast("double")
    return (F.when(p.isNull() | F.isnan(p), F.lit("n/a"))
            .when(p < 0.001, F.lit("<0.001"))
            .otherwise(_three_decimals(p)))


def change_score(b: Column, t: Column) -> Column:
    """Relative change that stays finite for quiet baselines."""
    return (t - b) / F.greatest(F.lit(1.0), b)


def euclid(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def microvolts(v: Column) -> Column:
    return v * F.lit(1e6)


def safe_pct(b: Column, t: Column) -> Column:
    """Percent change; NULL where both sides are silent or t falls below a zero b."""
    return (F.when(b != 0, 100.0 * (t - b) / b)
            .when(t > 0, F.lit(FROM_SILENCE_PCT)))


def capped_pct(b: Column, t: Column, cap: float | None) -> Column:
    """Percent change for displays: activity from silence takes the cap."""
    appeared = FROM_SILENCE_PCT if cap is None else float(cap)
    return (F.when((b == 0) & (t == 0), None)
            .when(b == 0, F.when(t > 0, F.lit(appeared)))
            .otherwise(100.0 * (t - b) / b))


def change_category(b: Column, t: Column, rel_tol: float = 1e-6) -> Column:
    """silenced / unchanged / increased / decreased; NULL when not active at baseline."""
    near = F.abs(t - b) <= F.lit(rel_tol) * b
    return (F.when(~(b > 0), None)
            .when(t == 0, "silenced")
            .when(near, "unchanged")
            .when(t > b, "increased")
            .otherwise("decreased"))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
