"""Small Column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

TINY = 1e-12


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_divide(numerator: Column | str, denominator: Column | str) -> Column:
    """n / d, NULL where |d| is not above 1e-12."""
    d = col(denominator)
    return F.when(F.abs(d) > TINY, col(numerator) / d)


def clip(value: Column | str, low: Column | float, high: Column | float) -> Column:
    v = col(value)
    lo = low if isinstance(low, Column) else F.lit(low)
    hi = high if isinstance(high, Column) else F.lit(high)
    # greatest/least skip NULLs, so a NULL value must be kept apart
    return F.when(v.isNotNull(), F.least(F.greatest(v, lo), hi))


def not_nan(value: Column | str) -> Column:
    """NaN to NULL, so that aggregates skip it."""
    v = col(value)
    return F.when(~F.isnan(v), v)


def count_present(columns: Sequence[Column | str]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + col(c).isNotNull().cast("int")
    return total


def mean_present(columns: Sequence[Column | str]) -> Column:
    """Row mean over the non-NULL columns; NULL when there is none."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(col(c).cast("double"), F.lit(0.0))
    n = count_present(columns)
    return F.when(n > 0, total / n)


def visible_on(effective_at: Column | str, as_of_date: Column | str | None = None) -> Column:
    """First calendar day on which a row may be used.

    ``effective_at <= D 23:59:59.999999 and as_of_date <= D`` is the same as
    ``greatest(date(effective_at), as_of_date) <= D``.
    """
    public = F.to_date(col(effective_at))
    if as_of_date is None:
        return public
    snapshot = col(as_of_date)
    return F.when(public.isNotNull() & snapshot.isNotNull(), F.greatest(public, snapshot))


def end_of_day(day: Column | str) -> Column:
    """day 23:59:59.999999 as a timestamp without zone."""
    return (F.date_add(F.to_date(col(day)), 1).cast("timestamp_ntz")) - F.expr("INTERVAL 0.000001 SECOND")


def month_key(day: Column | str) -> Column:
    return F.trunc(col(day), "month")


def snake(name: Column | str) -> Column:
    """Lower case, runs of other characters to one underscore, outer underscores trimmed."""
    text = F.regexp_replace(F.lower(F.trim(col(name))), "[^a-z0-9]+", "_")
    return F.regexp_replace(text, "^_+|_+$", "")


def register_sql_functions(spark) -> None:
    """SQL-visible helpers (SQL expressions, no Python)."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION safe_divide(n DOUBLE, d DOUBLE) RETURNS DOUBLE "
        "RETURN CASE WHEN abs(d) > 1e-12 THEN n / d END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION winsor_z(v DOUBLE, lo DOUBLE, hi DOUBLE, mean DOUBLE, sd DOUBLE) "
        "RETURNS DOUBLE RETURN CASE WHEN v IS NULL THEN NULL WHEN sd = 0 THEN 0D "
        "ELSE (least(greatest(v, lo), hi) - mean) / sd END"
    )


def digest_sums(text: Column) -> Column:
    """Aggregate: the eight 32-bit words of each row's SHA-256 summed on their own, joined by "-".

    Independent of row order, and every bit of every digest counts.
    """
    sha = F.sha2(text, 256)
    words = [F.sum(F.conv(F.substring(sha, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(8)]
    return F.concat_ws("-", *words)
