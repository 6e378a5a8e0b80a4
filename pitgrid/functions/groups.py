"""Ranks, quantiles, running sums and latest-row picks that survive one hot group.

None of these puts a whole group into one task. Values of a group are spread over
value-ordered buckets; the bucket of a value is a fixed function of the value alone
(64 steps per power of two), so a recomputed task always lands in the same bucket.
Order inside a bucket comes from a window on (keys, bucket), and what lies below the
bucket from a sum over the few bucket totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitgrid.functions.staging import stage

_STEPS = 64.0
_SHIFT = 1_200 * _STEPS  # above the smallest exponent of a double


def value_bucket(value: Column | str) -> Column:
    """Monotone bucket number of a double."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    size = F.floor(F.log2(F.abs(v)) * _STEPS) + F.lit(_SHIFT).cast("long")
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, size).otherwise(-size)


def _offsets(totals: DataFrame, keys: Sequence[str], bucket: str, amount: str, before: str, overall: str) -> DataFrame:
    """Sum over the lower buckets of a group, and over all; one row per bucket, so small."""
    w = W.partitionBy(*keys).orderBy(bucket)
    return totals.select(
        *keys,
        bucket,
        F.coalesce(F.sum(amount).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before),
        F.sum(amount).over(W.partitionBy(*keys)).alias(overall),
    )


def value_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per group and distinct non-NULL value: rows equal, rows below, rows in all.

    Columns: keys, ``value``, ``n_eq``, ``n_below``, ``n_all``. Equal values are counted
    map-side first, so a value that holds most of a group is one row here.
    """
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias(value))
        .agg(F.count(F.lit(1)).alias("n_eq"))
        .withColumn("_b", value_bucket(value))
    )
    totals = counts.groupBy(*keys, "_b").agg(F.sum("n_eq").alias("_t"))
    offsets = _offsets(totals, keys, "_b", "_t", "_before", "n_all")
    inside = W.partitionBy(*keys, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_inside", F.coalesce(F.sum("n_eq").over(inside), F.lit(0)))
    return (
        join_keys(counts, offsets, [*keys, "_b"])
        .select(*keys, value, "n_eq", (F.col("_before") + F.col("_inside")).alias("n_below"), "n_all")
    )


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", few: bool = False) -> DataFrame:
    """Null-safe equi join that keeps one copy of the keys (NULL is a group of its own).

    ``few`` says that the groups are those of the calendar (dates, sectors, features), so few that ``right`` is sent to all tasks and the rows stay where they are.
    """
    keys = list(keys)
    r = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(F.broadcast(r) if few else r, cond, how).drop(*[f"_r_{k}" for k in keys])


def join_days(left: DataFrame, right: DataFrame, days: Sequence[str], how: str = "inner", broadcast: bool = True) -> DataFrame:
    """Equi join on dates with a table of the calendar, no more than a few rows per date, which is sent to all tasks.

    Asked for by name, since from file sizes Spark may take the rows of the other side for the smaller table. The keys are day numbers: a relation of
    numbers is as large as its rows, one of dates takes a whole memory page of the driver (up to 64 MB).
    """
    days = list(days)
    r = right.select(*[F.unix_date(c).alias(f"_n_{c}") if c in days else F.col(c) for c in right.columns])
    cond = None
    for c in days:
        same = F.unix_date(c) == F.col(f"_n_{c}")
        cond = same if cond is None else cond & same
    return left.join(F.broadcast(r) if broadcast else r, cond, how).drop(*[f"_n_{c}" for c in days])


def with_average_ranks(
    df: DataFrame, keys: Sequence[str], row: Sequence[str], ranks: dict[str, str], pct: bool = True
) -> DataFrame:
    """Average-tie ranks of several columns within ``keys``, in one pass over a long table.

    ``row`` names the columns that identify a row inside its group. NULL stays NULL; with
    ``pct`` the rank is divided by the group's non-NULL count.
    """
    keys, row = list(keys), list(row)
    if len(ranks) == 1:  # no long table needed
        (c, out), = ranks.items()
        rank = F.col("n_below") + (F.col("n_eq") + 1) / 2.0
        pos = value_positions(df, keys, c).select(*keys, F.col(c).alias("_v"), (rank / F.col("n_all") if pct else rank).alias(out))
        return join_keys(df.withColumn("_v", F.col(c).cast("double")), pos, [*keys, "_v"], "left").drop("_v")
    return join_keys(df, average_ranks(df, keys, row, ranks, pct).drop("n_rows"), [*keys, *row], "left")


def average_ranks(df: DataFrame, keys: Sequence[str], row: Sequence[str], ranks: dict[str, str], pct: bool = True) -> DataFrame:
    """Keys, ``row`` and the ranks of ``with_average_ranks`` without the other columns, so nothing is joined back.

    One row per ``row`` with a value; ``n_rows`` is the most values that one column has there, so the number of its rows in ``df`` where none is NULL.
    """
    keys, row = list(keys), list(row)
    rank = F.col("n_below") + (F.col("n_eq") + 1) / 2.0
    long = df.select(*keys, *row, *[F.col(c).cast("double").alias(c) for c in ranks]).unpivot([*keys, *row], list(ranks), "_f", "_v")
    long = long.where(F.col("_v").isNotNull())
    pos = value_positions(long, [*keys, "_f"], "_v").select(
        *keys, "_f", "_v", (rank / F.col("n_all") if pct else rank).alias("_r")
    )
    return join_keys(long, pos, [*keys, "_f", "_v"]).groupBy(*keys, *row).agg(
        *[F.max(F.when(F.col("_f") == c, F.col("_r"))).alias(out) for c, out in ranks.items()],
        F.greatest(*[F.count_if(F.col("_f") == c) for c in ranks]).alias("n_rows"),
    )


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], few: bool = False) -> DataFrame:
    """Exact linear-interpolated quantiles per group: keys, ``n_all``, one column per name in ``probs``.

    All rows only go through a map-side count per bucket. The few buckets that hold a wanted
    position are then read again and ordered. ``few`` as in ``join_keys``.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value), value_bucket(value).alias("_b"))
    totals = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_t"))
    spans = _wanted_buckets(totals, keys, probs)
    counts = join_keys(rows, spans, [*keys, "_b"], few=few).groupBy(*keys, "_b", value).agg(
        F.count(F.lit(1)).alias("n_eq"), F.max("_before").alias("_before"), F.max("n_all").alias("n_all"))
    return _interpolated(counts, keys, value, probs)


def prefix_quantiles(df: DataFrame, keys: Sequence[str], day: str, ends: Sequence, value: str, probs: dict[str, float]) -> DataFrame:
    """``quantiles`` of the rows before each date of ``ends``: keys, ``end``, ``n_all``, one column per name in ``probs``.

    A row is not copied to the ends behind it: counts per bucket and day are, and the rows of the few buckets that hold a wanted position.
    """
    keys = list(keys)
    later = F.explode(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e > F.col(day))).alias("end")
    rows = df.where(F.col(value).isNotNull()).select(*keys, day, F.col(value).cast("double").alias(value), value_bucket(value).alias("_b"))
    by_day = rows.groupBy(*keys, "_b", day).agg(F.count(F.lit(1)).alias("_t"))
    totals = by_day.select(*keys, "_b", "_t", later).groupBy("end", *keys, "_b").agg(F.sum("_t").alias("_t"))
    spans = stage(_wanted_buckets(totals, ["end", *keys], probs), "wanted-buckets")  # two rows per end and group at most
    near = join_keys(rows, spans.select(*keys, "_b").distinct(), [*keys, "_b"]).groupBy(*keys, "_b", day, value).agg(F.count(F.lit(1)).alias("_n"))
    counts = join_keys(near, spans, [*keys, "_b"]).where(F.col("end") > F.col(day)).groupBy("end", *keys, "_b", value).agg(
        F.sum("_n").alias("n_eq"), F.max("_before").alias("_before"), F.max("n_all").alias("n_all"))
    return _interpolated(counts, ["end", *keys], value, probs)


def _wanted_buckets(totals: DataFrame, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Keys, bucket, rows below it and rows in all, of the buckets that hold a wanted position."""
    w = W.partitionBy(*keys).orderBy("_b")
    spans = totals.select(
        *keys, "_b", "_t", F.coalesce(F.sum("_t").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_t").over(W.partitionBy(*keys)).alias("n_all"),
    )
    wanted = F.lit(False)
    for e in _positions(probs).values():
        for idx in (F.floor(e), F.ceil(e)):
            wanted = wanted | ((F.col("_before") <= idx) & (idx < F.col("_before") + F.col("_t")))
    return spans.where(wanted).drop("_t")


def _positions(probs: dict[str, float]) -> dict[str, Column]:
    return {name: F.lit(float(p)) * (F.col("n_all") - 1) for name, p in probs.items()}


def _interpolated(counts: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles from the counts per value of the wanted buckets."""
    at = _positions(probs)
    inside = W.partitionBy(*keys, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("n_below", F.col("_before") + F.coalesce(F.sum("n_eq").over(inside), F.lit(0)))
    aggs = [F.max("n_all").alias("n_all")]
    for name, e in at.items():
        for tag, idx in (("lo", F.floor(e)), ("hi", F.ceil(e))):
            hit = (F.col("n_below") <= idx) & (idx < F.col("n_below") + F.col("n_eq"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{tag}"))
    out = counts.groupBy(*keys).agg(*aggs)
    cols = [(F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * (e - F.floor(e))).alias(n) for n, e in at.items()]
    return out.select(*keys, "n_all", *cols)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order_value: str,
    ties: Sequence[Column | str],
    amount: str,
    out: str,
    descending: bool = False,
) -> DataFrame:
    """Sum of ``amount`` over the rows before this one, ordered by a number and then by ``ties``."""
    keys = list(keys)
    bucket = value_bucket(-F.col(order_value) if descending else F.col(order_value))
    rows = df.withColumn("_b", bucket)
    totals = rows.groupBy(*keys, "_b").agg(F.sum(amount).alias("_t"))
    offsets = _offsets(totals, keys, "_b", "_t", "_rs_before", "_rs_all")
    first = F.col(order_value).desc() if descending else F.col(order_value).asc()
    w = W.partitionBy(*keys, "_b").orderBy(first, *ties).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_rs_inside", F.coalesce(F.sum(amount).over(w), F.lit(0.0)))
    return (
        join_keys(rows, offsets, [*keys, "_b"])
        .withColumn(out, F.col("_rs_before") + F.col("_rs_inside"))
        .drop("_b", "_rs_before", "_rs_inside", "_rs_all")
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the greatest by ``order`` (all descending), as one aggregate.

    ``max`` of a struct combines map-side, so a key with very many versions sends one row
    per task instead of all of them. The remaining columns end the struct and break ties.
    """
    keys = list(keys)
    rest = [c for c in (columns or df.columns) if c not in keys]
    order_cols = [(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)]
    packed = F.struct(*order_cols, *[F.col(c) for c in rest])
    out = df.groupBy(*keys).agg(F.max(packed).alias("_m"))
    picked = [c for c in (columns or df.columns)]
    return out.select(*[F.col(c) if c in keys else F.col(f"_m.{c}").alias(c) for c in picked])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First k rows per group; Spark limits each map partition before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)
