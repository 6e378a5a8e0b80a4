"""Portfolio tables: sector quota selection, capped weights and risk, for many dates at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitgrid.functions.groups import join_keys, top_k
from pitgrid.operators.asof import asof_join
from pitgrid.operators.series import daily_returns

# Portfolio limits.
MAX_NAME_WEIGHT = 0.05
SECTOR_ACTIVE_LIMIT = 0.08
MIN_POSITIONS = 20
MAX_POSITIONS = 30
PASSES = 10


def sector_targets(candidates: DataFrame) -> DataFrame:
    """Share of rows per sector and date."""
    total = candidates.groupBy("signal_date").agg(F.count(F.lit(1)).alias("_n"))
    return candidates.groupBy("signal_date", "sector").agg(F.count(F.lit(1)).alias("_s")).join(total, "signal_date").select(
        "signal_date", "sector", (F.col("_s") / F.col("_n")).alias("sector_target")
    )


def select_sector_quota(candidates: DataFrame, targets: DataFrame, score: str = "score", max_positions: int = MAX_POSITIONS) -> DataFrame:
    """Per sector the names its lower limit needs, then the best of the rest, by score to 30.

    At most 30 names per sector and 30 of the rest can ever be chosen, so per-group limits
    (taken before the shuffle) leave a short list per date.
    """
    order = [F.col(score).desc(), F.col("company_id").asc()]
    c = candidates.where(F.col(score).isNotNull())
    need = F.ceil(F.round(F.greatest(F.col("sector_target") - SECTOR_ACTIVE_LIMIT, F.lit(0.0)) / MAX_NAME_WEIGHT, 9))
    in_sector = top_k(c, ["signal_date", "sector"], order, max_positions, "_sr")
    short = join_keys(in_sector, targets, ["signal_date", "sector"], "left")
    short = short.withColumn("_must", F.coalesce(F.col("_sr") <= need, F.lit(False)))
    out = top_k(short, ["signal_date"], [F.col("_must").desc(), *order], max_positions, "_pick")
    w = W.partitionBy("signal_date").orderBy(*order)
    return out.withColumn("pick", F.row_number().over(w)).drop("_sr", "_pick").withColumnRenamed("_must", "quota")


def capped_score_weights(selected: DataFrame, min_positions: int = MIN_POSITIONS) -> DataFrame:
    """Fully invested weights: at most 5% each, sectors within 8 points of target, by rank.

    ``selected`` is the short list of B11 (30 names at most per date). Sector budgets start
    at the target limited by what the sector may and can hold; what is missing goes to the
    room left. Inside a sector the weight is proportional to the reversed rank; what a cap
    cuts off is shared out again in a fixed number of passes, the rest by room. Dates where
    the limits cannot be met (or with too few names) give no portfolio.
    """
    d, s = W.partitionBy("signal_date"), W.partitionBy("signal_date", "sector")
    df = selected.withColumn("_names", F.count(F.lit(1)).over(d)).where(F.col("_names") >= min_positions)
    df = df.withColumn("_in", F.count(F.lit(1)).over(s)).withColumn("_target", F.coalesce("sector_target", F.lit(0.0)))
    cap = F.least(F.col("_target") + SECTOR_ACTIVE_LIMIT, F.col("_in") * MAX_NAME_WEIGHT)
    df = df.withColumn("_cap", cap).withColumn("_b0", F.least("_target", "_cap"))
    per_row = lambda c: F.sum(F.col(c) / F.col("_in")).over(d)  # noqa: E731  sum over sectors
    df = df.withColumn("_capsum", per_row("_cap")).withColumn("_b0sum", per_row("_b0")).where(F.col("_capsum") >= 1 - 1e-9)
    room = F.col("_cap") - F.col("_b0")
    grow = F.when(F.col("_b0sum") < 1, (1 - F.col("_b0sum")) * room / F.nullif(F.col("_capsum") - F.col("_b0sum"), F.lit(0.0))).otherwise(0.0)
    df = df.withColumn("_b", F.col("_b0") + F.coalesce(grow, F.lit(0.0)))
    df = df.withColumn("_r", (F.col("_names") - F.col("pick") + 1).cast("double")).withColumn("weight", F.lit(0.0))
    for _ in range(PASSES):
        free = F.when(F.col("weight") < MAX_NAME_WEIGHT - 1e-12, F.col("_r")).otherwise(0.0)
        df = df.withColumn("_free", free).withColumn("_left", F.col("_b") - F.sum("weight").over(s)).withColumn("_rs", F.sum("_free").over(s))
        add = F.when(F.col("_rs") > 0, F.col("_left") * F.col("_free") / F.col("_rs")).otherwise(0.0)
        df = df.withColumn("weight", F.least(F.col("weight") + add, F.lit(MAX_NAME_WEIGHT)))
    df = df.withColumn("_left", F.col("_b") - F.sum("weight").over(s)).withColumn("_room", F.lit(MAX_NAME_WEIGHT) - F.col("weight"))
    df = df.withColumn("_roomsum", F.sum("_room").over(s))
    df = df.withColumn("weight", F.col("weight") + F.when(F.col("_roomsum") > 1e-15, F.col("_left") * F.col("_room") / F.col("_roomsum")).otherwise(0.0))
    return df.select(*selected.columns, "weight")


def portfolio_risk(books: DataFrame, prices: DataFrame, sessions: int = 252) -> DataFrame:
    """Variance and volatility of each book from daily returns, missing ones as 0.

    w'Cov w equals the sample variance of the book's own daily return, so no matrix of pairs
    is formed; the diagonal term adds 1e-6 times the sum of squared weights. Under 20 sessions
    the covariance is 0.04 on the diagonal.
    """
    w = W.partitionBy("_k").orderBy("price_date")  # one row per trading day
    days = prices.select("price_date").distinct().withColumn("_k", F.lit(1)).withColumn("_no", F.row_number().over(w))
    r = daily_returns(prices).join(days.drop("_k"), "price_date")
    marks = asof_join(books.select("signal_date").distinct().withColumn("_k", F.lit(1)), days, ["_k"], "signal_date", "price_date", ["_no"])
    marks = marks.select("signal_date", F.col("_no").alias("_last"))
    b = books.join(marks, "signal_date")
    # a window of sessions lies in two buckets of that many sessions
    bucket = F.floor(F.col("_last") / sessions)
    near = b.withColumn("_bucket", F.explode(F.array(bucket, bucket - 1)))
    hit = near.join(r.withColumn("_bucket", F.floor(F.col("_no") / sessions)), ["company_id", "_bucket"]).where((F.col("_no") <= F.col("_last")) & (F.col("_no") > F.col("_last") - sessions))
    daily = hit.groupBy("strategy", "signal_date", "_no").agg(F.sum(F.col("weight") * F.col("ret")).alias("x"))
    sums = daily.groupBy("strategy", "signal_date").agg(F.sum("x").alias("_sx"), F.sum(F.col("x") * F.col("x")).alias("_sxx"))
    base = b.groupBy("strategy", "signal_date").agg(F.sum(F.col("weight") * F.col("weight")).alias("_ww"), F.least(F.max("_last"), F.lit(sessions)).alias("sessions"))
    j = base.join(sums, ["strategy", "signal_date"], "left").fillna(0.0, ["_sx", "_sxx"])
    n = F.col("sessions")
    sample = (F.col("_sxx") - F.col("_sx") * F.col("_sx") / n) / (n - 1) * 252
    var = F.when(n >= 20, sample).otherwise(0.04 * F.col("_ww")) + 1e-6 * F.col("_ww")
    return j.select("strategy", "signal_date", "sessions", var.alias("variance"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("expected_volatility"))
