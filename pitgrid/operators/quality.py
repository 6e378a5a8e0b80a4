"""Data quality: coverage, gaps, spans, audits and the certification verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pitgrid.operators.asof import best_snapshot_per_period, expand_intervals

# Coverage rule and datasets.
MIN_COMPANIES = 400
MIN_SHARE = 0.90
REQUIRED_DATASETS = ("index_membership", "fundamentals", "estimates", "prices")
RESEARCH_DATASETS = ("fundamentals", "estimates")
AUTHORITATIVE_SOURCE = "capital_iq"


def source_status(source_files: DataFrame) -> DataFrame:
    """Q01: files, rows and latest import per dataset."""
    return source_files.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("files"), F.sum("row_count").alias("rows"), F.max("imported_at").alias("latest_import")
    )


def company_floor(source_files: DataFrame) -> Column:
    """400 companies, or 1 when any source is a synthetic fixture."""
    synthetic = source_files.agg(F.coalesce(F.bool_or(F.col("original_name").startswith("synthetic_")), F.lit(False))).scalar()
    return F.when(synthetic, F.lit(1)).otherwise(F.lit(MIN_COMPANIES))


def snapshot_counts(facts: DataFrame, membership: DataFrame, start: Column, end: Column, metric: str | None = None) -> DataFrame:
    """Q02, counts: active members and members present per snapshot date.

    Members present are found by joining the few (date, company) pairs of the facts, reduced
    map-side, to the members active that day.
    """
    f = facts.where(F.col("as_of_date").between(start, end))
    if metric:
        f = f.where(F.col("metric") == metric)
    present = f.select(F.col("as_of_date").alias("snapshot_date"), "company_id").distinct()
    dates = present.select("snapshot_date").distinct()
    m = membership.where(F.col("index_code") == "SP500").select("company_id", "member_from", "member_to")
    active = expand_intervals(m, dates, "member_from", "member_to", "snapshot_date").select("snapshot_date", "company_id").distinct()
    hit = active.join(present.withColumn("_p", F.lit(1)), ["snapshot_date", "company_id"], "left")
    return hit.groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("active_count"), F.count("_p").alias("covered"))


def snapshot_coverage(facts, membership, start: Column, end: Column, unit: str, floor: Column, metric: str | None = None) -> DataFrame:
    """Q02: best snapshot per month or quarter of the window and whether it is weak (missing ones are)."""
    best = best_snapshot_per_period(snapshot_counts(facts, membership, start, end, metric), unit)
    step = F.expr("INTERVAL 1 MONTH" if unit == "month" else "INTERVAL 3 MONTH")
    expected = facts.sparkSession.range(1).select(F.explode(F.sequence(F.trunc(start, unit), F.trunc(end, unit), step)).alias("period"))
    df = expected.join(best, "period", "left").fillna(0, ["covered", "active_count"]).fillna(0.0, ["ratio"])
    need = F.greatest(floor, F.ceil(F.round(F.col("active_count") * MIN_SHARE, 9)))
    return df.withColumn("weak", (F.col("active_count") == 0) | (F.col("covered") < need))


def universe_gaps(membership, fundamentals, estimates, instruments, start: Column, end: Column) -> DataFrame:
    """Q03: members of the window that lack fundamentals, estimates or identity."""
    m = membership.where((F.col("index_code") == "SP500") & (F.col("member_from") <= end) & (F.col("member_to").isNull() | (F.col("member_to") >= start)))
    h = m.groupBy("company_id", "ticker").agg(F.min("member_from").alias("first_member"), F.max(F.coalesce("member_to", end)).alias("last_member"))
    inside = F.col("as_of_date").between(start, end)
    ids = {
        "needs_fundamentals": fundamentals.where(inside), "needs_estimates": estimates.where(inside & (F.col("metric") == "eps_estimate")),
        "needs_instrument_identity": instruments,
    }
    for flag, df in ids.items():
        h = h.join(df.select("company_id").distinct().withColumn(flag, F.lit(False)), "company_id", "left").fillna(True, [flag])
    return h.where(" OR ".join(ids))


def gap_summary(gaps: DataFrame) -> DataFrame:
    """S16, counts of the manifest."""
    return gaps.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("ticker").alias("unique_tickers"),
        *[F.count_if(c).alias(c) for c in ("needs_fundamentals", "needs_estimates", "needs_instrument_identity")],
    )


def relevant_errors(issues, fundamentals, estimates, start: Column, end: Column, required: Sequence[str] = REQUIRED_DATASETS) -> DataFrame:
    """Q04: error issues that matter: research datasets only without a source or with one used in the window."""
    inside = F.col("as_of_date").between(start, end)
    used = fundamentals.where(inside).select(F.lit("fundamentals").alias("dataset"), "source_file_id").union(
        estimates.where(inside).select(F.lit("estimates"), "source_file_id")).distinct()
    e = issues.where((F.col("severity") == "error") & F.col("dataset").isin(*required))
    research = F.col("dataset").isin(*RESEARCH_DATASETS) & F.col("source_file_id").isNotNull()
    kept = e.where(~research).select("dataset", "code").unionByName(e.where(research).join(used, ["dataset", "source_file_id"], "left_semi").select("dataset", "code"))
    return kept.groupBy("dataset", "code").agg(F.count(F.lit(1)).alias("count"))


def membership_span(membership: DataFrame, start: Column, end: Column) -> DataFrame:
    """Q05: first start, last end, open spells and the verdict against the window."""
    a = membership.where(F.col("index_code") == "SP500").agg(
        F.min("member_from").alias("first_member"), F.max("member_to").alias("last_member"), F.count_if(F.col("member_to").isNull()).alias("open_spells"))
    verdict = (
        F.when(F.col("first_member").isNull(), "missing").when(F.col("first_member") > start, "begins after")
        .when((F.col("open_spells") == 0) & (F.col("last_member") < end), "ends before").otherwise("ok")
    )
    return a.withColumn("verdict", verdict)


def price_span(prices: DataFrame, start: Column, end: Column) -> DataFrame:
    """Q06: date span, sources, substitute sources and the verdict."""
    a = prices.agg(F.min("price_date").alias("first_price"), F.max("price_date").alias("last_price"), F.array_sort(F.collect_set("source")).alias("_s"))
    subs = F.filter("_s", lambda s: s != AUTHORITATIVE_SOURCE)
    verdict = F.when(F.col("first_price").isNull(), "missing").when((F.col("first_price") > start) | (F.col("last_price") < end), "does not span").otherwise("ok")
    return a.select("first_price", "last_price", F.size("_s").alias("n_sources"), F.array_join(subs, ", ").alias("substitutes"), verdict.alias("verdict"))


def freshness_span(fundamentals: DataFrame, start: Column, end: Column) -> DataFrame:
    """Q07: first and last availability against the window (15 months of slack at its end)."""
    a = fundamentals.agg(F.to_date(F.min("effective_at")).alias("first"), F.to_date(F.max("effective_at")).alias("last"))
    verdict = (
        F.when(F.col("first").isNull(), "missing").when(F.col("first") > start, "begins after")
        .when(F.col("last") < F.add_months(end, -15), "ends too early").otherwise("ok")
    )
    return a.withColumn("verdict", verdict)


def substitute_sources(source_files: DataFrame, dataset: str = "index_membership") -> DataFrame:
    """Q08: providers whose metadata says the data is not the vendor's."""
    meta = F.from_json("metadata_json", "provider string, capital_iq_data boolean")
    return source_files.where(F.col("dataset") == dataset).withColumn("m", meta).where(F.col("m.capital_iq_data") == F.lit(False)).select(
        F.coalesce("m.provider", F.lit("unknown_public_source")).alias("provider")).distinct()


def certify(source_files, membership, fundamentals, estimates, prices, issues, start: Column, end: Column) -> DataFrame:
    """Q09: ordered notes, each saying whether it blocks, and the overall flag."""
    spark, floor = source_files.sparkSession, company_floor(source_files)
    status = source_files.select("dataset").distinct()
    required = spark.range(1).select(F.explode(F.array(*[F.lit(d) for d in REQUIRED_DATASETS])).alias("dataset"))
    note = lambda df, order, text, blocks: df.select(F.lit(order).alias("seq"), text.alias("note"), F.lit(blocks).alias("blocks"))
    missing = required.join(status, "dataset", "left_anti")
    fresh = freshness_span(fundamentals, start, end).where("verdict <> 'ok'")
    weak_q = snapshot_coverage(fundamentals, membership, start, end, "quarter", floor).where("weak").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    weak_m = snapshot_coverage(estimates, membership, start, end, "month", floor, "eps_estimate").where("weak").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    span, px = membership_span(membership, start, end).where("verdict <> 'ok'"), price_span(prices, start, end)
    errors = relevant_errors(issues, fundamentals, estimates, start, end)
    notes = [
        note(missing, 1, F.concat(F.lit("missing dataset: "), "dataset"), True),
        note(fresh, 2, F.concat(F.lit("fundamentals: "), "verdict"), True),
        note(weak_q, 3, F.concat(F.lit("weak fundamental quarters: "), F.col("n").cast("string")), True),
        note(weak_m, 4, F.concat(F.lit("weak estimate months: "), F.col("n").cast("string")), True),
        note(errors, 5, F.concat_ws(" ", "dataset", "code", F.col("count").cast("string")), True),
        span.select(F.lit(6).alias("seq"), F.concat(F.lit("membership: "), "verdict").alias("note"), F.col("verdict").isin("missing", "begins after").alias("blocks")),
        note(substitute_sources(source_files), 7, F.concat(F.lit("membership substitute: "), "provider"), False),
        note(px.where("verdict <> 'ok'"), 8, F.concat(F.lit("prices: "), "verdict"), True),
        note(px.where("substitutes <> ''"), 9, F.concat(F.lit("price substitutes: "), "substitutes"), False),
    ]
    out = notes[0]
    for n in notes[1:]:
        out = out.unionByName(n)
    blocked = out.groupBy().agg(F.coalesce(F.bool_or("blocks"), F.lit(False)).alias("b"))
    passed = blocked.where("NOT b").select(F.lit(10).alias("seq"), F.lit("all checks passed").alias("note"), F.lit(False).alias("blocks"))
    return out.unionByName(passed)


def snapshot_audit(facts: DataFrame, period: str) -> DataFrame:
    """Q10: rows, companies, metrics and look-ahead counts per snapshot date."""
    return facts.groupBy("as_of_date").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("company_id").alias("companies"), F.count_distinct("metric").alias("metrics"),
        F.count_if(F.to_date("effective_at") > F.col("as_of_date")).alias("future_effective"),
        F.count_if(F.col(period) > F.col("as_of_date")).alias("future_period"), F.count_if(F.col(period).isNull()).alias("missing_period"),
    )


def duplicate_grain(facts: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Q11: groups on the grain with more than one row."""
    return facts.groupBy(*grain).count().where("count > 1")


def metric_coverage(facts: DataFrame) -> DataFrame:
    """Q12: companies per snapshot date and metric."""
    return facts.groupBy("as_of_date", "metric").agg(F.count_distinct("company_id").alias("companies"))


def issue_list(issues: DataFrame, n: int = 200) -> DataFrame:
    """Q13: newest n issues."""
    return issues.orderBy(F.col("created_at").desc(), F.col("issue_id").desc()).limit(n)


def symbols_without_bars(requested: DataFrame, bars: DataFrame) -> DataFrame:
    """Q14: requested symbols that returned no bar."""
    return requested.select("ticker").distinct().join(bars.select("ticker").distinct(), "ticker", "left_anti")


def feed_readiness(source_files: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Q15: expected datasets with their rows; those without raise a readiness warning."""
    want = source_files.sparkSession.range(1).select(F.explode(F.array(*[F.lit(d) for d in expected])).alias("dataset"))
    rows = source_files.groupBy("dataset").agg(F.sum("row_count").alias("rows"))
    out = want.join(rows, "dataset", "left").fillna(0, ["rows"])
    return out.withColumn("code", F.when(F.col("rows") == 0, F.concat(F.upper("dataset"), F.lit("_READINESS"))))
