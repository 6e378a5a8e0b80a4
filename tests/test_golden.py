"""Hand-made frames with exact expectations."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pitgrid.operators import asof, factors, ingest, learning, membership, performance, portfolio, screens, series, text
from pitgrid.sources import readers, writers

D = date.fromisoformat


def ts(s):
    return datetime.fromisoformat(s)


def dates(spark, *days):
    return spark.createDataFrame([(D(d),) for d in days], "signal_date date")


FACT = "company_id string, metric string, period_end date, effective_at timestamp_ntz, as_of_date date, ingested_at timestamp_ntz, value double, unit string, source_file_id string"


def fact(v, eff, asof_day, period="2024-06-30", ing="2024-12-01T00:00:00"):
    return ("c", "revenue", D(period), ts(eff), D(asof_day), ts(ing), v, "USD", "s")


def test_fact_vintages_become_visible_only_when_public_and_exported(spark):
    facts = spark.createDataFrame([fact(100.0, "2024-08-01T12:00:00", "2024-08-15"), fact(110.0, "2024-08-01T12:00:00", "2024-09-15")], FACT)
    out = asof.latest_asof_facts(facts, dates(spark, "2024-08-14", "2024-08-31", "2024-09-30"), "period_end")
    assert {(str(r.signal_date), r.value) for r in out.collect()} == {("2024-08-31", 100.0), ("2024-09-30", 110.0)}


def test_late_fact_of_an_older_period_does_not_replace_a_newer_one(spark):
    facts = spark.createDataFrame(
        [fact(5.0, "2024-08-01T12:00:00", "2024-08-15", "2024-06-30"), fact(1.0, "2024-09-01T12:00:00", "2024-09-15", "2024-03-31")], FACT)
    out = asof.latest_asof_facts(facts, dates(spark, "2024-12-31"), "period_end").collect()
    assert [r.value for r in out] == [5.0]


def test_future_rows_change_nothing(spark):
    base = [fact(100.0, "2024-08-01T12:00:00", "2024-08-15")]
    later = base + [fact(999.0, "2025-02-01T12:00:00", "2025-02-15", "2024-12-31")]
    day = dates(spark, "2024-09-30")
    one, two = (asof.latest_asof_facts(spark.createDataFrame(x, FACT), day, "period_end").collect() for x in (base, later))
    assert one == two


def test_universe_follows_renames_and_sectors(spark):
    inst = spark.createDataFrame(
        [("c", "OLD", "Name", "Energy", ts("2019-01-01T00:00:00"), D("2019-01-01")), ("c", "NEW", "Name", "Technology", ts("2023-01-01T00:00:00"), D("2023-01-01"))],
        "company_id string, ticker string, company_name string, sector string, effective_at timestamp_ntz, as_of_date date")
    mem = spark.createDataFrame(
        [("c", "OLD", "SP500", D("2019-01-01"), D("2022-12-31"), ts("2019-01-01T00:00:00")), ("c", "NEW", "SP500", D("2023-01-01"), None, ts("2023-01-01T00:00:00"))],
        "company_id string, ticker string, index_code string, member_from date, member_to date, effective_at timestamp_ntz")
    out = asof.universe_asof(mem, inst, dates(spark, "2020-06-30", "2024-06-30"))
    assert {(r.signal_date.year, r.ticker, r.sector) for r in out.collect()} == {(2020, "OLD", "Energy"), (2024, "NEW", "Technology")}


def test_inverse_multiple_is_calibrated(spark):
    rows = [("d", 100_000.0, 1_000.0, 10.0), ("d", 200_000.0, 2_000.0, 10.0), ("d", 300_000.0, 3_000.0, 10.0), ("d", -400_000.0, 4_000.0, None)]
    df = spark.createDataFrame(rows, "signal_date string, net_income double, market_cap double, price_to_earnings double")
    out = factors.calibrated_inverse_multiples(df, ["signal_date"], {"y": ("net_income", "market_cap", "price_to_earnings")})
    assert sorted(round(r.y, 9) for r in out.collect()) == [-0.1, 0.1, 0.1, 0.1]


def test_revision_breadth(spark):
    rows = [(10.0, 7.0, 3.0, 8.0, 1.0), (1.0, 4.0, 0.0, 0.0, 4.0), (None, 1.0, 3.0, 1.0, 3.0)]
    cols = "eps_analyst_count_1m double, eps_up_revisions_1m double, eps_down_revisions_1m double, eps_up_revisions_3m double, eps_down_revisions_3m double"
    out = factors.revision_breadth(spark.createDataFrame(rows, cols)).collect()
    assert [round(r.eps_revision_1m, 9) for r in out] == [0.4, 1.0, -0.5]
    assert [round(r.eps_revision_3m, 9) for r in out] == [0.7, -1.0, -0.5]


def test_estimate_change_keeps_the_fiscal_target(spark):
    def e(c, p, a, v):
        return (c, "eps_estimate", D(p), D(a), ts(a + "T18:00:00"), ts(a + "T20:00:00"), v)

    rows = [e("A", "2024-12-31", "2024-05-31", 10.0), e("A", "2024-12-31", "2024-07-31", 12.1), e("A", "2024-12-31", "2024-08-31", 13.31),
            e("B", "2024-12-31", "2024-07-31", 5.0), e("B", "2025-12-31", "2024-08-31", 6.0), e("C", "2024-12-31", "2024-07-31", -2.0), e("C", "2024-12-31", "2024-08-31", -1.0)]
    df = spark.createDataFrame(rows, "company_id string, metric string, fiscal_period date, as_of_date date, effective_at timestamp_ntz, ingested_at timestamp_ntz, value double")
    out = {r.company_id: r for r in factors.estimate_change_asof(df, dates(spark, "2024-08-31")).collect()}
    assert out["A"].change_1m == pytest.approx(0.1) and out["A"].change_3m == pytest.approx(0.331)
    assert out["B"].change_1m is None and out["C"].change_1m == pytest.approx(0.5)


def test_score_needs_four_families(spark):
    cols = ", ".join(f"{c} double" for c in factors.FAMILY_COLUMNS)
    rows = [(1.0, None, None, None, 1.0, None), (0.5, 0.5, None, None, 0.25, 0.25)]
    assert [r.factor_score for r in factors.factor_score(spark.createDataFrame(rows, cols)).collect()] == [None, 0.375]


def test_symbol_reuse_is_rejected_and_renames_tracked(spark):
    mem = spark.createDataFrame([("c", "OLD", D("2010-01-01"), D("2015-12-31")), ("c", "NEW", D("2016-01-01"), None)], "company_id string, ticker string, member_from date, member_to date")
    rows = spark.createDataFrame([("c", "OLD", D("2014-06-30")), ("c", "OLD", D("2020-06-30")), ("c", "NEW", D("2015-06-30")), ("x", "ZZZ", D("2020-06-30"))], "company_id string, ticker string, price_date date")
    got = {(r.ticker, str(r.price_date)): r.ticker_at_date for r in asof.ticker_asof(rows, mem).collect()}
    assert got == {("OLD", "2014-06-30"): "OLD", ("OLD", "2020-06-30"): None, ("NEW", "2015-06-30"): "OLD", ("ZZZ", "2020-06-30"): "ZZZ"}


def test_ticker_change_starts_an_interval_and_classes_collapse(spark):
    seed = spark.createDataFrame([("GOOG",), ("GOOGL",), ("FB",)], "ticker string")
    ev = spark.createDataFrame([("FB", D("2022-06-09"), "removed"), ("META", D("2022-06-09"), "added"), ("GOOGL", D("2023-01-01"), "removed")], "ticker string, day date, action string")
    cmap = spark.createDataFrame([("FB", "1"), ("META", "1"), ("GOOGL", "2")], "ticker string, company_id string")
    out = membership.membership_intervals(seed, ev, F.lit("2020-01-01").cast("date"), cmap, membership.share_class_table(spark))
    assert {(r.company_id, r.ticker, str(r.member_from), str(r.member_to)) for r in out.collect()} == {
        ("1", "FB", "2020-01-01", "2022-06-08"), ("1", "META", "2022-06-09", "None"), ("2", "GOOGL", "2020-01-01", "2022-12-31"), ("2", "GOOG", "2023-01-01", "None")}


def test_transaction_cost_and_repricing(spark):
    df = spark.createDataFrame([(0.02, 0.25)], "g double, t double").select(performance.apply_cost(F.col("g"), F.col("t"), 10.0).alias("n"))
    assert df.first().n == pytest.approx(0.01975)
    r = spark.createDataFrame([("s", D("2024-01-31"), 0.02, 0.01, 0.2)], "strategy string, date date, ret double, bench double, turnover double")
    assert performance.reprice(r, 10.0, (5.0,)).first().ret == pytest.approx(0.0201 - 0.02 + 0.02)


def test_capped_weights_keep_every_limit(spark):
    rows = [("2024-01-31", str(i), f"T{i}", f"S{i % 5}", float(i % 17) + i / 100) for i in range(60)]
    c = spark.createDataFrame(rows, "signal_date string, company_id string, ticker string, sector string, score double")
    targets = portfolio.sector_targets(c)
    w = portfolio.capped_score_weights(portfolio.select_sector_quota(c, targets)).collect()
    assert sum(r.weight for r in w) == pytest.approx(1.0, abs=1e-9) and max(r.weight for r in w) <= 0.05 + 1e-9
    for s in {r.sector for r in w}:
        assert abs(sum(r.weight for r in w if r.sector == s) - 0.2) <= 0.08 + 1e-9


def test_same_month_training_is_refused(spark):
    p = spark.createDataFrame([(D("2024-01-31"), 1.0)], "signal_date date, x double")
    with pytest.raises(learning.LookAheadError):
        learning.check_no_look_ahead(p, p)


@pytest.mark.parametrize("raw,want", [
    ("XAUUSD+", "GC=F"), ("btcusd", "BTC-USD"), ("BTC-USDT", "BTC-USD"), ("EURUSD", "EURUSD=X"), ("aapl", "AAPL"), ("BRK.B", "BRK.B"), ("ABCUSD", "ABCUSD"), ("^gspc", "^GSPC"), ("US30", "^DJI")])
def test_symbols(spark, raw, want):
    assert spark.range(1).select(text.normalize_symbol(F.lit(raw)).alias("s")).first().s == want


@pytest.mark.parametrize("raw,want", [
    ("**Rating**: Buy", "Buy"), ("Final rating - **overweight**", "Overweight"), ("Rating：Sell", "Sell"), ("Holding is fine, buyers wait", None), ("I would hold this", "Hold"),
    ("Rating: strong\nRating: Underweight", "Underweight"), ("", None), ("The market rating: great. Sell now", "Sell")])
def test_ratings(spark, raw, want):
    assert spark.range(1).select(text.extract_rating(F.lit(raw)).alias("s")).first().s == want


def test_missing_required_columns_reject_a_file(spark):
    with pytest.raises(ingest.ContractError, match="period_end"):
        ingest.apply_contract(spark.createDataFrame([("1",)], "company_id string"), "fundamentals")


def test_authoritative_source_wins(spark):
    rows = [("c", D("2024-01-02"), s, float(i), ts("2024-01-03T00:00:00"), "f") for i, s in enumerate(("alpaca_iex_adjusted", "capital_iq", "yahoo_adjusted", "other"))]
    df = spark.createDataFrame(rows, "company_id string, price_date date, source string, close double, ingested_at timestamp_ntz, source_file_id string")
    assert asof.price_precedence(df).first().source == "capital_iq"


def test_merge_keeps_the_newest_load(spark):
    cols = "company_id string, price_date date, source string, close double, ingested_at timestamp_ntz, source_file_id string"
    old = spark.createDataFrame([("c", D("2024-01-02"), "capital_iq", 1.0, ts("2024-01-03T00:00:00"), "a")], cols)
    new = spark.createDataFrame([("c", D("2024-01-02"), "capital_iq", 2.0, ts("2024-01-04T00:00:00"), "b")], cols)
    assert [r.close for r in writers.merge_price_lake(old, new).collect()] == [2.0]


def test_bearish_screen_takes_only_the_weak_adverse_name(spark):
    rows = [("d", "1", -2.0, 0.0, 80.0, -0.2, -0.1, 0.6), ("d", "2", 0.1, 0.0, 10.0, 0.1, 0.1, 0.2), ("d", "3", 0.5, 0.0, 12.0, 0.2, 0.1, 0.2), ("d", "4", 1.0, 0.0, 15.0, 0.3, 0.2, 0.1)]
    df = spark.createDataFrame(rows, "signal_date string, company_id string, factor_score double, ml_score double, price_to_earnings double, revenue_growth double, eps_revision_1m double, volatility_252d double")
    out = screens.bearish_screen(df).collect()
    assert [(r.company_id, r.bearish_signal_count) for r in out] == [("1", 4)]


def test_ema_matches_a_plain_loop_across_blocks(spark):
    xs = [((i * 37) % 101) / 10 for i in range(1200)]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs)], "sym string, i int, close double")
    got = [r.e for r in series.ewm(df, "sym", "i", {"e": (F.col("close"), 1 / 14)}).orderBy("i").collect()]
    num = den = 0.0
    for g, x in zip(got, xs):
        num, den = x + num * 13 / 14, 1 + den * 13 / 14
        assert g == pytest.approx(num / den, rel=1e-9)


@pytest.mark.parametrize("n", [1, 2000])
def test_ema_of_any_span_is_exact(spark, n):
    xs = [((i * 37) % 101) / 10 for i in range(3000)]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs)], "sym string, i int, close double")
    got = [r.e for r in series.ema(df, "sym", "i", "close", n, "e").orderBy("i").collect()]
    num = den = 0.0
    for g, x in zip(got, xs, strict=True):
        q = 1 - 2 / (n + 1)
        num, den = x + num * q, 1 + den * q
        assert g == pytest.approx(num / den, rel=1e-9)


def test_decision_log_keeps_the_last_resolved_field_whole(spark, tmp_path):
    tail = "2024-02-09 " + "x" * 150
    fields = "2024-01-02 | T | Buy | +1% | -1% | 5d | resolved:2024-01-09 | " + "note | " * 120 + f"resolved:{tail}"
    (tmp_path / "log.md").write_text(f"[{fields}]\n\nDECISION:\nRating: Buy\n\n{readers.ENTRY_END}\n")
    assert [r.resolved for r in readers.scan_decision_log(spark, str(tmp_path)).collect()] == [tail]


def test_a_known_id_holds_for_the_whole_share_class_group(spark):
    roster = spark.createDataFrame([("UA",), ("UAA",)], "ticker string")
    known = spark.createDataFrame([("UA", "9")], "ticker string, company_id string")
    out = membership.collapse_share_classes(roster, known, membership.share_class_table(spark)).collect()
    assert [(r.company_id, r.ticker, r.n_classes) for r in out] == [("9", "UAA", 2)]


def test_total_loss_ends_the_wealth(spark):
    rows = [("s", D("2024-01-31"), 0.1, 0.0, 0.0), ("s", D("2024-02-29"), -1.0, 0.0, 0.0), ("s", D("2024-03-31"), 0.5, 0.01, 0.0)]
    df = spark.createDataFrame(rows, "strategy string, date date, ret double, bench double, turnover double")
    assert [round(r.wealth, 9) for r in performance.wealth_curve(df).orderBy("date").collect()] == [1.1, 0.0, 0.0]
    m = performance.strategy_metrics(df).first()
    assert m.cagr == -1.0 and m.max_drawdown == -1.0


def test_outcome_outside_the_window_stays_pending(spark):
    bars = [(s, D("2024-01-02") + timedelta(days=5 * i), 10.0 + i) for s in ("T", "SPY") for i in range(8)]
    b = spark.createDataFrame(bars, "ticker string, price_date date, close double")
    d = spark.createDataFrame([("T", D("2024-01-02"), "SPY")], "ticker string, trade_date date, benchmark string")
    assert series.holding_outcome(d, b).first().raw_return is None
    assert series.holding_outcome(d, b, max_days=None).first().raw_return == pytest.approx(0.5)
    assert series.holding_outcome(d, b, holding=2).first().raw_return == pytest.approx(0.2)


def test_months_without_history_get_neutral_scores(spark):
    rows = [(D(f"2024-0{m}-28"), str(i), 0.1 * i, 0.01 * i, 0.02 * i) for m in (1, 2, 3) for i in range(6)]
    p = spark.createDataFrame(rows, "signal_date date, company_id string, factor_score double, x double, next_month_excess_return double")
    out = learning.walk_forward(p, [D("2024-01-28"), D("2024-03-28")], ["x"]).collect()
    assert len(out) == 12 and {(r.elastic_score, r.tree_score, r.fitted) for r in out} == {(0.0, 0.0, False)}


def test_staging_uses_the_shared_folder(spark):
    from pitgrid.session import checkpoint_folder
    assert checkpoint_folder(spark) == spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")

    class Context:
        master = "spark://host:7077"
        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_folder(Session())


def _bars(late, days=330, seed=2):
    """Daily bars of two companies and the benchmark; ``late`` maps (company, number of the day) to days of delay."""
    import math
    out = []
    for c, ticker in (("1", "T1"), ("2", "T2"), ("BENCHMARK:SPY", "SPY")):
        px = 100.0
        for i in range(days):
            px *= 1 + 0.01 * math.sin(i * (1.3 + len(c)) + seed) + 0.001 * (i % 5)
            d = D("2023-01-02") + timedelta(days=i)
            out.append((c, ticker, d, px, "yahoo_adjusted", d + timedelta(days=late.get((c, i), 0)), d, "f"))
    return out


def _market(spark, bars, asks):
    df = spark.createDataFrame(bars, "company_id string, ticker string, price_date date, adjusted_close double, source string, effective_at date, as_of_date date, source_file_id string")
    df = df.withColumn("effective_at", F.col("effective_at").cast("timestamp_ntz")).withColumn("ingested_at", F.lit("2024-12-31").cast("timestamp_ntz"))
    members = spark.createDataFrame(asks, "signal_date date, company_id string")
    return {(r.signal_date, r.company_id): tuple(r)[2:] for r in factors.market_features(df, members).collect()}


def test_bars_published_later_change_nothing_before(spark):
    """A statistic on a date equals that of a table without the bars that were not public then; once public, a late bar counts like any other."""
    import statistics
    late = {("1", 100): 250, ("1", 290): 20, ("2", 300): 3, ("BENCHMARK:SPY", 280): 15}
    days = [D("2023-01-02") + timedelta(days=i) for i in (295, 301, 305, 325)]
    asks = [(d, c) for d in days for c in ("1", "2")]
    bars = _bars(late)
    got = _market(spark, bars, asks)
    assert len(got) == len(asks)
    for d, c in asks:
        public = [b[:5] + (b[6],) + b[6:] for b in bars if b[5] <= d]
        want = _market(spark, public, [(d, c)])[d, c]
        assert got[d, c] == pytest.approx(want, rel=1e-9)
        seen = [b[3] for b in public if b[0] == c and b[2] <= d]
        rets = [y / x - 1 for x, y in zip(seen, seen[1:])]
        assert got[d, c][:3] == pytest.approx((seen[-22] / seen[-253] - 1, seen[-22] / seen[-127] - 1, statistics.pstdev(rets[-252:]) * 252**0.5), rel=1e-9)
    on_time = _market(spark, _bars({}), asks)
    assert got[days[0], "1"] != pytest.approx(on_time[days[0], "1"], rel=1e-9)
    assert got[days[2], "2"] == pytest.approx(on_time[days[2], "2"], rel=1e-9) and got[days[3], "1"][2] != pytest.approx(on_time[days[3], "1"][2], rel=1e-9)


def test_sql_functions_are_registered(spark):
    from pitgrid.functions.columns import register_sql_functions
    register_sql_functions(spark)
    r = spark.sql("SELECT safe_divide(1, 4) a, safe_divide(1, 0) b, winsor_z(9, 0, 5, 1, 2) c, winsor_z(1, 0, 5, 1, 0) d, winsor_z(NULL, 0, 5, 1, 2) e").first()
    assert tuple(r) == (0.25, None, 2.0, 0.0, None)


@pytest.mark.parametrize("start,end,spans,facts", [
    ("2020-01-01", "2022-01-01", "ends before", "ok"), ("2019-01-01", "2020-06-30", "begins after", "begins after"), ("2020-01-01", "2023-01-01", "ends before", "ends too early"), ("2020-01-01", "2021-01-01", "ok", "ok")])
def test_verdicts_of_spans(spark, start, end, spans, facts):
    from pitgrid.operators import quality
    at = [F.lit(x).cast("date") for x in (start, end)]
    m = spark.createDataFrame([("SP500", D("2020-01-01"), D("2021-06-30"))], "index_code string, member_from date, member_to date")
    assert quality.membership_span(m, *at).first().verdict == spans and quality.membership_span(m.limit(0), *at).first().verdict == "missing"
    f = spark.createDataFrame([(ts("2020-01-01T00:00:00"),), (ts("2021-06-30T10:00:00"),)], "effective_at timestamp_ntz")
    assert quality.freshness_span(f, *at).first().verdict == facts and quality.freshness_span(f.limit(0), *at).first().verdict == "missing"


def test_membership_sweep_equals_a_scan_of_days(spark):
    """Three classes of one company and one of another, opened and closed at random: the representative of every day, by a plain scan."""
    import random
    rng, events = random.Random(4), []
    for t in ("A", "A.B", "A.C", "Z"):
        for d in sorted(rng.sample(range(200), 12)):
            events.append((t, D("2020-01-01") + timedelta(days=d), rng.choice(["added", "removed"])))
    seed = ["A.B", "Z"]
    ev = spark.createDataFrame(events, "ticker string, day date, action string")
    sd = spark.createDataFrame([(t,) for t in seed], "ticker string")
    cm = spark.createDataFrame([("A", "1"), ("Z", "2")], "ticker string, company_id string")
    cl = spark.createDataFrame([("A", "A"), ("A.B", "A"), ("A.C", "A")], "ticker string, canonical string")
    got = membership.membership_intervals(sd, ev, F.lit("2019-12-31").cast("date"), cm, cl).collect()
    for company, tickers in (("1", ["A", "A.B", "A.C"]), ("2", ["Z"])):
        for i in range(-1, 210):
            day = D("2020-01-01") + timedelta(days=i)
            on = [t for t in tickers if next((a == "added" for x, d, a in reversed(events) if x == t and d <= day), t in seed)]
            want = None if not on else ("A" if "A" in on else "Z" if on == ["Z"] else min(on))
            held = [r.ticker for r in got if r.company_id == company and r.member_from <= day and (r.member_to is None or day <= r.member_to)]
            assert held == ([want] if want else []), (company, day)
