"""Steps whose work once grew faster than their rows, against plain forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitgrid.functions import groups
from pitgrid.operators import asof, boosting, factors, learning, series
from pitgrid.sources import writers


@pytest.mark.parametrize("n", [1, 14, 50, 200])
def test_long_means_come_from_short_frames(spark, n):
    rng = np.random.default_rng(n)
    rows = [(s, i, None if rng.random() < 0.2 else float(np.round(rng.normal(), 3))) for s, k in (("a", 450), ("b", 3), (None, 60)) for i in range(k)]
    rows[300] = ("a", 300, float("nan"))
    df = series.sma(spark.createDataFrame(rows, "s string, d int, v double"), "s", "d", "v", n, "m")
    assert n < 50 or f"-{n - 1}," not in df._jdf.queryExecution().toString()  # no frame of n rows
    got = {(r.s, r.d): r.m for r in df.collect()}
    assert df.columns == ["s", "d", "v", "m"] and len(got) == len(rows)
    for s in ("a", "b", None):
        v = [x for t, _, x in rows if t == s]
        for i in range(len(v)):
            some = [x for x in v[max(0, i - n + 1):i + 1] if x is not None]
            assert (got[s, i] is None) if not some else np.isclose(got[s, i], np.mean(some), rtol=0, atol=1e-12, equal_nan=True)


def test_quantiles_of_prefixes_copy_no_rows(spark):
    rng = np.random.default_rng(5)
    days = pd.date_range("2020-01-31", periods=30, freq="ME").date
    p = pd.DataFrame({"f": rng.choice(["x", "y"], 900, p=[0.9, 0.1]), "day": rng.choice(days, 900), "v": np.round(rng.standard_t(2, 900), 1)})
    p.loc[:200, "v"] = 0.0
    p.loc[850:, "v"] = np.nan
    df = spark.createDataFrame([(r.f, r.day, None if np.isnan(r.v) else float(r.v)) for r in p.itertuples()] + [("x", None, 9.0)], "f string, day date, v double")
    ends = [days[0], *days[3:], days[-1].replace(year=2030)]
    out = groups.prefix_quantiles(df, ["f"], "day", ends, "v", {"a": 0.1, "b": 0.5})
    got = {(r.f, r.end): (r.n_all, r.a, r.b) for r in out.collect()}
    want = {}
    for e in ends:
        for f, g in p[(p["day"] < e) & p["v"].notna()].groupby("f"):
            want[f, e] = (len(g), g["v"].quantile(0.1), g["v"].quantile(0.5))
    assert got.keys() == want.keys() and days[0] not in {e for _, e in got}
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_medians_of_training_sets_are_taken_by_prefix(spark, monkeypatch):
    asked, real = [], learning.prefix_quantiles
    monkeypatch.setattr(learning, "prefix_quantiles", lambda df, keys, day, ends, *rest: asked.append(len(ends)) or real(df, keys, day, ends, *rest))
    day = lambda m: __import__("datetime").date(2020, m, 28)
    df = spark.createDataFrame([(day(m), f"c{i}", float(m * i), 0.1) for m in range(1, 7) for i in range(5)], f"signal_date date, company_id string, a double, {learning.TARGET} double")
    sets = learning.training_sets(df, [day(3), day(6)], ["a"])
    assert asked == [2]
    for e in (3, 6):
        assert sets[day(e)].medians[0] == np.median([m * i for m in range(1, e) for i in range(5)])


@pytest.mark.parametrize("leaves", [2, 7, 16, 40])
def test_scores_follow_the_nodes(leaves):
    rng = np.random.default_rng(leaves)
    x = np.round(rng.normal(size=(3000, 3)), 1)
    model = boosting.boost(x, x[:, 0] * x[:, 1] + rng.normal(size=3000), 0.1, leaves, 5, 0.1)
    trees = int(np.frombuffer(model, "<i8", 1, 8)[0])
    nodes = np.frombuffer(model, boosting.NODE, offset=16 + 8 * trees)
    z = np.vstack([x[:200], [[np.nan, 0.0, np.inf]]])
    for row, got in zip(z, boosting.boosted_scores(model, z), strict=True):
        total = np.frombuffer(model, "<f8", 1)[0]
        for root in np.frombuffer(model, "<i8", trees, 16):
            at = root
            while nodes[at]["feature"] >= 0:
                at = nodes[at]["left"] if row[nodes[at]["feature"]] <= nodes[at]["cut"] else nodes[at]["right"]
            total += nodes[at]["value"]
        assert got == total


def test_the_register_counts_its_rows_once(spark):
    rows = spark.range(20).select(F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("source_file_id"), F.lit("d").alias("dataset"), F.when(F.col("id") < 15, "valid").otherwise("bad").alias("verdict"))
    at = F.lit("2002-01-01").cast("timestamp_ntz")
    known = spark.createDataFrame([("f1", "d", 9, "old"), ("z", "d", 4, "kept")], "source_file_id string, dataset string, row_count long, metadata_json string").withColumn("imported_at", at)
    known = known.select("source_file_id", "dataset", "row_count", "imported_at", "metadata_json")
    out = writers.source_register(known, rows, ["source_file_id", "dataset"], at)
    assert "Range (" not in out._jdf.queryExecution().toString()
    assert {(r.source_file_id, r.row_count) for r in out.collect()} == {("f0", 5), ("f1", 5), ("f2", 5), ("z", 4)}


def vendor_facts(spark, period):
    """Facts with repeats, ties, hidden rows and a null company; and the same as tuples."""
    rng = np.random.default_rng(11)
    at = lambda n: pd.Timestamp("2024-01-01") + pd.Timedelta(days=int(n))
    rows = []
    for i in range(400):
        e, a = rng.integers(0, 150, 2)
        rows.append((["a", "b", None][rng.integers(0, 3)], ["net_income", "revenue"][rng.integers(0, 2)], at(30 * rng.integers(0, 4)).date(), at(e).to_pydatetime(),
                     None if i % 29 == 0 else at(a).date(), at(200).to_pydatetime(), float(i), "USD", f"s{i % 7}"))
    rows += rows[:40]
    names = f"company_id string, metric string, {period} date, effective_at timestamp_ntz, as_of_date date, ingested_at timestamp_ntz, value double, unit string, source_file_id string"
    return spark.createDataFrame(rows, names), rows


def newest(rows, days):
    out = {}
    for day in days:
        for r in rows:
            if r[4] is not None and max(r[3].date(), r[4]) <= day:
                key = (day, r[0], r[1])
                out[key] = max(out.get(key, r), r, key=lambda x: x[2:])
    return out


def test_facts_are_dealt_once_by_company(spark):
    days = [pd.Timestamp(d).date() for d in ("2024-01-31", "2024-03-29", "2024-06-30")]
    dates = spark.createDataFrame([(d,) for d in days], "signal_date date")
    facts, rows = vendor_facts(spark, "period_end")
    found = asof.latest_asof_facts(facts, dates, "period_end")
    want = newest(rows, days)
    assert sorted(((r.signal_date, r.company_id, r.metric, r.value) for r in found.collect()), key=str) == sorted(((*k, v[6]) for k, v in want.items()), key=str)
    wide = asof.pivot_metrics(found, ["revenue", "net_income"])
    plan = wide._jdf.queryExecution().executedPlan().toString()
    # one shuffle for the maxima, the window and the metrics of a company, and no sort in front of it
    assert plan.count("Exchange hashpartitioning(company_id") == 1 and "Exchange hashpartitioning(signal_date" not in plan.split("BroadcastExchange")[0]
    assert "Sort" not in plan[plan.index("Exchange hashpartitioning(company_id"):].split("BroadcastExchange")[0]
    got = {(r.signal_date, r.company_id, m): r[m] for r in wide.collect() for m in ("revenue", "net_income") if r[m] is not None}
    assert got == {k: v[6] for k, v in want.items()}


def test_evidence_texts_are_made_before_the_dates(spark):
    days = [pd.Timestamp(d).date() for d in ("2024-02-29", "2024-05-31")]
    dates = spark.createDataFrame([(d,) for d in days], "signal_date date")
    (a, rows), (b, _) = vendor_facts(spark, "period_end"), vendor_facts(spark, "fiscal_period")
    out = asof.evidence_asof(a, b, dates)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("initcap") > plan.index("Generate explode") and plan.count("Exchange hashpartitioning(company_id") == 2
    want = [(d, c, f"{r[8]}:{m}", {"revenue": "Revenue", "net_income": "Net Income"}[m], r[6], r[3]) for (d, c, m), r in newest(rows, days).items()]
    got = [(r.signal_date, r.company_id, r.evidence_id, r.label, r.value, r.effective_at) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want + want, key=str)
    assert out.columns == ["signal_date", "company_id", "evidence_id", "label", "value", "unit", "effective_at", "source_file_id", "field"]


def test_indicators_shuffle_rows_once_and_join_nothing(spark):
    rng = np.random.default_rng(8)
    rows = [(s, i, *sorted(float(v) for v in np.round(rng.uniform(5, 9, 3), 2))) for s, k in (("a", 700), ("b", 2), (None, 200)) for i in range(k)]
    df = spark.createDataFrame([(s, i, lo, c, hi) for s, i, lo, c, hi in rows], "sym string, d int, low double, close double, high double")
    out = series.indicators(df, "sym", "d")
    got = {(r.sym, r.d): r for r in out.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.find("== Initial Plan ==")].count("Exchange hashpartitioning") == 1 and "Join" not in plan
    for s in ("a", "b", None):
        num = den = up = down = 0.0
        weight, last = 0.0, None
        for t, d, _, close, _ in (r for r in rows if r[0] == s):
            num, den = close + num * 9 / 11, 1 + den * 9 / 11
            assert got[s, d].close_10_ema == pytest.approx(num / den, rel=1e-12)
            if last is not None:
                up, down, weight = max(close - last, 0) + up * 13 / 14, max(last - close, 0) + down * 13 / 14, 1 + weight * 13 / 14
                if down > 0:
                    assert got[s, d].rsi == pytest.approx(100 - 100 / (1 + up / down), rel=1e-9)
            last = close


def test_sector_zscores_leave_the_rows_where_they_are(spark):
    rng = np.random.default_rng(3)
    day = lambda m: __import__("datetime").date(2020, m, 28)
    rows = [(day(m), f"c{i}", "ABC"[i % 3] if i < 18 else ("D" if i == 18 else None), float(rng.normal()), None if i % 4 == 0 else float(rng.normal()), 1.0) for m in (1, 2) for i in range(22)]
    rows += [(day(1), "c1", "A", 9.0, -9.0, 1.0), (day(1), None, "A", 0.5, 0.5, 1.0), (None, "c1", "A", 0.5, 0.5, 1.0)]  # a key twice, no company, no date
    p = pd.DataFrame(rows, columns=["signal_date", "company_id", "sector", "x", "y", "flat"])
    df = spark.createDataFrame(rows, "signal_date date, company_id string, sector string, x double, y double, flat double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if all were large
    try:
        unique = factors.sector_neutral_zscores(df.where("x < 9"), ["x", "y", "flat"])
        assert "SortMergeJoin" not in unique._jdf.queryExecution().toString() and "hashpartitioning(company_id" not in unique._jdf.queryExecution().toString()
        out = factors.sector_neutral_zscores(df, ["x", "y", "flat"]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(out) == len(rows) and list(out[0].asDict()) == [*df.columns, "z_x", "z_y", "z_flat"]
    want = {}
    for d, of_day in p[p["signal_date"].notna()].groupby("signal_date"):
        sector = of_day["sector"].fillna("*null*")
        for i, r in of_day.iterrows():
            mine = of_day[sector == sector[i]]
            mine = mine if len(mine) >= 3 else of_day
            for f in ("x", "y", "flat"):
                v = mine[f].dropna()
                c = v.clip(v.quantile(0.025), v.quantile(0.975))
                z = 0.0 if c.std(ddof=0) == 0 else (np.clip(r[f], v.quantile(0.025), v.quantile(0.975)) - c.mean()) / c.std(ddof=0)
                if r["company_id"] is not None and len(v) >= 3 and not np.isnan(z):
                    want.setdefault((d, r["company_id"], f), []).append(z)
    for r in out:
        for f in ("x", "y", "flat"):
            w = want.get((r.signal_date, r.company_id, f))
            assert r[f"z_{f}"] == (None if w is None else pytest.approx(max(w), abs=1e-12))


def test_asof_rows_stay_dealt_by_their_key(spark):
    left = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), (None, 2, "z")], "k string, t int, v string")
    right = spark.createDataFrame([("a", 2, 20.0), (None, 1, 10.0)], "k string, t int, w double")
    out = asof.asof_join(left.repartition("k"), right.repartition("k"), ["k"], "t", "t", ["w"]).groupBy("k", "v").agg(F.max("w").alias("w"))
    assert {(r.k, r.v): r.w for r in out.collect()} == {("a", "x"): None, ("a", "y"): 20.0, (None, "z"): 10.0}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.find("== Initial Plan ==")].count("Exchange hashpartitioning") == 2  # one for each side
