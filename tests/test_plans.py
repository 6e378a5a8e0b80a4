"""Plans that must hold when tables grow, and the rows of the operators behind them."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from pitgrid.functions import groups
from pitgrid.operators import asof, factors, performance
from pitgrid.plans import incremental
from pitgrid.sources import readers

DAY = datetime.date(2020, 1, 1)


def at(n: int) -> datetime.date:
    return DAY + datetime.timedelta(days=n)


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_calendar_is_sent_and_not_the_rows(spark):
    daily = spark.createDataFrame([(c, t, at(n), 1.0 * n, at(n + n % 3)) for n in range(60) for c, t in (("A", "A"), ("S", "SPY"))],
                                  "company_id string, ticker string, price_date date, adjusted_close double, public date")
    asks = spark.createDataFrame([(at(40), "A")], "signal_date date, company_id string")  # as small as a file of dates and ids looks
    assert "BuildLeft" not in physical(factors.hidden_windows(daily, asks, 50))
    dates = spark.createDataFrame([(at(n),) for n in range(60)], "signal_date date")
    spans = spark.createDataFrame([("A", at(3), None), ("B", at(5), at(6)), ("C", None, at(6))], "k string, a date, b date")
    out = asof.expand_intervals(spans, dates, "a", "b")
    assert "BuildLeft" not in physical(out)
    assert out.where("k = 'A'").count() == 57 and {r.signal_date for r in out.where("k = 'B'").collect()} == {at(5), at(6)} and out.where("k = 'C'").count() == 7


def test_join_of_days_keeps_rows_without_a_day(spark):
    rows = spark.createDataFrame([(1, at(0)), (2, at(1)), (3, None)], "id int, d date")
    days = spark.createDataFrame([(at(0), "x"), (at(0), "y"), (None, "z")], "d date, v string")
    got = {(r.id, r.d, r.v) for r in groups.join_days(rows, days, ["d"], "left").collect()}
    assert got == {(1, at(0), "x"), (1, at(0), "y"), (2, at(1), None), (3, None, None)}


def test_lessons_of_others_come_from_one_list_per_date(spark):
    draw = random.Random(5)
    lessons = [(t, at(7 * n), at(7 * n + draw.randint(1, 40)) if draw.random() < 0.9 else None, "Hold") for t in "ABCDEF" for n in range(12)]
    entries = spark.createDataFrame(lessons, "ticker string, trade_date date, resolved date, rating string")
    asked = [(t, at(10 * n)) for t in "ABZ" for n in range(10)]
    out = asof.lessons_asof(entries, spark.createDataFrame(asked, "ask_ticker string, as_of date"))
    want = set()
    for ask, day in asked:
        known = sorted(((d, t) for t, d, r, _ in lessons if r is not None and r <= day), reverse=True)
        for kind, n, rows in (("same", 5, [x for x in known if x[1] == ask]), ("cross", 3, [x for x in known if x[1] != ask])):
            want |= {(ask, day, kind, i + 1, t, d) for i, (d, t) in enumerate(rows[:n])}
    assert {(r.ask_ticker, r.as_of, r.kind, r["rank"], r.ticker, r.trade_date) for r in out.collect()} == want
    # only the asks' own lessons are ordered per ask
    assert optimized(out).count("windowspecdefinition(ask_ticker") == 1


def test_factor_correlation_joins_nothing_back(spark):
    draw = random.Random(2)
    rows = [(at(31 * d), f"c{i % 9}", draw.choice([None, 1.0, 2.0, 3.0]), draw.random(), 1.0 * i) for d in range(3) for i in range(12)]  # c0 to c2 stand twice
    panel = spark.createDataFrame(rows, "signal_date date, company_id string, x double, y double, z double")
    out = performance.factor_correlation(panel, ["x", "y", "z"])
    assert sum(line.lstrip(" :+-").startswith("Join ") for line in optimized(out).splitlines()) == 2
    # as with the ranks joined back to every row
    want = []
    for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
        long = panel.where(f"{a} IS NOT NULL AND {b} IS NOT NULL").select("signal_date", "company_id", a, b)
        ranked = groups.with_average_ranks(long, ["signal_date"], ["company_id"], {a: "r", b: "s"}, pct=False)
        want.append((a, b, ranked.groupBy("signal_date").agg(F.corr("r", "s").alias("rho")).agg(F.avg("rho")).first()[0]))
    got = {(r.a, r.b): r.rho for r in out.collect()}
    assert got == {(a, b): pytest.approx(rho) for a, b, rho in want}


def test_pages_of_bars_meet_the_symbols_whole(spark):
    pages = spark.createDataFrame([(1, 1, '{"bars":{"a":[{"t":"2020-01-02T05:00:00Z","o":1,"h":2,"l":1,"c":2},{"t":"2020-01-03T05:00:00Z","o":1,"h":2,"l":1,"c":3,"v":7}],"q":[{"t":"2020-01-02T05:00:00Z","c":9}]}}'),
                                   (1, 2, '{"bars":{" A ":[{"t":"2020-01-03T06:00:00Z","o":1,"h":2,"l":1,"c":4,"v":8}]}}')], "batch int, page int, body string")
    kind = "bars map<string,array<struct<t:string,o:double,h:double,l:double,c:double,v:double>>>, next_page_token string"
    pages = pages.select("batch", "page", F.from_json("body", kind).alias("response"))
    out = readers.flatten_bars_json(pages, spark.createDataFrame([("A", "7")], "ticker string, company_id string"), F.lit("2020-02-01").cast("date"))
    assert {(r.company_id, r.price_date, r.close, r.volume) for r in out.collect()} == {("7", at(1), 2.0, 0.0), ("7", at(2), 4.0, 8.0)}
    plan = optimized(out)
    assert plan.index("posexplode") < plan.index("Join Inner")  # the list is opened above the join


def test_files_of_a_large_table_take_no_shuffle(spark):
    rows = spark.range(100, numPartitions=8)
    assert "Repartition 6, false" in optimized(incremental.dealt(rows, 6)) and incremental.dealt(rows, 6).count() == 100
    assert "Repartition 6, true" in optimized(incremental.dealt(spark.range(5, numPartitions=2), 6))
