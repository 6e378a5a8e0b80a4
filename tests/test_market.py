"""Market features of windows with hidden bars, and the price tables, against plain Python."""

from __future__ import annotations

import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from pitgrid.operators import factors
from pitgrid.plans.bridge import Tables

DAY = datetime.date(2020, 1, 1)
LOOKBACK = 300


def at(n: int) -> datetime.date:
    return DAY + datetime.timedelta(days=n)


def bars_of(seed: int) -> list[tuple]:
    """Companies with bars that hide for a few days, for most of the line, from its first bar on, or never."""
    draw, rows = random.Random(seed), []
    for company, ticker, late in (("A", "A", 0.05), ("B", "B", 0.0), ("C", "C", 0.3), ("D", "D", 1.0), ("S", "SPY", 0.02)):
        for n in range(480):
            if draw.random() < 0.1:
                continue
            hides = draw.randint(1, 25) if draw.random() < late else 0
            if company == "C" and n in (150, 151):
                hides = 290  # a tail of more than 252 bars
            rows.append((company, ticker, at(n), draw.uniform(50, 150), at(n + hides)))
    return rows


def plain(rows: list[tuple], company: str, on: datetime.date) -> tuple | None:
    def line(name: str) -> dict:
        seen = sorted((d, px) for c, _, d, px, public in rows if c == name and on - datetime.timedelta(days=LOOKBACK) <= d <= on and public <= on)
        return {d: (px, px / seen[i - 1][1] - 1 if i else None) for i, (d, px) in enumerate(seen)}

    own, spy = line(company), line("S")
    if not own:
        return None
    closes, rets = [v[0] for v in own.values()], [v[1] for v in own.values()]
    back = lambda k: closes[-k - 1] if len(closes) > k else None
    momentum = [back(21) / back(k) - 1 if back(k) else None for k in (252, 126)]
    known = [r for r in rets if r is not None]
    recent = [r for r in rets[-252:] if r is not None]
    vol = statistics.pstdev(recent) * 252**0.5 if len(known) >= 40 else None
    pairs = [(r, spy[d][1]) for d, (_, r) in own.items() if r is not None and d in spy and spy[d][1] is not None]
    beta = None
    if len(pairs) >= 40:
        mx, my = statistics.fmean(p[0] for p in pairs), statistics.fmean(p[1] for p in pairs)
        beta = sum((x - mx) * (y - my) for x, y in pairs) / sum((y - my) ** 2 for _, y in pairs)
    return (*momentum, vol, beta)


def frames(spark, rows):
    prices = spark.createDataFrame(rows, "company_id string, ticker string, price_date date, adjusted_close double, public date").select(
        "company_id", "ticker", "price_date", "adjusted_close", F.col("public").cast("timestamp_ntz").alias("effective_at"),
        F.lit("capital_iq").alias("source"), F.lit("f").alias("source_file_id"), F.lit("2021-12-31").cast("timestamp_ntz").alias("ingested_at"))
    asks = spark.createDataFrame([(at(n), c) for n in range(5, 500, 15) for c in "ABCD"], "signal_date date, company_id string")
    return prices, asks


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_with_hidden_bars_equal_plain_python(spark, seed):
    rows = bars_of(seed)
    prices, asks = frames(spark, rows)
    found = {(r["signal_date"], r["company_id"]): tuple(r)[2:] for r in factors.market_features(prices, asks, LOOKBACK).collect()}
    wanted = {(at(n), c): w for n in range(5, 500, 15) for c in "ABCD" if (w := plain(rows, c, at(n))) is not None}
    assert found.keys() == wanted.keys()
    for key, w in wanted.items():
        assert found[key] == pytest.approx(w, abs=1e-7), key


def test_windows_are_not_sent_to_the_driver(spark):
    """Files of dates and ids look small; as joined rows they filled the driver."""
    prices, asks = frames(spark, bars_of(1))
    plan = factors.market_features(prices, asks, LOOKBACK)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin [signal_date" not in plan and "BroadcastHashJoin [company_id" not in plan


def test_prices_are_dealt_once(spark, tmp_path):
    rows = [(o, 1, 3, s, 2.0, 1000.0 + o, f, datetime.datetime(1996, 1, d, 5)) for o, (s, d, f) in enumerate((s, d, f) for s in (1, 2, None) for d in (3, 4) for f in "RAN" for _ in range(2))]
    items = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Tables(spark, str(tmp_path))
    companies = t._view("company_prices")
    prices = t._view("prices", company_prices=companies)
    for old, new in ((prices, t.prices), (t._view("prices_best", prices=prices), t.prices_best), (t._view("signals", company_prices=companies), t.signals)):
        assert old.schema.simpleString() == new.schema.simpleString()
        assert sorted(map(str, old.collect())) == sorted(map(str, new.collect()))
    assert "Exchange" not in t.prices_best._jdf.queryExecution().toString()


def test_features_and_their_files_share_the_daily_bars(spark):
    prices, asks = frames(spark, bars_of(1))
    daily = factors.daily_bars(prices)
    for of in (factors.market_features, factors.price_sources):
        assert sorted(map(str, of(None, asks, LOOKBACK, daily).collect())) == sorted(map(str, of(prices, asks, LOOKBACK).collect())) != []
