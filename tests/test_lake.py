"""Tables in generations: what a merge writes, what it leaves, and what readers see."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from pitgrid.sources import lake, readers, writers

D = date.fromisoformat
SCHEMA = "company_id string, ticker string, price_date date, source string, close double, ingested_at timestamp_ntz, source_file_id string"


def bars(spark, *rows):
    return spark.createDataFrame([(c, f"T{c}", D(d), s, v, datetime(2024, 1, n), f"f{n}") for c, d, s, v, n in rows], SCHEMA)


def held(spark, root):
    return sorted((r.company_id, str(r.price_date), r.source, r.close) for r in lake.read_parts(spark, root).collect())


def files(spark, root, year):
    return sorted(readers.price_lake(spark, root, year, year).inputFiles())


def test_merge_writes_touched_years_only(spark, tmp_path):
    root = str(tmp_path / "lake")
    assert lake.read_parts(spark, root) is None and lake.generation(spark, root) == 0
    first = bars(spark, ("1", "2022-05-02", "a", 1.0, 1), ("1", "2023-05-02", "a", 2.0, 1), ("2", "2023-05-02", "a", 3.0, 1), ("2", "2023-05-02", "a", 4.0, 2))
    assert writers.merge_into_price_lake(spark, root, first) == ["2022", "2023"]
    assert held(spark, root) == [("1", "2022-05-02", "a", 1.0), ("1", "2023-05-02", "a", 2.0), ("2", "2023-05-02", "a", 4.0)]
    before = {y: files(spark, root, y) for y in (2022, 2023)}
    late = bars(spark, ("1", "2023-05-02", "a", 9.0, 3), ("1", "2023-05-02", "b", 5.0, 1), ("2", "2023-05-02", "a", 0.0, 1), ("3", "2024-01-02", "a", 6.0, 1))
    assert writers.merge_into_price_lake(spark, root, late) == ["2023", "2024"]
    # the newest load wins, also against an older one that comes later
    assert held(spark, root) == [("1", "2022-05-02", "a", 1.0), ("1", "2023-05-02", "a", 9.0), ("1", "2023-05-02", "b", 5.0), ("2", "2023-05-02", "a", 4.0), ("3", "2024-01-02", "a", 6.0)]
    assert files(spark, root, 2022) == before[2022] and not set(files(spark, root, 2023)) & set(before[2023])
    assert writers.merge_into_price_lake(spark, root, late.limit(0)) == [] and lake.generation(spark, root) == 2
    assert writers.merge_into_price_lake(spark, root, late) == ["2023", "2024"] and len(held(spark, root)) == 5


def test_a_merge_broken_off_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "lake")
    writers.merge_into_price_lake(spark, root, bars(spark, ("1", "2022-05-02", "a", 1.0, 1), ("1", "2023-05-02", "a", 2.0, 1)))
    want = held(spark, root)
    late = bars(spark, ("1", "2023-05-02", "a", 9.0, 3))

    def stop(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(lake, "publish", stop)
        with pytest.raises(OSError):
            writers.merge_into_price_lake(spark, root, late)
    assert held(spark, root) == want and lake.generation(spark, root) == 1
    real = lake.publish

    def overtaken(spark, root, began, parts):  # another writer is faster
        real(spark, root, began, lake.valid_parts(spark, root))
        real(spark, root, began, parts)

    with monkeypatch.context() as m:
        m.setattr(lake, "publish", overtaken)
        with pytest.raises(lake.ConcurrentMergeError):
            writers.merge_into_price_lake(spark, root, late)
    assert held(spark, root) == want
    writers.merge_into_price_lake(spark, root, late)
    assert ("1", "2023-05-02", "a", 9.0) in held(spark, root)


def test_scans_list_the_wanted_years_only(spark, tmp_path):
    root = str(tmp_path / "lake")
    writers.merge_into_price_lake(spark, root, bars(spark, *[("1", f"{y}-05-02", "a", float(y), 1) for y in range(2015, 2025)]))
    df = readers.price_lake(spark, root, 2017, 2018)
    found = readers.scan_price_lake(df, F.lit("2017-01-01").cast("date"), F.lit("2018-12-31").cast("date"))
    assert sorted(r.close for r in found.collect()) == [2017.0, 2018.0]
    assert {f.split("part=")[1][:4] for f in df.inputFiles()} == {"2017", "2018"}
    assert "PushedFilters: [IsNotNull(price_date)" in found._jdf.queryExecution().executedPlan().toString()
    assert readers.price_lake(spark, root, 1990, 1991) is None


def test_upsert_into_a_table_on_disk(spark, tmp_path):
    root, key = str(tmp_path / "t"), ["company_id", "price_date"]
    rows = bars(spark, ("1", "2022-05-02", "a", 1.0, 1), ("1", "2022-05-02", "b", 2.0, 2), ("2", "2023-05-02", "a", 3.0, 1))
    writers.upsert_into(spark, root, rows, F.year("price_date"), key, ["ingested_at", "source_file_id"])
    assert held(spark, root) == [("1", "2022-05-02", "b", 2.0), ("2", "2023-05-02", "a", 3.0)]
