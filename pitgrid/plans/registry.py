"""Registry of runnable queries, each with its output columns and, where SQL can say it, a check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pitgrid.plans.bridge import Tables, with_views


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
STEPS: dict[str, str] = {}  # named SQL steps shared by several checks


def query(name: str, columns: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``.

    ``columns`` lists ``name:kind`` with kinds s(tring), d(ate), t(imestamp), f(loat), i(nt), b(ool);
    both the DataFrame and the SQL are projected to exactly these.
    """
    spec = tuple(tuple(c.split(":")) for c in columns.split())

    def add(fn):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = Query(name, spec, fn, sql)
        return fn

    return add


def step(name: str, sql: str) -> None:
    STEPS[name] = sql


# Shown decimals: 6 below 1000, 2 above. The small shift moves exact halves (averages of few
# short decimals end in one) off the rounding edge, where the last bit would decide.
def tidy(v: Column) -> Column:
    return F.when(F.abs(v) < 1000, F.round(v + F.lit(1.37e-8), 6)).otherwise(F.round(v + F.lit(1.37e-4), 2)) + F.lit(0.0)


TIDY_SQL = "CASE WHEN abs(CAST({0} AS DOUBLE)) < 1000 THEN round(CAST({0} AS DOUBLE) + 1.37e-8, 6) ELSE round(CAST({0} AS DOUBLE) + 1.37e-4, 2) END + 0.0 AS {0}"


def present(df: DataFrame, spec) -> DataFrame:
    out = []
    for name, kind in spec:
        c = F.col(name)
        if kind == "f":
            c = tidy(c.cast("double"))
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "b":
            c = c.cast("boolean")
        elif kind == "d":
            c = c.cast("date").cast("string")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        else:
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def oracle_text(q: Query) -> str | None:
    if q.sql is None:
        return None
    cast = {
        "f": TIDY_SQL,
        "i": "CAST({0} AS BIGINT) AS {0}",
        "b": "CAST({0} AS BOOLEAN) AS {0}",
        "d": "CAST(CAST({0} AS DATE) AS VARCHAR) AS {0}",
        "t": "strftime(CAST({0} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS {0}",
        "s": "CAST({0} AS VARCHAR) AS {0}",
    }
    cols = ", ".join(cast[k].format(n) for n, k in q.columns)
    return with_views(f"SELECT {cols} FROM ({q.sql}) result_rows", STEPS)


_tables: dict[tuple, Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _tables:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        _tables[key] = Tables(spark, sf_dir)
    return _tables[key]


def runnable(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(q.build(tables(spark, sf_dir)), q.columns)

    run.__name__ = q.name
    return run
