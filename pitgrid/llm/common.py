"""Shared helpers of the operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: White space that separates words: space and \t \n \v \f \r (fixed by the contracts).
SPACE = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words between white space; null or blank text: empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shingle_hashes(words: str, k: int) -> Column:
    """XXH64 of every run of k words of the array column ``words``, repeats included.

    Fewer words: one hash of the whole sequence; none: empty array. The hash chains the words,
    so runs that differ only in where words are cut differ. ``words`` must be a column of its own: the
    lambda reads it for every element.
    """
    hashed = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + j) for j in range(1, k)]))
    n = F.size(words)
    return F.slice(hashed, F.lit(1), F.when(n == 0, 0).otherwise(F.greatest(n - (k - 1), F.lit(1))))


def spread_join(rows: DataFrame, one: DataFrame, key: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """``rows`` joined (inner or left) with ``one``, which has one row per ``key``; no key's rows all go to one task.

    A key with more than 1 / ``share`` of the rows is hot: there are fewer than ``share`` of them, so their part of ``one`` is broadcast. All other keys
    meet in a shuffle. ``rows`` is read three times and should be a written table.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    hot = [r[key] for r in counts.where(F.col("n") * share > max(total, share * share)).select(key).where(F.col(key).isNotNull()).collect()]
    if not hot:
        return rows.join(one, key, how)
    is_hot = F.col(key).isin(hot)
    rest = F.coalesce(~is_hot, F.lit(True))
    return rows.where(is_hot).join(F.broadcast(one.where(is_hot)), key, how).unionByName(rows.where(rest).join(one, key, how))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if they see that folder."""
    root, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [p for p in paths.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        paths["PYTHONPATH"] = os.pathsep.join([*known, root])


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """``mapInArrow`` over plain values: ``make()`` runs once per task and gives a function
    from one row's values to output tuples. Batches are turned into rows 256 at a time, so memory
    holds one Arrow batch plus few rows."""
    spark_schema = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for at in range(0, batch.num_rows, 256):
                columns = [c.to_pylist() for c in batch.slice(at, 256).columns]
                for values in zip(*columns, strict=True):
                    out.extend(f(*values))
                size += 256
                if size >= 2048:
                    if out:
                        yield _batch(out, arrow)
                    out, size = [], 0
            if out:
                yield _batch(out, arrow)

    find_package(df.sparkSession)
    return df.mapInArrow(run, spark_schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
