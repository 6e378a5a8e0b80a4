"""Vendor exports to contract rows: renaming, reshaping, typing, verdicts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pitgrid.functions.columns import end_of_day, snake
from pitgrid.operators.text import lookup
from pitgrid.sources.contracts import (
    ALIASES, AS_OF_METRICS, CONTRACTS, CURRENT_METRICS, ESTIMATE_MARKERS, INDUSTRY_COLUMNS, LONG_IDENTITY, METRIC_ALIASES, NUMERIC_COLUMNS, PERCENTAGE_POINT_METRICS,
)


class ContractError(ValueError):
    """A file lacks required columns."""


def header_key(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def normalize_headers(df: DataFrame) -> DataFrame:
    """Headers to lower snake case."""
    return df.toDF(*[header_key(c) for c in df.columns])


def alias_columns(df: DataFrame) -> DataFrame:
    """The first accepted spelling present becomes the canonical name."""
    by_key = {header_key(c): c for c in df.columns}
    found = {canonical: next((by_key[a] for a in names if a in by_key), None) for canonical, names in ALIASES.items()}
    return df.withColumnsRenamed({raw: canonical for canonical, raw in found.items() if raw})


def positional_return_columns(df: DataFrame) -> DataFrame:
    """The first three price-change columns, in export order, are the 1d, 1w and 1m returns."""
    leading = [c for c in df.columns if header_key(c).startswith(("price_change", "sp_price_change"))]
    found = leading if len(leading) >= 3 else [c for c in df.columns if "price_change" in header_key(c)]
    if len(found) < 3:
        return df
    return df.withColumnsRenamed(dict(zip(found, ("return_1d", "return_1w", "return_1m"))))


def classify_dataset(files: DataFrame) -> DataFrame:
    """Dataset kind per (file_name, headers); NULL when the evidence is not clear."""
    name, heads = snake("file_name"), F.transform("headers", snake)
    has = lambda *cols: F.size(F.array_intersect(heads, F.array(*[F.lit(c) for c in cols]))) == len(cols)
    some = lambda cols: F.arrays_overlap(heads, F.array(*[F.lit(c) for c in cols]))
    said = lambda *words: F.lit(False) if not words else name.rlike("|".join(words))
    changes = F.size(F.filter(F.array_distinct(heads), lambda h: h.contains("price_change"))) >= 3
    kind = (
        F.when(said("returns_1d_1w_1m") | changes | has("return_1d", "return_1w", "return_1m"), "market_returns")
        .when(has("member_from", "member_to") | said("membership"), "index_membership")
        .when(has("transaction_date", "transaction_type") | said("insider"), "insider_transactions")
        .when(has("institutional_pct") | said("institutional_ownership"), "ownership")
        .when(has("price_date", "close") | has("date", "adj_close"), "prices")
        .when(some(ESTIMATE_MARKERS) | said("estimate", "revision"), "estimates")
        .when(some([m for m in METRIC_ALIASES if m not in ESTIMATE_MARKERS]) | said("fundamental", "financial"), "fundamentals")
        .when(some(("company_id", "sp_entity_id", "ticker", "sp_exchange_ticker")) & some(("company_name", "sp_entity_name", "sector", "iq_sector")), "instruments")
    )
    return files.withColumn("dataset", kind)


def clean_identifiers(df: DataFrame) -> DataFrame:
    """Whole-number ids as text, ticker after the last colon, name without its trailing symbol."""
    rules = {
        "company_id": lambda c: F.regexp_replace(F.trim(c.cast("string")), "^(-?\\d+)\\.0+$", "$1"),
        "ticker": lambda c: F.element_at(F.split(F.trim(c.cast("string")), ":"), -1),
        "company_name": lambda c: F.regexp_replace(F.trim(c.cast("string")), "\\s+\\([A-Za-z0-9._-]+:[^)]+\\)$", ""),
        "sector": lambda c: F.trim(c.cast("string")),
    }
    return df.withColumns({c: rule(F.col(c)) for c, rule in rules.items() if c in df.columns})


def is_parameter_row(df: DataFrame) -> Column:
    """No identity, and every filled cell looks like a code such as FY0 or Current."""
    ids = [c for c in ("company_id", "ticker", "company_name") if c in df.columns]
    if "company_id" not in df.columns:
        return F.lit(False)
    no_id = F.lit(True)
    for c in ids:
        no_id = no_id & F.col(c).isNull()
    cells = F.filter(F.array(*[F.trim(F.col(f"`{c}`").cast("string")) for c in df.columns]), lambda v: v.isNotNull() & (v != ""))
    return no_id & (F.size(cells) > 0) & F.forall(cells, lambda v: v.rlike("^[A-Za-z]+([+-]?\\d+)?$"))


def drop_parameter_rows(df: DataFrame) -> DataFrame:
    return df.where(~is_parameter_row(df))


def wide_to_long(df: DataFrame) -> DataFrame:
    """Every non-identity column to (metric, value); unchanged when already long."""
    if {"metric", "value"} <= set(df.columns):
        return df
    ids = [c for c in df.columns if c in LONG_IDENTITY]
    values = [c for c in df.columns if c not in LONG_IDENTITY and header_key(c) not in INDUSTRY_COLUMNS]
    if not values:
        return df
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("string").alias("value")) for c in values])
    return df.select(*ids, F.inline(cells))


@dataclass(frozen=True)
class DatedColumn:
    """What the header of an export column says: which field, as of when, for which period code."""

    column: str
    header: str
    as_of: str
    period_code: str = ""


def _expandable(dated: Sequence[DatedColumn], current: Sequence[str]) -> bool:
    return len({d.as_of for d in dated}) >= 2 or bool({header_key(d.header) for d in dated} & {header_key(c) for c in current})


def _expand(df: DataFrame, dated: Sequence[DatedColumn], companions: dict[str, tuple[str, ...]], identity: Sequence[str], as_of_only: Sequence[str]) -> DataFrame:
    """One row per source row and dated value column: all in one explode, no join."""
    ids = [c for c in df.columns if header_key(c) in {a for n in identity for a in ALIASES.get(n, ())}]
    roles = {role: [d for d in dated if header_key(d.header) in names] for role, names in companions.items()}
    taken = {d.column for ds in roles.values() for d in ds} | set(ids)
    items = []
    for d in dated:
        if d.column in taken:
            continue
        row = {"as_of_date": F.lit(d.as_of), "metric": F.lit(d.header), "value": F.col(f"`{d.column}`").cast("string")}
        for role, options in roles.items():
            mate = next((o for o in options if o.as_of == d.as_of and (not d.period_code or not o.period_code or o.period_code == d.period_code)), None)
            own = F.col(f"`{mate.column}`").cast("string") if mate else F.lit(None).cast("string")
            row[role] = F.lit(d.as_of) if header_key(d.header) in as_of_only else own
        items.append(F.struct(*[v.alias(k) for k, v in row.items()]))
    if not items:
        return df
    known = F.lit(False) if ids else F.lit(True)
    for c in ids:
        known = known | F.col(f"`{c}`").isNotNull()
    return df.where(known).select(*[F.col(f"`{c}`") for c in ids], F.explode(F.array(*items)).alias("_o")).select(*[F.col(f"`{c}`") for c in ids], "_o.*")


IDENTITY = ("company_id", "ticker", "company_name", "sector", "currency", "unit")


def expand_estimate_snapshots(df: DataFrame, dated: Sequence[DatedColumn], current: Sequence[str] = ()) -> DataFrame:
    """Repeated dated columns to one row per as-of date, with the fiscal period of the same snapshot."""
    if not _expandable(dated, current):
        return df
    out = _expand(df, dated, {"fiscal_period": (*ALIASES["fiscal_period"], *ALIASES["period_end"])}, (*IDENTITY, "valid_to"), ())
    return out.withColumn("effective_at", F.col("as_of_date"))


def expand_fundamental_snapshots(df: DataFrame, dated: Sequence[DatedColumn], current: Sequence[str] = ()) -> DataFrame:
    """As I08 with period end and filing date; vendor multiples use the as-of date for both."""
    if not _expandable(dated, current):
        return df
    return _expand(df, dated, {"period_end": ALIASES["period_end"], "effective_at": ALIASES["effective_at"]}, IDENTITY, AS_OF_METRICS)


def shift_fiscal_period(df: DataFrame, codes: Sequence[str]) -> DataFrame:
    """The one relative FY / FQ code of the file moves period_end by years or quarters."""
    parsed = [(m[1].upper(), int(m[2])) for c in codes if (m := re.fullmatch(r"([A-Za-z]+)([+-]?\d+)", c))]
    parsed = [(p, n) for p, n in parsed if n != 0 and p in ("FY", "FQ")]
    if len(parsed) != 1 or "fiscal_period" in df.columns or "period_end" not in df.columns:
        return df
    prefix, n = parsed[0]
    return df.withColumn("fiscal_period", F.add_months(F.expr("try_cast(period_end AS DATE)"), n * (12 if prefix == "FY" else 3)))


def derive_period_type(df: DataFrame, codes_by_header: dict[str, Sequence[str]], as_of: Column | None = None, observed_at: Column | None = None) -> DataFrame:
    """Period type from the single code of the metric's header; size metrics of a current snapshot are CURRENT."""
    single = {h: re.match(r"[A-Za-z]+", cs[0])[0].upper() for h, cs in codes_by_header.items() if len(cs) == 1 and re.match(r"[A-Za-z]+", cs[0])}
    key = snake("metric")
    inferred = lookup(single, key) if single else F.lit(None).cast("string")
    df = df.withColumn("period_type", F.coalesce("period_type", inferred) if "period_type" in df.columns else inferred)
    if as_of is None:
        return df
    now = key.isin(*CURRENT_METRICS)
    df = df.withColumn("_now", now).withColumn("period_type", F.when(F.col("_now"), "CURRENT").otherwise(F.col("period_type")))
    df = df.withColumn("period_end", F.when(F.col("_now"), as_of.cast("string")).otherwise(F.col("period_end").cast("string")))
    if observed_at is not None:
        df = df.withColumn("effective_at", F.when(F.col("_now"), observed_at.cast("string")).otherwise(F.col("effective_at").cast("string")))
    return df.drop("_now")


def canonical_metric(metric: Column | str = "metric") -> Column:
    """Canonical metric name; unknown names only normalized."""
    return F.coalesce(lookup(METRIC_ALIASES, snake(metric)), snake(metric))


def scale_percentage_points(df: DataFrame) -> DataFrame:
    """Seven vendor metrics come in percent; applied before the names are made canonical."""
    return df.withColumn("value", F.when(snake("metric").isin(*PERCENTAGE_POINT_METRICS), F.col("value") / 100.0).otherwise(F.col("value")))


def to_day(c: str) -> Column:
    return F.expr(f"try_cast(substring(trim(cast(`{c}` AS STRING)), 1, 10) AS DATE)")


def to_utc(c: str) -> Column:
    """Text or timestamp to a UTC wall-clock timestamp; the session time zone must be UTC."""
    return F.expr(f"cast(try_cast(cast(`{c}` AS STRING) AS TIMESTAMP) AS TIMESTAMP_NTZ)")


def coerce_types(df: DataFrame, dataset: str, date_only: bool = False) -> DataFrame:
    """Dates, UTC timestamps and numbers, bad values to NULL; date-only availability to end of day."""
    c = CONTRACTS[dataset]
    out = {d: to_day(d) for d in c.dates if d in df.columns}
    out |= {t: end_of_day(to_day(t)) if date_only and t == "effective_at" else to_utc(t) for t in c.timestamps if t in df.columns}
    numeric = lambda n: F.expr(f"try_cast(trim(cast(`{n}` AS STRING)) AS DOUBLE)")
    out |= {n: F.when(~F.isnan(numeric(n)), numeric(n)) for n in NUMERIC_COLUMNS if n in df.columns}
    return df.withColumns(out)


def missing_columns(df: DataFrame, dataset: str) -> list[str]:
    return [c for c in CONTRACTS[dataset].required if c not in df.columns]


def apply_contract(df: DataFrame, dataset: str, keep: Sequence[str] = ()) -> DataFrame:
    """I16: defaults, optional columns as NULL, fixed output order; missing required columns reject the file."""
    c = CONTRACTS[dataset]
    if missing := missing_columns(df, dataset):
        raise ContractError(f"Missing required columns: {', '.join(missing)}")
    fill = {n: F.lit(v) for n, v in c.defaults.items() if n not in df.columns}
    fill |= {n: F.lit(None).cast("string") for n in c.optional if n not in df.columns and n not in fill}
    return df.withColumns(fill).select(*c.columns, *keep) if fill else df.select(*c.columns, *keep)


def row_verdict(df: DataFrame, dataset: str) -> Column:
    """Valid, unavailable (no number, identity complete), fatal, or future (public after its snapshot)."""
    c = CONTRACTS[dataset]
    present = lambda cols: F.forall(F.array(*[F.col(x).isNotNull() for x in cols]), lambda b: b)
    if dataset == "market_returns":
        rets = ("return_1d", "return_1w", "return_1m")
        no_value = present(("company_id", "ticker", "as_of_date", "effective_at")) & F.col(rets[0]).isNull() & F.col(rets[1]).isNull() & F.col(rets[2]).isNull()
    elif dataset in ("fundamentals", "estimates"):
        no_value = present(("company_id", "ticker", "as_of_date", "metric")) & F.col("value").isNull()
    else:
        no_value = F.lit(False)
    future = F.to_date("effective_at") > F.col("as_of_date")
    return F.when(present(c.required), F.when(future, "future").otherwise("valid")).when(no_value, "unavailable").otherwise("fatal")


def verdict_issues(judged: DataFrame, dataset: str, keys: Sequence[str] = ()) -> DataFrame:
    """Issue rows out of the verdict counts."""
    n = judged.where("verdict <> 'valid'").groupBy(*keys, "verdict").agg(F.count(F.lit(1)).alias("rows"))
    return n.select(
        *keys, F.lit(dataset).alias("dataset"), F.when(F.col("verdict") == "unavailable", "warning").otherwise("error").alias("severity"),
        F.when(F.col("verdict") == "future", "FUTURE_EFFECTIVE_TIMESTAMP").otherwise("NULL_REQUIRED_VALUE").alias("code"), "rows",
    )


def fill_embedded_timestamps(df: DataFrame, dataset: str, as_of: Column | None = None, observed_at: Column | None = None, embedded_as_of: Column | None = None) -> DataFrame:
    """Missing as-of and availability columns from the snapshot arguments or the file's own as-of date."""
    text = lambda c: c.cast("string")
    if as_of is not None:
        if dataset == "fundamentals" and "effective_at" not in df.columns:
            raise ContractError("A current fundamentals snapshot needs a filing date column")
        df = df if "as_of_date" in df.columns else df.withColumn("as_of_date", text(as_of))
        df = df if "effective_at" in df.columns else df.withColumn("effective_at", text(observed_at))
    elif embedded_as_of is not None and "as_of_date" not in df.columns:
        df = df.withColumn("as_of_date", text(embedded_as_of))
    if dataset == "estimates" and embedded_as_of is not None and "effective_at" not in df.columns:
        df = df.withColumn("effective_at", text(embedded_as_of))
    return df


def stamp_provenance(df: DataFrame, source_file_id: Column, at: Column) -> DataFrame:
    """File id and load time."""
    return df.withColumns({"source_file_id": source_file_id, "ingested_at": at})


def filename_snapshot_date(name: Column) -> Column:
    """A 20yy-mm-dd or 20yy_mm_dd date inside a file name."""
    d = F.regexp_extract(name, "(20\\d{2})[-_](\\d{2})[-_](\\d{2})", 0)
    return F.try_to_date(F.replace(F.nullif(d, F.lit("")), F.lit("_"), F.lit("-")), "yyyy-MM-dd")


def import_export(df: DataFrame, dataset: str, date_only: bool = False) -> DataFrame:
    """Raw export to typed contract rows with a verdict: I02, I05 to I07, I12 to I18 as one lazy plan."""
    df = positional_return_columns(df) if dataset == "market_returns" else df
    df = clean_identifiers(alias_columns(df))
    df = drop_parameter_rows(df)
    if dataset in ("fundamentals", "estimates"):
        df = wide_to_long(df)
    date_only = date_only or dataset == "fundamentals"
    if "metric" in df.columns:
        raw = df.withColumn("_raw_metric", F.col("metric"))
        df = coerce_types(apply_contract(raw, dataset, keep=("_raw_metric",)), dataset, date_only)
        df = scale_percentage_points(df.withColumn("metric", F.col("_raw_metric"))).withColumn("metric", canonical_metric()).drop("_raw_metric")
    else:
        df = coerce_types(apply_contract(df, dataset), dataset, date_only)
    return df.withColumn("verdict", row_verdict(df, dataset))


def merge_value_chunks(chunks: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """The non-NULL value per key and whether chunks disagree."""
    return chunks.groupBy(*keys).agg(F.min(value).alias(value), (F.min(value) < F.max(value)).alias("conflict")).fillna(False, ["conflict"])


def calendar_completeness(present: DataFrame, date: str, start: Column, end: Column, months: int = 1, final: Column | None = None) -> DataFrame:
    """Expected month or quarter ends against the dates present: missing and extra ones."""
    spark = present.sparkSession
    ends = F.transform(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr(f"INTERVAL {months} MONTH")), lambda d: F.last_day(d))
    if final is not None:
        ends = F.array_distinct(F.concat(ends, F.array(final)))
    want = spark.range(1).select(F.explode(ends).alias("day")).withColumn("_w", F.lit(1))
    have = present.select(F.col(date).alias("day")).distinct().withColumn("_h", F.lit(1))
    both = want.join(have, "day", "full_outer")
    return both.where("_w IS NULL OR _h IS NULL").select("day", F.when(F.col("_h").isNull(), "missing").otherwise("extra").alias("status"))


def assemble_snapshot_rows(cells: DataFrame, fields: dict[str, str], keys: Sequence[str] = ("company_id", "snapshot_date")) -> DataFrame:
    """Value, period end and filing date cells of one (company, snapshot) to a row with a verdict.

    ``cells`` is long (keys, keyfield, cell); one grouped pass replaces a three-way join.
    """
    pick = lambda f: F.max(F.when(F.col("keyfield") == fields[f], F.col("cell")))
    rows = cells.groupBy(*keys).agg(*[pick(f).alias(f"_{f}") for f in fields]).select(
        *keys, F.expr("try_cast(_value AS DOUBLE)").alias("value"), *[to_day(f"_{f}").alias(f) for f in fields if f != "value"])
    dates = [f for f in fields if f != "value"]
    lost = F.col("value").isNull()
    late = F.lit(False)
    for f in dates:
        lost, late = lost | F.col(f).isNull(), late | (F.col(f) > F.col("snapshot_date"))
    return rows.withColumn("verdict", F.when(lost, "skipped").when(late, "future").otherwise("ok"))


def aligned_identity_check(listed: DataFrame, exported: DataFrame, index: str = "row") -> DataFrame:
    """Rows where a ticker list and an export differ in order or content."""
    a = listed.select(index, F.col("company").alias("listed"))
    b = exported.select(index, F.col("company").alias("exported"))
    return a.join(b, index, "full_outer").where(~F.col("listed").eqNullSafe(F.col("exported")))
