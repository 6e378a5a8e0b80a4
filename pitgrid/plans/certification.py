"""Quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgrid.operators import quality
from pitgrid.plans.registry import query, step

day = lambda s: F.lit(s).cast("date")
START, END = "1996-01-01", "2001-06-30"
WIN = f"as_of_date BETWEEN DATE '{START}' AND DATE '{END}'"


def window():
    return day(START), day(END)


@query("Q01_source_status", "dataset:s files:i rows:i latest_import:t", 'SELECT dataset, count(*) AS files, sum(row_count) AS "rows", max(imported_at) AS latest_import FROM source_files GROUP BY 1')
def q01(t):
    return quality.source_status(t.source_files)


def counts_sql(table: str, extra: str = "") -> str:
    return f"""SELECT a.snapshot_date, count(*) AS active_count, count(p.company_id) AS covered FROM (
      SELECT DISTINCT d.snapshot_date, m.company_id FROM (SELECT DISTINCT as_of_date AS snapshot_date FROM {table} WHERE {WIN}{extra}) d
      JOIN index_membership m ON m.member_from <= d.snapshot_date AND (m.member_to IS NULL OR m.member_to >= d.snapshot_date)) a
    LEFT JOIN (SELECT DISTINCT as_of_date AS snapshot_date, company_id FROM {table} WHERE {WIN}{extra}) p ON p.snapshot_date = a.snapshot_date AND p.company_id = a.company_id GROUP BY 1"""


def cover_sql(table: str, unit: str, floor: int, extra: str = "") -> str:
    return f"""SELECT e.period, b.snapshot_date, coalesce(covered, 0) AS covered, coalesce(active_count, 0) AS active_count,
      coalesce(active_count, 0) = 0 OR covered < greatest({floor}, ceil(round(active_count * 0.9, 9))) AS weak
    FROM (SELECT CAST(unnest(generate_series(date_trunc('{unit}', DATE '{START}'), date_trunc('{unit}', DATE '{END}'), INTERVAL 1 {unit})) AS DATE) AS period) e
    LEFT JOIN (SELECT *, date_trunc('{unit}', snapshot_date) AS period FROM ({counts_sql(table, extra)}) c
      QUALIFY row_number() OVER (PARTITION BY date_trunc('{unit}', snapshot_date) ORDER BY covered / active_count DESC, snapshot_date) = 1) b ON b.period = e.period"""


EPS = " AND metric = 'eps_estimate'"


@query("Q02_snapshot_coverage", "label:s period:d snapshot_date:d covered:i active_count:i weak:b",
       f"SELECT 'fundamentals' AS label, * FROM ({cover_sql('fundamentals', 'quarter', 60)}) a UNION ALL SELECT 'estimates', * FROM ({cover_sql('estimates', 'month', 60, EPS)}) b")
def q02(t):
    a = quality.snapshot_coverage(t.fundamentals, t.index_membership, *window(), "quarter", F.lit(60)).withColumn("label", F.lit("fundamentals"))
    b = quality.snapshot_coverage(t.estimates, t.index_membership, *window(), "month", F.lit(60), "eps_estimate").withColumn("label", F.lit("estimates"))
    return a.unionByName(b)


GAP_FUND = f"SELECT DISTINCT company_id FROM fundamentals WHERE {WIN} AND CAST(company_id AS BIGINT) % 6 <> 1"
step("gaps_q", f"""
  SELECT h.*, f.company_id IS NULL AS needs_fundamentals, e.company_id IS NULL AS needs_estimates, i.company_id IS NULL AS needs_instrument_identity
  FROM (SELECT company_id, ticker, min(member_from) AS first_member, max(coalesce(member_to, DATE '{END}')) AS last_member FROM index_membership
        WHERE member_from <= DATE '{END}' AND (member_to IS NULL OR member_to >= DATE '{START}') GROUP BY 1, 2) h
  LEFT JOIN ({GAP_FUND}) f ON f.company_id = h.company_id
  LEFT JOIN (SELECT DISTINCT company_id FROM estimates WHERE {WIN}{EPS} AND CAST(company_id AS BIGINT) % 10 <> 3) e ON e.company_id = h.company_id
  LEFT JOIN (SELECT DISTINCT company_id FROM instruments) i ON i.company_id = h.company_id WHERE f.company_id IS NULL OR e.company_id IS NULL""")


def gaps(t):
    """Vendor coverage with holes: two classes of companies were never exported."""
    k = F.col("company_id").cast("bigint")
    return quality.universe_gaps(t.index_membership, t.fundamentals.where(k % 6 != 1), t.estimates.where(k % 10 != 3), t.instruments, *window())


@query("Q03_universe_gaps", "company_id:s ticker:s first_member:d last_member:d needs_fundamentals:b needs_estimates:b needs_instrument_identity:b", "SELECT * FROM gaps_q")
def q03(t):
    return gaps(t)


step("errors_q", f"""
  SELECT dataset, code, count(*) AS count FROM issues i WHERE severity = 'error' AND dataset IN ('index_membership', 'fundamentals', 'estimates', 'prices')
    AND (dataset NOT IN ('fundamentals', 'estimates') OR source_file_id IS NULL OR EXISTS (SELECT 1 FROM (
      SELECT DISTINCT 'fundamentals' AS dataset, source_file_id FROM fundamentals WHERE {WIN} UNION SELECT DISTINCT 'estimates', source_file_id FROM estimates WHERE {WIN}) u
      WHERE u.dataset = i.dataset AND u.source_file_id = i.source_file_id)) GROUP BY 1, 2""")


@query("Q04_relevant_errors", "dataset:s code:s count:i", "SELECT * FROM errors_q")
def q04(t):
    return quality.relevant_errors(t.issues, t.fundamentals, t.estimates, *window())


@query("Q05_membership_span", "first_member:d last_member:d open_spells:i verdict:s",
       f"""SELECT *, CASE WHEN first_member IS NULL THEN 'missing' WHEN first_member > DATE '{START}' THEN 'begins after' WHEN open_spells = 0 AND last_member < DATE '{END}' THEN 'ends before' ELSE 'ok' END AS verdict
  FROM (SELECT min(member_from) AS first_member, max(member_to) AS last_member, count(*) FILTER (WHERE member_to IS NULL) AS open_spells FROM index_membership) m""")
def q05(t):
    return quality.membership_span(t.index_membership, *window())


@query("Q06_price_span", "first_price:d last_price:d n_sources:i substitutes:s verdict:s", f"""
  SELECT min(price_date) AS first_price, max(price_date) AS last_price, count(DISTINCT source) AS n_sources, string_agg(DISTINCT source, ', ' ORDER BY source) FILTER (WHERE source <> 'capital_iq') AS substitutes,
         CASE WHEN min(price_date) > DATE '{START}' OR max(price_date) < DATE '{END}' THEN 'does not span' ELSE 'ok' END AS verdict FROM prices""")
def q06(t):
    return quality.price_span(t.prices, *window())


@query("Q07_freshness_span", "first:d last:d verdict:s", f"""
  SELECT *, CASE WHEN first IS NULL THEN 'missing' WHEN first > DATE '{START}' THEN 'begins after' WHEN last < DATE '{END}' - INTERVAL 15 MONTH THEN 'ends too early' ELSE 'ok' END AS verdict
  FROM (SELECT CAST(min(effective_at) AS DATE) AS first, CAST(max(effective_at) AS DATE) AS last FROM fundamentals) f""")
def q07(t):
    return quality.freshness_span(t.fundamentals, *window())


@query("Q08_substitute_sources", "provider:s", "SELECT DISTINCT json_extract_string(metadata_json, '$.provider') AS provider FROM source_files WHERE dataset = 'index_membership' AND json_extract_string(metadata_json, '$.capital_iq_data') = 'false'")
def q08(t):
    return quality.substitute_sources(t.source_files)


@query("Q09_certify", "seq:i note:s blocks:b", f"""
  SELECT 3 AS seq, concat('weak fundamental quarters: ', count(*)) AS note, true AS blocks FROM ({cover_sql('fundamentals', 'quarter', 400)}) a WHERE weak HAVING count(*) > 0
  UNION ALL SELECT 4, concat('weak estimate months: ', count(*)), true FROM ({cover_sql('estimates', 'month', 400, EPS)}) b WHERE weak HAVING count(*) > 0
  UNION ALL SELECT 5, concat(dataset, ' ', code, ' ', count), true FROM errors_q
  UNION ALL SELECT 7, 'membership substitute: public_table', false
  UNION ALL SELECT 9, concat('price substitutes: ', string_agg(DISTINCT source, ', ' ORDER BY source)), false FROM prices WHERE source <> 'capital_iq'""")
def q09(t):
    return quality.certify(t.source_files, t.index_membership, t.fundamentals, t.estimates, t.prices, t.issues, *window())


def audit_sql(table: str, period: str) -> str:
    return f"""SELECT as_of_date, count(*) AS "rows", count(DISTINCT company_id) AS companies, count(DISTINCT metric) AS metrics, count(*) FILTER (WHERE effective_at >= as_of_date + INTERVAL 1 DAY) AS future_effective,
      count(*) FILTER (WHERE {period} > as_of_date) AS future_period, count(*) FILTER (WHERE {period} IS NULL) AS missing_period FROM {table} GROUP BY 1"""


AUDIT = "as_of_date:d rows:i companies:i metrics:i future_effective:i future_period:i missing_period:i"


@query("Q10_snapshot_audit", AUDIT, audit_sql("fundamentals", "period_end"))
def q10(t):
    return quality.snapshot_audit(t.fundamentals, "period_end")


@query("Q10_snapshot_audit_estimates", AUDIT, audit_sql("estimates", "fiscal_period"))
def q10b(t):
    return quality.snapshot_audit(t.estimates, "fiscal_period")


@query("Q11_duplicate_grain", "company_id:s metric:s period_end:d count:i", "SELECT company_id, metric, period_end, count(*) AS count FROM fundamentals GROUP BY 1, 2, 3 HAVING count(*) > 1")
def q11(t):
    # without the snapshot date in the grain, second vintages are duplicates
    return quality.duplicate_grain(t.fundamentals, ["company_id", "metric", "period_end"])


@query("Q12_metric_coverage", "as_of_date:d metric:s companies:i", "SELECT as_of_date, metric, count(DISTINCT company_id) AS companies FROM fundamentals GROUP BY 1, 2")
def q12(t):
    return quality.metric_coverage(t.fundamentals)


@query("Q13_issue_list", "issue_id:s severity:s dataset:s code:s created_at:t", "SELECT * FROM issues ORDER BY created_at DESC, issue_id DESC LIMIT 200")
def q13(t):
    return quality.issue_list(t.issues)


@query("Q14_symbols_without_bars", "ticker:s", "SELECT DISTINCT ticker FROM instruments WHERE ticker NOT IN (SELECT ticker FROM prices)")
def q14(t):
    return quality.symbols_without_bars(t.instruments, t.prices)


@query("Q15_feed_readiness", "dataset:s rows:i code:s", """
  SELECT d.dataset, coalesce(sum(s.row_count), 0) AS "rows", CASE WHEN coalesce(sum(s.row_count), 0) = 0 THEN concat(upper(d.dataset), '_READINESS') END AS code
  FROM (SELECT unnest(['prices', 'fundamentals', 'estimates', 'market_returns']) AS dataset) d LEFT JOIN source_files s ON s.dataset = d.dataset GROUP BY 1""")
def q15(t):
    return quality.feed_readiness(t.source_files, ("prices", "fundamentals", "estimates", "market_returns"))
