"""A spread of registered queries against their SQL, and the shape of their plans."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check  # noqa: E402
from pitgrid.plans import all_queries  # noqa: E402
from pitgrid.plans.registry import oracle_text, runnable  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "P01_latest_asof_facts", "P03_universe_asof", "P10_vintage_asof", "P13_membership_intervals", "P19_lessons_asof", "I17_reject_null_required", "F07_sector_neutral_zscore",
    "F12_beta_252d", "F18_operational_rank", "T02_fill_price_gaps", "T06_rsi", "T13_holding_outcome", "M02_impute_scale", "M03_elastic_net_grid", "M05_scored_months", "B02_forward_returns", "B07_quantile_returns",
    "B13_portfolio_risk", "R01_research_candidates", "R07_allocate_turnover_budget", "Q02_snapshot_coverage", "X12_extract_rating", "S06_upsert_by_key", "ST4_stream_latest_bar",
)


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    msg, _, _, ok = check.compare(spark, con, all_queries()[name], SF)
    assert ok, msg


def test_every_query_has_columns_and_most_have_sql():
    known = all_queries()
    assert len(known) >= 182
    without = {n for n, q in known.items() if oracle_text(q) is None}
    assert without == {"B12_capped_score_weights", "M04_gbt_grid", "M05_annual_model_selection"}


@pytest.mark.parametrize("name", ["P01_latest_asof_facts", "F07_sector_neutral_zscore", "T05_macd", "R03_bearish_screen", "X03_strip_html"])
def test_plans_hold_no_python_and_no_cartesian_product(spark, name):
    plan = runnable(all_queries()[name])(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
