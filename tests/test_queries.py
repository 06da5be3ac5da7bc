"""A cross-section of registered queries against DuckDB at the smallest scale, and contract checks."""
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_mod
from check_queries import compare

SF = "/root/testdata/sf0.001"
SAMPLE = ["bars_hourly_ticks", "asof_nearest", "iqr_cap_or_drop", "ind_macd", "ind_feature_set", "roll_moments_block", "anom_iqr_tukey", "anom_local_outlier_factor", "vol_regime",
          "vol_model_free_index", "risk_performance_row", "risk_var_backtest", "xasset_pearson", "book_level_changes", "flow_delta_metrics", "flow_layering", "pattern_harmonic_matches",
          "level_validation", "sentiment_lexicon", "index_fear_greed", "quality_near_duplicates", "drift_ks_wasserstein_ranksum", "select_anova", "eval_bootstrap_interval", "stream_trade_bars"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    ok, msg, _ = compare(spark, con, name, entry_mod.queries()[name], entry_mod.oracle_sql()[name], SF)
    assert ok, msg


def test_registry_contract():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q) and len(q) > 250 and len(o) / len(q) > .85


def test_entry_runs(spark):
    d = entry_mod.entry(spark)
    assert "label" in d.columns and d.count() > 0
