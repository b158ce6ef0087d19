"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import datetime
import os

import duckdb
import pytest

from skeinflow.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.isoformat(" ")
    return repr(value) if isinstance(value, float) else str(value)


#: Long chains over the panel: run with SKEINFLOW_SLOW=1; one of each kind is enough otherwise.
SLOW = {
    "fold_accuracy", "fold_assignment", "fold_auc", "benchmark_eqw", "backtest_pnl", "backtest_pnl_b", "backtest_summary", "backtest_with_benchmark", "report_sector", "report_distribution", "report_latest",
    "report_top5", "report_rung_pivot", "report_lookup", "leakage_guard", "predictions", "rung0_ar", "rung1_trees", "rung2_trees", "run_metrics", "wilcoxon_chance", "lookup_days", "lookup_predictions",
    "panel_top5", "panel_sectors", "panel_distribution", "feature_panel_pca", "fitted_backtest", "attribution_json", "rag_fallback_text", "rag_prompt",
}


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in SLOW or os.environ.get("SKEINFLOW_SLOW")])
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalog.SQL:
        assert rows
        return
    want = duck.sql(catalog.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    got = sorted(tuple(plain(r[c]) for c in columns) for r in rows)
    assert got == sorted(tuple(plain(r[i]) for i in place) for r in want.fetchall())
