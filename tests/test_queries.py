"""A sample of the registered queries against DuckDB; the driver runs them all."""

import pytest

from noticelake.plans import registry
from tests.compare import connect, rows_of, sql_rows

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "flt_all", "agg_by_severity", "agg_facets", "agg_stats", "win_anomalies", "win_forecast", "snk_upsert", "str_ingest_counts", "ml_knn", "str_match", "agg_digest", "str_dispatch", "fn_titles", "fn_canonical_slug",
    "fn_states_iso", "fn_validate_criteria", "jn_link_edges", "dq_contract", "src_enforcement", "src_ncc", "src_rasff", "src_measures", "str_stream_trend", "str_stream_sessions", "str_stream_gaps", "str_stream_expired", "str_stream_deadline", "snk_model",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    want, columns = sql_rows(con, registry.oracle_sql()[name])
    assert sorted(df.columns) == columns
    assert rows_of(df) == want


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, SF).count() > 0


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
