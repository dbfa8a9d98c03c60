"""A cross-section of the registered queries against DuckDB on the smallest data; check.py runs them all."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, canonical
from veladura.plans import registry

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "pii_detect", "pii_confidence", "pii_coord", "mask_fake", "mask_preserve", "mask_mode_by_type", "mask_table", "agg_pii_values", "pii_report",
    "F01", "F05", "F10", "F19", "F20", "F22", "F23", "F26", "F27", "src_generate_rows", "join_resolve_provider", "join_override_catalogue",
    "ext_catalogue", "form_fields", "form_config", "api_endpoints", "api_summary", "src_spec_csvline", "src_spec_dict", "sink_sql_script",
    "sink_json_array", "sink_csv", "sink_sql_mode", "stream_pii_counts",
]
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_equals_oracle(spark, db, name):
    found, wanted = queries()[name](spark, FOLDER).toPandas(), db.execute(oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns) and len(found) > 0
    assert canonical(found) == canonical(wanted)


def test_registry_is_complete(spark):
    assert set(registry.queries()) == set(registry.oracle_sql()) and len(registry.queries()) >= 170
    assert set(registry.queries()) <= set(queries()) and set(oracle_sql()) <= set(queries())
    assert entry(spark).columns == ["type", "n"]
