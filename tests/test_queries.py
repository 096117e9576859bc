"""Registered queries against their SQL on the smallest data, and what every query must have."""

import sys
from pathlib import Path

import duckdb
import pytest

from conftest import DATA

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as E  # noqa: E402
from check import TABLES, norm  # noqa: E402

FAST = [
    "blocks_from_source", "blocks_crop", "input_rejects", "derive_seed", "partner_map", "seal_blocks", "verify_verdict", "legacy_gap",
    "repair_blocks", "descriptor_mode", "recovery_metrics", "inject_splice", "identify", "format_census", "manifest_verify",
    "library_upsert", "repair_records", "records_recoverability", "gate_missing_cells", "runs_scan", "rd_stats",
    "account_records", "restore_records", "verify_complete", "library_store", "grid_resume", "partner_map_separated", "seal_records", "verify_records", "seal_leftovers", "coverage", "verify_library", "restore_exact", "truth_compare", "descriptor_dct",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, con, name):
    df = E.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(E.oracle_sql()[name])
    theirs = [d[0] for d in rel.description]
    assert sorted(theirs) == cols
    at = [theirs.index(c) for c in cols]
    assert mine == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_entry_has_rows(spark):
    assert E.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    from tesserae.catalog import ORACLE, QUERIES

    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) == set(ORACLE)
