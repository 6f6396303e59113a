"""The registered queries as a set, and a few of them against their SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check  # noqa: E402
from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from statloom.plans import catalogue  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["K6_select_values", "J1_resolve", "V1_validate", "G4_annual_windows", "N13_value_rank_customers", "X4_X24_rejoin_wrapped", "H5_health"]


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in check.TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    df = queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(check.plain(r[c]) for c in columns) for r in df.collect())
    cur = con.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(check.plain(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    assert got == want and got


def test_entry_invariants(spark):
    scores = entry(spark).collect()
    assert scores
    assert all(0 <= r.score <= 100 for r in scores if r.score is not None)
    assert all(0 <= r.coverage <= 1 for r in scores if r.coverage is not None)
    groups = {}
    for r in scores:
        if r.rank_overall is not None:
            groups.setdefault((r.edition, r.level, r.key), []).append(r.rank_overall)
    assert groups and all(min(ranks) == 1 for ranks in groups.values())
