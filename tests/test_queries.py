"""Queries against their DuckDB counterparts on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline.queries import dq

SF = "/root/testdata/sf0.001"
SOME = ["chk_not_null", "chk_pattern_consistent", "profile_topk", "profile_masks", "dup_exact", "fd_pairs", "examples_topn", "score_dimension", "registry_list", "dashboard_top5", "csv_scan", "csv_bad_rows", "range_join", "fd_lattice", "dup_fuzzy_pairs"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in "region nation customer supplier part orders lineitem documents pages benchmark labels".split():
        c.sql(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query(spark, duck, name):
    a = dq.QUERIES[name](spark, SF).toPandas()
    b = duck.sql(dq.ORACLES[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = [sorted(map(tuple, x[columns].astype(object).where(x[columns].notna(), None).map(str).values.tolist())) for x in (a, b)]
    assert rows[0] == rows[1]


def test_entry_names():
    assert set(dq.ORACLES) <= set(dq.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
