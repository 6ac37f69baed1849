"""Every query of the catalogue against its SQL."""

import os

import duckdb
import pytest

from millrace.plans import catalogue

from .oracle import connect, same

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def other(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_the_oracles(spark, sf, other, name):
    same(QUERIES[name](spark, sf), other, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_run(spark, sf, name):
    assert QUERIES[name](spark, sf).columns


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_samples(spark, sf):
    a, b = (QUERIES["sample_rows"](spark, sf).collect() for _ in range(2))
    assert len(a) == 100 and a == b
    n = QUERIES["sample_percent"](spark, sf).count()
    assert 450 < n < 750


def test_sketches_of_odd_groups(spark, sf, tmp_path):
    """Parts that 512 registers take for 1133, a group of null flags, one without parts and quantities."""
    for f in os.listdir(sf):
        os.symlink(f"{sf}/{f}", tmp_path / f)
    os.unlink(tmp_path / "lineitem.parquet")
    duckdb.sql(
        "SELECT i AS l_orderkey, CASE WHEN i % 3 < 2 THEN 112000 + i // 3 END AS l_partkey, (i % 7 + 1)::INTEGER AS l_linenumber, CASE WHEN i % 3 < 2 THEN (i % 50 + 1)::DOUBLE END AS l_quantity, "
        "['A', NULL, 'R'][i % 3 + 1] AS l_returnflag, ['F', 'O'][i % 2 + 1] AS l_linestatus FROM range(3000) r(i)"
    ).write_parquet(str(tmp_path / "lineitem.parquet"))
    same(QUERIES["sketches_within_bounds"](spark, str(tmp_path)), connect(str(tmp_path)), SQL["sketches_within_bounds"])


def test_sketches_of_null_event_types(spark, sf, tmp_path):
    for f in os.listdir(sf):
        os.symlink(f"{sf}/{f}", tmp_path / f)
    os.unlink(tmp_path / "events.parquet")
    duckdb.sql("SELECT i AS user_id, ['a', NULL, 'b'][i % 3 + 1] AS event_type, CASE WHEN i % 3 < 2 THEN i::DOUBLE END AS value FROM range(300) r(i)").write_parquet(str(tmp_path / "events.parquet"))
    same(QUERIES["aggregate_sketches"](spark, str(tmp_path)), connect(str(tmp_path)), SQL["aggregate_sketches"])
