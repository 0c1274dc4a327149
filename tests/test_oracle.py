"""Every registered query against its SQL, with names, types and values compared."""

import os

import pytest

from __spark_entry__ import entry
from pelagia.plans.oracle import ORACLE
from pelagia.plans.queries import QUERIES
from tests.conftest import SMALL

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
WITHOUT_SQL: set[str] = set()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    yield connection
    connection.close()


def rows(table):
    names = sorted(table.column_names)
    return sorted(zip(*[table.column(n).to_pylist() for n in names]), key=repr)


def types(table):
    return {f.name: str(f.type).replace("large_", "") for f in table.schema}


def test_registry_and_sql_name_the_same_queries():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL
    assert not set(ORACLE) - set(QUERIES)


def test_entry_returns_rows(spark):
    frame = entry(spark)
    assert frame.columns == ["sample_id", "taxon_read_count", "sample_total_read_count", "relative_abundance"]
    assert frame.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sql, name):
    found = QUERIES[name](spark, SMALL).toArrow()
    wanted = sql.sql(ORACLE[name]).to_arrow_table()
    assert types(found) == types(wanted)
    assert rows(found) == rows(wanted)


def test_fingerprint_ignores_order_and_partitioning(spark):
    from pelagia.operators.snapshot import content_fingerprint
    frame = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    mixed = frame.repartition(7).select(*reversed(frame.columns))
    assert content_fingerprint(frame).first() == content_fingerprint(mixed).first()
    assert content_fingerprint(frame).first() != content_fingerprint(frame.limit(10)).first()
    doubled = content_fingerprint(frame.unionByName(frame)).first()
    assert doubled.hash_xor == 0 and doubled.row_count == 2 * frame.count()
