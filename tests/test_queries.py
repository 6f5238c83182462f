"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from inkstone.plans import registry
from tests.conftest import DATA

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def cell(x):
    return None if x is None or isinstance(x, float) and math.isnan(x) else float(f"{x:.5f}") if isinstance(x, float) else x


def canon(rows):
    return sorted((tuple(cell(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert canon(df.select(*columns).collect()) == canon(found)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_a_row_for_each_document(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
