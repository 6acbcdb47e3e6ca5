"""Every registered query against its DuckDB twin on the smallest tables."""

import duckdb
import pytest

from evoframe.plans import queries, task_queries  # noqa: F401
from evoframe.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings labels benchmark conversations events lineitem orders part".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in sorted(found.columns))
    duck.register("found", found.toArrow())
    duck.execute("CREATE OR REPLACE TABLE ours AS SELECT * FROM found")
    duck.execute(f"CREATE OR REPLACE TABLE theirs AS {ORACLE_SQL[name]}")
    for a, b in (("ours", "theirs"), ("theirs", "ours")):
        assert duck.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b} LIMIT 3").fetchall() == []
    kinds = {t: dict(duck.execute(f"SELECT column_name, data_type FROM information_schema.columns WHERE table_name = '{t}'").fetchall()) for t in ("ours", "theirs")}
    assert kinds["ours"] == kinds["theirs"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
