"""Every query with SQL gives what DuckDB gives on the same tables; the others run."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from foliolake.functions import text as T
from foliolake.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, db, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in ORACLES:
        return
    q = db.execute(ORACLES[name])
    names = [x[0] for x in q.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in q.fetchall()), key=str)
    assert got == want


def test_privileges_of_all_bits(spark, tmp_path):
    """Ids with bits over the tenth, which sf0.001 and sf0.01 do not have."""
    spark.range(-2, 5000).selectExpr("id AS doc_id").union(spark.sql("SELECT NULL")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(ORACLES["privileges"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, QUERIES["privileges"](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
    every = spark.range(1).select(T.privileges(F.lit(-1))).first()[0]
    assert every == list(T.PERMISSIONS)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
