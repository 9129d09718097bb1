"""Every registered query with SQL gives the rows that SQL gives."""

import glob
import math
import os

import duckdb
import pytest

from lumenframe.plans import object_queries, queries  # noqa: F401


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def sql(sf_dir):
    db = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return db


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, sf_dir, sql, name):
    got = queries.QUERIES[name](spark, sf_dir)
    mine = rows(got.columns, got.collect())
    want = sql.execute(queries.ORACLE[name])
    assert mine == rows([d[0] for d in want.description], want.fetchall())
    assert mine[1]
