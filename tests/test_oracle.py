"""Every registered query of the vector engine against its SQL, on the smallest tables."""

import duckdb
import pytest
from tests.conftest import SF

from stratavec.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: v if isinstance(v, (bool, str, type(None))) else float(v)
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    wanted = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    assert rows_of(found.collect(), found.columns) == rows_of(wanted.fetchall(), columns)


def test_entry_has_every_query():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_batches_leave_out_no_target_or_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    n, targets = table.count(), table.filter("label = 5").count()
    assert sum(r["n"] for r in QUERIES["class_distance_stats"](spark, SF).collect()) == n * targets
    assert {r["qid"] for r in QUERIES["knn_1bit_fp16_k10"](spark, SF).collect()} == set(range(0, n, 100))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_what_rounds_to_zero_in_half_precision_has_no_sign(spark, tmp_path):
    """Beyond 50,000 rows some value is so near zero that only its sign would be left."""
    con, dim = duckdb.connect(), 64
    tiny = [-1e-8, 1e-8, -(2.0**-25), 2.0**-25, -1.5 * 2.0**-25, 1.5 * 2.0**-24, -2.5 * 2.0**-24, -(2.0**-14), 0.0]
    con.execute(f"CREATE TABLE embeddings AS SELECT i AS vec_id, list_transform(range({dim}), lambda j: CASE WHEN j < {len(tiny)} THEN ({tiny}[j + 1] * (1 + i))::FLOAT ELSE sin(i * {dim} + j)::FLOAT END) AS embedding, 0::INTEGER AS label FROM range(20) t(i)")
    con.execute(f"COPY embeddings TO '{tmp_path}/embeddings.parquet'")
    found, wanted = QUERIES["column_bytes"](spark, str(tmp_path)), con.execute(ORACLE_SQL["column_bytes"])
    columns = [d[0] for d in wanted.description]
    assert rows_of(found.collect(), found.columns) == rows_of(wanted.fetchall(), columns)
