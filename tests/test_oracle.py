"""Every registered query against its SQL oracle (DuckDB) on the small tables."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from newslens.sources.tables import TABLES

from conftest import SF_SMALL


def _canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 9))
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha256("\n".join(sorted("|".join(_canon(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_is_registered_with_an_oracle_or_is_iterative():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    # Rows-only: seeded k-means and density topics are iterative, not SQL queries. The corpus operators
    # (op<N>_*, pipeline) have brute-force tests of their own.
    rest = {q for q in set(qs) - set(sql) if not (q == "pipeline" or q.startswith("op"))}
    assert rest == {"topic_clusters", "document_enrichment", "topic_density"}


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if not n.startswith("op")))
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert _digest(df.columns, srows) == _digest(ocols, orows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["topic", "pol_leaning", "pct", "status"]
    assert df.count() >= 0


def test_clusters_rows(spark):
    df = E.queries()["topic_clusters"](spark, SF_SMALL)
    assert df.count() == spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").count()
    assert df.where("topic_nr < -1").count() == 0
