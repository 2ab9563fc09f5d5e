"""Every query with checking SQL against DuckDB on the smallest tables."""

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return con


def rows(columns, values):
    """Rows as sorted texts of typed values, columns by name; integers stay integers beside nulls."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    text = lambda v: "null" if v is None or v != v else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, sf_dir, name):
    got, want = entry.queries()[name](spark, sf_dir), duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_documents_do_not_depend_on_partitions(spark, sf_dir):
    from factengine.operators.publish import payloads
    from factengine.plans.registry import Tables
    from factengine.sources.sinks import documents_json

    t = Tables(spark, sf_dir)
    columns = ["filing", "quality", "source", "facts", "lineage", "limitations"]
    make = lambda facts, results: {r.filing_id: r.etag for r in documents_json(payloads(t.v_filings, facts, results, t.v_versions), columns).select("filing_id", "etag").collect()}
    facts, results = t.v_norm.cache(), t.v_results.cache()
    assert make(facts, results) == make(facts.repartition(7, "value"), results.repartition(5, "message"))
