"""Every registered query gives the rows of its SQL."""

import glob
import math
import os

import duckdb
import pytest
from tables import DATA

from citespan.plans.catalogue import ORACLE_SQL, QUERIES

SF = f"{DATA}/sf0.001"


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return str(bytes(value)) if isinstance(value, bytearray) else str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(shown(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.execute(ORACLE_SQL[name])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", ["fts_phrase", "fts_or", "fts_first", "fts_stemmed", "fts_and", "fts_column"])
def test_text_search_writes_no_index(spark, monkeypatch, name):
    """A search costs the same whether or not another one went before it: no index of all words is made."""
    from citespan.sources import corpus

    monkeypatch.setattr(corpus, "scratch", lambda spark: pytest.fail("written"))
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["manifest_cargo", "manifest_package_json", "manifest_pyproject", "run_configs", "symbols_extracted"])
def test_rendered_files_are_parsed_by_many_tasks(spark, name):
    """A table of one split is many tasks' work, as a row is little to read and much to parse."""
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() >= 8


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
