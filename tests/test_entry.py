"""Every query of the core against its SQL on the smallest data."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quirewright.plans import catalogue


def normal(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def rows(records, names):
    return sorted((tuple(str(normal(r[n])) for n in names) for r in records), key=str)


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, folder, duck, name):
    ours = entry.queries()[name](spark, folder)
    frame = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in frame.description]
    theirs = [dict(zip(names, r)) for r in frame.fetchall()]
    assert sorted(ours.columns) == sorted(names)
    assert rows([r.asDict() for r in ours.collect()], sorted(names)) == rows(theirs, sorted(names))


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, folder, name):
    assert entry.queries()[name](spark, folder).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "quirewright")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "quirewright.llm" not in open(os.path.join(folder, f)).read(), f
