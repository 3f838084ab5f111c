"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from codeloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    r = duck.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert mine == sorted(repr(tuple(plain(x[names.index(c)]) for c in cols)) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(SQL) <= set(e.oracle_sql()) and set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_training_data_part(monkeypatch):
    """With that part hidden the rest imports; what is missing elsewhere is an error."""
    import importlib
    import sys

    import __spark_entry__ as e

    with monkeypatch.context() as m:
        for name in [n for n in sys.modules if n.startswith("codeloom.llm") or n == "corpus_pipeline"]:
            m.delitem(sys.modules, name)
        m.setitem(sys.modules, "codeloom.llm", None)
        m.setitem(sys.modules, "corpus_pipeline", None)
        bare = importlib.reload(e)
        assert bare.llm is None and bare.corpus_pipeline is None
        assert set(bare.queries()) == set(QUERIES) and set(bare.oracle_sql()) == set(SQL)
        assert not bare._absent(ModuleNotFoundError("no", name="numpy"))
    importlib.reload(e)
