import os

import pytest

DATA = "/root/testdata/sf0.001"


def _names():
    from mailward.plans import QUERIES

    return list(QUERIES)


def _normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", _names())
def test_equals_sql(spark, name):
    import duckdb

    from mailward.plans import ORACLES, QUERIES

    db = duckdb.connect()
    for t in ("customer", "part", "events", "documents", "lineitem", "orders", "pages", "supplier"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    frame, twin = QUERIES[name](spark, DATA), db.execute(ORACLES[name])
    columns = [c[0] for c in twin.description]
    assert sorted(frame.columns) == sorted(columns)
    assert _normal(frame.collect(), frame.columns) == _normal(twin.fetchall(), columns)


def test_catalogue_is_one_exchange(spark):
    from mailward.operators.metrics import counted
    from mailward.schema import ALL, COLUMNS

    empty = spark.createDataFrame([], ", ".join(f"{c} {COLUMNS[c]}" for c in ALL))
    plan = counted(empty.repartition(2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2


def test_registry_without_corpus_operators(monkeypatch):
    import __spark_entry__

    real = __spark_entry__.importlib.import_module

    def missing(name, *a):
        if name in ("mailward.llm", "corpus_pipeline"):
            raise ImportError(name)
        return real(name, *a)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", missing)
    assert not [k for k in __spark_entry__.queries() if k.startswith("op") or k == "pipeline"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
