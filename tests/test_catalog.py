"""Every registered query of the engine's own operators equals its SQL on the smallest tables."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def clean(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else None if isinstance(v, float) else v


def test_queries_equal_their_sql(spark):
    import duckdb

    from corpusloom import registry
    from corpusloom.plans.standins import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql, wrong = registry.oracle_sql(), []
    for name, query in registry.queries().items():
        df = query(spark, SF)
        cols = sorted(df.columns)
        got = sorted((tuple(clean(r[c]) for c in cols) for r in df.collect()), key=repr)
        spark.catalog.clearCache()
        if name in sql:
            res = con.execute(sql[name])
            names = [d[0] for d in res.description]
            order = sorted(range(len(names)), key=names.__getitem__)
            want = sorted((tuple(clean(r[i]) for i in order) for r in res.fetchall()), key=repr)
            if cols != sorted(names) or got != want:
                wrong.append(name)
    assert wrong == []


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
