from __future__ import annotations

import math

import duckdb

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, size double, source_ string, bucket long, label int"


def documents(spark, rows):
    """A table of (doc_id, text, source) with columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "k", 1, 2.5, "s", 3, 1) for i, t, s in rows], COLUMNS)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def duck(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toArrow())
    return con.sql(sql)


def same(spark_df, relation):
    """Rows of equal columns and values, floats within 1e-9."""
    columns = sorted(spark_df.columns)
    assert columns == sorted(relation.columns)
    key = lambda r: tuple((x is None, round(x, 5) if isinstance(x, float) else x if x is not None else 0) for x in r)
    a = sorted((tuple(r) for r in spark_df.select(*columns).collect()), key=key)
    b = sorted(relation.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall(), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9), (x, y)
