"""Rows of two engines, brought to one form."""

import math

DATA = "/root/testdata"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, values):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted((tuple(plain(r[i]) for i in at) for r in values), key=repr)


def same(spark_df, relation):
    mine = rows(spark_df.columns, spark_df.collect())
    theirs = rows(relation.columns, relation.fetchall())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1]
