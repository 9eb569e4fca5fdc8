"""Small helpers that every operator here uses."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import new_path, remove, shared_dir, swept

__all__ = ["LOWER", "UPPER", "fold", "materialise", "new_path", "plus", "remove", "scratch", "shared_dir", "swept", "with_columns"]

#: ASCII upper case and its lower case: the only letters that the contracts fold.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_scopes: list[list[str]] = []


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back. Inside scratch() the table goes when that ends, or with keep when the scratch() around it does."""
    path = new_path(df.sparkSession, name)
    with swept(df.sparkSession):
        df.write.parquet(path)
    around = _scopes[:-1] if keep else _scopes
    if around:
        around[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialised inside is deleted at the end; nothing that is read later may come of it unwritten."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def with_columns(df: DataFrame, **columns) -> DataFrame:
    """Like withColumns, but a column that df has already (in any case) is replaced and goes to the end."""
    taken = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in columns.items()])


def fold(doc_id, of: int):
    """crc32 of the id's text, modulo: the split that labels are learnt and held out by. A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % of, F.lit(0))


def plus(df: DataFrame, **types: str) -> T.StructType:
    """df's schema and further columns (DDL types)."""
    return T.StructType([*df.schema.fields, *[T.StructField(k, T._parse_datatype_string(v)) for k, v in types.items()]])
