"""Keyed write verbs as functions from rows to rows. Nothing changes in place; a refused write raises and changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BulkLoadNonEmpty, BulkLoadOutOfOrder, KeyEmpty, KeyExists, NotFound
from ..functions.columns import Column
from ..sources.model import Bound
from .index import require_unique, require_unique_added
from .numbering import beside, numbered


def _keys(bound: Bound) -> list[str]:
    return list(bound.space.pk)


def require_keys(bound: Bound, rows: DataFrame) -> None:
    """Keys are neither null nor empty."""
    bad = F.lit(False)
    for c, kind in rows.select(*_keys(bound)).dtypes:
        bad = bad | F.col(c).isNull()
        if kind in ("string", "binary"):
            bad = bad | (F.octet_length(c) == 0)
    if not rows.where(bad).isEmpty():
        raise KeyEmpty(bound.space.name)


def last_of(bound: Bound, rows: DataFrame, sequence: str | None) -> DataFrame:
    """One row for each key: the one of the highest sequence (without a sequence column, keys must be distinct)."""
    pk = _keys(bound)
    if sequence is None:
        if not rows.groupBy(*pk).count().where("count > 1").isEmpty():
            raise KeyExists("a key twice in one batch, without a sequence column")
        return rows
    w = Window.partitionBy(*pk).orderBy(F.desc(sequence))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", sequence)


def _with(bound: Bound, kept: DataFrame, new: DataFrame) -> Bound:
    """``kept`` rows and ``new`` ones. Of unique indexes only the new rows' keys are looked at."""
    for i in bound.space.indexes:
        if i.unique:
            require_unique_added(Bound(bound.space, kept, {}), i, new)
    return Bound(bound.space, kept.unionByName(new), {})


def put(bound: Bound, new: DataFrame, sequence: str | None = None) -> Bound:
    """Upsert."""
    require_keys(bound, new)
    new = last_of(bound, new, sequence).select(*bound.rows.columns)
    return _with(bound, bound.rows.join(new, _keys(bound), "left_anti").select(*bound.rows.columns), new)


def insert(bound: Bound, new: DataFrame) -> Bound:
    """Add rows of new keys only."""
    require_keys(bound, new)
    new = last_of(bound, new, None)
    if not new.join(bound.rows, _keys(bound), "left_semi").isEmpty():
        raise KeyExists(bound.space.name)
    return _with(bound, bound.rows, new)


def replace(bound: Bound, new: DataFrame) -> Bound:
    """Change rows of present keys only."""
    if not new.join(bound.rows, _keys(bound), "left_anti").isEmpty():
        raise NotFound(bound.space.name)
    return put(bound, new)


def delete(bound: Bound, keys: DataFrame) -> Bound:
    """Remove rows by key; each key must be there."""
    if not keys.select(*_keys(bound)).join(bound.rows, _keys(bound), "left_anti").isEmpty():
        raise NotFound(bound.space.name)
    return Bound(bound.space, bound.rows.join(keys.select(*_keys(bound)).distinct(), _keys(bound), "left_anti").select(*bound.rows.columns), {})


def in_range(column: str, start=None, end=None) -> SparkColumn:
    """start <= column < end; an open side is None. Empty bounds are refused."""
    if start in ("", b"") or end in ("", b""):
        raise KeyEmpty(column)
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(column) >= F.lit(start))
    if end is not None:
        out = out & (F.col(column) < F.lit(end))
    return out


def _remove(bound: Bound, gone: SparkColumn) -> tuple[Bound, Callable[[], int]]:
    return Bound(bound.space, bound.rows.where(~gone), {}), lambda: bound.rows.where(gone).count()


def delete_range(bound: Bound, start=None, end=None) -> tuple[Bound, Callable[[], int]]:
    """Remove keys in [start, end) of the first key column; the rows left, and a function that counts those that went."""
    return _remove(bound, in_range(bound.space.pk[0], start, end))


def delete_prefix(bound: Bound, prefix=None) -> tuple[Bound, Callable[[], int]]:
    """Remove keys that start with the prefix; none or an empty one removes all. Counted as in ``delete_range``."""
    return _remove(bound, F.startswith(F.col(bound.space.pk[0]), F.lit(prefix)) if prefix else F.lit(True))


def bulk_load(bound: Bound, rows: DataFrame, sequence: str | None = None) -> Bound:
    """Fill an empty keyspace. Keys must be distinct, and ascending along the sequence column if one is given."""
    if not bound.rows.isEmpty():
        raise BulkLoadNonEmpty(bound.space.name)
    require_keys(bound, rows)
    pk = _keys(bound)
    if not rows.groupBy(*pk).count().where("count > 1").isEmpty():
        raise BulkLoadOutOfOrder(bound.space.name)
    if sequence is not None:
        _require_ascending(bound, rows, sequence)
        rows = rows.drop(sequence)
    out = Bound(bound.space, rows, {})
    for i in bound.space.indexes:
        if i.unique:
            require_unique(out, i)
    return out


def _require_ascending(bound: Bound, rows: DataFrame, sequence: str) -> None:
    """In order of the sequence each key must be above the one before."""
    keys = rows.select(F.col(sequence).alias("s"), F.struct(*_keys(bound)).alias("k"))
    got = beside(keys, [F.col("s")], F.col("k"), "after", "before")
    if not got.where(F.col("before") >= F.col("k")).isEmpty():
        raise BulkLoadOutOfOrder(bound.space.name)


def next_sequences(rows: DataFrame, last: int, column: str = "seq", order: list[str] | None = None) -> DataFrame:
    """Number rows last+1, last+2, ... in the given order; partitions are numbered side by side."""
    return numbered(rows, [F.col(c) for c in order or rows.columns[:1]], column, last + 1)


__all__ = [
    "Column", "bulk_load", "delete", "delete_prefix", "delete_range", "in_range", "insert", "last_of", "next_sequences", "put", "replace", "require_keys",
]
