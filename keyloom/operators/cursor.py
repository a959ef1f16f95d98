"""Positional reads: ends, floor and ceiling, steps and pages, over primary keys or (key, member) pairs."""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidOptions, NotFound
from ..sources.model import Bound
from .numbering import beside
from .write import in_range


def scan(bound: Bound) -> DataFrame:
    """All rows in key order."""
    return bound.rows.orderBy(*bound.by_pk())


def key_range(bound: Bound, start=None, end=None) -> DataFrame:
    return bound.rows.where(in_range(bound.space.pk[0], start, end))


def key_prefix(bound: Bound, prefix=None) -> DataFrame:
    """Text and binary keys that start with the prefix; keys of fixed width that equal it. None or empty: all."""
    first = bound.space.pk[0]
    if prefix is None or prefix in ("", b""):
        return bound.rows
    text = dict(bound.rows.dtypes)[first] in ("string", "binary")
    return bound.rows.where(F.startswith(F.col(first), F.lit(prefix)) if text else F.col(first) == F.lit(prefix))


def get(bound: Bound, *key):
    """The row of a key."""
    got = seek(bound, *key).take(1)
    if not got:
        raise NotFound(key)
    return got[0]


def _compare(bound: Bound, key, strict: bool, below: bool) -> SparkColumn:
    """The primary key against a tuple."""
    if len(key) != len(bound.space.pk):
        raise InvalidOptions(f"{bound.space.name} has {len(bound.space.pk)} key columns")
    out, same = F.lit(False), F.lit(True)
    for c, v in zip(bound.space.pk, key, strict=True):
        k, x = F.col(c), F.lit(v)
        out = out | (same & (k < x if below else k > x))
        same = same & (k == x)
    return out if strict else out | same


def seek(bound: Bound, *key) -> DataFrame:
    cond = F.lit(True)
    for c, v in zip(bound.space.pk, key, strict=True):
        cond = cond & (F.col(c) == F.lit(v))
    return bound.rows.where(cond).limit(1)


def first(bound: Bound, n: int = 1) -> DataFrame:
    return bound.rows.orderBy(*bound.by_pk()).limit(n)


def last(bound: Bound, n: int = 1) -> DataFrame:
    return bound.rows.orderBy(*bound.by_pk(True)).limit(n)


def seek_ge(bound: Bound, *key, n: int = 1) -> DataFrame:
    """The smallest keys that aren't below this one."""
    return bound.rows.where(_compare(bound, key, False, False)).orderBy(*bound.by_pk()).limit(n)


def seek_gt(bound: Bound, *key, n: int = 1) -> DataFrame:
    """The next page after a key."""
    return bound.rows.where(_compare(bound, key, True, False)).orderBy(*bound.by_pk()).limit(n)


def seek_le(bound: Bound, *key, n: int = 1) -> DataFrame:
    """The floor: the largest keys that aren't above this one."""
    return bound.rows.where(_compare(bound, key, False, True)).orderBy(*bound.by_pk(True)).limit(n)


def seek_lt(bound: Bound, *key, n: int = 1) -> DataFrame:
    return bound.rows.where(_compare(bound, key, True, True)).orderBy(*bound.by_pk(True)).limit(n)


def pages(bound: Bound, size: int):
    """Pages of rows in key order, each read from where the last ended."""
    key = None
    while True:
        page = (first(bound, size) if key is None else seek_gt(bound, *key, n=size)).collect()  # size rows at most
        if page:
            yield page
        if len(page) < size:
            return
        key = [page[-1][c] for c in bound.space.pk]


def neighbours(bound: Bound, group: str | None = None) -> DataFrame:
    """Every row with the next and the previous key inside its group (a column; without one over the whole table)."""
    key = F.struct(*bound.space.pk)
    if group is None:
        return beside(bound.rows, bound.by_pk(), key, "next", "previous")
    w = Window.partitionBy(group).orderBy(*bound.by_pk())
    return bound.rows.withColumn("next", F.lead(key).over(w)).withColumn("previous", F.lag(key).over(w))
