"""Set keyspaces: membership, counts, navigation inside a set and between keys, and their write verbs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NotFound, ValueSizeMismatch
from ..sources.model import Bound, Keyspace
from .write import in_range, require_keys


def has(bound: Bound, key) -> bool:
    return not bound.rows.where(F.col(bound.space.key) == F.lit(key)).isEmpty()


def has_value(bound: Bound, key, member) -> bool:
    return not bound.rows.where((F.col(bound.space.key) == F.lit(key)) & (F.col(bound.space.member) == F.lit(member))).isEmpty()


def members(bound: Bound, key) -> DataFrame:
    return bound.rows.where(F.col(bound.space.key) == F.lit(key)).orderBy(bound.space.member)


def count_values(bound: Bound, key) -> int:
    return bound.rows.where(F.col(bound.space.key) == F.lit(key)).count()


def counts(bound: Bound) -> DataFrame:
    """Members of every key: key, n."""
    return bound.rows.groupBy(bound.space.key).agg(F.count("*").alias("n"))


def ends(bound: Bound) -> DataFrame:
    """First and last member of every key."""
    m = bound.space.member
    return bound.rows.groupBy(bound.space.key).agg(F.min(m).alias("first"), F.max(m).alias("last"))


def steps(bound: Bound) -> DataFrame:
    """Every pair with the next and the previous member of the same key."""
    w = Window.partitionBy(bound.space.key).orderBy(bound.space.member)
    m = F.col(bound.space.member)
    return bound.rows.select("*", F.lead(m).over(w).alias("next"), F.lag(m).over(w).alias("previous"))


def next_key(bound: Bound, key) -> DataFrame:
    """The first member of the next key."""
    k, m = bound.space.key, bound.space.member
    return bound.rows.where(F.col(k) > F.lit(key)).groupBy(k).agg(F.min(m).alias(m)).orderBy(k).limit(1)


def previous_key(bound: Bound, key) -> DataFrame:
    """The first member of the previous key."""
    k, m = bound.space.key, bound.space.member
    return bound.rows.where(F.col(k) < F.lit(key)).groupBy(k).agg(F.min(m).alias(m)).orderBy(F.desc(k)).limit(1)


def put(bound: Bound, new: DataFrame) -> tuple[Bound, DataFrame]:
    """Add members; the pairs that weren't there before. Members of a fixed-size set must have that size."""
    k, m = bound.space.key, bound.space.member
    require_keys(Bound(Keyspace(bound.space.name, k), bound.rows, {}), new)
    size = bound.space.fixed_size
    if size is not None and not new.where(F.octet_length(F.col(m).cast("binary")) != size).isEmpty():
        raise ValueSizeMismatch(bound.space.name)
    added = new.select(k, m).distinct().join(bound.rows, [k, m], "left_anti")
    return Bound(bound.space, bound.rows.unionByName(added), {}), added


def delete(bound: Bound, keys: DataFrame) -> Bound:
    """Remove whole sets; each key must have one."""
    k = bound.space.key
    if not keys.select(k).join(bound.rows, k, "left_anti").isEmpty():
        raise NotFound(bound.space.name)
    return Bound(bound.space, bound.rows.join(keys.select(k).distinct(), k, "left_anti").select(*bound.space.pk), {})


def delete_values(bound: Bound, pairs: DataFrame) -> Bound:
    """Remove members; each must be there."""
    pk = list(bound.space.pk)
    if not pairs.select(*pk).join(bound.rows, pk, "left_anti").isEmpty():
        raise NotFound(bound.space.name)
    return Bound(bound.space, bound.rows.join(pairs.select(*pk).distinct(), pk, "left_anti").select(*pk), {})


def delete_range(bound: Bound, start=None, end=None) -> tuple[Bound, Callable[[], int]]:
    """Remove the sets of keys in [start, end); the pairs left, and a function that counts the members that went."""
    gone = in_range(bound.space.key, start, end)
    return Bound(bound.space, bound.rows.where(~gone), {}), lambda: bound.rows.where(gone).count()


def matching(bound: Bound, asked: DataFrame) -> DataFrame:
    """Those of the asked keys that have a set, or (with a member column) those of the asked pairs that are there; each once."""
    by = [c for c in bound.space.pk if c in asked.columns]
    return asked.select(*by).distinct().join(bound.rows, by, "left_semi")


def scan(bound: Bound) -> DataFrame:
    """All pairs, members in order inside their key."""
    return bound.rows.orderBy(*bound.by_pk())


def key_range(bound: Bound, start=None, end=None) -> DataFrame:
    """The pairs of keys in [start, end)."""
    return bound.rows.where(in_range(bound.space.key, start, end))


def seek_value(bound: Bound, key, member) -> DataFrame:
    """The pair itself, or nothing: never a pair of another key."""
    return bound.rows.where((F.col(bound.space.key) == F.lit(key)) & (F.col(bound.space.member) == F.lit(member)))
