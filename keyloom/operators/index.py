"""Index entries as DataFrames: extraction, uniqueness, lookups, upkeep and checks."""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IndexNotUnique, IndexUniqueViolation, InvalidOptions, NotFound
from ..functions.columns import MultiColumn
from ..sources.model import Bound, ColumnIndex, SetKeyspace

VALUE = "_value"


def key_name(c) -> str:
    return f"_k_{c.name}"


def cover_name(c) -> str:
    return f"_c_{c.name}"


def candidates(bound: Bound, index: ColumnIndex, rows: DataFrame | None = None) -> DataFrame:
    """The multiset of entries before equal ones of a row collapse: key columns, primary key, covered values."""
    df = bound.rows if rows is None else rows
    if index.where is not None:
        df = df.where(index.where)
    pk = list(bound.space.pk)
    cols = [F.col(c) for c in pk]
    cols += [F.coalesce(c.expr(), F.array()).alias(key_name(c)) if isinstance(c, MultiColumn) else c.expr().alias(key_name(c)) for c in index.columns]
    cols += [c.expr().alias(cover_name(c)) for c in index.covering]
    if index.cover_value:
        cols.append(F.struct(*[F.col(c) for c in df.columns]).alias(VALUE))
    out = df.select(*cols)
    for c in index.columns:
        if isinstance(c, MultiColumn):
            out = out.withColumn(key_name(c), F.explode(key_name(c)))
    return out


def collapsed(bound: Bound, index: ColumnIndex, rows: DataFrame | None = None) -> DataFrame:
    """The entries of rows, not checked: equal ones of one row are one."""
    got = candidates(bound, index, rows)
    if any(isinstance(c, MultiColumn) for c in index.columns):
        got = got.dropDuplicates([key_name(c) for c in index.columns] + list(bound.space.pk))
    return got


def entries(bound: Bound, index: ColumnIndex) -> DataFrame:
    """Entries of an index: stored ones if bound, else extracted, and a unique index is checked."""
    if index.name in bound.entries:
        return bound.entries[index.name]
    if index.unique:
        require_unique(bound, index)
    return collapsed(bound, index)


def violations(bound: Bound, index: ColumnIndex) -> DataFrame:
    """Keys that more than one candidate entry has, within a row or across rows: key columns and n."""
    enc = [c.encoder.apply(F.col(key_name(c))).alias(key_name(c)) for c in index.columns]
    return candidates(bound, index).select(*enc).groupBy(*[key_name(c) for c in index.columns]).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(bound: Bound, index: ColumnIndex) -> None:
    if not violations(bound, index).isEmpty():
        raise IndexUniqueViolation(index.name)


def _encoded_keys(bound: Bound, index: ColumnIndex, rows: DataFrame) -> DataFrame:
    return candidates(bound, index, rows).select(*[c.encoder.apply(F.col(key_name(c))).alias(key_name(c)) for c in index.columns])


def require_unique_added(bound: Bound, index: ColumnIndex, new: DataFrame) -> None:
    """``new`` rows may neither repeat a key among themselves nor have one of the bound rows'."""
    keys = [key_name(c) for c in index.columns]
    fresh = _encoded_keys(bound, index, new).groupBy(*keys).agg(F.count("*").alias("n"))
    taken = _encoded_keys(bound, index, bound.rows).join(fresh, keys, "left_semi").select(F.lit(1))
    if not fresh.where("n > 1").select(F.lit(1)).unionByName(taken).isEmpty():
        raise IndexUniqueViolation(index.name)


def sorted_entries(bound: Bound, index: ColumnIndex) -> DataFrame:
    """Entries range-partitioned and sorted by key and primary key: row groups then prune ranges."""
    by = [*[key_name(c) for c in index.columns], *bound.space.pk]
    return entries(bound, index).repartitionByRange(*by).sortWithinPartitions(*by)


def _point(index: ColumnIndex, values) -> SparkColumn:
    out = F.lit(True)
    for c, v in zip(index.columns, values, strict=False):
        out = out & (c.encoder.apply(F.col(key_name(c))) == c.encoder.literal(v))
    return out


def _tuple_bound(index: ColumnIndex, values, upper: bool, of=lambda c: F.col(key_name(c))) -> SparkColumn:
    """(key columns) < values, or >= values, compared as tuples; the values may be fewer than the columns."""
    same = F.lit(True)
    terms = []
    for c, v in zip(index.columns, values, strict=False):
        k, x = c.encoder.apply(of(c)), c.encoder.literal(v)
        terms.append(same & (k < x if upper else k > x))
        same = same & (k == x)
    out = terms[0]
    for t in terms[1:]:
        out = out | t
    out = out if upper else out | same
    # implied by the tuple, and simple enough for the scan: the first column's own bound
    k, x = index.columns[0].encoder.apply(of(index.columns[0])), index.columns[0].encoder.literal(values[0])
    return (k <= x if upper else k >= x) & out


class IndexReader:
    """Direct reads of one index.

    Entries are read where they are stored and hold what is asked. Everything else is one filter over the rows, which Catalyst pushes to
    their scan: with entries that would have to be cut from the same rows, or joined back to them, the rows would only be read twice.
    Results are in no order unless ``reverse`` is given: False is key order, True its exact reverse.
    """

    def __init__(self, bound: Bound, name: str):
        self.bound, self.index = bound, bound.space.index(name)
        self.stored = name in bound.entries
        self.order = [*[key_name(c) for c in self.index.columns], *bound.space.pk]

    @property
    def entries(self) -> DataFrame:
        return self.bound.entries[self.index.name] if self.stored else collapsed(self.bound, self.index)

    def _ordered(self, df: DataFrame, reverse: bool | None) -> DataFrame:
        if reverse is None:
            return df
        by = [*[c.encoder.apply(F.col(key_name(c))) for c in self.index.columns], *[F.col(c) for c in self.bound.space.pk]]
        return df.orderBy(*[c.desc() if reverse else c.asc() for c in by])

    def _arity(self, values, exact: bool) -> None:
        n = len(self.index.columns)
        if len(values) > n or (exact and len(values) != n):
            raise InvalidOptions(f"{self.index.name} has {n} columns, {len(values)} values were given")

    def _rows(self, hit: SparkColumn, on_entry: SparkColumn, reverse: bool | None) -> DataFrame:
        """Rows by a condition on them, or by the same condition on their entries; a row comes once, at its first entry."""
        pk = list(self.bound.space.pk)
        if self.index.cover_value and self.stored:
            got = self._ordered(self.entries.where(on_entry), reverse)
            if any(isinstance(c, MultiColumn) for c in self.index.columns):
                got = self._once(self.entries.where(on_entry), reverse, F.first(VALUE).alias(VALUE))
            return got.select(f"{VALUE}.*")
        rows = self.bound.rows if self.index.where is None else self.bound.rows.where(self.index.where)
        rows = rows.where(hit)
        for c in self.index.columns:
            if isinstance(c, MultiColumn):
                rows = rows.where(F.size(F.coalesce(c.expr(), F.array())) > 0)  # without a value there is no entry
        if reverse is None:
            return rows
        if any(isinstance(c, MultiColumn) for c in self.index.columns):
            value = F.struct(*[F.col(c) for c in rows.columns]).alias(VALUE)
            keyed = collapsed(Bound(self.bound.space, rows, {}), ColumnIndex(self.index.name, self.index.columns))
            keyed = keyed.where(on_entry).join(rows.select(*pk, value), pk)
            return self._once(keyed, reverse, F.first(VALUE).alias(VALUE)).select(f"{VALUE}.*")
        by = [*[c.encoded() for c in self.index.columns], *[F.col(c) for c in pk]]
        return rows.orderBy(*[c.desc() if reverse else c.asc() for c in by])

    def _once(self, hits: DataFrame, reverse: bool | None, value: SparkColumn) -> DataFrame:
        pk = list(self.bound.space.pk)
        key = F.struct(*[c.encoder.apply(F.col(key_name(c))) for c in self.index.columns])
        got = hits.groupBy(*pk).agg(F.min(key).alias("_first"), value)
        return got if reverse is None else got.orderBy(*[F.col(c).desc() if reverse else F.col(c).asc() for c in ("_first", *pk)])

    def _point_on_rows(self, values) -> SparkColumn:
        out = F.lit(True)
        for c, v in zip(self.index.columns, values, strict=False):
            out = out & (c.contains(v) if isinstance(c, MultiColumn) else c.eq(v)).condition()
        return out

    def lookup(self, *values, reverse: bool | None = None) -> DataFrame:
        """Rows with an entry of all these values."""
        self._arity(values, True)
        return self._rows(self._point_on_rows(values), _point(self.index, values), reverse)

    def lookup_keys(self, *values, reverse: bool | None = None) -> DataFrame:
        """Primary keys of entries of all these values; rows aren't read where entries are stored."""
        if isinstance(self.bound.space, SetKeyspace):
            raise InvalidOptions("entries of a set keyspace are (key, member) pairs")
        self._arity(values, True)
        return self._ordered(self.entries.where(_point(self.index, values)), reverse).select(*self.bound.space.pk)

    def range_entries(self, start=None, end=None, reverse: bool | None = None) -> DataFrame:
        """Entries with start <= key < end, keys compared as tuples; a bound may have fewer columns, none is open."""
        if isinstance(self.bound.space, SetKeyspace):
            raise InvalidOptions("entries of a set keyspace are (key, member) pairs")
        return self._ordered(self.entries.where(self._between(start, end, lambda c: F.col(key_name(c)))), reverse)

    def _between(self, start, end, of) -> SparkColumn:
        out = F.lit(True)
        for bound, upper in ((start, False), (end, True)):
            if bound is not None:
                self._arity(bound, False)
                out = out & _tuple_bound(self.index, bound, upper, of) if len(bound) else out
        return out

    def range(self, start=None, end=None, reverse: bool | None = None) -> DataFrame:
        """Rows with an entry in the range."""
        on_entry = self._between(start, end, lambda c: F.col(key_name(c)))
        if any(isinstance(c, MultiColumn) for c in self.index.columns) and not (self.index.cover_value and self.stored):
            pk = list(self.bound.space.pk)  # a tuple of several values has no condition on the row
            hits = self._once(self.entries.where(on_entry), None, F.lit(None).alias("_none"))
            got = self.bound.rows.join(hits.select(*pk, "_first"), pk)
            got = got if reverse is None else got.orderBy(*[F.col(c).desc() if reverse else F.col(c).asc() for c in ("_first", *pk)])
            return got.select(*self.bound.rows.columns)
        hit = F.lit(True) if self.index.cover_value and self.stored else self._between(start, end, lambda c: c.expr())
        return self._rows(hit, on_entry, reverse)

    def prefix(self, *values, reverse: bool | None = None) -> DataFrame:
        """Rows with an entry whose first columns are these values: whole values, no beginnings of texts. None: all that have an entry."""
        self._arity(values, False)
        return self._rows(self._point_on_rows(values), _point(self.index, values), reverse)

    def find(self, *values) -> DataFrame:
        """The one row of a unique key, or none, as a frame."""
        if not self.index.unique:
            raise IndexNotUnique(self.index.name)
        return self.lookup(*values).limit(1)

    def get(self, *values):
        """The one row of a unique key."""
        got = self.find(*values).take(1)
        if not got:
            raise NotFound(values)
        return got[0]


class TypedIndex(IndexReader):
    """Reads of an index with one key column, bound to the Spark type of its keys; a column of another type is refused at once."""

    def __init__(self, bound: Bound, name: str, key: T.DataType):
        super().__init__(bound, name)
        if len(self.index.columns) != 1:
            raise InvalidOptions(f"{name} has {len(self.index.columns)} columns")
        c = self.index.columns[0]
        got = bound.rows.select(c.expr().alias("k")).schema["k"].dataType
        got = got.elementType if isinstance(c, MultiColumn) and isinstance(got, T.ArrayType) else got
        if got != key:
            raise InvalidOptions(f"{name} has keys of type {got.simpleString()}, not {key.simpleString()}")


def maintained(bound: Bound, index: ColumnIndex, changed: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Stored entries after the rows of the ``changed`` keys were replaced by ``new_rows``: all entries of those keys are made again, covered values too."""
    pk = list(bound.space.pk)
    kept = bound.entries.get(index.name)
    kept = (collapsed(bound, index) if kept is None else kept).join(changed.select(*pk).distinct(), pk, "left_anti")
    fresh = collapsed(bound, index, new_rows)
    return kept.select(*fresh.columns).unionByName(fresh)


def differences(bound: Bound, index: ColumnIndex, stored: DataFrame) -> DataFrame:
    """What is wrong with stored entries against the rows: code (missing or extra) and the entry."""
    live = entries(Bound(bound.space, bound.rows, {}), index)
    stored = stored.select(*live.columns)
    missing = live.exceptAll(stored).withColumn("code", F.lit("index-entry-missing"))
    return missing.unionByName(stored.exceptAll(live).withColumn("code", F.lit("index-entry-extra")))


def check(bound: Bound) -> DataFrame:
    """Issues of a keyspace: code, subject, n. Keys (null, repeated), unique keys and stored entries are looked at."""
    pk = list(bound.space.pk)
    null = F.lit(False)
    for c in pk:
        null = null | F.col(c).isNull()
    parts = [
        bound.rows.where(null).select(F.lit("key-empty").alias("code"), F.lit(bound.space.name).alias("subject")),
        bound.rows.groupBy(*pk).count().where("count > 1").select(F.lit("key-duplicate").alias("code"), F.lit(bound.space.name).alias("subject")),
    ]
    for i in bound.space.indexes:
        if i.unique:
            parts.append(violations(bound, i).select(F.lit("index-unique-violation").alias("code"), F.lit(i.name).alias("subject")))
        if i.name in bound.entries:
            parts.append(differences(bound, i, bound.entries[i.name]).select("code", F.lit(i.name).alias("subject")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("code", "subject").agg(F.count("*").alias("n"))
