"""Declarations: keyspaces, set keyspaces and their indexes, and the pairs of a declaration and its rows."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IndexDeclaration, InvalidOptions
from ..functions.columns import Column, MultiColumn
from ..functions.encoders import RESERVED

ORDERED = (T.StringType, T.BinaryType, T.IntegralType, T.DecimalType, T.TimestampType, T.TimestampNTZType, T.DateType, T.FractionalType)


def _ordered(kind: T.DataType, nested: bool) -> bool:
    """Whether values can be compared; ``nested``: structs and arrays of such values too."""
    if nested and isinstance(kind, T.StructType):
        return all(_ordered(f.dataType, True) for f in kind.fields)
    if nested and isinstance(kind, T.ArrayType):
        return _ordered(kind.elementType, True)
    return isinstance(kind, (*ORDERED, T.BooleanType) if nested else ORDERED)


@dataclass(frozen=True)
class ColumnIndex:
    """An index over columns: one entry for each row, or for each combination of its multi columns' values.

    ``where`` makes it partial; ``covering`` columns are carried by the entries; ``cover_value`` carries whole rows.
    """

    name: str
    columns: tuple[Column | MultiColumn, ...]
    unique: bool = False
    where: str | SparkColumn | None = field(default=None, compare=False)
    covering: tuple[Column, ...] = ()
    cover_value: bool = False
    version: int = 0

    def __post_init__(self):
        object.__setattr__(self, "columns", tuple(self.columns))
        object.__setattr__(self, "covering", tuple(self.covering))
        if not self.name or not self.columns:
            raise IndexDeclaration("an index needs a name and columns")
        if any(not isinstance(c, (Column, MultiColumn)) for c in self.columns):
            raise IndexDeclaration(f"{self.name}: not a column")
        for group in (self.columns, self.covering):
            if len({c.identity for c in group}) < len(group) or len({c.name for c in group}) < len(group):
                raise IndexDeclaration(f"{self.name}: a column twice")
        if any(not isinstance(c, Column) for c in self.covering):
            raise IndexDeclaration(f"{self.name}: covering columns have one value")
        if self.cover_value and self.covering:
            raise IndexDeclaration(f"{self.name}: covers whole rows and columns")
        for c in (*self.columns, *self.covering):
            if not c.encoder.id or c.encoder.id.startswith(RESERVED):
                raise IndexDeclaration(f"{self.name}: encoder id {c.encoder.id!r}")

    @property
    def fingerprint(self) -> str:
        parts = [self.name, str(self.unique), str(self.version), str(self.cover_value), "partial" if self.where is not None else ""]
        parts += [c.identity for c in self.columns] + ["|"] + [c.identity for c in self.covering]
        return hashlib.sha256("".join(f"{len(p)}:{p}" for p in parts).encode()).hexdigest()


def index_by(name: str, keys: SparkColumn | str, unique: bool = False) -> ColumnIndex:
    """An index over 0..n keys computed from each row (an array expression)."""
    return ColumnIndex(name, (MultiColumn(f"{name}_key", keys),), unique)


@dataclass(frozen=True)
class Keyspace:
    """A table with a primary key. Key columns are never null; a row's key is unique."""

    name: str
    pk: tuple[str, ...]
    indexes: tuple[ColumnIndex, ...] = ()
    kind = "rows"

    def __post_init__(self):
        object.__setattr__(self, "pk", (self.pk,) if isinstance(self.pk, str) else tuple(self.pk))
        object.__setattr__(self, "indexes", tuple(self.indexes))
        if not self.name or not self.pk:
            raise InvalidOptions("a keyspace needs a name and a key")
        if len({i.name for i in self.indexes}) < len(self.indexes):
            raise IndexDeclaration(f"{self.name}: two indexes of one name")

    def index(self, name: str) -> ColumnIndex:
        from ..errors import IndexNotFound

        for i in self.indexes:
            if i.name == name:
                return i
        raise IndexNotFound(name)

    def _require(self, rows: DataFrame, keys: tuple[str, ...], members: tuple[str, ...] = ()) -> None:
        for c in (*keys, *members):
            if c not in rows.columns:
                raise InvalidOptions(f"{self.name}: no column {c}")
            if not _ordered(rows.schema[c].dataType, c in members):
                raise InvalidOptions(f"{self.name}: {c} can't be a key")

    def bind(self, rows: DataFrame, entries: dict[str, DataFrame] | None = None) -> Bound:
        self._require(rows, self.pk)
        return Bound(self, rows, dict(entries or {}))

    def read(self, spark: SparkSession, path: str) -> Bound:
        return self.bind(spark.read.parquet(path))


@dataclass(frozen=True)
class SetKeyspace(Keyspace):
    """A key with a sorted set of distinct members: rows are (key, member), both the primary key."""

    fixed_size: int | None = None
    kind = "sets"

    @property
    def key(self) -> str:
        return self.pk[0]

    @property
    def member(self) -> str:
        return self.pk[1]

    def __post_init__(self):
        super().__post_init__()
        if len(self.pk) != 2:
            raise InvalidOptions("a set keyspace has a key and a member column")
        if any(i.covering or i.cover_value for i in self.indexes):
            raise IndexDeclaration(f"{self.name}: an index of a set keyspace can't cover")

    def bind(self, rows: DataFrame, entries: dict[str, DataFrame] | None = None) -> Bound:
        """Pairs are distinct; a member may be of any type that can be compared, structs too."""
        self._require(rows, self.pk[:1], self.pk[1:])
        return Bound(self, rows.select(*self.pk).dropDuplicates(list(self.pk)), dict(entries or {}))

    def bind_distinct(self, rows: DataFrame, entries: dict[str, DataFrame] | None = None) -> Bound:
        """As ``bind``, for pairs that are known to be distinct."""
        self._require(rows, self.pk[:1], self.pk[1:])
        return Bound(self, rows.select(*self.pk), dict(entries or {}))


@dataclass(frozen=True)
class Bound:
    """A declaration with its rows, and the entries of its indexes as far as they are stored."""

    space: Keyspace
    rows: DataFrame
    entries: dict[str, DataFrame]

    def by_pk(self, descending: bool = False) -> list[SparkColumn]:
        return [F.col(c).desc() if descending else F.col(c).asc() for c in self.space.pk]
