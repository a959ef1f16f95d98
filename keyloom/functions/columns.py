"""Typed columns and the terms they make."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from ..errors import EncodeError, InvalidOptions
from .encoders import NATURAL, Encoder

RANGES = ("lt", "lte", "gt", "gte", "between", "prefix", "contains_range")
POINTS = ("eq", "contains")


@dataclass(frozen=True)
class Term:
    """An inert predicate: it names a column, a kind and values, and lowers to a condition."""

    kind: str
    column: Column | MultiColumn | None = None
    values: tuple = ()
    groups: tuple[tuple[Term, ...], ...] = ()

    @property
    def name(self) -> str | None:
        return self.column.name if self.column is not None else None

    @property
    def multi(self) -> bool:
        return isinstance(self.column, MultiColumn)

    def check(self) -> None:
        """Raise what is wrong with the term; called before any row is looked at."""
        if self.kind == "or":
            for g in self.groups:
                for t in g:
                    if not isinstance(t, Term):
                        raise InvalidOptions("a group of or_() holds something else than terms")
                    t.check()
        elif self.column is None:
            raise InvalidOptions("an empty term")
        else:
            for v in self.values:
                self.column.encoder.literal(v)

    def columns(self) -> set[str]:
        return {n for g in self.groups for t in g for n in t.columns()} | ({self.name} if self.name else set())

    def on(self, value: SparkColumn) -> SparkColumn:
        """The condition on one (encoded) value of the column."""
        v = [self.column.encoder.literal(x) for x in self.values]
        match self.kind:
            case "eq" | "contains":
                return value == v[0]
            case "lt":
                return value < v[0]
            case "lte":
                return value <= v[0]
            case "gt":
                return value > v[0]
            case "gte":
                return value >= v[0]
            case "between" | "contains_range":
                return (value >= v[0]) & (value < v[1])
            case "prefix":
                return F.startswith(value, v[0])
        raise InvalidOptions(self.kind)

    def condition(self) -> SparkColumn:
        """The condition on a whole row."""
        if self.kind == "or":
            out = F.lit(False)
            for i, g in enumerate(self.groups):
                one = conjunction(g)
                out = one if i == 0 else out | one
            return out
        if not self.multi:
            return self.on(self.column.encoded())
        many = F.coalesce(self.column.expr(), F.array())
        if self.kind == "contains" and self.column.encoder.id == "natural":
            return F.array_contains(many, self.column.encoder.literal(self.values[0]))
        return F.exists(many, lambda x: self.on(self.column.encoder.apply(x)))


def conjunction(terms) -> SparkColumn:
    """AND of the terms; of none, true."""
    out = None
    for t in terms:
        out = t.condition() if out is None else out & t.condition()
    return F.lit(True) if out is None else out


def or_(*groups) -> Term:
    """OR of groups (a term or a list of terms, all of which must hold). No group matches nothing; an empty one everything."""
    return Term("or", groups=tuple((g,) if isinstance(g, Term) else tuple(g) for g in groups))


@dataclass(frozen=True)
class OrderKey:
    column: Column
    descending: bool = False

    def sort(self) -> SparkColumn:
        c = self.column.encoded()
        return c.desc() if self.descending else c.asc()


@dataclass(frozen=True)
class _Base:
    name: str
    source: str | SparkColumn | Callable[[], SparkColumn] | None = field(default=None, compare=False)
    encoder: Encoder = NATURAL

    def expr(self) -> SparkColumn:
        if self.source is None:
            return F.col(self.name)
        if isinstance(self.source, str):
            return F.expr(self.source)
        return self.source() if callable(self.source) and not isinstance(self.source, SparkColumn) else self.source

    def encoded(self) -> SparkColumn:
        return self.encoder.apply(self.expr())

    @property
    def identity(self) -> str:
        """Injective over form, name and encoder."""
        form = "multi" if isinstance(self, MultiColumn) else "column"
        return f"keyloom/{form}/{len(self.name)}:{self.name}{len(self.encoder.id)}:{self.encoder.id}"


class Column(_Base):
    """A named value of each row: a table's column, a SQL text or an expression, with an encoder."""

    def eq(self, v: Any) -> Term:
        return Term("eq", self, (v,))

    def lt(self, v: Any) -> Term:
        return Term("lt", self, (v,))

    def lte(self, v: Any) -> Term:
        return Term("lte", self, (v,))

    def gt(self, v: Any) -> Term:
        return Term("gt", self, (v,))

    def gte(self, v: Any) -> Term:
        return Term("gte", self, (v,))

    def between(self, lo: Any, hi: Any) -> Term:
        """Half-open: lo <= value < hi."""
        return Term("between", self, (lo, hi))

    def has_prefix(self, v: Any) -> Term:
        return Term("prefix", self, (v,))

    def asc(self) -> OrderKey:
        return OrderKey(self)

    def desc(self) -> OrderKey:
        return OrderKey(self, True)


class MultiColumn(_Base):
    """A named array of each row; a null array is an empty one."""

    def contains(self, v: Any) -> Term:
        return Term("contains", self, (v,))

    def contains_range(self, lo: Any, hi: Any) -> Term:
        return Term("contains_range", self, (lo, hi))


__all__ = ["POINTS", "RANGES", "Column", "EncodeError", "MultiColumn", "OrderKey", "Term", "conjunction", "or_"]
