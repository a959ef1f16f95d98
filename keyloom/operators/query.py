"""The query builder. Every plan gives what a scan that evaluates all terms would give.

The scan lowering (default) is one filter that Catalyst pushes to the Parquet reader. The index lowering reads entries in place of rows where they are
stored and cover what is asked. Where rows are needed (``row-bytes``, ``back-lookup``), or entries would have to be cut from the
rows first, the plan's terms become the rows' filter: Spark has no random access to rows, so entries would only add a second read and a join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ColumnAbsent, InvalidOptions, MaterializeLimit
from ..functions.columns import Column, MultiColumn, OrderKey, Term, conjunction
from ..plans.planner import Leaf, Plan, explain, plan_query
from ..sources.model import Bound
from .index import VALUE, candidates, collapsed, cover_name, key_name
from .numbering import numbered


class Query:
    """Builder over a bound keyspace: where, filter, select, order_by, limit, offset, then all, keys, rows, count or explain."""

    def __init__(self, bound: Bound, lowering: str = "scan"):
        if lowering not in ("scan", "index"):
            raise InvalidOptions(lowering)
        self.bound, self.lowering = bound, lowering
        self.terms: list[Term] = []
        self.filters: list[SparkColumn] = []
        self.selected: list[Column] = []
        self.order: list[OrderKey] = []
        self._limit: int | None = None
        self._offset = 0
        self.budget = 0
        self.error: Exception | None = None

    def _fail(self, text: str) -> Query:
        self.error = self.error or InvalidOptions(text)
        return self

    def where(self, *terms: Term) -> Query:
        if any(not isinstance(t, Term) for t in terms):
            return self._fail("where() takes terms")
        self.terms += terms
        return self

    def filter(self, condition: SparkColumn | str | Callable) -> Query:
        """A condition the planner doesn't look into; it sees whole rows.

        A function takes a pandas frame of rows and returns a series of booleans; it runs over Arrow batches.
        """
        if condition is None:
            return self._fail("filter() takes a condition")
        if isinstance(condition, str):
            condition = F.expr(condition)
        elif not isinstance(condition, SparkColumn):
            if not callable(condition):
                return self._fail("filter() takes a condition")
            condition = _pandas_condition(condition)(F.struct(*[F.col(c) for c in self.bound.rows.columns]))
        self.filters.append(condition)
        return self

    def select(self, *columns: Column) -> Query:
        if any(not isinstance(c, Column) for c in columns):
            return self._fail("select() takes single-valued columns")
        self.selected += columns
        return self

    def order_by(self, *keys: OrderKey) -> Query:
        if any(not isinstance(k, OrderKey) for k in keys):
            return self._fail("order_by() takes order keys")
        self.order += keys
        return self

    def limit(self, n: int) -> Query:
        self._limit = n
        return self

    def offset(self, n: int) -> Query:
        self._offset = max(n, 0)
        return self

    def with_materialize_limit(self, size: int) -> Query:
        """Bytes that sorts, hash unions and intersections may hold, together; more is an error. 0 is no limit."""
        self.budget = size
        return self

    def err(self) -> Exception | None:
        try:
            self._check()
        except Exception as e:  # noqa: BLE001
            return e
        return None

    # ---- plans

    def plan(self) -> Plan:
        return plan_query(self.terms, self.bound.space.indexes, [c.name for c in self.selected], self.order, len(self.filters))

    def explain(self) -> str:
        plan = self.plan() if self.lowering == "index" else Plan(residual=tuple(self.terms))
        return explain(plan, self.selected, self.order, self._limit, self._offset, len(self.filters))

    # ---- results

    def all(self) -> DataFrame:
        """Whole rows."""
        self._check()
        return self._bounded(self._ordered(self._matched()))

    def keys(self) -> DataFrame:
        return self.all().select(*self.bound.space.pk)

    def rows(self) -> DataFrame:
        """Primary key and selected columns."""
        self._check()
        if not self.selected:
            raise InvalidOptions("rows() needs select()")
        pk = list(self.bound.space.pk)
        plan = self.plan()
        if self.lowering == "index" and plan.values == "entry" and self._stored(plan.leaves[0]):
            self._meter()
            return self._bounded(self._from_entries(plan))
        names = [c.expr().alias(c.name) for c in self.selected if c.name not in pk]
        return self._bounded(self._ordered(self._matched())).select(*pk, *names)

    def counted(self) -> DataFrame:
        """One row, n: max(0, min(limit, matched - offset)); order plays no part."""
        self._check()
        self._meter(order=False)
        n = F.count("*") - self._offset
        if self._limit is not None:
            n = F.least(F.lit(self._limit), n)
        return self._matched().agg(F.greatest(F.lit(0), n).cast("long").alias("n"))

    def count(self) -> int:
        return self.counted().first()["n"]

    def positions(self, column: str = "pos") -> DataFrame:
        """``rows()`` in their order with their number, from 1. No limit or offset."""
        if self._limit is not None or self._offset:
            raise InvalidOptions("positions() of a part of the rows")
        return numbered(self.rows(), self._sort(), column)

    # ---- lowering

    def _check(self) -> None:
        if self.error:
            raise self.error
        for t in self.terms:
            t.check()

    def _matched(self) -> DataFrame:
        """The matching rows, in no order; columns as the table's."""
        plan = self._plan()
        if plan.kind == "Leaf" and plan.values == "cover-value" and self._stored(plan.leaves[0]):
            df, residual = self._leaf_values(plan.leaves[0], self.terms), plan.residual
        elif plan.kind == "Union" and all(m.index.cover_value and self._stored(m) for m in plan.leaves):
            parts = []
            for m, g in zip(plan.leaves, plan.groups, strict=True):
                rest = [t for i, t in enumerate(g) if i not in m.consumed]
                parts.append(self._leaf_values(m, g).where(conjunction(rest)))
            df, residual = reduce(DataFrame.unionByName, parts).dropDuplicates(list(self.bound.space.pk)), plan.residual
        else:
            df, residual = self.bound.rows, self.terms
        if residual:
            df = df.where(conjunction(residual))
        for c in self.filters:
            df = df.where(c)
        return df

    def _plan(self) -> Plan:
        return self.plan() if self.lowering == "index" else Plan(residual=tuple(self.terms))

    def _stored(self, m: Leaf) -> bool:
        return m.index.name in self.bound.entries

    def _hits(self, m: Leaf, terms) -> DataFrame:
        """The entries a leaf reads."""
        df = self.bound.entries[m.index.name] if self._stored(m) else collapsed(self.bound, m.index)
        for i in m.consumed:
            t = terms[i]
            df = df.where(t.on(t.column.encoder.apply(F.col(key_name(t.column)))))
        return df

    def _leaf_values(self, m: Leaf, terms) -> DataFrame:
        rows = self._hits(m, terms).select(f"{VALUE}.*")
        return rows.dropDuplicates(list(self.bound.space.pk)) if m.dedup else rows

    def _from_entries(self, plan: Plan) -> DataFrame:
        """Index-only: rows aren't read."""
        m, pk = plan.leaves[0], list(self.bound.space.pk)
        hits = self._hits(m, self.terms)
        if m.dedup:
            hits = hits.dropDuplicates(pk)
        held = {c.name: key_name(c) for c in m.index.columns if not isinstance(c, MultiColumn)} | {c.name: cover_name(c) for c in m.index.covering}

        def here(c: Column) -> Column:
            return Column(c.name, F.col(f"`{held[c.name]}`"), c.encoder)

        def moved(t: Term) -> Term:
            if t.kind == "or":
                return Term("or", groups=tuple(tuple(moved(x) for x in g) for g in t.groups))
            return Term(t.kind, here(t.column), t.values)

        for t in plan.residual:
            hits = hits.where(moved(t).condition())
        if self.order:
            hits = hits.orderBy(*[OrderKey(here(k.column), k.descending).sort() for k in self.order], *self.bound.by_pk(self.order[-1].descending))
        elif self._limit is not None or self._offset:
            hits = hits.orderBy(*self.bound.by_pk())
        return hits.select(*pk, *[F.col(f"`{held[c.name]}`").alias(c.name) for c in self.selected if c.name not in pk])

    def _sort(self) -> list[SparkColumn]:
        """The keys; ties by primary key in the last key's direction. Without keys, the primary key."""
        return [*[k.sort() for k in self.order], *self.bound.by_pk(bool(self.order) and self.order[-1].descending)]

    def _ordered(self, df: DataFrame) -> DataFrame:
        self._meter()
        if self.order or self._limit is not None or self._offset:
            return df.orderBy(*self._sort())
        return df

    def _bounded(self, df: DataFrame) -> DataFrame:
        if self._limit is not None and self._limit <= 0:
            return df.limit(0)
        if self._offset:
            df = df.offset(self._offset)
        return df if self._limit is None else df.limit(self._limit)

    def _held(self, order: bool) -> list[DataFrame]:
        """What the plan's nodes hold: keys of hash unions, of a leaf whose rows may come twice and of an intersection's build side; sorted rows."""
        plan, pk, out = self._plan(), list(self.bound.space.pk), []
        if plan.kind == "Intersect":
            out.append(self._hits(plan.leaves[1], self.terms).select(*pk))
        elif plan.kind == "Union":
            for m, g in zip(plan.leaves, plan.groups, strict=True):
                if m.dedup:
                    out.append(self._hits(m, g).select(*pk).distinct())
            if any(m.shape != "IndexSeek" for m in plan.leaves):
                out.append(reduce(DataFrame.unionByName, [self._hits(m, g).select(*pk) for m, g in zip(plan.leaves, plan.groups, strict=True)]).distinct())
        elif plan.kind == "Leaf" and plan.leaves[0].dedup:
            out.append(self._hits(plan.leaves[0], self.terms).select(*pk).distinct())
        if order and self.order and not plan.streamed:
            df = self._matched()
            out.append(df if self._limit is None else df.orderBy(*self._sort()).limit(self._limit + self._offset))
        return out

    def _meter(self, order: bool = True) -> None:
        """Raise if all that the query's nodes hold together takes more than the budget; nothing is ever cut."""
        if self.budget <= 0 or (self._limit is not None and self._limit <= 0):
            return
        sizes = [df.select(F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns]))).alias("n")) for df in self._held(order)]
        if not sizes:
            return
        held = reduce(DataFrame.unionByName, sizes).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        if held > self.budget:
            raise MaterializeLimit(f"{held} bytes, {self.budget} allowed")


def _pandas_condition(fn: Callable) -> Callable:
    def holds(rows: pd.DataFrame) -> pd.Series:
        return fn(rows).astype(bool)

    return F.pandas_udf(holds, "boolean")


def value_of(row, column: Column):
    """A selected value of a result row."""
    if column.name not in row.asDict():
        raise ColumnAbsent(column.name)
    return row[column.name]


__all__ = ["Query", "candidates", "value_of"]
