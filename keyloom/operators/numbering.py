"""Positions in a global order without a window over all rows.

Rows are range-partitioned and sorted once and stored with the place that each has in its partition; every later step reads that one
table, so partitions, their sizes and their edges can't come apart. Only a row for each partition meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

PART, AT = "_part", "_at"
_INSIDE = (1 << 33) - 1  # monotonically_increasing_id: the row's number in its partition


def ranged(rows: DataFrame, order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """Struct ``row``, its partition ``_part`` and its place ``_at`` there (from 0); partitions are in order, and rows in them."""
    rows = rows.select(F.struct("*").alias("row"), *[F.col(c) for c in rows.columns])
    placed = (rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    placed = placed.select("row", F.spark_partition_id().alias(PART), F.monotonically_increasing_id().bitwiseAND(_INSIDE).alias(AT))
    return materialize(placed, "ranged")


def numbered(rows: DataFrame, order: Sequence[Column], column: str, first: int = 1) -> DataFrame:
    """``rows`` with their numbers first, first + 1, ... in the order. Rows that the order leaves tied are numbered in some order."""
    placed = ranged(rows, order)
    ends = placed.groupBy(PART).agg(F.count("*").alias("n"))  # a row for each partition
    before = F.coalesce(F.sum("n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = ends.select(PART, before.alias("_before"))
    return placed.join(F.broadcast(start), PART).select("row.*", (F.lit(first) + F.col("_before") + F.col(AT)).cast("long").alias(column))


def running(rows: DataFrame, order: Sequence[Column], values: dict[str, str]) -> DataFrame:
    """``rows`` with long columns: for each (new name, column) the column's sum over all rows before, in the order."""
    placed = ranged(rows, order)
    here = Window.partitionBy(PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy(PART).agg(*[F.sum(f"row.{c}").alias(f"_s_{n}") for n, c in values.items()])  # a row for each partition
    over = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    start = ends.select(PART, *[F.coalesce(F.sum(f"_s_{n}").over(over), F.lit(0)).alias(f"_b_{n}") for n in values])
    out = placed.select("*", *[F.coalesce(F.sum(f"row.{c}").over(here), F.lit(0)).alias(f"_h_{n}") for n, c in values.items()])
    return out.join(F.broadcast(start), PART).select("row.*", *[(F.col(f"_b_{n}") + F.col(f"_h_{n}")).alias(n) for n in values])


def beside(rows: DataFrame, order: Sequence[Column], value: Column, following: str, preceding: str) -> DataFrame:
    """``rows`` with the value of the next and of the previous row in the order (null at the ends)."""
    placed = ranged(rows.withColumn("_value", value), order)
    here = Window.partitionBy(PART).orderBy(AT)
    ends = placed.groupBy(PART).agg(F.min_by("row._value", AT).alias("first"), F.max_by("row._value", AT).alias("last"))  # a row for each partition
    over = Window.orderBy(PART)
    ends = ends.select(PART, F.lead("first").over(over).alias("_next"), F.lag("last").over(over).alias("_previous"))
    v = F.col("row._value")
    out = placed.select("*", F.lead(v).over(here).alias("_n"), F.lag(v).over(here).alias("_p")).join(F.broadcast(ends), PART)
    return out.select("row.*", F.coalesce("_n", "_next").alias(following), F.coalesce("_p", "_previous").alias(preceding)).drop("_value")
