"""Tables in key ranges: a folder for each range, so that a change rewrites only the ranges it touches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = "_keyloom_range"
_SIMPLE = (T.StringType, T.BinaryType, T.IntegralType, T.DecimalType, T.TimestampType, T.TimestampNTZType, T.DateType, T.FractionalType, T.BooleanType)


class Ranges:
    """The ranges of one table: a list of {path, upper}; a row lies in the first whose upper bound its key doesn't exceed, or in the last.

    ``most`` is the number of ranges to cut; without it there are as many as the shuffle has partitions.
    """

    def __init__(self, spark: SparkSession, root: str, by: list[str], schema: T.StructType, parts: list[dict] | None = None, most: int | None = None):
        self.spark, self.root, self.by, self.schema, self.parts, self.most = spark, root, by, schema, list(parts or []), most
        self.kind = schema[by[0]].dataType

    def _told(self, c: Column) -> Column:
        if isinstance(self.kind, T.BinaryType):
            return F.hex(c)
        return (F.unix_micros(c) if isinstance(self.kind, T.TimestampType) else c).cast("string")

    def _value(self, text: str) -> Column:
        if isinstance(self.kind, T.BinaryType):
            return F.unhex(F.lit(text))
        if isinstance(self.kind, T.TimestampType):
            return F.timestamp_micros(F.lit(int(text)))
        return F.lit(text).cast(self.kind)

    def of(self, key: Column) -> Column:
        """The number of a key's range; null keys lie in the first, which has no upper bound if it holds nothing else."""
        uppers = [self._value(p["upper"]) for p in self.parts[:-1] if p["upper"] is not None]
        nulls = len(self.parts[:-1]) - len(uppers)
        below = F.size(F.filter(F.array(*uppers), lambda u: u < key)) if uppers else F.lit(0)
        return F.when(key.isNull(), F.lit(0)).otherwise(F.lit(nulls) + below)

    def read(self, numbers=None) -> DataFrame:
        paths = [f"{self.root}/{p['path']}" for i, p in enumerate(self.parts) if p["path"] and (numbers is None or i in numbers)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _folder(self) -> str:
        return f"tables/{uuid.uuid4().hex}"

    def write(self, rows: DataFrame) -> Ranges:
        """All ranges anew, by the first key column: rows of one first key lie together. Their bounds come from what was written."""
        folder, rows = self._folder(), rows.select(*self.schema.names)
        simple = isinstance(self.kind, _SIMPLE)
        if simple:
            placed = rows.repartitionByRange(self.most, self.by[0]) if self.most else rows.repartitionByRange(self.by[0])
            placed = placed.withColumn(RANGE, F.spark_partition_id())
        else:  # a key without a text to tell it by: one range of many files
            placed = rows.repartition(*self.by).withColumn(RANGE, F.lit(0))
        placed = placed.sortWithinPartitions(RANGE, *self.by)
        placed.write.partitionBy(RANGE).parquet(f"{self.root}/{folder}")
        kind = T.StructType([*self.schema.fields, T.StructField(RANGE, T.IntegerType())])
        upper = self._told(F.max(self.by[0])) if simple else F.lit(None).cast("string")
        ends = self.spark.read.schema(kind).parquet(f"{self.root}/{folder}").groupBy(RANGE).agg(upper.alias("upper")).collect()  # a row for each range
        parts = [{"path": f"{folder}/{RANGE}={r[RANGE]}", "upper": r["upper"]} for r in sorted(ends, key=lambda r: r[RANGE])]
        return Ranges(self.spark, self.root, self.by, self.schema, parts, self.most)

    def touched(self, keys: DataFrame) -> list[int]:
        """The ranges that keys (a frame with the first key column) lie in."""
        return sorted(r[0] for r in keys.select(self.of(F.col(self.by[0])).alias("r")).distinct().collect())  # as many as ranges at most

    def replace(self, numbers: list[int], rows: DataFrame) -> Ranges:
        """The ranges of these numbers with new rows; the others keep their folders."""
        if not self.parts:
            return self.write(rows)
        folder = self._folder()
        placed = rows.select(*self.schema.names).withColumn(RANGE, self.of(F.col(self.by[0])))
        placed = placed.repartition(RANGE).sortWithinPartitions(RANGE, *self.by)
        placed.write.partitionBy(RANGE).parquet(f"{self.root}/{folder}")
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        there = {s.getPath().getName() for s in fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(fs_path)}
        parts = [dict(p) for p in self.parts]
        for i in numbers:
            parts[i]["path"] = f"{folder}/{RANGE}={i}" if f"{RANGE}={i}" in there else ""
        return Ranges(self.spark, self.root, self.by, self.schema, parts, self.most)
