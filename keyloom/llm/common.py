"""Session, storage and Arrow helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.scratch import discard, fresh_path

#: Words of the output contracts: everything but ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="keyloom-")) / "keyloom-package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    ship(df.sparkSession)
    return scratch.materialize(df, name)


#: A key that is met by more than 1 in HOT rows is hot.
HOT = 1000


def with_counted(rows: DataFrame, groups: DataFrame, keys: list[str], hot: int | None = None) -> DataFrame:
    """``rows`` joined on ``keys`` with ``groups``, a row for each key with the number ``n`` of rows that it will meet.

    Hot keys, ``HOT`` of them at most, are broadcast, so none gathers its rows in one task; the others are joined by a shuffle.
    """
    share, total = hot or HOT, rows.count()
    often = F.broadcast(groups.where(F.col("n") * share > total))
    spread = rows.join(often.select(*keys), keys, "left_anti").join(groups.where(F.col("n") * share <= total), keys)
    return rows.join(often, keys).unionByName(spread)


def with_salted(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``rows`` (stored) joined on ``key`` with ``other``, a row for each key. A key that more than 1 in ``HOT`` of the rows has is dealt
    over several tasks, and its row of ``other`` (which may be large) is repeated as often: 2 * HOT times at most, all keys told."""
    total = rows.count()
    n = F.count("*")
    hot = F.broadcast(rows.groupBy(key).agg(n.alias("_n")).where(F.col("_n") * HOT > total).select(key, F.ceil(F.col("_n") * HOT / max(total, 1)).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), salts).cast("int")).drop("_salts")
    right = other.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def fold_of(col, n: int):
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % n


def in_sample(key: Column, share: float) -> Column:
    """Whether a key's hash falls in the lowest ``share`` of all: the same keys are drawn whatever the partitions."""
    place = F.shiftrightunsigned(F.xxhash64(key, F.lit(11)), 11).cast("double") / F.lit(float(1 << 53))
    return place < F.lit(float(share))


def sampled_labels(labels: DataFrame, value: str, rows: int, keep=None) -> DataFrame:
    """About ``rows`` labelled ids (doc_id, label), or all if there are fewer; drawn by a threshold on the id's hash.

    Nothing is sorted or gathered to draw them. Null ids or labels are left out; of repeated ids the largest label counts.
    """
    x = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(value).cast("int").alias("label"))
    x = x.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    if keep is not None:
        x = x.where(keep(F.col("doc_id"), F.col("label")))
    n = x.count()
    if n > rows:
        x = x.where(in_sample(F.col("doc_id"), rows / n))
    return x.groupBy("doc_id").agg(F.max("label").alias("label"))


def text_parts(col: pa.Array, most: int = 1 << 19, rows: int = 1 << 16):
    """Split a string column in runs of at most ``rows`` rows and ``most`` bytes (or one row): first row, bytes, offsets.

    Nulls are empty texts.
    """
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + most, side="right")) - 1
        b = min(n, max(b, a + 1), a + rows)
        yield a, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def text_lists(col: pa.Array, most: int = 1 << 20):
    """Runs of rows as Python texts, at most ``most`` characters each (or one row): first row, texts. Nulls are ''."""
    run: list[str] = []
    at, size = 0, 0
    for i, t in enumerate(col.to_pylist()):
        t = t or ""
        if run and size + len(t) > most:
            yield at, run
            run, at, size = [], i, 0
        run.append(t)
        size += len(t)
    if run:
        yield at, run


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))


__all__ = [
    "HOT", "WORD_RE", "discard", "fold_of", "fresh_path", "in_sample", "list_array", "map_arrow", "materialize", "sampled_labels", "ship", "table", "text_lists", "text_parts", "with_counted", "with_salted",
]
