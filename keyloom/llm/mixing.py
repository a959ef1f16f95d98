"""Mixing sources to target weights with repetition rates and hash-seeded Bernoulli copies. DataFrame functions only.

Every document gets a number from the md5 of its id. It is emitted floor(rate) times, and once more if its number is below its source's
threshold. The threshold is the rate's fraction, set right for the documents at hand: it is where the words of the documents below it come
nearest to fraction x words, so one long text on the wrong side doesn't carry a small source away from its target. In large
sources it is the fraction itself. It is found by two sums over 4,096 steps of the numbers, the second inside the step that the first one
ends in, so no source is sorted or gathered; and the texts are read once for their sizes and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import running
from .common import WORD_RE, materialize, with_counted

#: Up to so many sources their rates are broadcast whole; beyond it only those of hot sources are.
BROADCAST_SOURCES = 50_000
MOST = 3
CYCLE = 3
SEED = "keyloom-mix"
STEPS = 12  # bits of a number that one sum looks at


def size_of(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: int = MOST, cycle: int = CYCLE) -> DataFrame:
    """(source, n, source_size, target) from (source, size): weights 1..cycle in code point order, null last.

    A target stops at ``most`` times its source's size and the excess goes to the others by weight. With the sources in
    order of size / weight, the stopped ones are the first k, for the smallest k at which the
    next source's share is not above its limit; so no iteration is needed. A source without words has target 0.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"), F.lit(1).cast("long").alias("one"))
    by = running(by, [F.col("source").asc_nulls_last()], {"at": "one"})
    by = materialize(by.select("source", "n", "source_size", (F.col("at") % cycle + 1).alias("w")), "sources")
    size, weight = by.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    by = running(by, [(F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last()], {"size_before": "source_size", "w_before": "w"})
    share = (F.lit(size) - most * F.col("size_before")) / (F.lit(weight) - F.col("w_before"))
    by = materialize(by.withColumn("share", share), "shares")
    fits = by.where(F.col("share") * F.col("w") <= most * F.col("source_size"))
    level = fits.agg(F.min(F.struct("w_before", "share")).alias("level"))  # one row
    by = by.crossJoin(F.broadcast(level))
    target = F.when(F.col("w_before") >= F.col("level.w_before"), F.col("level.share") * F.col("w")).otherwise(most * F.col("source_size"))
    return by.select("source", "n", "source_size", F.coalesce(target, F.lit(0)).cast("double").alias("target"))


def number(doc_id: Column, text: Column) -> Column:
    """24 bits from the md5 of a document's id (of its text where the id is null): the same wherever it runs."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null|"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED + "|"), key)), 1, 6), 16, 10).cast("long")


def sizes_of(docs: DataFrame) -> DataFrame:
    """A stored row (doc_id, source, size, number) for each document: all that mixing needs of it."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), number(F.col("doc_id"), F.col("text")).alias("number"))
    return materialize(rows, "sizes")


def source_rates(sizes: DataFrame) -> DataFrame:
    """(source, n, source_size, target, whole, threshold): a document is emitted ``whole`` times, and once more if its number is below the threshold."""
    rates = source_targets(sizes)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(F.lit(0.0))
    rates = rates.withColumn("whole", F.floor(rate).cast("long")).withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
    rates = materialize(rates, "rates")
    asked, at = rates.select("source", F.lit(0.0).alias("before"), F.lit(0).cast("long").alias("from"), "wanted"), 0
    for step in (STEPS, 0):
        # (source, step of the numbers) rows, at most 2 ** STEPS for each source
        steps = sizes.withColumn("at", F.shiftright("number", step)).groupBy("source", "at").agg(F.sum("size").alias("words"))
        here = asked.select(F.col("source").alias("s"), "before", "from", "wanted")
        steps = steps.join(here, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        steps = steps.where(F.col("at") >= F.col("from")).where(F.col("at") < F.col("from") + (1 << STEPS))
        up_to = F.sum("words").over(Window.partitionBy("source").orderBy("at")) + F.col("before")
        steps = steps.select("source", "at", "words", "wanted", (up_to - F.col("words")).alias("before"))
        found = steps.where((F.col("before") <= F.col("wanted")) & (F.col("wanted") < F.col("before") + F.col("words")))
        asked = materialize(found.select("source", "before", F.shiftleft("at", STEPS).alias("from"), "wanted", "at", "words"), "steps")
    nearer = F.when(F.col("wanted") - F.col("before") <= F.col("before") + F.col("words") - F.col("wanted"), F.col("at")).otherwise(F.col("at") + 1)
    found = asked.select(F.col("source").alias("s"), nearer.alias("threshold"))
    rates = rates.join(found, F.col("source").eqNullSafe(F.col("s")), "left")
    return rates.select("source", "n", "source_size", "target", "whole", F.coalesce("threshold", F.lit(0).cast("long")).alias("threshold"))


def _rated(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """``rows`` (source, ...) with their source's rate; no source gathers its rows in one task."""
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows, rates = rows.withColumn("_source", name), rates.withColumn("_source", name).drop("source")
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(rates), "_source").drop("_source")
    return with_counted(rows, rates, ["_source"]).drop("_source")


def _copies() -> Column:
    return F.col("whole") + (F.col("number") < F.col("threshold")).cast("long")


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and copies of every row of ``docs``.

    Reruns agree and repeated rows are treated alike. Null texts and texts without words have size 0. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    sizes = sizes_of(docs)
    return _rated(sizes, source_rates(sizes)).select("doc_id", "size", "source_size", "target", _copies().alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs``, all its columns, as many times as it is to be emitted."""
    rates = materialize(source_rates(sizes_of(docs)), "source-rates")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.source").cast("string").alias("source"), number(F.col("row.doc_id"), F.col("row.text")).alias("number"))
    x = _rated(rows, rates).select("row", _copies().alias("copies")).where("copies > 0")
    return x.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")
