"""Line dedup: repeated runs of lines are found in a suffix array over line ids and all copies but the first are deleted.

Suffixes are ranked by distributed prefix doubling. The alphabet is the lines: repeated ones in order of their 64-bit hash, then lines that
occur once, each a symbol of its own. A level ranks all suffixes by their first 2h lines from the ranks by h lines: distinct
(rank, rank h lines on) pairs are counted, range-partitioned and numbered by running sums. Suffixes of one rank at depth h are an interval of
the array whose longest common prefix is at least h lines. Suffixes that are alone in their interval leave: no longer run of theirs repeats.

A *run* is a maximal stretch of lines that occurs, as it stands, at an earlier place too (of an earlier text, or further up in its own; the two may
overlap). A run of ``min_words`` words or more, whatever the number and length of its lines, is a later copy and is deleted. Its lines are
the union of the shortest windows of so many words inside it: the window from each line on, or the one up to it where the first would
leave the run. Such a window is a common prefix of so many lines, so it is a later copy if it isn't the first of its interval; an interval
at a depth between 2^k and 2^(k+1) lines is given by the ranks by 2^k lines of the window's first and last 2^k lines. So each line asks for two
intervals, the depth goes as far as repeated suffixes and windows go, and no pair of copies is ever made. ``suffix_array`` goes on until
all suffixes are apart, and ``later_runs`` gives the runs themselves.

Ranks and first places return to the lines by a join on keys of which one may be most lines: keys of more than 1 in ``HOT`` of the
rows, so at most ``HOT`` of them, are broadcast, the others are joined by a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import discard, map_arrow, materialize, text_parts, with_counted

MIN_WORDS = 10
_ALONE = 1 << 62


def _shortest(words_before: np.ndarray, first: np.ndarray, end: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the shortest window of ``min_words`` words from each line on, and up to each line; 0 where its text has none."""
    n = len(first)
    i = np.arange(n)
    stop = np.maximum(np.searchsorted(words_before, words_before[:-1] + min_words), i + 1)
    start = np.minimum(np.searchsorted(words_before, words_before[1:] - min_words, side="right") - 1, i)
    return np.where(stop <= end, stop - i, 0), np.where(start >= first, i + 1 - start, 0)


def _line_rows(texts: bool, min_words: int):
    def go(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, b, offs in text_parts(batch.column(1)):
                nd = len(offs) - 1
                nl = np.flatnonzero(b == 10)
                s, e = np.sort(np.concatenate((offs[:-1], nl + 1))), np.sort(np.concatenate((nl, offs[1:])))
                per = np.bincount(np.searchsorted(offs[1:], nl, side="right"), minlength=nd) + 1
                doc = np.repeat(np.arange(nd), per)
                line = np.arange(len(s)) - np.repeat(np.cumsum(per) - per, per)
                words = tv.runs(~tv.WS[b], offs)[0]
                n_words = np.searchsorted(words, e) - np.searchsorted(words, s)
                chars = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80, dtype=np.int64)))
                cols = [
                    batch.column(0).slice(at, nd).take(pa.array(doc)), pa.array(uid + doc), pa.array(line), pa.array(np.repeat(per, per)),
                    pa.array(tv.Spans(b).hash(s, e).view(np.int64)), pa.array(n_words.astype(np.int64)), pa.array(chars[e] - chars[s]),
                ]
                names = ["doc_id", "uid", "line", "n_lines", "h", "n_words", "n_chars"]
                begin = np.repeat(np.cumsum(per) - per, per)
                cols += [pa.array(x) for x in _shortest(np.concatenate(([0], np.cumsum(n_words))), begin, begin + np.repeat(per, per), min_words)]
                names += ["on", "back"]
                if texts:
                    raw = b.tobytes()
                    cols.append(pa.array([raw[x:y].decode("utf-8", "replace") for x, y in zip(s.tolist(), e.tolist(), strict=True)], pa.string()))
                    names.append("text")
                uid += nd
                yield pa.RecordBatch.from_arrays(cols, names)

    return go


def lines_of(docs: DataFrame, texts: bool = False, min_words: int = MIN_WORDS) -> DataFrame:
    """A stored row for each line: doc_id, uid (of the row of ``docs``), line, n_lines, h, n_words, n_chars, on, back (and text).

    on and back are the lines of the shortest windows of ``min_words`` words from the line on and up to it. Lines are what ``\\n`` parts; a null
    or empty text is one empty line.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, uid long, line long, n_lines long, h long, n_words long, n_chars long, on long, back long"
    return materialize(map_arrow(rows, _line_rows(texts, min_words), kind + ", text string" * texts), "lines")


def numbered(pairs: DataFrame) -> DataFrame:
    """(x, y, n) distinct pairs to (x, y, n, rank): 1 plus the number of suffixes of smaller pairs."""
    spark = pairs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def go(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            sums = before + np.cumsum(n)
            cols = [batch.column(0), batch.column(1), batch.column(2), pa.array(np.full(len(n), part)), pa.array(sums - n)]
            before = int(sums[-1]) if len(n) else before
            yield pa.RecordBatch.from_arrays(cols, ["x", "y", "n", "part", "before"])

    ranged = pairs.repartitionByRange(parts, "x", "y").sortWithinPartitions("x", "y")
    made = materialize(map_arrow(ranged, go, "x long, y long, n long, part long, before long"), "pairs")
    sums = made.groupBy("part").agg(F.sum("n").alias("n")).toArrow()  # a row for each partition
    of = dict(zip(sums.column("part").to_pylist(), sums.column("n").to_pylist(), strict=True))
    start, total = {}, 0
    for p in sorted(of):
        start[p], total = total, total + of[p]
    if not start:
        return made.select("x", "y", "n", F.lit(1).cast("long").alias("rank"))
    first = F.element_at(F.create_map(*[F.lit(v) for p in start for v in (p, start[p])]), F.col("part"))
    return made.select("x", "y", "n", (first + F.col("before") + 1).cast("long").alias("rank"))


def _first_ranks(lines: DataFrame) -> DataFrame:
    twice = lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    first = numbered(twice.select(F.col("h").alias("x"), F.lit(0).cast("long").alias("y"), "n"))
    found = with_counted(lines.select("uid", "line", "n_lines", "h"), first.select(F.col("x").alias("h"), "n", "rank"), ["h"])
    return materialize(found.select("uid", "line", "n_lines", "rank"), "ranks")


def _doubled(now: DataFrame, step: int, least: int = 1) -> DataFrame:
    """Ranks by ``step`` lines more, of the suffixes of which at least ``least`` share one."""
    ahead = now.select("uid", (F.col("line") - step).alias("line"), F.col("rank").alias("next"))
    pairs = now.join(ahead, ["uid", "line"], "left")
    after = F.col("line") + step
    alone = F.lit(_ALONE) + F.shiftrightunsigned(F.xxhash64("uid", after), 2)  # a line that occurs once
    key = F.when(after >= F.col("n_lines"), F.lit(0).cast("long")).otherwise(F.coalesce("next", alone))
    pairs = materialize(pairs.select("uid", "line", "n_lines", F.col("rank").alias("x"), key.alias("y")), "doubled")
    order = numbered(pairs.groupBy("x", "y").agg(F.count("*").alias("n")).where(F.col("n") >= least))
    new = materialize(with_counted(pairs, order, ["x", "y"]).select("uid", "line", "n_lines", "rank"), "ranks")
    discard(pairs.sparkSession, pairs)
    return new


def suffix_array(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, line, rank) of every suffix that begins with a repeated line; the array is in order of rank, then doc_id, uid, line."""
    lines = lines_of(docs)
    now, h = _first_ranks(lines), 1
    groups = now.select("rank").distinct().count()
    while True:
        new = _doubled(now, h)
        discard(docs.sparkSession, now)
        now, h = new, 2 * h
        found = now.select("rank").distinct().count()
        if found == groups:  # ranks no longer part
            break
        groups = found
    return now.join(lines.select("doc_id", "uid", "line"), ["uid", "line"]).select("doc_id", "uid", "line", "rank")


def _later(windows: DataFrame, *by: str) -> DataFrame:
    """Windows that are not the first of their interval, in order of doc_id (null last), uid, line."""
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "uid", "line")
    least = windows.groupBy(*by).agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1")
    return with_counted(windows, least, list(by)).where(place > F.col("least")).drop("least", "n")


def _later_windows(lines: DataFrame) -> DataFrame:
    """(uid, from, stop) of the later copies among the shortest windows, each without what the ones before it of its text hold."""
    spark = lines.sparkSession
    on = lines.where("on > 0").select("doc_id", "uid", "line", F.col("on").alias("size"))
    back = lines.where("back > 0").select("doc_id", "uid", (F.col("line") - F.col("back") + 1).alias("line"), F.col("back").alias("size"))
    windows = materialize(on.unionByName(back).distinct(), "run-windows")
    longest = windows.agg(F.max("size")).first()[0] or 0
    now, h = _first_ranks(lines), 1
    found, used = [], []
    while h <= longest:
        here = windows.where((F.col("size") >= h) & (F.col("size") < 2 * h))
        of = here.join(now.select("uid", "line", F.col("rank").alias("head")), ["uid", "line"])
        tail = now.select("uid", F.col("line").alias("last"), F.col("rank").alias("tail"))
        of = materialize(of.withColumn("last", F.col("line") + F.col("size") - h).join(tail, ["uid", "last"]), "interval-windows")
        found.append(materialize(_later(of, "size", "head", "tail").select("uid", "line", "size"), "later"))
        used += [now, of]
        if 2 * h > longest or now.isEmpty():
            break
        now, h = _doubled(now, h, 2), 2 * h
    discard(spark, *used, windows)
    if not found:
        return lines.select("uid", F.col("line").alias("from"), F.col("line").alias("stop")).limit(0)
    runs = found[0]
    for f in found[1:]:
        runs = runs.unionByName(f)
    before = Window.partitionBy("uid").orderBy("line", "size").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("line") + F.col("size")
    runs = runs.select("uid", F.greatest("line", F.coalesce(F.max(stop).over(before), F.lit(0))).alias("from"), stop.alias("stop"))
    return runs.where(F.col("from") < F.col("stop"))


def marked(lines: DataFrame) -> DataFrame:
    """(uid, line, gone) of the lines of later copies, from the table of ``lines_of``: each line once."""
    return _later_windows(lines).select("uid", F.explode(F.sequence("from", F.col("stop") - 1)).alias("line"), F.lit(True).alias("gone"))


def later_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, uid, first_line, n_lines, n_words of the stretches of lines that later copies take up; stretches that touch are one."""
    lines = lines_of(docs, min_words=min_words)
    x = lines.join(marked(lines), ["uid", "line"])
    nth = F.row_number().over(Window.partitionBy("uid").orderBy("line"))
    x = x.withColumn("run", F.col("line") - nth).groupBy("uid", "run")
    return x.agg(
        F.first("doc_id").alias("doc_id"), F.min("line").alias("first_line"), F.count("*").alias("n_lines"), F.sum("n_words").alias("n_words")
    ).select("doc_id", "uid", "first_line", "n_lines", "n_words")


def digest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_chars (of the kept lines, borders not counted) of every row of ``docs``.

    Null and empty texts have one empty line. Of repeated rows all but one lose their lines; null ids come last. Other
    columns are ignored; an empty table gives an empty result.
    """
    lines = lines_of(docs, min_words=min_words)
    x = lines.join(marked(lines), ["uid", "line"], "left").groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"), F.count("*").alias("n_lines"), F.count("gone").alias("n_removed"),
        F.coalesce(F.sum(F.when(F.col("gone").isNull(), F.col("n_chars"))), F.lit(0)).alias("kept_chars"),
    )
    return x.select("doc_id", "n_lines", "n_removed", "kept_chars")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text (the kept lines), removed (numbers of the deleted lines, from 0) of every row of ``docs``. As in ``digest``."""
    lines = lines_of(docs, texts=True, min_words=min_words)
    x = lines.join(marked(lines.drop("text")), ["uid", "line"], "left")
    x = x.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("line", "text", "gone"))).alias("of"))  # one text's lines
    kept = F.filter("of", lambda v: v["gone"].isNull())
    return x.select("doc_id", F.array_join(F.transform(kept, lambda v: v["text"]), "\n").alias("text"), F.transform(F.filter("of", lambda v: v["gone"]), lambda v: v["line"]).alias("removed"))
