"""Benchmark decontamination by template canonicalisation.

Words of letters and digits become templates: numbers (digits with their separators, ordinals, number words), capitalised names (a run of
them is one, also at the opening of a sentence) and units after a number turn into typed placeholders, each one template word. Windows of ``WINDOW`` template words are hashed; document windows meet benchmark windows in a hash join (a bitmap of fixed
size over the benchmark's hashes goes to the executors first and keeps back what can't match). For every document and item,
the fillers of the placeholders must be consistent: one filler of the item always has the same filler in the document. An item
of which at least ``COVERAGE`` of the windows occur that way is found, be it verbatim or re-parameterised. Windows of too few plain words
meet only where their words are the same.

Beside the templates, windows of ``WINDOW`` words as they stand (the whole of a shorter item) meet in the same join, and an item is also found by
its share of these. So copies are found of items that are all placeholders, that are short, or whose copy has one filler changed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import list_array, map_arrow, materialize, text_parts
from .licenses import hash_words

WINDOW = 8
SHORTEST = 5  # items of fewer template words are found only by their words as they stand
COVERAGE = 0.5
PLAIN = 3  # words of a window that aren't placeholders, at least
BITMAP = 1 << 24

# Words that count as units after a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces ml l liter liters litre litres gallon gallons cup cups "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent degree degrees c f k kelvin celsius fahrenheit mph kph kmh hz khz mhz ghz v volt volts w kw watt watts j joule joules n newton newtons pa kpa "
    "usd eur gbp dollar dollars euro euros cent cents kb mb gb tb byte bytes bit bits px"
).split()

# Words that are numbers, and endings of ordinals.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    "thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion dozen"
).split()
ORDINALS = ("st", "nd", "rd", "th")

U = np.uint64
_NUM, _NAME, _UNIT = U(0x6E756D0000000001), U(0x6E616D6500000003), U(0x756E697400000005)
_FEW, _EXACT = U(0x6665770000000007), U(0x6578616374000009)
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_END = np.isin(np.arange(256), list(b".!?\n:;"))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_INSIDE, _LINK = np.isin(np.arange(256), list(b".,'_")), np.isin(np.arange(256), list(b" -"))


class Templates:
    """Template words of many texts: hash, raw filler hash, whether a placeholder, text and first word (of runs of letters and digits) of each."""

    def __init__(self, b: np.ndarray, offs: np.ndarray, units: np.ndarray, numbers: np.ndarray, ordinals: np.ndarray):
        spans = tv.Spans(tv.LOWER[b])
        s, e, doc = tv.runs(_WORD[b], offs)
        self.word_begin = np.searchsorted(doc, np.arange(len(offs) - 1))
        # digits that letters follow are a word of their own, but for ordinals
        letters = np.flatnonzero(_WORD[b] & ~_DIGIT[b])
        cut = np.minimum(np.append(letters, len(b))[np.searchsorted(letters, s)], e)
        ordinal = (cut > s) & (cut < e) & _among(spans.hash(cut, e), ordinals)
        apart = (cut > s) & (cut < e) & ~ordinal
        word = np.repeat(np.arange(len(s)), 1 + apart)
        second = np.zeros(len(word), bool)
        second[1:] = word[1:] == word[:-1]
        start = np.where(second, cut[word], s[word])
        end = np.where(apart[word] & ~second, cut[word], e[word])
        self.plain, self.plain_doc = spans.hash(s, e), doc
        doc = doc[word]
        n = len(word)
        first = np.ones(n, bool)
        first[1:] = doc[1:] != doc[:-1]
        raw = spans.hash(start, end)
        digits = cut[word] == end
        spelled = _among(raw, numbers)
        num = digits | ordinal[word] | spelled
        ends = np.concatenate(([0], np.cumsum(_END[b], dtype=np.int64)))
        opens = first.copy()
        opens[1:] |= ends[start[1:]] > ends[end[:-1]]
        unit = np.zeros(n, bool)
        unit[1:] = _among(raw, units)[1:] & num[:-1] & ~first[1:]
        name = (b[start] >= 65) & (b[start] <= 90) & ~num & ~unit
        on = np.zeros(n, bool)  # goes on with the placeholder before it
        if n:
            gap, sign = start[1:] - end[:-1] == 1, b[np.minimum(end[:-1], len(b) - 1)]
            on[1:] = ~first[1:] & gap & (
                (digits[1:] & digits[:-1] & _INSIDE[sign]) | (spelled[1:] & num[:-1] & _LINK[sign]) | (name[1:] & name[:-1] & (_LINK[sign] | (sign == 39)))
            )
        at = np.flatnonzero(~on)
        last = np.append(at, n)[1:] - 1
        self.doc, self.word = doc[at], word[at]
        self.raw = spans.hash(start[at], end[last])
        # a name's filler without the word that opens the sentence, which may be no part of it; 0 where there is none
        self.rest = np.zeros(len(at), U)
        led = name[at] & opens[at] & (last > at)
        self.rest[led] = spans.hash(start[at[led] + 1], end[last[led]])
        num, unit, name = num[at], unit[at], name[at]
        self.hole = num | name | unit
        self.hash = np.where(num, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, self.raw)))
        self.words = np.bincount(self.doc, minlength=len(offs) - 1)
        self.begin = np.cumsum(self.words) - self.words

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First template word and hash of each window of k of them: of the templates if enough are plain, else of the words themselves."""
        at, h = tv.windows(self.hash, self.doc, k)
        plain = np.concatenate(([0], np.cumsum(~self.hole, dtype=np.int64)))
        few = plain[at + k] - plain[at] < min(PLAIN, k)
        same = tv.windows(self.raw, self.doc, k)[1]
        return at, tv.mix(np.where(few, same ^ _FEW, h) + U(k))

    def exact(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window of k words as they stand."""
        at, h = tv.windows(self.plain, self.plain_doc, k)
        return at, tv.mix((h ^ _EXACT) + U(k))

    def fillers(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Two filler hashes of each window's placeholders (the whole, and without the opening word or 0), and their counts."""
        grid = at[:, None] + np.arange(k)
        hole = self.hole[grid]
        return np.stack((self.raw[grid][hole], self.rest[grid][hole]), axis=1).ravel(), 2 * hole.sum(axis=1)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _known() -> tuple[np.ndarray, ...]:
    return tuple(np.sort(hash_words(list(words))) for words in (UNITS, NUMBERS, ORDINALS))


_FIELDS = "at int, size int, exact boolean, word int, h long, fill array<long>"


def _window_rows(sizes: list[tuple[bool, int]] | None, bitmap: np.ndarray | None):
    """(key, text) to one row a window of the sizes (exact, k); without sizes, of WINDOW words or the whole of a shorter text."""

    def go(batches):
        known = _known()
        for batch in batches:
            for a, b, offs in text_parts(batch.column(1)):
                t = Templates(b, offs, *known)
                for exact, k in sizes or [*((False, k) for k in range(SHORTEST, WINDOW + 1)), *((True, k) for k in range(1, WINDOW + 1))]:
                    at, h = t.exact(k) if exact else t.windows(k)
                    doc = t.plain_doc if exact else t.doc
                    if sizes is None and k < WINDOW:
                        whole = np.bincount(doc, minlength=len(offs) - 1)[doc[at]] == k
                        at, h = at[whole], h[whole]
                    if bitmap is not None:
                        bit = (h & U(BITMAP - 1)).astype(np.int64)
                        ok = (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                        at, h = at[ok], h[ok]
                    if not len(at):
                        continue
                    d = doc[at]
                    fill, count = (np.zeros(0, U), np.zeros(len(at), np.int64)) if exact else t.fillers(at, k)
                    word = (at if exact else t.word[at]) - t.word_begin[d]
                    place = word if exact else at - t.begin[d]
                    cols = [
                        batch.column(0).slice(a, len(offs) - 1).take(pa.array(d)), pa.array(place.astype(np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), exact)),
                        pa.array(word.astype(np.int32)), pa.array(h.view(np.int64)), list_array(fill.view(np.int64), count, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "at", "size", "exact", "word", "h", "fill"])

    return go


def _bitmap(hashes: DataFrame) -> np.ndarray:
    cell = F.col("h").bitwiseAND(BITMAP - 1)
    bits = hashes.select(F.shiftright(cell, 5).alias("cell"), F.expr(f"shiftleft(1L, cast(h & 31 as int))").alias("bit"))
    rows = bits.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()  # BITMAP / 32 rows at most
    out = np.zeros(BITMAP // 32, np.uint32)
    out[rows.column("cell").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def _found(rows: DataFrame, benchmark: DataFrame, coverage: float) -> DataFrame:
    """key, item_id and the columns of ``find`` for the items found in the texts of ``rows`` (key, text)."""
    kind = rows.schema["key"].dataType.simpleString()
    items = benchmark.select(F.col("item_id").cast("long").alias("key"), F.col("text").cast("string").alias("text")).where("key is not null and text is not null")
    wanted = materialize(map_arrow(items, _window_rows(None, None), f"key long, {_FIELDS}"), "benchmark-windows")
    sizes = sorted((r["exact"], r["size"]) for r in wanted.select("exact", "size").distinct().toArrow().to_pylist())  # 2 * WINDOW at most
    totals = wanted.groupBy("key", "exact").agg(F.countDistinct("at").cast("long").alias("item_windows")).withColumnRenamed("key", "item_id")
    rows = rows.where("key is not null and text is not null")
    have = map_arrow(rows, _window_rows(sizes or [(True, WINDOW)], _bitmap(wanted)), f"key {kind}, {_FIELDS}")
    a, b = have, wanted.toDF("item_id", "item_at", "item_size", "item_exact", "item_word", "item_h", "item_fill")
    hits = a.join(b, (a["h"] == b["item_h"]) & (a["size"] == b["item_size"]) & (a["exact"] == b["item_exact"]) & (F.size("fill") == F.size("item_fill")))
    # windows of one alignment belong together
    hits = hits.select("key", "item_id", "exact", (F.col("at") - F.col("item_at")).alias("shift"), "word", "item_at", F.arrays_zip(F.col("item_fill").alias("x"), F.col("fill").alias("y")).alias("pairs"))
    hits = hits.withColumn("pairs", F.filter("pairs", lambda p: (p["x"] != 0) & (p["y"] != 0)))
    one = hits.groupBy("key", "item_id", "exact", "shift").agg(
        F.collect_set("item_at").alias("found"), F.min("word").alias("first_word"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")
    )  # a row's lists are bounded by its item's length

    def consistent(pairs: Column) -> Column:
        return F.size(F.array_distinct(F.transform(pairs, lambda p: p["x"]))) == F.size(pairs)

    one = one.where(consistent(F.col("pairs"))).withColumn("same", F.forall("pairs", lambda p: p["x"] == p["y"]))
    # alignments beside one another (a word more or less between them) count together if their fillers agree, else the one with most windows does
    best = F.max_by(F.struct("found", "first_word", "same"), F.struct(F.size("found"), -F.col("first_word"))).alias("best")
    both = one.groupBy("key", "item_id", "exact").agg(
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"), F.array_distinct(F.flatten(F.collect_set("found"))).alias("found"), F.min("first_word").alias("first_word"), F.min("same").alias("same"), best
    )
    whole = F.struct("found", "first_word", "same")
    both = both.withColumn("of", F.when(consistent(F.col("pairs")), whole).otherwise(F.col("best")))
    both = both.select("key", "item_id", "exact", F.size("of.found").cast("long").alias("n_windows"), F.col("of.first_word").cast("long").alias("first_word"), F.col("of.same").alias("same"))
    out = both.join(totals, ["item_id", "exact"]).withColumn("coverage", F.col("n_windows") / F.col("item_windows")).where(F.col("coverage") >= coverage)
    best = F.max_by(F.struct("n_windows", "item_windows", "coverage", "first_word"), F.struct("coverage", ~F.col("exact"))).alias("best")
    out = out.groupBy("key", "item_id").agg(best, F.min("same").alias("same"))
    kind = F.when(F.col("same"), "verbatim").otherwise("reparameterised")
    return out.select("key", "item_id", "best.n_windows", "best.item_windows", "best.coverage", "best.first_word", kind.alias("kind"))


def find(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row for each document and benchmark item found in it: doc_id, item_id, n_windows, item_windows, coverage, first_word, kind.

    n_windows counts the item's windows found (of templates, or of words as they stand where their share is larger), first_word is where the first
    begins (words from 0), kind is ``verbatim`` if all fillers are the item's own, else ``reparameterised``. A filler of the item
    has one filler in the document, or the alignment is no copy; windows of several alignments add up if their fillers agree. An item shorter than a window is found by
    the whole of it, be it one word. Null ids, null or empty texts and texts without a letter or digit match nothing; repeated documents are found
    once; other columns are ignored; an empty table on either side gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    return _found(rows, benchmark, coverage).withColumnRenamed("key", "doc_id")


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no benchmark item is found, whatever their id."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("_mark", F.md5(F.col("row.text").cast("string")))
    bad = _found(rows.select(F.col("_mark").alias("key"), F.col("row.text").cast("string").alias("text")), benchmark, coverage).select(F.col("key").alias("_mark")).distinct()
    return rows.join(bad, "_mark", "left_anti").select("row.*")
