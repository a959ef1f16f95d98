"""Quality rules: hashed byte n-gram log-likelihood ratio between a trusted target and the raw corpus, after base rules.

Both multinomials are over ``BUCKETS`` hashed byte trigrams. The raw one counts every text; the trusted one a bounded sample
(about ``TRUSTED_ROWS`` documents, drawn by their id hash) of documents labelled of quality 1. A text's score is the mean
of log(trusted / raw) over its trigrams; it passes if the score reaches ``THRESHOLD``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import map_arrow, sampled_labels, text_parts

BUCKETS = 1 << 16
TRUSTED_ROWS = 20_000
#: Mean log-likelihood ratio from which a text is kept.
THRESHOLD = -0.5
SYMBOLS = "#*$%&|<>"
WINDOW = 5
_SYM = np.isin(np.arange(256), list(SYMBOLS.encode()))


def _grams(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each trigram that stays inside its text, and its text."""
    n = len(b) - 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = b.astype(np.uint32)
    g = (x[:n] << np.uint32(16)) | (x[1 : n + 1] << np.uint32(8)) | x[2:]
    g = ((g * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    counts = np.maximum(np.diff(offs) - 2, 0)
    ok = np.ones(n, bool)
    ends = offs[1:-1]
    ok[ends[(ends >= 1) & (ends - 1 < n)] - 1] = False
    ok[ends[(ends >= 2) & (ends - 2 < n)] - 2] = False
    return g[ok], counts


def _count(batches):
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        trusted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for at, b, offs in text_parts(batch.column(0)):
            g, counts = _grams(b, offs)
            total[0] += np.bincount(g, minlength=BUCKETS)
            t = np.repeat(trusted[at : at + len(counts)], counts)
            if t.any():
                total[1] += np.bincount(g[t], minlength=BUCKETS)
    some = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], ["bucket", "raw", "trusted"])


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log(trusted / raw) by bucket, float32. Without trusted texts all are 0, so that only the base rules reject."""
    picked = sampled_labels(labels, "quality", TRUSTED_ROWS, lambda i, q: q == 1).select(F.col("doc_id").alias("trusted_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(picked), F.col("doc_id") == F.col("trusted_id"), "left")  # about TRUSTED_ROWS
    counts = map_arrow(rows.select("text", F.col("trusted_id").isNotNull().alias("trusted")), _count, "bucket long, raw long, trusted long")
    got = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toArrow()  # BUCKETS rows at most
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[got.column("bucket").to_numpy()] = got.column("raw").to_numpy()
    trusted[got.column("bucket").to_numpy()] = got.column("trusted").to_numpy()
    if not trusted.sum():
        return np.zeros(BUCKETS, np.float32)
    # the raw corpus is the trusted one's prior, with the weight of one trigram in a hundred
    p = (raw + 0.5) / (raw + 0.5).sum()
    weight = 0.01 * trusted.sum()
    q = (trusted + weight * p) / (trusted.sum() + weight)
    return np.log(q / p).astype(np.float32)


def measures(b: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts of each text."""
    nd = len(offs) - 1

    def by_text(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return c[offs[1:]] - c[offs[:-1]]

    inside = ~tv.WS[b]
    s, e, doc = tv.runs(inside, offs)
    spans = tv.Spans(b)
    h = spans.hash(s, e)
    words = np.bincount(doc, minlength=nd)
    # lines with a word that equal an earlier one of their text
    ls, le, ld = tv.runs(b != 10, offs)
    cw = np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))
    some = cw[le] > cw[ls]
    key = tv.mix(spans.hash(ls[some], le[some]) + ld[some].astype(tv.U) * tv.U(0xA24BAED4963EE407))
    ld = ld[some]
    fresh = np.zeros(len(key), bool)
    fresh[np.unique(key, return_index=True)[1]] = True
    dup = np.bincount(ld[~fresh], minlength=nd)
    # words in windows found twice or more
    at, w = tv.windows(h, doc, WINDOW)
    repeat = np.zeros(nd, np.int64)
    if len(at):
        w = tv.mix(w + doc[at].astype(tv.U) * tv.U(0x9FB21C651E98DF25))
        order = np.argsort(w)
        same = w[order][1:] == w[order][:-1]
        twice = np.zeros(len(w), bool)
        twice[1:] = same
        twice[:-1] |= same
        first = at[order[twice]]
        edge = np.bincount(first, minlength=len(h) + 1)[: len(h) + 1] - np.bincount(first + WINDOW, minlength=len(h) + 1)[: len(h) + 1]
        repeat = np.bincount(doc[np.cumsum(edge)[: len(h)] > 0], minlength=nd)
    return {
        "n_words": words,
        "word_chars": by_text(inside & ((b & 0xC0) != 0x80)),
        "n_symbols": by_text(_SYM[b]),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
    }


def score_rows(table: np.ndarray, threshold: float):
    def go(batches):
        for batch in batches:
            for at, b, offs in text_parts(batch.column(1)):
                m = measures(b, offs)
                g, counts = _grams(b, offs)
                sums = np.concatenate(([0.0], np.cumsum(table[g], dtype=np.float64)))
                ends = np.cumsum(counts)
                llr = (sums[ends] - sums[ends - counts]) / np.maximum(counts, 1)
                failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
                cols = [batch.column(0).slice(at, len(counts)), *[pa.array(v.astype(np.int64)) for v in m.values()]]
                cols += [pa.array(failed), pa.array(~failed & (llr >= threshold)), pa.array(llr)]
                yield pa.RecordBatch.from_arrays(cols, ["key", *m, "base_failed", "kept", "llr"])

    return go


SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and the measures and verdict of every row of ``docs``; columns beside doc_id and text are ignored.

    Null and empty texts have no words and fail the base rules. A null doc_id passes through. Repeated rows are scored alike.
    An empty table gives an empty result.
    """
    table = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, score_rows(table, threshold), "key long, " + SCORED).withColumnRenamed("key", "doc_id")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    table = fit(docs, labels)
    inner = score_rows(table, threshold)
    names = docs.columns

    def go(batches):
        for batch in batches:
            at = batch.schema.names.index("text")
            mark = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), batch.column(at)], ["key", "text"])
            ok = [x.column("kept") for x in inner([mark])]
            yield batch.filter(pa.concat_arrays(ok) if ok else pa.array([], pa.bool_()))

    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in names]), go, docs.schema)
