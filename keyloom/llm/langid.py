"""Language identification by the nearest of several centroids per language, over hashed byte n-gram TF-IDF vectors.

The document frequencies are of all learning texts; the centroids come from a bounded sample of about ``PER_LANGUAGE`` distinct texts
of each language (all where there are fewer), clustered by spherical k-means. A text farther (1 - cosine) from its nearest centroid than nearly all
of that centroid's own texts is *rejected*: ``identify`` then says ``und`` and keeps the nearest language in ``nearest``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import discard, map_arrow, materialize, text_parts

DIM = 4096
SIZES = (2, 3, 4)
CENTROIDS = 3
PER_LANGUAGE = 600
ROUNDS = 12
#: Up to so many languages their sampling rates are broadcast; beyond it they are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000
#: Share of a centroid's own texts that its radius holds.
RADIUS = 0.995
ROWS = 192
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.where(_LETTER, tv.LOWER, 32).astype(np.uint32)


def counts(b: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, DIM) counts of the n-grams inside each text; all that isn't a letter is one blank sign."""
    nd = len(offs) - 1
    x = _FOLD[b]
    doc = np.repeat(np.arange(nd), np.diff(offs))
    out = np.zeros(nd * DIM, np.int64)
    acc = x
    for n in range(2, max(SIZES) + 1):
        if len(x) < n:
            break
        acc = acc[:-1] * np.uint32(0x01000193) + x[n - 1 :]
        if n in SIZES:
            d = doc[: len(acc)]
            code = ((acc * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
            ok = d == doc[n - 1 :]
            out += np.bincount(d[ok] * DIM + code[ok], minlength=nd * DIM)
    return out.reshape(nd, DIM)


def vectors(b: np.ndarray, offs: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = counts(b, offs).astype(np.float32)
    np.log1p(v, out=v)
    v *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    v /= np.maximum(norm, 1e-9)[:, None]
    return v


def with_letters(b: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    c = np.concatenate(([0], np.cumsum(_LETTER[b] & (b < 128), dtype=np.int64)))
    has = c[offs[1:]] > c[offs[:-1]]
    for d in np.flatnonzero(~has & (np.diff(offs) > 0)).tolist():
        has[d] = any(ch.isalpha() for ch in b[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "replace"))
    return has


def _frequencies(batches):
    df, n = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for _, b, offs in text_parts(batch.column(0), 1 << 20, ROWS):
            df += (counts(b, offs) > 0).sum(axis=0)
            n += len(offs) - 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array(np.append(df, n))], ["bin", "n"])


def _clustered(idf: np.ndarray, k: int):
    import pandas as pd

    def go(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("order")
        got = []
        for _, b, offs in text_parts(pa.array(group["text"], pa.string()), 1 << 20, ROWS):
            got.append(vectors(b, offs, idf)[with_letters(b, offs)])
        x = np.concatenate(got) if got else np.zeros((0, DIM), np.float32)
        if not len(x):
            return pd.DataFrame({"lang": [], "radius": [], "centroid": []})
        c = [x.mean(axis=0)]  # then the farthest from those chosen
        while len(c) < min(k, len(x)):
            c.append(x[np.argmin((x @ np.array(c).T).max(axis=1))])
        c = np.array(c)
        for _ in range(ROUNDS):
            c /= np.maximum(np.linalg.norm(c, axis=1), 1e-9)[:, None]
            near = (x @ c.T).argmax(axis=1)
            c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1), 1e-9)[:, None]
        sim = x @ c.T
        near, far = sim.argmax(axis=1), 1 - sim.max(axis=1)
        every = np.quantile(far, RADIUS)
        radius = [float(max(np.quantile(far[near == j], RADIUS), every)) if (near == j).any() else float(every) for j in range(len(c))]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "radius": radius, "centroid": [v.astype(float).tolist() for v in c]})

    return go


class Model:
    def __init__(self, langs: list[str], centroids: np.ndarray, radii: np.ndarray, idf: np.ndarray):
        self.langs, self.centroids, self.radii, self.idf = langs, centroids, radii, idf


def fit(docs: DataFrame) -> Model:
    """Learn from the rows of ``docs`` (text, lang) with text and lang. Its size: 16 kB for each centroid."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    got = map_arrow(rows.select("text"), _frequencies, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # DIM + 1 rows
    n = np.zeros(DIM + 1)
    n[got.column("bin").to_numpy()] = got.column("n").to_numpy()
    idf = (np.log((1 + n[DIM]) / (1 + n[:DIM])) + 1).astype(np.float32)
    # drawn over distinct texts, each once: copies neither swell a language's sample nor are left out together
    mark = F.xxhash64("text", F.lit(11))
    marks = materialize(rows.select("lang", mark.alias("order")).distinct(), "text-marks")
    rate = marks.groupBy("lang").agg((F.lit(float(PER_LANGUAGE)) / F.count("*")).alias("rate"))
    if rate.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES:
        rate = F.broadcast(rate)
    place = (F.shiftrightunsigned(F.col("order"), 11).cast("double")) / F.lit(float(1 << 53))
    drawn = rows.select("lang", "text", mark.alias("order")).join(rate, "lang").where(place < F.col("rate"))
    some = drawn.groupBy("lang", "order").agg(F.min("text").alias("text"))
    ship_fn = _clustered(idf, CENTROIDS)
    made = some.groupBy("lang").applyInPandas(ship_fn, "lang string, radius double, centroid array<float>").toArrow().to_pylist()
    discard(docs.sparkSession, marks)
    made.sort(key=lambda r: (r["lang"], r["radius"]))
    c = np.array([r["centroid"] for r in made], np.float32).reshape(len(made), DIM)
    return Model([r["lang"] for r in made], c, np.array([r["radius"] for r in made]), idf)


def identify(docs: DataFrame, model: Model, key: Column | None = None) -> DataFrame:
    """key, lang_pred, score, rejected, nearest of every row of ``docs``; only its text is looked at.

    lang_pred is ``und`` for null texts, texts without a letter and rejected ones; score is the cosine to the nearest
    centroid (0 without a letter). Without any learned language all is ``und``. An empty table gives an empty result.
    """
    key = F.col("doc_id").cast("long") if key is None else key
    names = np.array([*model.langs, UNKNOWN], dtype=object)

    def go(batches):
        for batch in batches:
            for at, b, offs in text_parts(batch.column(1), 1 << 20, ROWS):
                nd = len(offs) - 1
                has = with_letters(b, offs) & bool(len(model.langs))
                best, score = np.full(nd, len(names) - 1), np.zeros(nd)
                if len(model.langs):
                    sim = vectors(b, offs, model.idf) @ model.centroids.T
                    best = np.where(has, sim.argmax(axis=1), best)
                    score = np.where(has, np.clip(sim.max(axis=1), 0, 1), 0).astype(float)
                out = has & (1 - score > np.append(model.radii, 2.0)[best])
                near = names[best]
                said = np.where(out, UNKNOWN, near)
                cols = [batch.column(0).slice(at, nd), pa.array(said, pa.string()), pa.array(score), pa.array(out), pa.array(near, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["key", "lang_pred", "score", "rejected", "nearest"])

    rows = docs.select(key.alias("key"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return map_arrow(rows, go, f"key {kind}, lang_pred string, score double, rejected boolean, nearest string")
