"""Toxicity: noisy-channel restoration of disguised words, then scoring of the restored text.

*Channel.* Signs that stand for letters (``LEET``), letters of other scripts that look like Latin ones (``LOOKS``), accents on all vowels of a word, repeated
letters, letters set apart by separators and words cut by one sign make a lattice: each sign is one of its letters or a word border, each
look-alike or accented letter itself or its Latin letter, each repetition one or two letters, each separator nothing or a word border; signs without width
are nothing. *Source.* A character model of order 4 over all texts of the corpus (exact counts over 32 symbols, so
at most 2**20 of them whatever the corpus). Viterbi decoding finds the likeliest restored word. A text without any such sign has one path,
itself. Doubled letters and single signs inside a word, which plain texts have too, make a lattice only where the model finds them unlikely.
Words that are cut by one blank are not put together.

*Score.* Words of the restored text whose link with toxic labels passes a likelihood-ratio test (corrected for the number of words
tried) each count with the lower end of the confidence interval of their toxic share; they are combined by noisy-or over the base rate.
Capital letters of ASCII and Latin-1 are folded alike in all texts, restored or not.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import map_arrow, materialize, sampled_labels, text_parts

#: Labelled documents used for fitting, about: drawn by a threshold on their id hash.
LABEL_ROWS = 20_000
FLAG = 0.7

# What disguising signs stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou",
}
# Letters of other scripts that look like Latin ones.
LOOKS = dict(zip("абвгдеһіјкмнорѕтухԁѵαβεικνορτυχγ", "abbrdehijkmhopstyxdvabeikvoptuxy", strict=True))
_FREE = "0134578@$9"  # signs that count next to a letter on either side; the others only before one
_SUB, _BREAK, _JOIN, _ONCE, _TWICE, _DOUBLE = -1.0, -1.5, -0.5, -0.3, -0.6, -0.7
#: Doubled letters are looked at below this log probability; a sign inside a word where the joined word is likelier by so much.
_RARE, _GAIN = -6.0, 2.0

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SYMBOL = np.zeros(256, np.uint32)  # 0: border; 1-26: a-z; 27-31: other letters
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27 + np.arange(128) % 5
_SEPARATORS = " .-_*/,"
_IS_FREE, _IS_AHEAD, _IS_SEP, _IS_CUT = (np.isin(np.arange(256), list(s.encode())) for s in (_FREE, "".join(c for c in LEET if c not in _FREE), _SEPARATORS, "-._*/"))
_VOWEL = np.isin(np.arange(256), list(b"aeiouAEIOU"))
_TOKEN = re.compile(r"(?:[^\W_]|[@$!|+(*]|(?<=[^\W\d_])[-._/](?=[^\W\d_]))+")
_SPACED = re.compile(r"(?<![^\W_])[a-z0134578@$9](?:[ .\-_*/,][a-z0134578@$9]){2,}(?![^\W_])")
_TAIL = re.compile(r"(?:[!|+(*]+|([@$])\1{2,})$")
_TRIPLE, _TWO = re.compile(r"([a-z])\1\1"), re.compile(r"([a-z])\1")
_CUT = re.compile(r"(?<=[^\W\d_])[-._*/](?=[^\W\d_])")
_ZERO = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")


def _base(c: str) -> str:
    """The Latin letter under an accent, or of full width; '' for others."""
    d = unicodedata.normalize("NFKD", c)[0].lower()
    return d if "a" <= d <= "z" and d != c else ""


def _symbol(w: str, i: int) -> int:
    if not 0 <= i < len(w):
        return 0
    k = ord(w[i]) - 96
    return k if 1 <= k <= 26 else 0 if k < 32 else int(_SYMBOL[w[i].encode()[-1]])


def folded(b: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capital letters of ASCII and Latin-1 in lower case."""
    out = tv.LOWER[b]
    high = np.zeros(len(b), bool)
    high[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
    out[high] += 0x20
    return out


# ---- character model -------------------------------------------------------------------------------------------


def _four_grams(batches):
    total = np.zeros(1 << 20, np.int64)
    for batch in batches:
        for _, b, offs in text_parts(batch.column(0)):
            s = _SYMBOL[b]
            keep = np.ones(len(s), bool)
            keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
            s = np.concatenate((np.zeros(3, np.uint32), s[keep], np.zeros(1, np.uint32)))
            total += np.bincount((s[:-3] << 15) | (s[1:-2] << 10) | (s[2:-1] << 5) | s[3:], minlength=1 << 20)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(symbol | three before it), (32, 32, 32, 32), each order smoothed by the one below."""
    got = map_arrow(docs.select(F.col("text").cast("string").alias("text")), _four_grams, "gram long, n long")
    got = got.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # 2**20 rows at most
    n = np.zeros(1 << 20)
    n[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    n = n.reshape(32, 32, 32, 32)
    p = np.full(32, 1 / 32)
    for axes in ((0, 1, 2), (0, 1), (0,), ()):
        c = n.sum(axis=axes) if axes else n
        p = (c + 4 * p) / (c.sum(axis=-1, keepdims=True) + 4)
    return np.log(p).astype(np.float32)


class Restorer:
    """Restores texts under a character model; remembers decoded words."""

    def __init__(self, model: np.ndarray):
        self.p = model
        self.seen: dict[str, str] = {}

    def word(self, w: str) -> str:
        if w not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[w] = self.decode(self.lattice(w, False))
        return self.seen[w]

    @staticmethod
    def lattice(w: str, spaced: bool) -> list[list[tuple[str, float]]]:
        out: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(w):
            c = w[i]
            n = 1
            while i + n < len(w) and w[i + n] == c:
                n += 1
            if c in " .-_/," or (c == "*" and spaced):
                out.append([("", _JOIN), (" ", 0.0)])
                n = 1
            elif c in LEET:
                opts = [(x, _SUB) for x in LEET[c]] + [(" ", _BREAK)]
                if n >= 3:
                    out.append(opts + [(x + x, _SUB + _TWICE) for x in LEET[c]])
                else:
                    out.extend([opts] * n)
            elif c > "\x7f" and c.isalpha():
                latin = LOOKS.get(c) or _base(c)
                out.extend([[(c, 0.0), (latin, _SUB)] if latin else [(c, 0.0)]] * n)
            elif not "a" <= c <= "z":
                out.append([(" ", 0.0)])
            elif n >= 3:
                out.append([(c, _ONCE), (c + c, _TWICE)])
            elif n == 2:
                out.append([(c + c, 0.0), (c, _DOUBLE)])
            else:
                out.append([(c, 0.0)])
            i += n
        return out

    @staticmethod
    def symbols(text: str) -> list[tuple[str, tuple[int, ...]]]:
        """Each character with its symbols."""
        return [(c, (0,) if c == " " else (ord(c) - 96,) if "a" <= c <= "z" else tuple(_SYMBOL[list(c.encode())].tolist())) for c in text]

    def decode(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The likeliest restored string. States are the last three symbols, so the search is exact."""
        p = self.p
        states: dict[tuple[int, int, int], tuple[float, tuple | None]] = {(0, 0, 0): (0.0, None)}
        for options in [*([(self.symbols(t), cost) for t, cost in o] for o in lattice), [(self.symbols(" "), 0.0)]]:
            new: dict[tuple[int, int, int], tuple[float, tuple | None]] = {}
            for (a, b, c), (score, back) in states.items():
                for text, cost in options:
                    x, y, z, s, path = a, b, c, score + cost, back
                    for ch, ks in text:
                        if ks == (0,) and z == 0:
                            continue
                        for k in ks:
                            s += float(p[x, y, z, k])
                            x, y, z = y, z, k
                        path = (path, ch)
                    old = new.get((x, y, z))
                    if old is None or s > old[0]:
                        new[x, y, z] = (s, path)
            states = new
        path = max(states.values(), key=lambda v: v[0])[1]
        out = []
        while path is not None:
            path, ch = path
            out.append(ch)
        return "".join(reversed(out)).strip()

    def odd(self, w: str) -> bool:
        """Whether a word could come from the channel."""
        if _TRIPLE.search(w) or any(c in LEET for c in w):
            return True
        other = [c for c in w if c > "\x7f"]
        if other and (any(c in LOOKS or "\uff21" <= c <= "\uff5a" for c in other) or (len(other) > 1 and not any(c in "aeiou" for c in w))):
            return True
        return self.unlikely(w)

    def unlikely(self, w: str) -> bool:
        """``_unlikely`` of one word: only its doubled letters and inner signs are looked at."""
        p = self.p
        for m in _TWO.finditer(w):
            i, k = m.start(), ord(m[1]) - 96
            if p[_symbol(w, i - 2), _symbol(w, i - 1), k, k] < _RARE:
                return True
        for m in _CUT.finditer(w):
            i = m.start()
            x, y, z, u, v = (_symbol(w, i + k) for k in (-3, -2, -1, 1, 2))
            if p[x, y, z, u] + p[y, z, u, v] > p[x, y, z, 0] + p[y, z, 0, u] + p[z, 0, u, v] + _GAIN:
                return True
        return False

    def text(self, text: str) -> str:
        """A folded text with its odd words restored."""
        text = _ZERO.sub("", text)
        text = _SPACED.sub(lambda m: self.decode(self.lattice(m[0], True)) if any("a" <= c <= "z" for c in m[0]) else m[0], text)

        def one(m: re.Match) -> str:
            w = _TAIL.sub("", m[0])
            if not any(c.isalpha() for c in w) or len(w) > 64 or not self.odd(w):
                return m[0]
            return self.word(w)

        return _TOKEN.sub(one, text)


def _unlikely(b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Places of folded bytes where a doubled letter is rare, or a sign parts two letters that the model would rather join."""
    n = len(b)
    pad = np.concatenate((np.zeros(4, np.uint8), b, np.zeros(4, np.uint8)))
    at = lambda k, i: _SYMBOL[pad[4 + k + i]]
    out = np.zeros(n, bool)
    low = (b >= 97) & (b <= 122)
    i = np.flatnonzero(low & (b == pad[5 : 5 + n]))
    out[i] = p[at(-2, i), at(-1, i), at(0, i), at(1, i)] < _RARE
    i = np.flatnonzero(_IS_CUT[b] & _LETTER[pad[3 : 3 + n]] & _LETTER[pad[5 : 5 + n]])
    x, y, z, u, v = at(-3, i), at(-2, i), at(-1, i), at(1, i), at(2, i)
    zero = np.zeros(len(i), np.uint32)
    apart = p[x, y, z, zero] + p[y, z, zero, u] + p[z, zero, u, v]
    out[i] |= p[x, y, z, u] + p[y, z, u, v] > apart + _GAIN
    return out


def suspicious(b: np.ndarray, offs: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Bytes of folded texts at which something begins that the channel could have made."""
    n = len(b)
    pad = np.concatenate((np.zeros(4, np.uint8), b, np.zeros(4, np.uint8)))
    at = lambda k: pad[4 + k : 4 + k + n]
    letter, before, after = _LETTER[b], _LETTER[at(-1)], _LETTER[at(1)]
    run = ((b == at(1)) & (b == at(2))) | ((b == at(-1)) & (b == at(1))) | ((b == at(-1)) & (b == at(-2)))
    odd = _IS_FREE[b] & (before | after) & ~run
    odd |= _IS_AHEAD[b] & after
    odd |= letter & (b < 128) & (b == at(1)) & (b == at(2))
    odd |= _IS_FREE[b] & run & before & after
    one = (letter | _IS_FREE[b]) & ~before & ~after
    p1 = np.concatenate((one, np.zeros(4, bool)))
    s1 = np.concatenate((_IS_SEP[b], np.zeros(4, bool)))
    odd |= p1[:n] & s1[1 : n + 1] & p1[2 : n + 2] & s1[3 : n + 3] & p1[4 : n + 4]
    odd |= _unlikely(b, p)
    if (b >= 128).any():
        # signs without width; letters of other scripts and of full width
        odd |= (b == 0xE2) & (((at(1) == 0x80) & (at(2) >= 0x8B) & (at(2) <= 0x8D)) | ((at(1) == 0x81) & (at(2) == 0xA0)))
        odd |= ((b == 0xEF) & (at(1) == 0xBB) & (at(2) == 0xBF)) | ((b == 0xC2) & (at(1) == 0xAD))
        plain = lambda k: (at(k) >= 97) & (at(k) <= 122)
        odd |= (b >= 0xCE) & (b <= 0xD4) & (plain(-1) | plain(2))
        odd |= (b == 0xEF) & (at(1) >= 0xBC) & (at(1) <= 0xBD)
        # words of several accents without a plain vowel
        s, e, _ = tv.runs(letter, offs)
        c = lambda x: np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
        high, vowel = c(b >= 0xC0), c(_VOWEL[b])
        odd[s[(high[e] - high[s] > 1) & (vowel[e] == vowel[s])]] = True
    return odd


def stretches(t: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of a text about the given bytes, from two words before one to six words behind it, whole words and none twice."""
    ws = np.flatnonzero((t == 32) | (t == 10))
    edge = np.concatenate((np.full(2, -1), ws, np.full(7, len(t))))
    w = np.searchsorted(ws, at)
    left, right = edge[w] + 1, np.maximum.accumulate(edge[w + 8])
    first = np.flatnonzero(np.concatenate(([True], left[1:] > right[:-1])))
    last = np.append(first[1:] - 1, len(at) - 1)
    return list(zip(left[first].tolist(), right[last].tolist(), strict=True))


def restored(b: np.ndarray, offs: np.ndarray, with_: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """The texts' folded bytes, what is suspicious in them restored."""
    low = folded(b)
    mask = suspicious(low, offs, with_.p)
    c = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    odd = np.flatnonzero(c[offs[1:]] > c[offs[:-1]])
    if not len(odd):
        return low, offs
    size = np.diff(offs)
    pieces, last = [], 0
    for d in odd.tolist():
        t = low[offs[d] : offs[d + 1]]
        for x, y in stretches(t, np.flatnonzero(mask[offs[d] : offs[d + 1]])):
            new = with_.text(t[x:y].tobytes().decode("utf-8", "replace")).encode()
            pieces += [low[last : offs[d] + x], np.frombuffer(new, np.uint8)]
            size[d] += len(new) - (y - x)
            last = offs[d] + y
    pieces.append(low[last:])
    return np.concatenate(pieces), np.concatenate(([0], np.cumsum(size)))


def _words(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, doc = tv.runs(_LETTER[b], offs)
    return tv.Spans(b).hash(s, e), doc


# ---- model and scores ------------------------------------------------------------------------------------------


class Model:
    def __init__(self, chars: np.ndarray, words: np.ndarray, weight: np.ndarray, base: float):
        order = np.argsort(words)
        self.chars, self.words, self.weight, self.base = chars, words[order], weight[order], base


def _labelled_words(chars: np.ndarray):
    def go(batches):
        with_ = Restorer(chars)
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for at, b, offs in text_parts(batch.column(0)):
                h, doc = _words(*restored(b, offs, with_))
                nd = len(offs) - 1
                y = label[at : at + nd]
                key = tv.mix(h + doc.astype(tv.U) * tv.U(0x9E3779B97F4A7C15))
                first = np.unique(key, return_index=True)[1]
                words, back = np.unique(h[first], return_inverse=True)
                n = np.bincount(back, minlength=len(words))
                tox = np.bincount(back, weights=y[doc[first]], minlength=len(words)).astype(np.int64)
                cols = [pa.array(np.append(words.view(np.int64), 0)), pa.array(np.append(n, nd)), pa.array(np.append(tox, int(y.sum())))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.append(np.zeros(len(words), bool), True))], ["word", "n", "tox", "all"])

    return go


def fit(docs: DataFrame, labels: DataFrame, learn=lambda doc_id: F.lit(True)) -> Model:
    """Learn from all texts (characters) and from the labelled ones whose id ``learn`` allows (words)."""
    chars = character_model(docs)
    picked = sampled_labels(labels, "toxic", LABEL_ROWS, lambda i, y: learn(i))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(picked), "doc_id").select("text", "label")  # about LABEL_ROWS
    counts = map_arrow(rows, _labelled_words(chars), "word long, n long, tox long, all boolean").groupBy("word", "all")
    counts = counts.agg(F.sum("n").alias("n"), F.sum("tox").alias("tox"), F.count("*").alias("parts"))
    counts = materialize(counts, "words")
    whole = counts.where("all").select("n", "tox").first()
    if not whole or not whole.n:
        return Model(chars, np.zeros(0, np.uint64), np.zeros(0), 0.0)
    n_all, base = whole.n, (whole.tox + 1) / (whole.n + 2)
    tried = max(counts.where("not all").count(), 1)
    n, t = F.col("n").cast("double"), F.col("tox").cast("double")

    def part(k: Column, m: Column, p: Column | float) -> Column:
        return F.when(k > 0, k * F.log(k / (m * p))).otherwise(0.0)

    gain = 2 * (part(t, n, F.lit(base)) + part(n - t, n, F.lit(1 - base)))
    z = 1.96
    share = t / n
    low = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    hits = counts.where("not all").select("word", gain.alias("gain"), low.alias("low")).where((F.col("low") > base) & (F.col("gain") > 2 * math.log(tried) + 6))
    hits = hits.toArrow()  # words of about LABEL_ROWS texts that pass the test
    return Model(chars, hits.column("word").to_numpy().astype(np.int64).view(np.uint64), hits.column("low").to_numpy().astype(float), float(base))


def score(docs: DataFrame, model: Model, key: Column | None = None) -> DataFrame:
    """key, score (0 to 1), n_hits of every row of ``docs``; only its text is looked at.

    Null and empty texts get the base rate. Repeated rows get the same score; an empty table gives an empty result.
    """
    key = F.col("doc_id").cast("long") if key is None else key
    keep = np.log1p(-np.clip(model.weight, 0, 0.999))

    def go(batches):
        with_ = Restorer(model.chars)
        for batch in batches:
            for at, b, offs in text_parts(batch.column(1)):
                nd = len(offs) - 1
                h, doc = _words(*restored(b, offs, with_))
                total, hits = np.zeros(nd), np.zeros(nd, np.int64)
                if len(model.words) and len(h):
                    i = np.minimum(np.searchsorted(model.words, h), len(model.words) - 1)
                    ok = model.words[i] == h
                    pairs = np.unique(doc[ok] * len(model.words) + i[ok])  # each word counts once a text
                    d, i = pairs // len(model.words), pairs % len(model.words)
                    total, hits = np.bincount(d, weights=keep[i], minlength=nd), np.bincount(d, minlength=nd)
                s = 1 - (1 - model.base) * np.exp(total)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, nd), pa.array(np.clip(s, 0, 1)), pa.array(hits)], ["key", "score", "n_hits"])

    rows = docs.select(key.alias("key"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, go, f"key {rows.schema['key'].dataType.simpleString()}, score double, n_hits long")


def restore_texts(docs: DataFrame, chars: np.ndarray) -> DataFrame:
    """doc_id and the restored text (folded) of every row; null texts stay null."""

    def go(batches):
        with_ = Restorer(chars)
        for batch in batches:
            for at, b, offs in text_parts(batch.column(1)):
                out, ends = restored(b, offs, with_)
                raw, null = out.tobytes(), batch.column(1).slice(at, len(offs) - 1).is_null().to_pylist()
                texts = [None if z else raw[x:y].decode() for x, y, z in zip(ends[:-1].tolist(), ends[1:].tolist(), null, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(texts, pa.string())], ["doc_id", "restored"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, go, "doc_id long, restored string")
