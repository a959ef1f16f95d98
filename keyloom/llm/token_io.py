"""Token ids as files: canonical length-limited Huffman codes from global counts, in independent blocks.

The format is a folder with two Parquet tables, so that any store Spark can write will do:

* ``header``: one row; ``symbols`` (ids with a code, ascending), ``lengths`` (code length of each), ``limit``. Codes are
  canonical: ascending by (length, id).
* ``blocks``: ``part``, ``block``, ``start`` (ids before the block), ``n_tokens``, ``doc_ids`` and ``doc_tokens`` of its whole documents in
  order, ``bits`` (codes, most significant bit first), ``checkpoints`` (the bits taken by each run of ``STEP`` ids, as
  little-endian 16-bit numbers; their running sum gives the bit offset at which each run starts).

Blocks are decoded without one another, and inside a block all runs are decoded side by side: one table lookup a code.
Documents are in ascending doc_id order over ``(part, block)``.
"""

from __future__ import annotations

import json
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import discard, fresh_path, map_arrow, materialize, ship, text_parts

# The sections of a tokenizer's file that the pieces below stand for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}
ADDED = ("<|startoftext|>", "<|endoftext|>")

STEP = 64
BLOCK_TOKENS = 1 << 18
#: Code lengths, at least; vocabularies of more ids take as many bits as they need, ``MOST_BITS`` at most.
LIMIT, MOST_BITS = 16, 24
#: Distinct pieces kept with their ids by each worker; beyond it the memory is emptied and filled again.
CACHE_PIECES = 250_000

# ---- tokenizer -------------------------------------------------------------------------------------------------

# Classes of bytes: 0 white space, 1 letter, 2 digit, 3 other, 4 only for texts that go to the library whole.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = 1
_CLASS[0x61:0x7B] = 1
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[0xC3] = 1  # with the next byte, a letter of U+00C0 to U+00FF but for two signs
_CLASS[0x80:0xC0] = 1
_BYTE_CHARS = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
#: The byte-level alphabet: visible bytes stand for themselves, the others for U+0100 on.
_ALPHABET = dict(zip(_BYTE_CHARS, _BYTE_CHARS, strict=True)) | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_BYTE_CHARS))}
_loaded: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """Encodes whole texts with the tokenizers library.

    The vocabulary's pieces (letters, single digits, other signs, English contractions) don't depend on their neighbours.
    Texts of ASCII and Latin-1 letters are split into pieces here, on bytes, and each distinct piece is given to the
    library's model once; any other text goes to the library whole, and so does every text where the file's normaliser, splitter or added
    tokens are others than those that the pieces stand for.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        added = all(t["content"] in ADDED for t in told.get("added_tokens") or [])
        self.known_pieces = told.get("normalizer") == NORMALIZER and told.get("pre_tokenizer") == SPLITTER and told["model"].get("type", "BPE") == "BPE" and added
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.first, self.count, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.flat = np.zeros(1 << 18, np.uint32)

    def _learn(self, hashes: list[int], pieces: list[bytes]) -> int:
        """Remember the ids of new pieces; the number of the first."""
        i, tokenize, chars = len(self.known), self.model.tokenize, _ALPHABET
        got = [[t.id for t in tokenize(x.decode("latin-1").translate(chars))] for x in pieces]
        counts = np.array([len(x) for x in got], np.int64)
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(counts.sum()))
        while i + len(got) > len(self.first):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        if self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(flat)))
        self.first[i : i + len(got)], self.count[i : i + len(got)] = self.used + np.cumsum(counts) - counts, counts
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.known.update(zip(hashes, range(i, i + len(got)), strict=True))
        return i

    def many(self, b: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, each with the end id, and their counts."""
        import pandas as pd

        if not self.known_pieces:
            return self._whole(b, offs, end_id)
        nd = len(offs) - 1
        if len(self.known) > CACHE_PIECES:
            self.clear()
        odd = (_CLASS[b] == 4).astype(np.int8)
        if len(b) > 1:
            odd[:-1] |= (b[:-1] == 0xC3) & ((b[1:] == 0x97) | (b[1:] == 0xB7) | ~((b[1:] >= 0x80) & (b[1:] < 0xC0)))
            odd[:-1] |= (b[:-1] == 0x3C) & (b[1:] == 0x7C)
            odd[1:] |= (b[1:] >= 0x80) & (b[1:] < 0xC0) & (b[:-1] != 0xC3)
        c = np.concatenate(([0], np.cumsum(odd, dtype=np.int64)))
        whole = np.flatnonzero(c[offs[1:]] > c[offs[:-1]])
        low = tv.LOWER[b]
        if len(b) > 1:
            up = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
            low[1:][up] += 32
        s, e, doc = self._pieces(low, offs)
        h = tv.Spans(low).hash(s, e)
        code, distinct = pd.factorize(h)
        get = self.known.get
        index = [get(x) for x in distinct.tolist()]
        if None in index:
            at = np.zeros(len(distinct), np.int64)
            at[code[::-1]] = np.arange(len(code))[::-1]
            raw = low.tobytes()
            new = [j for j, x in enumerate(index) if x is None]
            where = at[new]
            first = self._learn(distinct[new].tolist(), [raw[x:y] for x, y in zip(s[where].tolist(), e[where].tolist(), strict=True)])
            for i, j in enumerate(new):
                index[j] = first + i
        of = np.array(index, np.int64)[code] if len(code) else np.zeros(0, np.int64)
        n = self.count[of]
        if len(whole):
            n[np.isin(doc, whole)] = 0
        before = np.cumsum(n) - n
        ids = self.flat[np.repeat(self.first[of] - before, n) + np.arange(int(n.sum()))]
        per = np.bincount(doc, weights=n, minlength=nd).astype(np.int64)
        ends = np.cumsum(per)
        if len(whole):
            cut = np.split(ids, ends[:-1])
            for d in whole.tolist():
                cut[d] = np.array(self.tok.encode(b[offs[d] : offs[d + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                per[d] = len(cut[d])
            ids, ends = np.concatenate(cut), np.cumsum(per)
        return np.insert(ids, ends, end_id), per + 1

    def _whole(self, b: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        raw = b.tobytes()
        got = [[*self.tok.encode(raw[x:y].decode(), add_special_tokens=False).ids, end_id] for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        n = np.array([len(x) for x in got], np.int64)
        return np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum())), n

    @staticmethod
    def _pieces(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cls = _CLASS[b]
        cls[cls == 4] = 0
        n = len(b)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z
        turn = np.ones(n + 1, bool)  # a class ends before this byte
        turn[1:-1] = cls[1:] != cls[:-1]
        turn[offs] = True
        digit = cls == 2
        s = np.flatnonzero((cls > 0) & (turn[:-1] | digit))
        e = np.flatnonzero((cls > 0) & (turn[1:] | digit)) + 1
        # 's 't 'm 'd 're 've 'll: a single quote before a letter takes the letters with it
        q = np.flatnonzero((e - s == 1) & (b[s] == 39))
        q = q[q + 1 < len(s)]
        q = q[(s[q + 1] == e[q]) & (cls[s[np.minimum(q + 1, len(s) - 1)]] == 1) & ~turn_at_text(offs, s[q] + 1)] if len(q) else q
        if len(q):
            p, room = s[q], e[q + 1] - s[q + 1]
            x, y = b[p + 1], b[np.minimum(p + 2, n - 1)]
            one = np.isin(x, [115, 116, 109, 100])
            two = (room > 1) & (((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108)))
            take = one * 1 + two * 2
            e[q] += take
            s[q + 1] += take
            ok = s < e
            s, e = s[ok], e[ok]
        return s, e, np.searchsorted(offs[1:], s, side="right")


def turn_at_text(offs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a text begins at these bytes."""
    i = np.searchsorted(offs, at)
    return offs[np.minimum(i, len(offs) - 1)] == at


def encoder(path: str) -> PieceEncoder:
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


def encode_rows(path: str, end_id: int):
    """For mapInArrow over sorted (doc_id, text): part, doc_id, ids before it in its part, n_tokens, ids."""

    def go(batches):
        from pyspark import TaskContext

        enc, part, start = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, b, offs in text_parts(batch.column(1)):
                ids, n = enc.many(b, offs, end_id)
                wide = len(ids) and ids.max() > 65535
                raw = pa.py_buffer(ids.astype("<u4" if wide else "<u2"))
                ends = np.concatenate(([0], np.cumsum(n))) * (4 if wide else 2)
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), raw]).cast(pa.binary())
                first = start + np.cumsum(n) - n
                start += int(n.sum())
                cols = [pa.array(np.full(len(n), part, np.int32)), batch.column(0).slice(at, len(n)), pa.array(first), pa.array(n), blobs]
                yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "first", "n_tokens", "ids"])
        enc.clear()

    return go


def _ids(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4")


# ---- codes -----------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts, by package-merge."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes of more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    levels = []
    row, is_leaf = leaves, np.ones(n, bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaves, pairs))
        at = np.argsort(both, kind="stable")
        row, is_leaf = both[at], at < n
    levels.append(is_leaf)
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        chosen = is_leaf[:take]
        depth[: int(chosen.sum())] += 1
        take = 2 * int((~chosen).sum())
    out = np.zeros(n, np.int64)
    out[order] = depth
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes ascending by (length, symbol)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    code, last, out = 0, 0, np.zeros(len(lengths), np.int64)
    for i in order.tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        out[i] = code
        code += 1
    return out


def pack(ids: np.ndarray, code_of: np.ndarray, length_of: np.ndarray) -> tuple[bytes, bytes]:
    """Bits and checkpoints of a run of ids."""
    ln = length_of[ids].astype(np.int64)
    end = np.cumsum(ln)
    pos = end - ln
    total = int(end[-1]) if len(end) else 0
    unit, off = pos >> 4, pos & 15
    v = code_of[ids] << (48 - off - ln)  # a code of MOST_BITS lies in three units of 16 bits at most
    size = (total >> 4) + 3
    bits = sum(np.bincount(unit + k, (v >> (32 - 16 * k)) & 0xFFFF, size + k)[:size] for k in range(3))
    marks = np.append(end[STEP - 1 :: STEP], end[-1:] if len(end) % STEP else [])
    return bits.astype(">u2").tobytes(), np.diff(marks, prepend=0).astype("<u2").tobytes()


def unpack(blocks: list[tuple[bytes, bytes, int]], symbol_at: np.ndarray, length_at: np.ndarray, limit: int) -> list[np.ndarray]:
    """The ids of (bits, checkpoints, n_tokens) blocks, all their runs side by side."""
    base, starts, sizes, data = 0, [], [], []
    for bits, marks, n in blocks:
        m = np.frombuffer(marks, "<u2").astype(np.int64)
        starts.append(base * 8 + np.cumsum(m) - m)
        s = np.full(len(m), STEP, np.int64)
        if len(m):
            s[-1] = n - STEP * (len(m) - 1)
        sizes.append(s)
        data.append(bits)
        base += len(bits)
    raw = np.frombuffer(b"".join(data) + b"\0" * 8, np.uint8).astype(np.uint32)
    view = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]  # 32 bits from each byte on
    pos, size = np.concatenate(starts), np.concatenate(sizes)
    out = np.zeros((len(pos), STEP), np.uint32)
    mask, short = np.uint32((1 << limit) - 1), np.flatnonzero(size < STEP)
    for i in range(STEP):
        look = (view[pos >> 3] >> (32 - limit - (pos & 7)).astype(np.uint32)) & mask
        out[:, i] = symbol_at[look]
        pos += length_at[look]
        if len(short):
            done = short[size[short] <= i + 1]
            pos[done] = 0
    res, at = [], 0
    for (_, _, n), s in zip(blocks, sizes, strict=True):
        res.append(out[at : at + len(s)].ravel()[:n])
        at += len(s)
    return res


def tables(symbols: np.ndarray, lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    codes = canonical(lengths)
    order = np.argsort(codes << (limit - lengths), kind="stable")
    repeat = (1 << (limit - lengths))[order]
    sym, ln = np.repeat(symbols[order], repeat), np.repeat(lengths[order], repeat)
    rest = (1 << limit) - len(sym)
    return np.concatenate((sym, np.zeros(rest, sym.dtype))).astype(np.uint32), np.concatenate((ln, np.ones(rest, ln.dtype))).astype(np.int64)


# ---- files -----------------------------------------------------------------------------------------------------


def _count(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        both = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for kind, width in (("<u2", 2), ("<u4", 4)):
            c = np.bincount(np.frombuffer(b"".join([x for x, n in both if len(x) == width * n]), kind))
            if len(c) > len(total):
                total = np.concatenate((total, np.zeros(len(c) - len(total), np.int64)))
            total[: len(c)] += c
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])


def _blocks(code_of: np.ndarray, length_of: np.ndarray, offsets: np.ndarray):
    def go(batches):
        from pyspark import TaskContext

        split, number, run, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            ids = np.concatenate([_ids(r[3], r[2]) for r in run])
            bits, marks = pack(ids.astype(np.int64), code_of, length_of)
            part, first = run[0][4], run[0][1]
            vals = [part, (split << 32) + number, int(offsets[part]) + first, len(ids), [r[0] for r in run], [r[2] for r in run], bits, marks]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            names = ["part", "block", "start", "n_tokens", "doc_ids", "doc_tokens", "bits", "checkpoints"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(vals, kinds, strict=True)], names)

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for part, doc, first, n, blob in zip(*cols, strict=True):
                if run and (run[0][4] != part or run[-1][1] + run[-1][2] != first or size + n > BLOCK_TOKENS):
                    yield flush()
                    number, run, size = number + 1, [], 0
                run.append((doc, first, n, blob, part))
                size += n
        if run:
            yield flush()

    return go


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, limit: int = LIMIT) -> None:
    """Tokenise ``docs`` (doc_id, text) and write the ids of every whole text to ``path``, in ascending doc_id order.

    A null or empty text has the end id alone. Null ids come first; repeated ids stay next to one another, in order of
    their text's hash. Other columns are ignored. An empty table makes empty tables.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # the text's hash parts rows of one id (or of none), however many they are
    ranged = rows.withColumn("order", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "order").sortWithinPartitions("doc_id", "order").drop("order")
    made = map_arrow(ranged, encode_rows(tokenizer, end_id), "part int, doc_id long, first long, n_tokens long, ids binary")
    made = materialize(made, "ids")
    sums = made.groupBy("part").agg(F.sum("n_tokens").alias("n")).toArrow()  # a row for each partition
    of = dict(zip(sums.column("part").to_pylist(), sums.column("n").to_pylist(), strict=True))
    offsets = np.concatenate(([0], np.cumsum([of.get(p, 0) for p in range(max(of, default=0) + 1)]))).astype(np.int64)
    counts = map_arrow(made.select("ids", "n_tokens"), _count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toArrow()  # a row an id
    symbols, n = counts.column("id").to_numpy().astype(np.int64), counts.column("n").to_numpy()
    limit = min(max(limit, (max(len(n), 1) - 1).bit_length()), MOST_BITS)
    lengths = code_lengths(n, limit) if len(n) else np.zeros(0, np.int64)
    code_of, length_of = np.zeros(int(symbols.max(initial=0)) + 1, np.int64), np.zeros(int(symbols.max(initial=0)) + 1, np.int64)
    code_of[symbols], length_of[symbols] = canonical(lengths), lengths
    head = spark.createDataFrame([(symbols.tolist(), lengths.tolist(), limit)], "symbols array<int>, lengths array<int>, limit int")
    head.coalesce(1).write.parquet(f"{path}/header")
    kinds = "part int, block long, start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, bits binary, checkpoints binary"
    source = made.select("part", "doc_id", "first", "n_tokens", "ids").selectExpr("part", "doc_id", "first", "n_tokens", "ids")
    map_arrow(source, _blocks(code_of, length_of, offsets), kinds).write.option("compression", "none").parquet(f"{path}/blocks")
    discard(spark, made)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (with ``ids``) the ids themselves of each document in the files at ``path``."""
    ship(spark)
    head = spark.read.parquet(f"{path}/header").first()
    symbols, lengths, limit = np.array(head[0], np.int64), np.array(head[1], np.int64), head[2]
    symbol_at, length_at = tables(symbols, lengths, limit)

    def go(batches):
        for batch in batches:
            step = 8
            for a in range(0, len(batch), step):
                sub = batch.slice(a, step)
                start, n, doc, size, bits, marks = (sub.column(i).to_pylist() for i in range(6))
                got = unpack(list(zip(bits, marks, n, strict=True)), symbol_at, length_at, limit)
                docs, starts, crc, lists = [], [], [], []
                for x, s, d, z in zip(got, start, doc, size, strict=True):
                    raw = x.astype("<u4").tobytes()
                    at = 0
                    for i, m in zip(d, z, strict=True):
                        docs.append(i)
                        starts.append(s + at)
                        crc.append(zlib.crc32(raw[4 * at : 4 * (at + m)]))
                        if ids:
                            lists.append(x[at : at + m].tolist())
                        at += m
                cols = [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array([m for z in size for m in z], pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    cols.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    blocks = spark.read.parquet(f"{path}/blocks").select("start", "n_tokens", "doc_ids", "doc_tokens", "bits", "checkpoints")
    return map_arrow(blocks, go, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the ids to a fresh folder and read them back as doc_id, start, n_tokens, ids_crc32."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path, ids=False)
