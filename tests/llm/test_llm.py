"""The training-data operators against brute force, and on nulls, empty and long texts, repeats and empty tables."""

import collections
import hashlib
import html
import itertools
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.llm import common, decontaminate, html_extract, langid, licenses, line_dedup, mixing, quality, queries, superminhash, token_io, toxicity
from keyloom.llm import textvec as tv
from keyloom.llm.common import text_parts
from keyloom.llm.components import components
from keyloom.llm.queries import tokenizer_path

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (None, "no id at all, but ten words or more are in this text"), (900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "same text twice"), (904, "same text twice"),
    (905, "x " * 30000), (906, "é" * 50 + " ÀÉ ß 12 it's <|x|> 日本"),
]


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(i, t, None, None) for i, t in ODD], base.schema)
    # names that clash with the operators' own columns
    return base.unionByName(odd).withColumns({c: F.lit("extra") for c in ("key", "score", "mix", "row", "rate", "h", "rank", "label", "kept", "size")}).cache()


@pytest.fixture(scope="module")
def labels(spark):
    base = spark.read.parquet(f"{DIR}/labels.parquet")
    return base.unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None), (1, 1, 0), (1, 1, 0)], base.schema))


def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_words_and_windows():
    texts = ["a b  c", "", "Ä x\ny", None, "z"]
    (at, b, offs), *rest = text_parts(pa.array(texts))
    s, e, d = tv.runs(~tv.WS[b], offs)
    assert not rest and [bytes(b[i:j]).decode() for i, j in zip(s, e, strict=True)] == ["a", "b", "c", "Ä", "x", "y", "z"]
    assert d.tolist() == [0, 0, 0, 2, 2, 2, 4]
    assert [x[0] for x in text_parts(pa.array(["aaaa", "bb", "c"]), most=3)] == [0, 1]


def test_superminhash_is_the_sequential_one():
    m, rng = 16, np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 3, 20, 200)]
    h, seg = np.concatenate(sets), np.repeat(np.arange(4), [len(s) for s in sets])
    got = superminhash.signatures(h, seg, 4, m)
    for i, s in enumerate(sets):
        want = [None] * m
        for x in s:
            p = list(range(m))
            for j in range(m):
                r = int(tv.mix(np.array([x + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)]))[0])
                k = j + ((r & 0xFFFFFFFF) * (m - j) >> 32)
                p[j], p[k] = p[k], p[j]
                v = (j << 32) | (r >> 32)
                want[p[j]] = v if want[p[j]] is None else min(want[p[j]], v)
        assert got[i].tolist() == want


def test_near_duplicates(spark, docs):
    rows = plain(docs)
    group = [(2000 + i, " ".join(f"w{j}" if j not in (3 * i, 3 * i + 40) else f"edit{i}" for j in range(120))) for i in range(14)]  # all near one another's middle
    rows += [(1999, " ".join(f"w{j}" for j in range(120))), *group]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in superminhash.near_duplicates(df, 3, 85).collect() if r.doc_id is not None}
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        if i is not None:
            sets[i] = set(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {i: (len(s), find(i), find(i) == i) for i, s in sets.items()} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}
    kept = superminhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 904").count() == 1 and kept.where("doc_id is null").count() == 1
    assert superminhash.near_duplicates(df.limit(0), 3, 85).count() == 0


def test_rows_go_by_id_and_text(spark):
    """Several texts under one id, repeated rows, null ids and texts, clashing columns: only copies go."""
    long = " ".join(f"w{j}" for j in range(60))
    near = long.replace("w30", "other")
    rows = [(1, long), (5, near), (5, "a text that nobody else has, of some words"), (5, None), (5, None), (5, ""), (6, long), (6, near), (7, near), (None, long), (None, long), (1, near), (1, long), (8, "q r"), (8, "q r")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("_id", "_mark", "row", "comp", "mark", "kept", "cls")})
    kept = superminhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    first = min((long, near), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert got == sorted([(1, first), (5, "a text that nobody else has, of some words"), (5, None), (5, ""), (None, long), (None, long), (8, "q r")], key=str)
    bench = spark.createDataFrame([(1, long)], "item_id long, text string")
    clean = decontaminate.clean(df, bench)
    assert clean.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted([r for r in rows if r[1] not in (long, near)], key=str)


def test_near_duplicates_of_one_template(spark):
    """A large group around one text, with copies beyond the threshold, shortened ones and ones that share edits."""
    rng = np.random.default_rng(5)
    base = [f"w{j}" for j in range(150)]
    rows = []
    for i in range(260):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(0, 9)), replace=False):
            words[at] = f"e{rng.integers(0, 40)}x{at // 10}"
        if i % 3 == 0:
            words = words[: int(rng.integers(125, 150))]
        rows.append((i, " ".join(words)))
        if i % 20 == 0:  # a chain that leads away from the text
            for step in range(1, 5):
                words = list(words)
                words[7 * step] = f"c{i}s{step}"
                words[7 * step + 60] = f"d{i}s{step}"
                rows.append((1000 + 10 * i + step, " ".join(words)))
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {i: find(i) for i in sets}
    assert len(set(want.values())) > 10
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in superminhash.near_duplicates(df, 3, 85).collect()} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (500, 500)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 500: 500}


def test_quality(docs, labels):
    got = sorted(map(tuple, quality.score(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    want = []
    for i, t in plain(docs):
        t = t or ""
        w = WORD.findall(t)
        win = list(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False))
        n = collections.Counter(win)
        rep = {j for k, x in enumerate(win) if n[x] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        bad = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(rep), bad))
    assert got == sorted(want, key=str)
    kept = quality.keep(docs, labels)
    verdict = collections.Counter(r.doc_id for r in quality.score(docs, labels).where("kept").collect())
    assert collections.Counter(r.doc_id for r in kept.select("doc_id").collect()) == verdict and kept.columns == docs.columns
    assert quality.score(docs.limit(0), labels).count() == 0 and quality.score(docs, labels.limit(0)).count() == docs.count()


def test_mixing(docs, monkeypatch):
    got = mixing.taken(docs).join(docs.select("doc_id", "source").distinct(), "doc_id", "left").collect()
    size = {r.source: r.source_size for r in got}
    order = sorted((s for s in size if s is not None)) + [None]
    total, weight, target, open_ = sum(size.values()), {s: k % 3 + 1 for k, s in enumerate(order)}, {}, set(order)
    while True:
        rest = total - sum(target.values())
        over = [s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            open_.discard(s)
    share = (total - sum(target.values())) / sum(weight[x] for x in open_)
    target |= {s: share * weight[s] for s in open_}
    assert all(r.target == pytest.approx(target[r.source]) and r.copies <= 3 for r in got)
    assert len({r.copies for r in got if r.doc_id == 904}) == 1
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    copies = collections.Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert copies == collections.Counter({i: sum(r.copies for r in got if r.doc_id == i) for i in {r.doc_id for r in got}})
    assert mixing.taken(docs.limit(0)).count() == 0
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    for hot in (1, 1000):
        monkeypatch.setattr(common, "HOT", hot)
        assert collections.Counter(r.doc_id for r in mixing.mixed(docs).select("doc_id").collect()) == copies


def test_mixing_comes_near_its_targets(spark):
    """Also where a source has few texts, one of them long."""
    d = "/root/testdata/sf0.01"
    got = queries.op8_mixing(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source"), "doc_id")
    by = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest")).collect()
    assert len(by) > 5 and all(abs(r.taken - r.target) <= max(0.1 * r.target, r.largest) for r in by)
    assert sum(abs(r.taken - r.target) for r in by) < 0.02 * sum(r.target for r in by)
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.choice([1, 10, 10_000], p=[0.5, 0.45, 0.05])), f"s{i % 7}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest")).collect()
    assert all(abs(r.taken - r.target) <= r.largest for r in got)


def test_tokens(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rows = [r for r in plain(docs) if r[0] != 904]
    path = f"file://{tmp_path}/tokens"
    token_io.write_tokens(docs.where("doc_id is null or doc_id != 904"), path, tokenizer_path())
    got = token_io.read_tokens(spark, path).orderBy("start").collect()
    start = 0
    for (i, t), r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0])), got, strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids, r.ids_crc32) == (i, start, len(ids), ids, zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert token_io.round_trip(docs.limit(0), tokenizer_path()).count() == 0


def test_huffman():
    rng = np.random.default_rng(3)
    counts = np.unique(rng.zipf(1.2, 4000) % 5000, return_counts=True)[1]
    for limit in (10, 12, 16):
        if len(counts) > 1 << limit:
            continue
        n = token_io.code_lengths(counts, limit)
        assert n.max() <= limit and (2.0**-n).sum() == 1
    assert token_io.code_lengths(np.array([5, 1, 1, 1]), 16).tolist() == [1, 3, 3, 2] or (token_io.code_lengths(np.array([5, 1, 1, 1]), 16) * [5, 1, 1, 1]).sum() == 13
    with pytest.raises(ValueError):
        token_io.code_lengths(np.ones(9), 3)


def test_codes_of_large_vocabularies():
    rng = np.random.default_rng(6)
    n, limit = 70_000, 17
    lengths = token_io.code_lengths(rng.integers(1, 1000, n), limit)
    codes, (symbol_at, length_at) = token_io.canonical(lengths), token_io.tables(np.arange(n), lengths, limit)
    runs = [rng.integers(0, n, k) for k in (1, 63, 64, 65, 5000)]
    packed = [(*token_io.pack(r, codes, lengths), len(r)) for r in runs]
    assert all((a == b).all() for a, b in zip(runs, token_io.unpack(packed, symbol_at, length_at, limit), strict=True))


def test_other_tokenizers_go_whole(spark, tmp_path):
    """A file whose splitter is another one, ids beyond those with codes of 16 bits, repeated ids."""
    import json

    from tokenizers import Tokenizer

    told = json.load(open(tokenizer_path()))
    told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"
    path = str(tmp_path / "other.json")
    json.dump(told, open(path, "w"))
    tok = Tokenizer.from_file(path)
    rows = [(1, "abc123 it's"), (2, ""), (3, None), (3, "x 12"), (3, "y 7z"), (None, "a b")]
    got = token_io.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    crc = lambda t: zlib.crc32(b"".join(struct.pack("<I", x) for x in [*tok.encode(t or "", add_special_tokens=False).ids, 1]))
    assert sorted(((r.doc_id, r.ids_crc32) for r in got), key=str) == sorted(((i, crc(t)) for i, t in rows), key=str)
    assert tok.encode("abc123").ids != Tokenizer.from_file(tokenizer_path()).encode("abc123").ids


def test_pieces_are_the_tokenizers():
    enc = token_io.PieceEncoder(tokenizer_path())
    odd = ["it's we're I'LL they've x'd 'start ''s !'s 'tis don't'", "naïve ÉCOLE Straße × 5÷2 ½", "İ ŉ", "a\x1cb\x85c", "<|endoftext|> a", "", " ", "é", "'", "12 3.14", "a\x0bb\x0cc", "’s"]
    for _, b, offs in text_parts(pa.array(odd)):
        ids, n = enc.many(b, offs, 1)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [enc.tok.encode(t, add_special_tokens=False).ids + [1] for t in odd]


def later_copies(rows, min_words):
    """Lines in maximal runs that an earlier place has too, from all pairs of places."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    texts = [(t or "").split("\n") for _, t in rows]
    words = [[len(WORD.findall(x)) for x in ls] for ls in texts]
    where, gone = collections.defaultdict(list), [set() for _ in texts]
    for d, ls in enumerate(texts):
        for j, x in enumerate(ls):
            for e, k in where[x]:
                if j and k and ls[j - 1] == texts[e][k - 1]:
                    continue  # not where the run begins
                n = 0
                while j + n < len(ls) and k + n < len(texts[e]) and ls[j + n] == texts[e][k + n]:
                    n += 1
                if sum(words[d][j : j + n]) >= min_words:
                    gone[d] |= set(range(j, j + n))
            where[x].append((d, j))
    return [(i, ls, g) for (i, _), ls, g in zip(rows, texts, gone, strict=True)]


def test_lines(spark, docs):
    short = "\n".join(f"item {i % 7}" for i in range(40))
    menu = "\n".join(["home", "news", "about us", "all products", "contact", "help", "terms", "privacy", "sign in", "careers", "press", "site map"])  # 16 words
    more = [(2000, short), (2001, "head of it\n" + short + "\nfoot"), (2002, "\n" * 14 + "\n".join("abcdefghij")), (2003, "q\n" + "\n".join("abcdefghi")), (2004, "z\n" + "\n".join("abcdefghij") + "\n" * 9)]
    more += [(3000 + i, f"top {i}\n{menu}\nend {i}") for i in range(3)] + [(4000, "u v\n" * 30 + "w"), (4001, "ten words are in this line of text, so it's\nx\ny"), (4002, "ten words are in this line of text, so it's\nx\ny\nz")]
    some = docs.where("doc_id is null or doc_id != 904").select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    brute = later_copies([(r.doc_id, r.text) for r in some.collect()], line_dedup.MIN_WORDS)
    gone = {i: len(g) for i, _, g in brute}
    # overlapping runs of one text, a whole copy, too few words, empty lines, a menu of short lines in three texts, short lines that end a run
    assert gone[2000] > 30 and gone[2001] == 40 and gone[2003] == 0 and gone[2004] == 10 and [gone[i] for i in (3000, 3001, 3002)] == [0, 12, 12] and gone[4000] == 29 and gone[4002] == 3
    want = {i: (len(ls), len(g), sum(len(x) for j, x in enumerate(ls) if j not in g)) for i, ls, g in brute}
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_chars) for r in line_dedup.digest(some).collect()} == want
    assert {r.doc_id: r.text for r in line_dedup.deduplicated(some).collect()} == {i: "\n".join(x for j, x in enumerate(ls) if j not in g) for i, ls, g in brute}
    runs = collections.defaultdict(set)
    for r in line_dedup.later_runs(some).collect():
        assert not runs[r.doc_id] & set(range(r.first_line - 1, r.first_line + r.n_lines + 1)) and r.n_words >= line_dedup.MIN_WORDS
        runs[r.doc_id] |= set(range(r.first_line, r.first_line + r.n_lines))
    assert {i: s for i, s in runs.items() if s} == {i: g for i, _, g in brute if g}
    assert line_dedup.digest(docs.limit(0)).count() == 0 and line_dedup.later_runs(docs.limit(0)).count() == 0


def test_lines_of_repeated_rows_and_hot_lines(spark, monkeypatch):
    """Rows of one id and text, ties, clashing columns, and joins in which every key is hot or none is."""
    text = "one two three four five\nsix seven eight nine ten\nrest"
    rows = [(1, text), (1, text), (None, text), (2, "rest\n" + text), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("uid", "line", "h", "n", "rank", "gone", "size", "head", "tail", "on")})
    want = [(1, 3, 0), (1, 3, 3), (2, 4, 3), (3, 1, 0), (4, 1, 0), (None, 3, 3)]
    for hot in (1, 1000):
        monkeypatch.setattr(common, "HOT", hot)
        assert sorted(((r.doc_id, r.n_lines, r.n_removed) for r in line_dedup.digest(df).collect()), key=str) == sorted(want, key=str)


def test_suffix_array(spark):
    texts = ["a\nb\na\nb\na", "b\na\nb", "q\na\nb\nz", "c\nc\nc\nc"]
    got = line_dedup.suffix_array(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    lines = {i: t.split("\n") for i, t in enumerate(texts)}
    once = {x for x, n in collections.Counter(x for ls in lines.values() for x in ls).items() if n == 1}
    rank = {(r.doc_id, r.line): r.rank for r in got}
    assert set(rank) == {(i, j) for i, ls in lines.items() for j, x in enumerate(ls) if x not in once}
    suffix = lambda p: tuple(lines[p[0]][p[1] :])
    for p in rank:
        for q in rank:
            assert (rank[p] == rank[q]) == (suffix(p) == suffix(q))
            if suffix(p) != suffix(q) and suffix(q)[: len(suffix(p))] == suffix(p):
                assert rank[p] < rank[q]  # a prefix comes first


def test_licenses(docs):
    assert len(licenses.rules()) > 300 and len({r.name for r in licenses.rules()}) == len(licenses.rules())
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in licenses.scan(docs).collect():
        t = next(t for i, t in plain(docs) if i == r.doc_id) if r.doc_id != 904 else "same text twice"
        w = word.findall(lower(t))
        at = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("Released under the MIT License.", "mit"), ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0"),
        ("licensed under the GNU Lesser General Public License, version 2.1", "gpl,lgpl-2.1"), ("see https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa-4.0"), ("dual BSD 3-clause license", "bsd-3-clause"),
        ("we go mit der Zeit, public domain names", ""),
    ],
)
def test_license_rules(spark, text, labels):
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == labels


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated files"
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee"


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        (MIT, "mit"), (BSD, "bsd"), (ISC, "isc"), ("# " + BSD.replace("\n", "\r\n#   "), "bsd"), ("/* " + ISC.replace("\n", " *\n * ") + " */", "isc"), (MIT.replace(" ", "  ").replace("\n", "\n//\t"), "mit"),
        ("Licensed under the Apache License", "apache"), ("distributed under the MPL", "mpl"), ("the Eclipse\n-- Public License", "epl"), ("GNU Affero General Public License", "agpl,gpl"),
        ("Licensed under the GNU Lesser General Public License", "gpl,lgpl"), ("licensed under the GNU Lesser General Public License v3", "gpl,lgpl-3.0"), ("AGPL-licensed", "agpl"),
        ("see apache.org/licenses/LICENSE-2.0 for it", "apache-2.0"), ("gnu.org/licenses/gpl.html", "gpl"), ("http://otm.illinois.edu/uiuc_openSource", "ncsa"),
        ("provided by the Apache Software Foundation, with some artistic license", ""),
    ],
)
def test_licenses_wrapped_unversioned_and_bare(spark, text, labels):
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == labels


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("SPDX-License-Identifier: BSL-1.0", "boost-1.0"), ("SPDX-License-Identifier: BUSL-1.1", "busl-1.1"), ("// SPDX-License-Identifier: (MIT OR Apache-2.0)", "apache-2.0,mit"),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "gpl-2.0"), ("SPDX-License-Identifier: MulanPSL-2.0", "mulan-2.0"), ("SPDX-License-Identifier: PSF-2.0", "python-2.0"),
        ("SPDX-License-Identifier: CC-BY-SA-4.0 AND CC0-1.0", "cc-by,cc-by-sa-4.0,cc0-1.0"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"), ("spdx-license-identifier: mitten", ""),
        ("gnu general\npublic license", "gpl"), ("under the Apache License,\n version 2.0", "apache-2.0"), ("Tous droits réservés, alle Rechte vorbehalten", "reserved"),
        ("This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.", "gpl,gpl-3.0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl,mpl-2.0"),
    ],
)
def test_license_identifiers_and_sentences(spark, text, labels):
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels
    assert set(labels.split(",")) <= set(got.split(",")) and (labels or not got), got
    assert "spdx" not in text.lower() or got == labels


def test_suppression_is_the_plain_one():
    """Against a test of each detection with each winner; and in time for many."""
    rng = np.random.default_rng(4)
    names = ["ab", "abc", "bc", "b c", "c", "a", "abcab", "ca(?P<at>b)"]
    some = [licenses.Rule(f"r{i}", f"l{i}", int(rng.integers(0, 3)), 0.5, (), n) for i, n in enumerate(names)]
    some = [(r, re.compile(r.pattern)) for r in some]
    for _ in range(200):
        text = "".join(rng.choice(list("abc x"), 40)).strip()
        short = licenses.folded(text)[0]
        found = [(r.priority, m.start(g) - m.end(g), m.start(g), m.end(g), r) for r, p in some for g in ["at" if "at" in p.groupindex else 0] for m in p.finditer(short)]
        kept = []
        for _, _, a, b, r in sorted(found, key=lambda x: (*x[:3], x[4].name)):
            if not any(x <= a and b <= y for x, y, _ in kept):
                kept.append((a, b, r))
        if short == text:
            assert licenses.detect(text, some) == sorted(kept, key=lambda x: x[:2])
    began = time.perf_counter()
    assert len(licenses.detect("mit license x " * 30000, [(r, re.compile(r.pattern)) for r in licenses.rules() if r.label == "mit"])) == 30000
    assert time.perf_counter() - began < 10


def test_places_of_licenses_are_the_texts(spark):
    text = "İx\n\n# first  line\n#\n#  Licensed under\n# the  Apache\n#\tLicense, Version\n# 2.0, and\n  more"
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(lower(text)[d.start : d.end], d.label) for d in r.detections] == [("licensed under\n# the  apache\n#\tlicense, version\n# 2.0", "apache-2.0")]
    for t in ("", " ", "\n", "  \n" * 5000, " " * 50000, "# " * 20000, "a *" * 20000, " *" * 20000):
        short, here, there = licenses.folded(t)
        assert len(here) == len(there) and not re.search(r"\s\s", short)


def test_decontamination(spark, docs):
    bench = spark.createDataFrame(
        [(1, "Say Alice has 12 apples and gives 5 kg of them to Bob, so how many apples does Alice keep today?"), (2, None), (3, "short one"), (None, "nothing"), (4, "What is the capital of the country of France in the year 1999 after all?")],
        "item_id long, text string",
    )
    texts = [
        (1, "intro text here. Say Alice has 12 apples and gives 5 kg of them to Bob, so how many apples does Alice keep today? end"),
        (2, "Well. Say Carol has 77 apples and gives 8 kg of them to Dave, so how many apples does Carol keep today?"),
        (3, "Well. Say Carol has 77 apples and gives 8 kg of them to Dave, so how many apples does Erin keep today?"),
        (4, "nothing of the kind, in the year 1999 after all"), (5, None), (6, ""), (None, "Alice has 12 apples and gives 5 kg of them to Bob"),
    ]
    got = decontaminate.find(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.kind) for r in got) == [(1, 1, "verbatim"), (2, 1, "reparameterised")]
    real = spark.read.parquet(f"{DIR}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in real.collect()]
    want = {(i, j) for i, t in plain(docs) for j, x in items if i is not None and t and x in t}
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(docs, real).collect()} == want
    kept = decontaminate.clean(docs, real)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({i for i, _ in want})
    assert decontaminate.find(docs, real.limit(0)).count() == 0 and decontaminate.find(docs.limit(0), real).count() == 0


def test_decontamination_of_other_lengths(spark):
    items = [
        (1, "Alice has 12 apples and 3 pears. Bob gives Alice 5 more apples on the next day. Alice eats 2 of her apples with Bob. How many apples does Alice have now?"),
        (2, "A shop in Paris lowers the price of its oldest bicycle from 950 euros to 400 euros and then sells it, so what part of the price is gone?"),
        (3, "The runner carries a bag of 5kg for three miles along the 3rd road and then rests for a while near the old stone bridge."),
    ]
    texts = [
        (1, "Carol has 1,250 apples and 7 pears. Dave Miller gives Carol 15 more apples on the next day. Carol eats 2.5 of her apples with Dave Miller. How many apples does Carol have now?"),
        (2, "A shop in New York lowers the price of its oldest bicycle from 1,250 euros to 399.50 euros and then sells it, so what part of the price is gone?"),
        (3, "The runner carries a bag of 12.5 lb for twenty-two miles along the 21st road and then rests for a while near the old stone bridge."),
        (4, "Carol has 1,250 apples and 7 pears. Dave gives Erin 15 more apples on the next day. Frank eats 2 of her apples with Alice. How many apples does Bob have now?"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.kind, r.coverage, r.first_word) for r in got) == [(i, i, "reparameterised", 1.0, 0) for i in (1, 2, 3)]


def test_decontamination_of_few_plain_words(spark):
    items = [
        (1, "Compute 12 + 45 - 33 + 8 * 9 / 4 + 16 - 7"), (2, "Alice Bob Carol Dave Erin Frank"), (3, "Who wrote it first?"), (4, "3 1 4 1 5 9 2 6 5 3 5 8 9 7 9"),
        (5, "Paris 7 Rome 8 Oslo 9 Bern 4 Kyiv 5 Riga 2 then all of these towns are put in order"), (6, "..."),
    ]
    texts = [
        (1, "now Compute 12 + 45 - 33 + 8 * 9 / 4 + 16 - 7 at once"), (2, "Names Alice Bob Carol Dave Erin Frank"), (3, "well, who wrote it first, then?"), (4, "so 3 1 4 1 5 9 2 6 5 3 5 8 9 7 9"),
        (5, "Paris 7 Rome 8 Oslo 9 Bern 4 Kyiv 5 Riga 2 then all"), (6, "Compute 13 + 46 - 34 + 7 * 8 / 5 + 17 - 6, who wrote it"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()
    # of item 5 half the windows are found, though they have at most two plain words
    assert sorted((r.doc_id, r.item_id, r.kind, r.first_word) for r in got) == [(1, 1, "verbatim", 1), (2, 2, "verbatim", 1), (3, 3, "verbatim", 1), (4, 4, "verbatim", 1), (5, 5, "verbatim", 0)]


def test_decontamination_over_alignments(spark):
    """A word more in the middle makes two alignments: their windows add up, unless their fillers contradict one another."""
    first, second = "Say Alice has a basket of 12 ripe green apples and walks to the town market", "there Alice sells all but 5 of them to people who pass by on that day"
    bench = spark.createDataFrame([(1, f"{first} and {second}")], "item_id long, text string")
    own = lambda t, n: t.replace("Alice", n).replace("12", "40").replace("5", "9")
    texts = [(1, f"{own(first, 'Carol')} early then and {own(second, 'Carol')}"), (2, f"{own(first, 'Carol')} early then and {own(second, 'Erin')}")]
    got = {r.doc_id: r for r in decontaminate.find(spark.createDataFrame(texts, "doc_id long, text string"), bench, 0.3).collect()}
    assert got[1].kind == got[2].kind == "reparameterised" and got[1].n_windows > got[2].n_windows >= 6


def test_decontamination_of_copies_with_one_filler_changed(spark):
    item = "We know that Alice has a house near the lake with a garden full of old apple trees and two dogs that sleep in it all day, while at night the dogs run to the hill where Alice keeps 12 sheep and 12 goats"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [(1, item.replace("Alice keeps", "Carol keeps")), (2, item.replace("12 goats", "15 goats")), (3, item.replace("Alice keeps 12", "Carol keeps 15").replace("that Alice", "that Erin"))]
    got = decontaminate.find(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.kind) for r in got) == [(1, "verbatim"), (2, "verbatim"), (3, "verbatim")]


def test_pages(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    src = {r.page_id: r.html for r in pages.collect()}
    got = html_extract.extract(pages).collect()
    for r in got:
        part = re.search(r"<article>(.*?)(?:</article>|$)", src[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split(r"<(?:/?(?:p|h1)|br)\b[^>]*>", part)]
        assert (r.text, r.n_chars) == (t := "\n".join(x for x in blocks if x), len(t))
    w = html_extract.fit(pages)
    page = """<body><header>Site name</header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div>
      <div id=content><h1>Title &amp; more</h1><p>First   <b>bold</b>&nbsp;text here.<p>Second one, with words.</div>
      <aside>Side words</aside><form><label>Name</label><input></form><section class='comments'><p>I do not agree</p></section><footer>(c) me</footer>"""
    assert html_extract.extract_text(page, w) == "Title & more\nFirst bold text here.\nSecond one, with words."
    for bad in (None, "", "<", "<p", "plain words", "<p>a<script>x", "</p></div>"):
        assert isinstance(html_extract.extract_text(bad, w), str)
    odd = spark.createDataFrame([(None, None, None), (1, "u", "<p>hi there</p>"), (1, "u", "<p>hi there</p>")], "page_id long, url string, html string")
    assert [r.text for r in html_extract.extract(odd, w).orderBy("page_id").collect()] == ["", "hi there", "hi there"]
    assert html_extract.extract(odd.limit(0)).count() == 0


ARTICLE = "<h1>A heading</h1><p>" + "The first paragraph has some words in it. " * 4 + "</p><p>" + "The second one goes on for a while. " * 4 + "</p>"
ARTICLE_TEXT = "A heading\n" + ("The first paragraph has some words in it. " * 4).strip() + "\n" + ("The second one goes on for a while. " * 4).strip()
AROUND = "<body><header><a href=/>Site</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>{}<footer>Foot words</footer></body>"
COMMENT = "<p>I do not agree with it at all, and here is why I think so, in many words.</p>" * 9


@pytest.fixture(scope="module")
def weights(spark):
    return html_extract.fit(spark.read.parquet(f"{DIR}/pages.parquet"))


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="layout sidebar-right">{ARTICLE}</div>', f'<div class="content overflow-hidden">{ARTICLE}</div>', f'<div class="share-price">{ARTICLE}</div>', f'<div aria-hidden="false">{ARTICLE}</div>',
        f'<article>{ARTICLE}</article><section><article class="comment">{COMMENT}</article><article class="comment">{COMMENT}</article></section>', f'<div class="article-header">{ARTICLE[:18]}</div>{ARTICLE[18:]}',
        f'<div id="main">{ARTICLE}<div class="cookieBanner"><p>{"We use cookies on this site. " * 9}</p></div></div>', f'<form id="aspnetForm"><div>{ARTICLE}</div></form><form><p>Your name here please</p></form>',
        f'<body class="has-sidebar no-comments"><main class="with-comments">{ARTICLE}</main><div id="disqus_thread">{COMMENT}</div>', f"<nav><ul><li>One two<article>{ARTICLE}</article>", f'<div class="comments-enabled"><article>{ARTICLE}</article></div>',
        f'<div hidden>{COMMENT}</div><div class="post">{ARTICLE}</div><div style="display: none">{COMMENT}</div>', f"<div><![CDATA[ x ]]><!-- a > b -->{ARTICLE}<script>if (a < b) '</p>'</script></div>",
        f'<div title="a > b" data-x=\'"<p>\'>{ARTICLE}</div>', f'<div class="sidebar widget"><p>{"Some words beside the text. " * 3}</p></div><div class="post">{ARTICLE}</div><ol class="commentlist"><li>{COMMENT}</ol>',
    ],
)
def test_pages_of_other_markup(weights, page):
    assert html_extract.extract_text(AROUND.format(page), weights) == ARTICLE_TEXT
    assert html_extract.extract_text(AROUND.format(page), {}) == ARTICLE_TEXT  # where no page names its content


def test_best_run_is_the_best():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x = rng.integers(-5, 5, int(rng.integers(0, 14))).tolist()
        a, b = html_extract.best_run(x)
        assert sum(x[a:b]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i, len(x) + 1))]) and (a, b) != (0, 0) or max(x, default=0) <= 0


def test_long_pages_take_linear_time(weights):
    n = 1 << 20
    bits = ["<a ", "<b>", '<a "', '<a b="', "<a b='>", "</i>", "<p class=comment>x", "<div class='x sidebar'>y", "<!-- ", "<![CDATA[", "<script>", "</script ", "< ", "a=b ", "&amp;", "<a " + " " * 50]
    for page in [*(x * (n // len(x)) for x in bits), "<b>" * (n // 6) + "</i>" * (n // 8), "<a b=" * (n // 10) + ">" * (n // 2), '<p a="' * (n // 12) + '>" ' * (n // 6)]:
        began = time.perf_counter()
        html_extract.extract_text(page, weights)
        assert time.perf_counter() - began < 8, page[:20]
    long = "<article>" + "".join(f"<p>{i} words of a long page</p>" for i in range(20000)) + "</article>"
    assert html_extract.extract_text(AROUND.format(long), weights).count("\n") == 19999


def test_pages_with_clashing_columns_and_the_query(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    more = pages.withColumns({c: F.lit("clash") for c in ("text", "n_chars", "kind", "context", "inside", "n")})
    assert html_extract.extract(more).exceptAll(html_extract.extract(pages)).isEmpty()
    got = queries.op4_html_extraction(spark, DIR)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == pages.count()


def test_toxicity(spark, docs, labels):
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs, labels.limit(0)).base == 0
    # labels from a planted word: it is learned, and found again in disguise
    text = [(i, ("some plain words about nothing the day " * 3) + ("what an idiot " if i % 4 == 0 else "")) for i in range(200)]
    d = spark.createDataFrame(text, "doc_id long, text string")
    y = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, y)
    test = spark.createDataFrame([(1, "you 1d10t"), (2, "an i.d.i.o.t here"), (3, "IDIOOOOT"), (4, "some plain day"), (5, "1999 a.b, 100$ and 3 x 4")], "doc_id long, text string")
    assert {r.key: r.score >= toxicity.FLAG for r in toxicity.score(test, model).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False}
    disguised = ["i/d/i/o/t", "i,d,i,o,t", "\u0456diot", "ïdíöt", "id\u200biot", "iidiot", "idi-ot", "ＩＤＩＯＴ", "an ID1OT!!!", "Ünsinn 1diot"]
    test = spark.createDataFrame(list(enumerate(disguised)), "doc_id long, text string")
    assert [disguised[r.key] for r in toxicity.score(test, model).collect() if r.score < toxicity.FLAG] == []


def test_one_folding():
    """A word has one hash, whatever else is in its text."""
    p = np.full((32, 32, 32, 32), -3.0, np.float32)
    hashes = []
    for t in ("Ünsinn ÄRGER Éa", "Ünsinn ÄRGER Éa 1d10t", "ünsinn ärger éa"):
        (_, b, offs), *_ = text_parts(pa.array([t]))
        hashes.append(toxicity._words(*toxicity.restored(b, offs, toxicity.Restorer(p)))[0][:3].tolist())
    assert hashes[0] == hashes[1] == hashes[2]


def test_toxicity_query(spark):
    """Held-out rows are never learned from, and most of their toxic documents are found."""
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, d).collect()}
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.FLAG)
    held = [(label[i], r.predicted) for i, r in got.items() if r.held_out and label.get(i) is not None]
    toxic, clean = [p for y, p in held if y], [p for y, p in held if not y]
    assert len(toxic) > 10 and np.mean(toxic) >= 0.7 and np.mean(clean) <= 0.02


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    p = np.log(rng.dirichlet(np.ones(32), (32, 32, 32))).astype(np.float32)
    r = toxicity.Restorer(p)
    for w in ("1d10t", "a4$e", "l00ok", "aaab3"):
        lattice = r.lattice(w, False)
        best = (-1e9, "")

        def walk(i, out, s, lattice=lattice):
            nonlocal best
            if i == len(lattice):
                t = out + " "
                t = re.sub(" +", " ", t).lstrip()
                k = [0, 0, 0] + [0 if c == " " else ord(c) - 96 for c in t]
                score = s + sum(float(p[k[j - 3], k[j - 2], k[j - 1], k[j]]) for j in range(3, len(k)))
                best = max(best, (score, t.strip()))
                return
            for text, cost in lattice[i]:
                walk(i + 1, out + text, s + cost)

        walk(0, "", 0.0)
        assert r.decode(lattice) == best[1]


def test_language(spark, docs):
    model = langid.fit(docs)
    got = langid.identify(docs, model).join(docs.select(F.col("doc_id").alias("key"), "lang").where("lang is not null"), "key").collect()
    assert np.mean([r.nearest == r.lang for r in got]) > 0.95
    odd = {r.key: r.lang_pred for r in langid.identify(docs.where("doc_id in (900, 901, 902)"), model).collect()}
    assert odd == {900: "und", 901: "und", 902: "und"}
    empty = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_language_query(spark):
    """Held-out rows are never learned from, and their languages are found."""
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op2_language_id(spark, d).collect()
    known = {r.lang for r in docs.values() if r.lang}
    right = []
    for r in got:
        t = docs[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t.text or "")) and r.lang_pred in known | {"und"}
        if r.held_out and t.lang and r.lang_pred != "und":
            right.append(r.lang_pred == t.lang)
    assert len(got) == len(docs) and len(right) > 100 and np.mean(right) > 0.95


def test_quality_verdict(spark, docs, labels):
    """The likelihood ratio of every text, counted in plain Python."""
    bucket = lambda g: (int.from_bytes(g, "big") * 0x9E3779B1 & 0xFFFFFFFF) >> 16
    grams = lambda t: collections.Counter(bucket(b[i : i + 3]) for b in [(t or "").encode()] for i in range(len(b) - 2))
    rows = [(i, grams(t)) for i, t in plain(docs)]
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    raw, trusted = collections.Counter(), collections.Counter()
    for i, c in rows:
        raw.update(c)
        if i in good:
            trusted.update(c)
    all_raw, all_trusted = sum(raw.values()) + quality.BUCKETS / 2, sum(trusted.values())
    p = {g: (raw[g] + 0.5) / all_raw for g in raw}
    ratio = {g: np.log((trusted[g] + 0.01 * all_trusted * p[g]) / (1.01 * all_trusted) / p[g]) for g in raw}
    want = collections.Counter((i, round(sum(n * ratio[g] for g, n in c.items()) / max(sum(c.values()), 1), 3)) for i, c in rows)
    table = quality.fit(docs, labels)
    got = quality.score(docs, labels)
    name = next(c for c in got.columns if c not in ("doc_id", "kept", "base_failed", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    near = {(i, s) for (i, s) in want}
    for r in got.collect():
        assert min(abs(r[name] - s) for i, s in near if i == r.doc_id) < 2e-3 and r.kept == (not r.base_failed and r[name] >= quality.THRESHOLD)
    assert len(table) == quality.BUCKETS


def test_other_queries(spark):
    """The registered queries over a folder's whole tables, with the columns of their contracts."""
    n = spark.read.parquet(f"{DIR}/documents.parquet").count()
    want = {
        "op3_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op7_token_io": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op9_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        "op10_minhash_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    }
    for name, columns in want.items():
        got = queries.QUERIES[name](spark, DIR)
        assert set(columns) <= set(got.columns) and got.count() == n, name
    found = queries.op5_decontamination(spark, DIR)
    assert {"doc_id", "item_id"} <= set(found.columns) and found.count() > 0


def test_language_of_few_texts_with_many_copies(spark, monkeypatch):
    monkeypatch.setattr(langid, "PER_LANGUAGE", 20)
    sizes = spark.sparkContext.accumulator(0)
    real = langid._clustered

    def counted(idf, k):
        go = real(idf, k)

        def count(group):
            sizes.add(len(group))
            return go(group)

        return count

    monkeypatch.setattr(langid, "_clustered", counted)
    words = {"aa": "red green blue black white", "bb": "eins zwei drei vier", "cc": "uno due tre quattro cinque sei"}
    rows = [(f"{words['aa']} {w} {i}", "aa") for w in words["aa"].split() for i in range(8) for _ in range(100)]
    rows += [(f"{words['bb']} {i}", "bb") for i in range(3) for _ in range(1000)] + [(words["cc"], "cc")] * 4000
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert set(model.langs) == {"aa", "bb", "cc"} and 4 < sizes.value <= 40 + 3 + 1


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    now, cols = docs, docs.columns
    sizes = []
    for _, f in corpus_pipeline.STAGES[:-1]:
        now = f(spark, now, DIR)
        assert now.columns == cols
        sizes.append(now.count())
    assert docs.count() > sizes[0] > sizes[1] > sizes[2]
    last = corpus_pipeline.STAGES[-1][1](spark, now, DIR)
    assert last.count() == sizes[3] and last.agg(F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens")).first()[0] == last.agg(F.sum("n_tokens")).first()[0]
