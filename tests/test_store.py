"""Write verbs, sets, cursors, the versioned store and its streams."""

import pytest
from pyspark.sql import functions as F

from keyloom import errors as E
from keyloom.functions.columns import Column
from keyloom.operators import cursor, sets, write
from keyloom.sources.model import ColumnIndex, Keyspace, SetKeyspace
from keyloom.sources.store import Store
from keyloom.streaming.feed import apply_stream, feed

V = Column("v")
T = Keyspace("t", "k", (ColumnIndex("by_v", (V,)),))
S = SetKeyspace("s", ("k", "m"))


def rows(spark, *pairs):
    return spark.createDataFrame([*pairs], "k long, v string")


def got(b):
    return sorted(tuple(r) for r in b.rows.collect())


def test_verbs(spark):
    b = T.bind(rows(spark, (1, "a"), (2, "b")))
    assert got(write.put(b, rows(spark, (2, "x"), (3, "c")))) == [(1, "a"), (2, "x"), (3, "c")]
    seq = spark.createDataFrame([(2, "x", 1), (2, "y", 2)], "k long, v string, n int")
    assert got(write.put(b, seq, "n")) == [(1, "a"), (2, "y")]
    with pytest.raises(E.KeyExists):
        write.insert(b, rows(spark, (2, "z")))
    with pytest.raises(E.NotFound):
        write.replace(b, rows(spark, (9, "z")))
    with pytest.raises(E.NotFound):
        write.delete(b, rows(spark, (9, "")))
    with pytest.raises(E.KeyEmpty):
        write.put(b, rows(spark, (None, "z")))
    left, n = write.delete_range(b, 2, None)
    assert (got(left), n()) == ([(1, "a")], 1)
    assert write.delete_range(b, 2, 2)[1]() == 0
    assert write.delete_prefix(b)[1]() == 2
    with pytest.raises(E.BulkLoadNonEmpty):
        write.bulk_load(b, rows(spark, (5, "a")))
    empty = T.bind(rows(spark).limit(0))
    with pytest.raises(E.BulkLoadOutOfOrder):
        write.bulk_load(empty, rows(spark, (5, "a"), (5, "b")))
    with pytest.raises(E.BulkLoadOutOfOrder):
        write.bulk_load(empty, spark.createDataFrame([(5, "a", 2), (7, "b", 1)], "k long, v string, n int"), "n")
    ordered = spark.createDataFrame([(5, "a", 1), (7, "b", 2)], "k long, v string, n int")
    assert got(write.bulk_load(empty, ordered, "n")) == got(write.put(empty, rows(spark, (5, "a"), (7, "b"))))
    unique = Keyspace("t", "k", (ColumnIndex("u", (V,), unique=True),))
    with pytest.raises(E.IndexUniqueViolation):
        write.put(unique.bind(rows(spark, (1, "a"))), rows(spark, (2, "a")))


def test_cursors(spark):
    b = T.bind(spark.range(1, 21).select(F.col("id").alias("k"), F.lit("v").alias("v")))
    assert cursor.get(b, 5).k == 5
    with pytest.raises(E.NotFound):
        cursor.get(b, 99)
    assert cursor.seek_le(b, 99).first().k == 20 and cursor.seek_lt(b, 1).isEmpty()
    assert cursor.seek_ge(b, 0).first().k == 1 and cursor.seek_gt(b, 20).isEmpty()
    assert [len(p) for p in cursor.pages(b, 8)] == [8, 8, 4]
    with pytest.raises(E.KeyEmpty):
        cursor.key_range(Keyspace("n", "v").bind(b.rows), "")


def test_sets(spark):
    b = S.bind(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (1, "a")], "k long, m string"))
    assert sets.has(b, 1) and not sets.has(b, 9) and sets.has_value(b, 1, "b") and not sets.has_value(b, 2, "b")
    assert sets.count_values(b, 1) == 2 and sets.count_values(b, 9) == 0
    new, added = sets.put(b, spark.createDataFrame([(1, "a"), (1, "z")], "k long, m string"))
    assert [tuple(r) for r in added.collect()] == [(1, "z")] and sets.count_values(new, 1) == 3
    assert sets.previous_key(b, 2).first().m == "a"
    with pytest.raises(E.NotFound):
        sets.delete_values(b, spark.createDataFrame([(1, "q")], "k long, m string"))
    assert got(sets.delete(b, spark.createDataFrame([(1,)], "k long"))) == [(2, "c")]
    fixed = SetKeyspace("f", ("k", "m"), fixed_size=2).bind(b.rows.limit(0))
    with pytest.raises(E.ValueSizeMismatch):
        sets.put(fixed, spark.createDataFrame([(1, "abc")], "k long, m string"))


def test_set_declarations(spark):
    """Keys are checked when a set is bound; members may be structs of values that can be compared."""
    rows_ = spark.sql("select 1L as k, named_struct('a', 1, 'b', 'x') as m, map('a', 1) as x")
    assert S.bind(rows_).rows.count() == 1
    for bad in (SetKeyspace("s", ("m", "k")), SetKeyspace("s", ("k", "nothing")), SetKeyspace("s", ("k", "x")), Keyspace("s", "m")):
        with pytest.raises(E.InvalidOptions):
            bad.bind(rows_)


def test_reads_in_order(spark, tmp_path):
    """Lookups, prefixes and ranges in key order and its exact reverse, with and without stored entries."""
    from keyloom.functions.columns import MultiColumn
    from keyloom.operators.index import IndexReader

    data = spark.createDataFrame([(i, f"v{i % 3}", [f"t{i % 4}", "all", f"t{i % 2}"]) for i in range(24)], "k long, v string, tags array<string>")
    tags = MultiColumn("tags")
    space = Keyspace("r", "k", (ColumnIndex("by_v", (V,)), ColumnIndex("full", (V,), cover_value=True), ColumnIndex("by_tag", (tags, V)), ColumnIndex("full_tag", (tags, V), cover_value=True), ColumnIndex("none", (V,), where="k > 10")))
    st = Store(spark, f"file://{tmp_path}/db", ranges=3)
    st.update(lambda tx: tx.create(space, data))
    every = [r.asDict() for r in data.collect()]
    keys = {"by_v": lambda r: [(r["v"],)], "full": lambda r: [(r["v"],)], "none": lambda r: [(r["v"],)] * (r["k"] > 10), "by_tag": lambda r: [(t, r["v"]) for t in r["tags"]], "full_tag": lambda r: [(t, r["v"]) for t in r["tags"]]}
    for b in (space.bind(data), st.snapshot().open(space)):
        for name, of in keys.items():
            reader, two = IndexReader(b, name), "tag" in name
            point = ("t1", "v1") if two else ("v1",)

            def want(ok, of=of):
                return [k for _, k in sorted((min(e for e in of(r) if ok(e)), r["k"]) for r in every if any(map(ok, of(r))))]

            for got, ok in (
                (lambda rev: reader.lookup(*point, reverse=rev), lambda e: e == point), (lambda rev: reader.prefix(point[0], reverse=rev), lambda e: e[0] == point[0]),
                (lambda rev: reader.prefix(reverse=rev), lambda e: True), (lambda rev: reader.range(point, None, reverse=rev), lambda e: e >= point), (lambda rev: reader.range(None, ("t2",) if two else ("v2",), reverse=rev), lambda e: e < (("t2",) if two else ("v2",))),
            ):
                assert [r.k for r in got(False).collect()] == want(ok), name
                assert [r.k for r in got(True).collect()] == want(ok)[::-1], name
                assert sorted(r.k for r in got(None).collect()) == sorted(want(ok)), name


def test_store(spark, tmp_path):
    st = Store(spark, f"file://{tmp_path}/db")
    st.update(lambda tx: tx.create(T, rows(spark, (1, "a"), (2, "b"))))
    snap = st.snapshot()
    v = st.version()
    st.update(lambda tx: tx.write(write.put(tx.open(T), rows(spark, (1, "x"), (3, "c")))))
    assert got(snap.open(T)) == [(1, "a"), (2, "b")] and got(st.snapshot().open(T)) == [(1, "x"), (2, "b"), (3, "c")]
    assert st.wait_version(v) == v + 1 and st.wait_version(v, 0.2, "other") == v + 1
    with pytest.raises(E.KeyspaceKindMismatch):
        snap.open(SetKeyspace("t", ("k", "v")))
    with pytest.raises(E.KeyspaceNotFound):
        snap.open(S)
    with pytest.raises(E.IndexFingerprintMismatch):
        st.snapshot().open(Keyspace("t", "k", (ColumnIndex("by_v", (V,), version=2),)))
    with pytest.raises(E.ReadOnly):
        snap.write(None)
    a, b = st.begin(), st.begin()
    a.drop_index(T, "by_v")
    a.commit()
    with pytest.raises(E.Conflict):
        b.commit()
    with pytest.raises(E.TxClosed):
        a.commit()
    tx = st.begin()
    assert (tx.next_sequence(T), tx.next_sequence(T, 5), tx.next_sequence(T)) == (1, 2, 7)
    child = tx.child()
    with pytest.raises(E.TxClosed):
        tx.commit()
    child.create_index(T, "by_v")
    child.rollback()
    tx.create_index(T, "by_v")
    tx.commit()
    _, errors = st.batch([lambda t: t.write(write.put(t.open(T), rows(spark, (7, "q")))), lambda t: t.write(write.insert(t.open(T), rows(spark, (7, "z")))), lambda t: t.next_sequence(T)])
    assert [type(e) for e in errors] == [type(None), E.KeyExists, type(None)]
    assert (7, "q") in got(st.snapshot().open(T)) and st.snapshot().check(T).isEmpty()
    assert got(st.copy_to(f"file://{tmp_path}/copy").snapshot().open(T)) == got(st.snapshot().open(T))
    assert {r.name: r.rows for r in st.snapshot().stats().collect()} == {"t": 4, "t.by_v": 4}


def test_touched_ranges(spark, tmp_path):
    """A write rewrites the ranges its keys lie in, of the rows and of the entries, and no others."""
    from keyloom.operators.index import IndexReader

    space = Keyspace("t", "k", (ColumnIndex("by_v", (V,), covering=(Column("w"),)), ColumnIndex("u", (Column("w"),), unique=True)))
    data = spark.range(4000).select(F.col("id").alias("k"), F.format_string("v%04d", "id").alias("v"), (F.col("id") * 2).alias("w"))
    st = Store(spark, f"file://{tmp_path}/db", ranges=6)
    st.update(lambda tx: tx.create(space, data))
    one = st.manifest()["spaces"]["t"]
    assert len(one["parts"]) > 2 and len(one["indexes"]["by_v"]["parts"]) > 2
    new = spark.createDataFrame([(10, "v0010", 21), (5000, "v0011", 1)], "k long, v string, w long")
    st.update(lambda tx: tx.put(space, new))
    two = st.manifest()["spaces"]["t"]
    same = lambda a, b: sum(x == y for x, y in zip(a["parts"], b["parts"], strict=True))
    assert same(one, two) == len(one["parts"]) - 2 and same(one["indexes"]["by_v"], two["indexes"]["by_v"]) == len(one["indexes"]["by_v"]["parts"]) - 1
    b = st.snapshot().open(space)
    want = sorted([*((i, f"v{i:04d}", 2 * i) for i in range(4000) if i != 10), (10, "v0010", 21), (5000, "v0011", 1)])
    assert got(b) == want and st.snapshot().check(space).isEmpty()
    assert {(r.k, r["_c_w"]) for r in IndexReader(b, "by_v").range_entries(("v0010",), ("v0012",)).collect()} == {(10, 21), (11, 22), (5000, 1)}
    with pytest.raises(E.IndexUniqueViolation):
        st.update(lambda tx: tx.put(space, spark.createDataFrame([(3999, "x", 0)], "k long, v string, w long")))  # 0 is row 0's, in another range
    with pytest.raises(E.KeyExists):
        st.update(lambda tx: tx.insert(space, new))
    with pytest.raises(E.NotFound):
        st.update(lambda tx: tx.delete(space, spark.createDataFrame([(9999,)], "k long")))
    st.update(lambda tx: tx.delete(space, spark.range(0, 3000).select(F.col("id").alias("k"))))
    st.update(lambda tx: tx.replace(space, spark.createDataFrame([(3000, None, 7)], "k long, v string, w long")))
    st.update(lambda tx: tx.put(space, spark.createDataFrame([(1, "back", 9)], "k long, v string, w long")))
    assert got(st.snapshot().open(space))[:1] == [(1, "back", 9)] and st.snapshot().open(space).rows.count() == 1002 and st.snapshot().check(space).isEmpty()
    versions, folders = st.vacuum(older_than=0)
    assert versions == st.version() - 1 and folders > 0 and st.versions() == [st.version()] and st.snapshot().open(space).rows.count() == 1002


def test_ranges_of_odd_keys(spark, tmp_path):
    """Null, boolean, binary, time and struct keys of indexes, in stores that are written to again."""
    kinds = {"b": "k % 2 = 0", "n": "if(k < 30, null, k)", "x": "cast(cast(k as string) as binary)", "t": "timestamp_micros(k * 1000003)", "d": "date_add(date'2020-01-01', cast(k as int))", "s": "struct(k % 3 as a)", "f": "k / 7.0"}
    space = Keyspace("o", "k", tuple(ColumnIndex(f"by_{c}", (Column(c),)) for c in kinds))
    data = spark.range(60).selectExpr("id as k").selectExpr("k", *[f"{v} as {c}" for c, v in kinds.items()])
    st = Store(spark, f"file://{tmp_path}/db", ranges=5)
    st.update(lambda tx: tx.create(space, data))
    more = spark.range(50, 70).selectExpr("id as k").selectExpr("k", *[f"{v} as {c}" for c, v in kinds.items()])
    st.update(lambda tx: tx.put(space, more.withColumn("n", F.lit(None).cast("long"))))
    st.update(lambda tx: tx.delete(space, spark.range(20, 40).selectExpr("id as k")))
    b = st.snapshot().open(space)
    assert b.rows.count() == 50 and st.snapshot().check(space).isEmpty() and b.rows.where("n is null").count() == 40


def test_two_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    st = Store(spark, f"file://{tmp_path}/db")
    st.update(lambda tx: tx.create(T, rows(spark, (1, "a"))))
    for _ in range(5):
        txs = [st.begin() for _ in range(8)]
        for tx in txs:
            tx.next_sequence(T)

        def commit(tx):
            try:
                return tx.commit()
            except E.Conflict:
                return None

        with ThreadPoolExecutor(8) as pool:
            done = list(pool.map(commit, txs))
        assert len([v for v in done if v]) == 1
    assert st.manifest()["spaces"]["t"]["sequence"] == 5


def test_numbers_of_many_rows(spark):
    """Each number once, whatever the columns and however the exchange is cut."""
    n = 300_000
    x = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.md5(F.col("id").cast("string")).alias("text"))
    got = write.next_sequences(x, 5, order=["k"])
    r = got.agg(F.count_distinct("seq").alias("n"), F.max("seq").alias("top"), F.min("seq").alias("low"), F.sum((F.col("seq") != F.col("k") + 6).cast("int")).alias("bad")).first()
    assert tuple(r) == (n, n + 5, 6, 0)
    b = Keyspace("n", "k").bind(x)
    y = cursor.neighbours(b)
    assert y.where("next.k != k + 1 or previous.k != k - 1").isEmpty() and y.where("next is null or previous is null").count() == 2


def test_streams(spark, tmp_path):
    st = Store(spark, f"file://{tmp_path}/db")
    st.update(lambda tx: tx.create(T, rows(spark, (1, "a"))))
    rows(spark, (1, "new"), (5, "e")).write.parquet(f"{tmp_path}/in")
    apply_stream(st, T, spark.readStream.schema("k long, v string").parquet(f"{tmp_path}/in"), f"{tmp_path}/cp").awaitTermination(120)
    assert got(st.snapshot().open(T)) == [(1, "new"), (5, "e")]
    q = feed(st, "t").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.version for r in spark.sql("select * from seen").collect()) == [2, 3]
