"""Plans never change results: scan lowering, index lowering and a plain Python evaluator agree."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keyloom.errors import EncodeError, IndexDeclaration, IndexNotUnique, IndexUniqueViolation, InvalidOptions, MaterializeLimit, NotFound
from keyloom.functions.columns import Column, MultiColumn, or_
from keyloom.functions.encoders import FLOAT_BITS, FOLD, INT64, bytes_int64, int64_bytes, sortable_tuple
from keyloom.operators.index import IndexReader, check, entries, maintained, sorted_entries
from keyloom.operators.query import Query
from keyloom.plans.planner import plan_query
from keyloom.sources.model import ColumnIndex, Keyspace, index_by

grp, name, tags = Column("grp"), Column("name"), MultiColumn("tags")
SCHEMA = "id long, grp long, name string, tags array<string>"
INDEXES = (
    ColumnIndex("by_grp", (grp,)),
    ColumnIndex("by_grp_name", (grp, name), covering=()),
    ColumnIndex("by_name_cov", (name,), covering=(grp,)),
    ColumnIndex("by_name_full", (name, grp), cover_value=True),
    ColumnIndex("by_tag", (tags,)),
    ColumnIndex("by_grp_tag", (grp, tags)),
    ColumnIndex("even", (grp, name), where="grp % 2 = 0"),
)


def space(spark, rows, indexes=()):
    return Keyspace("t", "id", tuple(indexes)).bind(spark.createDataFrame(rows, SCHEMA))


def holds(t, r):
    if t.kind == "or":
        return any(all(holds(x, r) for x in g) for g in t.groups)
    v = r[{"grp": 1, "name": 2, "tags": 3}[t.name]]
    one = {
        "eq": lambda x: x == t.values[0], "contains": lambda x: x == t.values[0], "lt": lambda x: x < t.values[0], "lte": lambda x: x <= t.values[0],
        "gt": lambda x: x > t.values[0], "gte": lambda x: x >= t.values[0], "between": lambda x: t.values[0] <= x < t.values[1],
        "contains_range": lambda x: t.values[0] <= x < t.values[1], "prefix": lambda x: x.startswith(t.values[0]),
    }[t.kind]
    return any(map(one, v)) if t.multi else one(v)


def some_term(rnd, deep=True):
    n = lambda: rnd.choice(["alpha", "beta", "Alpha", "b", ""])
    g = lambda: rnd.randrange(6)
    k = rnd.randrange(9 if deep else 7)
    if k == 0:
        return grp.eq(g())
    if k == 1:
        return name.eq(n())
    if k == 2:
        return rnd.choice([grp.lt, grp.lte, grp.gt, grp.gte])(g())
    if k == 3:
        return name.between(*sorted((n(), n())))
    if k == 4:
        return name.has_prefix(rnd.choice(["a", "b", ""]))
    if k == 5:
        return tags.contains(rnd.choice(["go", "db", "x", ""]))
    if k == 6:
        return tags.contains_range("a", "h")
    return or_(*[[some_term(rnd, False) for _ in range(rnd.randrange(1, 3))] for _ in range(rnd.randrange(1, 3))])


def test_plans_agree(spark):
    rnd, census = random.Random(7), Counter()
    rows = [(i, rnd.randrange(6), rnd.choice(["alpha", "beta", "Alpha", "b", ""]), [rnd.choice(["go", "db", "x", ""]) for _ in range(rnd.randrange(3))]) for i in range(90)]
    for _ in range(14):
        b = space(spark, rows, [i for i in INDEXES if rnd.random() < 0.7])
        terms = [some_term(rnd) for _ in range(rnd.randrange(0, 4))]
        order = [k for k in (grp.asc(), name.desc(), grp.desc(), name.asc()) if rnd.random() < 0.3]
        off, lim = rnd.randrange(4), rnd.choice([None, None, 5, 0])
        want = [r for r in rows if all(holds(t, r) for t in terms)]
        want.sort(key=lambda r: r[0], reverse=bool(order) and order[-1].descending)
        for k in reversed(order):
            want.sort(key=lambda r: r[1 if k.column.name == "grp" else 2], reverse=k.descending)
        n = max(0, len(want) - off) if lim is None else max(0, min(lim, len(want) - off))
        want_ids = [r[0] for r in want][off:][: max(lim, 0) if lim is not None else None]
        for lowering in ("scan", "index"):
            q = Query(b, lowering).where(*terms).select(grp, name).order_by(*order).offset(off)
            q = q if lim is None else q.limit(lim)
            got = [r.id for r in q.all().collect()]
            assert (got if order or lim is not None or off else sorted(got)) == want_ids, (lowering, q.explain())
            assert sorted((r.id, r.grp, r.name) for r in q.rows().collect()) == sorted(r[:3] for r in rows if r[0] in set(want_ids))
            assert q.count() == n
        census[q.plan().kind, q.plan().values] += 1
    assert len(census) >= 4, census


def test_plan_shapes():
    ix = {i.name: i for i in INDEXES}
    shape = lambda terms, *names, **k: plan_query(terms, [ix[n] for n in names], **k)
    p = shape([grp.eq(1), name.gte("b"), name.lt("x")], "by_grp", "by_grp_name")
    assert (p.leaves[0].index.name, p.leaves[0].shape, len(p.residual)) == ("by_grp_name", "IndexRange", 1)
    assert shape([grp.eq(2)], "even").kind == "Scan"  # partial indexes are never chosen
    assert shape([grp.eq(2)], "by_grp_tag").kind == "Scan"  # a row without tags has no entry
    assert shape([grp.eq(2), tags.contains("x")], "by_grp_tag").leaves[0].shape == "IndexSeek"
    assert shape([grp.eq(1), name.eq("x")], "by_grp", "by_name_cov").kind == "Intersect"
    assert shape([or_(grp.eq(1), name.eq("x"))], "by_grp", "by_name_cov").kind == "Union"
    assert shape([or_(grp.eq(1), tags.contains("x"))], "by_grp").kind == "Scan"
    assert shape([name.eq("a")], "by_name_cov", selected=["grp"]).values == "entry"
    assert shape([name.eq("a")], "by_name_cov", selected=["grp"], opaque=1).values == "back-lookup"
    assert shape([name.eq("a")], "by_name_full", selected=["grp"]).values == "cover-value"
    assert shape([grp.eq(1)], "by_grp_name", order=[name.desc()]).reverse


def test_index_only_reads_no_rows(spark, tmp_path):
    rows = [(i, i % 3, "n", []) for i in range(9)]
    b = space(spark, rows, [ix for ix in INDEXES if ix.name == "by_name_cov"])
    sorted_entries(b, b.space.indexes[0]).write.parquet(str(tmp_path / "e"))
    b.rows.write.parquet(str(tmp_path / "r"))
    stored = b.space.bind(spark.read.parquet(str(tmp_path / "r")), {"by_name_cov": spark.read.parquet(str(tmp_path / "e"))})
    q = Query(stored, "index").where(name.eq("n")).select(grp)
    plan = q.rows()._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path / "r") not in plan and q.rows().count() == 9
    assert "IndexSeek(by_name_cov, values=entry)" in q.explain()


def test_anchors(spark):
    b = space(spark, [(1, 1, "b", []), (2, 1, "a", []), (3, 1, "a", []), (4, 1, "c", []), (5, 2, "a", [])])
    ids = lambda q: [r.id for r in q.all().collect()]
    assert ids(Query(b).where(grp.eq(1)).order_by(name.asc())) == [2, 3, 1, 4]
    assert ids(Query(b).where(grp.eq(1)).order_by(name.desc())) == [4, 1, 3, 2]
    same = space(spark, [(i, 1, "same", []) for i in range(1, 10)])
    assert ids(Query(same).order_by(name.asc()).limit(4)) == [1, 2, 3, 4]
    assert ids(Query(same).order_by(name.desc()).limit(4)) == [9, 8, 7, 6]
    b = space(spark, [(1, 1, "", ["b", "c"]), (2, 1, "", ["a"]), (3, 2, "", ["d", "e", "f"]), (4, 2, "", [])], INDEXES[4:6])
    for low in ("scan", "index"):
        assert sorted(ids(Query(b, low).where(tags.contains_range("a", "z")))) == [1, 2, 3]
        assert sorted(ids(Query(b, low).where(grp.eq(2)))) == [3, 4]
    b = space(spark, [(1, 0, "alpha", []), (2, 0, "Alpha", []), (3, 0, "beta", [])])
    assert sorted(ids(Query(b).where(Column("name", encoder=FOLD).eq("ALPHA")))) == [1, 2]
    x = Keyspace("f", "id").bind(spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, 0.0), (4, -0.0)], "id long, v double"))
    v = Column("v", encoder=FLOAT_BITS)
    assert ids(Query(x).where(v.eq(float("nan")))) == [1]
    assert ids(Query(x).where(v.eq(-0.0))) == [4]
    assert ids(Query(x).where(v.lt(0.0))) == [4]
    raw = Column("n")
    y = Keyspace("b", "n").bind(spark.createDataFrame([(bytearray(z),) for z in (b"a", b"a\0", b"ab", b"\xff", b"\xff\xff")], "n binary"))
    assert [bytes(r.n) for r in Query(y).where(raw.has_prefix(b"\xff")).order_by(raw.desc()).keys().collect()] == [b"\xff\xff", b"\xff"]


def test_errors_and_budget(spark):
    b = space(spark, [(i, 1, "n" * 10, []) for i in range(50)], INDEXES[:3])
    for size in (64, 16, 1):
        with pytest.raises(MaterializeLimit):
            Query(b).order_by(name.asc()).with_materialize_limit(size).all()
    assert Query(b).order_by(name.asc()).with_materialize_limit(1 << 20).all().count() == 50
    assert Query(b).with_materialize_limit(1).all().count() == 50
    with pytest.raises(EncodeError):
        Query(b).where(Column("grp", encoder=INT64).eq("x")).limit(0).all()
    assert isinstance(Query(b).filter(None).err(), InvalidOptions)
    with pytest.raises(InvalidOptions):
        Query(b).rows()
    assert Query(b).where(or_()).count() == 0 and Query(b).where(or_([])).count() == 50
    with pytest.raises(IndexDeclaration):
        ColumnIndex("x", (grp, grp))
    with pytest.raises(IndexDeclaration):
        ColumnIndex("x", (grp,), covering=(name,), cover_value=True)


def test_index_reads(spark):
    users = Keyspace("u", "id", (index_by("first", "case when name = '' then array() else array(substring(name, 1, 1)) end"),))
    b = users.bind(spark.createDataFrame([(1, "alice"), (2, "amy"), (3, "bob"), (4, "anna"), (5, "")], "id long, name string"))
    r = IndexReader(b, "first")
    assert sorted(x.id for x in r.lookup("a").collect()) == [1, 2, 4]
    assert [x.id for x in r.lookup_keys("a", reverse=True).collect()] == [4, 2, 1]
    with pytest.raises(IndexNotUnique):
        r.get("a")
    with pytest.raises(InvalidOptions):
        r.lookup("a", "b")
    unique = ColumnIndex("u", (tags,), unique=True)
    with pytest.raises(IndexUniqueViolation):
        entries(space(spark, [(1, 0, "", ["go", "go"])], [unique]), unique)
    one = space(spark, [(1, 0, "a", ["go"]), (2, 0, "b", ["x"])], [unique])
    assert IndexReader(one, "u").get("x").id == 2
    with pytest.raises(NotFound):
        IndexReader(one, "u").get("z")
    assert entries(space(spark, [(1, 0, "", ["go", "go"])], [INDEXES[4]]), INDEXES[4]).count() == 1


def test_upkeep_and_check(spark):
    cov = INDEXES[2]
    b = space(spark, [(1, 1, "a", []), (2, 2, "b", [])], [cov])
    changed = spark.createDataFrame([(2, 9, "b", [])], SCHEMA)
    new = maintained(b, cov, changed, changed)
    assert sorted((r.id, r["_c_grp"]) for r in new.collect()) == [(1, 1), (2, 9)]  # covered values are fresh
    stale = b.space.bind(space(spark, [(1, 1, "a", []), (2, 9, "b", [])]).rows, {cov.name: entries(b, cov)})
    assert {(r.code, r.n) for r in check(stale).collect()} == {("index-entry-missing", 1), ("index-entry-extra", 1)}


def test_encoders(spark):
    vals = [-(1 << 63), -5, 0, 7, (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in vals], "v long").withColumn("b", int64_bytes(F.col("v"))).withColumn("w", bytes_int64(F.col("b")))
    got = df.orderBy("b").collect()
    assert [r.v for r in got] == vals and all(r.v == r.w for r in got)
    pairs = [(b"a", b"b"), (b"a\0", b""), (b"a", b""), (b"", b"z"), (b"\xa0\x0b", b"")]
    df = spark.createDataFrame([(bytearray(x), bytearray(y)) for x, y in pairs], "x binary, y binary")
    got = [(bytes(r.x), bytes(r.y)) for r in df.orderBy(sortable_tuple(F.col("x"), F.col("y"))).collect()]
    assert got == sorted(pairs)
