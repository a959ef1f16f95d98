"""Near-duplicate groups by SuperMinHash signatures, banding, verification on full sets and union-find.

A signature slot holds the smallest ``level + u`` over a text's shingles, where each shingle walks
a pseudo-random permutation of the slots, one slot a level. All shingles of a block take a level
together, and a text stops as soon as every slot is filled: later levels can't lower it.

Texts with equal shingle sets are one *class* and are collapsed first, so a group of thousands of
exact copies is one node. A bucket (equal band) of up to ``SMALL_BUCKET`` classes tests all its pairs,
a bound that doesn't grow. A larger one first tests its members against its most central one, L. If u is not
linked with L, its overlap with L is too small for a link with a set as large as L; so u and m are linked
only if they share enough of what each has beyond L. The members are therefore dealt anew by those
shingles, each taking only the prefix of its sorted ones that such a number can't miss. The one exception,
an m smaller than L with which u could be linked through L alone, is paired by sizes and overlaps. New buckets of
up to ``SPLIT_BUCKET`` test all pairs between components; the larger take more leaders each round until
every pair between components has been tested. So no bucket is capped and no pair is dropped, while a
group of copies takes tests in proportion to its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import discard, list_array, map_arrow, materialize, text_parts, with_counted, with_salted
from .components import components

U = np.uint64
#: 32 bands of 8 rows miss a pair of similarity 0.85 with probability 4e-5; 6 rows do so at 0.8.
BANDS = 32


def rows_for(percent: int) -> int:
    return 8 if percent >= 85 else 6


SMALL_BUCKET = 6
SPLIT_BUCKET = 32
BITMAP = 1 << 22
_LATE = 8  # levels for which a shingle's swaps are kept as a list


def signatures(h: np.ndarray, seg: np.ndarray, nseg: int, m: int) -> np.ndarray:
    """(nseg, m) SuperMinHash signatures of the sets of hashes ``h``; a set without members keeps the maximum."""
    none = U(0xFFFFFFFFFFFFFFFF)
    sig = np.full(nseg * m, none, U)
    ks: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    perm = None
    for j in range(m):
        if not len(h):
            break
        x = tv.mix(h + U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = (U(j) + (((x & U(0xFFFFFFFF)) * U(m - j)) >> U(32))).astype(np.int64)
        if perm is None:
            at_k, at_j = k.copy(), np.full(len(h), j)
            for kt, vt in zip(ks, vs, strict=True):
                np.copyto(at_k, vt, where=kt == k)
                np.copyto(at_j, vt, where=kt == j)
            ks.append(k)
            vs.append(at_j)
        else:
            rows = np.arange(len(h))
            at_k = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(sig, seg * m + at_k, (U(j) << U(32)) | (x >> U(32)))
        open_ = (sig.reshape(nseg, m) == none).any(axis=1)[seg]
        if not open_.all():
            h, seg = h[open_], seg[open_]
            if perm is None:
                ks, vs = [k[open_] for k in ks], [v[open_] for v in vs]
            else:
                perm = perm[open_]
        if perm is None and j + 1 == _LATE:
            perm = np.tile(np.arange(m, dtype=np.int16), (len(h), 1))
            rows = np.arange(len(h))
            for kt, vt in zip(ks, vs, strict=True):
                perm[rows, kt] = vt
    return sig.reshape(nseg, m)


def _id_bit(ids: np.ndarray) -> np.ndarray:
    return (tv.mix(ids.astype(np.int64).view(U)) & U(BITMAP - 1)).astype(np.int64)


def set_rows(k: int, bands: int = 0, rows: int = 0, full: bool = False, bitmap: np.ndarray | None = None):
    """A function for mapInArrow from (doc_id, text, mark) to the texts' sets: size, class keys, mark, band hashes or members."""

    def go(batches):
        for batch in batches:
            ids = batch.column(0)
            if bitmap is not None:
                x = ids.fill_null(0).to_numpy(zero_copy_only=False)
                bit = _id_bit(x)
                batch = batch.filter(pa.array((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1))
                ids = batch.column(0)
            for at, b, offs in text_parts(batch.column(1)):
                nd = len(offs) - 1
                n, d, h = tv.shingle_sets(b, offs, k)
                k1, k2 = np.zeros(nd, U), np.zeros(nd, U)
                some = np.flatnonzero(n)
                if len(h):
                    first = np.concatenate(([0], np.cumsum(n)[:-1]))[some]
                    k1[some] = np.add.reduceat(tv.mix(h), first)
                    k2[some] = np.add.reduceat(tv.mix(h ^ U(0x5851F42D4C957F2D)), first)
                out = [ids.slice(at, nd), pa.array(n.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))]
                names = ["doc_id", "n_shingles", "k1", "k2"]
                if batch.num_columns > 2:
                    out.append(batch.column(2).slice(at, nd))
                    names.append("mark")
                if bands:
                    sig = signatures(h, d, nd, bands * rows).reshape(nd, bands, rows)
                    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=U), (nd, bands)).copy()
                    for i in range(rows):
                        acc = tv.mix(acc * U(0x9E3779B97F4A7C15) + sig[:, :, i])
                    out.append(list_array(acc.view(np.int64).ravel(), np.full(nd, bands), pa.int64()))
                    names.append("bands")
                if full:
                    out.append(list_array(h.view(np.int64), n, pa.int64()))
                    names.append("members")
                yield pa.RecordBatch.from_arrays(out, names)

    return go


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the hashed ids: what it lets through is joined exactly afterwards."""

    def bits(batches):
        for batch in batches:
            b = np.unique(_id_bit(batch.column(0).to_numpy(zero_copy_only=False)))
            cell, one = b >> 5, np.int64(1) << (b & 31)
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(cell[first]), pa.array(np.bitwise_or.reduceat(one, first))], ["cell", "bits"])

    rows = map_arrow(ids, bits, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITMAP // 32, np.uint32)
    out[rows.column("cell").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def near_duplicates(docs: DataFrame, k: int, percent: int, bands: int = BANDS, rows: int | None = None, marked: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (``marked``: also mark, the text's md5, and comp, its component) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Links texts whose sets of k-word shingles have ``100 * intersection >= percent * union``, each
    confirmed on the full sets; ``component_id`` is the smallest doc_id reachable. Texts without words and
    null texts have 0 shingles and are linked with nothing. A row with a null doc_id has a null component_id and
    is kept; such rows link nothing. Repeated rows link with one another and keep the same ids.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = rows or rows_for(percent)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    head = "doc_id long, n_shingles long, k1 long, k2 long"
    told = base.withColumn("mark", F.md5("text")) if marked else base
    made = materialize(map_arrow(told, set_rows(k, bands, rows), head + ", mark string" * marked + ", bands array<long>"), "sets")
    usable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    # a class: all rows of one set. Its key is a 64-bit hash of both sums and the size.
    key = F.xxhash64("k1", "k2", "n_shingles").alias("cls")
    classes = materialize(made.where(usable).groupBy(key).agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")), "classes")
    banded = made.where(usable).select(key, F.col("doc_id").alias("rep"), "bands").join(classes.select("cls", "rep"), ["cls", "rep"], "left_semi")
    flat = materialize(banded.select("cls", F.explode("bands").alias("bucket")).distinct(), "bands")
    many = flat.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    # central: how many classes share its buckets, all told; an unedited original leads those made from it
    central = F.sum("g").over(Window.partitionBy("cls")).alias("c")
    members = materialize(with_counted(flat, many, ["bucket"]).withColumnRenamed("n", "g").select("bucket", "cls", "g", central), "buckets")
    discard(spark, flat)

    needed = members.select("cls").distinct().join(classes, "cls")
    bitmap = _bitmap(needed.select("rep"))
    sets = map_arrow(base, set_rows(k, full=True, bitmap=bitmap), head + ", members array<long>")
    sets = sets.where(usable).select(key, F.col("doc_id").alias("rep"), "members")
    sets = materialize(sets.join(needed.select("cls", "rep"), ["cls", "rep"], "left_semi").groupBy("cls").agg(F.first("members").alias("members")), "members")

    spent: list[DataFrame] = []

    def overlaps(pairs: DataFrame, *more) -> DataFrame:
        """Of pairs (a, b) of classes: both sizes and the size of the intersection."""
        x = with_salted(pairs, sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        size = [F.size(c).cast("long") for c in ("sa", "sb", F.array_intersect("sa", "sb"))]
        return x.select("a", "b", size[0].alias("na"), size[1].alias("nb"), size[2].alias("both"), *more)

    def least_both(x: str, y: str):
        """The smallest intersection that links sets of these sizes."""
        return F.expr(f"({percent} * ({x} + {y}) + {99 + percent}) div {100 + percent}")

    near = F.col("both") >= least_both("na", "nb")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose sets are near enough."""
        size = classes.select(F.col("cls"), F.col("n"))
        pairs = pairs.distinct().join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
        pairs = materialize(pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b"), "pairs")
        spent.append(pairs)
        return overlaps(pairs).where(near).select("a", "b")

    def all_pairs(rows: DataFrame) -> DataFrame:
        """Pairs within the buckets, of a size that doesn't grow, whose components (``of``) differ."""
        lists = rows.groupBy("bucket").agg(F.collect_list(F.struct("cls", "of")).alias("all"))
        one = lists.select(F.explode("all").alias("x"), "all")
        others = F.filter("all", lambda y: (y["cls"] > F.col("x.cls")) & (y["of"] != F.col("x.of")))
        return one.select(F.col("x.cls").alias("a"), F.explode(others).alias("y")).select("a", F.col("y.cls").alias("b"))

    # every member of a larger bucket against its most central one
    big = members.where(F.col("g") > SMALL_BUCKET)
    small = members.where(F.col("g") <= SMALL_BUCKET).withColumn("of", F.col("cls"))
    tests, stars = confirmed(all_pairs(small)), None
    if not big.isEmpty():
        lead = F.min(F.struct(-F.col("c"), F.xxhash64("cls"), F.col("cls"))).alias("x")
        chosen = big.groupBy("bucket").agg(lead, F.count("*").alias("n")).select("bucket", F.col("x.cls").alias("a"), "n")
        star = materialize(with_counted(big, chosen, ["bucket"]).where("cls != a").select("a", F.col("cls").alias("b")).distinct(), "star")
        spent.append(star)
        stars = materialize(overlaps(star, F.array_except("sb", "sa").alias("added")), "stars")
        tests = tests.unionByName(stars.where(near).select("a", "b"))
    links = materialize(tests, "links")
    group = components(links)

    def further(links: DataFrame, group: DataFrame) -> DataFrame:
        """Components with the links between members that a leader does not join: see the module's text."""
        of = F.coalesce("of", "b").alias("of")
        split = stars.select("a", "b", "nb").join(group.toDF("b", "of"), "b", "left").select("a", "nb", of)
        split = split.groupBy("a").agg(F.min("nb").alias("low"), F.min("of").alias("x"), F.max("of").alias("y"), F.count("*").alias("n")).where("x != y")
        told = with_counted(stars, split.select("a", "low", "n"), ["a"]).drop("n").join(group.toDF("b", "of"), "b", "left").select("a", "b", "na", "nb", "both", "added", "low", of)
        told = materialize(told.withColumn("low", F.greatest("low", F.expr(f"({percent} * nb + 99) div 100"))), "told")
        if told.isEmpty():
            return group
        share = F.greatest(least_both("nb", "low") - F.col("both"), F.lit(1))
        prefix = F.slice(F.sort_array("added"), 1, F.greatest(F.size("added") - share + 1, F.lit(0)).cast("int"))
        keyed = told.select("a", F.col("b").alias("cls"), "of", F.col("both").alias("c"), F.explode(prefix).alias("t"))
        keyed = materialize(keyed.withColumn("bucket", F.xxhash64("a", "t")).drop("a", "t"), "keyed")
        mixed = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("of").alias("x"), F.max("of").alias("y")).where("x != y")
        rest = materialize(with_counted(keyed, mixed.select("bucket", "n"), ["bucket"]).withColumnRenamed("n", "g"), "rest")
        inside = told.where(~near & (F.col("both") >= least_both("nb", "low"))).select("a", F.col("b").alias("b1"), F.col("nb").alias("n1"), F.col("both").alias("i1"), F.col("of").alias("of1"))
        shorter = told.where("nb < na").select("a", F.col("b").alias("b2"), F.col("nb").alias("n2"), F.col("both").alias("i2"), F.col("of").alias("of2"))
        apart = inside.join(shorter, "a").where((F.col("of1") != F.col("of2")) & (least_both("n1", "n2") <= F.least("i1", "i2")))
        apart = apart.select(F.least("b1", "b2").alias("a"), F.greatest("b1", "b2").alias("b"))
        pairs = all_pairs(rest.where(F.col("g") <= SPLIT_BUCKET)).unionByName(apart)
        spent.extend([rest, stars, told, keyed])
        rest, leaders = materialize(rest.where(F.col("g") > SPLIT_BUCKET).select("bucket", "cls", "c"), "rest"), 8
        while True:
            tests, left = pairs, not rest.isEmpty()
            if left:
                top = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("c"), F.xxhash64("cls"), "cls"))
                chosen = materialize(rest.withColumn("rn", top).where(F.col("rn") <= leaders).select("bucket", F.col("cls").alias("leader")), "leaders")
                of_bucket = chosen.groupBy("bucket").agg(F.collect_list("leader").alias("all")).join(rest.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
                star = with_counted(rest, of_bucket, ["bucket"]).select("bucket", "cls", F.explode("all").alias("leader")).where("cls != leader")
                star = star.join(group.toDF("cls", "gc"), "cls", "left").join(group.toDF("leader", "gl"), "leader", "left")
                star = star.where(F.coalesce("gc", "cls") != F.coalesce("gl", "leader"))
                star = star.select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b"))
                tests = star if pairs is None else pairs.unionByName(star)
            if tests is None:
                return group
            new, pairs = materialize(confirmed(tests), "links"), None
            if not new.isEmpty():
                links = materialize(links.unionByName(new), "links")
                group = components(links)
            if not left:
                return group
            tested = rest.join(chosen, [rest["bucket"] == chosen["bucket"], rest["cls"] == chosen["leader"]], "left_anti")
            labelled = tested.join(group.toDF("cls", "of"), "cls", "left").withColumn("of", F.coalesce("of", "cls"))
            # the leaders have been tested against all others: a bucket whose other members are in one component is done
            mixed = labelled.groupBy("bucket").agg(F.min("of").alias("x"), F.max("of").alias("y")).where("x != y")
            rest, leaders = materialize(labelled.join(mixed, "bucket", "left_semi").select("bucket", "cls", "c"), "rest"), leaders * 8
            discard(spark, *spent)
            spent[:] = [rest, chosen]

    if stars is not None:
        group = further(links, group)
    discard(spark, *spent)
    mine = classes.join(group.toDF("cls", "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = mine.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = mine.join(least, "comp").select("cls", "component_id", "comp")
    more = ["mark"] if marked else []
    out = made.select("doc_id", "n_shingles", F.when(usable, F.xxhash64("k1", "k2", "n_shingles")).alias("cls"), *more).join(named, "cls", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept")
    return out.select("doc_id", "n_shingles", "component_id", kept, *more, *(["comp"] if marked else []))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all its columns, one of each group of near-duplicates: that of the smallest doc_id, of several texts under it the one of
    the smallest md5.

    Rows go by id and text together: a text that only shares its id with a duplicate stays. Of rows that repeat a kept id and text, one stays. Rows with a
    null doc_id stay.
    """
    got = materialize(near_duplicates(docs, k, percent, marked=True).where("doc_id is not null"), "verdicts")
    # two texts of one id in one component: all but the first go
    twice = got.where(F.col("kept") & F.col("comp").isNotNull()).groupBy("comp").agg(F.min("mark").alias("first"), F.max("mark").alias("last")).where("first != last")
    more = got.where("kept").join(twice.select("comp", "first"), "comp").where("mark != first")
    text = F.coalesce("mark", F.lit("")).alias("_text")
    gone = got.where(~F.col("kept")).unionByName(more.select(*got.columns)).select(F.col("doc_id").alias("_id"), text).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("_id", F.col("row.doc_id").cast("long")).withColumn("_text", F.coalesce(F.md5(F.col("row.text").cast("string")), F.lit("")))
    # one shuffle of the texts: what repeats an id and a text is next to it after the join
    rest = rows.where("_id is not null").join(gone, ["_id", "_text"], "left_anti").dropDuplicates(["_id", "_text"])
    return rest.unionByName(rows.where("_id is null")).select("row.*")
