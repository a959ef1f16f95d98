"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, langid, licenses, line_dedup, mixing, quality, superminhash, token_io, toxicity
from .common import fold_of, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda doc_id: fold_of(doc_id, 3) != 1)
    got = toxicity.score(docs, model)
    held = fold_of(F.col("key"), 3) == 1
    predicted = (F.col("score") >= toxicity.FLAG).cast("int")
    return got.select(F.col("key").alias("doc_id"), held.alias("held_out"), "score", predicted.alias("predicted"), "n_hits")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold_of(F.col("doc_id"), 4) != 2))
    got = langid.identify(docs, model)
    # the contract wants a learned language for every text with a letter; a rejected one is marked
    return got.select(F.col("key").alias("doc_id"), (fold_of(F.col("key"), 4) == 2).alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "rejected")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op7_token_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_io.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.taken(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_language_id, op3_quality_rules, op4_html_extraction, op5_decontamination,
        op6_line_dedup, op7_token_io, op8_mixing, op9_license_scan, op10_minhash_dedup,
    )
}

_WORDS = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = {
    # every pair of equal lines; pairs side by side in both texts make the maximal common runs
    "op6_line_dedup": rf"""
        with l as (
            select doc_id, u.i - 1 as line, u.t as text, len(regexp_extract_all(u.t, '{_WORDS}')) as n_words
            from documents, (select 1) one, lateral (select unnest(string_split(coalesce(text, ''), chr(10))) as t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i) u
        ),
        p as (
            select b.doc_id, b.line, b.n_words, a.doc_id as of_doc, b.line - a.line as shift from l a join l b
            on a.text = b.text and (a.doc_id < b.doc_id or (a.doc_id = b.doc_id and a.line < b.line))
        ),
        r as (select *, line - row_number() over (partition by doc_id, of_doc, shift order by line) as run from p),
        w as (select *, sum(n_words) over (partition by doc_id, of_doc, shift, run) as words from r),
        g as (select distinct doc_id, line from w where words >= {line_dedup.MIN_WORDS})
        select l.doc_id, count(*) as n_lines, count(g.line) as n_removed, cast(coalesce(sum(length(l.text)) filter (where g.line is null), 0) as bigint) as kept_chars
        from l left join g on l.doc_id = g.doc_id and l.line = g.line group by l.doc_id""",
    "op8_mixing": rf"""
        with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0)::bigint as size from documents),
        b as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % {mixing.CYCLE} + 1 as w from d group by source),
        o as (
            select *, row_number() over f as pos, (sum(source_size) over () - coalesce({mixing.MOST} * sum(source_size) over (f rows between unbounded preceding and 1 preceding), 0))::double
                / (sum(w) over (f rows between current row and unbounded following))::double as share
            from b window f as (order by source_size / w, source nulls last)
        ),
        k as (select min(pos) as pos, min_by(share, pos) as share from o where share * w <= {mixing.MOST} * source_size),
        t as (select o.source, o.source_size, coalesce(case when o.pos >= k.pos then k.share * o.w else ({mixing.MOST} * o.source_size)::double end, 0) as target from o, k),
        r as (select *, case when source_size > 0 then least(target / source_size, {mixing.MOST}.0::double) else 0 end as rate from t),
        u as (
            select d.doc_id, d.size, r.source, r.source_size, r.target, floor(r.rate)::bigint as whole, r.target - floor(r.rate)::bigint * r.source_size as wanted,
                ('0x' || substr(md5('{mixing.SEED}|' || d.doc_id), 1, 6))::bigint as n
            from d join r on d.source is not distinct from r.source
        ),
        v as (select source, n, sum(size) as words, any_value(wanted) as wanted, sum(sum(size)) over (partition by source order by n) as up_to from u group by source, n),
        c as (select source, case when wanted - (up_to - words) <= up_to - wanted then n else n + 1 end as threshold from v where up_to - words <= wanted and wanted < up_to)
        select doc_id, size, source_size, target, size * (whole + case when n < coalesce(threshold, 0) then 1 else 0 end) as taken
        from u left join c on u.source is not distinct from c.source""",
}
