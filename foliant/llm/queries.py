"""Queries of the training-data operators over the whole tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import embedding_dedup, exact_dedup, fingerprint, langid, license_scan, lm_score, mixing, ngram_join, packing, quality, retention, url_filter, whitening
from foliant.llm.common import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(_documents(spark, sf_dir))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_documents(spark, sf_dir))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(_documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predict(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "links")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_documents(spark, sf_dir))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_documents(spark, sf_dir))
    return found.withColumn("families", F.array_join("families", ","))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(table(spark, sf_dir, "embeddings"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.found_by_row(table(spark, sf_dir, "embeddings"))


def op13_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.cells(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "clients"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_language_id,
        op3_fingerprints,
        op4_quality,
        op5_ngram_join,
        op6_exact_dedup,
        op7_lm_score,
        op8_url_filter,
        op9_packing,
        op10_license_scan,
        op11_whitening,
        op12_embedding_dedup,
        op13_retention,
        pipeline,
    )
}

_SIZE = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"
MIX = rf"""
with docs as (select doc_id, source, {_SIZE}::bigint as size from documents),
sizes as (select source, sum(size)::bigint as source_size from docs group by source),
ranked as (select *, row_number() over (order by source nulls last) - 1 as place from sizes),
limits as (
  select *, case place % 3 when 0 then 1.0::double when 1 then 2.0::double else 3.0::double end as weight,
    source_size * 3.0::double as cap
  from ranked),
cut as (
  select *,
    coalesce(sum(cap) over w, 0.0::double) as capped, coalesce(sum(weight) over w, 0.0::double) as weight_before,
    sum(source_size) over () as everything, sum(weight) over () as weights
  from limits window w as (order by cap / weight, place rows between unbounded preceding and 1 preceding)),
levels as (select *, (everything - capped) / (weights - weight_before) as level from cut),
found as (select *, max(level) over () as best from levels),
rated as (
  select source, source_size, least(cap, weight * best) as target,
    ('0x' || substr(md5('mix:' || coalesce(source, '') || case when source is null then '?' else '!' end), 1, 8))::ubigint / 4294967296.0::double as shift
  from found),
placed as (
  select d.doc_id, d.size, r.source_size, r.target, r.shift,
    least(3.0::double, case when r.source_size > 0 then r.target / r.source_size else 0 end) as rate,
    row_number() over (partition by d.source order by d.size, d.doc_id nulls first) - 1 as n
  from docs d join rated r on d.source is not distinct from r.source)
select doc_id, size, source_size, target,
  ((floor(rate * (n + 1) + shift) - floor(rate * n + shift)) * size)::bigint as taken
from placed
"""
DEDUP = """
with docs as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents),
grouped as (select norm, max(doc_id) as keep_id, count(*) as group_size from docs group by norm)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.norm) as text_sha256
from docs d join grouped g using (norm)
"""
ORACLE = {"op1_mix_sources": MIX, "op6_exact_dedup": DEDUP, "op8_url_filter": url_filter.ORACLE, "op13_retention": retention.ORACLE}
