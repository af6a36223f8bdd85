"""The training-data operators' queries over whole tables, with production parameters, and SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_text, media, near_dup, packing, quality, sharding, suffix_dedup, tokens, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.histogram(tokens.counts(table(spark, sf_dir, "documents")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stored(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, [*url_filter.CONTRACT_RULES, *url_filter.OWN_RULES]).select("page_id", "host", "path", "rule", "verdict")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.media_columns(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_token_counts": op2_token_counts,
    "op3_sharding": op3_sharding,
    "op4_url_filters": op4_url_filters,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_media_columns": op10_media_columns,
}

ORACLES: dict[str, str] = {
    "op5_minhash_near_dedup": r"""
        with recursive w as (
            select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
        ), s as (
            select distinct doc_id, array_to_string(w[p : p + least(len(w), 4) - 1], ' ') as s
            from (select doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) as p from w where len(w) > 0)
        ), n as (
            select doc_id, count(*) as n from s group by doc_id
        ), met as (
            select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all
        ), link as (
            select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)
        ), edge as (
            select a, b from link union all select b, a from link
        ), reach as (
            select doc_id as id, doc_id as r from documents
            union
            select reach.id, edge.b from reach join edge on reach.r = edge.a
        ), best as (
            select id, min(r) as component_id from reach group by id
        )
        select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, doc_id = component_id as kept
        from documents left join n using (doc_id) join best on best.id = doc_id
    """,
    "op6_benchmark_decontamination": r"""
        with low as (
            select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents
        ), item as (
            select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark
        ), win as (
            select distinct item_id, n, array_to_string(w[p : p + n - 1], ' ') as win
            from (select item_id, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p from item where len(w) > 0)
        ), seen as (
            select doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') as win
            from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from low, (select distinct n from win) where len(w) >= n)
        ), hit as (
            select doc_id, p, seen.n, item_id from seen join win on seen.win = win.win and seen.n = win.n
        ), pos as (
            select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hit) group by doc_id
        ), items as (
            select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as s from (select distinct doc_id, cast(item_id as varchar) as i from hit) group by doc_id
        )
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from low left join pos using (doc_id) left join items using (doc_id)
    """,
    "op4_url_filters": r"""
        with u as (
            select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
        ), h as (
            select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) as path
            from u
        ), r(rhost, rpath, v) as (
            values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
        ), m as (
            select h.page_id, max_by(rhost || rpath, length(rhost || rpath)) as rule, max_by(v, length(rhost || rpath)) as v
            from h join r on (h.host = r.rhost or ends_with(h.host, '.' || r.rhost)) and starts_with(h.path, r.rpath)
            group by h.page_id
        )
        select h.page_id, h.host, h.path, m.rule,
               coalesce(m.v, case when regexp_matches(h.host, '(^|[^a-z0-9])(porn|xxx|casino|doubleclick|adserver|malware|warez|phishing)([^a-z0-9]|$)') then 'block' else 'allow' end) as verdict
        from h left join m using (page_id)
    """,
}
