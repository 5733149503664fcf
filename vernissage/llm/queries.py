"""The dealt operators as named queries over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vernissage.llm.alignment import linked_tokens
from vernissage.llm.chaining import fuzzy_passages
from vernissage.llm.decontaminate import contaminated
from vernissage.llm.extract import main_texts
from vernissage.llm.jaccard import jaccard_components
from vernissage.llm.langid import identify
from vernissage.llm.licences import licence_notices
from vernissage.llm.lm import scores
from vernissage.llm.lsh_forest import near_duplicates
from vernissage.llm.mixing import mixed_counts
from vernissage.llm.resample import resample
from vernissage.llm.store import read
from vernissage.llm.suffix_dedup import removed
from vernissage.llm.topk import scaled, top_k


def op1_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return removed(read(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op3_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licence_notices(read(spark, folder, "documents"))


def op4_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = scaled(read(spark, folder, "embeddings"))
    return top_k(vectors.filter("vec_id % 20 = 0"), vectors, 20)


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify(read(spark, folder, "documents"))


def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return scores(read(spark, folder, "documents"))


def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(read(spark, folder, "pages"))


def op8_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(read(spark, folder, "documents"), n_words=3, percent=90).select(
        "doc_id", "n_shingles", "component_id")


def op9_substring_chaining(spark: SparkSession, folder: str) -> DataFrame:
    return fuzzy_passages(read(spark, folder, "documents"))


def op10_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixed_counts(read(spark, folder, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return linked_tokens(read(spark, folder, "documents"))


def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resample(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "documents"))


def shingle_components(n_words: int, percent: int) -> str:
    """SQL for (doc_id, n_shingles, component_id): exact links of word shingles, then what they reach."""
    return f"""
        with recursive words as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
            from documents
        ), sets as (
            select doc_id, case when len(w) = 0 then [] when len(w) < {n_words} then [array_to_string(w, ' ')]
                   else list_distinct(list_transform(range(1, len(w) - {n_words} + 2),
                        lambda i: array_to_string(w[i:i + {n_words} - 1], ' '))) end as s
            from words
        ), one as (
            select distinct on (s) doc_id, len(s) as n, s from (select doc_id, list_sort(s) as s from sets where len(s) > 0) order by s, doc_id
        ), held as (
            select doc_id, n, unnest(s) as x from one
        ), links as (
            select a.doc_id as a, b.doc_id as b from held a join held b on a.x = b.x and a.doc_id < b.doc_id
            group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= {percent} * (a.n + b.n - count(*))
        ), both_ways as (
            select a, b from links union all select b, a from links
            union all select c.doc_id, o.doc_id from (select doc_id, list_sort(s) as s from sets where len(s) > 0) c join one o using (s)
            union all select o.doc_id, c.doc_id from (select doc_id, list_sort(s) as s from sets where len(s) > 0) c join one o using (s)
        ), reached as (
            select a as node, a as root from both_ways
            union
            select e.b, r.root from reached r join both_ways e on e.a = r.node
        )
        select s.doc_id, cast(len(s.s) as bigint) as n_shingles,
               coalesce((select min(root) from reached r where r.node = s.doc_id), s.doc_id) as component_id
        from sets s"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_licence_scan": op3_licence_scan,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_language_id": op5_language_id,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_html_extraction": op7_html_extraction,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_substring_chaining": op9_substring_chaining,
    "op10_source_mixing": op10_source_mixing,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_lsh_forest": op13_lsh_forest,
}
ORACLE: dict[str, str] = {
    "op8_ngram_jaccard_join": shingle_components(3, 90),
    "op13_lsh_forest": f"select *, doc_id = component_id as kept from ({shingle_components(5, 85)})",
    "op4_exact_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
            from embeddings
            where embedding is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select q.vec_id as query_id, d.vec_id,
                   cast(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) as bigint) as score
            from v q join v d on q.vec_id % 20 = 0 and d.vec_id <> q.vec_id
        ), ranked as (
            select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
        )
        select query_id, cast(rank as int) as rank, vec_id, score from ranked where rank <= 20""",
}
