"""The registered ``opN_*`` queries, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from quillon.llm import (
    ann,
    html_text,
    jaccard_join,
    mixing,
    neardup_vectors,
    packing,
    quality,
    sharding,
    suffix_dedup,
    warc,
)
from quillon.shipping import ship_package


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.jaccard_classes(_read(spark, sf_dir, "documents"), k=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


def op2_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(_read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_multinomial_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_documents(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the digest is of the cut at 400 bytes; the text, which follows it, also lacks repeated passages of fifty words
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.remove_repeats(docs, length=400, passage=suffix_dedup.PASSAGE)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


def op5_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the ids of byte_bpe_50k.json
    return packing.pack_documents(_read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"), n_shards=40)


def op9_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_read(spark, sf_dir, "pages"))


def op10_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_warc_normaliser": op2_warc_normaliser,
    "op3_multinomial_mix": op3_multinomial_mix,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_minimum_bin_slack": op5_minimum_bin_slack,
    "op6_collision_counting": op6_collision_counting,
    "op7_one_bit_codes": op7_one_bit_codes,
    "op8_feistel_shards": op8_feistel_shards,
    "op9_wrapper_induction": op9_wrapper_induction,
    "op10_positive_unlabelled": op10_positive_unlabelled,
}

ORACLES = {
    "op2_warc_normaliser": """
        with p as (
            select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d
            from pages),
        f as (select d, count(*) as c, min(page_id) as first_id from p where n >= 100 group by d)
        select p.page_id, cast(p.n as bigint) as payload_bytes, p.d as payload_digest,
               case when f.c > 1 and p.page_id <> f.first_id then 'revisit' else 'response' end as record_type,
               case when f.c > 1 and p.page_id <> f.first_id then f.first_id end as refers_to
        from p left join f on p.d = f.d and p.n >= 100
    """,
}

#: Links and components by brute force, for the small tables that the SQL is run on.
_COMPONENTS = """,
    ways as (select a, b from links union all select b, a from links),
    reach(n, c) as (select id, id from ids union select r.n, w.b from reach r join ways w on r.c = w.a),
    comp as (select n, min(c) as c from reach group by n),
    deg as (select a as n, count(*) as k from ways group by a)
"""
ORACLES["op1_jaccard_join"] = f"""
    with recursive w as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\\x20\\x09-\\x0D]+') as w from documents),
    s as (
        select distinct doc_id, array_to_string(w[i : i + 3], ' ') as s from w, unnest(range(1, len(w) - 2)) t(i) where len(w) >= 4
        union all select doc_id, array_to_string(w, ' ') from w where len(w) between 1 and 3),
    n as (select w.doc_id as id, count(s.s) as n from w left join s on w.doc_id = s.doc_id group by 1),
    ids as (select id from n),
    c as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.s = y.s and x.doc_id < y.doc_id group by all),
    links as (select a, b from c join n p on p.id = a join n q on q.id = b where 100 * k >= 85 * (p.n + q.n - k))
    {_COMPONENTS}
    select n.id as doc_id, n.n as n_shingles, comp.c as component_id, coalesce(deg.k, 0) as n_links
    from n join comp on comp.n = n.id left join deg on deg.n = n.id
"""
ORACLES["op6_collision_counting"] = f"""
    with recursive v as (
        select vec_id as id, embedding::double[] as e from embeddings where embedding is not null and len(embedding) > 0
          and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    ids as (select vec_id as id from embeddings),
    links as (select x.id as a, y.id as b from v x join v y on x.id < y.id and list_cosine_similarity(x.e, y.e) >= 0.9)
    {_COMPONENTS}
    select comp.n as vec_id, coalesce(deg.k, 0) as n_links, comp.c as component_id, comp.n = comp.c as kept
    from comp left join deg on deg.n = comp.n
"""
