"""Queries of the subpackage: one for each operation, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import bpe, ctw, divergence, embeddings, fingerprints, language_id, minhash, packing, repeats, secrets, sharding, trie, wavelet
from tallyloom.llm.store import documents


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), n_shards=24)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(documents(spark, sf_dir))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.shared_prefixes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(documents(spark, sf_dir))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_packing, op3_token_output, op4_near_duplicates, op5_fingerprints, op6_secrets, op7_embeddings, op8_lm_scores, op9_language_id, op10_bpe, op11_prefix_trie, op12_repeated_passages, op13_source_divergence)
}

#: The smallest id that each node reaches over ``pairs(a, b)``, from ``nodes(id)``.
_REACHED = "reach(node, seen) as (select id, id from nodes union select p.b, r.seen from reach r join pairs p on r.node = p.a), least as (select node, min(seen) as component_id from reach group by node)"

#: DuckDB SQL for the queries whose whole result SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op4_near_duplicates": f"""with recursive
words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
 else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) end as s from words),
shingles as (select doc_id, len(s) as n, unnest(s) as s from sets),
shared as (select x.doc_id as a, y.doc_id as b, any_value(x.n) as n, any_value(y.n) as m, count(*) as c from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id),
pairs as (select a, b from shared where 100 * c >= 85 * (n + m - c)),
nodes as (select doc_id as id from documents), {_REACHED}
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept from sets join least on doc_id = node""",
    "op7_embeddings": f"""with recursive
vectors as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
live as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from vectors
 where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
pairs as (select x.vec_id as a, y.vec_id as b from live x join live y on x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.95),
nodes as (select vec_id as id from embeddings), {_REACHED},
links as (select a, count(*) as n from pairs group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from embeddings join least on vec_id = node left join links on vec_id = a""",
    "op11_prefix_trie": trie.SQL,
    "op12_repeated_passages": repeats.SQL,
    "op13_source_divergence": divergence.SQL,
}
