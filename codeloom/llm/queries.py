"""The registered queries of the operators, one per operator, each over its whole table."""

from __future__ import annotations

import public_tokenizers

from codeloom.llm import (
    bpe_trie, conversation_trie, decontaminate, hamming_dedup, line_dedup, packing, quality, rp_forest, sharding, suffix_dedup, token_alignment,
    url_filter, vector_graph,
)
from codeloom.llm.base import table


def op1(spark, sf_dir):
    return vector_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2(spark, sf_dir):
    return rp_forest.nearest(table(spark, sf_dir, "embeddings"))


def op3(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4(spark, sf_dir):
    return bpe_trie.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5(spark, sf_dir):
    return line_dedup.dedup(table(spark, sf_dir, "documents"))


def op6(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8(spark, sf_dir):
    return hamming_dedup.find(table(spark, sf_dir, "documents"))


def op9(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12(spark, sf_dir):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.digests(table(spark, sf_dir, "documents"), *paths)


def op13(spark, sf_dir):
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_vector_graph": (op1, None),
    "op2_rp_forest": (op2, None),
    "op3_quality_knn": (op3, None),
    "op4_bpe_trie": (op4, None),
    "op5_line_suffix_array": (op5, line_dedup.SQL),
    "op6_feistel_shards": (op6, None),
    "op7_suffix_array": (op7, None),
    "op8_hamming_minhash": (op8, None),
    "op9_url_filter": (op9, None),
    "op10_best_fit_packing": (op10, None),
    "op11_suffix_automaton": (op11, None),
    "op12_perfect_hash_alignment": (op12, None),
    "op13_prefix_trie": (op13, None),
}


def all_queries():
    import corpus_pipeline

    return {name: fn for name, (fn, _) in QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def all_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
