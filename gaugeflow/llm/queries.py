"""The registered queries of this subpackage, each over whole tables, and their SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm import alignment, covertree, fingerprint, idfiles, lexicon, neardup, packing, periodic, piecebpe, sharding, substring, tokencount, toxicity
from gaugeflow.llm.shared import new_folder, stored, tables


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tables(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.encode_decode(tables(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(tables(spark, sf_dir, "documents"), percent=85)


def op4_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(tables(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(tables(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(tables(spark, sf_dir, "documents")).drop("kept")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = covertree.whole_vectors(tables(spark, sf_dir, "embeddings"))
    return covertree.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op8_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "ids")
    idfiles.write_ids(tables(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    rows = stored(idfiles.read_ids(spark, folder), "decoded")  # the starts need them more than once
    return idfiles.with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32", F.col("file").alias("file"), "segment")


def op9_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(tables(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecebpe.encode_decode(tables(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(tables(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(tables(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


_ALL = (op1_packing, op2_bpe_codec, op3_near_duplicates, op4_multiset_hash, op5_token_counts, op6_substring_dedup, op7_exact_top_k, op8_id_files, op9_interleaved_shards, op10_toxicity, op11_piece_codec, op12_periodic_runs, op13_token_alignment)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op7_exact_top_k": covertree.ORACLE, "op9_interleaved_shards": sharding.ORACLE}
