"""Registered queries of the operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm import (
    bag_ranking, collocations, decontaminate, language_crf, line_spread, personal_data, piece_codec, simhash, suffix_dedup, toxicity, url_filter,
    vector_topk, wavelet,
)

URL_RULES = (("com/", url_filter.ALLOW), ("example.com/en/", url_filter.BLOCK), ("www.example.com/en/", url_filter.ALLOW), ("net/es/", url_filter.BLOCK), ("net/fr/", url_filter.BLOCK))
# Sites that are never wanted, whatever their top-level name.
LISTED_SITES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_KEYS = tuple(f"{name}.example.{top}/" for name, top in product(LISTED_SITES, ("com", "net", "org")))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_url_filter(spark, sf):
    keys = spark.createDataFrame([*URL_RULES, *((k, url_filter.LISTED) for k in LISTED_KEYS)], "key string, kind int")
    judged = url_filter.judge_urls(table(spark, sf, "pages"), url_filter.build_digests(keys))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; it is installed with Python on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_wavelet_ids(spark, sf):
    return wavelet.corpus_ids(table(spark, sf, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_piece_round_trip(spark, sf):
    return piece_codec.round_trip(table(spark, sf, "documents"), tokenizer_file("piece_bpe_32k.model"), [F.col("doc_id")])


def op4_language_crf(spark, sf):
    return language_crf.identify(table(spark, sf, "documents"))


def op5_suffix_dedup(spark, sf):
    return suffix_dedup.dedup_substrings(table(spark, sf, "documents"))


def op6_simhash(spark, sf):
    groups = simhash.linked_groups(table(spark, sf, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_decontamination(spark, sf):
    """One row per contaminated document and item; other documents do not appear."""
    return decontaminate.overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op8_toxicity_crf(spark, sf):
    return toxicity.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op9_vector_topk(spark, sf):
    vectors = vector_topk.scaled(table(spark, sf, "embeddings"))
    return vector_topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op10_line_spread(spark, sf):
    out = line_spread.strip_lines(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_bag_ranking(spark, sf):
    return bag_ranking.rank_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_personal_data(spark, sf):
    return personal_data.span_digest(table(spark, sf, "documents"))


def op13_collocations(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_wavelet_ids, op3_piece_round_trip, op4_language_crf, op5_suffix_dedup, op6_simhash, op7_decontamination, op8_toxicity_crf,
    op9_vector_topk, op10_line_spread, op11_bag_ranking, op12_personal_data, op13_collocations,
)}
