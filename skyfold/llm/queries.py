"""The registered queries of the document operators, each over its whole table, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from skyfold.llm.bpe import bpe_decode, bpe_encode
from skyfold.llm.checks import CHECKS  # noqa: F401  (the entry reads it here)
from skyfold.llm.common import frozen, text_of, words_of
from skyfold.llm.exact_dedup import exact_duplicates
from skyfold.llm.jaccard_join import jaccard_groups
from skyfold.llm.language import fold, predict, train
from skyfold.llm.lm_scoring import word_lm_scores
from skyfold.llm.mixing import mixing_counts
from skyfold.llm.pii import KINDS, find_personal_data
from skyfold.llm.prefix_trie import grafted_turns, prefix_trie, ranked_turns
from skyfold.llm.quality import quality_verdicts
from skyfold.llm.sharding import byte_shards, utf8_size
from skyfold.llm.substring_dedup import substring_dedup
from skyfold.llm.suffix_dedup import suffix_dedup
from skyfold.llm.whitening import fit, identity_error, whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ranks_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def sha256(text):
    return F.sha2(text.cast("binary"), 256)


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(fold() != 2), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score")


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_encode(documents(spark, sf_dir).select("doc_id", "text"), ranks_path(), public_tokenizers.PATTERN)
    read = bpe_decode(coded.select("doc_id", "ids"), ranks_path())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return read.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256(ids).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_mixing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_of("text")
    rows = documents(spark, sf_dir).select("doc_id", F.crc32(text.cast("binary")).alias("crc"), "source", F.size(words_of(text)).cast("long").alias("size"))
    mixed = mixing_counts(rows, "source", "size", ["doc_id", "crc", "size"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", sha256(F.col("kept_text")).alias("kept_sha256"))


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    return jaccard_groups(rows).select(F.col("_id").alias("doc_id"), "n_shingles", "component_id")


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", utf8_size().alias("size"), F.crc32(text_of("text").cast("binary")).alias("text_crc32"))
    shards = byte_shards(rows, "size", ["doc_id", "text_crc32", "size"], 16)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def span_list(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, sha256(span_list(base)).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


@query
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = word_lm_scores(documents(spark, sf_dir).select("doc_id", "text"))
    return scored.select("doc_id", "n_words_scored", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 9).alias("mean_log_score"))


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", sha256(F.col("normal_text")).alias("text_sha256"))


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is NULL beyond a long, then see ``deviation_exact``."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = fit(rows, "embedding")
    found = whiten(rows, "embedding", model)
    shares = F.array(*[F.lit(e) for e in (model.explained if model else [])[:32]]).cast("array<double>")
    parts = found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return parts.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"),
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(identity_error(found)).alias("identity_error"),
        F.col("deviation").alias("deviation_exact"),
    )


@query
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = frozen(ranked_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    turns, convs = grafted_turns(ranked, F.col("conv_id") - F.col("conv_id") % 5, head, 8)
    return prefix_trie(turns, convs)
