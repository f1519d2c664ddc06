"""Registered queries of the operators for training text, by the contracts of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm import (
    alignment, decontamination, fingerprints, licenses, merkle, mixing, ngram_model, packing, quality, simhash_dedup, suffix_dedup,
    token_counts, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo; a missing id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus, F.lit(0))


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a field of lines fitted on labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 5) == 0).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    found = quality.score(docs, quality.fit(docs.where("not held_out"), labels), keep=("held_out",))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences and notices that a document is or has as lines."""
    return licenses.scan(table(spark, sf_dir, "documents"))


SQL["op2_licenses"] = licenses.oracle_sql()


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by two models of the labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 4) == 2).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    found = toxicity.score(docs, toxicity.fit(docs.where("not held_out"), labels), keep=("held_out",))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "difference")


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each text without strings of 400 bytes that start anywhere else, too."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a bigram model of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 7) == 2).alias("held_out"))
    return ngram_model.score(docs, ngram_model.train(docs.where("not held_out")), keep=("held_out",))


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' fingerprints beside those of their edited texts and of the next documents, and
    their classes of near fingerprints."""
    return fingerprints.with_classes(fingerprints.with_neighbours(table(spark, sf_dir, "documents")))


@query
def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates by 64-bit fingerprints at most four bits apart."""
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_dedup.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of the benchmark in any document, with at most a tenth of its characters edited."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_VOCABULARY))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of all documents."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_VOCABULARY))


@query
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash tree over all documents, and what it says of texts that have lost their line feeds."""
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    presented = merkle.leaf(*[F.col(f) for f in merkle.FIELDS[:-1]], text)
    found = merkle.manifest(docs, keep={"presented": presented})
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"),
        merkle.fold(F.col("presented"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


SQL["op11_manifest"] = merkle.oracle_sql()


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers meet in every document."""
    found = alignment.aligned(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_VOCABULARY), tokenizer_path(PIECE_VOCABULARY))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


@query
def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that a mix of their sources takes of them."""
    found = mixing.shares(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


SQL["op13_mixing"] = mixing.oracle_sql()
