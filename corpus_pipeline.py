"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but
the last return the columns of `documents`. Inside a stage columns have names of their own, so a
column of `docs` may have any name. A stage deletes what earlier ones have kept for themselves, once
their results are written; what `docs` still reads stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm import decontamination, packing, shingle_dedup, suffix_dedup, toxicity
from veriframe.llm.queries import WORD_VOCABULARY, table, tokenizer_path
from veriframe.llm.scratch import collected, release
from veriframe.session import configure, shared_folder

TOXIC_FROM = 0.3
# Bytes of a string that goes where it occurs again, chosen for passages of more than 50 words: 51 words
# that repeat across different documents at sf0.1 have a median of 313 bytes, 95 % of them at least 278.
PASSAGE_BYTES = 200
_made: list[str] = []  # folders of stages before


def _columns(docs: DataFrame, wanted: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """What `wanted` makes of the rows under names of their own, with the names they had."""
    release(docs, _made)
    own = [f"c{i}" for i in range(len(docs.columns))]
    name = dict(zip(docs.columns, own))
    with collected(_made):
        return wanted(docs.toDF(*own), name["doc_id"], name["text"]).select(*own).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC_FROM by models of all labelled documents; rows without text stay."""
    def clean(rows: DataFrame, doc_id: str, text: str) -> DataFrame:
        models = toxicity.fit(rows, table(spark, sf_dir, "labels").withColumnRenamed("doc_id", doc_id), doc_id=doc_id, text=text)
        scored = toxicity.score(rows, models, doc_id, text, keep=tuple(c for c in rows.columns if c != doc_id))
        blank = F.coalesce(F.trim(F.col(text)), F.lit("")) == ""
        return scored.where((F.col("score") < TOXIC_FROM) | blank).withColumnRenamed("doc_id", doc_id)

    return _columns(docs, clean)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with similar sets of five-word shingles: the one with the smallest doc_id."""
    return _columns(docs, lambda rows, doc_id, text: shingle_dedup.first_rows(rows, doc_id=doc_id, text=text))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of PASSAGE_BYTES that occur elsewhere; texts of which nothing is left go."""
    chars = f"c{docs.columns.index('n_chars')}" if "n_chars" in docs.columns else None

    def rest(rows: DataFrame, doc_id: str, text: str) -> DataFrame:
        cut = suffix_dedup.remove_repeats(rows, PASSAGE_BYTES, text, characters=True)
        left = F.when(F.col("n_removed") == 0, F.col(text)).otherwise(F.col("kept").cast("string"))
        out = cut.where("n_removed < n_bytes or n_bytes = 0").withColumn(text, left)
        if chars:
            number = F.when(F.col("n_removed") == 0, F.col(chars)).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
            out = out.withColumn(chars, number)
        return out

    return _columns(docs, rest)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = table(spark, sf_dir, "benchmark")
    return _columns(docs, lambda rows, doc_id, text: decontamination.without_leaks(rows, benchmark, text=text))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    release(docs, _made)
    return packing.pack(docs, tokenizer_path(WORD_VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Models, fingerprints, alignments and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written as Parquet and read again."""
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
