"""The corpus pipeline: documents in, token ids out, each stage written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import jaccard, mixing, pieces, suffixes, toxicity
from kinfold.llm.blocks import bound_batches
from kinfold.session import materialize, scratch


# The columns a stage reads; all others travel under private names, so that none of them clashes with a stage's own.
_READ = ("doc_id", "text", "source")


def _private(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`").alias(c if c in _READ else f"__{i}") for i, c in enumerate(docs.columns)])


def _public(result: DataFrame, docs: DataFrame) -> DataFrame:
    return result.select(*[F.col(c if c in _READ else f"__{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or toxicity stays under one half; a text without words has none.

    Only the texts go through Python, not the other columns, and only a number comes back.
    """
    bound_batches(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = _private(docs).withColumn("__chance", toxicity.chance(model, F.col("text")))
    return _public(scored.where("__chance < 0.5"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more.

    Null texts and texts without words all stay.
    """
    return _public(jaccard.keep_one(_private(docs)), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of 200-byte strings that occur more than once; null texts stay null."""
    cut = suffixes.remove_repeats(_private(docs), as_text=True)
    cut = _public(cut.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept"))), docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them; those without words never."""
    return _public(mixing.mixture(_private(docs)), docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_pieces, ids`` of every document of the mix."""
    narrow = docs.select("doc_id", "source", "text")
    coded = pieces.encode(narrow, pieces.read_vocabulary(), keep=["doc_id", "source"])
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]

# The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with scratch(spark) as kept:  # what a stage wrote on the way goes once its result is written
            docs = kept(materialize(stage(spark, docs, sf_dir)))
    return docs
