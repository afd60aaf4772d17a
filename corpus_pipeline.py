"""A corpus pipeline: each stage reads what its predecessor kept and writes what it keeps.

``STAGES`` has (name, function) in order; a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of ``documents``. ``run`` applies them to ``documents``, each written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import bpe, linededup, minhash, mixing, quality
from tabloom.llm.common import private, written
from tabloom.llm.queries import held_out, tokenizer_path

#: Documents that score less are left out.
KEEP_FROM = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from labelled documents that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.where(~held_out(F.col("doc_id"))))
    score = private(docs.columns, "_quality_score")
    scored = quality.score(docs, model, out=score)
    return scored.where(F.col(score) >= KEEP_FROM).select(*[F.col(f"`{c}`") for c in docs.columns])


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` as the text has them now."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of repeated lines one occurrence stays; documents that lose all of theirs go."""
    return _counted(linededup.dedup_lines(docs, drop_empty=True, short_lines=True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, once for each epoch."""
    return _counted(mixing.take(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text's sha256 of each document of the mix."""
    path = tokenizer_path()
    texts = bpe.encode(docs, path, decoded="text")
    return texts.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("bpe", tokens),
]

#: SQL can express neither the classifier nor the verified similarity joins nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
