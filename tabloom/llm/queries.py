"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import bpe, linededup, minhash, mixing, quality, secrets, simhash, tokenbin, topk, warc

#: The name of the tokenizer file; ``tokenizer_path`` makes it a path.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_table(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("group").alias("class_id"), "n_links")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    texts = bpe.encode(table(spark, sf_dir, "documents"), path, decoded="text")
    line = F.array_join(F.col("ids").cast("array<string>"), " ")
    return texts.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(line.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.whole_numbers(F.col("embedding")).alias("vector"))
    return topk.search(vectors, F.col("vec_id") % 50 == 0)


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(table(spark, sf_dir, "pages"))
    found = warc.read(spark, index, payloads=False)
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = linededup.dedup_lines(docs, out="kept", short_lines=True)
    count = lambda c: F.size(F.split(F.coalesce(F.col(c), F.lit("")), "\n", -1)).cast("long")
    dropped = F.coalesce(count("text") - count("kept"), F.lit(0).cast("long"))
    return found.select("doc_id", count("text").alias("n_lines"), F.when(F.col("kept") == "", count("text")).otherwise(dropped).alias("n_dropped"), F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare(table(spark, sf_dir, "documents"), asks=F.col("id") % 20 == 0)


def held_out(doc_id):
    """Whether a row is kept from training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~held_out(F.col("doc_id"))))
    found = quality.score(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score")
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards, ranks = tokenbin.write(table(spark, sf_dir, "documents"), tokenizer_path())
    return tokenbin.read(spark, shards, ranks, "doc_id long, start long, n_tokens long, ids_crc32 long", tokenbin.digest)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_secrets, op2_near_copies, op3_bpe, op4_top_k, op5_mix, op6_warc, op7_lines, op8_fingerprints, op9_quality, op10_token_files, pipeline]
    return {f.__name__: f for f in found}
