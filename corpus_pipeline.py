"""Corpus pipeline: quality filter, near duplicates, secrets, source mixing, encoding.

Each stage is ``(name, function)`` with ``function(spark, docs, sf_dir)``, takes
what the one before kept and has its decisions take effect:

1. ``quality``: boosted trees score every text; documents below 0.3 go.
2. ``near_duplicates``: one document (the smallest doc_id) of each class of
   documents with similar five-word sets stays; documents without words stay.
3. ``secrets``: secrets in a text are replaced by a mark; no document goes.
4. ``mix``: each document appears as often as the mix takes it, up to twice.
5. ``encode``: ids of every text, and their decoding, as digests.

All but the last return the columns of ``documents``. Every function works on whole
tables of any size, and on an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.llm import boosting, mixing, ngram_join, piece_bpe, secret_scan
from pairlight.scratch import keep, sweep, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    forest = boosting.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = boosting.score(docs, forest, docs.columns, "__score")
    return scored.where(F.col("__score") >= boosting.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, told by doc_id and text; rows without a doc_id stay.

    Rows that share doc_id and text are one document, and of those the first row by the
    JSON of all its columns stays, so reruns agree.
    """
    classes = keep(ngram_join.near_duplicates(docs).select("doc_id", "stays", "text_key"), "pipeline-classes")
    told = classes.where("doc_id is not null").groupBy(F.col("doc_id").alias("__told"), F.col("text_key").alias("__told_key")).agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    keyed = docs.withColumn("__text", F.xxhash64("text"))
    same = (F.col("doc_id") == F.col("__told")) & (F.col("__text") == F.col("__told_key"))
    gone, repeated = told.where("not stays"), told.where("stays and n > 1")
    if not repeated.limit(1).count():
        return keyed.join(gone, same, "left_anti").drop("__text")
    alone = keyed.join(told.where("not stays or n > 1"), same, "left_anti").drop("__text")
    first = F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*[c for c in docs.columns if c != "text"])))
    return alone.unionByName(keyed.join(repeated, same, "left_semi").groupBy("doc_id", "__text").agg(first.alias("row")).select("row.*"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced and n_chars counted again."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixing.pareto_mix(docs, carry=True).where("copies > 0")
    return taken.select("document.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).drop("__copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text."""
    return piece_bpe.encode_digest(docs, piece_bpe.model_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("encode", encode)]
#: A trained model and exact encoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it; tables that no later stage reads are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = written()
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        sweep(spark, before, but=1)
    return STAGES[-1][1](spark, docs, sf_dir)
