"""The training-data pipeline over ``documents``: five stages, each written as Parquet and read by the next.

A stage gets the rows that the one before kept and returns the rows that it keeps, with the columns
of ``documents``; the last returns tokens. Verdicts are joined to rows by the text's MD5 (and the
language or the id, where the verdict depends on it), so rows without an id are judged like others.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import lsi_decontamination, quality_lm, secret_scan, sentencepiece_bpe, simhash_dedup
from shelfwise.llm.catalog import vocabulary
from shelfwise.session import scratch_path, stored
from shelfwise.sources.tables import table


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or as much longer that no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject."""
    key, lang = _free(docs, "__key"), _free(docs, "__lang")
    verdicts = quality_lm.classify(docs, table(spark, sf_dir, "labels"))
    rejected = verdicts.where(~F.col("kept")).select(F.col("key").alias(key), F.col("lang").alias(lang)).distinct()
    # a written table beside the rows, so Spark can split the rows of a text with very many copies
    rejected = stored(rejected, "rejected")
    rows = docs.withColumn(key, _key()).withColumn(lang, F.coalesce("lang", F.lit("")))
    return rows.join(rejected, [key, lang], "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: the one with the least id.

    Of several rows with this id and text, the least by their other columns in
    their order (a map column by its JSON) stays.
    """
    found = simhash_dedup.near_duplicates(docs, words=4, most=4)
    own, at = _free(docs, "__own"), _free(docs, "__id")
    stay = stored(simhash_dedup.representatives(found).select(F.col("doc_id").alias(at), F.col("key").alias(own)), "representatives")
    key, row = _free(docs, "__key"), _free(docs, "__row")
    rows = docs.withColumn(key, _key())
    rows = rows.join(stay, (F.col(key) == F.col(own)) & F.col("doc_id").eqNullSafe(F.col(at)), "left_semi")
    order = F.struct(*[F.to_json(c.name) if "map" in c.dataType.simpleString() else F.col(c.name) for c in docs.schema if c.name not in ("doc_id", "text")], F.lit(0))
    first = rows.groupBy("doc_id", key).agg(F.min_by(F.struct(*docs.columns), order).alias(row))
    return first.select(f"{row}.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no benchmark item away."""
    key = _free(docs, "__key")
    found = lsi_decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    leaks = stored(found.select(F.col("key").alias(key)).distinct(), "leaks")
    return docs.withColumn(key, _key()).join(leaks, key, "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; ``n_chars``, if there is such a column, counts the new text."""
    clean = secret_scan.redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decodes``: the ids of every document, and whether they decode to its text."""
    found = sentencepiece_bpe.encode_documents(docs, vocabulary("piece_bpe_32k.model"), check=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decodes")


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination),
          ("secret scans", secrets), ("SentencePiece encoding and decoding", tokens)]

#: SQL can express neither the language model nor the tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them goes when the application ends."""
    docs = table(spark, sf_dir, "documents")
    base = os.path.join(scratch_path(spark, "pipeline"), uuid.uuid4().hex)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(base)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
