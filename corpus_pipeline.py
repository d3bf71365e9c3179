"""Corpus pipeline over ``documents``: language, repeated passages, near duplicates, secrets, packing.

Every stage reads what its predecessor kept and returns a DataFrame; all but the last keep the
columns of ``documents``. SQL cannot express the first stage, so there is no SQL for the result;
the stages are tested against brute force.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import jaccard, language, lines, packing, secrets
from tidepanel.session import checkpoint_dir, cut_lineage, shuffles_deleted

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _as_reports(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed({"doc_id": "external_id", "text": "content_text", "lang": "language"})


def _as_documents(reports: DataFrame) -> DataFrame:
    named = reports.withColumnsRenamed({"external_id": "doc_id", "content_text": "text", "language": "lang"})
    return named.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any text in a language (null, no letter) go; the others get the predicted ``lang``,
    or keep the given one where no document has a label to learn from."""
    reports = _as_reports(docs.select(*COLUMNS)).withColumnRenamed("language", "given")
    labelled = reports.where(F.col("given") != language.UNKNOWN)  # that label says that there is none
    learnt = language.language_profiles(labelled, language_col="given").select("language", "profile").collect()  # a row per language
    nameless = [("", [0.0] * language.DIMENSIONS)]  # what any text with a letter comes nearest to
    profiles = spark.createDataFrame(learnt or nameless, "language string, profile array<double>")
    found = language.predict_language(reports, profiles, keep=["external_id", "content_text", "source", "given"])
    found = found.where(F.col("language") != language.UNKNOWN)
    return _as_documents(found.drop("given") if learnt else found.withColumn("language", F.col("given")).drop("given"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of two lines or more that stand earlier are cut out; documents left without text go."""
    return _as_documents(lines.drop_repeated_passages(_as_reports(docs.select(*COLUMNS))).where(r"content_text rlike '\\S'"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that link by five-word shingles at 0.8, the one with the least id stays (null ids last, of
    equal ids any one), whatever other rows share its id."""
    reports = _as_reports(docs.select(*COLUMNS)).withColumn("_row", F.monotonically_increasing_id())
    reports = cut_lineage(reports)  # stored, so that a row keeps its number
    place = F.struct(F.col("external_id").isNull().alias("last"), F.col("external_id").alias("id"), F.col("_row").alias("row"))
    groups = jaccard.near_duplicates(reports.select(place.alias("external_id"), "content_text"))
    keepers = groups.where("external_id.row = group_id.row").select(F.col("external_id.row").alias("_row"))
    return _as_documents(reports.join(keepers, "_row", "left_semi"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind; every document stays."""
    return _as_documents(secrets.redact_reports(_as_reports(docs.select(*COLUMNS))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: one row per piece of a document."""
    out = packing.pack_reports(_as_reports(docs.select(*COLUMNS)), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumnsRenamed({"external_id": "doc_id", "report_tokens": "doc_tokens"})


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", one_of_each_group),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again. A stage's table is
    deleted when the next one is written; the last one stays, as the result reads it."""
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        kept = stage(spark, docs, sf_dir)
        with shuffles_deleted(spark):
            kept.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        before = path
    return docs
