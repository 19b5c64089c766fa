"""A corpus pipeline of five of the training-data operators.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``.  All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkeval.llm import decontam, pieces, quality, secrets, simhash
from sparkeval.llm.common import shared_dir, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality reaches 0.7 stay.

    Null and empty texts are scored as empty ones, texts of any length whole; a score of exactly 0.7 stays; rows with equal
    texts have equal scores, so repeated rows stay or go together; where there are too few labelled rows to learn from, all get the
    mean label; an empty table stays empty.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, out_col="__score").where(F.col("__score") >= 0.7).drop("__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id stays of each group of near copies: five-word shingles alike to 0.8.

    Rows with equal ids are one document and stay or go together; rows without an id stay.
    """
    groups = simhash.near_copies(spark, docs)
    gone = groups.groupBy("id").agg(F.max(F.col("id") == F.col("component_id")).alias("first")).where("not first")
    return docs.join(gone.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Rows without a text or an id stay; texts of any length are read whole, in passages; equal texts share their fate, and
    repeated rows stay or go together; an empty table, or an empty benchmark, changes nothing.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every secret in them is replaced by a mark.

    Null texts stay null (with null ``n_chars``) and empty ones empty; texts of any length are searched whole; of overlapping
    spans the union is replaced; repeated rows stay repeated, as the whole row is carried along; an empty table stays empty.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = secrets.find_secrets(docs.select(F.struct(*others, F.col("text").alias("__whole")).alias("row"), "text"), id_col="row")
    clean = secrets.redact(found)
    text = F.when(F.col("row.__whole").isNotNull(), F.col("redacted"))
    made = clean.select("row.*", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
    return made.select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether they decode to it again.

    Null and empty texts have no ids; texts of any length are encoded whole; repeated rows stay repeated; other columns than
    ``doc_id, lang, source, text`` are left out, so they can't clash; an empty table gives an empty result.
    """
    done = pieces.encode(docs.select("doc_id", "lang", "source", "text"), check_col="round_trip")
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", redact_secrets),
    ("sentencepiece", encode_pieces),
]

#: SQL can't express the compression classifier; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
