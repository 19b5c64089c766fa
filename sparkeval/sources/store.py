"""Objects with verified digests, and the canonical export of a version.

An object is a row: key, bytes, their SHA-256, size and media type, in a Parquet table below a root
that any Spark file system can hold.  The digest is made while objects are written and compared with the
bytes whenever they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let

#: A key's segments: fixed rule, so that keys mean the same in every store.
SEGMENT = r"[A-Za-z0-9][A-Za-z0-9._=-]{0,199}"
KEY = rf"^{SEGMENT}(/{SEGMENT})*$"


def checked_key(key: Column) -> Column:
    """The key, or an error for one that is absolute, empty in a segment, too long or leads out of the store."""
    fine = key.rlike(KEY) & (F.length(key) <= 1000) & ~F.endswith(key, F.lit("\n"))
    return F.when(F.coalesce(fine, F.lit(False)), key).otherwise(F.raise_error(F.lit("invalid object key")))


def put_objects(objects: DataFrame, root: str, media_type: str = "application/octet-stream") -> DataFrame:
    """Writes ``key, body`` (and ``expected_sha256``, if there is such a column) and returns ``key, sha256, size, media_type``.

    A body that has not its expected digest fails the write.  A null body is refused as well.  Objects are not replaced: a key that is put again is there twice, and
    the digests tell whether both are the same.
    """
    body = F.coalesce(F.col("body").cast("binary"), F.raise_error(F.lit("an object has no body")).cast("binary"))
    rows = objects.select(checked_key(F.col("key")).alias("key"), body.alias("body"), *(["expected_sha256"] if "expected_sha256" in objects.columns else [])).withColumn("sha256", F.sha2("body", 256))
    if "expected_sha256" in objects.columns:
        same = F.coalesce(F.lower("expected_sha256") == F.col("sha256"), F.col("expected_sha256").isNull())
        rows = rows.withColumn("sha256", F.when(same, F.col("sha256")).otherwise(F.raise_error(F.lit("object content hash does not match expected hash")))).drop("expected_sha256")
    rows.withColumn("size", F.octet_length("body").cast("long")).withColumn("media_type", F.lit(media_type)).write.mode("append").parquet(f"{root}/objects")
    return objects.sparkSession.read.parquet(f"{root}/objects").select("key", "sha256", "size", "media_type")


def get_objects(spark: SparkSession, root: str, max_bytes: int = 1 << 30) -> DataFrame:
    """``key, body, sha256, size, media_type``; bytes that have not their digest, or are too many, fail the query.

    Filters by key reach the scan, so that one object is read without the others.
    """
    if max_bytes < 1:
        raise ValueError("max_bytes must be positive")
    good = F.when(F.octet_length("body") > max_bytes, F.raise_error(F.lit("object exceeds configured read limit"))).when(F.sha2("body", 256) == F.col("sha256"), F.col("body"))
    return spark.read.parquet(f"{root}/objects").withColumn("body", F.coalesce(good.cast("binary"), F.raise_error(F.lit("object checksum verification failed")).cast("binary")))


def canonical_lines(records: DataFrame) -> DataFrame:
    """``key, line``: each record of ``build_records`` as one canonical JSON object (names in order, no white space)."""
    whole = F.to_json(F.struct(F.col("key").alias("x")))
    name = let(whole, lambda j: F.substring(j, F.lit(6), F.length(j) - 6))  # the text's value, out of an object with one member
    parts = [
        F.lit('{"envelope_hash":"'), F.col("envelope_hash"), F.lit('","key":'), name, F.lit(',"metadata":'), F.col("metadata"), F.lit(',"payload":'), F.col("payload"),
        F.lit(',"payload_hash":"'), F.col("payload_hash"), F.lit('","splits":'), F.to_json("splits"), F.lit("}"),
    ]
    return records.select("key", F.concat(*parts).alias("line"))


def export_version(records: DataFrame, content_hash: str, root: str, version: str, part_rows: int = 100_000) -> DataFrame:
    """Writes the records of a version as canonical JSON lines in key order, in objects of about ``part_rows`` lines, with a manifest.

    Returns the manifest: ``key, sha256, size, first_key, position, etag``, one row for each object in order.  The version's ETag is
    ``"sha256:<content hash>"``; every object is named by the digest of its own bytes, so equal versions are equal objects.
    """
    spark = records.sparkSession
    lines = canonical_lines(records)
    parts = max(1, -(-records.count() // part_rows))
    dealt = lines.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id())
    whole = dealt.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("key", "line"))).alias("rows"))  # part_rows lines
    body = F.concat(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).cast("binary")
    made = whole.select(body.alias("body"), F.get("rows", F.lit(0))["key"].alias("first_key")).withColumn("key", F.concat(F.lit(f"exports/{version}/"), F.sha2("body", 256)))
    made.write.parquet(f"{root}/staged/{version}")
    staged = spark.read.parquet(f"{root}/staged/{version}")
    put = put_objects(staged, root, "application/x-ndjson").where(F.startswith("key", F.lit(f"exports/{version}/")))
    place = F.row_number().over(Window.orderBy("first_key"))  # a row for each object
    manifest = put.join(staged.select("key", "first_key"), "key").withColumn("position", place).withColumn("etag", F.lit(f'"sha256:{content_hash}"')).drop("media_type")
    manifest.coalesce(1).write.parquet(f"{root}/manifests/{version}")
    return spark.read.parquet(f"{root}/manifests/{version}")


def read_export(spark: SparkSession, root: str, version: str) -> DataFrame:
    """``position, line_number, line`` of an export, every object's bytes verified."""
    manifest = spark.read.parquet(f"{root}/manifests/{version}").select("key", "position")
    objects = get_objects(spark, root).where(F.startswith("key", F.lit(f"exports/{version}/"))).join(F.broadcast(manifest), "key")
    lines = F.split(F.regexp_replace(F.col("body").cast("string"), r"\n\z", ""), "\n")
    return objects.select("position", F.posexplode(lines).alias("line_number", "line"))
