"""Sources: the four import formats, envelopes, limits, pages, and a deterministic fake provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``row, line, valid``: physical line numbers from 1, a byte-order mark removed, blank lines skipped.

    A line is valid if it is a JSON object without repeated keys at any depth.  Line numbers
    are counted file by file from per-partition counts, so no task sees more than its lines.
    """
    # one partition for each file keeps the physical order of its lines
    lines = spark.read.option("wholetext", False).text(path).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    part = lines.withColumn("part", F.spark_partition_id())
    sizes = part.groupBy("file", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("file", "part").orderBy("at"))
    row = part.withColumn("local", local).join(F.broadcast(bases.select("file", "part", "base")), ["file", "part"])
    line = F.regexp_replace("value", "^\ufeff", "")
    return row.select((F.col("base") + F.col("local")).alias("row"), line.alias("line")).where(F.trim("line") != "").withColumn("valid", is_object(F.col("line")))


def is_object(line: Column) -> Column:
    """Whether a text is a JSON object; repeated keys make it invalid."""
    parsed = F.try_parse_json(line)
    return parsed.isNotNull() & F.schema_of_variant(parsed).startswith("OBJECT")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, a header required; a repeated header name fails."""
    head = spark.read.text(path).limit(1).first()
    names = [c.strip().strip('"') for c in (head[0].removeprefix("\ufeff").split(",") if head else [])]
    if not names or len(set(names)) < len(names):
        raise ValueError("the header is missing or repeats a name")
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A root array, or an object with an array ``records``: ``row, line`` from 1."""
    whole = spark.read.option("wholetext", True).text(path)
    v = F.try_parse_json("value")
    items = F.coalesce(F.try_variant_get(v, "$.records", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    return whole.select(F.posexplode(items).alias("pos", "item")).select((F.col("pos") + 1).cast("long").alias("row"), F.to_json("item").alias("line"))


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``row, line``: any of jsonl, csv, json and parquet as JSON objects."""
    if kind == "jsonl":
        rows = read_jsonl(spark, path)
        return rows.select("row", F.when(F.col("valid"), F.col("line")).otherwise(F.raise_error(F.concat(F.lit("line "), F.col("row").cast("string"), F.lit(" is no valid object")))).alias("line"))
    if kind == "json":
        return read_json(spark, path)
    table = read_csv(spark, path) if kind == "csv" else spark.read.parquet(path)
    numbered = table.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"), F.monotonically_increasing_id().alias("at"))
    part = numbered.withColumn("part", F.spark_partition_id())
    sizes = part.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("part").orderBy("at"))
    first = 2 if kind == "csv" else 1
    return part.withColumn("local", local).join(F.broadcast(bases), "part").select((F.col("base") + F.col("local") + (first - 1)).alias("row"), "line")


def normalize_envelope(rows: DataFrame) -> DataFrame:
    """``row, key, payload, metadata, splits`` of (row, line).

    A line with ``key`` and ``payload`` is an envelope; else its ``id``, or the row number, is
    the key, and the rest is the payload.  A line or a payload that is no JSON object fails the query with its row.
    """
    fault = lambda text: F.raise_error(F.concat(F.lit(f"{text}: row "), F.col("row").cast("string"))).cast("string")
    v = F.try_parse_json("line")
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    enveloped = F.map_contains_key(fields, "key") & F.map_contains_key(fields, "payload")
    key = F.when(enveloped, F.try_variant_get(v, "$.key", "string")).otherwise(F.coalesce(F.try_variant_get(v, "$.id", "string"), F.col("row").cast("string")))
    rest = F.to_json(F.map_filter(fields, lambda k, _: k != "id"))
    given = F.try_variant_get(v, "$.payload", "variant")
    object_of = F.when(F.schema_of_variant(given).startswith("OBJECT"), F.to_json(given)).otherwise(fault("a record's payload must be an object"))
    payload = F.when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), F.when(enveloped, object_of).otherwise(rest)).otherwise(fault("a record must be a JSON object"))
    metadata = F.when(enveloped, F.coalesce(F.to_json(F.try_variant_get(v, "$.metadata", "variant")), F.lit("{}"))).otherwise(F.lit("{}"))
    splits = F.coalesce(F.try_variant_get(v, "$.splits", "array<string>"), F.array().cast("array<string>"))
    return rows.select("row", key.alias("key"), payload.alias("payload"), metadata.alias("metadata"), F.when(enveloped, splits).otherwise(F.array().cast("array<string>")).alias("splits"))


def check_limit(rows: DataFrame, max_records: int = 1_000_000) -> DataFrame:
    """Fails if there are more than ``max_records`` rows; reads at most one more than that."""
    if rows.limit(max_records + 1).count() > max_records:
        raise ValueError(f"more than {max_records} records")
    return rows


def check_bytes(spark: SparkSession, path: str, max_bytes: int = 100 << 20) -> int:
    """The size of the files at ``path``; fails beyond ``max_bytes``."""
    size = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if size > max_bytes:
        raise ValueError(f"{size} bytes are more than {max_bytes}")
    return size


def keyset_page(rows: DataFrame, key: str, after, n: int) -> DataFrame:
    """The ``n`` rows after a key, in its order, and one more if another page follows."""
    return rows.where(F.col(key) > after).orderBy(key).limit(n + 1)


def token_estimate(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.expr("1") * F.floor(F.octet_length(text) / 4).cast("long")))


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def fake_generate(
    rows: DataFrame, identifier: str, seed: int, responses: dict[str, str] | None = None, separator: str = "\0", stop: tuple[str, ...] = (), failures: dict[str, str] | None = None
) -> DataFrame:
    """Deterministic responses: a recorded one, or the prompt itself, trimmed, behind ``fake:``, up to the first of each ``stop``.

    With ``failures`` (a kind of error for a prompt) there is a column ``error``, and a prompt that fails has no response, tokens or request.
    """
    prompt = F.col("prompt")
    response = F.concat(F.lit("fake:"), F.btrim(prompt, F.lit(SPACES)))
    if responses:
        response = F.coalesce(_lookup(responses, prompt), response)
    for mark in filter(None, stop):
        response = F.substring_index(response, mark, 1)
    digest = F.substring(F.sha2(F.concat(F.lit(identifier), F.lit(separator), prompt, F.lit(separator), F.lit(str(seed))), 256), 1, 24)
    made = {"response": response, "input_tokens": token_estimate(prompt), "output_tokens": token_estimate(response), "request_id": F.concat(F.lit("fake-"), digest)}
    if not failures:
        return rows.select("*", *[c.alias(n) for n, c in made.items()])
    error = _lookup(failures, prompt)
    return rows.select("*", *[F.when(error.isNull(), c).alias(n) for n, c in made.items()], F.concat(F.lit("scripted fake failure: "), error).alias("error"))


def fake_embed(rows: DataFrame, dimensions: int, separator: str = "\0") -> DataFrame:
    """Unit vectors from digests of the text."""

    def raw(i: Column) -> Column:
        h = F.substring(F.sha2(F.concat(i.cast("string"), F.lit(separator), F.col("text")), 256), 1, 16)
        return F.conv(h, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64 - 1)) * 2 - 1

    made = rows.withColumn("raw", F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), raw))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda acc, x: acc + x * x))
    return made.withColumn("norm", norm).withColumn("vector", F.transform("raw", lambda x: F.try_divide(x, F.col("norm")))).drop("raw", "norm")


def benchmark_cases(rows: DataFrame) -> DataFrame:
    """``id, category, prompt, accepted_answers``, trimmed.

    Null, empty or repeated ids, null or empty categories, prompts and answers, cases without answers, and a table of fewer than two cases fail.
    """
    strip = lambda c: F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACES))
    answers = F.transform(F.coalesce("accepted_answers", F.array().cast("array<string>")), strip)
    trimmed = rows.select(*[strip(F.col(c)).alias(c) for c in ("id", "category", "prompt")], answers.alias("accepted_answers"))
    if len(trimmed.take(2)) < 2:
        raise ValueError("a benchmark has at least two cases")
    ids = trimmed.groupBy("id").agg(F.count("*").alias("c"))
    blank = (F.col("category") == "") | (F.col("prompt") == "") | (F.size("accepted_answers") == 0) | F.exists("accepted_answers", lambda a: a == "")
    fault = F.when(F.col("id") == "", "a case id is empty").when(F.col("c") > 1, "a case id is repeated").when(blank, "a case has an empty field")
    checked = trimmed.join(ids, "id").withColumn("id", F.when(fault.isNull(), F.col("id")).otherwise(F.raise_error(F.concat(fault, F.lit(": "), F.col("id")))))
    return checked.drop("c")
