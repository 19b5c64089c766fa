"""Sinks: reports of a comparison, safe cells, atomic versions."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_ROWS = 10_000


def safe_cell(cell: Column) -> Column:
    """A text that a spreadsheet will not run: a leading = + - @, tab or return gets a quote before it."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def safe_table(rows: DataFrame) -> DataFrame:
    """All text columns made safe."""
    return rows.select([safe_cell(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in rows.schema.fields])


def write_csv(rows: DataFrame, path: str) -> None:
    safe_table(rows).write.mode("errorifexists").option("header", True).csv(path)


def _few(rows: DataFrame) -> list[dict]:
    """The rows of a report, a handful for each metric; more than ``REPORT_ROWS`` are refused."""
    got = rows.limit(REPORT_ROWS + 1).collect()
    if len(got) > REPORT_ROWS:
        raise ValueError("a report of that many rows has to be written as a table")
    return [r.asDict(recursive=True) for r in got]


def as_json(rows: DataFrame) -> str:
    return json.dumps(_few(rows), sort_keys=True, indent=2, default=str, ensure_ascii=False)


def _cell(v) -> str:
    return "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


def as_markdown(rows: DataFrame) -> str:
    names = rows.columns
    escape = lambda t: t.replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(map(escape, names)) + " |", "|" + " --- |" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(escape(_cell(r[n])) for n in names) + " |" for r in _few(rows)]) + "\n"


def as_html(rows: DataFrame, title: str = "Comparison") -> str:
    tag = lambda t, x: f"<{t}>{html.escape(x)}</{t}>"
    body = "".join("<tr>" + "".join(tag("td", _cell(r[n])) for n in rows.columns) + "</tr>" for r in _few(rows))
    head = "<tr>" + "".join(tag("th", n) for n in rows.columns) + "</tr>"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'>{tag('title', title)}</head><body>{tag('h1', title)}<table>{head}{body}</table></body></html>"


def publish_version(records: DataFrame, root: str, version: str, content_hash: str) -> DataFrame:
    """Writes a version's records, then its manifest, under a folder that must be new.

    A reader takes only versions with a manifest, so a failed write is never seen, and a
    published version can't be written again.
    """
    spark = records.sparkSession
    records.write.mode("errorifexists").parquet(f"{root}/version={version}/records")
    spark.createDataFrame([(version, content_hash)], "version string, content_hash string").coalesce(1).write.mode("errorifexists").parquet(f"{root}/version={version}/manifest")
    return read_version(spark, root, version)


def read_version(spark: SparkSession, root: str, version: str) -> DataFrame:
    """The records of a published version, with its digest."""
    manifest = spark.read.parquet(f"{root}/version={version}/manifest")
    return spark.read.parquet(f"{root}/version={version}/records").crossJoin(F.broadcast(manifest.select("content_hash").limit(1)))
