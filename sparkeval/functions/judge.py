"""Judge responses under a strict contract, and the prompt that asks for them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .canonical import loads

FIELDS = {"schema_version", "verdict", "scores", "confidence", "evidence", "justification", "abstention_reason"}
VERDICTS = {"A", "B", "tie", "abstain"}
VERSION = "judge-response/1"  # a fixed value of the contract


def check(text: str, dimensions: dict[str, tuple[float, float]], evidence: list[str], version: str | None = None) -> dict:
    """The response as a dict; ``ValueError`` names what breaks the contract.  With ``version``, that of the response has to be it."""
    fence = re.fullmatch(r"\s*```(?:json)?\s*\n(.*?)\n?```\s*", text, re.S)
    r = loads(fence[1] if fence else text)
    if not isinstance(r, dict) or set(r) - FIELDS or FIELDS - {"abstention_reason"} - set(r):
        raise ValueError("fields")
    if version is not None and r["schema_version"] != version:
        raise ValueError("schema version")
    if r["verdict"] not in VERDICTS:
        raise ValueError("verdict")
    if not isinstance(r["scores"], dict) or set(r["scores"]) != set(dimensions):
        raise ValueError("dimensions")
    if any(not lo <= r["scores"][d] <= hi for d, (lo, hi) in dimensions.items()):
        raise ValueError("score range")
    if not 0 <= r["confidence"] <= 1:
        raise ValueError("confidence range")
    if len(set(r["evidence"])) < len(r["evidence"]) or set(r["evidence"]) - set(evidence):
        raise ValueError("evidence")
    if not str(r["justification"]).strip():
        raise ValueError("justification")
    if (r["verdict"] == "abstain") != bool(r.get("abstention_reason")):
        raise ValueError("abstention reason")
    return r


def parse_responses(rows: DataFrame, dimensions: dict[str, tuple[float, float]], evidence: list[str], column: str = "response", version: str | None = None) -> DataFrame:
    """``rows`` with verdict, confidence, scores, evidence and error; a bad response has the error alone."""
    schema = "verdict string, confidence double, scores map<string,double>, evidence array<string>, error string"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != column)
    others = [c for c in rows.columns if c != column]

    def run(parts):
        for pdf in parts:
            out = []
            for t in pdf[column]:
                try:
                    r = check(t, dimensions, evidence, version)
                    out.append((r["verdict"], float(r["confidence"]), {d: float(v) for d, v in r["scores"].items()}, list(r["evidence"]), None))
                except (ValueError, TypeError, KeyError) as e:
                    out.append((None, None, None, None, str(e)[:100]))
            made = pd.DataFrame(out, columns=["verdict", "confidence", "scores", "evidence", "error"], index=pdf.index)
            yield pd.concat([pdf[others], made], axis=1)

    return rows.mapInPandas(run, f"{kinds}, {schema}")


def envelope(text: Column, side: str, nonce: str) -> Column:
    """A judged answer with numbered lines between marks that only the nonce's owner can write."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.concat(F.format_string(f"{side}:L%04d ", i + 1), x))
    head = F.concat(F.lit(f"<<{side} {nonce} bytes="), F.octet_length(text).cast("string"), F.lit(">>\n"))
    return F.concat(head, F.array_join(lines, "\n"), F.lit(f"\n<</{side} {nonce}>>"))


def nonce(identifier: str, version: str, seed: Column, repetition: Column) -> Column:
    """The mark of one repetition: 32 hex digits that depend on the judge and its seed alone."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(identifier), F.lit(version), seed.cast("string"), repetition.cast("string")), 256), 1, 32)


def retry_delay(seed: Column, repetition: Column, attempt: Column, timeout_seconds: float) -> Column:
    """Seconds before an attempt (from 1): doubled each time, with a jitter of up to one second from a digest, at most half the timeout."""
    digest = F.sha2(F.concat_ws("|", seed.cast("string"), repetition.cast("string"), attempt.cast("string")), 256)
    jitter = F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") / 65535
    return F.least(F.lit(timeout_seconds / 2), F.pow(F.lit(2.0), attempt - 1) + jitter)
