"""Patterns, answers and prompts as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PATTERN = 500


def check_pattern(pattern: str) -> str:
    """The pattern, if it is short and free of back references, look-behind and nested repeats."""
    if len(pattern) > MAX_PATTERN:
        raise ValueError("the pattern is too long")
    if re.search(r"\\[1-9]|\(\?P=|\(\?<[=!]", pattern):
        raise ValueError("back references and look-behind are refused")
    if re.search(r"\([^()]*[*+}][^()]*\)\s*[*+{]", pattern):
        raise ValueError("nested repeats are refused")
    re.compile(pattern)
    return pattern


def safe_match(text: Column, pattern: str, full: bool = False) -> Column:
    check_pattern(pattern)
    return text.rlike(f"^(?:{pattern})$" if full else pattern)


def benchmark_answer(text: Column) -> Column:
    """NFC and trimmed; out of a code fence that has no tag or the tag ``text``; white space collapsed, case folded, one closing mark dropped."""
    from .text import exact_normalized

    space = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
    bare = F.regexp_replace(F.regexp_replace(text, f"^{space}+", ""), f"{space}+$", "")
    fenced = bare.startswith("```") & bare.endswith("```")
    opened = F.regexp_replace(bare, f"^```(?i:text)?{space}*", "")
    return F.regexp_replace(exact_normalized(F.when(fenced, F.regexp_replace(opened, f"{space}*```$", "")).otherwise(bare)), "[.!?]$", "")


def first_field(payload: Column, names: list[str]) -> Column:
    """The first of the fields that is there, else the whole payload."""
    return F.coalesce(*[F.get_json_object(payload, f"$.{n}") for n in names], payload)


def render(template: str, value: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{{ input }}"), value)


#: Names under which a configuration must not carry its secrets.
SECRET_KEYS = frozenset("authorization api_key apikey password secret token access_token refresh_token".split())


def reject_secrets(config, path: str = "") -> None:
    """``ValueError`` names the first key, at any depth, that would carry a secret."""
    if isinstance(config, dict):
        for k, v in config.items():
            if str(k).lower().replace("-", "_") in SECRET_KEYS:
                raise ValueError(f"a secret in the configuration: {path}/{k}")
            reject_secrets(v, f"{path}/{k}")
    elif isinstance(config, (list, tuple)):
        for i, v in enumerate(config):
            reject_secrets(v, f"{path}/{i}")
