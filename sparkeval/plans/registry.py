"""The registry of metrics: definitions, and evaluation that isolates errors.

A metric is a function from its configuration to a Column over a sample row, or a Python function of
a sample and the configuration.  ``evaluate`` checks the configuration against the metric's schema, then for each sample the task type, the required
fields and the range, and gives the value or the reason that there is none.  A Python function that raises fails on that sample alone; a
Column has to be total, as an error of Spark's ends the query.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import schema_errors, validate
from ..functions.patterns import safe_match


@dataclass(frozen=True)
class Definition:
    identifier: str
    family: str
    direction: str
    unit: str
    required: tuple[str, ...] = ()
    task_types: tuple[str, ...] = ()
    minimum: float | None = None
    maximum: float | None = None
    version: str = "1"
    config_schema: dict | None = None

    def __post_init__(self):
        if not (self.identifier and self.version):
            raise ValueError("a metric has an identifier and a version")
        if self.minimum is not None and self.maximum is not None and self.minimum > self.maximum:
            raise ValueError("the range of a metric is inverted")


@dataclass
class MetricRegistry:
    metrics: dict[str, tuple[Definition, Callable[[dict], Column]]] = field(default_factory=dict)
    functions: set[str] = field(default_factory=set)
    inputs: dict[str, Callable[[], dict[str, Column]]] = field(default_factory=dict)

    def register(self, definition: Definition, build: Callable[[dict], Column], inputs: Callable[[], dict[str, Column]] = dict) -> None:
        """``inputs`` gives columns that are made of the sample first, for the metric to read by name."""
        if definition.identifier in self.metrics:
            raise ValueError(f"the metric {definition.identifier} is registered already")
        self.metrics[definition.identifier] = definition, build
        self.inputs[definition.identifier] = inputs

    def register_function(self, definition: Definition, function: Callable[[dict, dict], float | None]) -> None:
        """A metric in Python: ``function(sample, config)`` gets the required fields and returns a number, or None where there is none."""

        def build(config: dict) -> Column:
            @F.pandas_udf("status string, value double, error string")
            def run(samples: pd.DataFrame) -> pd.DataFrame:
                out = []
                for sample in samples.to_dict("records"):
                    try:
                        value = function(sample, config)
                        if value is not None and (isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value)):
                            out.append(("invalid_result", None, f"no finite number: {value!r}"))
                        else:
                            out.append(("missing" if value is None else "succeeded", value, None))
                    except Exception as e:  # whatever a plugin raises is its result on this sample
                        out.append(("failed", None, f"{type(e).__name__}: {e}"))
                return pd.DataFrame(out, columns=["status", "value", "error"]).astype({"value": "float64"})

            return run(F.struct(*(definition.required or (F.lit(0).alias("none"),))))

        self.register(definition, build)
        self.functions.add(definition.identifier)

    def definition(self, identifier: str) -> Definition:
        if identifier not in self.metrics:
            raise KeyError(f"no metric {identifier}")
        return self.metrics[identifier][0]

    def evaluate(self, samples: DataFrame, identifiers: list[str], config: dict | None = None, sample_id: str = "sample_id", errors: bool = False) -> DataFrame:
        """``sample_id, metric, value, status`` (and ``error``) in long form.

        A configuration that its metric's schema refuses is a ``ValueError`` before anything runs.
        """
        out, config = [], config or {}
        for i in identifiers:
            d = self.definition(i)
            if d.config_schema is not None and (found := validate(config, d.config_schema)):
                raise ValueError(f"{i}: the configuration fails at {found[0][0]} by {found[0][1]}")
        made = samples
        for n, i in enumerate(identifiers):
            d, build = self.metrics[i]
            need = [F.col(r).isNotNull() for r in d.required]
            kinds = [F.col("task_type").isin(*d.task_types)] if d.task_types else []
            everything = lambda cs: F.coalesce(F.forall(F.array(*cs), lambda c: c), F.lit(False)) if cs else F.lit(True)
            made = made.withColumns(self.inputs[i]())
            if i in self.functions:
                made = made.withColumn(f"__m{n}", build(config))
                value, own, error = F.col(f"__m{n}.value"), F.nullif(F.col(f"__m{n}.status"), F.lit("succeeded")), F.col(f"__m{n}.error")
            else:
                value = build(config).cast("double")
                own, error = F.when(value.isNull(), "missing"), F.lit(None).cast("string")
            low = [value >= d.minimum] if d.minimum is not None else []
            high = [value <= d.maximum] if d.maximum is not None else []
            status = F.when(~everything(kinds), "wrong_task_type").when(~everything(need), "missing_field").when(own.isNotNull(), own).when(~everything(low + high), "out_of_range").otherwise("succeeded")
            out.append(F.struct(F.lit(i).alias("metric"), status.alias("status"), value.alias("value"), F.when(status == "failed", error).when(status == "invalid_result", error).alias("error")))
        rows = made.select(sample_id, F.explode(F.array(*out)).alias("m")).select(sample_id, "m.*")
        rows = rows.withColumn("value", F.when(F.col("status") == "succeeded", F.col("value")))
        return rows if errors else rows.drop("error")


OPERATIONAL = (
    ("latency-ms", "minimize", "ms"), ("time-to-first-token-ms", "minimize", "ms"), ("input-tokens", "minimize", "tokens"), ("output-tokens", "minimize", "tokens"), ("total-tokens", "minimize", "tokens"),
    ("cost-usd", "minimize", "usd"), ("retrieval-latency-ms", "minimize", "ms"), ("generation-latency-ms", "minimize", "ms"), ("end-to-end-latency-ms", "minimize", "ms"),
    ("throughput-tokens-per-second", "maximize", "tokens/s"), ("error", "minimize", "indicator"), ("refusal", "minimize", "indicator"), ("agent/step-count", "minimize", "steps"), ("agent/tool-cost-usd", "minimize", "usd"),
)


def default_registry() -> MetricRegistry:
    """The native metrics by their identifiers."""
    from ..functions import ranking as K
    from ..functions import similarity as S
    from ..functions import text as X
    from ..functions import trajectory as J
    from ..functions.vectors import cosine
    from ..operators.operational import field_of

    reg = MetricRegistry()
    p, r = "prediction", "reference"
    both = (p, r)

    def add(name, family, build, required=both, direction="maximize", maximum=1.0, config=None, minimum=0.0, inputs=dict):
        reg.register(Definition(name, family, direction, "score", required, (), minimum, maximum, config_schema=config), build, inputs)

    def wants(**fields):
        return {"type": "object", "required": list(fields), "properties": fields}

    one = lambda c: c.cast("double")
    add("exact-match", "text", lambda c: one(F.col(p) == F.col(r)))
    add("normalized-match", "text", lambda c: one(X.normalized(F.col(p)) == X.normalized(F.col(r))))
    add("case-insensitive-match", "text", lambda c: one(X.casefold(F.col(p)) == X.casefold(F.col(r))))
    add("classification-accuracy", "text", lambda c: one(F.trim(F.col(p)) == F.trim(F.col(r))))
    composed = lambda: {"__prediction": X.composed(F.col(p)), "__reference": X.composed(F.col(r))}
    add("token-f1", "text", lambda c: X.precision_recall_f1(X.tokens(F.col("__prediction")), X.tokens(F.col("__reference")))["f1"], inputs=composed)
    add("rouge-l", "text", lambda c: S.rouge_lsum_score(F.col(p), F.col(r)))
    add("bleu", "text", lambda c: S.bleu_score(F.col(p), F.col(r)))
    add("edit-distance", "text", lambda c: F.levenshtein(F.col(p), F.col(r)), direction="minimize", maximum=None)
    add("character-error-rate", "text", lambda c: F.when(F.length(r) == 0, one(F.length(p) > 0)).otherwise(X.rate(F.levenshtein(F.col(p), F.col(r)), F.length(r))), direction="minimize", maximum=None)
    add("word-error-rate", "text", lambda c: S.word_error_rate(F.col(p), F.col(r)), direction="minimize", maximum=None)
    add("json-validity", "structure", lambda c: one(F.try_parse_json(p).isNotNull()), (p,))
    add("json-schema", "structure", lambda c: one(F.size(schema_errors(json.dumps(c["schema"]))(F.col(p))) == 0), (p,), config=wants(schema={"type": "object"}))
    add("regex-match", "structure", lambda c: one(safe_match(F.col(p), c["pattern"], c.get("full_match", False))), (p,), config=wants(pattern={"type": "string", "minLength": 1, "maxLength": 500}))
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    for n in (1, 2):
        grams = lambda c, n=n: X.let(words(F.col(c)), lambda t: F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))))
        add(f"rouge-{n}", "text", lambda c, g=grams: X.precision_recall_f1(g(p), g(r))["f1"])
    add("semantic-similarity", "text", lambda c: cosine(F.col("prediction_vector"), F.col("reference_vector")), ("prediction_vector", "reference_vector"), minimum=-1.0)
    i, rel = "retrieved_ids", "relevant_ids"
    ranked = (i, rel)
    gains = lambda: F.map_from_entries(F.transform(F.array_distinct(rel), lambda x: F.struct(x, F.lit(1.0))))
    add("ndcg-at-k", "retrieval", lambda c: K.ndcg(F.col(i), gains(), c["k"]), ranked, config=wants(k={"type": "integer", "minimum": 1}))
    add("citation-validity", "retrieval", lambda c: K.citation_scores(F.col(p), F.col(i), F.col(rel))["validity"], (p, i))
    add("precision-at-k", "retrieval", lambda c: K.precision_at(F.col(i), F.col(rel), c["k"]), ranked)
    add("recall-at-k", "retrieval", lambda c: K.recall_at(F.col(i), F.col(rel), c["k"]), ranked)
    add("hit-rate-at-k", "retrieval", lambda c: K.hit_at(F.col(i), F.col(rel), c["k"]), ranked)
    add("reciprocal-rank", "retrieval", lambda c: K.reciprocal_rank(F.col(i), F.col(rel)), ranked)
    add("average-precision", "retrieval", lambda c: K.average_precision(F.col(i), F.col(rel)), ranked)
    add("retrieval-coverage", "retrieval", lambda c: K.coverage(F.col(i), F.col(rel)), ranked)
    add("duplicate-document-rate", "retrieval", lambda c: K.duplicate_rate(F.col(i)), (i,), "minimize")
    add("context-utilization", "retrieval", lambda c: K.utilization(F.col(i), F.col(rel)), ranked)
    add("agent/tool-success-rate", "agent", lambda c: J.tool_success_rate(F.col("steps")), ("steps",))
    add("agent/redundant-call-rate", "agent", lambda c: J.redundant_call_rate(F.col("steps")), ("steps",), "minimize")
    add("agent/loop", "agent", lambda c: one(J.has_loop(F.col("steps"), decision="decision")), ("steps",), "minimize")
    add("agent/recovery", "agent", lambda c: J.recovery_rate(F.col("steps")), ("steps",))
    for name, direction, unit in OPERATIONAL:
        reg.register(Definition(name, "operational", direction, unit, ("operational",)), lambda c, n=name: F.col(f"operational.{field_of(n)}"))
    return reg


def definitions(spark: SparkSession) -> DataFrame:
    rows = [(d.identifier, d.family, d.direction, d.unit, d.version) for d, _ in default_registry().metrics.values()]
    return spark.createDataFrame(rows, "identifier string, family string, direction string, unit string, version string").orderBy("identifier")
