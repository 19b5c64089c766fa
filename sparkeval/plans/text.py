"""Per-sample text metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..registry import query
from ..views import table, turns, with_views

FOLD = "replace(lower({}), 'ß', 'ss')"  # case folding, as far as the tables need it
NORM = "trim(regexp_replace(replace(lower(nfc_normalize({})), 'ß', 'ss'), '[\\s\\p{{Z}}]+', ' ', 'g'))"


def _round(df, names, digits=9):
    return df.select("sample_id", *[F.round(n, digits).alias(n) for n in names])


TOK = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')"
OVERLAP = """
p AS (SELECT sample_id, x, count(*) AS c FROM (SELECT sample_id, unnest(p) AS x FROM t) GROUP BY ALL), r AS (SELECT sample_id, x, count(*) AS c FROM (SELECT sample_id, unnest(r) AS x FROM t) GROUP BY ALL),
o AS (SELECT sample_id, sum(least(p.c, r.c)) AS n FROM p JOIN r USING (sample_id, x) GROUP BY sample_id),
s AS (SELECT sample_id, CASE WHEN len(p) = 0 THEN (len(r) = 0)::INT::DOUBLE ELSE coalesce(n, 0) / len(p) END AS precision, CASE WHEN len(r) = 0 THEN (len(p) = 0)::INT::DOUBLE ELSE coalesce(n, 0) / len(r) END AS recall FROM t LEFT JOIN o USING (sample_id))
"""


@query(with_views("turns", f"""WITH t AS (SELECT sample_id, {TOK.format(NORM.format("prediction"))} AS p, {TOK.format(NORM.format("reference"))} AS r FROM turns), {OVERLAP}
SELECT sample_id, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 9) AS f1 FROM s"""))
def lm03_token_f1(spark, sf_dir):
    texts = turns(spark, sf_dir).select("sample_id", X.composed(F.col("prediction")).alias("p"), X.composed(F.col("reference")).alias("r"))
    scored = texts.select("sample_id", X.precision_recall_f1(X.tokens(F.col("p")), X.tokens(F.col("r"))).alias("s"))
    return _round(scored.select("sample_id", "s.*"), ["precision", "recall", "f1"])


@query(with_views("turns", f"""SELECT sample_id, (prediction = reference)::INT::DOUBLE AS exact, ({NORM.format("prediction")} = {NORM.format("reference")})::INT::DOUBLE AS normalized,
 ({FOLD.format("prediction")} = {FOLD.format("reference")})::INT::DOUBLE AS case_insensitive, (trim(prediction, ' ') = trim(reference, ' '))::INT::DOUBLE AS accuracy FROM turns"""))
def lm04_match(spark, sf_dir):
    one = lambda c: c.cast("double")
    return turns(spark, sf_dir).select(
        "sample_id",
        one(F.col("prediction") == F.col("reference")).alias("exact"),
        one(X.normalized(F.col("prediction")) == X.normalized(F.col("reference"))).alias("normalized"),
        one(X.casefold(F.col("prediction")) == X.casefold(F.col("reference"))).alias("case_insensitive"),
        one(F.trim(F.col("prediction")) == F.trim(F.col("reference"))).alias("accuracy"),
    )


@query(with_views("turns", r"""SELECT sample_id, trim(regexp_replace(replace(lower(nfc_normalize(prediction)), 'ß', 'ss'), '[\s\p{Z}]+', ' ', 'g')) AS normalized FROM turns"""))
def lm01_exact_normalize(spark, sf_dir):
    """NFC and case folding, exact."""
    return turns(spark, sf_dir).select("sample_id", X.exact_normalized(F.col("prediction")).alias("normalized"))


ROUGE = "regexp_extract_all(lower({}), '[a-z0-9]+')"
GRAM2 = "[x[1] || ' ' || x[2] FOR x IN list_zip({0}[1:len({0})-1], {0}[2:])]"


def _rouge(n: int):
    grams = lambda c: X.let(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: t if n == 1 else F.when(F.size(t) >= 2, F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>")))

    def scored(p, r):
        hits = X.multiset_overlap(p, r)
        return X.let(hits, lambda h: F.coalesce(X.rate(2 * h, F.size(p) + F.size(r)), F.lit(0.0)))

    return X.let(grams(F.col("prediction")), lambda p: X.let(grams(F.col("reference")), lambda r: scored(p, r)))


@query(with_views("turns", f"""WITH t1 AS (SELECT sample_id, {ROUGE.format("prediction")} AS p, {ROUGE.format("reference")} AS r FROM turns),
u AS (SELECT sample_id, 1 AS n, unnest(p) AS x, 1 AS a, 0 AS b FROM t1 UNION ALL SELECT sample_id, 1, unnest(r), 0, 1 FROM t1
 UNION ALL SELECT sample_id, 2, unnest([p[i] || ' ' || p[i+1] FOR i IN range(1, len(p))]), 1, 0 FROM t1 UNION ALL SELECT sample_id, 2, unnest([r[i] || ' ' || r[i+1] FOR i IN range(1, len(r))]), 0, 1 FROM t1),
g AS (SELECT sample_id, n, x, sum(a) AS a, sum(b) AS b FROM u GROUP BY ALL), f AS (SELECT sample_id, n, 2 * sum(least(a, b)) / sum(a + b) AS f FROM g GROUP BY ALL)
SELECT sample_id, round(coalesce(f1.f, 0), 9) AS rouge1, round(coalesce(f2.f, 0), 9) AS rouge2 FROM turns LEFT JOIN (SELECT * FROM f WHERE n = 1) f1 USING (sample_id) LEFT JOIN (SELECT * FROM f WHERE n = 2) f2 USING (sample_id)"""))
def lm06_rouge(spark, sf_dir):
    return _round(turns(spark, sf_dir).select("sample_id", _rouge(1).alias("rouge1"), _rouge(2).alias("rouge2")), ["rouge1", "rouge2"])


@query()
def lm06b_rouge_lsum(spark, sf_dir):
    return turns(spark, sf_dir).select("sample_id", S.rouge_lsum_score(F.col("prediction"), F.col("reference")).alias("rouge_lsum"))


@query()
def lm07_bleu(spark, sf_dir):
    return turns(spark, sf_dir).select("sample_id", S.bleu_score(F.col("prediction"), F.col("reference")).alias("bleu"))


@query("""SELECT p_partkey, levenshtein(p_name, p_type) AS edit_distance, round(CASE WHEN length(p_type) = 0 THEN (length(p_name) > 0)::INT ELSE levenshtein(p_name, p_type) / length(p_type) END, 9) AS cer FROM part""")
def lm08_edit_distance(spark, sf_dir):
    """Edit distance and character error rate, by code points."""
    a, b = F.col("p_name"), F.col("p_type")
    d = F.levenshtein(a, b)
    cer = F.when(F.length(b) == 0, (F.length(a) > 0).cast("double")).otherwise(X.rate(d, F.length(b)))
    return table(spark, sf_dir, "part").select("p_partkey", d.cast("long").alias("edit_distance"), F.round(cer, 9).alias("cer"))


@query()
def lm10_word_error_rate(spark, sf_dir):
    return turns(spark, sf_dir).select("sample_id", S.word_error_rate(F.col("prediction"), F.col("reference")).alias("wer"))


@query("SELECT event_id, json_valid(props)::INT::DOUBLE AS valid, 0.0::DOUBLE AS broken FROM events")
def lm12_json_validity(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ok = lambda c: F.try_parse_json(c).isNotNull().cast("double")
    return e.select("event_id", ok(F.col("props")).alias("valid"), ok(F.concat(F.lit('{"k":1,'), F.expr("substr(props, 2)"))).alias("broken"))


@query("SELECT event_id, (json_extract_string(props, '$.k') = (user_id % 10)::VARCHAR)::INT / 2.0::DOUBLE AS accuracy, 'absent' AS missing FROM events")
def lm14_structured_field_accuracy(spark, sf_dir):
    """Two declared fields; one is on neither side, so it counts as wrong."""
    e = table(spark, sf_dir, "events")
    reference = F.to_json(F.struct((F.col("user_id") % 10).alias("k")))
    fields = ("k", "absent")
    get = lambda c, f: F.get_json_object(c, f"$.{f}")
    right = sum(F.coalesce(get(F.col("props"), f) == get(reference, f), F.lit(False)).cast("double") for f in fields)
    gone = F.array_compact(F.array(*[F.when(get(F.col("props"), f).isNull() | get(reference, f).isNull(), F.lit(f)) for f in fields]))
    return e.select("event_id", (right / len(fields)).alias("accuracy"), F.array_join(gone, ",").alias("missing"))


@query("SELECT p_partkey, regexp_matches(p_name, '[0-9]+$') AS found, regexp_full_match(p_type, '[A-Z ]+') AS whole FROM part")
def lm15_regex_match(spark, sf_dir):
    from ..functions.patterns import safe_match

    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", safe_match(F.col("p_name"), "[0-9]+$").alias("found"), safe_match(F.col("p_type"), "[A-Z ]+", full=True).alias("whole"))


@query("""SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def lm16_cosine_similarity(spark, sf_dir):
    from ..functions.vectors import cosine

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    o = e.select(F.col("vec_id").alias("other"), F.col("embedding").alias("b"), (F.col("vec_id") - 1).alias("vec_id"))
    return e.join(o, "vec_id").select("vec_id", "other", F.round(cosine(F.col("embedding"), F.col("b")), 6).alias("similarity"))


@query("""SELECT item_id, regexp_replace(trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\\s+', ' ', 'g')), '[.!?]$', '') AS normalized, true AS correct FROM benchmark""")
def lm19_benchmark_answer(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    from ..functions.patterns import benchmark_answer

    n = benchmark_answer(F.col("text"))
    accepted = F.array(benchmark_answer(F.concat(F.lit("```\n"), "text", F.lit("\n```"))), F.lit("other"))
    return b.select("item_id", n.alias("normalized"), F.array_contains(accepted, n).alias("correct"))


@query("SELECT event_id, coalesce(NULL, props) AS input_text, json_extract_string(props, '$.k') AS reference, 'Answer: ' || event_type || '.' AS prompt FROM events")
def flt03_input_and_reference(spark, sf_dir):
    """First present input field, first present reference, and the rendered prompt."""
    from ..functions.patterns import first_field, render

    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        first_field(F.col("props"), ["input", "question", "task", "document"]).alias("input_text"),
        F.coalesce(*[F.get_json_object("props", f"$.{f}") for f in ("reference", "reference_answer", "label", "answers[0]", "k")]).alias("reference"),
        render("Answer: {{ input }}.", F.col("event_type")).alias("prompt"),
    )


@query(with_views("turns", f"""WITH m AS (SELECT sample_id, 'exact-match' AS metric, 'succeeded' AS status, (prediction = reference)::INT::DOUBLE AS value FROM turns
 UNION ALL SELECT sample_id, 'normalized-match', 'succeeded', ({NORM.format("prediction")} = {NORM.format("reference")})::INT::DOUBLE FROM turns
 UNION ALL SELECT sample_id, 'json-validity', 'succeeded', json_valid(prediction)::INT::DOUBLE FROM turns UNION ALL SELECT sample_id, 'recall-at-k', 'missing', NULL FROM turns)
SELECT metric, status, count(*) AS n, round(avg(value), 9) AS value FROM m GROUP BY metric, status"""))
def udf02_registry_evaluate(spark, sf_dir):
    """Registered metrics over all samples, in long form, with the reason where there is no value."""
    from .registry import default_registry

    none = F.array().cast("array<string>")
    samples = turns(spark, sf_dir).withColumn("retrieved_ids", none).withColumn("relevant_ids", none)
    rows = default_registry().evaluate(samples, ["exact-match", "normalized-match", "json-validity", "recall-at-k"], {"k": 3})
    return rows.groupBy("metric", "status").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("value"))
