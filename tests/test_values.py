"""Hand-computed values of single operators."""

from __future__ import annotations

import hashlib
import hmac
import itertools
import json
import math
import re
import unicodedata
from collections import Counter
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkeval.functions import canonical, hashing, judge, patterns, planning, ranking, similarity, special, text, trajectory
from sparkeval.operators import agreement, aggregates, alignment, comparison, datasets, gates, inference, lifecycle, money, pairwise, predicates, rankings
from sparkeval.plans.registry import Definition, default_registry
from sparkeval.sources import readers


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# --- text ---


def f1(spark, p, r):
    df = spark.createDataFrame([(p, r)], "p string, r string")
    return tuple(one(df.select(text.precision_recall_f1(text.tokens(F.col("p")), text.tokens(F.col("r"))).alias("s")).select("s.*")))


@pytest.mark.parametrize("p,r,want", [("the red red fox", "the red fox jumps", (0.75, 0.75, 0.75)), ("", "", (1, 1, 1)), ("x", "", (0, 0, 0)), ("", "x", (0, 0, 0))])
def test_token_f1(spark, p, r, want):
    assert f1(spark, p, r) == pytest.approx(want)


def test_similarity():
    assert similarity.word_error("one two", "one three") == 0.5
    assert similarity.word_error("", "") == 0 and similarity.word_error("x", "") == 1
    assert similarity.bleu("the cat sat on the mat", ["the cat sat on the mat"]) == pytest.approx(1)
    assert similarity.bleu("a b", ["c d"]) == 0
    assert similarity.rouge_lsum("a b c", "a b c") == 1 and similarity.rouge_lsum("", "a") == 0
    assert similarity.edit_distance("kitten", "sitting") == 3


def test_exact_normalize(spark):
    df = spark.createDataFrame([("Straße  x",), ("é",), (None,)], "t string")
    assert [r[0] for r in df.select(text.exact_normalized(F.col("t"))).collect()] == ["strasse x", "é", None]


ODD = ["Straße ẞ", "ΣΊΣΥΦΟΣ ς", "ﬃ ŉ ǰ ᾳ", "İstanbul ı", "हिन्दी में", "A\x1cB\x85C\u3000D", "e\u0301 É", "\u212b Å", "𐐀𐐨 x", "a_b-c's 12½ ²", "", " ", None, "plain ASCII\tText", "한국어 각 각"]


def test_case_folding_of_all_characters(spark):
    points = [n for n in range(0x110000) if not 0xD800 <= n < 0xE000 and (chr(n).casefold() != chr(n) or n % 97 == 0)]
    df = spark.createDataFrame([(n, f"x{chr(n)}Y") for n in points] + [(-1, None), (-2, "ABC"), (-3, "")], "n int, t string")
    got = {r["n"]: r["f"] for r in df.select("n", text.casefold(F.col("t")).alias("f")).collect()}
    assert got == {n: f"x{chr(n)}Y".casefold() for n in points} | {-1: None, -2: "abc", -3: ""}


def test_words_and_normal_form_are_those_of_plain_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    grams = text.text_ngrams(F.col("t"), 1)
    got = df.withColumn("c", text.composed(F.col("t"))).select("t", text.normalized(F.col("t")).alias("n"), text.tokens(F.col("c")).alias("w"), grams.alias("g"), F.size(text.gram_hashes(F.col("t"), 1)).alias("h")).collect()
    for r in got:
        if r["t"] is None:
            assert r["n"] is None
            continue
        want = " ".join(unicodedata.normalize("NFC", r["t"]).casefold().split())
        assert r["n"] == want and r["w"] == re.findall(r"\w+|[^\w\s]", want), r["t"]
        words = list(dict.fromkeys(re.findall(r"\w+", r["t"].casefold())))
        assert r["g"] == words and r["h"] == len(words), r["t"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("aabcd"), max_size=12), st.lists(st.sampled_from("abbce"), max_size=12)), min_size=1, max_size=30))
def test_overlap_counts_repeats(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = {r["i"]: r["n"] for r in df.select("i", text.multiset_overlap(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {i: sum((Counter(a) & Counter(b)).values()) for i, (a, b) in enumerate(pairs)}


def test_token_f1_of_the_registry(spark):
    df = spark.createDataFrame([(1, "Die STRASSE, e\u0301", "die Straße é"), (2, "", ""), (3, "a a b", "a b b c")], "sample_id int, prediction string, reference string")
    got = {r["sample_id"]: r["value"] for r in default_registry().evaluate(df, ["token-f1", "case-insensitive-match"]).where("metric = 'token-f1'").collect()}
    assert got == pytest.approx({1: 2 * 3 / 7, 2: 1.0, 3: 2 * 2 / 7})


def test_overlap_of_long_and_null_arrays(spark):
    df = spark.createDataFrame([(["x"] * 20_000 + ["y"], ["x"] * 15_000 + ["z"]), (None, ["x"]), ([], [])], "a array<string>, b array<string>")
    assert [r["n"] for r in df.select(text.multiset_overlap(F.col("a"), F.col("b")).alias("n")).collect()] == [15_000, 0, 0]


@pytest.mark.parametrize("bad", ["(a+)+$", r"(a)\1", "(?<=a)b", "a" * 501])
def test_patterns_are_refused(bad):
    with pytest.raises(ValueError):
        patterns.check_pattern(bad)


# --- retrieval ---


def test_retrieval(spark):
    df = spark.createDataFrame([(["d2", "d1", "d4", "d1"], ["d1", "d3"]), (["d2"], [])], "i array<string>, r array<string>")
    i, r = F.col("i"), F.col("r")
    got = df.select(
        ranking.precision_at(i, r, 3), ranking.recall_at(i, r, 3), ranking.hit_at(i, r, 1), ranking.reciprocal_rank(i, r), ranking.average_precision(i, r), ranking.duplicate_rate(i), ranking.coverage(i, r)
    ).collect()
    assert list(got[0]) == pytest.approx([1 / 3, 0.5, 0, 0.5, 0.25, 0.25, 0.5])
    assert list(got[1]) == [0.0, None, None, None, None, 0.0, None]


def test_ndcg(spark):
    df = spark.createDataFrame([(["a", "b", "a"], {"a": 1.0, "c": 2.0})], "i array<string>, g map<string,double>")
    want = 1 / (3 + 1 / math.log2(3))
    assert one(df.select(ranking.ndcg(F.col("i"), F.col("g"), 3)))[0] == pytest.approx(want)


def test_labelled_relevance_keeps_the_retrieved_gain(spark):
    df = spark.createDataFrame([([("a", None), ("b", 2.0)], ["a", "c"])], "i array<struct<id:string,relevance:double>>, r array<string>")
    assert one(df.select(ranking.labelled_relevance(F.col("i"), F.col("r"))))[0] == {"a": 0.0, "b": 2.0, "c": 1.0}


def test_citations(spark):
    df = spark.createDataFrame([("Answer [source:a] and [source:missing].", ["a", "b"]), ("none", ["a"])], "t string, k array<string>")
    c = df.select(ranking.citations(F.col("t")).alias("c"), "k").select("c", ranking.citation_validity(F.col("c"), F.col("k"))).collect()
    assert (c[0][0], c[0][1], c[1][0], c[1][1]) == (["a", "missing"], 0.5, [], 0.0)


# --- agents ---


def test_trajectory(spark):
    steps = [
        (0, "model_decision", None, "x", None), (1, "tool_call", "t", "1", None), (2, "tool_result", "t", None, False), (3, "model_decision", None, "x", None), (4, "tool_call", "t", "1", None),
        (5, "tool_result", "t", None, True), (6, "final_output", None, None, None),
    ]
    df = spark.createDataFrame([(steps,)], "steps array<struct<step:bigint,kind:string,tool:string,arguments:string,success:boolean>>")
    s = F.col("steps")
    got = one(df.select(trajectory.tool_success_rate(s), trajectory.redundant_call_rate(s), trajectory.recovery_rate(s), trajectory.has_loop(s), trajectory.has_loop(s, 2), trajectory.valid_steps(s)))
    assert list(got) == [0.5, 0.5, 1.0, False, True, True]
    empty = spark.createDataFrame([([],)], df.schema)
    got = one(empty.select(trajectory.tool_success_rate(s), trajectory.redundant_call_rate(s), trajectory.recovery_rate(s), trajectory.has_loop(s)))
    assert list(got) == [None, 0.0, None, False]


# --- digests, JSON ---


def test_hmac_and_frames(spark):
    df = spark.createDataFrame([("kéy",)], "k string")
    seed = 2**64 - 5
    got = one(df.select(hashing.hmac_sha256(seed, F.col("k")), hashing.hmac_sha256_by(F.lit(f"{seed:016x}"), F.col("k")), F.hex(hashing.frame(F.col("k"), F.lit("ab")))))
    want = hmac.new(seed.to_bytes(8, "big"), "kéy".encode(), hashlib.sha256).hexdigest()
    assert got[0] == got[1] == want
    raw = "kéy".encode()
    assert bytes.fromhex(got[2]) == len(raw).to_bytes(8, "big") + raw + (2).to_bytes(8, "big") + b"ab"


@pytest.mark.parametrize("x,want", [(1e21, "1e+21"), (1e-7, "1e-7"), (0.1, "0.1"), (123456789.5, "123456789.5"), (1e20, "100000000000000000000"), (-2.5e-9, "-2.5e-9"), (0.000001, "0.000001"), (5, "5")])
def test_numbers_as_in_ecmascript(x, want):
    assert canonical.jcs(x) == want


def test_canonical_json():
    a = canonical.jcs(canonical.normalize({"b": "x\r\n", "a": -0.0, "é": [1.0]}))
    assert a == '{"a":0,"b":"x\\n","é":[1]}'
    schema = {"properties": {"when": {"type": "string", "format": "date-time"}, "opt": {"type": ["string", "null"]}}}
    assert canonical.normalize({"when": "2024-01-01T02:00:00.500+02:00"}, schema) == {"when": "2024-01-01T00:00:00.5Z", "opt": None}
    for bad in ('{"a":1,"a":2}', '{"a":NaN}'):
        with pytest.raises(ValueError):
            canonical.loads(bad)
    for bad in (2**53, float("inf"), {"é": 1, "é": 2}):
        with pytest.raises(ValueError):
            canonical.normalize(bad)


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**53) + 1, 2**53 - 1) | st.floats(-1e15, 1e15) | st.text(st.characters(blacklist_categories=["Cs"]), max_size=8), lambda c: st.lists(c, max_size=3), max_leaves=8))
def test_normalize_is_idempotent(value):
    once = canonical.normalize(value)
    assert canonical.jcs(canonical.normalize(json.loads(canonical.jcs(once)))) == canonical.jcs(once)


def test_schema_errors():
    rule = {"type": "object", "required": ["answer"], "properties": {"answer": {"type": "integer"}}, "additionalProperties": False}
    assert canonical.validate({"answer": 42}, rule) == []
    assert canonical.validate({"answer": "42"}, rule) == [("/answer", "type")]
    assert canonical.validate({"x/y": 1}, rule) == [("/answer", "required"), ("/x~1y", "additionalProperties")]


def test_redact(spark):
    df = spark.createDataFrame([('{"profile":{"email":"a@b"},"l":[1,2]}',)], "j string")
    got = one(df.select(canonical.redact_json(["/profile/email", "/l/1", "/none/x"])(F.col("j"))))[0]
    assert json.loads(got) == {"profile": {"email": "[REDACTED]"}, "l": [1, "[REDACTED]"]}


# --- datasets ---


def test_version_hash_ignores_order(spark):
    rows = [("b", "2"), ("a", "1"), ("c", "3")]
    digests = set()
    for r in (rows, rows[::-1]):
        df = spark.createDataFrame(r, "k string, p string")
        built = datasets.build_records(df, F.col("k"), F.col("p"), F.lit("{}"), F.array(F.lit(" Test"), F.lit("test")), F.lit("{}"))
        assert built.first()["splits"] == ["test"]
        digests.add((datasets.version_hash(built, "{}", "{}").first()[0], datasets.tree_hash(built).first()[0]))
    assert len(digests) == 1
    env = sorted((x["key"].encode(), x["envelope_hash"]) for x in built.collect())
    parts = [datasets.C14N.encode(), hashlib.sha256(b"{}").digest(), hashlib.sha256(b"{}").digest(), *(bytes.fromhex(e) for _, e in env)]
    want = hashlib.sha256(b"llm-eval-dataset\0" + b"".join(len(p).to_bytes(8, "big") + p for p in parts)).hexdigest()
    assert next(iter(digests))[0] == want
    with pytest.raises(Exception, match="too many"):
        datasets.version_hash(built, "{}", "{}", max_records=2).collect()


def test_empty_keys_fail(spark):
    df = spark.createDataFrame([(" ", "1")], "k string, p string")
    with pytest.raises(Exception, match="key is empty"):
        datasets.build_records(df, F.col("k"), F.col("p"), F.lit("{}"), F.array(F.lit("x")), F.lit("{}")).collect()


def test_diff(spark):
    schema = "key string, input string, label string"
    a = spark.createDataFrame([("keep", "x", "1"), ("edit", "x", "1"), ("remove", "x", "1")], schema)
    b = spark.createDataFrame([("keep", "x", "1"), ("edit", "y", None), ("add", "x", "1")], schema)
    d = datasets.diff_versions(a, b, ["input", "label"])
    assert {r["kind"]: r["n"] for r in datasets.diff_counts(d).collect()} == dict.fromkeys(datasets.KINDS, 1)
    assert [(c["pointer"], c["before"], c["after"]) for c in d.where("kind = 'modified'").first()["changes"]] == [("/input", "x", "y"), ("/label", "1", None)]


def test_stratified(spark):
    df = spark.createDataFrame([(f"k{i}", "a" if i < 7 else "b") for i in range(10)], "key string, s string")
    got = datasets.stratified_sample(df, 5, 9, "s").groupBy("label").count().collect()
    assert {r[0]: r[1] for r in got} == {"a": 4, "b": 1}


def test_contamination(spark):
    s = "one two three four five six seven"
    left = spark.createDataFrame([("train-1", s), ("train-2", "other words entirely different from the rest here"), ("e", "")], "key string, text string")
    right = spark.createDataFrame([("test-1", s.upper()), ("f", "a b")], "key string, text string")
    got = {(r[0], r[1]): r[2] for r in datasets.contamination_matches(left, right).collect()}
    assert got == {("train-1", "test-1"): 1.0, ("e", "f"): 1.0}
    assert datasets.contamination_matches(left, right, threshold=0).count() == 6
    both = left.union(right)
    keys = {r["key"] for r in datasets.lsh_buckets(datasets.minhash_lsh(both, permutations=16, bands=4)).collect()}
    assert {"train-1", "test-1"} <= keys and "train-2" not in keys


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.8, 1.0])
@pytest.mark.parametrize("small", [True, False])
def test_contamination_equals_brute_force(spark, monkeypatch, threshold, small):
    if not small:
        monkeypatch.setattr(datasets, "BROADCAST_GRAMS", 0)
    words = [f"w{k % 23}" for k in range(400)]
    texts = [" ".join(words[7 * k : 7 * k + 9 + k % 4 * 10]) for k in range(40)] + ["", "too short", None, "the same line again and again " * 9]
    sides = [[(f"{side}{k % 42}", t if k % 3 else t and t + " and one line more of it") for k, t in enumerate(texts)] for side in "ab"]  # two keys are repeated
    left, right = (spark.createDataFrame(x, "key string, text string") for x in sides)

    def grams(t):
        w = re.findall(r"\w+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = []
    for a, s in sides[0]:
        for b, t in sides[1]:
            x, y = grams(s), grams(t)
            j = len(x & y) / len(x | y) if x | y else 1.0
            if j >= threshold:
                want.append((a, b, round(j, 9)))
    got = [(r[0], r[1], round(r[2], 9)) for r in datasets.contamination_matches(left, right, threshold=threshold).collect()]
    assert sorted(got) == sorted(want) and len(want) > 9


def test_bands_of_exact_signatures(spark):
    """Buckets are SHA-256 over a band's eight-byte values."""
    near = " ".join(f"w{k}" for k in range(90))
    rows = [("a", near), ("b", near + " more"), ("c", " ".join(f"v{k}" for k in range(90))), ("e", ""), ("f", "few words")]
    signed = spark.createDataFrame(rows, "key string, text string").select("key", canonical.minhash_signature()(F.col("text")).alias("signature"))
    banded = datasets.lsh_bands(signed)
    values = {r["key"]: bytes.fromhex(r["signature"].replace(",", "")) for r in signed.collect()}
    want = {(k, b): hashlib.sha256(v[64 * b : 64 * b + 64]).hexdigest() for k, v in values.items() for b in range(16)}
    assert {(r["key"], r["band"]): r["bucket"] for r in banded.collect()} == want
    together = {(r["key"]) for r in datasets.lsh_buckets(banded).collect()}
    assert together == {"a", "b", "e", "f"}


# --- sources ---


def test_formats_agree(spark, tmp_path):
    rows = [{"id": "1", "input": "hello"}, {"id": "2", "input": "world"}]
    (tmp_path / "a.jsonl").write_text("﻿" + "\n\n".join(json.dumps(r) for r in rows) + "\n")
    (tmp_path / "a.json").write_text(json.dumps({"records": rows}))
    (tmp_path / "b.json").write_text(json.dumps(rows))
    (tmp_path / "a.csv").write_text("id,input\n1,hello\n2,world\n")
    spark.createDataFrame([tuple(r.values()) for r in rows], "id string, input string").coalesce(1).write.parquet(str(tmp_path / "a.parquet"))
    got = {}
    for name in ("a.jsonl", "a.json", "b.json", "a.csv", "a.parquet"):
        e = readers.normalize_envelope(readers.read_records(spark, str(tmp_path / name), name.rpartition(".")[2]))
        got[name] = sorted((r["key"], json.dumps(json.loads(r["payload"]))) for r in e.collect())
    assert len({str(v) for v in got.values()}) == 1 and got["a.csv"][0] == ("1", '{"input": "hello"}')
    assert [r["row"] for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl")).orderBy("row").collect()] == [1, 3]


def test_bad_sources(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"id":"1","id":"2"}\n')
    with pytest.raises(Exception, match="no valid object"):
        readers.read_records(spark, str(tmp_path / "d.jsonl"), "jsonl").collect()
    (tmp_path / "d.csv").write_text("id,id\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "d.csv"))
    with pytest.raises(ValueError):
        readers.check_limit(spark.range(2), 1)
    with pytest.raises(ValueError):
        readers.check_bytes(spark, str(tmp_path / "d.csv"), 3)


# --- statistics ---


def test_special():
    assert special.wilson(5, 10) == pytest.approx((0.236593, 0.763407), abs=1e-6)
    assert special.clopper_pearson(0, 10) == pytest.approx((0, 0.308497), abs=1e-6)
    assert special.t_quantile(0.975, 4) == pytest.approx(2.776445, abs=1e-6)
    assert special.binomial_two_sided(7, 8) == pytest.approx(0.0703125)
    assert planning.continuous_size(0.5) == 32


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 200).flatmap(lambda n: st.tuples(st.integers(0, n), st.just(n))))
def test_intervals_hold_the_estimate(kn):
    k, n = kn
    for lo, hi in (special.wilson(k, n), special.clopper_pearson(k, n)):
        assert 0 <= lo <= k / n + 1e-12 and k / n - 1e-12 <= hi <= 1


def side(spark, values):
    return spark.createDataFrame([("m", k, "succeeded" if v is not None else "missing", v) for k, v in values.items()], "metric string, id string, status string, value double")


def test_alignment(spark):
    a = alignment.align(side(spark, {"a": 1.0, "b": None, "c": 3.0, "d": float("nan")}), side(spark, {"a": 2.0, "b": 2.0, "d": 4.0, "e": 5.0}), ["metric", "id"])
    s = one(alignment.alignment_summary(a, ["metric"]))
    assert (s["union_n"], s["paired_n"], s["missing_left"], s["missing_right"], s["non_finite"]) == (5, 1, 2, 1, 1)
    assert s["warnings"] == "VERY_SMALL_SAMPLE,EXCESSIVE_MISSINGNESS"


def test_effects_and_tests(spark):
    left, right = [1.0, 2.0, 3.0, 4.0], [2.0, 2.0, 4.0, 6.0]
    a = alignment.align(side(spark, dict(zip("abcd", left, strict=True))), side(spark, dict(zip("abcd", right, strict=True))), ["metric", "id"])
    e = one(alignment.continuous_effects(a, ["metric"]))
    assert (e["mean_difference"], e["median_difference"], e["relative_difference"], e["superiority"]) == pytest.approx((1, 1, 0.4, 0.875))
    t = one(inference.paired_t(a.where("paired"), ["metric"], "difference"))
    assert t["statistic"] == pytest.approx(1 / (math.sqrt(2 / 3) / 2))
    assert one(inference.sign_test(inference.sign_counts(a.where("paired"), ["metric"], "difference")))["p_value"] == pytest.approx(0.25)
    assert one(inference.wilcoxon(a.where("paired"), ["metric"], "difference"))["statistic"] == 0


def test_exact_permutation(spark):
    rows = [("m", k, x) for k, x in enumerate([1.0, 2.0, 3.0, -1.0, 0.0])] + [("ties", 1, 0.0), ("ties", 2, 0.0)]
    df = spark.createDataFrame(rows, "metric string, id long, d double")
    xs = [1.0, 2.0, 3.0, -1.0]
    sums = [sum(x * s for x, s in zip(xs, signs, strict=True)) for signs in itertools.product((1, -1), repeat=4)]
    tails = {"two-sided": lambda s: abs(s) >= 5, "greater": lambda s: s >= 5, "less": lambda s: s <= 5}
    for name, tail in tails.items():
        got = {r["metric"]: r for r in inference.permutation_test(df, ["metric"], "d", unit="id", alternative=name).collect()}
        assert got["m"]["p_value"] == pytest.approx(sum(map(tail, sums)) / 16) and got["m"]["method"] == "paired_permutation_exact"
        assert (got["ties"]["p_value"], got["ties"]["n"]) == (1.0, 0)
    with pytest.raises(ValueError):
        inference.permutation_test(df, ["metric"], "d", resamples=600, unit="id")


@pytest.mark.parametrize("test", comparison.TESTS)
def test_comparison(spark, test):
    left = spark.createDataFrame([("m", f"r{k}", "succeeded", float(k % 5)) for k in range(40)] + [("only left", "r0", "succeeded", 1.0)], "metric string, record_id string, status string, value double")
    right = spark.createDataFrame([("m", f"r{k}", "succeeded", k % 5 + 1.0 + k % 3 / 10) for k in range(40)], left.schema)
    got = one(comparison.compare_metrics(left, right, test=test, practical=0.5))
    assert got["metric"] == "m" and got["paired_n"] == 40 and got["p_value"] < 0.01
    assert got["lower"] < got["mean_difference"] < got["upper"] and got["mean_difference"] == pytest.approx(1.0975)
    assert got["interpretation"] == "statistically_significant_and_practically_meaningful"
    with pytest.raises(Exception, match="two finite pairs"):
        comparison.compare_metrics(left, right.where("record_id = 'r1'"), test=test).collect()


def test_failures_as_zero(spark):
    left = spark.createDataFrame([("m", "a", "failed", None), ("m", "b", "succeeded", 1.0)], "metric string, id string, status string, value double")
    right = side(spark, {"a": 1.0, "b": 2.0})
    assert alignment.align(left, right, ["metric", "id"], "failures_as_zero").where("paired").count() == 2
    assert alignment.align(left, right, ["metric", "id"]).where("paired").count() == 1


def test_adjustments(spark):
    p = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "family string, key string, p double")
    got = {r["key"]: (r["bonferroni"], r["holm"], r["bh"]) for r in inference.adjust_p_values(p).collect()}
    assert got["a"] == pytest.approx((0.03, 0.03, 0.03)) and got["b"] == pytest.approx((0.12, 0.06, 0.04)) and got["c"] == pytest.approx((0.09, 0.06, 0.04))


def test_binary_effects(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 1)], "l int, r int")
    e = one(agreement.binary_effects(df, "l", "r"))
    assert (e["risk_difference"], e["only_left"], e["only_right"], e["odds_ratio"]) == (0.25, 1, 2, 2.0)


def test_rank_correlation(spark):
    df = spark.createDataFrame(list(zip([1, 2, 3, 4], [1, 2, 4, 3], strict=True)), "a int, b int")
    assert one(agreement.spearman(df, "a", "b"))["spearman"] == pytest.approx(0.8)
    assert one(agreement.kendall_tau_b(df, "a", "b"))["tau_b"] == pytest.approx(2 / 3)


def test_calibration(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("tie", "tie")], "a string, b string")
    assert one(agreement.weighted_kappa(df, "a", "b", "nominal"))["kappa"] == pytest.approx(0.6363636364)
    m = one(aggregates.classification_metrics(df, "a", "b"))
    assert m["accuracy"] == 0.75 and m["micro_f1"] == pytest.approx(0.75)


def test_classification_of_given_labels(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("C", "A")], "a string, b string")
    m = one(aggregates.classification_metrics(df, "a", "b", ["A", "B", "never"]))
    assert m["macro_precision"] == pytest.approx((0.5 + 0.5 + 0) / 3) and m["macro_recall"] == pytest.approx((0.5 + 1 + 0) / 3)
    assert m["weighted_precision"] == pytest.approx(0.5) and m["weighted_recall"] == pytest.approx(2 / 3)
    assert m["accuracy"] == 0.5 and m["weighted_f1"] == pytest.approx((2 * 0.5 + 2 / 3) / 3)


def test_position_bias_without_winners(spark):
    df = spark.createDataFrame([("x", "tie"), ("y", "A"), ("y", "A"), ("y", "B")], "k string, verdict string")
    got = {r["k"]: tuple(r)[1:] for r in pairwise.position_bias(df, ["k"]).collect()}
    assert got["x"] == (0.5, 0.0, 0) and got["y"] == pytest.approx((2 / 3, 1 / 6, 3))


def test_arguments_of_another_order_are_the_same_call(spark):
    step = "array<struct<step int, kind string, tool string, arguments string, success boolean>>"
    calls = ['{"a": 1, "b": {"y": [1, 2], "x": null}}', '{"b":{"x":null,"y":[1,2]},"a":1}', '{"b":{"x":null,"y":[2,1]},"a":1}', "not json", "not json"]
    df = spark.createDataFrame([([(i, "tool_call", "t", c, None) for i, c in enumerate(calls)],)], f"steps {step}")
    assert df.select(trajectory.redundant_call_rate(F.col("steps"))).first()[0] == pytest.approx(2 / 5)


def test_fake_provider(spark):
    df = spark.createDataFrame([("\u3000 say END no\t",), ("broken",), ("known",)], "prompt string")
    got = {r["prompt"]: r for r in readers.fake_generate(df, "f", 7, {"known": "a|b END"}, stop=("END", "", "|"), failures={"broken": "timeout"}).collect()}
    first = got["\u3000 say END no\t"]
    assert first["response"] == "fake:say " and got["known"]["response"] == "a" and first["error"] is None
    assert first["request_id"] == "fake-" + hashlib.sha256("f\0\u3000 say END no\t\x007".encode()).hexdigest()[:24]
    assert got["broken"]["response"] is None and got["broken"]["error"] == "scripted fake failure: timeout"
    assert "error" not in readers.fake_generate(df, "f", 7).columns


def test_benchmark_cases(spark):
    kind = "id string, category string, prompt string, accepted_answers array<string>"
    good = [(" 1 ", "c\t", " p", [" a "]), ("2", "c", "q", ["b", "c"])]
    made = readers.benchmark_cases(spark.createDataFrame(good, kind)).orderBy("id").collect()
    assert [tuple(r) for r in made] == [("1", "c", "p", ["a"]), ("2", "c", "q", ["b", "c"])]
    for bad in ((" ", "c", "p", ["a"]), (None, "c", "p", ["a"]), ("1", "c", "p", ["a"]), ("3", " ", "p", ["a"]), ("3", "c", None, ["a"]), ("3", "c", "p", []), ("3", "c", "p", None), ("3", "c", "p", ["a", "\t"])):
        with pytest.raises(Exception, match="a case"):
            readers.benchmark_cases(spark.createDataFrame([*good, bad], kind)).collect()
    with pytest.raises(ValueError, match="two cases"):
        readers.benchmark_cases(spark.createDataFrame(good[:1], kind))


@pytest.mark.parametrize("line,fault", [("[1]", "JSON object"), ("x", "JSON object"), ('{"key": "a", "payload": [1]}', "payload must be"), ('{"key": "a", "payload": null}', "payload must be")])
def test_envelopes_of_no_object(spark, line, fault):
    df = spark.createDataFrame([(1, '{"key": "k", "payload": {"b": 1}}'), (2, line)], "row int, line string")
    assert readers.normalize_envelope(df.where("row = 1")).first()["payload"] == '{"b":1}'
    with pytest.raises(Exception, match=f"{fault}.*row 2"):
        readers.normalize_envelope(df).collect()


def test_values_have_to_be_finite(spark):
    rows = spark.createDataFrame([(1, "succeeded", 1.0), (2, "succeeded", math.nan), (3, "failed", None)], "id int, status string, value double")
    assert {r["id"]: r["paired"] for r in alignment.align(rows, rows, ["id"]).collect()} == {1: True, 2: False, 3: False}
    assert alignment.align(rows.where("id <> 2"), rows.where("id <> 2"), ["id"], strict=True).count() == 2
    with pytest.raises(Exception, match="finite"):
        alignment.align(rows, rows, ["id"], strict=True).collect()


def test_judge_output_and_delays(spark):
    good = {"schema_version": "1.0", "verdict": "A", "scores": {"q": 4}, "confidence": 0.5, "evidence": ["A:L0001"], "justification": "x"}
    df = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(good | {"scores": {}})), (3, None)], "id int, response string")
    got = {r["id"]: r for r in judge.parse_responses(df, {"q": (0, 5)}, ["A:L0001"]).collect()}
    assert got[1]["scores"] == {"q": 4.0} and got[1]["evidence"] == ["A:L0001"] and got[1]["error"] is None
    other = judge.parse_responses(df.where("id = 1"), {"q": (0, 5)}, ["A:L0001"], version=judge.VERSION).first()
    assert other["error"] == "schema version" and other["verdict"] is None
    assert got[2]["scores"] is None and got[2]["evidence"] is None and got[2]["error"] == "dimensions" and got[3]["error"]
    row = spark.range(1).select(*[judge.retry_delay(F.lit(7), F.lit(2), F.lit(a), 20.0).alias(f"d{a}") for a in (1, 3, 9)], judge.nonce("j", "1", F.lit(7), F.lit(2)).alias("n")).first()
    jitter = lambda a: int(hashlib.sha256(f"7|2|{a}".encode()).hexdigest()[:4], 16) / 65535
    assert row["d1"] == pytest.approx(1 + jitter(1)) and row["d3"] == pytest.approx(4 + jitter(3)) and row["d9"] == 10
    assert row["n"] == hashlib.sha256(b"j|1|7|2").hexdigest()[:32]


def test_money(spark):
    rows = [("a", 0.1, "usd"), ("a", 0.2, " USD"), ("b", 5.0, "eur"), ("c", None, "eur"), ("d", 1.0, None)]
    df = spark.createDataFrame(rows, "k string, v double, c string").withColumn("m", money.money(F.col("v"), F.col("c")))
    got = {r["k"]: r["total"] for r in money.total(df, ["k"], "m").collect()}
    assert (got["a"]["amount"], got["a"]["currency"]) == (Decimal("0.3").quantize(Decimal(10) ** -12), "USD") and got["b"]["currency"] == "EUR" and got["c"] is None and got["d"] is None
    half = spark.createDataFrame([("0.0000000000005",), ("0.0000000000015",)], "v string").select(money.money(F.col("v"), F.lit("usd"))["amount"].alias("a")).collect()
    assert [r["a"] for r in half] == [0, Decimal("0.000000000002")]
    usd = lambda v: money.money(F.lit(v), F.lit("usd"))
    assert spark.range(1).select(money.minus(usd(3), usd(1))["amount"], money.plus(usd(3), usd(1))["amount"]).first()[:] == (2, 4)
    eur = money.money(F.lit(1), F.lit("eur"))
    for bad in (usd(-1), usd(math.nan), money.money(F.lit(1), F.lit("us")), money.minus(usd(1), usd(2)), money.plus(usd(1), eur), money.minus(usd(1), eur)):
        with pytest.raises(Exception, match="money|currenc"):
            spark.range(1).select(bad.alias("m")).collect()
    with pytest.raises(Exception, match="currencies must match"):
        money.total(df.withColumn("k", F.lit(1)), ["k"], "m").collect()


def test_rankings():
    pairs = [(0, 1, 18, 2, 5), (0, 2, 15, 5, 4), (1, 2, 12, 8, 3)]
    for f in (rankings.bradley_terry, rankings.davidson):
        a, b, c = f(3, pairs)
        assert a > b > c and a + b + c == pytest.approx(1)
    assert sum(rankings.elo(3, pairs)) == pytest.approx(4500)


# --- gates, judging ---


def test_gate(spark):
    c = spark.createDataFrame([("m", 50, 0.4, -0.1, -0.2, "inconclusive")], "metric string, n long, candidate_mean double, mean_difference double, lower double, interpretation string")
    rules = spark.createDataFrame([("a", "m", "minimum", 0.5, 10, True), ("b", "m", "maximum_regression", 0.2, 10, True), ("c", "x", "minimum", 0.0, 1, False), ("d", "m", "minimum", 0.0, 100, False)], gates.RULES)
    got = {r["identifier"]: (r["passed"], r["reason"]) for r in gates.evaluate_rules(c, rules).collect()}
    assert got == {"a": (False, "violated"), "b": (True, "holds"), "c": (False, "metric is absent"), "d": (False, "too few pairs")}
    assert one(gates.gate(gates.evaluate_rules(c, rules)))["passed"] is False


def test_interpretation(spark):
    df = spark.createDataFrame([(-2.0, -1.0, 0.01, -1.5), (0.5, 2.0, 0.01, 1.2), (0.1, 0.4, 0.01, 0.2), (-0.5, 0.5, 0.9, 0.0), (-3.0, 3.0, 0.9, 0.0)], "lo double, hi double, p double, m double")
    got = [r[0] for r in df.select(alignment.interpret(F.col("lo"), F.col("hi"), F.col("p"), F.col("m"), 1.0)).collect()]
    assert got == ["meaningful_regression", "significant_meaningful", "significant", "within_tolerance", "inconclusive"]


def test_judgments(spark):
    df = spark.createDataFrame([(1, v, 0.5) for v in ("A", "A", "B", "abstain")] + [(2, "abstain", 0.5)], "id int, verdict string, confidence double")
    got = {r["id"]: r for r in pairwise.aggregate_judgments(df, "id").collect()}
    assert (got[1]["verdict"], got[1]["usable"], got[1]["abstained"]) == ("A", 3, 1) and got[1]["disagreement"] == pytest.approx(1 / 3)
    assert (got[2]["verdict"], got[2]["disagreement"]) == ("tie", 1.0)
    none = pairwise.aggregate_responses(df.withColumn("scores", F.create_map(F.lit("q"), F.lit(1.0))), ["id"])
    assert {r["id"]: r["verdict"] for r in none.collect()} == {1: "A", 2: "abstain"}


def test_balanced_design(spark):
    records = spark.createDataFrame([(f"r{i}",) for i in range(20)], "record_key string")
    d = pairwise.balanced_assignments(pairwise.pair_cells(records, ["a", "b", "c"], 2, 2), 91, reversed_pairs=True, chunks=4)
    assert d.count() == 480 and d.select("assignment_id").distinct().count() == 480
    first = d.where("not reversed").groupBy(F.least("variant_a", "variant_b").alias("x"), F.greatest("variant_a", "variant_b").alias("y")).agg((2 * F.count_if(F.col("variant_a") < F.col("variant_b")) - F.count("*")).alias("gap"))
    assert all(abs(r["gap"]) <= 1 for r in first.collect())


def test_judge_contract():
    ok = {"schema_version": "1", "verdict": "A", "scores": {"q": 3}, "confidence": 0.5, "evidence": ["A:L0001"], "justification": "x", "abstention_reason": None}
    assert judge.check("```json\n" + json.dumps(ok) + "\n```", {"q": (0, 5)}, ["A:L0001"])["verdict"] == "A"
    for change in ({"verdict": "C"}, {"scores": {}}, {"scores": {"q": 9}}, {"evidence": ["B"]}, {"extra": 1}, {"verdict": "abstain"}, {"justification": " "}):
        with pytest.raises(ValueError):
            judge.check(json.dumps(ok | change), {"q": (0, 5)}, ["A:L0001"])


def test_predicates(spark):
    for bad in ({"field": "a", "operator": "like", "value": 1}, {"field": "a", "operator": "equals"}, {"field": "a", "operator": "range"}, {"field": "a", "operator": "exists", "value": 1}):
        with pytest.raises(ValueError):
            predicates.compile_predicate(bad)


def test_registry(spark):
    reg = default_registry()
    assert len(reg.metrics) == 44
    with pytest.raises(ValueError):
        reg.register(Definition("bleu", "text", "maximize", "score"), None)
    df = spark.createDataFrame([("1", "a", "a"), ("2", "a", None)], "sample_id string, prediction string, reference string")
    got = {r["sample_id"]: (r["status"], r["value"]) for r in reg.evaluate(df, ["exact-match"]).collect()}
    assert got == {"1": ("succeeded", 1.0), "2": ("missing_field", None)}


def test_aggregate_mean(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", 0.0), ("m", None), ("m", float("nan"))], "k string, x double")
    r = one(aggregates.aggregate_mean(df, ["k"], "x", failed=2))
    assert tuple(r[1:]) == (0.5, 6, 2, 2, 2)


def test_multilabel(spark):
    df = spark.createDataFrame([(["a", "b"], ["a"]), (["b"], ["b"])], "e array<string>, p array<string>")
    assert one(aggregates.multilabel_metrics(df, "e", "p"))["subset_accuracy"] == 0.5
    none = spark.createDataFrame([([], [])], df.schema)
    assert list(one(aggregates.multilabel_metrics(none, "e", "p"))) == [1.0] * 5


def test_secrets_in_a_configuration():
    patterns.reject_secrets({"model": "m", "options": [{"temperature": 0}]})
    for bad in ({"api-key": "x"}, {"a": [{"Token": 1}]}):
        with pytest.raises(ValueError):
            patterns.reject_secrets(bad)


def test_bootstraps_agree(spark):
    rows = spark.range(400).selectExpr("'m' as metric", "id", "(id % 20) + 1.0D as x")
    classic = one(inference.bootstrap_groups(rows, ["metric"], "x", lambda v: v.mean(), "percentile", 400, 1))
    weighted = one(inference.poisson_bootstrap_mean(rows, ["metric"], "id", "x", 400, 1))
    assert weighted["lower"] == pytest.approx(classic["lower"], abs=0.2) and weighted["upper"] == pytest.approx(classic["upper"], abs=0.2)
    assert one(inference.paired_bootstrap_test(rows, ["metric"], "id", "x"))["p_value"] < 0.01
    assert one(inference.permutation_test(rows.withColumnRenamed("id", "record_id"), ["metric"], "x"))["p_value"] < 0.01
    with pytest.raises(Exception, match="too large"):
        inference.bootstrap_groups(rows, ["metric"], "x", lambda v: v.mean(), max_n=10).collect()


def test_reports(spark, tmp_path):
    from sparkeval.sources import sinks

    df = spark.createDataFrame([("=1+1", 0.1234567, None), ("a|b<c>", 2.0, 3)], "name string, x double, n int")
    assert "| a\\|b<c> | 2 | 3 |" in sinks.as_markdown(df) and "0.123457" in sinks.as_markdown(df)
    assert "a|b&lt;c&gt;" in sinks.as_html(df) and json.loads(sinks.as_json(df))[0]["name"] == "=1+1"
    assert sinks.safe_table(df).first()["name"] == "'=1+1"
    sinks.publish_version(df, str(tmp_path), "1", "h")
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.publish_version(df, str(tmp_path), "1", "h")


def test_golden_digest(spark):
    """Two texts of one record have one digest, whose value is fixed."""
    field = lambda kind, **more: {"type": kind, **more}
    schema = {"properties": {"text": field("string"), "when": field("string", format="date-time"), "optional": field(["string", "null"]), "score": field("number")}}
    texts = ['{"text":"Cafe\\u0301\\r\\nline","when":"2024-01-01T05:30:00+05:30","score":-0.0}', '{"score":0,"optional":null,"when":"2024-01-01T00:00:00Z","text":"Café\\nline"}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(F.sha2(canonical.canonical_json_with(json.dumps(schema))(F.col("t")), 256)).collect()
    assert {r[0] for r in got} == {"41e8ffe1d572578fd3eab5c8d773760c09978bfffd1a74e6b1038b87e0c73775"}


def test_splits_need_names(spark):
    df = spark.createDataFrame([("k", "1")], "k string, p string")
    with pytest.raises(Exception, match="split has no name"):
        datasets.build_records(df, F.col("k"), F.col("p"), F.lit("{}"), F.array(F.lit(" ")), F.lit("{}")).collect()


# --- values by the published definitions ---


def test_alpha_draws_without_replacement(spark):
    # three units of two ratings and one of a single: pairs differ in 1 of 3; a 4, b 3 of 7 values
    rows = [(1, "a"), (1, "a"), (2, "b"), (2, "b"), (3, "a"), (3, "b"), (4, "a"), (5, None)]
    df = spark.createDataFrame(rows, "unit int, label string")
    assert one(agreement.krippendorff_nominal(df))[0] == pytest.approx(1 - (1 / 3) / (1 - (12 + 6) / 42))
    assert one(agreement.krippendorff_nominal(df.where("label = 'a'")))[0] == 1.0
    assert one(agreement.krippendorff_nominal(df.where("unit = 4")))[0] is None


def test_benchmark_consistency(spark):
    rows = [("x", "c1", False, True, "1", 10)] * 3 + [("x", "c2", False, False, w, 10) for w in "abc"] + [("x", "c3", True, False, None, 0), ("x", "c3", False, True, "1", 5), ("x", "c3", False, True, "1", 5)]
    df = spark.createDataFrame(rows, "category string, case_id string, failed boolean, correct boolean, response string, tokens long")
    got = one(aggregates.benchmark_by_category(df, 3))
    assert (got["cases"], got["majority_correct"], got["consistent"], got["requests"], got["failures"], got["tokens"]) == (3, 2, 1, 9, 1, 70)
    with pytest.raises(Exception, match="repetitions"):
        aggregates.benchmark_by_category(df, 4).collect()


def test_where_a_loop_begins(spark):
    kind = "array<struct<step:bigint,kind:string,tool:string,arguments:string,success:boolean,decision:string>>"
    call = lambda i, a: (i, "tool_call", "t", a, None, None)
    loop = [(0, "model_decision", None, None, None, "p"), *[call(i + 1, "xy"[i % 2]) for i in range(6)]]
    thought = [(i, "model_decision", None, None, None, d) for i, d in enumerate("pqr")]
    df = spark.createDataFrame([(loop,), (thought,), ([(0, "tool_call", "a", None, None, "b"), (1, "tool_call", "a", "b", None, None), (2, "tool_call", "a", None, None, "b")],)], f"steps {kind}")
    got = [r[0] for r in df.select(trajectory.find_loop(F.col("steps"), 3, 4, "decision")).collect()]
    assert [g and tuple(g) for g in got] == [(1, 2), None, None]
    # without their decisions the three steps are one action
    assert tuple(df.where("size(steps) = 3").select(trajectory.find_loop(F.col("steps"), 3)).first()[0]) == (0, 1)


def test_minhash_key(spark):
    df = spark.createDataFrame([("one two three four",)], "t string")
    grams = ["one\x1ftwo\x1fthree", "two\x1fthree\x1ffour"]
    want = []
    for p in range(4):
        key = hashlib.sha256((7).to_bytes(8, "big") + p.to_bytes(4, "big")).digest()
        want.append(min(hashlib.blake2b(g.encode(), key=key, digest_size=8).hexdigest() for g in grams))
    assert one(df.select(canonical.minhash_signature(3, 4, 7)(F.col("t"))))[0] == ",".join(want)


def test_refresh_tokens_are_secrets():
    with pytest.raises(ValueError):
        patterns.reject_secrets({"a": {"refresh-token": "x"}})


@pytest.mark.parametrize(
    "raw, want",
    [("```text Yes.```", "yes"), ("``` text Yes.```", "text yes"), ("```TEXT\nYes\n```", "yes"), ("```python\nx\n```", "python x"), ("```Straße!\n```", "strasse"), ("e\u0301 \u3000x?", "é x"), ("a..", "a."), (" \u00a0", "")],
)
def test_benchmark_answers(spark, raw, want):
    assert one(spark.createDataFrame([(raw,)], "t string").select(patterns.benchmark_answer(F.col("t"))))[0] == want


def test_published_verdicts(spark):
    df = spark.createDataFrame([(-2.0, -1.0, 0.01, -1.5), (-3.0, 3.0, 0.9, 0.0)], "lo double, hi double, p double, m double")
    got = [r[0] for r in df.select(alignment.interpretation(F.col("lo"), F.col("hi"), F.col("p"), F.col("m"), 1.0)).collect()]
    assert got == ["evidence_of_meaningful_regression", "not_statistically_conclusive"]
    rule = spark.createDataFrame([("r", "m", "no_meaningful_regression", 0.0, 1, True)], gates.RULES)
    c = spark.createDataFrame([("m", 5, 0.0, 0.0, 0.0, got[0])], "metric string, n long, candidate_mean double, mean_difference double, lower double, interpretation string")
    assert one(gates.evaluate_rules(c, rule))["passed"] is False


def test_drift_alerts_on_scores_alone(spark):
    kind = "verdict string, confidence double, clarity double"
    a, b = spark.createDataFrame([("A", 0.1, 3.0)] * 4, kind), spark.createDataFrame([("A", 0.9, 3.2)] * 4, kind)
    calm = one(pairwise.judge_drift(a, b, dimensions=("clarity",)))
    assert calm["alert"] is False and calm["clarity_shift"] == pytest.approx(0.2) and calm["confidence_shift"] == pytest.approx(0.8)
    assert one(pairwise.judge_drift(a, b.withColumn("clarity", F.lit(1.0)), dimensions=("clarity",)))["alert"] is True


def test_links_form_a_chain(spark):
    rows = [(o, i, hashlib.sha256(f"{o}{i}".encode()).hexdigest()) for o in ("x", "y", None) for i in range(40)]
    got = lifecycle.hash_chain(spark.createDataFrame(rows, "org string, seq int, h string").repartition(5), "org", "seq", "h").collect()
    last: dict = {}
    want = {}
    for o, i, h in rows:
        last[o] = want[(o, i)] = hashlib.sha256((last.get(o, "0" * 64) + h).encode()).hexdigest()
    assert {(r["org"], r["seq"]): r["chain"] for r in got} == want


def test_states_that_may_not_follow(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(["draft", "validating", "queued", "running", "pausing", "queued", "completed", "odd"])], "run int, at int, state string")
    got = [(r["before"], r["state"]) for r in lifecycle.illegal_transitions(df, "run", ["at"], "state").collect()]
    assert sorted(got) == [("completed", "odd"), ("pausing", "queued"), ("queued", "completed")]
