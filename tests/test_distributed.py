"""Recursive differences, rank correlation, resampling, rankings and stores against plain versions."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkeval.functions import ranking, special
from sparkeval.functions.json_walk import json_changes
from sparkeval.operators import agreement, aggregates, datasets, inference, rankings, resampling
from sparkeval.plans.registry import Definition, default_registry
from sparkeval.sources import store
from sparkeval.streaming import progress, windows


# --- recursive differences ---


def plain_changes(b, a, pointer=""):
    if isinstance(b, dict) and isinstance(a, dict):
        out = []
        for k in sorted(set(b) | set(a)):
            child = pointer + "/" + k.replace("~", "~0").replace("/", "~1")
            if k not in b:
                out.append((child, None, a[k]))
            elif k not in a:
                out.append((child, b[k], None))
            elif json.dumps(b[k]) != json.dumps(a[k]):
                out += plain_changes(b[k], a[k], child)
        return out
    return [(pointer or "/", b, a)]


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([0, 1, 2.5, "x", "1", "{", None, True, False, [1, {"a": 1}], [], {}])
    return {k: tree(rng, depth - 1) for k in sorted(rng.sample(["a", "b", "a/b", "~", "~1", "", "é"], rng.randrange(4)))}


def test_json_changes_equal_a_plain_walk(spark):
    rng, pairs = random.Random(5), []
    for _ in range(400):
        b = tree(rng, 5)
        a = json.loads(json.dumps(b))
        node = a
        while isinstance(node, dict) and node and rng.random() < 0.9:
            k = rng.choice(list(node))
            if rng.random() < 0.4:
                node[k] = tree(rng, 2)
                break
            node = node[k]
        pairs.append((b, a if rng.random() < 0.8 else tree(rng, 4)))
    text = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    df = spark.createDataFrame([(i, text(b), text(a)) for i, (b, a) in enumerate(pairs)], "i int, b string, a string")
    got = {r["i"]: r["c"] for r in df.select("i", json_changes(F.col("b"), F.col("a")).alias("c")).collect()}
    nested = 0
    for i, (b, a) in enumerate(pairs):
        want = [] if text(b) == text(a) else plain_changes(json.loads(text(b)), json.loads(text(a)))
        assert [(c["pointer"], None if c["before"] is None else json.loads(c["before"]), None if c["after"] is None else json.loads(c["after"])) for c in got[i]] == want, (b, a)
        nested += any(p.count("/") > 2 for p, _, _ in want)
    assert nested > 20


def test_diff_of_records_reports_nested_pointers(spark):
    def version(rows):
        df = spark.createDataFrame(rows, "key string, payload string, metadata string, source string")
        return datasets.build_records(df, F.col("key"), F.col("payload"), F.col("metadata"), F.array(F.lit("test")), F.col("source"))

    keep = ("keep", '{"input":"same","label":"l"}', "{}", "{}")
    before = version([keep, ("edit", '{"input":"old","label":"l"}', '{"stratum":"a"}', "{}"), ("remove", "{}", "{}", "{}"), ("moved", "{}", "{}", '{"uri":1}')])
    after = version([keep, ("edit", '{"input":"new","label":"l"}', '{"stratum":"b"}', "{}"), ("add", "{}", "{}", "{}"), ("moved", "{}", "{}", '{"uri":2}')])
    d = {r["key"]: (r["kind"], [tuple(c) for c in r["changes"]]) for r in datasets.diff_records(before, after).collect()}
    assert d == {
        "keep": ("unchanged", []),
        "edit": ("modified", [("/metadata/stratum", '"a"', '"b"'), ("/payload/input", '"old"', '"new"')]),
        "remove": ("removed", []),
        "add": ("added", []),
        "moved": ("modified", []),  # its origin alone differs
    }


# --- rank correlation ---


def plain_tau_b(x, y):
    c = d = tx = ty = 0
    for i in range(len(x)):
        s = np.sign(x[i] - x[i + 1 :]) * np.sign(y[i] - y[i + 1 :])
        c += int((s > 0).sum())
        d += int((s < 0).sum())
        tx += int((x[i] == x[i + 1 :]).sum())
        ty += int((y[i] == y[i + 1 :]).sum())
    n = len(x) * (len(x) - 1) // 2
    return (c - d) / np.sqrt((n - tx) * (n - ty)) if tx < n and ty < n else None


@pytest.mark.parametrize(("n", "ties"), [(10_000, 0), (3000, 12), (2000, 1), (2, 0), (1, 0)])
def test_kendall_equals_all_pairs(spark, monkeypatch, n, ties):
    monkeypatch.setattr(agreement, "INVERSION_ROWS", 700)
    rng = np.random.default_rng(n + ties)
    x = rng.normal(size=n)
    y = x + rng.normal(size=n)
    if ties:
        x, y = np.round(x * ties) / ties, np.where(rng.random(n) < 1 / 3, 0.0, y)  # a third of the rows share a value
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist(), strict=True), (None, 1.0)], "a double, b double")
    plan = agreement.kendall_tau_b(df, "a", "b")
    got, want = plan.first()["tau_b"], plain_tau_b(x, y)
    assert (got is None) == (want is None) and (want is None or abs(got - want) < 1e-12)


# --- resampling ---


def classic(x, statistic, method, resamples, seed, confidence=0.95):
    rng = np.random.default_rng(seed)
    draws, est = np.array([statistic(rng.choice(x, len(x))) for _ in range(resamples)]), statistic(x)
    acc = 0.0
    if method == "bca":
        jack = np.array([statistic(np.delete(x, i)) for i in range(len(x))])
        dev = jack.mean() - jack
        acc = (dev**3).sum() / (6 * (dev**2).sum() ** 1.5) if dev.any() else 0.0
    return resampling.limits(draws, est, method, confidence, acc)


@pytest.fixture(scope="module")
def grouped(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(x), f"c{i % 40}", f"s{i % 3}") for i, x in enumerate(rng.gamma(2, 10, 3000))]
    rows += [("b", float(x), f"c{i % 25}", "s") for i, x in enumerate(np.round(rng.normal(5, 2, 400)))]
    rows += [("few", float(x), "c", "s") for x in (1, 2, 2, 7)] + [("one", 3.0, "c", "s"), ("a", None, "c", "s")]
    df = spark.createDataFrame(rows, "k string, x double, c string, s string").repartition(3).cache()
    return df, {k: np.array([r[1] for r in rows if r[0] == k and r[1] is not None]) for k in ("a", "b", "few", "one")}


@pytest.mark.parametrize("method", resampling.METHODS)
@pytest.mark.parametrize("p", [0.5, 0.9])
def test_quantile_bootstrap_has_the_classic_limits(grouped, method, p):
    df, groups = grouped
    got = {r["k"]: r for r in resampling.bootstrap_quantile(df, ["k"], "x", p, method, 4000, 1).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert got[k]["estimate"] == pytest.approx(np.quantile(x, p)) and got[k]["n"] == len(x)
        if k in ("a", "b"):
            want = classic(x, lambda v: np.quantile(v, p), method, 4000, 1)
            assert (got[k]["lower"], got[k]["upper"]) == pytest.approx(want, abs=0.06 * x.std()), k
    assert got["few"]["warnings"] == "VERY_SMALL_SAMPLE,UNSTABLE_INTERVAL" and got["a"]["warnings"] == ""
    assert "ZERO" not in got["one"]["warnings"] and got["one"]["lower"] == got["one"]["upper"] == 3.0


@pytest.mark.parametrize("values", [20_000, 64])
@pytest.mark.parametrize("method", resampling.METHODS)
def test_bootstrap_of_sums_has_the_classic_limits(grouped, method, values, monkeypatch):
    monkeypatch.setattr(resampling, "BIN_VALUES", values)
    df, groups = grouped
    for statistic, features, plain in ((resampling.mean_of, lambda x: [x], np.mean), (resampling.sd_of, lambda x: [x, x * x], lambda v: np.std(v, ddof=1) if len(v) > 1 else 0.0)):
        got = {r["k"]: r for r in resampling.bootstrap_sums(df, ["k"], "x", statistic, features, method, 2000, 3).collect()}
        assert set(got) == set(groups)
        for k in ("a", "b"):
            want = classic(groups[k], plain, method, 2000, 3)
            assert got[k]["estimate"] == pytest.approx(plain(groups[k])) and got[k]["n"] == len(groups[k])
            assert got[k]["upper"] - got[k]["lower"] == pytest.approx(want[1] - want[0], rel=0.1)
            assert (got[k]["lower"], got[k]["upper"]) == pytest.approx(want, abs=0.15 * (want[1] - want[0])), (k, method)


def test_strata_keep_their_sizes(spark):
    rows = [("k", 100.0 * s + i % 3, s) for s in range(4) for i in range(30 * (s + 1))]
    df = spark.createDataFrame([*rows, ("k", 9.0, None)], "k string, x double, s int")
    free = resampling.bootstrap_sums(df, ["k"], "x", resamples=1000).first()
    kept = resampling.bootstrap_sums(df, ["k"], "x", resamples=1000, stratum="s").first()
    assert kept["estimate"] == pytest.approx(free["estimate"]) and kept["n"] == 301
    sd = np.sqrt(sum((30 * (s + 1) / 301) ** 2 * np.var([i % 3 for i in range(30 * (s + 1))]) / (30 * (s + 1)) for s in range(4)))
    assert kept["upper"] - kept["lower"] == pytest.approx(2 * 1.96 * sd, rel=0.1)  # within strata alone
    assert free["upper"] - free["lower"] > 20 * (kept["upper"] - kept["lower"])


def test_clusters_are_drawn_whole(grouped):
    df, _ = grouped
    got = {r["k"]: r for r in resampling.bootstrap_sums(df, ["k"], "x", resamples=2000, cluster="c").collect()}
    pdf = df.where("x is not null").toPandas()
    for k in ("a", "b"):
        sums = pdf[pdf.k == k].groupby("c")["x"].agg(["sum", "count"]).to_numpy()
        rng = np.random.default_rng(8)
        picks = [sums[rng.integers(len(sums), size=len(sums))].sum(axis=0) for _ in range(4000)]
        want = np.quantile([a / n for a, n in picks], [0.025, 0.975])
        assert (got[k]["lower"], got[k]["upper"]) == pytest.approx(want, abs=0.12 * (want[1] - want[0]))
        assert got[k]["n_effective"] == len(sums) and got[k]["warnings"] == ""
    assert got["few"]["n_effective"] == 1 and got["few"]["warnings"] == "VERY_SMALL_SAMPLE,TOO_FEW_CLUSTERS"


def test_cluster_quantiles_are_exact_for_their_weights(grouped):
    df, groups = grouped
    b = 300
    got = {(r["k"], r["p"]): r for r in resampling.cluster_quantiles(df, ["k"], "c", "x", [0.5, 0.95], b, 4).collect()}
    pdf = df.where("x is not null").withColumn("u", F.xxhash64("c", "k")).toPandas()
    for k in groups:
        part = pdf[pdf.k == k]
        w = resampling.cluster_weights(part["u"].to_numpy(), b, 4)
        for p in (0.5, 0.95):
            draws = [np.quantile(np.repeat(part["x"].to_numpy(), w[:, i]), p) for i in range(b) if w[:, i].sum()]
            r = got[k, p]
            assert (r["lower"], r["upper"]) == pytest.approx(tuple(np.quantile(draws, [0.025, 0.975])))
            assert r["estimate"] == pytest.approx(np.quantile(part["x"], p)) and (r["n"], r["n_clusters"]) == (len(part), part["c"].nunique())


def test_cluster_weights_are_poisson():
    w = resampling.cluster_weights(np.arange(-500, 500), 400, 3)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.01


# --- ratings, flips, the benchmark's summary ---


def test_elo_fold_equals_the_sequential_fold(spark):
    rng = random.Random(3)
    games = [(i, *rng.sample("abcd", 2), rng.choice([1.0, 0.0, 0.5]), rng.choice([1, 1, 3])) for i in range(900)] + [(900, "a", "b", 0.5, 10**12)]
    want = dict.fromkeys("abcd", 1500.0)
    for _, a, b, score, n in games:
        for _ in range(min(n, 5000)):  # ties settle long before
            gain = 32.0 * (score - 1 / (1 + 10 ** ((want[b] - want[a]) / 400)))
            want[a] += gain
            want[b] -= gain
    shuffled = rng.sample(games, len(games))
    df = spark.createDataFrame(shuffled, "i int, a string, b string, score double, games long")
    got = {r["item"]: r["strength"] for r in rankings.elo_fold(df, ["i"], part_rows=100).collect()}
    assert got == want
    counts = spark.createDataFrame([("x", "y", 18, 2, 5), ("x", "z", 15, 5, 4), ("y", "z", 12, 8, 3)], "a string, b string, wins_a int, wins_b int, ties int")
    elo = {r["item"]: r["strength"] for r in rankings.elo_fold(rankings.games_of(counts), ["a", "b", "kind"], part_rows=2).collect()}
    assert list(elo.values()) == pytest.approx(list(rankings.elo(3, [(0, 1, 18, 2, 5), (0, 2, 15, 5, 4), (1, 2, 12, 8, 3)]))) and sum(elo.values()) == pytest.approx(4500)


@pytest.mark.parametrize("alternative", inference.ALTERNATIVES)
def test_exact_flips_equal_all_flips(spark, alternative):
    rng = random.Random(6)
    groups = {k: [rng.choice([-2, -1, 1, 2, 0.1, rng.gauss(1, 1)]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 9), ("d", 14))}
    groups["zero"] = [1.0, -1.0]
    df = spark.createDataFrame([(k, i, float(x)) for k, v in groups.items() for i, x in enumerate(v)], "k string, i int, x double")
    got = {r["k"]: r for r in inference.permutation_test(df, ["k"], "x", unit="i", alternative=alternative).collect()}
    for k, v in groups.items():
        flips = np.array([[1 if f >> j & 1 else -1 for j in range(len(v))] for f in range(2 ** len(v))]) @ np.array(v)
        total, slack = sum(v), 1e-9
        tail = {"two-sided": np.abs(flips) >= abs(total) - slack, "greater": flips >= total - slack, "less": flips <= total + slack}[alternative]
        assert got[k]["p_value"] == pytest.approx(tail.mean()), (k, v)


def test_benchmark_summary(spark):
    rows = [("a", "A", "yes", False, True), ("a", "A", "yes", False, True), ("a", "A", None, True, False), ("b", "B", "yes", False, False), ("b", "B", "no", False, True), ("b", "B", "yes", False, False)]
    df = spark.createDataFrame([(*r, 8, 2) for r in rows], "case_id string, category string, response string, failed boolean, correct boolean, input_tokens long, output_tokens long")
    r = aggregates.benchmark_summary(df, 1.5, 7.5, 3).first()
    assert (r["majority_correct"], r["accuracy"], r["correct_requests"], r["failures"], r["consistent"]) == (1, 0.5, 3, 1, 0)
    assert r["input_tokens"] + r["output_tokens"] == 60 and r["cost"] == pytest.approx((48 * 1.5 + 12 * 7.5) / 1e6)
    assert (r["failure_low"], r["failure_high"]) == pytest.approx(special.wilson(1, 6, 0.95)) and (r["accuracy_low"], r["accuracy_high"]) == pytest.approx(special.wilson(1, 2, 0.95))


# --- contamination by classes ---


def test_many_empty_and_equal_texts_give_few_rows(spark):
    copies = [(f"c{i}", "the quick brown fox jumps over the lazy dog") for i in range(5000)]
    rows = [(f"e{i}", None if i % 2 else " short ") for i in range(10_000)] + copies + [("own", "nothing that any other text here would say")]
    df = spark.createDataFrame(rows, "key string, text string")
    pairs, left, right = datasets.contamination_classes(df, df)
    got = {(r["left_first"], r["right_first"]): (r["similarity"], r["links"]) for r in pairs.collect()}
    assert got == {("e0", "e0"): (1.0, 10_000**2), ("c0", "c0"): (1.0, 5000**2), ("own", "own"): (1.0, 1)}
    assert left.count() == right.count() == len(rows) and left.groupBy("class").count().count() == 3


def test_positions_are_those_of_one_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(5) / 4, f"l{rng.randrange(50)}", f"r{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "similarity double, left_key string, right_key string").repartition(5)
    got = {r["right_key"]: r["position"] for r in datasets.ordered_matches(df).collect()}
    want = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    assert got == {r[2]: i for i, r in enumerate(want, 1)}


# --- registry ---


def test_a_metric_that_raises_fails_on_its_sample_alone(spark):
    def ratio(sample, config):
        if sample["prediction"] == "none":
            return None
        if sample["prediction"] == "text":
            return "1"
        return config["scale"] / int(sample["prediction"])

    reg = default_registry()
    schema = {"type": "object", "required": ["scale"], "properties": {"scale": {"type": "integer"}}}
    reg.register_function(Definition("ratio", "own", "maximize", "score", ("prediction",), ("qa",), 0.0, 5.0, config_schema=schema), ratio)
    rows = [("ok", "qa", "2"), ("zero", "qa", "0"), ("word", "qa", "x"), ("none", "qa", "none"), ("text", "qa", "text"), ("low", "qa", "-1"), ("high", "qa", "1"), ("kind", "rag", "2"), ("lacks", "qa", None)]
    df = spark.createDataFrame([(*r, r[2]) for r in rows], "sample_id string, task_type string, prediction string, reference string")
    got = {(r["sample_id"], r["metric"]): r for r in reg.evaluate(df, ["ratio", "exact-match"], {"scale": 8}, errors=True).collect()}
    want = {"ok": "succeeded", "zero": "failed", "word": "failed", "none": "missing", "text": "invalid_result", "low": "out_of_range", "high": "out_of_range", "kind": "wrong_task_type", "lacks": "missing_field"}
    assert {k: got[k, "ratio"]["status"] for k in want} == want and got["ok", "ratio"]["value"] == 4.0
    assert got["zero", "ratio"]["error"].startswith("ZeroDivisionError") and got["low", "ratio"]["value"] is None and got["lacks", "ratio"]["error"] is None
    assert all(got[k, "exact-match"]["status"] == ("missing_field" if k == "lacks" else "succeeded") for k in want)
    with pytest.raises(ValueError, match="ratio: the configuration fails"):
        reg.evaluate(df, ["ratio"], {"scale": "x"})
    with pytest.raises(KeyError):
        reg.evaluate(df, ["unknown"])
    with pytest.raises(ValueError, match="registered already"):
        reg.register_function(Definition("ratio", "own", "maximize", "score"), ratio)
    with pytest.raises(ValueError, match="inverted"):
        Definition("x", "own", "maximize", "score", minimum=1.0, maximum=0.0)


def test_metrics_with_configurations(spark):
    df = spark.createDataFrame(
        [("a", '{"k": 1}', "the red fox ran", [1.0, 0.0], [1.0, 0.0], ["d2", "d1"], ["d1"]), ("b", "the red fox", "the red cat", [1.0, 0.0], [0.0, 1.0], ["d1"], ["d1"])],
        "sample_id string, prediction string, reference string, prediction_vector array<double>, reference_vector array<double>, retrieved_ids array<string>, relevant_ids array<string>",
    )
    config = {"schema": {"type": "object", "required": ["k"]}, "pattern": "red", "k": 2}
    names = ["json-schema", "regex-match", "rouge-1", "rouge-2", "semantic-similarity", "ndcg-at-k", "citation-validity"]
    got = {(r["sample_id"], r["metric"]): r["value"] for r in default_registry().evaluate(df, names, config).collect()}
    assert [got["a", n] for n in names[:2]] == [1.0, 0.0] and [got["b", n] for n in names[:2]] == [0.0, 1.0]
    assert got["b", "rouge-1"] == pytest.approx(2 / 3) and got["b", "rouge-2"] == 0.5 and got["a", "rouge-1"] == 0.0
    assert got["a", "semantic-similarity"] == 1.0 and got["b", "semantic-similarity"] == 0.0
    assert got["a", "ndcg-at-k"] == pytest.approx(1 / np.log2(3)) and got["b", "ndcg-at-k"] == 1.0
    with pytest.raises(ValueError, match="json-schema"):
        default_registry().evaluate(df, ["json-schema"], {})


def test_citations_of_labelled_claims(spark):
    df = spark.createDataFrame([("Answer [source:a] and [source:missing].", ["a", "b"], []), ("[source:a] [source:a] [source:b]", ["a", "b"], ["a", "c"]), ("none", ["a"], ["a"])], "t string, known array<string>, need array<string>")
    got = [tuple(r["s"]) for r in df.select(ranking.citation_scores(F.col("t"), F.col("known"), F.col("need")).alias("s")).collect()]
    assert got == [(1.0, 0.5, None, None), (1.0, 1.0, 0.5, 0.5), (0.0, 0.0, 0.0, 0.0)]
    for score, confidence, told in ((1.5, 0.5, "x"), (0.5, -0.1, "x"), (0.5, 0.5, " \t"), (None, 0.5, "x")):
        bad = spark.createDataFrame([(score, confidence, told)], "s double, c double, j string")
        with pytest.raises(Exception, match="judge"):
            bad.select(ranking.checked_judgment(F.col("s"), F.col("c"), F.col("j"))).collect()


# --- the object store and exports ---


def test_objects_are_verified(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows = [("a/b.txt", b"one"), ("c=1/d", b"\x00\xff"), ("e", b"")]
    df = spark.createDataFrame(rows, "key string, body binary")
    store.put_objects(df, root)
    assert {(r["key"], bytes(r["body"])) for r in store.get_objects(spark, root).collect()} == set(rows)
    with pytest.raises(Exception, match="read limit"):
        store.get_objects(spark, root, 2).collect()
    flipped = spark.read.parquet(f"{root}/objects").withColumn("body", F.when(F.col("key") == "e", F.lit(b"\x01")).otherwise(F.col("body")))
    flipped.write.parquet(f"file://{tmp_path}/damaged/objects")
    with pytest.raises(Exception, match="checksum"):
        store.get_objects(spark, f"file://{tmp_path}/damaged").collect()
    assert store.get_objects(spark, f"file://{tmp_path}/damaged").where("key = 'a/b.txt'").count() == 1
    with pytest.raises(Exception, match="expected hash"):
        store.put_objects(df.withColumn("expected_sha256", F.lit("0" * 64)), f"file://{tmp_path}/other")
    for key in ("/a", "a//b", "../a", "a/..", "", "a\\b", "é", "a\n", ".a", "x" * 201, None):
        bad = spark.createDataFrame([(key, b"x")], "key string, body binary")
        with pytest.raises(Exception, match="invalid object key"):
            bad.select(store.checked_key(F.col("key"))).collect()


def test_export_is_canonical_and_verified(spark, tmp_path):
    from sparkeval.functions.canonical import jcs, loads

    rows = [(f"k{i}", jcs({"text": f'é "{i}"', "n": i / 4})) for i in range(25)] + [('q"\\', "{}")]
    df = spark.createDataFrame(rows, "key string, payload string")
    built = datasets.build_records(df, F.col("key"), F.col("payload"), F.lit('{"m":[1]}'), F.array(F.lit("test")), F.lit("{}"))
    root = f"file://{tmp_path}/x"
    manifest = store.export_version(built, "ab" * 32, root, "v1", part_rows=7).orderBy("position").collect()
    assert len(manifest) >= 3 and {r["etag"] for r in manifest} == {'"sha256:' + "ab" * 32 + '"'}
    lines = [r["line"] for r in store.read_export(spark, root, "v1").orderBy("position", "line_number").collect()]
    assert [loads(x)["key"] for x in lines] == sorted(k for k, _ in rows)
    assert all(jcs(loads(x)) == x for x in lines)
    assert all(r["key"].endswith(r["sha256"]) for r in manifest)


# --- streams with late rows ---


def test_sessions_leave_late_rows_out_and_drift_follows_time(spark, tmp_path):
    import shutil
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    parts = [[(1, 0.0, 0), (1, 0.5, 1), (2, 1.0, 0)], [(1, 30.0, 0), (2, 30.5, 1), (2, 49.0, 1)], [(1, 49.5, 0), (2, 90.0, 0)], [(1, 1.0, 1), (2, 95.0, 0)]]
    schema = "user long, ts timestamp, failed int"
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(parts):
        spark.createDataFrame([(u, start + timedelta(hours=h), f) for u, h, f in rows], schema).coalesce(1).write.parquet(f"file://{tmp_path}/w{i}")
        part = next((tmp_path / f"w{i}").glob("*.parquet"))
        shutil.copy(part, tmp_path / "in" / f"{i}.parquet")
        import os

        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i * 60,) * 2)

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in").withWatermark("ts", "2 hours")

    got = progress.run_to_end(spark, stream(), lambda s: windows.sessions(s, "ts", "1 hour", ["user"], [F.count("*").alias("n")]))
    hours = lambda t: (t - start).total_seconds() / 3600
    # hour 1 of user 1 comes when the watermark has passed 47: too late
    assert sorted((r["user"], hours(r["started"]), r["n"]) for r in got.collect()) == [(1, 0.0, 2), (1, 30.0, 1), (1, 49.5, 1), (2, 1.0, 1), (2, 30.5, 1), (2, 49.0, 1), (2, 90.0, 1)]
    day = 86_400_000
    d = progress.run_to_end(spark, stream(), lambda s: windows.drift(s, "user", "ts", F.col("failed") == 1, day, 0.5)).collect()
    base = int(start.timestamp() * 1000) // day * day
    rows = sorted((r["key"], (r["start_ms"] - base) // day, r["n"], r["share"], r["before"], r["alert"]) for r in d)
    assert rows == [("1", 0, 2, 0.5, None, False), ("1", 1, 1, 0.0, 0.5, True), ("1", 2, 1, 0.0, 0.0, False), ("2", 0, 1, 0.0, None, False), ("2", 1, 1, 1.0, 0.0, True), ("2", 2, 1, 1.0, 1.0, False)]
