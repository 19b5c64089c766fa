"""The pipeline: every stage against a plain version on its own input, nulls and empty tables."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sparkeval.llm import decontam, quality, queries, secrets, simhash

from .test_operators import DOCS


def shingled(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """The written output of each stage, the input first."""
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        where = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], sf).write.parquet(where)
        out.append(spark.read.parquet(where))
    return out


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_columns(steps):
    assert all(sorted(s.columns) == sorted(steps[0].columns) for s in steps[:-1])


def test_quality_stage(spark, sf, steps):
    model = quality.fit(steps[0], spark.read.parquet(f"{sf}/labels.parquet"))
    kept = quality.score(steps[0], model).where("score >= 0.7")
    assert ids(steps[1]) == ids(kept) and 0 < steps[1].count() < steps[0].count()


def test_dedup_stage(steps):
    rows = steps[1].collect()
    sets = {r["doc_id"]: shingled(r["text"]) for r in rows}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    kept, order = ids(steps[2]), sorted(sets)
    close = [p for p, j in alike.items() if j >= 0.8]
    assert close and sum(not set(p) <= kept for p in close) >= 0.95 * len(close)
    for gone in set(order) - kept:  # only what resembles another document goes
        assert max(j for p, j in alike.items() if gone in p) >= 0.6
    groups = Counter(frozenset(sets[i]) for i in order)
    left = Counter(frozenset(sets[i]) for i in kept)
    assert all(n <= 1 for n in left.values()) and len(groups) >= len(left)


def test_dedup_is_exact(steps):
    """The components are those of all pairs at 0.8 or more, and of no other."""
    sets = {r["doc_id"]: shingled(r["text"]) for r in steps[1].collect()}
    assert ids(steps[2]) == {i for i, root in exact_components(sets).items() if i == root}


def exact_components(sets):
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    return root


def test_a_repeated_line_is_no_link(spark):
    rng = random.Random(5)
    line = " ".join(f"line{k}" for k in range(16))
    texts = [" ".join([line] * 60 + [f"w{rng.randrange(10**6)}" for _ in range(204)]) for _ in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r["id"] == r["component_id"] for r in simhash.near_copies(spark, df).collect())


@pytest.mark.parametrize("block", [20_000, 12])
def test_no_pair_is_missed(spark, block):
    """Pairs just above and below 0.8, short texts included, hot lines, and a chain."""
    rng, texts = random.Random(6), []
    word = lambda: f"w{rng.randrange(10**6)}"
    for n in [*range(5, 30), 44, 84, 104, 204]:
        base = [word() for _ in range(n)]
        texts += [base, [*base, word()], base[: -max(1, n // 5)], [word() for _ in range(n // 9)] + base[n // 9 :]]
    common = [word() for _ in range(60)]
    texts += [common + [word() for _ in range(k)] for k in range(4, 40)]
    texts = {i: " ".join(t) for i, t in enumerate(texts)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in simhash.near_copies(spark, df, block=block).collect()}
    assert got == exact_components({i: shingled(t) for i, t in texts.items()})


def test_leak_stage(spark, sf, steps):
    items = [decontam.shingles(decontam.words_of(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = set()
    for r in steps[2].collect():
        have = decontam.shingles(decontam.words_of(r["text"]))
        if all(len(s & have) < 0.8 * len(s) for s in items):
            clean.add(r["doc_id"])
    assert ids(steps[3]) == clean


def test_secret_stage(steps):
    before = {r["doc_id"]: r for r in secrets.find_secrets(steps[3]).collect()}
    for r in steps[4].collect():
        want, at = "", 0
        for s in before[r["doc_id"]]["spans"]:
            if s["start"] >= at:
                want += before[r["doc_id"]]["text"][at : s["start"]] + "[SECRET]"
            at = max(at, s["stop"])
        want += before[r["doc_id"]]["text"][at:]
        assert r["text"] == want and r["n_chars"] == len(want)
    assert ids(steps[4]) == ids(steps[3])


def test_run_is_the_stages(spark, sf, steps):
    got = corpus_pipeline.run(spark, sf)
    assert ids(got) == ids(steps[-1]) and got.where("not round_trip").count() == 0


@pytest.mark.parametrize("k", range(5))
def test_odd_rows(spark, sf, k):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "some text", None, None, 9), (3, "x" * 20000, "en", "s", 20000)]
    stage = corpus_pipeline.STAGES[k][1]
    clash = ("id", "score", "ids", "decoded", "leaks", "spans", "row", "redacted", "component_id", "fp")
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in clash})
    got = stage(spark, df, sf)
    assert got.count() <= len(rows)
    if k < 4:
        assert got.columns == df.columns
    if k == 1:
        assert {r["doc_id"] for r in got.collect()} == {None, 1, 3}
    if k in (2, 3, 4):
        assert got.count() == len(rows)
    assert stage(spark, df.limit(0), sf).count() == 0


def test_queries_are_registered(spark):
    names, sf = entry.queries(), "/root/testdata/sf0.01"
    assert sum(n.startswith("op") and n[2].isdigit() for n in names) == 13 and "pipeline" in names
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = sorted(map(tuple, names[name](spark, sf).toPandas().astype(str).values.tolist()))
        want = sorted(map(tuple, con.execute(sql).df().astype(str).values.tolist()))
        assert got == want
    assert names["op4_secret_scan"](spark, sf).where(F.col("spans") != "").count() > 0
