"""Periodic runs, centroid clusters and exact copies against plain versions, and on odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkeval.llm import centroids, exact, periodic, queries, records

CLASH = ("id", "n", "full", "runs", "cluster", "distance", "keep_id", "kept", "group_size", "text_sha256", "__id", "__x", "__len", "c", "s")
TEXTS = [None, "", " \t\n", "one", "a a a a a a", "b a b a b a b a c", " x x y  x", "x" * 30_000, "la " * 40_000, "again and again", "again and again", "", "A", "a"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (3, "two"), (None, "null id"), (None, "one"), (None, "null id")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("z") for c in CLASH})


def odd_rows(odd):
    return [(r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()]


# --- 11 periodic runs ---


def plain_runs(w, exponent=4, least=6):
    """Every period tried at every place; the smallest period tested by definition."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            size = i + q - s
            if size >= max(least, exponent * q):
                x = w[s : s + size]
                if not any(x[r:] == x[:-r] for r in range(1, q)):
                    out.append((s, size, q))
            i += i == s
    return sorted(out)


def repeats(rng, longest):
    letters, w = rng.choice((1, 2, 3, 5, 40)), []
    while len(w) < longest:
        unit = [rng.randrange(letters) for _ in range(rng.choice((1, 2, 3, 4, 5, 7, 8, 9, 13, 20, 30, 61)))]
        w += (unit * rng.randrange(1, 9))[: rng.randrange(1, 300)]
    return w


@pytest.mark.parametrize("key", [32, 2])
def test_runs_equal_all_periods(key, monkeypatch):
    monkeypatch.setattr(periodic, "KEY", key)
    rng, some = random.Random(key), 0
    for _ in range(400):
        w = repeats(rng, rng.randrange(1, 250))
        for exponent, least in ((4, 6), (2, 1), (3, 2)):
            want = plain_runs(w, exponent, least)
            assert periodic.find_runs(np.array(w, np.int32), exponent, least) == want, w
            some += bool(want)
    assert some > 300


def test_runs_of_long_texts_in_little_time():
    n = 100_000
    for w, want in (([0] * n, [(0, n, 1)]), ([0] * n + [1] + [0] * n, [(0, n, 1), (n + 1, n, 1)]), (list(range(1000)) * 100, [(0, n, 1000)])):
        t = time.process_time()
        assert periodic.find_runs(np.array(w, np.int32)) == want
        assert time.process_time() - t < 20


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op11_equals_a_plain_version(spark, sf, odd):
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    short = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"]) < 6000]
    got = {r["doc_id"]: tuple(r) for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert len(got) == docs.count()
    assert [got[i] for i, _ in short] == [plain_digest(i, t) for i, t in short]
    assert sum(r[1] > 0 for r in got.values()) > 5
    rows = [(i, t) for i, t in odd_rows(odd) if len(t) < 100_000]
    made = periodic.digest(odd.where("coalesce(length(text), 0) < 100000"))
    assert sorted(map(key, made.collect())) == sorted(key(plain_digest(i, t)) for i, t in rows)
    la = periodic.periodic_runs(odd.where("length(text) >= 100000")).first()
    assert (la["n_words"], [tuple(r) for r in la["runs"]], la["collapsed"]) == (40_000, [(0, 40_000, 1)], "la")


def test_op11_of_an_empty_table(spark, odd):
    assert periodic.digest(odd.limit(0)).collect() == []


# --- 12 centroid clusters ---


def plain_clusters(rows, k=8, rounds=10, dims=64, seed=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(1024 * float(x))) for x in v]))
    if not kept:
        return []
    c = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, sha(f"{seed}:{r[0]}"), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if groups[j] else c[j] for j in range(len(c))]
    at = [(i, *near(v)) for i, v in kept]
    spread = defaultdict(int)
    for _, d, j in at:
        spread[j] += d
    return [(i, j, d, spread[j], sum(spread.values()), sha(",".join(map(str, c[j])))) for i, d, j in at]


ORDER = lambda r: tuple("" if v is None else str(v) for v in r)


@pytest.mark.parametrize("k", [1, 8, 30])
def test_clusters_equal_all_distances(spark, k):
    rng = random.Random(k)
    near = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(near)]) for i in range(200)]
    rows += [(i, [float(rng.randrange(2)) for _ in range(4)]) for i in range(100)]  # ties, repeated ids and vectors
    rows += [(1000, None), (1001, []), (1002, [1.0] * 3), (1003, [1.0] * 5), (1004, [1.0, None, 1.0, 1.0]), (1005, [1.0, float("nan"), 1.0, 1.0]), (1006, [float("-inf")] * 4), (None, [0.5] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("z") for c in CLASH})
    got = centroids.cluster(spark, df.repartition(3), k=k, rounds=4, dims=4)
    assert sorted(map(ORDER, got.collect())) == sorted(map(ORDER, plain_clusters(rows, k, 4, 4)))


@pytest.mark.parametrize("pairs", [1, 7, 1 << 16])
def test_annulus_equals_all_centroids(pairs):
    rng = np.random.default_rng(pairs)
    for span, n, k in ((3, 300, 40), (1000, 300, 40), (1 << 27, 50, 9)):
        x, c = rng.integers(-span, span, (n, 6)), rng.integers(-span, span, (k, 6))
        c[-1], x[0] = c[0], c[0]  # two equal centroids, and a vector at both
        label, d, compared = centroids.nearest(x, c, pairs)
        every = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (label == every.argmin(1)).all() and (d == every.min(1)).all() and compared <= n * k
    x = np.outer(np.arange(1, 1001), [30, 40]) + rng.integers(-3, 4, (1000, 2))
    assert centroids.nearest(x, x[::10])[2] < 4 * len(x)  # few of 100 centroids lie in an annulus


def test_clusters_without_vectors(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert centroids.digest(spark, df).collect() == [] and centroids.digest(spark, df.limit(0)).collect() == []


def test_a_component_out_of_range_is_refused(spark):
    df = spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark, df, dims=1).collect()


# --- 13 exact copies ---


def plain_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return [(i, keep[t], len(groups[t]), i == keep[t], sha(t)) for i, t in rows]


@pytest.mark.parametrize("bits", [24, 1])
def test_copies_equal_a_plain_version(spark, odd, bits):
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    got = exact.groups(spark, odd, carry={"text_sha256": text}, bits=bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(ORDER, got.collect())) == sorted(map(ORDER, plain_copies(odd_rows(odd))))


def test_copies_with_hot_texts_and_equal_beginnings(spark):
    start = "w" * 80
    rows = [(i, start + "same") for i in range(900)] + [(1000 + i, start + f"{i:04d}") for i in range(900)] + [(3000 + i, f"pair {i // 2}") for i in range(900)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact.digest(spark, df).collect()
    assert sorted(map(ORDER, got)) == sorted(map(ORDER, plain_copies(rows)))
    # whole texts were hashed where length and beginning left a class of two or more, and nowhere else
    assert exact.groups(spark, df.union(spark.createDataFrame([(9, "alone in its length")], df.schema))).where("full_sha256 is null").count() == 1


def test_deduplicate(spark, odd):
    stays = exact.deduplicate(spark, odd)
    assert stays.columns == odd.columns
    want = sorted(ORDER((i, t)) for (i, t), p in zip(odd_rows(odd), plain_copies(odd_rows(odd)), strict=True) if p[3])
    assert sorted(ORDER((r["doc_id"], r["text"] or "")) for r in stays.collect()) == want
    assert exact.digest(spark, odd.limit(0)).collect() == [] and exact.deduplicate(spark, odd.limit(0)).count() == 0


def test_names_that_the_result_makes_are_refused(spark, odd):
    with pytest.raises(ValueError, match="makes itself"):
        exact.groups(spark, odd, carry={"kept": F.lit(1)})


@pytest.mark.parametrize("name", ["op12_centroid_clusters", "op13_exact_dedup"])
def test_equals_sql(name, spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    want = con.execute(queries.oracle_sql()[name]).fetchdf()[got.columns]
    assert sorted(map(ORDER, got.collect())) == sorted(map(ORDER, want.itertuples(index=False)))


# --- 6 token records: tokenizers that miss a rule ---


@pytest.mark.parametrize("without", ["Lowercase", "NFC"])
def test_a_tokenizer_without_a_rule_gets_whole_texts(tmp_path, without):
    import json

    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        rules = json.load(f)
    rules["normalizer"]["normalizers"] = [n for n in rules["normalizer"]["normalizers"] if n["type"] != without]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(rules))
    assert not records.cuts_at_space(rules)
    texts = ["Hello WORLD, The Cat.", "café Café", "", "a\tB  c"]
    ids, begin = records.encoder_of(str(path), 2).encode(pa.array(texts))
    whole = Tokenizer.from_file(str(path))
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]


# --- 3 html: the entropy of a branch against its place and names ---


def test_importance_has_no_veto(spark):
    from sparkeval.llm import html_text

    rows, want = [], {}
    for i in range(30):
        first, second, third = (f"{w} part of story {i} with words of its own {i * 7}" for w in ("first", "second", "third"))
        page = (
            f"<nav><a href=/>home</a></nav><div class='ad'>buy number {i} now</div><article><h1>Story {i}</h1><p>{first}</p><section class='promotion-history'><p>{second}</p></section>"
            f"<div class='about'>about this site</div><div class='comments'>reader {i} says no</div></article><div class='rest'><p>{third}</p></div><div class='rest-of-site'>always the same</div><footer>page {i}</footer>"
        )
        rows.append((i, "http://a.example/x", page))
        want[i] = f"Story {i} {first} {second} {third}"
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["id"]: r["text"] for r in html_text.extract(df).collect()} == want
    # one page is little evidence: places and names decide, but a part of a name alone does not
    alone = html_text.main_text(rows[0][2], frozenset())
    assert alone == "Story 0 first part of story 0 with words of its own 0 second part of story 0 with words of its own 0 about this site"


def test_names_weigh_by_their_share():
    from sparkeval.llm import html_text

    text = lambda h: html_text.main_text(h, frozenset())
    club = "<article><h1>T</h1><section class='promotion-history'><p>The club won promotion in 1999.</p></section><p>End.</p></article>"
    assert text(club) == "T The club won promotion in 1999. End."
    assert text("<article><p>a b c</p><div class='widget'>About widgets as such</div></article>") == "a b c About widgets as such"
    for name in ("ad", "comments", "cookie notice", "newsletter-signup", "sidebar"):
        assert text(f"<article><p>a b c</p><div class='{name}'>other words</div></article>") == "a b c", name
    assert text("<article><p>a</p><div hidden>not shown</div></article>") == "a"


# --- 5 decontamination: bounds in slices ---


@pytest.mark.parametrize("pairs", [1, 50, 1 << 21])
def test_bounds_in_slices_are_all_bounds(monkeypatch, pairs):
    from sparkeval.llm import decontam

    monkeypatch.setattr(decontam, "PAIRS", pairs)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choices(words, k=rng.choice((1, 2, 6, 12)))) for _ in range(120)]
    texts = [" ".join(rng.choices([*words, "x", "y"], k=rng.randrange(90))) + " " + rng.choice(items) for _ in range(40)] + ["", None, "x y"]
    index = decontam.BlockMaxIndex(list(range(120)), items, decontam.Rule(span=3))
    got = index.scan(texts)
    monkeypatch.setattr(decontam, "PAIRS", 1 << 21)
    assert got == index.scan(texts) and sum(map(len, got)) > 40
    # every item whose score reaches the threshold in a passage has its range among the hits
    theta, step = index.rule.threshold, index.longest
    for text, found in zip(texts, got, strict=True):
        doc, seen = decontam.words_of(text), {x[0] for x in found}
        for a in range(0, max(1, len(doc) - step), step):
            window = doc[a : a + 2 * step]
            terms = sorted({index.terms[w] for w in window if w in index.terms})
            have = decontam.shingles(window)
            for item in range(120):
                score = sum(v for t in terms for i, v in zip(index.posts[t], index.weights[t], strict=True) if i == item)
                shares = [decontam._share(s, have, window) for s in index.items[item]]
                if score >= theta and shares[0] >= index.rule.overlap:
                    assert index.ids[item] in seen, (text, item)


def test_long_texts_and_short_items_take_little():
    from sparkeval.llm import decontam

    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    index = decontam.BlockMaxIndex(list(range(2000)), words[:2000], decontam.Rule())
    t = time.process_time()
    assert len(index.scan([" ".join(rng.choices(words, k=100_000))])[0]) == 2000
    assert time.process_time() - t < 15


# --- 4 secrets: many matches in one text ---


def test_very_many_spans_of_one_text(spark):
    from sparkeval.llm import secrets

    n = 3000
    text = "".join(f"é token={i:06d} x" for i in range(n))
    found = secrets.find_secrets(spark.createDataFrame([(1, text), (2, "no"), (3, "token=abcdef")], "doc_id long, text string"))
    got = {r["doc_id"]: [(s["start"], s["stop"]) for s in r["base"]] for r in found.collect()}
    want = [m.span() for m in re.finditer(r"token=\d{6}", text)]
    assert got == {1: want, 2: [], 3: [(0, 12)]} and len(want) == n
