"""Language identification by error-correcting output codes.

Every language gets a codeword; one binary classifier over hashed character 1- to 3-grams
predicts each bit.  Decoding weighs the logistic loss of each bit by how reliable the bit
was in the fit, and takes the codeword with the least loss; a small lead over the second
codeword is flagged as ambiguous.

The languages are all that the training rows name.  The fit uses at most ``max_rows`` rows
outside the held-out fold, or 50 of each language if that is more: the same number of each,
texts of at most ``max_chars`` characters first.  Prediction reads every whole text, in chunks.

Cases: a null text, and a text without a letter, is ``und`` with score 0; with no training
rows every text is ``und``; with one language all texts with letters get it; repeated rows
get equal results, of languages with equal losses the first in the alphabet; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out

CHUNK = 1 << 17


@dataclass
class CodeModel:
    langs: list[str]
    codes: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray
    buckets: int
    ambiguous_below: float


_ALPHA: np.ndarray | None = None


def _alpha() -> np.ndarray:
    """Which code points are letters."""
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _ALPHA


def ngram_counts(text: str, buckets: int) -> np.ndarray:
    """Hashed counts of letter 1-, 2- and 3-grams; runs of other characters are one gap."""
    total = np.zeros(buckets, np.float32)
    alpha, kept = _alpha(), np.zeros(1, np.uint32)  # a text begins with a gap
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.concatenate([kept[-2:], np.where(alpha[codes], codes, 0)])
        new = len(kept[-2:])
        one = codes.astype(np.uint64)
        two = one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77)
        three = two[:-1] * np.uint64(0xC2B2AE3D) + one[2:] * np.uint64(0x27D4EB2F)
        for k, grams in ((1, one), (2, two), (3, three)):
            fresh = grams[max(0, new - k + 1) :]
            letters = codes[len(codes) - len(fresh) :] > 0
            if k > 1:
                letters = letters | (codes[len(codes) - len(fresh) - 1 : -1] > 0)
            h = (fresh[letters] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) >> np.uint64(40)
            total += np.bincount((h % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        kept = codes
    return total


def _unit(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts)
    return x / max(1e-9, float(np.linalg.norm(x)))


def codebook(k: int) -> np.ndarray:
    """All splits of up to five languages; beyond that, fixed pseudo-random codewords."""
    if k <= 1:
        return np.ones((k, 0))
    if k <= 5:
        bits = [[1 if (m >> i) & 1 else -1 for i in range(k)] for m in range(1, 2 ** (k - 1))]
        return np.array(bits).T
    rng, n = np.random.default_rng(7), int(np.ceil(10 * np.log2(k)))
    best, gap = None, -1
    for _ in range(200):
        c = rng.choice([-1, 1], size=(k, n))
        apart = min((c[i] != c[j]).sum() for i in range(k) for j in range(i))
        if apart > gap and (np.abs(c.sum(axis=0)) < k).all():
            best, gap = c, apart
    return best


def _sample(train: DataFrame, each: int, max_chars: int):
    """At most ``each`` rows of every language, chosen by a hash of the id, as pandas."""
    order = (F.length("text") > max_chars, F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")), F.col("doc_id"), F.xxhash64("text"))
    # ids and ranks alone are ordered; tasks keep ``each`` rows of a language before the shuffle
    ranked = train.select("doc_id", "lang", F.xxhash64("text").alias("h"), F.row_number().over(Window.partitionBy("lang").orderBy(*order)).alias("rank"))
    chosen = ranked.where(F.col("rank") <= each).select("doc_id", "lang", "h").distinct()
    rows = train.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "lang", "h"]).dropDuplicates(["doc_id", "lang", "h"])
    return rows.select("doc_id", "lang", "text").orderBy("lang", F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")), "doc_id", "text").toPandas()


def fit(docs: DataFrame, max_rows: int = 3000, max_chars: int = 20_000, buckets: int = 4096, steps: int = 80, ambiguous_below: float = 0.2) -> CodeModel:
    train = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text").dropna()
    langs = sorted(r[0] for r in train.select("lang").distinct().collect())  # a row for each language
    rows = _sample(train, max(50, max_rows // max(1, len(langs))), max_chars)
    codes = codebook(len(langs))
    bits = codes.shape[1]
    model = CodeModel(langs, codes, np.zeros((buckets, bits), np.float32), np.zeros(bits, np.float32), np.ones(bits), buckets, ambiguous_below)
    if not bits:
        return model
    x = np.stack([_unit(ngram_counts(t, buckets)) for t in rows["text"]]).astype(np.float32)
    y = codes[[langs.index(v) for v in rows["lang"]]].astype(np.float32)
    w, b = model.weights, model.bias
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):  # gradient steps with momentum on the mean logistic loss
        g = -y / (1 + np.exp(y * (x @ w + b)))
        vw = 0.9 * vw - 4.0 * (x.T @ g / len(x) + 1e-5 * w)
        vb = 0.9 * vb - 0.5 * g.mean(axis=0)
        w, b = w + vw, b + vb
    right = ((x @ w + b) * y > 0).mean(axis=0).clip(0.5, 0.999)
    model.weights, model.bias, model.trust = w.astype(np.float32), b.astype(np.float32), np.log(right / (1 - right)).clip(0.05, None)
    model.trust = model.trust / model.trust.mean()
    return model


def predict_text(text: str | None, model: CodeModel) -> tuple[str, float, bool]:
    """Language, score and whether it is ambiguous."""
    if not text or not model.langs or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    if len(model.langs) == 1:
        return model.langs[0], 1.0, False
    f = _unit(ngram_counts(text, model.buckets)) @ model.weights + model.bias
    loss = (np.logaddexp(0, -model.codes * f) * model.trust).sum(axis=1)
    p = np.exp(loss.min() - loss)
    p /= p.sum()
    order = np.argsort(-p, kind="stable")
    return model.langs[order[0]], float(p[order[0]]), bool(p[order[0]] - p[order[1]] < model.ambiguous_below)


def identify(docs: DataFrame, model: CodeModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score, ambiguous`` for every row."""

    def run(batches):
        for b in batches:
            found = [predict_text(t, model) for t in b.column(1).to_pylist()]
            cols = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "lang_pred", "score", "ambiguous"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, ambiguous boolean")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op7."""
    return identify(docs, fit(docs)).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "ambiguous")
