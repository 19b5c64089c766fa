"""Text similarity that needs sequences: BLEU, ROUGE-Lsum and word error rate, as Arrow functions."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edit_distance(a, b) -> int:
    """Levenshtein distance of two sequences; the shorter one is kept as the row."""
    if len(b) > len(a):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def word_error(prediction: str, reference: str) -> float:
    r, p = reference.split(), prediction.split()
    return edit_distance(p, r) / len(r) if r else float(bool(p))


# The tokenisation that BLEU scores are compared under (13a).
BLEU_RULES = (
    (re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "),
    (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "),
    (re.compile(r"([\.,])([^0-9])"), r" \1 \2"),
    (re.compile(r"([0-9])(-)"), r"\1 \2 "),
)


def bleu_tokens(text: str) -> list[str]:
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for name, plain in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(name, plain)
    text = f" {text} "
    for rule, to in BLEU_RULES:
        text = rule.sub(to, text)
    return text.split()


def bleu(prediction: str, references: list[str]) -> float:
    """Sentence BLEU in [0, 1]: effective order, exponential smoothing of zero counts."""
    if not references:
        raise ValueError("a reference is needed")
    p, rs = bleu_tokens(prediction), [bleu_tokens(r) for r in references]
    logs, order, smooth = 0.0, 0, 1.0
    for n in range(1, 5):
        own = Counter(tuple(p[i : i + n]) for i in range(len(p) - n + 1))
        if not own:
            break
        most: Counter = Counter()
        for r in rs:
            most |= Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
        hit, total = sum((own & most).values()), sum(own.values())
        if n == 1 and not hit:
            return 0.0
        if not hit:
            smooth *= 2
        logs += math.log(hit / total if hit else 1 / (smooth * total))
        order = n
    if not order:
        return 0.0
    closest = min((abs(len(r) - len(p)), len(r)) for r in rs)[1]
    brevity = 1.0 if len(p) >= closest else math.exp(1 - closest / len(p))
    return min(1.0, max(0.0, brevity * math.exp(logs / order)))


def rouge_tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _lcs_marks(reference: list[str], prediction: list[str]) -> set[int]:
    """Positions of the reference in one longest common subsequence."""
    n, m = len(reference), len(prediction)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            t[i + 1][j + 1] = t[i][j] + 1 if reference[i] == prediction[j] else max(t[i][j + 1], t[i + 1][j])
    out, i, j = set(), n, m
    while i and j:
        if reference[i - 1] == prediction[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif t[i - 1][j] > t[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def rouge_lsum(prediction: str, reference: str) -> float:
    """F1 of the union of longest common subsequences, sentence by sentence (lines)."""
    ps, rs = ([rouge_tokens(s) for s in t.split("\n") if s.strip()] for t in (prediction, reference))
    n_p, n_r = sum(map(len, ps)), sum(map(len, rs))
    if not n_p or not n_r:
        return 0.0
    left_p, left_r = Counter(w for s in ps for w in s), Counter(w for s in rs for w in s)
    hits = 0
    for r in rs:
        union = set().union(*(_lcs_marks(r, p) for p in ps))
        for k in sorted(union):
            if left_p[r[k]] > 0 and left_r[r[k]] > 0:
                hits += 1
                left_p[r[k]] -= 1
                left_r[r[k]] -= 1
    precision, recall = hits / n_p, hits / n_r
    return 2 * precision * recall / (precision + recall) if hits else 0.0


def _udf(f):
    @F.pandas_udf(T.DoubleType())
    def run(prediction: pd.Series, reference: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or r is None else f(p, r) for p, r in zip(prediction, reference, strict=True)], dtype="float64")

    return run


bleu_score = _udf(lambda p, r: bleu(p, [r]))
rouge_lsum_score = _udf(rouge_lsum)
word_error_rate = _udf(word_error)
