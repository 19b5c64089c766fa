"""Toxicity: fuzzy lexicon matching and context windows.

The lexicon starts from a short list of insults and grows by terms learned from labelled
rows: words, and stems with several endings, that are far more frequent in toxic texts.  It
is kept as a trie.  A Levenshtein automaton over it accepts every word within a term's
edit budget: its states are sets of (trie node, edits so far), made deterministic as words
need them, and a word ends its walk as soon as no term can be reached any more.  The model
also spends edits on the first letter; a trie made with ``free_first=False`` doesn't.

Misspelled hits that the sample shows in clean texts are exempt.

Each hit is then weighed by a window of words around it: inside quotation marks, or next to
reporting words, it is likelier a quotation; next to words that address someone, likelier
abuse.  A logistic calibration over the counts and window scores, fit on at most
``max_rows`` labelled rows outside the held-out fold, gives the score.

Cases: null and empty texts are scored with no hit; very long texts are read whole; no labelled
rows, or one class only, use fixed weights; repeated rows get equal scores; of terms at the
same number of edits the first in the alphabet counts; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, logistic_fit, logistic_score

# Insults, and words that mark a quotation or an address.
LEXICON = (
    "bastard", "bigot", "clown", "coward", "creep", "disgusting", "dumbass", "filth", "freak", "garbage", "idiot", "imbecile",
    "loser", "lunatic", "maggot", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless",
)
REPORTING = frozenset("said says quote quoted quoting wrote called calls word words term phrase cited title headline".split())
ADDRESS = frozenset("you your youre u are tu vous du ihr eres usted es".split())
LOOKALIKES = (str.maketrans("013457@$", "oieastas"), str.maketrans("013457@$", "oleastas"))  # a one is an i or an l
WORD = re.compile(r"[\w@$]+")
OPENING, CLOSING = "\"“«„‘", "\"”»“’"


class FuzzyTrie:
    """A lexicon trie with a lazily determinised Levenshtein automaton over it."""

    def __init__(self, terms, stems=(), budget=lambda term: 0 if len(term) < 5 else 1 if len(term) < 9 else 2, free_first: bool = False):
        self.free_first = free_first
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.room: list[int] = [0]  # the largest budget of the terms below a node
        self.budget = {t: budget(t) for t in terms} | {t: 0 for t in stems}
        self.stems = frozenset(stems)
        for t in self.budget:
            node = 0
            for ch in t:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.term)
                    self.children.append({})
                    self.term.append(None)
                    self.room.append(0)
                node = self.children[node][ch]
                self.room[node] = max(self.room[node], self.budget[t])
            self.term[node] = t
        self.room[0] = max(self.budget.values(), default=0) if free_first else 0
        self.ids: dict[frozenset, int] = {}
        self.states: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[str, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        todo = [] if set(nodes) == {0} and not self.free_first else list(nodes.items())
        while todo:  # leaving out a character of the term
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.room[child] and e + 1 < nodes.get(child, 99):
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        if not nodes:
            return -1
        key = frozenset(nodes.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(nodes)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in nodes.items() if self.term[n] and e <= self.budget[self.term[n]]]
            self.ends.append(min(ends)[::-1] if ends else None)
        return self.ids[key]

    def _move(self, state: int, ch: str) -> int:
        out: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.room[node] and e < out.get(node, 99):
                out[node] = e

        for node, e in self.states[state].items():
            if node == 0 and not self.free_first:  # the first character must be right
                if ch in self.children[0]:
                    put(self.children[0][ch], 0)
                continue
            put(node, e + 1)  # a character too many
            for c, child in self.children[node].items():
                put(child, e if c == ch else e + 1)
        self.moves[state][ch] = to = self._state(out)
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its budget, and the edits; None if there is none."""
        state = self.start
        for ch in word:
            to = self.moves[state].get(ch)
            state = self._move(state, ch) if to is None else to
            if state < 0:
                return None
            end = self.ends[state]
            if end is not None and end[0] in self.stems:
                return end
        return self.ends[state]


@dataclass
class ToxicityModel:
    terms: dict[str, float] = field(default_factory=lambda: dict.fromkeys(LEXICON, 4.0))  # whole words, with their log-odds
    stems: dict[str, float] = field(default_factory=dict)  # beginnings of words
    exempt: frozenset = frozenset()
    window: int = 4
    #: For use without labels: evidence raises the score, quotations lower it.
    weights: np.ndarray = field(default_factory=lambda: np.array([2.0, 1.0, 0.5, 0.5, 0.5, 0.3, -1.0, -0.5, 0.5, 0.5, -3.5]))

    def trie(self) -> FuzzyTrie:
        return FuzzyTrie(self.terms, self.stems, free_first=True)


class _Quotes:
    """The quotation marks of a text, for questions about spans of it."""

    def __init__(self, text: str):
        at = lambda marks: [m.start() for m in re.finditer(f"[{marks}]", text)]
        self.lines, self.plain = at("\n"), at('"')
        self.pairs = [(at(o), at(c)) for o, c in zip(OPENING[1:], CLOSING[1:], strict=True)]
        self.end = len(text)

    def around(self, at: int, stop: int) -> bool:
        """Whether an opening mark before and a closing mark after lie in the same line."""
        k = bisect_left(self.lines, at)
        begin, end = self.lines[k - 1] + 1 if k else 0, self.lines[k] if k < len(self.lines) else self.end

        def after(marks: list[int]) -> bool:
            k = bisect_left(marks, stop)
            return k < len(marks) and marks[k] < end

        def before(marks: list[int]) -> int:
            k = bisect_left(marks, at)
            return marks[k - 1] if k and marks[k - 1] >= begin else -1

        if (bisect_left(self.plain, at) - bisect_left(self.plain, begin)) % 2 and after(self.plain):
            return True
        return any(before(o) > before(c) and after(c) for o, c in self.pairs)


def find_terms(text: str | None, trie: FuzzyTrie, model: ToxicityModel) -> list[dict]:
    """The hits of a text: term, edits, position, and the score of the window around it."""
    if not text:
        return []
    low = text.lower()
    known = {}
    for w in set(WORD.findall(low)) - model.exempt:
        for plain in (w,) if w.isalpha() else {w.translate(t) for t in LOOKALIKES}:
            m = trie.match(plain)
            if m and (w not in known or m[::-1] < known[w][::-1]):
                known[w] = m
    if not known:
        return []
    words = [(m.group(), m.start(), m.end()) for m in WORD.finditer(low)]
    hits, quotes = [], _Quotes(low)
    for i, (w, at, stop) in enumerate(words):
        if w in known:
            term, edits = known[w]
            near = {x for x, _, _ in words[max(0, i - model.window) : i + model.window + 1]}
            quoted, told, aimed = quotes.around(at, stop), bool(near & REPORTING), bool(near & ADDRESS)
            weight = (0.4 if quoted else 1.0) * (0.6 if told else 1.0) * (1.3 if aimed else 1.0) * (0.5 if edits else 1.0)
            odds = model.terms.get(term) or model.stems[term]
            hits.append({"term": term, "edits": edits, "start": at, "stop": stop, "quoted": quoted, "reported": told, "addressed": aimed, "weight": weight, "odds": odds})
    return hits


WIDTH = 10


def features(hits: list[dict], n_words: int) -> list[float]:
    if not hits:
        return [0.0] * WIDTH
    odds = sorted((h["odds"] * h["weight"] for h in {h["term"]: h for h in hits}.values()), reverse=True)
    weight, n = sum(h["weight"] for h in hits), len(hits)
    return [
        float(any(h["edits"] == 0 for h in hits)), odds[0] / 4, min(3.0, sum(odds[1:4]) / 8), min(1.0, (len(odds) - 1) / 3), min(2.0, np.log1p(n)),
        float(all(h["edits"] for h in hits)), sum(h["quoted"] for h in hits) / n, sum(h["reported"] for h in hits) / n,
        sum(h["addressed"] for h in hits) / n, min(3.0, 50 * weight / max(1, n_words)),
    ]


def _rows_of(texts, trie, model) -> np.ndarray:
    return np.array([features(find_terms(t, trie, model), (t or "").count(" ") + 1) for t in texts]).reshape(-1, WIDTH)


def learn_lexicon(texts: list[str], toxic: np.ndarray, model: ToxicityModel, least: int = 5, odds: float = 4.0) -> ToxicityModel:
    """``model`` with terms and stems whose smoothed log-odds in toxic texts reach ``odds``.

    A term needs ``least`` texts, a stem two times as many and four endings.  Near copies
    count once: texts whose two smallest word hashes agree are one.
    """
    bags = {}
    for text, y in zip(texts, toxic, strict=True):
        bag = {w for w in WORD.findall(text.lower()) if w.isalpha()}
        bags.setdefault((tuple(sorted(zlib.crc32(w.encode()) for w in bag)[:2]), bool(y)), bag)
    yes, no = ([b for (_, y), b in bags.items() if y is want] for want in (True, False))
    top, low = np.log(len(yes) + 1), np.log(len(no) + 1)
    value = lambda a, b: float(np.log(a + 0.5) - top - np.log(b + 0.5) + low)
    ends = lambda bag: {w[:k] for w in bag for k in range(4, min(len(w), 9))}
    hit = Counter(w for b in yes for w in b)
    words = {w for w, n in hit.items() if n >= least}
    clean = Counter(w for b in no for w in b & words)
    stem_hit = Counter(s for b in yes for s in ends(b))
    stems = {s for s, n in stem_hit.items() if n >= 2 * least}
    heads = {s[:4] for s in stems}
    stem_clean = Counter(s for b in no for s in ends({w for w in b if w[:4] in heads}) & stems)
    tails = Counter(s for w in hit for s in {w[:k] for k in range(4, min(len(w), 9))} & stems)
    kept: dict[str, float] = {}
    for s in sorted(stems, key=lambda s: (len(s), s)):
        if tails[s] >= 4 and value(stem_hit[s], stem_clean[s]) >= odds and not any(s.startswith(k) for k in kept):
            kept[s] = value(stem_hit[s], stem_clean[s])
    terms = {w: value(hit[w], clean[w]) for w in words if len(w) > 3 and value(hit[w], clean[w]) >= odds and not any(w.startswith(k) for k in kept)}
    out = ToxicityModel(model.terms | terms, kept, window=model.window, weights=model.weights)
    trie, seen = out.trie(), Counter()
    for b in no:
        for w in b:
            if (m := trie.match(w)) and (m[1] or m[0] != w and m[0] not in trie.stems):
                seen[w] += 1
    out.exempt = frozenset(seen)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_chars: int = 20_000, model: ToxicityModel | None = None) -> ToxicityModel:
    """The lexicon of all sampled rows; the weights are fit on one half with the lexicon of the other."""
    model = model or ToxicityModel()
    rows = labelled_sample(docs, labels, ["toxic"], max_rows, max_chars)
    y, texts = rows["toxic"].to_numpy(dtype=float), rows["text"].tolist()
    if not len(y) or not 0 < y.mean() < 1:
        return model
    x = np.zeros((len(y), WIDTH))
    for half in (0, 1):
        other = [i for i in range(len(y)) if i % 2 != half]
        part = learn_lexicon([texts[i] for i in other], y[other], model, least=3)
        own = np.arange(half, len(y), 2)
        x[own] = _rows_of([texts[i] for i in own], part.trie(), part)
    out = learn_lexicon(texts, y, model)
    out.weights = logistic_fit(x, y)
    return out


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, n_hits, terms`` for every row; ``terms`` are ``term~edits@start`` in text order."""

    def run(batches):
        trie = model.trie()
        for b in batches:
            texts = b.column(1).to_pylist()
            hits = [find_terms(t, trie, model) for t in texts]
            x = np.array([features(h, t.count(" ") + 1) if h else [0.0] * WIDTH for t, h in zip(texts, hits, strict=True)]).reshape(-1, WIDTH)
            terms = [",".join(f"{h['term']}~{h['edits']}@{h['start']}" for h in hs) for hs in hits]
            cols = [pa.array(logistic_score(x, model.weights), pa.float64()), pa.array([len(h) for h in hits], pa.int64()), pa.array(terms, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "score", "n_hits", "terms"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, n_hits long, terms string")


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The columns of query op1."""
    return score(docs, fit(docs, labels)).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits", "terms"
    )
