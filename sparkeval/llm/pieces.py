"""SentencePiece encoding and decoding by a shared-prefix forward (Viterbi) search.

The pieces and their scores come from a SentencePiece model file.  A text is marked as the
model does it (a space in front, every space written as U+2581) and cut into marked words
where a mark follows another character; no piece of the model reaches across such a place,
which is checked when the model is read.

The distinct marked words of a run of rows are sorted, which is a depth-first walk of their
trie: from one word to the next, the states of the common prefix stay on the stack, and only
the rest of the word is searched.  The state after ``i`` characters is the best way to
segment them: where its last piece began, which piece that is, its score, and the pieces
that may go on.  Characters without a piece are written as byte pieces.

* For a unigram model the score of a segmentation is the sum of its pieces' scores; of equal
  scores the one whose last piece began first wins.
* For a merge model (BPE) the scores are merge ranks, and their sum means nothing: the
  segmentation is the one that merging in rank order arrives at.  It has a property that a
  forward search can use: it ends with piece ``t`` after piece ``s`` only if merging ``s + t``
  by itself gives just these two, and at every position exactly one last piece passes that
  test against the state where it begins.  So the forward state is the last piece, the
  test, remembered for each pair of pieces, takes the place of the sum, and prefixes share
  their states just as before.  Words that begin with more than one mark have pieces of
  equal rank, for which this does not hold; they are merged directly.

Cases: null and empty texts have no ids; very long words are searched like any other; a text
that holds U+2581 itself decodes to a space there, as in the library; repeated rows give
equal rows; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
UNKNOWN_PENALTY = 10.0  # fixed value of the library
CACHE = 80_000  # words of a generation that a worker remembers
PAIRS = 300_000
SHORT = 16  # characters of a piece at most, about


def model_type(data: bytes) -> int:
    """``trainer_spec.model_type`` of a serialized model: 1 unigram, 2 merges; 1 if it is not said."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            value, shift, i = value | (byte & 127) << shift, shift + 7, i + 1
            if byte < 128:
                return value, i

    def fields(i: int, stop: int):
        while i < stop:
            key, i = number(i)
            if key & 7 == 2:
                size, i = number(i)
                yield key >> 3, i, i + size
                i += size
            elif key & 7 == 0:
                value, i = number(i)
                yield key >> 3, value, value
            else:
                i += 4 if key & 7 == 5 else 8

    kinds = [v for f, a, b in fields(0, len(data)) if f == 2 for g, v, _ in fields(a, b) if g == 3]
    return kinds[-1] if kinds else 1


class PieceModel:
    """The pieces of a model as a trie with scores, and the tables for decoding."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        lowest = 0.0
        self.scores: list[float] = []
        for i in range(sp.get_piece_size()):
            piece, score = sp.id_to_piece(i), sp.get_score(i)
            self.scores.append(score)
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            elif sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            else:
                if re.search(f"[^{MARK}]{MARK}", piece):
                    raise ValueError(f"the piece {piece!r} reaches across a word boundary")
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                lowest = min(lowest, score)
        self.unknown = lowest - UNKNOWN_PENALTY
        self.merges = model_type(sp.serialized_model_proto()) == 2
        self.id_of = {b.decode("utf-8", "replace").replace(" ", MARK): i for i, b in enumerate(self.bytes_of) if b and not sp.is_byte(i)}
        self.text_of = {i: t for t, i in self.id_of.items()}
        # the trie's nodes by their texts, and an automaton over them, made as words need it
        self.nodes = {t[:k]: None for t in self.id_of for k in range(1, len(t) + 1)} | {"": None}
        self.reached: list[str] = []
        self.moves: list[dict[str, int]] = []
        self.ending: list[tuple[tuple[int, int], ...]] = []
        self.root = self.node("")
        self.size = len(self.scores)
        self.fits: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def node(self, text: str) -> int:
        """The state for a text that pieces begin with, and the pieces that end there: (length, id), the longest first."""
        found = self.nodes[text]
        if found is None:
            found = self.nodes[text] = len(self.reached)
            self.reached.append(text)
            self.moves.append({})
            self.ending.append(tuple((len(text) - k, self.id_of[text[k:]]) for k in range(len(text)) if text[k:] in self.id_of))
        return found

    def move(self, state: int, ch: str) -> int:
        """The state for the longest end of the text so far that pieces begin with."""
        text = self.reached[state] + ch
        while text not in self.nodes:
            text = text[1:]
        self.moves[state][ch] = to = self.node(text)
        return to

    def merged(self, word: str) -> list[int]:
        """The ids that merging in rank order gives, the leftmost of equal ranks first; -1 for a character without a piece."""
        if len(word) <= 2 * SHORT:
            return self._merged_short(word)
        n, id_of, scores = len(word), self.id_of, self.scores
        part, after, before = list(word), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (p := id_of.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-scores[p], i, len(part[i]) + len(part[j])))

        for i in range(n):
            offer(i)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the two was merged meanwhile
            part[i] += part[j]
            part[j] = ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [id_of.get(p, -1) for p in part if p]

    def _merged_short(self, word: str) -> list[int]:
        """The same by looking at every neighbouring pair, which is faster for a pair of pieces."""
        get, scores, part = self.id_of.get, self.scores, list(word)
        pairs = [get(a + b, -1) for a, b in zip(part, part[1:], strict=False)]
        rank = [scores[p] if p >= 0 else -1e300 for p in pairs]
        while rank:
            top = max(rank)
            if top == -1e300:
                break
            i = rank.index(top)
            part[i : i + 2] = [part[i] + part[i + 1]]
            del rank[i]
            for j in (i - 1, i):
                if 0 <= j < len(rank):
                    p = get(part[j] + part[j + 1])
                    rank[j] = scores[p] if p is not None else -1e300
        return [get(p, -1) for p in part]

    def whole(self, t: int) -> bool:
        """Whether merging the characters of piece ``t`` gives it again."""
        known = self.alone.get(t)
        if known is None:
            known = self.alone[t] = self.merged(self.text_of[t]) == [t]
        return known

    def follows(self, s: int, t: int) -> bool:
        """Whether merging leaves piece ``t`` behind piece ``s``; -1 is a start, or a character without a piece."""
        if s < 0:
            return self.whole(t)
        key = s * self.size + t
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            both = self.text_of[s] + self.text_of[t]
            # two pieces that make a third would have been merged
            known = self.fits[key] = both not in self.id_of and self.whole(t) and self.merged(both) == [s, t]
        return known


def _spelled(parts, model: PieceModel) -> list[int]:
    """Ids of (text, id) parts; a part without a piece is written in bytes."""
    ids = []
    for text, p in parts:
        if p >= 0:
            ids.append(p)
        else:
            ids += [model.byte_ids[b] for b in text.encode()]
    return ids


def encode_words(words: list[str], model: PieceModel) -> dict[str, bytes]:
    """The ids of each distinct marked word as little-endian 32-bit integers."""
    flat: list[int] = []
    ordered, counts = sorted(words), []
    moves, ending, scores, unknown, follows = model.moves, model.ending, model.scores, model.unknown, model.follows
    fits, size, merges = model.fits, model.size, model.merges
    # the stack, by depth: automaton state, the last piece's id (-1: bytes) and start, best score
    states, last, start, best = [model.root], [-1], [0], [0.0]
    previous = ""
    for word in ordered:
        if merges and word.startswith(MARK * 2):
            ids = _spelled(_parts(model.merged(word), word, model), model)
            flat += ids
            counts.append(len(ids))
            continue
        depth, top = 0, min(len(word), len(previous))
        while depth < top and word[depth] == previous[depth]:
            depth += 1
        del states[depth + 1 :], last[depth + 1 :], start[depth + 1 :], best[depth + 1 :]
        state = states[depth]
        for i in range(depth, len(word)):
            ch = word[i]
            to = moves[state].get(ch)
            state = model.move(state, ch) if to is None else to
            states.append(state)
            piece, at = -1, i
            if merges:  # the one piece that merging leaves behind the one before it
                for n, p in ending[state]:
                    s = last[i + 1 - n]
                    ok = fits.get(s * size + p) if s >= 0 else None
                    if follows(s, p) if ok is None else ok:
                        piece, at = p, i + 1 - n
                        break
            else:  # the piece with the largest sum of scores; the earliest start of equal ones
                top_score, single = -1e300, False
                for n, p in ending[state]:
                    single = single or n == 1
                    if best[i + 1 - n] + scores[p] > top_score:
                        top_score, piece, at = best[i + 1 - n] + scores[p], p, i + 1 - n
                if not single and best[i] + unknown > top_score:
                    top_score, piece, at = best[i] + unknown, -1, i
                best.append(top_score)
            last.append(piece)
            start.append(at)
        parts, i = [], len(word)
        plain = True
        while i > 0:
            parts.append(last[i])
            plain = plain and last[i] >= 0
            i = start[i]
        parts.reverse()
        ids = parts if plain else _spelled(_parts(parts, word, model), model)
        flat += ids
        counts.append(len(ids))
        previous = word
    data, out, at = np.array(flat, "<i4").tobytes(), {}, 0
    for word, n in zip(ordered, counts, strict=True):
        out[word] = data[at : at + 4 * n]
        at += 4 * n
    return out


def _parts(ids: list[int], word: str, model: PieceModel):
    """(text, id) of each part of a word; a part without a piece is one character."""
    at = 0
    for p in ids:
        size = len(model.text_of[p]) if p >= 0 else 1
        yield word[at : at + size], p
        at += size


class Encoder:
    """Ids of texts; what it knows of words is kept from batch to batch, up to a bound."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        # two generations: what was used lately survives when the older one goes
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        known, older, fresh = self.known, self.older, []
        for w in set().union(*cut):
            if w not in known:
                ids = older.get(w)
                if ids is None:
                    fresh.append(w)
                else:
                    known[w] = ids
        known |= encode_words(fresh, self.model)
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), "<i4") for ws in cut]

    def decode(self, ids) -> str:
        """The text of ids; invalid bytes become U+FFFD."""
        raw = b"".join(map(self.model.bytes_of.__getitem__, ids))
        return raw.decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder, with what it knows, for each Python worker."""
    return Encoder(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


ROWS = 256  # rows whose words are sorted together


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", out_col: str = "ids", check_col: str | None = None) -> DataFrame:
    """``docs`` with ``out_col``, in place of a column of that name: the ids of each text.

    ``check_col`` adds whether the ids decode to the text again, decoded in the same task.
    """
    path, docs = path or default_model(), docs.drop(out_col, *([check_col] if check_col else []))

    def run(batches):
        encoder = encoder_of(path)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                texts = part.column(text_col).to_pylist()
                ids = encoder.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.empty(0, np.int32)
                made, names = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))], [out_col]
                if check_col:
                    same = [encoder.decode(x.tolist()) == (t or "").replace(MARK, " ") for x, t in zip(ids, texts, strict=True)]
                    made, names = [*made, pa.array(same, pa.bool_())], [*names, check_col]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, `{out_col}` array<int>" + (f", `{check_col}` boolean" if check_col else ""))


def decode(tokens: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``tokens`` with ``out_col``: the text of each row's ids; null ids give an empty text."""
    path, tokens = path or default_model(), tokens.drop(out_col)

    def run(batches):
        encoder = encoder_of(path)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                lists = part.column(ids_col)
                values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                # the ids of one row at a time become Python numbers
                texts = [encoder.decode(values[a:c].tolist()) for a, c in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out_col])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(run, f"{kinds}, `{out_col}` string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Query op2: ids of every text, and whether they decode to the text again."""
    done = encode(docs.select("doc_id", "text"), path, check_col="round_trip")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
