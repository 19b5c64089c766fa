"""Token-ID output: length-delimited binary records with an offset index.

A file is a run of frames::

    uint64 length | uint32 masked CRC of the length | body | uint32 masked CRC of the body

all little-endian; the body is ``int64 id, uint32 count, uint8 width, uint8 has_id`` and
``count`` token ids of ``width`` bytes (2 where the vocabulary allows it).  The mask is
``rotate_right(crc, 15) + 0xa282ead8``; the CRC is CRC-32 (that of zlib).  Beside every file lies
an index: ``int64 id, uint64 offset, uint32 count`` for each record, so that records can be
read in any order.

Documents are dealt out by ranges of their id and a hash of their text and sorted, so the files
in the order of their first rows hold all documents in ascending order, and rows of one very
frequent id are split too.  Each task writes files under a name
of its own and returns it; the manifest of the tasks that ended well is checkpointed, so a
lost or repeated task leaves at most a file that nothing refers to.

Tokens come from the tokenizers library.  Where the tokenizer's own rules drop white space
before anything else, texts are cut at ASCII white space and each distinct piece of a task
is encoded once; any other tokenizer gets whole texts.

Cases: null and empty texts have only the end id; very long texts are one record; repeated
ids keep all their records, next to each other, in the order of the hash of their texts (ties
are equal rows); a null id comes first; an empty table gives no file and an empty result;
extra columns are not read.  The window over the manifest has a row for each file.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir

HEAD = struct.Struct("<QI")
BODY = struct.Struct("<qIBB")
INDEX = np.dtype([("id", "<i8"), ("offset", "<u8"), ("count", "<u4"), ("has_id", "<u1")])
MASK = 0xA282EAD8
CRC = struct.Struct("<I")
FRAME = HEAD.size + BODY.size + CRC.size  # bytes of a frame besides the ids
CACHE = 300_000  # pieces of a generation that a worker remembers
GATHER = 1 << 19  # pieces whose ids are gathered at once
FILE_BYTES = 256 << 20


def _mask(c: int) -> int:
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def masked(data) -> int:
    return _mask(zlib.crc32(data))


@lru_cache(maxsize=1 << 16)
def _sized(n: int) -> bytes:
    """The head of a frame: a length and the masked checksum of it."""
    size = struct.pack("<Q", n)
    return size + CRC.pack(masked(size))


def frame(body: bytes) -> bytes:
    return b"".join((_sized(len(body)), body, CRC.pack(masked(body))))


def unframe(data: memoryview) -> memoryview:
    """The body of one frame; ``ValueError`` if a checksum is wrong."""
    size, crc = HEAD.unpack_from(data)
    if masked(bytes(data[:8])) != crc:
        raise ValueError("the checksum of a length is wrong")
    body = data[HEAD.size : HEAD.size + size]
    if len(body) != size or masked(body) != struct.unpack_from("<I", data, HEAD.size + size)[0]:
        raise ValueError("the checksum of a body is wrong")
    return body


class PieceEncoder:
    """Token ids of many texts at once; what a worker knows of pieces is kept from task to task.

    Arrow cuts the texts at ASCII white space and names each distinct piece by a number; only
    what is new to the worker meets the tokenizer, and one gather makes the ids of all texts.
    This holds for tokenizers that drop white space and keep runs of letters whole, as
    ``cuts_at_space`` reads from their own rules; any other tokenizer encodes whole texts.

    A piece of letters with closing marks from ``TAIL`` behind is two pieces: the letters are
    one pre-token however they are cut off.  Such words are encoded many at a time, and the
    ids with the word-end mark say where each one ends; should their number not be that of
    the words, and for all other pieces, each piece is encoded by itself.
    """

    TAIL = ".,;:!?"

    def __init__(self, vocabulary: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        ids = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max([*ids.values(), end_id]) < 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.closes = np.zeros(max(ids.values()) + 1, bool)
        self.closes[[i for token, i in ids.items() if token.endswith("</w>")]] = True
        self.cuts = cuts_at_space(json.loads(self.tokenizer.to_str()))
        # two generations: what was used lately survives when the older one goes
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _each(self, texts: list[str]) -> list[bytes]:
        out = []
        for lo in range(0, len(texts), 1024):
            out += [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 1024], add_special_tokens=False)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        out, width = [], self.dtype.itemsize
        for lo in range(0, len(words), 2048):
            part = words[lo : lo + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            stops = ((np.flatnonzero(self.closes[ids]) + 1) * width).tolist()
            if len(stops) != len(part):  # some word is more than one pre-token
                out += self._each(part)
                continue
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        return out

    def _pieces(self, pieces: pa.Array) -> list[bytes]:
        """The ids of distinct pieces; those of letters alone are learned many at a time."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        known, older, names = self.known, self.older, _listed(pieces)
        fresh, letters = [], []
        for p, alpha in zip(names, _listed(_letters(pieces)), strict=True):
            if p not in known:
                if (ids := older.get(p)) is not None:
                    known[p] = ids
                else:
                    (letters if alpha else fresh).append(p)
        known |= zip(letters, self._words(letters), strict=True)
        known |= zip(fresh, self._each(fresh), strict=True)
        return [known[p] for p in names]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text's end id included, and where each text begins (one more at the end)."""
        texts = pc.fill_null(texts, "")
        if not self.cuts:
            words = [*self._each(texts.to_pylist()), self.end]
            row = np.empty((len(texts), 2), np.int32)
            row[:, 0], row[:, 1] = np.arange(len(texts)), len(texts)
            row, stops = row.ravel(), np.arange(1, len(texts) + 1) * 2
        else:
            lists = pc.ascii_split_whitespace(texts)
            coded = pc.dictionary_encode(lists.flatten())
            lower = pc.ascii_lower(coded.dictionary)
            body = pc.ascii_rtrim(lower, characters=self.TAIL)
            body = pc.if_else(_letters(body), body, lower)
            cut = [w[len(b) :] for w, b in zip(_listed(lower), _listed(body), strict=True)]
            body, tail = pc.dictionary_encode(body), pc.dictionary_encode(pa.array(cut, pa.string()))
            words = [*self._pieces(body.dictionary), *self._pieces(tail.dictionary), self.end]
            # every piece is its letters and its tail; after its pieces every text has the end id
            named, each = coded.indices.to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
            stops = np.cumsum(2 * each + 1)
            row = np.empty(2 * len(named) + len(each), np.int32)
            inner = np.ones(len(row), bool)
            inner[stops - 1] = False
            both = np.stack([body.indices.to_numpy()[named], tail.indices.to_numpy()[named] + len(body.dictionary)], 1) if len(named) else np.empty(0, np.int32)
            row[inner], row[stops - 1] = both.ravel(), len(words) - 1
        pool = np.frombuffer(b"".join(words), self.dtype)
        length = np.fromiter(map(len, words), np.int32, len(words)) // self.dtype.itemsize
        first = (np.cumsum(length) - length).astype(np.int32)
        ends = np.cumsum(length[row], dtype=np.int64)
        out, at = np.empty(int(ends[-1]) if len(ends) else 0, self.dtype), 0
        for lo in range(0, len(row), GATHER):  # the index arrays stay small, however long a text is
            part = row[lo : lo + GATHER]
            m = length[part]
            stop = int(ends[lo + len(part) - 1])
            where = np.repeat(first[part] - (np.cumsum(m, dtype=np.int32) - m), m)
            where += np.arange(stop - at, dtype=np.int32)
            np.take(pool, where, out=out[at:stop])
            at = stop
        return out, np.concatenate([[0], ends[stops - 1]])


@lru_cache(maxsize=4)
def encoder_of(vocabulary: str, end_id: int) -> PieceEncoder:
    """One encoder for each Python worker."""
    return PieceEncoder(vocabulary, end_id)


def _letters(words: pa.Array) -> pa.Array:
    """Whether a word is letters alone, and stays so when it is normalised and lower-cased."""
    alpha = pc.utf8_is_alpha(words)
    wide = pc.and_not(alpha, pc.string_is_ascii(words))
    some = pc.filter(words, wide)
    # U+0130 is the one letter whose lower case has a mark
    return pc.replace_with_mask(alpha, wide, pc.and_not(pc.utf8_is_alpha(pc.utf8_normalize(some, "NFC")), pc.match_substring(some, "\u0130")))


def _listed(values: pa.Array) -> list:
    """Far faster than ``to_pylist`` for strings."""
    return values.to_numpy(zero_copy_only=False).tolist()


def cuts_at_space(rules: dict) -> bool:
    """Whether white space only ever separates pieces for a tokenizer that lower-cases, as read from its own JSON.

    It must have each rule that encoding by words relies on; another one is given whole texts.
    """
    normal = (rules.get("normalizer") or {}).get("normalizers", [])
    split = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    pattern = split.get("pattern", {}).get("Regex", "")
    drops = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and pattern.endswith(r"|[^\s\p{L}\p{N}]+") and " " not in pattern
    plain = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in normal)
    plain = plain and {"NFC", "Lowercase"} <= {n["type"] for n in normal}  # words are normalised and lower-cased one by one
    whole = not any(c.isspace() for t in rules["added_tokens"] for c in t["content"]) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in rules["added_tokens"])
    return bool(drops and plain and whole and not (rules["truncation"] or rules["padding"]))


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Writer:
    """One data file and its index."""

    def __init__(self, folder: str):
        self.name = f"{folder}/{uuid.uuid4().hex}"
        self.fs, path = _open(self.name)
        self.out = self.fs.open_output_stream(path + ".rec")
        self.path, self.at, self.rows, self.tokens, self.first = path, 0, [], 0, None

    def add(self, keys: list, tie: int, ids: np.ndarray, begin: np.ndarray) -> None:
        """Frames the records of a slice of rows and writes them at once."""
        self.first = self.first or (keys[0], tie)
        width, data, begin = ids.dtype.itemsize, memoryview(ids).cast("B"), begin.tolist()
        parts, crc = [], zlib.crc32
        for key, lo, hi in zip(keys, begin, begin[1:], strict=False):
            head, body = BODY.pack(key or 0, hi - lo, width, key is not None), data[lo * width : hi * width]
            parts += (_sized(len(head) + len(body)), head, body, CRC.pack(_mask(crc(body, crc(head)))))
            self.rows.append((key or 0, self.at, hi - lo, key is not None))
            self.at += FRAME + (hi - lo) * width
        self.out.write(b"".join(parts))
        self.tokens += begin[-1] - begin[0]

    def close(self) -> tuple:
        self.out.close()
        index = np.array(self.rows, INDEX)
        with self.fs.open_output_stream(self.path + ".idx") as f:
            f.write(index.tobytes() + struct.pack("<I", masked(index.tobytes())))
        return self.name, *self.first, len(self.rows), self.tokens


MANIFEST = "name string, first_id long, first_tie long, n_records long, n_tokens long"


def _slices(batch, most_bytes: int = 1 << 23):
    """A batch in slices of about ``most_bytes`` of text, one row at least."""
    size = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most_bytes)))
        yield batch.slice(at, stop - at)
        at = stop


def write_records(spark: SparkSession, docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents in ascending id order; returns the checkpointed manifest, a row for each file."""

    def run(batches):
        encoder, writer, done = encoder_of(vocabulary, end_id), None, []
        for b in batches:
            for part in _slices(b):
                ids, begin = encoder.encode(part.column(1))
                writer = writer or _Writer(folder)
                writer.add(part.column(0).to_pylist(), part.column(2)[0].as_py(), ids, begin)
                if writer.at >= FILE_BYTES:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, d, strict=True)) for d in done], schema=kinds)

    kinds = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in MANIFEST.split(", ")])
    _make_folder(folder)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text")
    return cut(spark, ordered.mapInArrow(run, MANIFEST))


def _make_folder(folder: str) -> None:
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)


def read_index(name: str) -> np.ndarray:
    """The index of one file, its checksum verified."""
    fs, path = _open(name + ".idx")
    with fs.open_input_file(path) as f:
        data = f.read()
    if masked(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError(f"the index of {name} is damaged")
    return np.frombuffer(data[:-4], INDEX)


def read_at(f, index: np.ndarray, size: int, i: int, upto: int) -> memoryview:
    stop = int(index["offset"][upto]) if upto < len(index) else size
    return memoryview(f.read_at(stop - int(index["offset"][i]), int(index["offset"][i])))


def ids_of(body: memoryview) -> tuple[int | None, np.ndarray]:
    key, n, width, has = BODY.unpack_from(body)
    ids = np.frombuffer(body, "<u2" if width == 2 else "<u4", n, BODY.size)
    return (key if has else None), ids


def shuffled(name: str, seed: int):
    """All records of a file in a seeded random order, each read by its offset."""
    index = read_index(name)
    fs, path = _open(name + ".rec")
    with fs.open_input_file(path) as f:
        size = f.size()
        for i in np.random.default_rng(seed).permutation(len(index)).tolist():
            yield ids_of(unframe(read_at(f, index, size, i, i + 1)))


def read_records(manifest: DataFrame, read_bytes: int = 4 << 20) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every record, read back from the files."""
    # a row for each file: the running sum over files gives every file's first offset
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_tie", "name").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("name", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                index = read_index(name)
                fs, path = _open(name + ".rec")
                starts = base + np.concatenate([[0], np.cumsum(index["count"].astype(np.int64))])
                with fs.open_input_file(path) as f:
                    size, i = f.size(), 0
                    while i < len(index):
                        upto = max(i + 1, int(np.searchsorted(index["offset"], int(index["offset"][i]) + read_bytes)))
                        data, at0 = read_at(f, index, size, i, upto), int(index["offset"][i])
                        keys, sums, counts = [], [], []
                        for off in index["offset"][i:upto].tolist():
                            key, ids = ids_of(unframe(data[off - at0 :]))
                            keys.append(key)
                            counts.append(len(ids))
                            sums.append(zlib.crc32(ids.astype("<u4")))
                        cols = (pa.array(keys, pa.int64()), pa.array(starts[i:upto]), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()))
                        yield pa.RecordBatch.from_arrays(list(cols), names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        i = upto

    spread = files.repartition(max(1, manifest.rdd.getNumPartitions()), "name")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """The columns of query op6."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    folder = folder or f"{shared_dir(spark)}/token_records/{uuid.uuid4().hex}"
    return read_records(write_records(spark, docs, folder, vocabulary, end_id))
