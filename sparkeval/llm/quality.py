"""Quality classifier by compression.

Two zstandard dictionaries are built from labelled good and bad texts.  A text that
compresses better with the good one resembles good text: the difference of the compressed
sizes, divided by the length, is the evidence.  A small logistic calibration over that
difference, the compressibility by itself and the length turns it into a probability.

The fit uses at most ``max_rows`` labelled rows of at most ``max_chars`` characters outside
the held-out fold; scoring reads every whole text.

Cases: null and empty texts are scored as the empty string; no labelled rows, or only one
class, give the constant share of good labels (0.5 without labels); repeated rows get equal
scores; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, logistic_fit, logistic_score


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    level: int
    mean: np.ndarray | None
    scale: np.ndarray | None
    weights: np.ndarray | None
    constant: float = 0.5


class _Sizes:
    """Compressed sizes with either dictionary and with none."""

    def __init__(self, model: CompressionModel):
        def maker(d: bytes | None):
            data = zstandard.ZstdCompressionDict(d) if d else None
            if data is not None:
                data.precompute_compress(level=model.level)
            kind = {"dict_data": data} if data is not None else {}
            return zstandard.ZstdCompressor(level=model.level, write_content_size=False, write_dict_id=False, **kind)

        self.coders = maker(model.good), maker(model.bad), maker(None)

    def features(self, texts) -> np.ndarray:
        out = np.zeros((len(texts), 5))
        for i, text in enumerate(texts):
            raw = (text or "").encode()
            n = max(1, len(raw))
            g, b, c = (len(x.compress(raw)) for x in self.coders)
            out[i] = (g - b) / n, (g - b) / (g + b), c / n, min(g, b) / n, np.log(n)
        return out


def _expand(model: CompressionModel, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    return np.hstack([z, z * z, z[:, :1] * z[:, 1:], z[:, 2:3] * z[:, 3:]])


def _dictionary(texts: list[str], size: int) -> bytes:
    """A trained dictionary, or where there is too little text to train on, the text itself."""
    samples = [t.encode() for t in texts]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 5000, max_chars: int = 20_000, dict_size: int = 64_000, level: int = 3) -> CompressionModel:
    """Half of the sample builds the dictionaries, the other half calibrates."""
    rows = labelled_sample(docs, labels, ["quality"], max_rows, max_chars)
    y = rows["quality"].to_numpy(dtype=float)
    base = float(y.mean()) if len(y) else 0.5
    texts = rows["text"].tolist()
    first = np.arange(len(y)) % 2 == 0
    if min((first & (y == 1)).sum(), (first & (y == 0)).sum(), (~first & (y == 1)).sum(), (~first & (y == 0)).sum()) < 1:
        return CompressionModel(b"", b"", level, None, None, None, base)
    pick = lambda mask: [t for t, m in zip(texts, mask, strict=True) if m]
    model = CompressionModel(_dictionary(pick(first & (y == 1)), dict_size), _dictionary(pick(first & (y == 0)), dict_size), level, None, None, None)
    x = _Sizes(model).features(pick(~first))
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = logistic_fit(_expand(model, x), y[~first])
    return model


def score(docs: DataFrame, model: CompressionModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Every row with ``out_col``, in place of a column of that name: the calibrated probability of label 1."""
    docs = docs.drop(out_col)

    def run(batches):
        sizes = _Sizes(model) if model.weights is not None else None
        for b in batches:
            texts = b.column(text_col).to_pylist()
            if sizes is None:
                s = np.full(len(texts), model.constant)
            else:
                s = logistic_score(_expand(model, sizes.features(texts)), model.weights) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, out_col])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, `{out_col}` double")


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The columns of query op10."""
    done = score(docs.select("doc_id", "text"), fit(docs, labels))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
