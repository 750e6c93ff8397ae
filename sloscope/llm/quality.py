"""Quality rules: a calibrated logistic regression on hashed word and character n-grams.

The model is fitted on a bounded, hash-ordered sample of labelled rows (``SAMPLE``
rows at most, whatever the table's size); every whole text is then scored in Arrow
batches against the fixed threshold. Rules on counts come first and can't be overruled.

Defined cases: a null text has no words. Labels without a doc_id or outside 0 and 1
are ignored, of contradicting labels the lower holds. Without labels of both kinds
there is no model and the rules alone decide. Repeated rows and null ids are scored
as rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sloscope.llm.common import table, whole_row

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 2000
#: Least calibrated probability of good quality that keeps a document.
THRESHOLD = 0.5
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; per cent of words in repeated windows
SYMBOLS = b"#*$%&|<>"

DIMS, GRAM, SCALE = 1 << 14, 3, 30.0
STEPS, RATE, DECAY = 120, 0.1, 1e-4

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def word_features(words: list[bytes]) -> np.ndarray:
    """Hashed single words and word pairs, in the lower half of the dimensions."""
    one = np.fromiter(map(crc32, words), np.int64, len(words))
    two = (one[:-1] * 31 + one[1:]) * 2654435761 >> 7
    return np.concatenate((one, two)) & (DIMS - 1)


def char_features(data: bytes) -> np.ndarray:
    """Hashed byte n-grams of the raw text, in the upper half."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    if len(b) < GRAM:
        return np.zeros(0, np.int64)
    gram = b[:-2] | b[1:-1] << 8 | b[2:] << 16
    return DIMS + ((gram * 2654435761 >> 11) & (DIMS - 1))


def features(data: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions in use and their scaled frequencies."""
    out = []
    for found in (word_features(words), char_features(data)):
        dims, counts = np.unique(found, return_counts=True)
        out.append((dims, counts * (SCALE / max(1, len(found)))))
    return np.concatenate([d for d, _ in out]), np.concatenate([v for _, v in out])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, data: bytes, words: list[bytes]) -> float:
        z = self.bias
        for found in (word_features(words), char_features(data)):
            if len(found):
                z += SCALE * float(self.weights[found].sum(dtype=np.float64)) / len(found)
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -500, 500))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model | None:
    """Full-batch Adam on four fifths of the rows; Platt's calibration on the others."""
    labels = np.asarray(labels, float)
    if len(set(labels.tolist())) < 2:
        return None
    held = np.arange(len(labels)) % 5 == 4
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held[:] = False
    train = np.flatnonzero(~held)
    dims = np.concatenate([rows[i][0] for i in train]).astype(np.int32)
    values = np.concatenate([rows[i][1] for i in train]).astype(np.float32)
    owner = np.repeat(np.arange(len(train), dtype=np.int32), [len(rows[i][0]) for i in train])
    y = labels[train]
    w, bias = np.zeros(2 * DIMS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.bincount(owner, values * w[dims], len(y)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        grad = np.bincount(dims, values * error[owner], 2 * DIMS) / len(y) + DECAY * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        g = error.mean()
        mb, vb = 0.9 * mb + 0.1 * g, 0.999 * vb + 0.001 * g * g
        a, b = 1 - 0.9**step, 1 - 0.999**step
        w -= RATE * (m / a) / (np.sqrt(v / b) + 1e-8) * (grad != 0)
        bias -= RATE * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    slope, offset = 1.0, 0.0
    if held.any():
        own = np.flatnonzero(held)
        slope, offset = _platt(np.array([rows[i][1] @ w[rows[i][0]] + bias for i in own]), labels[own])
    return Model(w.astype(np.float32), float(bias), slope, offset)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's steps for the sigmoid of slope * z + offset, with Platt's smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    design = np.stack([z, np.ones_like(z)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (target - p) - 1e-3 * (beta - [1.0, 0.0]))
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return max(1e-3, float(beta[0])), float(beta[1])


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        key = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + h[2:]
    ordered = np.sort(key)
    if (ordered[1:] != ordered[:-1]).all():
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    again = np.fromiter((seen[x] > 1 for x in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(windows)] |= again
    return int(covered.sum())


def judge(text: str | None, model: Model | None) -> tuple:
    """The five counts, base_failed, the probability (null without a model) and kept."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text) - (len(data) - sum(map(len, words)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    again = repeated_words(words)
    failed = n < LEAST_WORDS or 100 * again > MOST_REPEATED * n
    good = model.probability(data, words) if model and not failed else None
    return n, chars, symbols, len(lines) - len(set(lines)), again, failed, good, not failed and (good is None or good >= THRESHOLD)


_SCORED = [*((c, T.LongType()) for c in COUNTS), ("base_failed", T.BooleanType()), ("probability", T.DoubleType()), ("kept", T.BooleanType())]
_KINDS = [*[pa.int64()] * len(COUNTS), pa.bool_(), pa.float64(), pa.bool_()]


def _score(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [judge(t.as_py(), model) for t in batch.column("row").field("text")]
        found = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(_KINDS), _KINDS)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *(c for c, _ in _SCORED)])


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, then its counts, probability and verdict."""
    rows = docs.select(whole_row(docs.withColumn("text", F.col("text").cast("string"))).alias("row"))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, k) for c, k in _SCORED)])
    return rows.mapInArrow(partial(_score, model=model), schema)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims, values = [], []
        for t in batch.column("text"):
            data = (t.as_py() or "").encode("utf-8", "surrogatepass")
            d, v = features(data, data.split())
            dims.append(d.astype("<i4").tobytes())
            values.append(v.astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(dims, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "quality", "dims", "vals"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` labelled rows, the same for any partitioning."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = rows.mapInArrow(_sample_features, "doc_id long, quality int, dims binary, vals binary").collect()
    got.sort(key=lambda r: r["doc_id"])
    vectors = [(np.frombuffer(r["dims"], "<i4"), np.frombuffer(r["vals"], "<f4")) for r in got]
    return fit(vectors, np.array([r["quality"] for r in got]))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they came."""
    scored = score_documents(docs, train(docs, labels))
    return scored.filter("kept").select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("row.doc_id", *COUNTS, "base_failed", "kept", "probability")


QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLES: dict[str, str] = {}
