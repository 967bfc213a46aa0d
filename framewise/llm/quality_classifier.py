"""Quality of texts: naive Bayes features in a linear support vector machine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.llm.common import map_texts, plain_names, small_batches

#: n-grams are hashed to 2 ** BITS features.
BITS = 18
GRAMS = (1, 2, 3)
RUNS = 4
#: Labelled documents of each class at most that the model is fitted on.
SAMPLE = 3_000
THRESHOLD = 0.7
COST, EPOCHS, SEED = 1.0, 12, 5


@dataclass(frozen=True)
class Model:
    """score = sigmoid(slope * margin + level); margin = mean of the weights of a text's n-grams, times the root of their number, + bias."""

    weights: np.ndarray
    bias: float
    slope: float
    level: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        margin = np.array([_margin(self.weights, self.bias, g) for g in map(Grams(), texts)])
        return 1 / (1 + np.exp(-(self.slope * margin + self.level)))


class Grams:
    """The distinct n-grams of a text, as sorted feature numbers. Whole texts, however long.

    Two sequences have n-grams: the bytes, hashed, and whether each word equals
    the one before it, of which runs of up to ``RUNS`` equal words are features.
    """

    def __init__(self) -> None:
        self.seen = np.zeros(1 << BITS, bool)

    def __call__(self, text: bytes) -> np.ndarray:
        a = np.frombuffer(text, np.uint8).astype(np.uint32)
        code = np.zeros(len(a), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            if len(a) < n:
                break
            code = (code[: len(a) - n + 1] << np.uint32(8)) | a[n - 1 :]
            if n in GRAMS:
                self.seen[((code + np.uint32(n * 0x1000193)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)] = True
        words = text.split()
        same = bytes(map(eq, words, words[1:]))
        for n in range(1, RUNS + 1):
            self.seen[n] |= b"\1" * n in same
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found.astype(np.int32)


def _packed(grams: np.ndarray) -> bytes:
    """A text's features as bytes: their numbers, or a bit for each possible one where that is shorter (``2 ** BITS / 8`` at most)."""
    if 4 * len(grams) < (1 << BITS) // 8:
        return grams.tobytes()
    bits = np.zeros(1 << BITS, bool)
    bits[grams] = True
    return np.packbits(bits).tobytes()


def _unpacked(row: bytes) -> np.ndarray:
    if len(row) < (1 << BITS) // 8:
        return np.frombuffer(row, np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(row, np.uint8))).astype(np.int32)


def _margin(weights: np.ndarray, bias: float, grams: np.ndarray) -> float:
    return float(weights[grams].sum() / np.sqrt(max(1, len(grams))) + bias)


def _dual_descent(rows: list[bytes], y: np.ndarray, scale: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of min 1/2 |w|^2 + sum cost * hinge, by dual coordinate descent over rows ``scale[grams] / sqrt(n)`` and a constant 1."""
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)).tolist():
            grams = _unpacked(rows[i])  # one row at a time, so that long texts take no more memory than their bits
            x = scale[grams] / np.sqrt(max(1, len(grams)))
            grad = y[i] * (w[grams] @ x + bias) - 1
            new = min(max(alpha[i] - grad / (float(x @ x) + 1), 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[grams] += step * x
                bias += step
                alpha[i] = new
    return w * scale, bias


def _log_ratio(rows: list[bytes], y: np.ndarray) -> np.ndarray:
    """log of the shares of either class's documents that hold an n-gram, over each other; both smoothed alike, so an unknown one says nothing."""
    n, count = {}, {}
    for s in (1, -1):
        own = np.flatnonzero(y == s)
        n[s], count[s] = max(1, len(own)), np.zeros(1 << BITS)
        for i in own.tolist():
            count[s][_unpacked(rows[i])] += 1
    smooth = 1 / sum(n.values())
    return np.log((count[1] / n[1] + smooth) / (count[-1] / n[-1] + smooth))


def _sigmoid_fit(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and level of Platt's sigmoid, by Newton steps."""
    target = np.where(y > 0, 0.995, 0.005)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        grad = np.array([g @ margin + 1e-3 * a, g.sum()])
        hess = np.array([[h @ margin**2 + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 0.0)), float(b)


def held_out() -> F.Column:
    """Rows whose labels are never learned from: crc32 of the id as text, mod 4, is 2 (a null id: false)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents of each class, the first by a hash of doc_id.

    docs: ``doc_id``, ``text``; labels: ``doc_id`` and ``label`` (0, 1). Null
    labels and ids are left out; a document labelled twice counts with its
    higher label, rows that repeat a doc_id once. Without both classes the score of all is
    the share of label 1 (1 of none). The driver holds the sample's n-grams, 32 kB a
    document at most: 200 MB, whatever the input.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = known.withColumn("h", F.xxhash64("doc_id"))
    chosen = None
    for y in (0, 1):
        part = order.where(F.col("y") == y).orderBy("h", "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * sample ids: small enough to broadcast, whatever the input.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "y")), "doc_id")

    def made(batch: list[bytes]) -> list:
        grams = Grams()
        return [pa.array([_packed(grams(t)) for t in batch], pa.binary())]

    rows = map_texts(texts, ["doc_id", "y"], [T.StructField("grams", T.BinaryType())], made)
    table = rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("grams").alias("grams")).toPandas().sort_values("doc_id")
    grams = [bytes(g) for g in table["grams"]]
    y = np.where(table["y"].to_numpy() == 1, 1, -1)
    if len(set(y.tolist())) < 2:
        n = sum(totals.values())
        share = totals.get(1, 0) / n if n else 1.0
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    each = np.where(y > 0, totals[1] / max(1, (y > 0).sum()), totals[0] / max(1, (y < 0).sum()))
    each = each / each.mean()
    # The sigmoid is fitted on margins of rows that the weights behind them haven't seen.
    margin = np.zeros(len(y))
    fold = np.arange(len(y)) % 3
    for k in range(3):
        train = np.flatnonzero(fold != k)
        if len(set(y[train].tolist())) < 2:
            train = np.arange(len(y))
        seen = [grams[i] for i in train]
        w, bias = _dual_descent(seen, y[train], _log_ratio(seen, y[train]), COST * each[train])
        margin[fold == k] = [_margin(w, bias, _unpacked(grams[i])) for i in np.flatnonzero(fold == k)]
    slope, level = _sigmoid_fit(margin, y, each)
    w, bias = _dual_descent(grams, y, _log_ratio(grams, y), COST * each)
    return Model(w.astype(np.float32), bias, slope, level)


def score(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` of every document, ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD``); a null text is empty."""
    made = [T.StructField("score", T.DoubleType())]
    return map_texts(docs, columns, made, lambda texts: [model.score(texts)]).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


@plain_names
def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model predicts as good, all columns as given.

    A null text is judged as an empty one, repeated rows are judged each, extra columns stay, no rows give no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(model.score(texts) >= THRESHOLD, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
