"""Vector compression: product codes of integer vectors, nearest entries by equal-average search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import materialize

#: Components are counted in steps of 1 / SCALE.
SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Vectors whose distances are looked at together.
ROWS = 8192


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the entry of ``book`` that is nearest to each row of ``x``; ties go to the lower index. Exact.

    Equal-average search. For vectors of ``d`` components whose sums differ by
    ``g``, the squared distance is ``g * g / d`` at least. Entries lie sorted
    by their sum; each row starts at its own sum and moves outward, to the
    side with the smaller gap, until ``g * g / d`` exceeds the best distance.
    Equality goes on, as an entry of lower index may tie.
    """
    n, d = x.shape
    k = len(book)
    order = np.argsort(book.sum(axis=1), kind="stable")
    sums, own = book.sum(axis=1)[order], x.sum(axis=1)
    high = np.searchsorted(sums, own)
    low = high - 1
    best, index = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
    live = np.arange(n)
    far = np.iinfo(np.int64).max
    while len(live):
        below, above = low[live], high[live]
        down = np.where(below >= 0, own[live] - sums[np.maximum(below, 0)], far)
        up = np.where(above < k, sums[np.minimum(above, k - 1)] - own[live], far)
        gap = np.minimum(down, up)
        # Compared before it is squared: an end that is reached has no gap to square.
        going = gap != far
        going[going] = (index[live[going]] == k) | (gap[going] * gap[going] <= best[live[going]] * d)
        live, down, up = live[going], down[going], up[going]
        if not len(live):
            break
        lower = down <= up
        entry = order[np.where(lower, low[live], high[live])]
        low[live] -= lower
        high[live] += ~lower
        off = x[live] - book[entry]
        dist = (off * off).sum(axis=1)
        won = (dist < best[live]) | ((dist == best[live]) & (entry < index[live]))
        best[live[won]], index[live[won]] = dist[won], entry[won]
    return index, best


def _matrix(column: pa.ListArray, parts: int) -> np.ndarray:
    """Rows x parts x components of a part. Squared distances of larger components would not fit a long."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), parts, -1)
    if len(x) and np.abs(x).max() >= (1 << 29) // x.shape[2]:
        raise ValueError(f"a component is {np.abs(x).max() / SCALE:g}: squared distances of such vectors do not fit a long")
    return x


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, len(b), ROWS):
            yield b.slice(a, ROWS)


def quantized(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """``vec_id, label, q``: the vectors that count, in whole steps (``floor(SCALE * x)``).

    Dropped: vectors that are null or empty, hold null or non-finite
    components, can't be cut into ``parts`` of one length, or are not as long
    as that of the smallest ``vec_id``.
    """
    e = F.col("embedding")
    fine = e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & (F.size(e) > 0) & (F.size(e) % parts == 0)
    whole: Column = F.transform(e, lambda x: F.floor(x.cast("double") * SCALE))
    kept = vectors.where(F.coalesce(fine, F.lit(False)))
    length = kept.agg(F.min(F.struct(F.col("vec_id").isNull(), "vec_id", F.size(e).alias("n"))).getField("n")).first()[0] or 0
    return kept.where(F.size(e) == length).select("vec_id", "label", whole.alias("q"))


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x components of a part) of ``quantized`` rows.

    They start as the rows of the smallest ``vec_id`` (equal ids by their
    components; fewer rows make fewer entries) and are re-made ``rounds``
    times from the floored means of the parts next to them; an entry that no
    part is next to stays. A task sends one sum for each entry and component,
    Spark adds them, and the driver sees as many numbers as the books have.
    """
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    books = np.array([r["q"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for b in _slices(batches):
            x = _matrix(b.column("q"), parts)
            for p in range(parts):
                at, _ = nearest(x[:, p], books[p])
                np.add.at(total[p], at, x[:, p])
                count[p] += np.bincount(at, minlength=len(books[p]))
        p, e = np.nonzero(count)
        d = books.shape[2]
        flat = [np.repeat(p, d), np.repeat(e, d), np.tile(np.arange(d), len(p)), total[p, e].ravel(), np.repeat(count[p, e], d)]
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in flat], names=["part", "entry", "at", "total", "n"])

    for _ in range(rounds):
        made = rows.select("q").mapInArrow(sums, "part long, entry long, at long, total long, n long")
        found = made.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # a row for each number of the books
        new = books.copy()
        for r in found:
            new[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
        books = new
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of the entries' numbers, by part, entry and position within the part."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error``: the entry of each part (two hex digits) and the sum of their squared distances."""
    parts = len(books)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long"

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            x = _matrix(b.column("q"), parts)
            at, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                at[:, p], e = nearest(x[:, p], books[p])
                error += e
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes().hex() for r in at]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(coded, schema)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Product codes of ``vectors`` (``vec_id, embedding, label``; other columns are ignored): ``vec_id, label, code, error, label_error, codebooks_sha256``.

    One row for each vector that ``quantized`` keeps; rows that repeat a
    vec_id each have one. Components of 2**29 steps over the length of a part
    raise an error: no long can hold their distances. A null label is a label
    of its own, a null vec_id comes last. No rows give no rows.

    At most 256 ``entries``, as a code has two hex digits a part.
    """
    rows = materialize(quantized(vectors, parts))
    books = train(rows, parts, entries, rounds)
    made = materialize(encode(rows, books))
    sums = materialize(made.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "__label")
    return made.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label").withColumn("codebooks_sha256", F.lit(digest(books)))
