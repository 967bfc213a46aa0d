"""Ranked lexical search: impact tiles times item tiles, as dense matrix products of whole numbers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.common import small_batches

TOP = 20
#: Bytes of item texts that are ranked in one pass over the documents.
ITEM_BYTES = 4 << 20
#: Documents, and cells (documents x vocabulary), of an impact tile at most.
TILE_ROWS, TILE_CELLS = 2048, 1 << 23
#: No impact is larger; sums of products stay below EXACT, so doubles hold them exactly in any order of addition.
IMPACT, EXACT = 10**6, 2**53
#: A-Z to a-z, all other ASCII characters but letters and digits to a space; what isn't ASCII stays.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class _Vocabulary(dict):
    """Number of each term; all that aren't in it have the number after the last."""

    def __missing__(self, term: bytes) -> int:
        return self.size

    @classmethod
    def of(cls, texts: list[bytes]) -> _Vocabulary:
        made = cls((t, i) for i, t in enumerate(sorted({t for text in texts for t in terms(text)})))
        made.size = len(made)
        return made

    def __reduce__(self):
        return _rebuilt, (list(self),)


def _rebuilt(words: list[bytes]) -> _Vocabulary:
    made = _Vocabulary((t, i) for i, t in enumerate(words))
    made.size = len(made)
    return made


def weight_tiles(counts: np.ndarray, weights: np.ndarray) -> list[tuple[slice, np.ndarray]]:
    """(columns, vocabulary tile of items x terms): summed over all tiles they are ``counts * weights``.

    Within a tile no item's weights sum up to ``EXACT / IMPACT``, so a tile's
    product with any impacts is exact in doubles. Usually it is one tile.
    """
    most = (EXACT - 1) // IMPACT
    q = counts * weights
    tiles = []
    while q.any():
        part = np.minimum(q, most)  # a weight beyond what a tile can hold goes on in the next round
        start, run = 0, np.zeros(len(q), np.int64)
        for c in range(part.shape[1]):
            if ((run + part[:, c]) > most).any():
                tiles.append((slice(start, c), part[:, start:c]))
                start, run = c, np.zeros(len(q), np.int64)
            run += part[:, c]
        tiles.append((slice(start, part.shape[1]), part[:, start:]))
        q = q - part
    return [(s, t.astype(np.float64)) for s, t in tiles if t.any()]


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Impact tile of a tile of term counts (documents x terms)."""
    out = np.zeros(tf.shape)
    r, c = np.nonzero(tf)
    f = tf[r, c].astype(np.int64)
    out[r, c] = (1_000_000_000 * f) // (1000 * f + 12 * m[r])
    return out


def _tiles(batches: Iterator[pa.RecordBatch], vocabulary: _Vocabulary) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_id, number of terms, tf) tile by tile."""
    width = vocabulary.size + 1
    rows = max(1, min(TILE_ROWS, TILE_CELLS // width))
    ids, numbers, lengths = [], [], []

    def tile():
        n = np.array(lengths, np.int64)
        key = np.repeat(np.arange(len(n)) * width, n) + (np.concatenate(numbers) if numbers else np.zeros(0, np.int64))
        return pa.array(ids, pa.int64()), n, np.bincount(key, minlength=len(n) * width).reshape(len(n), width)[:, :-1]

    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("__text").to_pylist(), strict=True):
            found = terms(text)
            ids.append(doc_id)
            lengths.append(len(found))
            numbers.append(np.fromiter(map(vocabulary.__getitem__, found), np.int64, len(found)))
            if len(ids) == rows:
                yield tile()
                ids, numbers, lengths = [], [], []
    if ids:
        yield tile()


def statistics(docs: DataFrame, vocabulary: _Vocabulary) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each term of the vocabulary: a task sends one count a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(vocabulary.size, np.int64), 0, 0
        for _, lengths, tf in _tiles(batches, vocabulary):
            df += (tf > 0).sum(axis=0)
            n += int((lengths > 0).sum())
            total += int(lengths.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(df))), pa.array(np.r_[n, total, df])], names=["term", "n"])

    got = dict(map(tuple, docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect()))
    return got.get(-2, 0), got.get(-1, 0), np.array([got.get(i, 0) for i in range(vocabulary.size)], np.int64)


def _best(item: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Rows of the ``k`` highest scores of each item, equal scores by ``key``."""
    order = np.lexsort((key, -score, item))
    i = item[order]
    start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    place = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
    return order[place < k]


def ranker(vocabulary: _Vocabulary, tiles: list, items: int, n_docs: int, total: int, k: int) -> Callable:
    """A function that ranks a task's documents: at most ``k`` rows an item come out of a task, whatever it reads."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.iinfo(np.int64).max
        held = np.zeros((3, 0), np.int64)  # item, score, doc_id (null: the largest long)
        least = np.ones(items, np.int64)  # a lower score can't enter
        for doc_id, n, tf in _tiles(batches, vocabulary):
            imp = impacts(tf, 100 - 25 + (25 * n * n_docs) // max(1, total))
            score = np.zeros((len(n), items), np.int64)
            for columns, weights in tiles:
                score += (imp[:, columns] @ weights.T).astype(np.int64)
            row, item = np.nonzero(score >= least)
            if not len(row):
                continue
            ids = doc_id.fill_null(none).to_numpy()
            every = np.concatenate([held, np.stack([item, score[row, item], ids[row]])], axis=1)
            held = every[:, _best(every[0], every[1], every[2], k)]
            number = np.bincount(held[0], minlength=items)
            last = np.full(items, none)
            np.minimum.at(last, held[0], held[1])
            least = np.where(number >= k, last, 1)
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[2], mask=held[2] == none), pa.array(held[1])], names=["item", "doc_id", "score"])

    return rank


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` documents of the highest scores for each item: ``item_id, rank, doc_id, score``.

    docs: ``doc_id, text``; items: ``item_id, text``; other columns are
    ignored. Only scores above 0 count, equal scores go by ascending doc_id,
    nulls last. Documents that repeat a doc_id are documents of their own.
    Items that repeat id and text are one, texts that share an item_id are
    ranked each for itself. Null and wordless texts match nothing. No
    documents or no items give no rows.

    Items are ranked in blocks of some ``ITEM_BYTES``, each a pass over all
    documents. A block's vocabulary is numbered compactly; the documents of a
    task become tiles of impacts (documents x vocabulary), multiplied with the
    items' weights by BLAS. Impacts and weights are whole numbers, and tiles
    are cut so that sums stay below 2**53, so doubles are exact (larger totals
    are added up as longs). A task keeps the best ``k`` of each item only.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8").alias("__text"))
    wanted = items.where("text IS NOT NULL").select("item_id", "text").distinct()
    blocks = max(1, math.ceil((wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / ITEM_BYTES))
    schema = wanted.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {schema}, rank int, doc_id long, score long")
    for block in range(blocks):
        some = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()  # about ITEM_BYTES
        texts = [r["text"].encode() for r in some]
        vocabulary = _Vocabulary.of(texts)
        if not vocabulary.size:
            continue
        n_docs, total, df = statistics(rows, vocabulary)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        counts = np.zeros((len(some), vocabulary.size), np.int64)
        for i, text in enumerate(texts):
            np.add.at(counts[i], [vocabulary[t] for t in terms(text)], 1)
        found = rows.mapInArrow(ranker(vocabulary, weight_tiles(counts, weights), len(some), n_docs, total, k), "item long, doc_id long, score long")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(some)], f"item long, item_id {schema}")
        ranked = found.withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(names), "item")  # a row an item of the block
        out = out.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
    return out
