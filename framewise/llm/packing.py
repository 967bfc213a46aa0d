"""Packing documents into training sequences by multiway differencing."""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.llm.common import buffers, materialize, small_batches
from framewise.llm.tokenizing import encoder

CAPACITY = 4096
END_ID = 2
#: What is left of a document after its full sequences is cut into pieces of this many ids at most.
PIECE = 512
#: Pieces that one task packs together: enough for near-equal windows, bounded at every size of input.
GROUP = 2048


def differencing(sizes: list[int], k: int) -> list[int]:
    """Window (0 to ``k`` - 1) of each size, by Karmarkar-Karp multiway differencing.

    Each size starts as a partition of its own with k - 1 empty windows. The
    two partitions with the largest imbalance are merged again and again, the
    fullest window of one with the emptiest of the other. Only windows that
    hold something are kept: ascending sums, and the node of each in the tree
    of merged windows.
    """
    low, high = [-1] * len(sizes), [-1] * len(sizes)
    heap = [(-size, i, np.array([size], np.int64), [i]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, s, m = heapq.heappop(heap)
        _, _, t, n = heapq.heappop(heap)
        shared = max(0, len(s) + len(t) - k)  # the least of each meet; all others meet an empty window
        nodes = [*range(len(low), len(low) + shared), *m[shared:], *n[shared:]]
        low += m[:shared]
        high += n[:shared][::-1]
        sums = np.concatenate([s[:shared] + t[:shared][::-1], s[shared:], t[shared:]])
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        if len(sums) == k:
            sums = sums - sums[0]
        heapq.heappush(heap, (-int(sums[-1]), tie, sums, [nodes[o] for o in order.tolist()]))
        tie += 1
    out = [0] * len(sizes)
    for w, root in enumerate(heap[0][3] if heap else []):
        todo = [root]
        while todo:
            node = todo.pop()
            if node < len(sizes):
                out[node] = w
            else:
                todo += [low[node], high[node]]
    return out


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """Window of each size, none fuller than ``capacity``; the number of windows rises until that holds.

    Sizes are at most ``capacity``. Full ones have a window to themselves.
    """
    out = [-1] * len(sizes)
    full = [i for i, s in enumerate(sizes) if s == capacity]
    for w, i in enumerate(full):
        out[i] = w
    rest = [i for i, s in enumerate(sizes) if s < capacity]
    k = max(1, math.ceil(sum(sizes[i] for i in rest) / capacity))
    while rest:
        found = differencing([sizes[i] for i in rest], k)
        filled = np.bincount(found, weights=[sizes[i] for i in rest], minlength=k)
        if filled.max() <= capacity:
            for i, w in zip(rest, found, strict=True):
                out[i] = len(full) + w
            break
        k += 1 + k // 512
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each document's ids and ``end_id``, cut into full sequences and pieces of the rest: ``doc_id, start, length, ids_crc32, doc_tokens``."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("__text"))
    made = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens"))])

    def cut(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            ids, at = enc.encode(*buffers(batch.column("__text")))
            total = np.diff(at) + 1
            full = total // capacity
            n = full + -(-(total % capacity) // PIECE)
            doc = np.repeat(np.arange(len(total)), n)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            whole = nth < full[doc]
            start = np.where(whole, nth * capacity, full[doc] * capacity + (nth - full[doc]) * PIECE)
            length = np.where(whole, capacity, np.minimum(total[doc] - start, PIECE))
            end = np.array([end_id], "<u4").tobytes()
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = []
            for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True):
                last = s + m == total[d]
                a = 4 * (int(at[d]) + s)
                c = zlib.crc32(raw[a : a + 4 * (m - last)])
                crc.append(zlib.crc32(end, c) if last else c)
            columns = [batch.column("doc_id").take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total[doc]))]
            yield pa.RecordBatch.from_arrays(columns, names=made.names)

    return rows.mapInArrow(cut, made)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids with little padding.

    docs: ``doc_id`` and ``text`` (null: empty); other columns are ignored; an
    empty text is its end id alone. Returns one row per piece: ``doc_id``,
    ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``,
    ``offset``. Rows that repeat a doc_id, or have none, are documents of their
    own. No rows give no rows.

    A document is cut into as many full sequences as it fills and pieces of
    ``PIECE`` ids of the rest; many pieces a window make windows near-equal.
    They go by hash into groups of about ``GROUP``, packed each by differencing. Only spans are shuffled; ``ids_of``
    reads the ids themselves back.
    """
    spans = materialize(pieces(docs, tokenizer, capacity, end_id))
    groups = max(1, round(spans.count() / GROUP))
    spans = spans.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def place(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True]).reset_index(drop=True)
        g["w"] = windows(g["length"].tolist(), capacity)
        g["offset"] = g.groupby("w")["length"].cumsum() - g["length"]
        g["sequence_id"] = g["g"] * (1 << 32) + g["w"]
        return g[names]

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return spans.groupBy("g").applyInPandas(place, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:]))


def ids_of(packed: DataFrame, docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """``packed`` with the column ``ids``: the ids of each piece, in order. doc_id names one document here."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("__text"))

    def encoded(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            ids, at = enc.encode(*buffers(batch.column("__text")))
            parts = [[*ids[a:z].tolist(), end_id] for a, z in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(parts, pa.list_(pa.int32()))], names=["doc_id", "all_ids"])

    tokens = rows.mapInArrow(encoded, T.StructType([rows.schema["doc_id"], T.StructField("all_ids", T.ArrayType(T.IntegerType()))]))
    return packed.join(tokens, "doc_id").withColumn("ids", F.slice("all_ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))).drop("all_ids")
