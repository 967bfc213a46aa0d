"""Substring dedup: suffix automata of reference shards give the matching statistics of all texts that can match them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.llm.common import if_small, materialize, release, small_batches

#: Words of a window: what repeats at this length or more is removed.
WINDOW = 13
#: Words that a shard of the reference is to hold.
SHARD = 200_000
#: Anchors that a task gathers before it sends them, and that a bucket of anchors is to hold.
FLUSH, BUCKET, LEAST_BUCKETS = 1 << 21, 1 << 22, 64
#: Bits at most (as a power of two) of the filter of shared anchors that is broadcast: 16 MB.
FILTER_BITS = 27


class SuffixAutomaton:
    """All substrings of the word sequences that were added."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, after: dict[bytes, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _copy(self, p: int, q: int, w: bytes) -> int:
        """The part of state ``q`` that ``p`` and ``w`` reach: ``q`` itself if that is all of it."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], self.next[q].copy())
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[bytes]) -> None:
        after, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            if (q := after[last].get(w)) is not None:  # it is known from an earlier sequence
                last = self._copy(last, q, w)
                continue
            new = self._state(length[last] + 1, 0, {})
            p = last
            while p >= 0 and w not in after[p]:
                after[p][w] = new
                p = link[p]
            if p >= 0:
                link[new] = self._copy(p, after[p][w], w)
            last = new

    def matching(self, words: list[bytes]) -> list[int]:
        """Matching statistics: for each word the length of the longest substring that ends there and is known."""
        after, link, length = self.next, self.link, self.length
        state = run = 0
        out = []
        for w in words:
            while (q := after[state].get(w)) is None and state:
                state = link[state]
                run = length[state]
            if q is not None:
                state = q
                run += 1
            out.append(run)
        return out


class _Hashes(dict):
    """64-bit hashes of words, each computed once while the table is small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def anchors(bodies: list[list[bytes]], window: int, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, body, place among the words of all bodies) of each window of each body, in order.

    The anchor is the least hash of the runs of ``(window + 1) // 2`` words
    within the window. It depends on the window's words only, so equal windows
    have equal anchors, and neighbouring windows mostly share one.
    """
    n = np.fromiter(map(len, bodies), np.int64, len(bodies))
    windows = np.maximum(n - window + 1, 0)
    total, count = int(n.sum()), int(windows.sum())
    body = np.repeat(np.arange(len(n)), windows)
    at = np.arange(count) + np.repeat(np.cumsum(n) - n - (np.cumsum(windows) - windows), windows)
    if not count:
        return np.zeros(0, np.uint64), body, at
    h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(bodies)), np.uint64, total)
    k = (window + 1) // 2
    g = h[: total - k + 1].copy()
    for j in range(1, k):
        g = (g ^ (g >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(g)]
    for shift in (31, 29):
        g = (g ^ (g >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    least = g[: total - window + 1].copy()
    for j in range(1, window - k + 1):
        np.minimum(least, g[j : j + len(least)], out=least)
    return least[at], body, at


def runs(*x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of rows that are equal in all arrays."""
    n = len(x[0])
    start = np.flatnonzero(np.r_[True, np.logical_or.reduce([a[1:] != a[:-1] for a in x])]) if n else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, n])


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of True."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte by byte of equal weight, which compresses what they have in common."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _bytes_of(docs: DataFrame) -> DataFrame:
    """``doc_id, x, text`` of the documents that have an id; x tells texts of one id apart."""
    small_batches(docs.sparkSession)
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("x"), F.encode("text", "utf-8").alias("text"))


def shared_anchors(texts: DataFrame, window: int) -> DataFrame:
    """``anchor, first``: anchors that documents of different ids have, with the smallest id.

    A task packs what it has read: an anchor once, with its smallest and
    largest id, whatever number of its documents have it. Packs are dealt by
    ranges of the anchors.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(int(math.log2(LEAST_BUCKETS)), math.ceil(math.log2(max(1, size / 26 / BUCKET))))  # an anchor in some 26 bytes of text
    shift = np.uint64(64 - bits)

    def packs(a: list[np.ndarray], d: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a, d = np.concatenate(a), np.concatenate(d)
        order = np.lexsort((d, a))
        a, d = a[order], d[order]
        start, n = runs(a)
        a, low, high = a[start], d[start], d[start + n - 1]
        at, number = runs(a >> shift)
        step = np.diff(a, prepend=np.uint64(0))
        step[at] = a[at]
        cut = [slice(s, s + k) for s, k in zip(at, number, strict=True)]
        columns = [[_planes(step[c]) for c in cut], [_planes(low[c]) for c in cut], [_planes((high - low)[c]) for c in cut]]
        yield pa.RecordBatch.from_arrays([pa.array((a[at] >> shift).astype(np.int64)), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "steps", "low", "more"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, a, d, held = _Hashes(), [], [], 0
        for b in batches:
            found, row, _ = anchors([t.split() for t in b.column("text").to_pylist()], window, hashes)
            start, _ = runs(found, row)
            a.append(found[start])
            d.append(b.column("doc_id").to_numpy()[row[start]])
            held += len(start)
            if held >= FLUSH:
                yield from packs(a, d)
                a, d, held = [], [], 0
        if held:
            yield from packs(a, d)

    def shared(g: pa.Table) -> pa.Table:
        a, low, more = [], [], []
        for s, lo, up in zip(*(g.column(c).to_pylist() for c in ("steps", "low", "more")), strict=True):
            a.append(np.cumsum(_numbers(s, np.uint64), dtype=np.uint64))
            low.append(_numbers(lo, np.int64))
            more.append(_numbers(up, np.int64))
        a, low, more = map(np.concatenate, (a, low, more))
        high = low + more
        order = np.argsort(a, kind="stable")
        a, low, high = a[order], low[order], high[order]
        start, _ = runs(a)
        low, high = np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)
        some = low < high
        return pa.table({"anchor": a[start][some].view(np.int64), "first": low[some]})

    packed = texts.select("doc_id", "text").mapInArrow(gather, "bucket long, steps binary, low binary, more binary")
    return packed.groupBy("bucket").applyInArrow(shared, "anchor long, first long")


def _filter(shared: DataFrame) -> np.ndarray:
    """A bit for each remainder of a shared anchor; of bounded size, so of little use where there are very many, but never wrong about one that is shared."""
    bits = min(FILTER_BITS, max(18, math.ceil(math.log2(16 * max(1, shared.count())))))
    at = F.col("anchor").bitwiseAND(F.lit((1 << bits) - 1))
    rows = shared.groupBy(F.shiftright(at, 15).alias("block")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(0x7FFF))).alias("bitmap")).collect()  # 16 MB at most
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        out[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(r["bitmap"], np.uint8)
    return out


def _digest(body: bytes) -> tuple[int, int]:
    high, low = divmod(xxhash.xxh3_128_intdigest(body), 2**64)
    return high - (high >> 63 << 64), low - (low >> 63 << 64)


_PIECE = "doc_id long, x long, start int, n int, d1 long, d2 long, body binary"


def _regions(texts: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """Runs of windows (``doc_id, x``, the first one's ``start``, their number ``n``) whose anchors may be shared, with their words and a digest of these."""
    held = texts.sparkSession.sparkContext.broadcast(_filter(shared))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bitmap = _Hashes(), held.value
        mask = np.uint64(8 * len(bitmap) - 1)
        for b in batches:
            rows, texts = [], [t.split() for t in b.column("text").to_pylist()]
            found, row, at = anchors(texts, window, hashes)
            bit = found & mask
            some = np.flatnonzero(bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
            start, length = runs(row[some], at[some] - np.arange(len(some)))  # windows next to one another in a text
            first = np.r_[0, np.cumsum([len(t) for t in texts])]
            ids, x = b.column("doc_id").to_pylist(), b.column("x").to_pylist()
            for k, n in zip(some[start].tolist(), length.tolist(), strict=True):
                r = int(row[k])
                s = int(at[k] - first[r])
                body = b" ".join(texts[r][s : s + n + window - 1])
                rows.append((ids[r], x[r], s, n, *_digest(body), body))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names=[f.split()[0] for f in _PIECE.split(", ")])

    return texts.mapInArrow(find, _PIECE)


def _cells(bodies: DataFrame, window: int) -> DataFrame:
    """``rid, at, n, key``: the windows of each body, those next to one another with one anchor together."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            rid, texts = b.column("rid").to_numpy(), [t.split() for t in b.column("body").to_pylist()]
            key, row, at = anchors(texts, window, hashes)
            at = at - (np.r_[0, np.cumsum([len(t) for t in texts])][row])
            start, length = runs(key, row)
            columns = (rid[row[start]], at[start].astype(np.int32), length.astype(np.int32), key[start].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rid", "at", "n", "key"])

    return bodies.select("rid", "body").mapInArrow(cut, "rid long, at int, n int, key long")


def _windows(bodies: DataFrame, window: int) -> DataFrame:
    """``rid, first, at, n, w1, w2``: the windows of each body with a digest of their words; equal ones next to one another are one row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rid, first, body in zip(*(b.column(c).to_pylist() for c in ("rid", "first", "body")), strict=True):
                words = body.split()
                each = (d for i in range(len(words) - window + 1) for d in _digest(b" ".join(words[i : i + window])))
                digest = np.fromiter(each, np.int64).reshape(-1, 2)
                start, n = runs(*digest.T)
                out.append((np.full(len(start), rid), np.full(len(start), first), start.astype(np.int32), n.astype(np.int32), *digest[start].T))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["rid", "first", "at", "n", "w1", "w2"])

    return bodies.select("rid", "first", "body").mapInArrow(cut, "rid long, first long, at int, n int, w1 long, w2 long")


def _known_windows(bodies: DataFrame, window: int) -> DataFrame:
    """``rid, at, n``: windows of the bodies whose words a body of a smaller id holds, by the smallest id of each window: no words of a window are gathered, in however many bodies and runs it lies."""
    cells = materialize(_windows(bodies, window))
    least = cells.groupBy("w1", "w2").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most").drop("most")
    return cells.join(least, ["w1", "w2"]).where("first > least").select("rid", "at", "n")


def _parts(bodies: DataFrame, cells: DataFrame, window: int) -> DataFrame:
    """``key, rid, at, n, doc_id, d1, d2, body``: each body cut where the key of its cells changes; parts overlap in words, not in windows."""
    cells = cells.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("at", "n", "key"))).alias("c"))
    listed = bodies.join(cells.select("rid", F.col("c.at").alias("ats"), F.col("c.n").alias("ns"), F.col("c.key").alias("keys")), "rid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rid, first, body, ats, ns, keys in zip(*(b.column(c).to_pylist() for c in ("rid", "first", "body", "ats", "ns", "keys")), strict=True):
                words, k = body.split(), 0
                while k < len(ats):
                    at, n, key = ats[k], ns[k], keys[k]
                    k += 1
                    while k < len(ats) and keys[k] == key and ats[k] == at + n:
                        n += ns[k]
                        k += 1
                    part = b" ".join(words[at : at + n + window - 1])
                    out.append((key, rid, at, n, first, *_digest(part), part))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "rid", "at", "n", "doc_id", "d1", "d2", "body"])

    return listed.mapInArrow(cut, "key long, rid long, at int, n int, doc_id long, d1 long, d2 long, body binary")


def seen_before(bodies: list[list[bytes]], ids: list[int], window: int) -> list[np.ndarray]:
    """For each body a flag a window: whether a body of a smaller id holds its words. ``ids`` ascend.

    A body is matched against the automaton of all before it, and only the
    runs of windows that are new are added to it.
    """
    automaton, out, waits = SuffixAutomaton(), [], []
    for k, (words, i) in enumerate(zip(bodies, ids, strict=True)):
        if k and ids[k - 1] != i:
            for new in waits:
                automaton.add(new)
            waits = []
        known = np.array(automaton.matching(words)[window - 1 :], np.int64) >= window
        out.append(known)
        waits += [words[s : s + n + window - 1] for s, n in zip(*spans(~known), strict=True)]
    return out


def _searched(parts: DataFrame, window: int) -> DataFrame:
    """``rid, at, n``: windows of the parts whose words a part of the same key and a smaller id holds; a shard of keys to an automaton."""
    total = parts.agg(F.sum(F.col("n") + window - 1)).first()[0] or 0
    shards = max(1, math.ceil(2 * total / SHARD))

    def search(g: pa.Table) -> pa.Table:
        g = g.sort_by([("doc_id", "ascending"), ("rid", "ascending"), ("at", "ascending")])
        flags = seen_before([b.split() for b in g.column("body").to_pylist()], g.column("doc_id").to_pylist(), window)
        rid, at, n = [], [], []
        for r, a, f in zip(g.column("rid").to_pylist(), g.column("at").to_pylist(), flags, strict=True):
            for s, k in zip(*spans(f), strict=True):
                rid.append(r)
                at.append(a + s)
                n.append(k)
        return pa.table([pa.array(rid, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32())], names=["rid", "at", "n"])

    rows = parts.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "rid", "at", "doc_id", "body")
    return rows.groupBy("shard").applyInArrow(search, "rid long, at int, n int")


def _merged(spans: DataFrame, key: str) -> DataFrame:
    """``key, spans``: the lists ``spans`` (of ``at, n``) of a key as one, in order, neighbours put together. Spans of a key don't overlap."""
    one = spans.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"))
    end = lambda x: x["at"] + x["n"]
    first = F.filter("s", lambda x, i: (i == 0) | (x["at"] > end(F.get("s", i - 1))))
    last = F.filter("s", lambda x, i: (i == F.size("s") - 1) | (end(x) < F.get("s", i + 1)["at"]))
    return one.select(key, F.zip_with(first, last, lambda f, l: F.struct(f["at"].alias("at"), (end(l) - f["at"]).alias("n"))).alias("spans"))


def _judged(pieces: DataFrame, shared: DataFrame, window: int, level: int = 0) -> DataFrame:
    """Those of ``pieces`` (``n, doc_id, d1, d2, body`` and others) that have windows whose words a document of a smaller id holds, with these windows as a list of ``spans`` (``at, n``) in place of the body.

    Pieces of equal words are one body, judged for the smallest of their ids;
    all windows of the others are known from it. Bodies are cut so that equal
    windows have one key: the smallest document that has their anchor, then
    (where a key has more words than a shard holds) the anchor. So all that
    can match lies in one shard. Where an anchor has more words than that,
    each of its windows is looked up by itself, without an automaton. A body
    has one list, so joins give a row a piece at most, whatever number of its
    windows repeats.
    """
    bodies = pieces.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.any_value("body").alias("body"))
    bodies = materialize(bodies.withColumn("rid", F.monotonically_increasing_id()))
    listed = lambda found: found.select("rid", F.array(F.struct("at", "n")).alias("spans"))
    if level > 1:
        found = listed(_known_windows(bodies, window))
    else:
        cells = _cells(bodies, window)
        if level == 0:
            cells = cells.join(shared, F.col("key") == F.col("anchor")).select("rid", "at", "n", F.col("first").alias("key"))
        parts = materialize(_parts(bodies, cells, window))
        hot = materialize(parts.groupBy("key").agg(F.sum(F.col("n") + window - 1).alias("words"), F.count("*").alias("parts")).where(f"words > {SHARD} AND parts > 1").select("key"))
        if hot.isEmpty():
            found = listed(_searched(parts, window))
        else:
            some = materialize(parts.join(hot, "key", "left_semi").select(F.col("rid").alias("of"), F.col("at").alias("from"), "n", "doc_id", "d1", "d2", "body"))
            inner = _judged(some, shared, window, level + 1)
            moved = F.transform("spans", lambda x: F.struct((F.col("from") + x["at"]).alias("at"), x["n"].alias("n")))
            found = listed(_searched(parts.join(hot, "key", "left_anti"), window)).unionByName(inner.select(F.col("of").alias("rid"), moved.alias("spans")))
    marks = materialize(_merged(found, "rid"))
    if level < 2:
        release(parts)
    known = materialize(bodies.select("rid", "d1", "d2", "first").join(marks, "rid", "left").drop("rid"))
    rows = pieces.drop("body").join(known, ["d1", "d2"])
    every = F.array(F.struct(F.lit(0).alias("at"), F.col("n").alias("n")))
    return rows.withColumn("spans", F.when(F.col("doc_id") > F.col("first"), every).otherwise(F.col("spans"))).where("spans IS NOT NULL").drop("first", "d1", "d2")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, x, start, n``: spans of words (first and number) that windows cover whose words also start in a document of a smaller id; x is the XXH64 of the text.

    Spans of a document may overlap. Documents without an id have no order
    and take no part; those that share one don't repeat each other.
    """
    texts = _bytes_of(docs)
    shared = materialize(shared_anchors(texts, window))
    found = _judged(materialize(_regions(texts, shared, window)), shared, window)
    rows = found.select("doc_id", "x", "start", F.explode("spans").alias("span"))
    return rows.select("doc_id", "x", (F.col("start") + F.col("span.at")).alias("start"), (F.col("span.n") + window - 1).alias("n")).distinct()


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of each row: the words that are left, joined by a space.

    docs: ``doc_id`` and ``text``; other columns are ignored. A word goes if a
    window of ``window`` words covers it that also starts in a document of a
    smaller id; windows are judged on the texts as given. Null texts have no
    words. Rows that share a doc_id don't repeat each other; rows without one
    keep all words, and remove none. No rows give no rows.
    """
    cut = repeats(docs, window).groupBy("doc_id", "x").agg(F.collect_list(F.struct("start", "n")).alias("cut")).withColumnsRenamed({"doc_id": "i", "x": "y"})
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("x")).join(if_small(materialize(cut)), (F.col("doc_id") == F.col("i")) & (F.col("x") == F.col("y")), "left")
    small_batches(docs.sparkSession)
    rows = rows.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text"), "cut")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = [], [], []
            for text, cut in zip(b.column("text").to_pylist(), b.column("cut").to_pylist(), strict=True):
                words = text.split()
                n.append(len(words))
                if cut:
                    stays = np.ones(len(words), bool)
                    for c in cut:
                        stays[c["start"] : c["start"] + c["n"]] = False
                    words = [words[k] for k in np.flatnonzero(stays)]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=schema.names)

    return rows.mapInArrow(keep, schema)
