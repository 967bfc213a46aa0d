"""Near-duplicate texts: SimHash fingerprints in vantage-point trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.llm.common import map_texts, materialize
from framewise.llm.graph import connected_components, local_components

RADIUS = 2
#: Fingerprints at most from which the upper levels of the tree are laid out on the driver (8 bytes each).
TREE_SAMPLE = 32_768
#: Fingerprints that a shard of the tree is to hold.
SHARD = 4_096
#: Below this a branch is compared whole.
LEAF = 512
#: Rows of a shard that a task searches; larger shards are parted further, dense clusters cut into pairs of blocks.
BLOCK = 65_536


def fingerprint(text: bytes, words: int) -> np.uint64:
    """The 64-bit SimHash: the majority of the XXH64 (seed 42) of all word shingles, repeats included; zero without a word.

    A-Z are lower-cased; words are runs of anything but ASCII white space;
    fewer words than a shingle has make one shingle.
    """
    w = text.lower().split()
    if not w:
        return np.uint64(0)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    x = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)
    counts = np.zeros(64, np.int64)
    for a in range(0, len(x), 4096):  # a long text needs no more memory than a short one
        counts += np.unpackbits(x[a : a + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(x), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) of every text; null is empty."""

    def made(texts: list[bytes]) -> list:
        return [pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))]

    return map_texts(docs, ["doc_id"], [T.StructField("fp", T.LongType())], made)


def _far(x: np.ndarray, y) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def _split(x: np.ndarray, radius: int) -> tuple[np.uint64, int, np.ndarray, np.ndarray] | None:
    """A vantage point, the median distance from it, and the rows of the inner and the outer branch.

    By the triangle bound two fingerprints within ``radius`` lie on different
    sides only if the inner one is within ``radius`` of the boundary. Such
    inner ones go to both branches; so each pair meets in one branch at least.
    None: no vantage point of those tried parts them.
    """
    for k in range(4):
        vp = x[(k * 2 + 1) * len(x) // 8]
        d = _far(x, vp)
        mu = int(np.median(d))
        mu -= not (d > mu).any()
        inner, outer = np.flatnonzero(d <= mu), np.flatnonzero(d.astype(int) > mu - radius)
        if max(len(inner), len(outer)) <= 0.85 * len(x):
            return vp, mu, inner, outer
    return None


def layout(sample: np.ndarray, leaves: int, radius: int = RADIUS) -> list | int:
    """Upper levels of the tree: nested ``[vp, mu, inner, outer]``, an int for each shard."""
    count = 0

    def grow(x: np.ndarray, wanted: int):
        nonlocal count
        if wanted <= 1 or len(x) < 16 or (cut := _split(x, radius)) is None:
            count += 1
            return count - 1
        vp, mu, *_ = cut
        inner = _far(x, vp) <= mu
        return [vp, mu, grow(x[inner], wanted // 2), grow(x[~inner], wanted - wanted // 2)]

    return grow(sample, leaves)


def shards_of(fp: np.ndarray, node, rows: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, rows) of all the shards whose region a fingerprint lies in or has to be asked in."""
    if not len(rows):
        return
    if not isinstance(node, list):
        yield node, rows
        return
    vp, mu, inner, outer = node
    d = _far(fp[rows], vp).astype(int)
    yield from shards_of(fp, inner, rows[d <= mu], radius)
    yield from shards_of(fp, outer, rows[d > mu - radius], radius)


def tree_links(x: np.ndarray, radius: int = RADIUS, side: np.ndarray | None = None) -> np.ndarray:
    """Label of each fingerprint of ``x``: the first row that pairs within ``radius`` reach.

    With ``side`` (a boolean a row) only pairs of rows on different sides are compared.
    """
    label = np.arange(len(x))

    def linked(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.nonzero(_far(x[p][:, None], x[q][None, :]) <= radius)
        return p[i], q[j]

    def unite(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        new = label[i] != label[j]
        if new.any():
            label = local_components(len(x), np.concatenate([np.arange(len(x)), i[new]]), np.concatenate([label, j[new]]))

    def across(p: np.ndarray, q: np.ndarray) -> None:
        for a in range(0, len(p), LEAF):
            for b in range(a if p is q else 0, len(q), LEAF):
                unite(*linked(p[a : a + LEAF], q[b : b + LEAF]))

    if side is not None:
        across(np.flatnonzero(side), np.flatnonzero(~side))
    todo = [np.arange(len(x))] if side is None else []
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            across(rows, rows)
        elif (cut := _split(x[rows], radius)) is not None:
            todo += [rows[cut[2]], rows[cut[3]]]
        else:
            # A dense cluster: what one pivot links is one component already and needs no pairs within.
            i, j = linked(rows[:1], rows)
            unite(np.repeat(i, len(j) // max(1, len(i))), j)
            rest = np.setdiff1d(rows, j, assume_unique=True)
            if len(j) >= len(rows) // 16:
                across(j, rest)
                todo.append(rest)
            else:
                across(rows, rows)
    return label


def _larger(batches: Iterator[pd.DataFrame], rows: int = 32_768) -> Iterator[pd.DataFrame]:
    """Batches put together to ``rows``: a walk down the tree costs the same for few rows as for many."""
    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def _deal(prints: DataFrame, radius: int) -> DataFrame:
    """``(shard, fp)``: every fingerprint in all shards of the upper tree that it has to be asked in.

    Shards are numbered as in a heap, so that 2 s and 2 s + 1 can be the branches of s.
    """
    n = prints.count()
    hashed = prints.select("fp", F.xxhash64("fp").alias("__h"))
    if n > 2 * TREE_SAMPLE:  # the smallest hashes lie below this, so that few rows of each task leave it
        hashed = hashed.where(F.col("__h") < F.lit(-(2**63) + 2**64 * 2 * TREE_SAMPLE // n))
    sample = hashed.orderBy("__h", "fp").limit(TREE_SAMPLE).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    leaves = max(1, math.ceil(n / SHARD))
    tree, first = layout(sample, leaves, radius), 1 << leaves.bit_length()

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _larger(batches):
            fp = b["fp"].to_numpy(np.int64)
            for shard, rows in shards_of(fp.view(np.uint64), tree, np.arange(len(fp)), radius):
                yield pd.DataFrame({"shard": first + shard, "fp": fp[rows]})

    return prints.select("fp").mapInPandas(deal, "shard long, fp long")


def _parted(dealt: DataFrame, radius: int) -> DataFrame:
    """``(shard, fp, blocks)`` of ``dealt`` with shards over ``BLOCK`` rows parted further, a level of the tree a round.

    The vantage point of a shard comes from a sample of it, all its rows go to
    the inner or outer branch by distance, those near the boundary to both. A
    shard that no vantage point parts (a dense cluster) gets as many
    ``blocks`` as it has ``BLOCK`` rows; all others get one.
    """

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        cut = _split(np.sort(g["fp"].to_numpy(np.int64)).view(np.uint64), radius)
        return pd.DataFrame({"shard": g["shard"].iloc[:1], "vp": [cut[0].view(np.int64)], "mu": [cut[1]]}) if cut else pd.DataFrame({"shard": [], "vp": [], "mu": []})

    done, live = [], materialize(dealt)
    while True:
        large = materialize(live.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
        if large.isEmpty():
            break
        sample = live.join(large, "shard").where(F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / SHARD)) == 0).select("shard", "fp")
        cuts = materialize(sample.groupBy("shard").applyInPandas(choose, "shard long, vp long, mu int"))
        marked = live.join(large, "shard", "left").join(cuts, "shard", "left")
        done.append(marked.where("vp IS NULL").select("shard", "fp", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int").alias("blocks")))
        d = F.bit_count(F.col("fp").bitwiseXOR(F.col("vp")))
        branches = F.array_compact(F.array(F.when(d <= F.col("mu"), 2 * F.col("shard")), F.when(d > F.col("mu") - radius, 2 * F.col("shard") + 1)))
        live = materialize(marked.where("vp IS NOT NULL").select(F.explode(branches).alias("shard"), "fp"))
    out = live.withColumn("blocks", F.lit(1))
    for part in done:
        out = out.unionByName(part)
    return out


def _search(prints: DataFrame, radius: int) -> DataFrame:
    """Links ``(src, dst)`` between fingerprints within ``radius`` of one another: exact, a forest for each shard.

    A shard with several blocks is searched by pairs of blocks in separate
    tasks, so no task holds more than two.
    """

    def search(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("fp")
        fp = g["fp"].to_numpy(np.int64)
        label = tree_links(fp.view(np.uint64), radius, (g["mine"] == g["i"]).to_numpy() if g["i"].iloc[0] != g["j"].iloc[0] else None)
        some = np.flatnonzero(label != np.arange(len(fp)))
        return pd.DataFrame({"src": fp[some], "dst": fp[label[some]]})

    pieces = (
        _parted(_deal(prints, radius), radius)
        .withColumn("mine", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("shard", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "fp")
    )
    return pieces.groupBy("shard", "i", "j").applyInPandas(search, "src long, dst long")


def rooted(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``distinct`` fingerprints (``fp`` and others) with the ``root`` of those that links within ``radius`` reach."""
    comp = materialize(connected_components(_search(distinct, radius)))
    return distinct.join(comp, F.col("fp") == F.col("id"), "left").select(*distinct.columns, F.coalesce("component_id", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """Group texts whose fingerprints differ in ``radius`` bits or fewer.

    docs: ``doc_id`` and ``text``; other columns are ignored. Returns
    ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest
    doc_id that links reach), one row per row given. Null and wordless texts
    have fingerprint zero, which is linked like any other. A null doc_id never
    names a component: where no id is, it is null. No rows give no rows.

    Only distinct fingerprints enter the tree. The upper levels come from a
    sample of ``TREE_SAMPLE`` of them, all fingerprints are dealt to shards by
    distance (those near a boundary to both sides), shards that are still large
    are parted further by vantage points of their own, and each is searched
    with a tree of its own. The search is exact. A shard emits a forest, not
    its pairs.
    """
    prints = materialize(fingerprints(docs, words))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = rooted(distinct, radius)
    named = found.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = found.join(named, "root").select("fp", "component_id")
    return prints.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
