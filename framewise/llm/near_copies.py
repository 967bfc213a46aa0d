"""Near copies: one row of each group of texts whose shingle sets have a Jaccard similarity of 0.8 or more."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.llm.common import map_texts, materialize, plain_names
from framewise.llm.graph import connected_components
from framewise.llm.simhash_dedup import fingerprint, rooted

#: Words of a shingle, and MinHash bands and values a band. At a similarity of exactly 0.8
#: no band agrees with probability (1 - 0.8**6)**40 = 5.2e-6, whatever kind of edit made the difference.
BODY_WORDS, BANDS, BAND_ROWS = 5, 40, 6
#: Words of a shingle of the SimHash fingerprints.
SIMHASH_WORDS = 3
#: Shingles of a block; larger groups are cut into blocks that share a few rows, the pivots.
BLOCK_SHINGLES, PIVOTS = 1 << 18, 4
_MULTIPLY, _ADD = np.random.default_rng(42).integers(0, 2**63, (2, BANDS * BAND_ROWS, 1), np.uint64) * np.uint64(2) + np.array([1, 0], np.uint64)[:, None, None]


def _chain(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + y


def shingle_set(text: bytes, words: int = BODY_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; words and short texts as in ``fingerprint``."""
    w = text.lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    k = min(words, len(w))
    x = h[: len(w) - k + 1]
    for i in range(1, k):
        x = _chain(x, h[i : i + len(x)])
    return np.unique(x)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each of ``BANDS`` bands of MinHash values; none without a shingle."""
    if not len(shingles):
        return shingles
    low = np.full(BANDS * BAND_ROWS, 2**64 - 1, np.uint64)
    for a in range(0, len(shingles), 256):  # a long text needs no more memory than a short one
        low = np.minimum(low, (shingles[a : a + 256] * _MULTIPLY + _ADD).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, BAND_ROWS).T:
        key = _chain(key, column)
    return key


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indexes ``start[i] .. start[i] + n[i] - 1``, one range after the other."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def similar_links(sets: list[np.ndarray]) -> np.ndarray:
    """Label of each set: the first row that pairs with a Jaccard similarity of 0.8 or more reach. Exact.

    Two such sets share one of the rarest ``n - ceil(0.8 n) + 1`` elements of
    each (the prefix filter). The pairs that these propose are counted whole.
    A row that a component has reached is not compared within it again.
    """
    n = np.array([len(s) for s in sets], np.int64)
    label, start = np.arange(len(n)), np.cumsum(n) - n
    row = np.repeat(label, n)
    if not len(row):
        return label
    _, code, common = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(common), np.int64)
    rank[np.argsort(common, kind="stable")] = np.arange(len(common))
    code = rank[code]
    code = code[np.lexsort((code, row))]
    prefix = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
    rare = _ranges(start, prefix)
    order = np.argsort(code[rare], kind="stable")
    posted, listed = code[rare][order], row[rare][order]
    first = np.searchsorted(posted, np.arange(len(common) + 1))
    seen, mine, live = np.zeros(len(n), bool), np.zeros(len(common), bool), len(n)
    for root in range(len(n)):
        todo = [] if seen[root] else [root]
        seen[root] = True
        while todo:
            p = todo.pop()
            c = code[start[p] : start[p] + prefix[p]]
            near = np.unique(listed[_ranges(first[c], first[c + 1] - first[c])])
            near = near[~seen[near]]
            near = near[5 * np.minimum(n[near], n[p]) >= 4 * np.maximum(n[near], n[p])]
            if not len(near):
                continue
            own = code[start[p] : start[p] + n[p]]
            mine[own] = True
            both = np.add.reduceat(mine[code[_ranges(start[near], n[near])]], np.cumsum(n[near]) - n[near], dtype=np.int64)
            mine[own] = False
            near = near[9 * both >= 4 * (n[near] + n[p])]
            label[near], seen[near] = root, True
            todo += near.tolist()
            if 2 * (left := len(n) - int(seen.sum())) < live:
                kept, live = ~seen[listed], left
                posted, listed = posted[kept], listed[kept]
                first = np.searchsorted(posted, np.arange(len(common) + 1))
    return label


def _groups(nodes: DataFrame) -> DataFrame:
    """``(id, component_id)`` of the ``nid`` of ``nodes`` that shared values of ``keys``, or SimHash fingerprints (``fps``) near one another, chain together: a star for each value, not its pairs."""
    prints = materialize(nodes.select("nid", F.explode("fps").alias("fp")))
    near = materialize(rooted(materialize(prints.select("fp").distinct())))
    simhash = prints.join(near, "fp").select("nid", F.xxhash64(F.lit("simhash"), "root").alias("key"))
    rows = materialize(nodes.select("nid", F.explode("keys").alias("key")).unionByName(simhash))
    shared = rows.groupBy("key").agg(F.min("nid").alias("low"), F.max("nid").alias("high")).where("low < high").select("key", "low")
    return connected_components(rows.join(materialize(shared), "key").where("nid <> low").select(F.col("nid").alias("src"), F.col("low").alias("dst")))


def _regrouped(sets: DataFrame) -> DataFrame:
    """``sets`` with groups over ``BLOCK_SHINGLES`` parted by their rare shingles.

    Bands of few values also chain texts that only share a template. Two sets
    of 0.8 or more share one of the rarest ``n - ceil(0.8 n) + 1`` shingles of
    each, by one order for a whole group; so a group falls into the components
    of texts that share such a shingle, and no link is lost. A template is
    what is common in its group: it takes the last places of the order, and
    texts with nothing else in common fall apart. A text whose rare shingles
    are all its own has no link and goes. Work is in proportion to the
    shingles; a shingle links its texts as a star.
    """
    large = materialize(sets.groupBy("grp").agg(F.sum(F.size("shingles")).alias("n")).where(F.col("n") > BLOCK_SHINGLES).select("grp"))
    if large.isEmpty():
        return sets
    mine = sets.join(large, "grp", "left_semi")
    each = mine.select("grp", "nid", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    common = materialize(each.groupBy("grp", "s").agg(F.count("*").alias("texts")))
    place = F.row_number().over(Window.partitionBy("nid").orderBy("texts", "s"))  # a window is one text
    rare = each.join(common, ["grp", "s"]).withColumn("place", place).where("place <= n - (4 * n + 4) div 5 + 1 AND texts > 1")
    rare = materialize(rare.select("grp", "s", "nid"))
    low = rare.groupBy("grp", "s").agg(F.min("nid").alias("low"))
    comp = materialize(connected_components(rare.join(low, ["grp", "s"]).where("nid <> low").select(F.col("nid").alias("src"), F.col("low").alias("dst"))))
    parted = mine.drop("grp").join(comp, F.col("nid") == F.col("id")).select(F.col("component_id").alias("grp"), "nid", "shingles")
    return sets.join(large, "grp", "left_anti").unionByName(materialize(parted))


def _set_links(sets: DataFrame) -> DataFrame:
    """Links ``(src, dst)`` between the ``nid`` of ``sets`` (``grp, nid, shingles``) of one ``grp`` at 0.8 or more: a forest for each task.

    Small groups share tasks. A group over ``BLOCK_SHINGLES`` is cut into
    blocks that are searched alone, each with the group's ``PIVOTS``. Blocks
    grow together through these, so most of a group of near copies is one
    component after work in proportion to its size. What may be missing are
    links of rows outside that component: see ``_rest_links``.
    """
    sizes = materialize(sets.groupBy("grp").agg(F.sum(F.size("shingles")).alias("n")))
    small = sizes.where(F.col("n") <= BLOCK_SHINGLES).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(8, 2 * math.ceil(small / BLOCK_SHINGLES))
    large = materialize(sizes.where(F.col("n") > BLOCK_SHINGLES).select("grp", _blocks("n").alias("blocks")))
    shared = sets.join(large, "grp", "left_anti").select(F.lit("shared").alias("kind"), F.pmod(F.xxhash64("grp"), F.lit(tasks)).alias("grp"), F.lit(0).alias("i"), F.lit(0).alias("j"), "nid", "shingles")
    if large.isEmpty():
        return _searched(shared)
    cut = materialize(sets.join(large, "grp").select("grp", "nid", "shingles", "blocks", F.pmod(F.xxhash64("nid"), "blocks").cast("int").alias("block")))
    slot = F.pmod(F.xxhash64("nid", F.lit(1)), F.lit(PIVOTS))
    able = cut.where(F.size("shingles") <= BLOCK_SHINGLES // (2 * PIVOTS))
    pivots = materialize(able.groupBy("grp", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("nid"), "nid")).getField("nid").alias("nid")).select("nid"))
    copies = cut.join(pivots, "nid").select("grp", "nid", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "block").where("i <> block")
    alone = cut.select("grp", "nid", "shingles", F.col("block").alias("i")).unionByName(copies.drop("block"))
    first = materialize(_searched(shared.unionByName(alone.withColumns({"kind": F.lit("alone"), "j": F.lit(0)}))))
    return first.unionByName(_rest_links(cut.select("grp", "nid", "shingles"), first))


def _rest_links(cut: DataFrame, first: DataFrame) -> DataFrame:
    """The links of large groups that ``first`` may lack.

    Two rows of a group's largest component (``main``) need no further
    comparison. The other rows, the rest, are cut into blocks that meet
    pairwise, and that meet all blocks of the main component.
    """
    comp = materialize(connected_components(first))
    rooted = cut.join(comp, F.col("nid") == F.col("id"), "left").select("grp", "nid", F.coalesce("component_id", "nid").alias("root"), F.size("shingles").alias("n"))
    weights = materialize(rooted.groupBy("grp", "root").agg(F.sum("n").alias("n")))
    most = F.max(F.struct("n", "root"))
    plan = weights.groupBy("grp").agg(most.getField("root").alias("main"), _blocks(most.getField("n")).alias("mains"), _blocks(F.sum("n") - most.getField("n")).alias("rests"))
    plan = materialize(plan.where("rests > 0"))
    known = materialize(rooted.select("grp", "nid", "root").join(plan, "grp").select("nid", (F.col("root") == F.col("main")).alias("in_main"), "mains", "rests"))
    rows = cut.join(known, "nid").withColumn("own", F.pmod(F.xxhash64("nid"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int"))

    def meet(kind: str, i, j):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))

    rests, mains, own = F.sequence(F.lit(0), F.col("rests") - 1), F.sequence(F.lit(0), F.col("mains") - 1), F.col("own")
    places = F.when(F.col("in_main"), F.transform(rests, lambda r: meet("main", r, own))).otherwise(
        F.concat(F.transform(mains, lambda m: meet("main", own, m)), F.transform(rests, lambda r: meet("rest", F.least(own, r), F.greatest(own, r))))
    )
    return _searched(rows.select("grp", "nid", "shingles", F.explode(places).alias("at")).select("at.kind", "grp", "at.i", "at.j", "nid", "shingles"))


def _blocks(n):
    return F.ceil((F.col(n) if isinstance(n, str) else n) / BLOCK_SHINGLES).cast("int")


def _searched(pieces: DataFrame) -> DataFrame:
    """A forest of links for each ``(kind, grp, i, j)`` of ``pieces``, a task's share."""

    def search(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("nid")
        ids, label = g["nid"].to_numpy(np.int64), similar_links(g["shingles"].tolist())
        some = np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({"src": ids[some], "dst": ids[label[some]]})

    return pieces.groupBy("kind", "grp", "i", "j").applyInPandas(search, "src long, dst long")


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """128 bits of each shingle set, as two arrays of longs: equal sets are one text here."""
    digest = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 2**64) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
    return [pa.array(digest[:, 0]), pa.array(digest[:, 1])]


def duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, d1, d2`` of the documents that near copies with smaller ids stand for; d1 and d2 are a text's digest.

    A pair is linked when the sets of its five-word shingles have a Jaccard
    similarity of 0.8 or more, counted exactly. SimHash fingerprints within a
    few bits of one another, and MinHash bands for the pairs that these can't
    reach, put the texts into groups (see ``BANDS`` for the pairs missed), large groups are
    parted by their rare shingles; the sets of texts in a group are compared
    in ``similar_links``.
    """

    def keyed(texts: list[bytes]) -> list:
        sets = [shingle_set(t) for t in texts]
        fps = np.array([fingerprint(t, SIMHASH_WORDS) for t in texts], np.uint64)
        return [*_digests(sets), pa.array([band_keys(s).view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(fps.view(np.int64))]

    def listed(texts: list[bytes]) -> list:
        sets = [shingle_set(t) for t in texts]
        return [*_digests(sets), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]

    some, longs = docs.where("doc_id IS NOT NULL"), T.ArrayType(T.LongType())
    digest = [T.StructField("x1", T.LongType()), T.StructField("x2", T.LongType())]
    prints = materialize(map_texts(some, ["doc_id"], [*digest, T.StructField("keys", longs), T.StructField("fp", T.LongType())], keyed).withColumnsRenamed({"x1": "d1", "x2": "d2"}))
    nodes = materialize(prints.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.collect_set("fp").alias("fps")).withColumn("nid", F.monotonically_increasing_id()))
    groups = materialize(_groups(nodes)).join(nodes, F.col("id") == F.col("nid")).select(F.col("rep").alias("doc_id"), "nid", "d1", "d2", F.col("component_id").alias("grp"))
    sets = map_texts(some.select("doc_id", "text").join(groups, "doc_id"), ["grp", "nid", "d1", "d2"], [*digest, T.StructField("shingles", longs)], listed)
    # Another text under the same id isn't the one that is meant; the same row again links with itself.
    sets = materialize(sets.where("d1 = x1 AND d2 = x2").select("grp", "nid", "shingles"))
    comp = materialize(connected_components(_set_links(_regrouped(sets))))
    rooted = nodes.join(comp, F.col("nid") == F.col("id"), "left").select("d1", "d2", "rep", F.coalesce("component_id", "nid").alias("root"))
    stays = rooted.groupBy("root").agg(F.min(F.struct("rep", "d1", "d2")).alias("stays"))
    known = rooted.join(stays, "root").select("d1", "d2", "stays")
    return prints.join(known, ["d1", "d2"]).where(F.struct("doc_id", "d1", "d2") != F.col("stays")).select("doc_id", "d1", "d2").distinct()


@plain_names
def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the smallest doc_id stays, all columns as given.

    Texts that share a doc_id are documents of their own, and stay unless they
    are near copies; of rows that repeat id and text one stays, the same in
    every run. Rows with a null doc_id stay. No rows give no rows.
    """
    gone = materialize(duplicates(docs))
    twice = materialize(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    once = docs.join(twice, "doc_id", "left_anti").join(gone, "doc_id", "left_anti").select(*docs.columns)
    schema = T.StructType([T.StructField("row", docs.schema), *(T.StructField(d, T.LongType()) for d in ("d1", "d2"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            row = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            yield pa.RecordBatch.from_arrays([row, *_digests([shingle_set(t) for t in texts])], names=schema.names)

    again = docs.join(twice, "doc_id", "left_semi").select(*docs.columns).mapInArrow(run, schema).select(F.col("row.doc_id").alias("doc_id"), "d1", "d2", "row")
    again = again.join(gone, ["doc_id", "d1", "d2"], "left_anti").groupBy("doc_id", "d1", "d2").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.unionByName(again.select("row.*"))
