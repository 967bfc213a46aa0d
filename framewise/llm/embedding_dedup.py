"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosine check, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import materialize
from framewise.llm.graph import connected_components, local_components

SEED = 17
#: Unrelated vectors of a label that a bucket is to hold. Larger buckets need fewer bits and tables, so fewer copies of each vector are shuffled; smaller ones fewer comparisons.
BUCKET = 1024
#: Vectors of one bucket that a task compares with one another; larger buckets are cut into pairs of blocks.
BLOCK = 2048
#: Chance at most that a pair just at the threshold shares no bucket in any table.
MISS = 1e-5
BITS = (2, 40)


def table_plan(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for ``n`` vectors of a label: buckets hold some ``BUCKET`` unrelated vectors, and a pair at the threshold is missed with chance ``miss``."""
    bits = min(BITS[1], max(BITS[0], math.ceil(math.log2(max(n, 1) / BUCKET))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def _keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    planes = np.random.default_rng(SEED).standard_normal((x.shape[1], bits * tables))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length, without a Python object a row."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Link vectors of equal label whose cosine is ``threshold`` or more.

    vectors: ``vec_id``, ``embedding``, ``label``; other columns are ignored.
    Returns ``vec_id``, ``n_links`` (other vectors linked directly),
    ``component_id`` (smallest id reachable) and ``kept``, one row per row given.

    Equal embeddings of a label form a class and are compared once. Rows that
    repeat id, label and embedding are one vector; an id with several vectors
    has a row, and links, for each. A label or an embedding that is null, zero,
    or holds null or non-finite components links with nothing; a null id has a
    null component and isn't kept. Vectors of different lengths never link. No
    rows give no rows.

    Every vector goes to one bucket a table; how many bits and tables follows
    from the number of classes of its label. A pair is counted in the first
    table whose bucket it shares, so what leaves a bucket is one count and one
    link a vector, not its pairs. Buckets over ``BLOCK`` are cut into blocks
    which meet pairwise in separate tasks: the number of links asked for needs
    these comparisons, and no task holds more than two blocks.
    """
    rows = vectors.select("vec_id", F.col("label").alias("label"), F.col("embedding").alias("e"))
    fine = (
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("e").isNotNull()
        & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("e", lambda x: x != 0)
    )
    rows = rows.withColumn("ok", F.coalesce(fine, F.lit(False)))
    # A digest of its numbers (their shortest decimals tell any two apart) stands for an embedding in joins.
    valid = rows.where("ok").select("vec_id", "label", F.unhex(F.md5(F.col("e").cast("string"))).alias("h"), "e")
    once = valid.groupBy("label", "h", "vec_id").agg(F.any_value("e").alias("e"))
    classes = once.groupBy("label", "h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("e").alias("e"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    counts, links = _bucket_links(classes, threshold)
    comp = materialize(connected_components(links))
    made = materialize(
        classes.select("label", "h", "rep", "n", "cid")
        .join(counts, "cid", "left")
        .join(comp, F.col("cid") == F.col("id"), "left")
        .select("label", "h", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "cid").alias("root"))
    )
    named = made.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = valid.select("vec_id", "label", "h").join(made.join(named, "root"), ["label", "h"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _bucket_links(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(``cid, links``, ``src, dst``): links counted for each class, and a forest of them for each bucket."""
    sizes = materialize(classes.groupBy("label").agg(F.count("*").alias("of_label")))
    plans = F.create_map(*(F.lit(x) for b in range(BITS[0], BITS[1] + 1) for x in (b, table_plan(BUCKET << b, threshold)[1])))
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("of_label") / BUCKET)), F.lit(BITS[0])), F.lit(BITS[1])).cast("int")
    planned = classes.join(sizes, "label").select("label", "cid", "n", "e", bits.alias("bits")).withColumn("tables", plans[F.col("bits")])
    label, vec = classes.schema["label"].dataType.simpleString(), classes.schema["e"].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch], with_vectors: bool) -> Iterator[pa.RecordBatch]:
        """The rows once a table, their vectors as they came."""
        for b in batches:
            plan = np.stack([pc.list_value_length(b.column("e")).to_numpy(), b.column("bits").to_numpy(), b.column("tables").to_numpy()], axis=1)
            for dim, bits, tables in np.unique(plan, axis=0).tolist():
                part = b.take(pa.array(np.flatnonzero((plan == (dim, bits, tables)).all(axis=1))))
                keys = _keys(_unit(_matrix(part.column("e"))), bits, tables)
                same = pa.array(np.full(len(part), dim, np.int32))
                for t in range(tables):
                    columns = [part.column("label"), same, pa.array(np.full(len(part), t, np.int32)), pa.array(keys[:, t])]
                    yield pa.RecordBatch.from_arrays([*columns, *(part.column(c) for c in names[4:])] if with_vectors else columns, names=names if with_vectors else at)

    at = ["label", "dim", "t", "bucket"]
    names = [*at, "cid", "n", "bits", "tables", "e"]
    key = f"label {label}, dim int, t int, bucket long"
    rows = planned.mapInArrow(lambda batches: keyed(batches, True), f"{key}, cid long, n long, bits int, tables int, e {vec}")
    # Buckets that have to be cut: few, as each holds over BLOCK rows; their table's written size tells Spark how to join it.
    counts = planned.mapInArrow(lambda batches: keyed(batches, False), key).groupBy(*at).count()
    large = materialize(counts.where(F.col("count") > BLOCK).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count"))
    pieces = (
        rows.join(large, at, "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("mine", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*at, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "cid", "n", "bits", "tables", "e")
    )

    def compare(g: pa.Table) -> pa.Table:
        x = _unit(_matrix(g.column("e").combine_chunks()))
        i, j, t, bits, tables = (g.column(c)[0].as_py() for c in ("i", "j", "t", "bits", "tables"))
        own, cid, n = (g.column(c).to_numpy() for c in ("mine", "cid", "n"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        close = x[left] @ x[right].T >= threshold
        if i == j:
            close = np.triu(close, 1)
        a, b = np.nonzero(close)
        a, b = left[a], right[b]
        links = np.zeros(len(x), np.int64)
        if len(a):
            keys = _keys(x, bits, tables)
            for s in range(0, len(a), 65536):
                p, q = a[s : s + 65536], b[s : s + 65536]
                first = (keys[p] == keys[q]).argmax(axis=1) == t
                np.add.at(links, p[first], n[q[first]])
                np.add.at(links, q[first], n[p[first]])
        roots = local_components(len(x), a, b)
        some = np.flatnonzero((links > 0) | (roots != np.arange(len(x))))
        return pa.table({"cid": cid[some], "links": links[some], "root": cid[roots[some]]})

    found = materialize(pieces.groupBy(*at, "i", "j").applyInArrow(compare, "cid long, links long, root long"))
    return found.groupBy("cid").agg(F.sum("links").alias("links")), found.select(F.col("cid").alias("src"), F.col("root").alias("dst"))
