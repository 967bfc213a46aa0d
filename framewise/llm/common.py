"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.session import delete, scratch_path

#: Records and bytes in an Arrow batch at most (a single longer text is a batch of its own).
ARROW_ROWS, ARROW_BYTES = 256, 8 << 20


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Lineage is cut, lost executors cost only the rows in flight, and the next
    join knows the true size of the table. The files go when they are released
    or the driver ends.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files behind a materialized table that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


#: Bytes of a written table up to which ``if_small`` has it broadcast.
SMALL = 16 << 20


def if_small(written: DataFrame) -> DataFrame:
    """A materialized table, to be broadcast if its files have ``SMALL`` bytes at most; else Spark joins as it finds best, so no text is shuffled for a few rows and no large table broadcast."""
    size = int(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(written) if size <= SMALL else written


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of whole texts to ``ARROW_ROWS`` records and ``ARROW_BYTES`` bytes in this session.

    The settings stay, as frames returned to the caller are planned later; only ever lowered, never raised.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


#: Columns of documents that operators know by name.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def plain(docs: DataFrame) -> DataFrame:
    """``docs`` with names by place for all columns but the ``KNOWN`` ones, so that these are never ambiguous."""
    return docs.toDF(*(c if c in KNOWN else f"__extra_{i}" for i, c in enumerate(docs.columns)))


def plain_names(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function that gives back the columns of its first argument may have any further columns there: with dots, or names that differ in case only.

    Columns are told apart by place while it runs, and get their names back at the end.
    """

    @wraps(stage)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        return stage(plain(docs), *args, **options).toDF(*docs.columns)

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_texts(df: DataFrame, columns: list[str], fields: list[T.StructField], fn: Callable[[list[bytes]], list], text: str = "text") -> DataFrame:
    """Keep ``columns`` and add ``fields``, computed from whole texts as UTF-8 bytes (null: empty), batch by batch."""
    small_batches(df.sparkSession)
    rows = df.select(*columns, F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8").alias("__text"))
    schema = T.StructType([*(rows.schema[c] for c in columns), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(c) for c in columns]
            made = fn(batch.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([*kept, *(x if isinstance(x, pa.Array) else pa.array(x) for x in made)], names=schema.names)

    return rows.mapInArrow(run, schema)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without a copy (32- or 64-bit offsets)."""
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[offs[0] : offs[-1]], offs - offs[0]
