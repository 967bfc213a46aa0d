"""S3: a table that arrives in chunks, as a streaming data source whose chunks have many partitions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Lock

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from framewise.session import scratch_path

#: Rows of a file, which is a partition of its chunk.
FILE_ROWS = 1 << 20
#: Typed state needs a store with column families; Spark's default one has none.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_starting = Lock()


@contextmanager
def state_store(spark: SparkSession, tasks: int | None = None) -> Iterator[None]:
    """Streams that are started within this block keep their state in RocksDB, whatever store the session names, in ``tasks`` partitions at most: each costs a store to load and commit every micro-batch.

    A stream takes the settings along when it starts, so the session gets its
    own back at once. Streams of several threads start one after the other.
    """
    with _starting:
        partitions = "spark.sql.shuffle.partitions"
        settings = STATE_STORE | ({partitions: str(min(tasks, int(spark.conf.get(partitions))))} if tasks else {})
        before = {k: spark.conf.get(k, None) for k in settings}
        try:
            for k, v in settings.items():
                spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/*", "file:///", path))


class ChunkReader(DataSourceStreamReader):
    """The offset is the number of chunks that have arrived; so a query that starts again goes on after the chunks in its own log, whatever this object remembers."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema

    def _chunks(self) -> list[str]:
        fs, root = _opened(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return sorted(f.path for f in found if f.type == pafs.FileType.Directory and f.base_name.startswith("chunk="))

    def initialOffset(self) -> dict:
        return {"chunks": 0}

    def latestOffset(self) -> dict:
        return {"chunks": len(self._chunks())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        fs, _ = _opened(self.path)
        files = (f.path for c in self._chunks()[start["chunks"] : end["chunks"]] for f in fs.get_file_info(pafs.FileSelector(c)))
        return [InputPartition(f) for f in files if f.endswith(".parquet")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.path)
        want = to_arrow_schema(self.schema)
        with fs.open_input_file(partition.value) as f:
            for batch in pq.ParquetFile(f, coerce_int96_timestamp_unit="us").iter_batches(columns=want.names):
                yield pa.RecordBatch.from_arrays([batch.column(x.name).cast(x.type) for x in want], schema=want)


class ChunkSource(DataSource):
    """``spark.readStream.format("chunks").schema(..).load(path)``: the folders ``chunk=..`` of Parquet files below a path, in the order of their names."""

    @classmethod
    def name(cls) -> str:
        return "chunks"

    def streamReader(self, schema: StructType) -> ChunkReader:
        return ChunkReader(self.options["path"], schema)


class Feed:
    """A table in chunks, of which none has arrived at first; ``arrive`` lets the next one in.

    The rows are written once. A chunk is as many files as its size asks for
    (Spark splits large chunks and joins small files), and arrives by a rename.
    """

    def __init__(self, df: DataFrame, chunk: Column) -> None:
        self.spark, self.schema = df.sparkSession, df.schema
        self.path, waiting = scratch_path(self.spark, "feed"), scratch_path(self.spark, "waiting")
        rows = df.withColumn("__chunk", chunk.cast("long"))
        rows.hint("rebalance", "__chunk").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("__chunk").parquet(waiting)
        root = self._path(waiting)
        self.fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        named = ((p.getName().partition("=")[2], p) for p in (s.getPath() for s in self.fs.listStatus(root)) if "=" in p.getName())
        self.waiting = [p for _, p in sorted((int(k), p) for k, p in named if k.lstrip("-").isdigit())]
        self.files = max((len(self.fs.listStatus(p)) for p in self.waiting), default=0)
        self.arrived, self.chunks = 0, len(self.waiting)
        self.fs.mkdirs(self._path(self.path))

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def arrive(self) -> bool:
        """Let the next chunk in; False if all have arrived."""
        if self.arrived == self.chunks:
            return False
        self.fs.rename(self.waiting[self.arrived], self._path(f"{self.path}/chunk={self.arrived:012d}"))
        self.arrived += 1
        return True

    def stream(self) -> DataFrame:
        """A source of a name of its own, so that streams side by side share no Python function: a run in which they did failed while a task read a map that came with it (OptionalDataException)."""
        name = f"chunks_{self.path.rpartition('-')[2]}"
        self.spark.dataSource.register(type("FeedSource", (ChunkSource,), {"name": classmethod(lambda cls: name)}))
        return self.spark.readStream.format(name).schema(self.schema).load(self.path)


def replay(op: Callable[..., DataFrame], *feeds: Feed, mode: str = "append", progress: list[dict] | None = None) -> DataFrame:
    """What ``op`` (of the feeds' streams) writes while the chunks arrive, a micro-batch each: in append mode final rows only, in update mode every version of every row.

    Feeds of several inputs arrive side by side. ``progress`` gets Spark's report of each batch.
    State is parted for the cores there are, or by the files of a chunk where these are more.
    """
    spark = feeds[0].spark
    stream = op(*(f.stream() for f in feeds))
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "state")
    writer = stream.writeStream.option("checkpointLocation", state).outputMode(mode)
    with state_store(spark, max(spark.sparkContext.defaultParallelism, *(f.files for f in feeds))):
        query = writer.format("parquet").option("path", out).start() if mode == "append" else writer.foreachBatch(by_batch(out)).start()
    seen = -1
    try:
        while any([f.arrive() for f in feeds]):  # a list: all of them
            query.processAllAvailable()
            for p in query.recentProgress if progress is not None else []:
                if p["batchId"] > seen:
                    seen = p["batchId"]
                    progress.append(p)
    finally:
        query.stop()
    return written_batches(spark, out, stream.schema) if mode != "append" else spark.read.schema(stream.schema).parquet(out)


def by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """An idempotent ``foreachBatch`` sink: a batch's rows are a folder with its number, so a batch that is run again replaces its own rows and no others."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def written_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``by_batch`` wrote, with the number of each row's ``batch``."""
    fields = StructType([*schema.fields]).add("batch", "long")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).parquet(path)
