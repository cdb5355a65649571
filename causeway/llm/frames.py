"""Small helpers every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder (spark.checkpoint.dir), which all executors share.

    One is set only where a session on one machine has none, as in tests; on a
    cluster a folder of the driver's would be no shared one, so that is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of df in the shared folder; for small rows, as its files are not compressed."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again; for whole texts."""
    return stored(df)[0]


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """As written(), with the table's path, for forget()."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder on which nothing depends that is still to be computed."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done with.

    It does so when the driver's collector finds them unused, which a driver with a large
    heap may do late: rounds of small jobs over many partitions would fill the executors' disks meanwhile.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Hand what the worker has freed back to the system: idle workers stay for a while beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that releases its memory when it is through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int, int]:
    """(id, text, row_key, block) of every row, the number of blocks, and all texts' bytes.

    A block is a hash class of rows whose texts add up to about block_bytes; a
    longer text makes a longer block. Equal rows share a block. Null texts count
    as empty.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    size, count = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    size = int(size or 0)
    n = max(1, math.ceil(size / block_bytes), math.ceil(count / 50_000))
    key = F.xxhash64("doc_id", "text")
    return rows.withColumn("row_key", key).withColumn("block", F.pmod(F.xxhash64("row_key"), F.lit(n)).cast("int")), n, size


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of text each, whatever the batch size."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        begin = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += int(n) + 16
        if begin < len(sizes):
            yield batch.slice(begin)


def texts_of(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
