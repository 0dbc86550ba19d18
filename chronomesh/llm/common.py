"""What the training-data operators share: reading, shared storage, bounded Arrow slices."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null doc_id takes part as the smallest one and is returned as null again.
NULL_ID = -(2**63)

_own_dirs: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a local one, which only a local session may use."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _own_dirs.setdefault(app, "file://" + tempfile.mkdtemp(prefix="chronomesh-"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_temporary: list[list[str]] = []


def stored(df: DataFrame, name: str, result: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors.

    Within temporary() the table goes at its end; a result goes with what encloses that, if anything does. Others stay
    with the folder.
    """
    path = scratch(df.sparkSession, name)
    if len(_temporary) > result:
        _temporary[-1 - result].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What stored() writes within is deleted at the end: nothing that is returned may still read it."""
    _temporary.append([])
    try:
        yield
    finally:
        for path in _temporary.pop():
            drop_stored(spark, path)


def drop_stored(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of finished jobs before the next long one."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucket_of_id(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most about `limit` bytes of text (a longer text stands alone)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        first, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > limit:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += n + 64
        if first < batch.num_rows:
            yield batch.slice(first)
    release()


def release() -> None:
    """Give freed memory back to the system, so that a worker that is used again doesn't keep the peak of a task before."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps it
        pass
