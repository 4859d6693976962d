"""Small helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words.
BLANK = "\\x20\\x09-\\x0D"

#: glibc's call that returns freed memory, where there is one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. In local mode (tests) one of our own where it is unset; on a cluster that is an error, as executors don't share their disks."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="specseq-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch that goes to Python. Spark's own bound, 10,000 rows or 64 MB, holds a batch of whole texts several times over in an executor and its worker.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Within it Spark plans Arrow batches of at most about BATCH_BYTES; a longer row is a batch of its own. A smaller bound of the session stays."""
    before = spark.conf.get(_BATCH)
    own = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    if 0 < own <= BATCH_BYTES:
        yield
        return
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


#: Paths that written() made, for each open settled() call.
_passing: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors. Within a settled() function it lasts as long as the call."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _passing:
        _passing[-1].append(path)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(name: str):
    """Of a function that returns a DataFrame of rows of its first argument's size: its result is written, and all tables that it wrote on the way are deleted."""

    def wrap(function):
        @functools.wraps(function)
        def run(df: DataFrame, *args, **named) -> DataFrame:
            spark, paths = df.sparkSession, []
            _passing.append(paths)
            try:
                result = function(df, *args, **named)
                path = scratch_path(spark, name)
                with small_batches(spark):
                    result.write.parquet(path)
            finally:
                _passing.pop()
                for p in paths:
                    place = spark._jvm.org.apache.hadoop.fs.Path(p)
                    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            if _passing:
                _passing[-1].append(path)
            schema = result.schema
            del result
            gc.collect()
            spark._jvm.System.gc()  # Spark drops shuffle files once nothing refers to their plans
            return spark.read.schema(schema).parquet(path)

        return run

    return wrap


def let(value: Column, body) -> Column:
    """body(value) with value computed once, as SQL functions have no local names."""
    return F.transform(F.array(value), body)[0]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: So many ids or estimates are broadcast at most; beyond that they are joined by shuffle.
MOST_BROADCAST = 1_000_000


def sized(small: DataFrame) -> DataFrame:
    """A table of few narrow columns, to be broadcast if it has at most MOST_BROADCAST rows. It is counted, so it should be a written one."""
    return F.broadcast(small) if small.count() <= MOST_BROADCAST else small


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't among the ids in the one column of ids; a null id counts as a value."""
    ids = sized(written(ids.toDF("_gone").distinct(), "ids"))
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["_gone"]), "left_anti")


def give_back() -> None:
    """Hand freed memory to the system: Python workers stay alive between tasks, and an executor's limit counts what idle ones hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def in_slices(batches, column: str = "text", most_bytes: int = 4 << 20, most_rows: int = 4096):
    """Cut Arrow batches so that a slice's column holds about most_bytes; a longer value is a slice of its own."""
    for batch in batches:
        at, n = batch.schema.get_field_index(column), batch.num_rows
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(sizes)
        start = 0
        while start < n:
            before = upto[start - 1] if start else 0
            end = min(max(int(np.searchsorted(upto, before + most_bytes, "right")), start + 1), start + most_rows, n)
            yield batch.slice(start, end - start)
            start = end
        del batch, sizes, upto
    give_back()
