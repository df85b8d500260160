"""Shared helpers: table access, materialised intermediates, checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast side may hold this many rows at most; beyond it a shuffle join is used.
BROADCAST_ROWS = 50_000
#: Rows and bytes in an Arrow batch handed to Python; a text longer than that is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch; smaller settings of the session are kept."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key)).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def together(batches, most: int):
    """Arrow batches joined while they have at most ``most`` bytes together."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def release() -> None:
    """Give memory that this Python worker no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # not this C library


def frugal(run: Callable) -> Callable:
    """``run`` over Arrow batches; when a task ends, its memory is given back.

    Workers are used again by later stages and would else keep the most they ever had.
    """

    def to_the_end(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return to_the_end


def room_for_python(spark: SparkSession) -> None:
    """Have the executors' JVMs give back heap that they do not use.

    After a stage of joins and sorts a JVM holds all the heap it may have, little of it in
    use, and the Python workers of the next stage live in the same container.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    collected = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, n, 1, n).select(collected).write.format("noop").mode("overwrite").save()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where a session names none (tests in local mode) a local folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "paperloom-shared")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, ids_only: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage and survives lost executors.  Tables of ids, whose rows are
    a few bytes, are written in four tasks for each core, not one for each partition.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    schema = df.schema
    if ids_only:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it needs to tell."""
    return df.limit(rows + 1).count() <= rows


def join_checked(left: DataFrame, right: DataFrame, on, how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts ``right`` only if its checked size is small.

    Beyond that both sides are shuffled, and adaptive execution splits skewed keys.
    """
    return left.join(F.broadcast(right) if is_small(right, rows) else right, on, how)


def fold(column: str, parts: int):
    """crc32 of an id as text, modulo ``parts``: the fold that a row is in."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def sample_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df``: the first by a hash of ``key``.

    Where there are many more, a cut-off of the hash that the count gives keeps all but
    about twice as many out of the sort, in whatever partition they are.
    """
    n = df.count()
    if n > 4 * rows:
        within = 1 << 40
        df = df.where(F.pmod(F.xxhash64(F.lit(17), key), F.lit(within)) < int(within * 2 * rows / n))
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Names for columns of our own that clash with none of ``taken``, in any case."""
    low, out = {name.lower() for name in taken}, []
    for name in wanted:
        name = f"_{name}"
        while name in low:
            name = f"_{name}"
        low.add(name)
        out.append(name)
    return out
