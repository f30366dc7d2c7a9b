"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Arrow batches hold at most this many rows, so that a run of very long texts stays in a worker's memory.
BATCH_ROWS = 1000


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def whole_text(text: Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows; a lower limit that the session already has stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local sessions without it a fresh folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


class _Written(threading.local):
    """Tables that :func:`stored` has written in a thread and nothing has deleted yet."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_written = _Written()


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage is cut, and nothing is computed twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandloom/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that :func:`stored` has written meanwhile, but for the last one: what was read from them must be done by then."""
    first = len(_written.paths)
    yield
    old = _written.paths[first:-1]
    del _written.paths[first:-1]
    for path in old:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which at its end gives freed memory back: workers live on, and the next task needs none of what this one held."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return whole


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = BATCH_ROWS, most_bytes: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches, cut by rows and by the bytes of their binary, text and array values."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(value.nbytes if isinstance(value, np.ndarray) else len(value) for value in row if isinstance(value, bytes | str | np.ndarray))
        if len(held) >= size or weight >= most_bytes:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


#: Bits of the map that keeps unmarked documents out of a shuffle.
MAP_BITS = 26


def marked_only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, hashed) may be in ``keys``: a filter by a bit map, broadcast as at most 2**20 rows."""
    bit = F.pmod(F.xxhash64("doc_id", "hashed"), F.lit(1 << MAP_BITS))
    bits = keys.select(bit.alias("bit")).select(F.shiftright("bit", 6).alias("block"), F.expr("shiftleft(1L, cast(bit & 63 AS int))").alias("mask"))
    blocks = F.broadcast(bits.groupBy("block").agg(F.bit_or("mask").alias("mask")))
    own = docs.withColumn("own_bit", bit).withColumn("own_block", F.shiftright("own_bit", 6))
    met = own.join(blocks, F.col("own_block") == F.col("block"))
    return met.filter("shiftright(mask, cast(own_bit & 63 AS int)) & 1L = 1L").select(*docs.columns)
