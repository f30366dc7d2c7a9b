"""Token-ID output: Parquet list columns with chosen encoding, row groups and page indexes, and selective reads.

Rows are range-partitioned and sorted by identifier before they are encoded, so only texts are shuffled, never token
lists. Files hold ``doc_id, part, row, n_tokens, ids``; ``part`` and ``row`` give the place in the global order. The
writer sets row-group bytes, the rows of a page and the encoding (``dictionary``, or ``delta``: Parquet's version 2
writer without dictionary, which packs integers as deltas). Parquet's column and offset indexes let a reader skip pages
by ``doc_id``, and column pruning lets it read counts without token bytes.

Defined results: a null text counts as empty and becomes just the end id; null identifiers come first; rows with equal
identifiers stand side by side, in either order; an empty table writes files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import small_batches, tidied, whole_text
from strandloom.llm.tokens import word_encoder

SCHEMA = "doc_id long, part int, row long, n_tokens long, ids array<int>"


def writer_options(encoding: str = "delta", compression: str = "snappy", row_group_bytes: int = 64 << 20, page_rows: int = 2000, page_bytes: int = 1 << 20) -> dict[str, str]:
    """Options of the Parquet writer for token files.

    Ids of running text are near to incompressible beyond 16 or 17 bits each, which either encoding reaches; deltas need no
    table of values while they are written.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is 'dictionary' or 'delta'")
    return {
        "compression": compression,
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.writer.version": "v2" if encoding == "delta" else "v1",
    }


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, one value after the other, and where each value ends; nothing is copied."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if not len(ends):
        return np.zeros(0, np.uint8), ends
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends[1:] - ends[0]


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of the token files, in ascending order of identifier over partitions and within them."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, row = word_encoder(tokenizer_path).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            ids, counts = encode(*_joined(batch.column(1)), end_id)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.record_batch([batch.column(0), pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), pa.array(counts, pa.int64()), lists], schema=schema)
            row += n

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), whole_text(docs[text_col]).cast("binary").alias("text"))
    return own.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(tidied(run), SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", **layout) -> None:
    """Encode every text and write token files to ``path``; ``layout`` goes to :func:`writer_options`."""
    encoded(docs, tokenizer_path, end_id, id_col, text_col).write.options(**writer_options(**layout)).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Token files, only the columns asked for and only pages that can hold identifiers from ``first`` to ``last``."""
    found = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        found = found.filter(F.col("doc_id") >= first)
    if last is not None:
        found = found.filter(F.col("doc_id") <= last)
    return found.select(*columns) if columns else found


def layout_of(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row, read back from the files.

    ``start`` counts the ids of all rows before it. It is a running sum within each part, plus the sum of the parts
    before, of which there is one row for each partition that was written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            ids = batch.column(3)
            data, at = memoryview(ids.values.buffers()[1] or b""), ids.values.offset
            ends = ids.offsets.to_pylist()
            pairs = list(zip(ends, ends[1:], strict=False))
            crcs = [zlib.crc32(data[4 * (at + a) : 4 * (at + b)]) for a, b in pairs]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array([b - a for a, b in pairs], pa.int64()), pa.array(crcs, pa.int64())], schema=schema)

    small_batches(spark)
    found = read_tokens(spark, path, ["doc_id", "part", "row", "ids"]).mapInArrow(tidied(run), "doc_id long, part int, row long, n_tokens long, ids_crc32 long")
    sums = read_tokens(spark, path, ["part", "n_tokens"]).groupBy("part").agg(F.sum("n_tokens").alias("own"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select(F.col("part").alias("at_part"), F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("inner_start", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return placed.join(parts, F.col("part") == F.col("at_part")).select("doc_id", (F.col("base") + F.col("inner_start")).alias("start"), "n_tokens", "ids_crc32")
