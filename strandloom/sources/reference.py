"""Reference sequences as chunks: ``chrom, chrom_idx, chunk, start, seq``, ``start`` 0-based, and lookups by equi-join."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from strandloom.functions import records as R

CHUNK = 1 << 13
#: Characters that a lookup of one base walks over at most.
PIECE = 1 << 6
SCHEMA = "chrom string, chrom_idx long, chunk long, start long, seq string"


def read_fasta(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """Chunks of a FASTA file's sequences, in raw case; ``chrom_idx`` is the order in the file.

    Lines get their contig from the last name line before them, and their offset from the lengths of the contig's lines
    before them: sums over blocks of the file, then within each block, so that no task holds a contig.
    """
    text = spark.read.text(path).filter("value <> ''")
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.rtrim("value").alias("value"))
    lines = lines.withColumns({"name": F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>\s*(\S+)", 1)), "size": F.when(F.col("value").startswith(">"), 0).otherwise(F.length("value")).cast("long")})
    group = F.struct("block", F.floor(F.col("row") / 4096).alias("part"))
    lines = lines.withColumn("at", group)
    own = Window.partitionBy("file", "at").orderBy("row")
    total = lines.groupBy("file", "at").agg(F.sum("size").alias("sum"), F.max_by(F.when(F.col("name").isNotNull(), F.struct("row", "name")), F.when(F.col("name").isNotNull(), F.col("row"))).alias("last"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    carried = total.select("file", "at", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum_before"), F.last("last", ignorenulls=True).over(before).alias("last_before"))
    found = lines.join(carried, ["file", "at"]).withColumns(
        {
            "offset": F.col("sum_before") + F.sum("size").over(own) - F.col("size"),
            "contig": F.coalesce(F.last(F.when(F.col("name").isNotNull(), F.struct("row", "name")), ignorenulls=True).over(own), F.col("last_before")),
        }
    )
    starts = found.filter("name IS NOT NULL").select(F.col("file").alias("f"), F.col("contig").alias("c"), F.col("offset").alias("base"))
    order = starts.withColumn("chrom_idx", F.row_number().over(Window.partitionBy("f").orderBy("base", "c")).cast("long") - 1)
    placed = found.filter("name IS NULL AND contig IS NOT NULL").join(order, (F.col("file") == F.col("f")) & (F.col("contig") == F.col("c")))
    placed = placed.select(F.col("contig.name").alias("chrom"), "chrom_idx", (F.col("offset") - F.col("base")).alias("start"), F.col("value").alias("seq"))
    return rechunked(placed, chunk)


def rechunked(parts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Sequence parts ``chrom, chrom_idx, start, seq`` of any lengths as chunks of one length."""
    first, last = F.floor(F.col("start") / chunk), F.floor((F.col("start") + F.length("seq") - 1) / chunk)
    cut = parts.filter("seq <> ''").withColumn("chunk", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("start"), F.col("chunk") * chunk)
    piece = F.substr("seq", (low - F.col("start") + 1).cast("int"), ((F.col("chunk") + 1) * chunk - low).cast("int"))
    cut = cut.select("chrom", "chrom_idx", "chunk", low.alias("low"), piece.alias("piece"))
    joined = cut.groupBy("chrom", "chrom_idx", "chunk").agg(F.array_sort(F.collect_list(F.struct("low", "piece"))).alias("pieces"))
    return joined.select("chrom", "chrom_idx", "chunk", F.get("pieces", F.lit(0))["low"].alias("start"), F.array_join(F.col("pieces.piece"), "").alias("seq"))


def from_sequences(spark: SparkSession, sequences: dict[str, str], chunk: int = CHUNK) -> DataFrame:
    """Chunks of short sequences given in memory."""
    rows = [(name, k, 0, seq) for k, (name, seq) in enumerate(sequences.items())]
    return rechunked(spark.createDataFrame(rows, "chrom string, chrom_idx long, start long, seq string"), chunk)


def standardized(reference: DataFrame) -> DataFrame:
    """The reference in upper case with ambiguity codes as N; an error for characters that are no base."""
    return reference.withColumn("seq", R.standardize_reference("seq"))


def contigs(reference: DataFrame) -> DataFrame:
    """``chrom, chrom_idx, size, known``: length, and length without N, in file order by ``chrom_idx``."""
    known = F.length(F.regexp_replace(F.upper("seq"), "[^ACGTU]", ""))
    return reference.groupBy("chrom", "chrom_idx").agg(F.sum(F.length("seq")).cast("long").alias("size"), F.sum(known).cast("long").alias("known"))


def chromosomes(reference: DataFrame) -> list[str]:
    """Contig names in file order; a genome's contigs are few."""
    return [row["chrom"] for row in reference.select("chrom", "chrom_idx").distinct().orderBy("chrom_idx").collect()]


def known_size(reference: DataFrame, region: tuple[str, int | None, int | None] | None = None) -> DataFrame:
    """One row ``size, known``, of the whole reference or of a region (1-based, closed)."""
    part = reference
    if region:
        chrom, begin, end = region
        low, high = (begin or 1) - 1, end
        part = part.filter(F.col("chrom") == chrom).filter(F.col("start") + F.length("seq") > low)
        part = part.filter(F.col("start") < high) if high is not None else part
        skip = F.greatest(F.lit(0), F.lit(low) - F.col("start"))
        take = F.length("seq") - skip if high is None else F.least(F.col("start") + F.length("seq"), F.lit(high)) - F.col("start") - skip
        part = part.withColumn("seq", F.substr("seq", (skip + 1).cast("int"), take.cast("int")))
    known = F.length(F.regexp_replace(F.upper("seq"), "[^ACGTU]", ""))
    return part.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("size"), F.coalesce(F.sum(known), F.lit(0)).cast("long").alias("known"))


def with_base(rows: DataFrame, reference: DataFrame, chrom: str = "chrom", pos: str = "pos", name: str = "ref_base", chunk: int = CHUNK) -> DataFrame:
    """``rows`` with the reference base at a 1-based position, N outside the reference.

    An equi-join on chromosome and chunk number: the planner broadcasts a small genome and shuffles by chunk otherwise. A text's
    substring walks over all characters before it, so a chunk is an array of short pieces, of which a lookup walks over one.
    """
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / PIECE).cast("int")), lambda k: F.substr(F.col("seq"), k * PIECE + 1, F.lit(PIECE)))
    ref = reference.select(F.col("chrom").alias("_rc"), F.col("chunk").alias("_rk"), F.col("start").alias("_rs"), pieces.alias("_rp"))
    at = F.floor((F.col(pos) - 1) / chunk)
    joined = rows.join(ref, (F.col(chrom) == F.col("_rc")) & (at == F.col("_rk")), "left")
    offset = (F.col(pos) - F.col("_rs") - 1).cast("int")
    base = F.substr(F.get("_rp", F.floor(offset / PIECE).cast("int")), F.pmod(offset, F.lit(PIECE)) + 1, F.lit(1))
    return joined.withColumn(name, F.when(F.col(pos) < 1, F.lit("N")).otherwise(F.coalesce(F.nullif(base, F.lit("")), F.lit("N")))).drop("_rc", "_rk", "_rs", "_rp")


def with_slice(rows: DataFrame, reference: DataFrame, key: list[str], length: Column, chrom: str = "chrom", pos: str = "pos", name: str = "ref_slice", chunk: int = CHUNK) -> DataFrame:
    """``rows`` with the reference from a position on; shorter at a contig's end, null if the contig or the place is missing."""
    ref = reference.select(F.col("chrom").alias("_rc"), F.col("chunk").alias("_rk"), F.col("start").alias("_rs"), F.col("seq").alias("_rq"))
    sized = rows.withColumn("_n", length)
    first, last = F.floor((F.col(pos) - 1) / chunk), F.floor((F.col(pos) - 2 + F.greatest("_n", F.lit(1))) / chunk)
    # nearly all rows lie in one chunk, which one join gives
    inside = F.coalesce(first == last, F.lit(True))
    one = sized.filter(inside).join(ref, (F.col(chrom) == F.col("_rc")) & (first == F.col("_rk")), "left")
    whole = F.substr("_rq", (F.col(pos) - F.col("_rs")).cast("int"), F.col("_n").cast("int"))
    one = one.withColumn(name, F.when((F.col(pos) >= 1) & (whole != ""), whole)).drop("_n", "_rc", "_rk", "_rs", "_rq")
    sized = sized.filter(~inside)
    rows = sized.drop("_n")
    spread = sized.withColumn("_k", F.explode(F.sequence(F.floor((F.col(pos) - 1) / chunk), F.floor((F.col(pos) - 2 + F.greatest("_n", F.lit(1))) / chunk))))
    joined = spread.join(ref, (F.col(chrom) == F.col("_rc")) & (F.col("_k") == F.col("_rk")), "left")
    low = F.greatest(F.col(pos) - 1, F.col("_rs"))
    piece = F.substr("_rq", (low - F.col("_rs") + 1).cast("int"), (F.col(pos) - 1 + F.col("_n") - low).cast("int"))
    pieces = joined.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("_rq").isNotNull() & (piece != ""), F.struct(F.col("_k"), piece.alias("p"))))).alias("_p"))
    pieces = pieces.withColumnsRenamed({k: f"_{k}" for k in key}).withColumn(name, F.when(F.size("_p") > 0, F.array_join(F.col("_p.p"), ""))).drop("_p")
    same = None
    for k in key:
        each = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = each if same is None else same & each
    return one.unionByName(rows.join(pieces, same, "left").drop(*[f"_{k}" for k in key]))


def write_fasta(reference: DataFrame, path: str, width: int = 60) -> None:
    """FASTA text in contig order. Chunks whose length is a multiple of ``width`` keep lines whole."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str] = []
            for chrom, start, seq in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                out += [f">{chrom}"] if start == 0 else []
                out += [seq[k : k + width] for k in range(0, len(seq), width)]
            yield pa.record_batch([pa.array(out)], names=["value"])

    reference.orderBy("chrom_idx", "start").select("chrom", "start", "seq").mapInArrow(lines, "value string").write.text(path)
