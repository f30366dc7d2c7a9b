"""Variant files: reading lines, header and records, regions of a file, and writing.

``line_no`` orders a file's lines: the place of the split in the file, then the place in the split. It is a struct from
:func:`read_lines` and may be any orderable column in DataFrames from elsewhere.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import records as R
from strandloom.plans.storage import small_methods

COLUMNS = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample"]
#: Words of a line; the last one keeps the rest.
MOST_WORDS = 50
#: Columns that a line needs at least, and at most (0: any number), by kind of tool.
WIDTHS = {"block": (8, 10), "check": (8, 0), "region": (10, 10), "single": (10, 10), "multi": (10, 0)}


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, line_no, value`` of text files, gzip by extension (not splittable)."""
    text = spark.read.text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")).alias("line_no"), "value")


def header_lines(lines: DataFrame) -> list[str]:
    """The header, in order; headers are small."""
    return [row["value"] for row in lines.filter(F.col("value").startswith("#")).orderBy("line_no").select("value").collect()]


def sample_name(header: list[str]) -> str:
    """The tenth column of the last header line, or UNKNOWN."""
    for line in header:
        if line.startswith("#CHROM"):
            words = line.split("\t")
            return words[9] if len(words) > 9 else "UNKNOWN"
    return "UNKNOWN"


def sample_names(header: list[str]) -> list[str]:
    return next((line.split("\t")[9:] for line in header if line.startswith("#CHROM")), [])


def parse_records(lines: DataFrame, tool: str = "block", keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """Records of lines ``line_no, value``; a malformed line is an error that names it.

    A short SAMPLE is padded with ``.``, as trailing fields may be dropped; a long one is an error, as is an empty REF,
    an unreadable POS or a line with too few (or, by ``tool``, too many) columns. Empty lines are skipped.
    """
    small_methods(lines.sparkSession)
    least, most = WIDTHS[tool]
    body = lines.filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    words = body.withColumn("word", F.split("value", "\t", MOST_WORDS)).withColumn("n_word", F.size("word"))

    def word(k: int) -> Column:
        return F.get("word", F.lit(k))

    words = words.withColumns({"_pos": R.parse_unsigned(word(1)), "_format": R.listed(word(8), ":"), "_sample": R.listed(word(9), ":")})
    format, sample, pos = F.col("_format"), F.col("_sample"), F.col("_pos")
    short = F.size(format) - F.size(sample)
    wrong = (
        F.when(F.col("n_word") < least, F.lit("too few fields"))
        .when((F.col("n_word") > most) if most else F.lit(False), F.lit("too many fields"))
        .when(pos.isNull(), F.lit("unreadable position"))
        .when(word(3) == "", F.lit("empty reference field"))
        .when(short < 0, F.lit("FORMAT and SAMPLE do not agree"))
    )
    # never null, so that no join asks for it, which would read the line twice
    chrom = F.coalesce(F.when(wrong.isNull(), word(0)).otherwise(F.raise_error(F.concat(wrong, F.lit(" in record: "), F.col("value")))), F.lit(""))
    kept = [c for c in keep if c in lines.columns]
    return words.select(
        *kept,
        "line_no",
        chrom.alias("chrom"),
        pos.alias("pos"),
        word(2).alias("id"),
        word(3).alias("ref"),
        R.listed(word(4), ",").alias("alt"),
        word(5).alias("qual"),
        R.listed(word(6), ";").alias("filter"),
        R.listed(word(7), ";").alias("info"),
        format.alias("format"),
        F.when(short > 0, F.concat(sample, F.array_repeat(F.lit("."), short))).otherwise(sample).alias("sample"),
        "n_word",
        F.col("value").alias("raw"),
    )


def read_vcf(spark: SparkSession, path: str | list[str], tool: str = "block") -> tuple[list[str], DataFrame]:
    """Header lines and records of one file, or of files with the same header."""
    lines = read_lines(spark, path)
    return header_lines(lines), parse_records(lines, tool)


def read_samples(spark: SparkSession, paths: list[str]) -> tuple[list[list[str]], DataFrame]:
    """Headers and records of several files as one DataFrame with ``sample_id``, the file's place in ``paths``."""
    headers, parts = [], []
    for k, path in enumerate(paths):
        header, found = read_vcf(spark, path, "multi")
        headers.append(header)
        parts.append(found.withColumn("sample_id", F.lit(k)))
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return headers, together


def parse_region(region: str) -> tuple[str, int | None, int | None]:
    """``chrom``, ``chrom:begin`` or ``chrom:begin-end`` (1-based, closed; commas allowed) as its parts."""
    match = re.fullmatch(r"(.+?)(?::([0-9,]+)(?:-([0-9,]+)?)?)?", region)
    if not match or not region:
        raise ValueError(f"can't parse region {region!r}")
    begin, end = (int(part.replace(",", "")) if part else None for part in match.group(2, 3))
    if begin is not None and (begin < 1 or (end is not None and end < begin)):
        raise ValueError(f"can't parse region {region!r}")
    return match[1], begin, end


def in_region(found: DataFrame, region: str) -> DataFrame:
    """Records that overlap a region; on Parquet the plain conditions on ``chrom`` and ``pos`` are pushed to the scan."""
    chrom, begin, end = parse_region(region)
    found = found.filter(F.col("chrom") == chrom)
    if end is not None:
        found = found.filter(F.col("pos") <= end)
    if begin is not None:
        found = found.filter((F.col("pos") >= begin) | (F.greatest(R.record_end(), F.col("pos") + F.length("ref") - 1) >= begin))
    return found


def chromosomes(found: DataFrame) -> DataFrame:
    return found.select("chrom").distinct()


def check_fresh(data: str, index: str) -> None:
    """An index file must be there and no older than its data; remote paths are not checked."""
    if data.startswith(("ftp://", "http://", "https://")):
        return
    if not os.path.exists(index):
        raise FileNotFoundError(f"no index {index}")
    if os.path.getmtime(index) < os.path.getmtime(data):
        raise ValueError(f"index {index} is older than {data}")


def to_parquet(found: DataFrame, path: str) -> None:
    """Records sorted by place and partitioned by chromosome, for pruning and page-level skipping in later reads."""
    found.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").write.partitionBy("chrom").parquet(path)


def line_of(columns: dict[str, Column] | None = None) -> Column:
    """A record's line: ten columns, ``.`` for what is empty."""
    c = {name: F.col(name) for name in COLUMNS} | (columns or {})
    parts = [c["chrom"], c["pos"].cast("string"), c["id"], c["ref"], R.unlisted(c["alt"], ","), F.coalesce(c["qual"], F.lit(".")), R.unlisted(c["filter"], ";"), R.unlisted(c["info"], ";"), R.unlisted(c["format"], ":"), R.unlisted(c["sample"], ":")]
    return F.concat_ws("\t", *parts)


def write_lines(lines: DataFrame, path: str, order: list[str], header: list[str] | None = None) -> None:
    """Text in global order, the header in the first file; ``lines`` has ``value`` and the columns of ``order``."""
    body = lines.select(F.lit(1).alias("part"), F.struct(*order).alias("at"), F.lit(0).alias("k"), "value")
    if header:
        rows = lines.sparkSession.createDataFrame(list(enumerate(header)), "k int, value string")
        body = body.unionByName(rows.select(F.lit(0).alias("part"), F.lit(None).cast(body.schema["at"].dataType).alias("at"), "k", "value"))
    body.orderBy("part", "at", "k").select("value").write.text(path)


def write_vcf(found: DataFrame, path: str, header: list[str] | None = None, order: tuple[str, ...] = ("line_no",)) -> None:
    write_lines(found.select(*order, line_of().alias("value")), path, list(order), header)


def write_raw(found: DataFrame, path: str, header: list[str] | None = None, order: tuple[str, ...] = ("line_no",)) -> None:
    """The records' own lines, unchanged."""
    write_lines(found.select(*order, F.col("raw").alias("value")), path, list(order), header)
