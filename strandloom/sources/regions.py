"""Interval files, chromosome depths and alignment summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import records as R


def parse_bed(lines: DataFrame) -> DataFrame:
    """``chrom, begin, end`` (0-based, half-open) of lines ``value``; further columns are ignored.

    Lines of ``track``, ``browser`` and comments are skipped, empty ones too; an unreadable line or an end before its
    begin is an error. An interval of length zero is an interval.
    """
    body = lines.filter(~F.col("value").rlike(r"^(track|browser|#)|^\s*$"))
    word = F.split(F.trim("value"), r"\s+")
    begin, end = R.parse_unsigned(F.get(word, F.lit(1))), R.parse_unsigned(F.get(word, F.lit(2)))
    good = begin.isNotNull() & end.isNotNull() & (end >= begin)
    chrom = F.when(good, F.get(word, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("invalid interval: "), F.col("value"))))
    return body.select(chrom.alias("chrom"), begin.alias("begin"), end.alias("end"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return parse_bed(spark.read.text(path))


def write_bed(regions: DataFrame, path: str, order: tuple[str, ...] = ("chrom", "begin", "end")) -> None:
    regions.orderBy(*order).select("chrom", "begin", "end").write.csv(path, sep="\t")


def parse_chrom_depth(lines: DataFrame) -> DataFrame:
    """``chrom, depth`` of tab-separated lines ``line_no, value``; a later line of a chromosome wins, further columns are ignored."""
    word = F.split("value", "\t")
    depth = R.parse_double(F.get(word, F.lit(1)))
    good = R.required(depth, "a depth", "value")
    rows = lines.filter("value <> ''").select("line_no", F.get(word, F.lit(0)).alias("chrom"), good.alias("depth"))
    return rows.groupBy("chrom").agg(F.max_by("depth", "line_no").alias("depth"))


def read_chrom_depth(spark: SparkSession, path: str) -> DataFrame:
    from strandloom.sources.vcf import read_lines

    return parse_chrom_depth(read_lines(spark, path))


def parse_index_stats(lines: DataFrame) -> DataFrame:
    """``chrom, size, mapped`` of an alignment index's statistics; the line of unplaced reads (``*``) is skipped."""
    word = F.split("value", "\t")
    return lines.select(F.get(word, F.lit(0)).alias("chrom"), R.parse_long(F.get(word, F.lit(1))).alias("size"), R.parse_long(F.get(word, F.lit(2))).alias("mapped")).filter("chrom <> '*'")


def parse_alignments(lines: DataFrame) -> DataFrame:
    """``line_no, flag, cigar`` of tab-separated alignment lines."""
    word = F.split("value", "\t", 7)
    return lines.filter(~F.col("value").startswith("@")).select("line_no", R.parse_int(F.get(word, F.lit(1))).alias("flag"), F.get(word, F.lit(5)).alias("cigar"))
