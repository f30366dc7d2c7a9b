"""Mean chromosome depth from an alignment index's statistics and a sample of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aligned_lengths(alignments: DataFrame) -> DataFrame:
    """``line_no, aligned``: bases in M operations of mapped reads that have one."""
    matches = F.regexp_extract_all("cigar", F.lit("([0-9]+)M"), F.lit(1))
    total = F.aggregate(F.transform(matches, lambda m: m.cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return alignments.filter(F.col("flag").bitwiseAND(F.lit(4)) == 0).filter(F.size(matches) > 0).select("line_no", total.alias("aligned"))


def average_depth(stats: DataFrame, alignments: DataFrame, most_reads: int = 200_000) -> DataFrame:
    """``chrom, depth, n_reads, mean_length``: mapped reads times the mean aligned length, by chromosome length.

    The mean is over the first ``most_reads`` reads in order, a limit that is part of the estimate. Chromosomes shorter than
    the mean are left out.
    """
    first = aligned_lengths(alignments).orderBy("line_no").limit(most_reads)
    mean = first.agg(F.count(F.lit(1)).alias("n"), F.avg("aligned").alias("length")).first()
    length = F.lit(mean["length"]).cast("double")
    rows = stats.filter(F.col("size") >= length)
    return rows.select("chrom", (F.col("mapped") * length / F.col("size")).alias("depth"), F.lit(mean["n"]).cast("long").alias("n_reads"), length.alias("mean_length"))


def depth_lines(depths: DataFrame) -> DataFrame:
    """The depth file's lines, three decimals."""
    number = lambda c: F.format_string("%.3f", F.col(c))
    return depths.select("chrom", F.concat_ws("\t", "chrom", number("depth"), F.col("n_reads").cast("string"), number("mean_length")).alias("value"))
