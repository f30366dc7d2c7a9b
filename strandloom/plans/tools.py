"""The tools from files to files: each reads, applies operators, and writes, without holding data on the driver."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import blocks, concordance, depth, intervals, merge
from strandloom.operators.filters import BlockOptions
from strandloom.operators.sites import CallOptions
from strandloom.sources import header as H
from strandloom.sources import reference as ref
from strandloom.sources import regions, vcf

VERSION = "0.1"


def _write(found: DataFrame, out: str, head: list[str], order: tuple[str, ...] = ("line_no", "piece")) -> None:
    vcf.write_vcf(found, out, head, order)


def gatk_to_gvcf(spark: SparkSession, source: str, out: str, options: BlockOptions = BlockOptions(), chrom_depth: str | None = None, stats: str | None = None, skip_header: bool = False, command: str | None = None) -> None:
    head, records = vcf.read_vcf(spark, source, "block")
    depths = regions.read_chrom_depth(spark, chrom_depth) if chrom_depth else None
    known = {row["chrom"]: row["depth"] for row in depths.collect()} if depths is not None else None
    found, summary = blocks.block_vcf(records, options, depths)
    _write(found, out, H.edited(head, H.block_lines(options, known), H.DROPPED, VERSION, command, skip_header), ("line_no",))
    if stats:
        row = blocks.block_stats(summary)
        lines = row.select(F.explode(F.array(*[F.concat(F.lit(f"{name}: "), F.coalesce(F.col(name).cast("string"), F.lit("nan"))) for name in row.columns])).alias("value"))
        lines.write.text(stats)


def region_tool(spark: SparkSession, kind: str, source: str, bed: str, fasta: str, out: str, command: str | None = None, **options: bool) -> None:
    """``break_blocks``, ``remove_region`` or ``set_haploid_region``."""
    head, records = vcf.read_vcf(spark, source, "region")
    apply = {"break_blocks": intervals.break_blocks, "remove_region": intervals.remove_region, "set_haploid_region": intervals.set_haploid}[kind]
    found = apply(records, regions.read_bed(spark, bed), ref.read_fasta(spark, fasta), **options)
    added = H.haploid_lines() if kind == "set_haploid_region" else []
    _write(found.withColumn("at", F.col("pos")), out, H.edited(head, added, (), VERSION, command), ("line_no", "piece", "at"))


def extract_variants(spark: SparkSession, source: str, out: str, invert: bool = False, skip_header: bool = False) -> None:
    head, records = vcf.read_vcf(spark, source, "single")
    vcf.write_raw(intervals.extract_variants(records, invert), out, [] if skip_header else head)


def called_regions(spark: SparkSession, source: str, out: str) -> None:
    _, records = vcf.read_vcf(spark, source, "single")
    regions.write_bed(intervals.called_regions(records), out)


def check_reference(spark: SparkSession, source: str, fasta: str) -> None:
    _, records = vcf.read_vcf(spark, source, "check")
    intervals.check_reference(records, ref.read_fasta(spark, fasta))


def merge_variants(spark: SparkSession, sources: list[str], fasta: str, out: str, options: CallOptions = CallOptions(), region: str | None = None, exclude: list[str] | None = None, drop_overlaps: bool = False) -> None:
    """Chromosomes come in the reference's order; without any locus the file is empty, its header included."""
    heads, records = vcf.read_samples(spark, sources)
    reference = ref.read_fasta(spark, fasta)
    found = merge.merge_variants(records, reference, len(sources), options, region=vcf.parse_region(region) if region else None, exclude=exclude, drop_overlaps=drop_overlaps)
    order = reference.select(F.col("chrom").alias("c"), "chrom_idx").distinct()
    lines = found.join(order, F.col("chrom") == F.col("c")).select("chrom_idx", "pos", "is_indel", merge.line_of().alias("value"))
    names = "\t".join(vcf.sample_name(head) for head in heads)
    head = [line for line in heads[0] if not line.startswith("#CHROM")] + ["#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + names]
    vcf.write_lines(lines, out, ["chrom_idx", "pos", "is_indel"], head if not lines.isEmpty() else None)


def concordance_report(spark: SparkSession, sources: list[str], fasta: str, out: str, options: CallOptions = CallOptions(), region: str | None = None, exclude: list[str] | None = None, drop_overlaps: bool = False, events: dict[str, str] | None = None, metadata: bool = True, command: str = "") -> list[tuple[str, str]]:
    """Twins for two sources, a trio (mother, father, child) for three; ``events`` maps conflict, same_het and hethet_hom to paths."""
    is_trio = len(sources) == 3
    names = concordance.TRIO if is_trio else concordance.TWINS
    _, records = vcf.read_samples(spark, sources)
    reference = ref.read_fasta(spark, fasta)
    part = vcf.parse_region(region) if region else None
    tool = concordance.trio if is_trio else concordance.twins
    judged, row = tool(records, reference, options, region=part, exclude=exclude, drop_overlaps=drop_overlaps)
    sized = reference.filter(~F.col("chrom").isin(exclude)) if exclude else reference
    size = ref.known_size(ref.standardized(sized), part).first()
    lines = concordance.report(row.first().asDict(), size["size"], size["known"], names, is_trio)
    head = [("CMDLINE", command)] + ([("START_TIME", datetime.datetime.now().ctime()), ("VERSION", VERSION)] if metadata else [])
    text = [(k, f"{name} {value}") for k, (name, value) in enumerate(head)] + [(len(head) + k, f"{name}: {value}") for k, (name, value) in enumerate(lines)]
    spark.createDataFrame(text, "k int, value string").orderBy("k").coalesce(1).select("value").write.text(out)
    chosen = {"conflict": F.col("all_called") & ~F.col("consistent"), "same_het": F.col("same_het") if is_trio else F.lit(False), "hethet_hom": F.col("hethet_hom") if is_trio else F.lit(False)}
    for kind, path in (events or {}).items():
        vcf.write_lines(concordance.event_lines(judged.filter(chosen[kind]), names), path, ["chrom", "pos", "k"])
    return lines


def chromosome_depth(spark: SparkSession, index_stats: str, alignments: str, out: str, most_reads: int = 200_000) -> None:
    stats = regions.parse_index_stats(spark.read.text(index_stats))
    reads = regions.parse_alignments(vcf.read_lines(spark, alignments))
    depth.depth_lines(depth.average_depth(stats, reads, most_reads)).orderBy("chrom").select("value").write.text(out)


