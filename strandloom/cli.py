"""``python -m strandloom.cli TOOL ...``: the tools on the command line. Outputs are folders of text files, in order."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from strandloom.operators.filters import DEFAULT_FILTERS, BlockOptions
from strandloom.operators.sites import CallOptions, InfoLimit
from strandloom.plans import tools


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom", description="Genome variant files on Spark.")
    sub = top.add_subparsers(dest="tool", required=True)

    block = sub.add_parser("gatk_to_gvcf", help="filter, settle overlaps with indels, compress non-variant sites")
    block.add_argument("source")
    block.add_argument("out")
    block.add_argument("--min-blockable-nonref", type=float, default=0.2)
    block.add_argument("--skip-header", action="store_true")
    block.add_argument("--chrom-depth-file")
    block.add_argument("--max-depth-factor", default="3.0")
    block.add_argument("--min-gqx")
    for each in DEFAULT_FILTERS:
        block.add_argument("--" + each.option.replace("_", "-"), help=f"default {each.threshold}")
    block.add_argument("--no-default-filters", action="store_true")
    block.add_argument("--block-range-factor", type=float, default=0.3)
    block.add_argument("--block-label", default="BLOCKAVG_min30p3a")
    block.add_argument("--block-stats")
    block.add_argument("--no-block-compression", action="store_true")

    for name in ("break_blocks", "remove_region", "set_haploid_region"):
        region = sub.add_parser(name)
        region.add_argument("source")
        region.add_argument("out")
        region.add_argument("--region-file", required=True)
        region.add_argument("--ref", required=True)
        if name == "break_blocks":
            region.add_argument("--exclude-off-target", action="store_true")
            region.add_argument("--include-variants", action="store_true")

    extract = sub.add_parser("extract_variants")
    extract.add_argument("source")
    extract.add_argument("out")
    extract.add_argument("--skip-header", action="store_true")
    extract.add_argument("--invert", action="store_true")

    called = sub.add_parser("get_called_regions")
    called.add_argument("source")
    called.add_argument("out")

    check = sub.add_parser("check_reference")
    check.add_argument("source")
    check.add_argument("--ref", required=True)

    several = argparse.ArgumentParser(add_help=False)
    several.add_argument("out")
    several.add_argument("--ref", required=True)
    several.add_argument("--region")
    several.add_argument("--exclude", action="append", default=[])
    several.add_argument("--murdock", action="store_true", help="drop overlapping records instead of refusing them")
    merge = sub.add_parser("merge_variants", parents=[several])
    merge.add_argument("--input", action="append", required=True)
    for name, samples in (("twins", ("twin1", "twin2")), ("trio", ("mother", "father", "child"))):
        report = sub.add_parser(name, parents=[several])
        for sample in samples:
            report.add_argument(f"--{sample}", required=True)
        report.add_argument("--conflict-file")
        if name == "trio":
            report.add_argument("--same-het-file")
            report.add_argument("--hethet-hom-file")
        report.add_argument("--no-variable-metadata", action="store_true")
        report.add_argument("--min-gqx", type=float, default=0.0)
        report.add_argument("--min-pos-rank-sum", type=float)
        report.add_argument("--min-qd", type=float)
        report.add_argument("--min-info-field", nargs=2, action="append", default=[], metavar=("KEY", "VALUE"))
        report.add_argument("--max-info-field", nargs=2, action="append", default=[], metavar=("KEY", "VALUE"))

    mean = sub.add_parser("chromosome_depth")
    mean.add_argument("index_stats")
    mean.add_argument("alignments")
    mean.add_argument("out")
    return top


def block_options(args: argparse.Namespace) -> BlockOptions:
    names = ["min_gqx", *(each.option for each in DEFAULT_FILTERS)]
    given = {name: getattr(args, name) for name in names if getattr(args, name) is not None}
    for name, value in given.items():
        float(value)  # a threshold that isn't a number is refused here
    base = BlockOptions(min_blockable_nonref=args.min_blockable_nonref, max_depth_factor=args.max_depth_factor, range_factor=args.block_range_factor, label=args.block_label, compress=not args.no_block_compression)
    return base.with_thresholds(args.no_default_filters, **given)


def call_options(args: argparse.Namespace) -> CallOptions:
    limits = [InfoLimit(key, float(value), True) for key, value in args.min_info_field] + [InfoLimit(key, float(value), False) for key, value in args.max_info_field]
    return CallOptions(args.min_gqx, args.min_qd, args.min_pos_rank_sum, tuple(limits))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    command = " ".join(argv if argv is not None else sys.argv[1:])
    spark = spark or SparkSession.builder.appName("strandloom").getOrCreate()
    if args.tool == "gatk_to_gvcf":
        tools.gatk_to_gvcf(spark, args.source, args.out, block_options(args), args.chrom_depth_file, args.block_stats, args.skip_header, command)
    elif args.tool in ("break_blocks", "remove_region", "set_haploid_region"):
        options = {"exclude_off_target": args.exclude_off_target, "include_variants": args.include_variants} if args.tool == "break_blocks" else {}
        tools.region_tool(spark, args.tool, args.source, args.region_file, args.ref, args.out, command, **options)
    elif args.tool == "extract_variants":
        tools.extract_variants(spark, args.source, args.out, args.invert, args.skip_header)
    elif args.tool == "get_called_regions":
        tools.called_regions(spark, args.source, args.out)
    elif args.tool == "check_reference":
        tools.check_reference(spark, args.source, args.ref)
    elif args.tool == "merge_variants":
        tools.merge_variants(spark, args.input, args.ref, args.out, region=args.region, exclude=args.exclude, drop_overlaps=args.murdock)
    elif args.tool in ("twins", "trio"):
        sources = [args.twin1, args.twin2] if args.tool == "twins" else [args.mother, args.father, args.child]
        events = {"conflict": args.conflict_file} | ({"same_het": args.same_het_file, "hethet_hom": args.hethet_hom_file} if args.tool == "trio" else {})
        tools.concordance_report(spark, sources, args.ref, args.out, call_options(args), args.region, args.exclude, args.murdock, {k: v for k, v in events.items() if v}, not args.no_variable_metadata, command)
    else:
        tools.chromosome_depth(spark, args.index_stats, args.alignments, args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
