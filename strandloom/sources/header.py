"""File headers: lists of lines, edited on the driver."""

from __future__ import annotations

from strandloom.operators.filters import BlockOptions

# What the header lines say.
FORMAT_MQ = '##FORMAT=<ID=MQ,Number=1,Type=Integer,Description="RMS Mapping Quality">'
FORMAT_GQX = '##FORMAT=<ID=GQX,Number=1,Type=Integer,Description="Minimum of {Genotype quality assuming variant position,Genotype quality assuming non-variant position}">'
INFO_END = '##INFO=<ID=END,Number=1,Type=Integer,Description="End position of the region described in this record">'
INFO_BLOCK = '##INFO=<ID={label},Number=0,Type=Flag,Description="Non-variant site block. All sites in a block are constrained to be non-variant, have the same filter value, and have all sample values in range [x,y] , y <= max(x+3,(x*(1+{factor:g}))). All printed site block sample values are the minimum observed in the region spanned by the block">'
FILTER_INDEL_CONFLICT = '##FILTER=<ID={label},Description="Locus is in region with conflicting indel calls.">'
FILTER_SITE_CONFLICT = '##FILTER=<ID={label},Description="Site genotype conflicts with proximal indel call. This is typically a heterozygous SNV call made inside of a heterozygous deletion.">'
FILTER_DEPTH = '##FILTER=<ID={label},Description="Site depth is greater than {factor}x the mean chromosome depth">'
FILTER_HAPLOID = '##FILTER=<ID=HAPLOID_CONFLICT,Description="Locus has heterozygous genotype in a haploid region.">'
FORMAT_OPL = '##FORMAT=<ID=OPL,Number=.,Type=Integer,Description="Original PL value before conversion to haploid genotype">'
#: Lines that mention one of these are dropped before blocks are written.
DROPPED = ("INFO=<ID=AC", "INFO=<ID=AF", "INFO=<ID=AN")


def edited(header: list[str], added: list[str], dropped: tuple[str, ...] = (), version: str | None = None, command: str | None = None, skip: bool = False) -> list[str]:
    """The header without lines that hold a dropped text, and with new lines before the column line; nothing with ``skip``."""
    if skip:
        return []
    out: list[str] = []
    for line in header:
        if line.startswith("#CHROM"):
            out += [f'##strandloom_version="{version}"'] if version else []
            out += [f'##strandloom_cmdline="{command}"'] if command else []
            out += [*added, line]
            break
        if not any(text in line for text in dropped):
            out.append(line)
    return out


def block_lines(options: BlockOptions, depths: dict[str, float] | None = None) -> list[str]:
    """Lines that the block tool adds: its fields, its filters with their thresholds, and depth limits by name of chromosome."""

    def filter_line(label: str, kind: str, tag: str, is_max: bool, threshold: str, if_missing: bool) -> str:
        return f'##FILTER=<ID={label},Description="{kind} {tag} is {"greater" if is_max else "less"} than {threshold}{" or not present" if if_missing else ""}">'

    kinds = {"SITE": "Site", "INDEL": "Indel", "BOTH": "Locus"}
    out = [
        INFO_END,
        INFO_BLOCK.format(label=options.label, factor=options.range_factor),
        FORMAT_MQ,
        FORMAT_GQX,
        FILTER_INDEL_CONFLICT.format(label=options.indel_conflict),
        FILTER_SITE_CONFLICT.format(label=options.site_conflict),
    ]
    if depths:
        out.append(FILTER_DEPTH.format(label=options.max_depth_label, factor=options.max_depth_factor))
        out += [f"##{options.max_depth_label}_{chrom}={depth * float(options.max_depth_factor):g}" for chrom, depth in sorted(depths.items())]
    if options.min_gqx is not None:
        out.append(filter_line(options.gqx_label, "Locus", "GQX", False, options.min_gqx, True))
    return out + [filter_line(each.label, kinds[each.kind], each.tag, each.is_max, each.threshold, each.if_missing) for each in options.thresholds]


def haploid_lines() -> list[str]:
    return [FILTER_HAPLOID, FORMAT_OPL]
