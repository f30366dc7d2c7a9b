"""Threshold filters and the grooming of input records, as expressions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import records as R
from strandloom.plans import ordered


@dataclass(frozen=True)
class Threshold:
    """A filter on an INFO or FORMAT number; the threshold keeps its text for the header."""

    option: str
    kind: str  # SITE, INDEL or BOTH
    label: str
    tag: str
    threshold: str
    is_max: bool
    in_sample: bool = False
    if_missing: bool = False

    @property
    def place(self) -> str:
        return "sample" if self.in_sample else "info"

    def value(self) -> Column:
        return R.maybe_double(R.sample_value(self.tag) if self.in_sample else R.info_value("info", self.tag))

    def holds(self, value: Column | None = None) -> Column:
        """Whether a record gets the label."""
        value, limit = self.value() if value is None else value, float(self.threshold)
        failed = F.coalesce((value > limit) if self.is_max else (value < limit), F.lit(self.if_missing))
        indel = R.is_indel_any_long()
        return failed & (~indel if self.kind == "SITE" else indel if self.kind == "INDEL" else F.lit(True))


# The default filters and their thresholds.
DEFAULT_FILTERS = (
    Threshold("min_mq", "SITE", "LowMQ", "MQ", "20.0", False),
    Threshold("min_qd", "BOTH", "LowQD", "QD", "3.73", False),
    Threshold("max_site_fs", "SITE", "HighFS", "FS", "60.0", True),
    Threshold("max_hapscore", "SITE", "HighHaplotypeScore", "HaplotypeScore", "13.0", True),
    Threshold("min_mqrs", "SITE", "LowMQRankSum", "MQRankSum", "-12.5", False),
    Threshold("min_site_rprs", "SITE", "LowReadPosRankSum", "ReadPosRankSum", "-2.386", False),
    Threshold("max_indel_fs", "INDEL", "HighIndelFS", "FS", "200.0", True),
    Threshold("min_indel_rprs", "INDEL", "LowIndelReadPosRankSum", "ReadPosRankSum", "-20.0", False),
)


@dataclass(frozen=True)
class BlockOptions:
    """Options of the filtering and block-compressing tool; the labels and defaults are fixed values."""

    min_blockable_nonref: float = 0.2
    max_depth_factor: str = "3.0"
    min_gqx: str | None = "20.0"
    thresholds: tuple[Threshold, ...] = DEFAULT_FILTERS
    range_factor: float = 0.3
    absolute_tolerance: int = 3
    label: str = "BLOCKAVG_min30p3a"
    compress: bool = True
    max_depth_label: str = "MaxDepth"
    indel_conflict: str = "IndelConflict"
    site_conflict: str = "SiteConflict"
    gqx_label: str = "LowGQX"

    def __post_init__(self) -> None:
        if self.range_factor < 0:
            raise ValueError("the block range factor is not negative")

    def with_thresholds(self, no_defaults: bool = False, **given: str) -> BlockOptions:
        """Thresholds set by option name; ``no_defaults`` drops all filters that are left at their default."""
        names = {each.option for each in self.thresholds} | {"min_gqx"}
        if unknown := set(given) - names:
            raise ValueError(f"unknown filters: {sorted(unknown)}")
        kept = tuple(replace(each, threshold=str(given.get(each.option, each.threshold))) for each in self.thresholds if each.option in given or not no_defaults)
        gqx = given.get("min_gqx", None if no_defaults else self.min_gqx)
        return replace(self, thresholds=kept, min_gqx=None if gqx is None else str(gqx))


def add_labels(records: DataFrame, labels: list[tuple[Column, str]]) -> DataFrame:
    """Records with the labels whose condition holds, in order: each once, and in PASS's place."""
    if not labels:
        return records
    given = F.array_distinct(F.filter(F.array(*[F.when(holds, F.lit(label)) for holds, label in labels]), lambda label: label.isNotNull()))
    records = records.withColumn("_labels", given)
    had = F.when(R.is_pass(), R.empty()).otherwise(F.col("filter"))
    new = F.concat(had, F.filter("_labels", lambda label: ~F.array_contains(F.col("filter"), label)))
    return records.withColumn("filter", F.when(F.size("_labels") > 0, new).otherwise(F.col("filter"))).drop("_labels")


def add_thresholds(records: DataFrame, thresholds: tuple[Threshold, ...] = DEFAULT_FILTERS) -> DataFrame:
    """Records with the labels of all thresholds that they miss, in order."""
    return add_labels(records, [(each.holds(), each.label) for each in thresholds])


def low_gqx(minimum: str) -> Column:
    gqx = R.gqx()
    return gqx.isNull() | (gqx < float(minimum))


def add_gqx_filter(records: DataFrame, minimum: str, label: str = "LowGQX") -> DataFrame:
    return add_labels(records, [(low_gqx(minimum), label)])


def with_depth_limit(records: DataFrame, depths: DataFrame, factor: str = "3.0") -> DataFrame:
    """Records with ``depth_limit``: the chromosome's mean depth times the factor, null for chromosomes without a depth."""
    limits = depths.select(F.col("chrom").alias("_dc"), (F.col("depth") * float(factor)).alias("depth_limit"))
    return records.join(F.broadcast(limits), F.col("chrom") == F.col("_dc"), "left").drop("_dc")


def too_deep() -> Column:
    """The sample's DP is over ``depth_limit``; a missing DP is within it."""
    return R.maybe_double(R.sample_value("DP")) > F.col("depth_limit")


def add_depth_filter(records: DataFrame, label: str = "MaxDepth") -> DataFrame:
    return add_labels(records, [(too_deep(), label)])


def groom(records: DataFrame, options: BlockOptions = BlockOptions()) -> DataFrame:
    """Input grooming: MQ rounded and copied to the sample, filters in their order, PASS for none, AC, AF and AN dropped.

    A column ``depth_limit``, if there is one, gives the high-depth filter.
    """
    values = {"_gqx": R.gqx(), "_mq": R.maybe_int(R.info_value("info", "MQ")).cast("string")}
    values |= {f"_{place}_{tag}": R.maybe_double(R.sample_value(tag) if place == "sample" else R.info_value("info", tag)) for place, tag in {(each.place, each.tag) for each in options.thresholds}}
    names = records.columns
    records = records.withColumns(values)
    known = F.col("_mq").isNotNull()
    format, sample = R.sample_set("MQ", F.col("_mq"))
    changed = {"info": F.when(known, R.info_set("info", "MQ", F.col("_mq"))).otherwise(F.col("info")), "format": F.when(known, format).otherwise(F.col("format")), "sample": F.when(known, sample).otherwise(F.col("sample"))}
    if "_info_MQ" in values:
        changed["_info_MQ"] = F.coalesce(F.col("_mq").cast("double"), F.col("_info_MQ"))
    records = records.withColumns(changed)
    labels = [(F.coalesce(F.col("_gqx") < float(options.min_gqx), F.lit(True)), options.gqx_label)] if options.min_gqx is not None else []
    labels += [(too_deep(), options.max_depth_label)] if "depth_limit" in names else []
    records = add_labels(records, labels + [(each.holds(F.col(f"_{each.place}_{each.tag}")), each.label) for each in options.thresholds])
    records = records.withColumn("filter", R.filter_default("filter"))
    for key in ("AC", "AF", "AN"):
        records = records.withColumn("info", R.info_delete("info", key))
    return records.select(*names)


def without_repeats(records: DataFrame, width: int = ordered.BIN, keep: bool = False) -> DataFrame:
    """Records without multi-base non-variant ones, and without non-indels at or before an earlier non-indel's position.

    Positions are taken in file order, as ``line_no`` has it; within a chromosome they rise, but for the repeats. ``keep`` is
    that of :mod:`strandloom.plans.ordered`.
    """
    own = records.filter(~R.is_nonvariant_block())
    place = F.when(~R.is_indel_any_long(), F.col("pos"))
    found = ordered.max_before(own, ["chrom"], "pos", ["pos", "line_no"], place, "_last", width, keep)
    return found.filter(R.is_indel_any_long() | F.col("_last").isNull() | (F.col("pos") > F.col("_last"))).drop("_last")


def is_blockable(options: BlockOptions = BlockOptions()) -> Column:
    """Whether a record may join a block: no ID or ALT, one base, a reference or unknown genotype, and few other bases."""
    if not options.compress:
        return F.lit(False)
    gt = F.coalesce(R.sample_value("GT"), F.lit(""))
    ad, dp = R.maybe_int(R.sample_value("AD")), R.maybe_int(R.info_value("info", "DP"))
    mixed = F.coalesce(F.try_divide(ad.cast("double"), dp.cast("double")) + options.min_blockable_nonref <= 1.0, F.lit(False))
    return (F.col("id") == ".") & ~R.is_variant() & (F.length("ref") == 1) & gt.isin("", "./.", ".", "0/0", "0") & ~mixed


def write_gqx(records: DataFrame) -> DataFrame:
    """GQX added to the sample of unblocked records that have one."""
    value = R.gqx()
    format, sample = R.sample_set("GQX", value.cast("string"))
    return records.withColumns({"format": F.when(value.isNotNull(), format).otherwise(F.col("format")), "sample": F.when(value.isNotNull(), sample).otherwise(F.col("sample"))})
