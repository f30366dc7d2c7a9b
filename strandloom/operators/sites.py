"""Records as sites: call predicates, expansion to positions, and the order of records."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import records as R
from strandloom.plans import ordered
from strandloom.plans.storage import stored
from strandloom.sources import reference as ref


@dataclass(frozen=True)
class InfoLimit:
    """An INFO number's minimum or maximum; records without the key pass."""

    key: str
    value: float
    is_min: bool = True


@dataclass(frozen=True)
class CallOptions:
    """When a record counts as called. Numbers pass through single precision before they are compared."""

    min_gqx: float = 0.0
    min_qd: float | None = None
    min_pos_rank_sum: float | None = None
    info: tuple[InfoLimit, ...] = ()


def is_call(options: CallOptions = CallOptions()) -> Column:
    """FILTER is PASS and no limit is missed; a missing value misses none. The rank-sum limit reads BaseQRankSum."""
    limits = list(options.info)
    if options.min_qd is not None:
        limits.append(InfoLimit("QD", options.min_qd))
    if options.min_pos_rank_sum is not None:
        limits.append(InfoLimit("BaseQRankSum", options.min_pos_rank_sum))
    good = R.is_pass()
    if options.min_gqx > 0:
        good &= F.coalesce(R.format_prefix_float("GQX") >= options.min_gqx, F.lit(True))
    for limit in limits:
        value = R.info_prefix_number("info", limit.key)
        good &= F.coalesce((value >= limit.value) if limit.is_min else (value <= limit.value), F.lit(True))
    return good


def mapped_depth() -> Column:
    """The sample's DP, 0 where it is missing."""
    return F.coalesce(R.format_prefix_unsigned("DP"), F.lit(0))


def without_chromosomes(records: DataFrame, names: list[str]) -> DataFrame:
    return records.filter(~F.col("chrom").isin(names)) if names else records


def on_reference(records: DataFrame, reference: DataFrame) -> DataFrame:
    """Records of the reference's chromosomes; others are never visited."""
    return records.join(reference.select("chrom").distinct(), "chrom", "left_semi").select(*records.columns)


def placed(records: DataFrame, reference: DataFrame, region: tuple[str, int | None, int | None] | None = None) -> DataFrame:
    """The records; a position below 1, or beyond its contig where no region is asked for, is an error when it is read."""
    sizes = ref.contigs(reference).select(F.col("chrom").alias("_sc"), F.col("size").alias("_size"))
    met = records.join(sizes, F.col("chrom") == F.col("_sc"), "left")
    bad = F.when(F.col("pos") < 1, F.lit("record position less than 1"))
    if not region:
        bad = bad.when(F.col("pos") > F.col("_size"), F.lit("record position beyond the end of its contig"))
    pos = F.when(bad.isNull(), F.col("pos")).otherwise(F.raise_error(F.concat(bad, F.lit(": "), "chrom", F.lit(":"), F.col("pos").cast("string"))).cast("long"))
    return met.withColumn("pos", pos.cast(records.schema["pos"].dataType)).select(*records.columns)


def with_locus(records: DataFrame) -> DataFrame:
    """Records with ``is_indel``, ``n_sites`` (0 for indels and for a malformed END) and ``locus_end``, the last position."""
    indel = R.is_indel_site()
    sites = F.when(indel, F.lit(0)).otherwise(R.site_length())
    return records.withColumns({"is_indel": indel, "n_sites": sites, "locus_end": F.col("pos") + F.greatest(sites, F.lit(1)) - 1})


def order_conflicts(records: DataFrame, width: int = ordered.BIN) -> DataFrame:
    """Rows of :func:`with_locus` that do not come after the row before them (of their sample and chromosome)."""
    names = records.columns
    here = F.struct("locus_end", "is_indel")
    cut = ordered.binned(records, "line_no", width)
    within = Window.partitionBy("sample_id", "chrom", "_bin").orderBy("line_no")
    cut = cut.withColumns({"_before": F.lag(here).over(within), "_last": F.lead(F.lit(True)).over(within).isNull()})
    early = lambda before: F.coalesce(F.struct("pos", "is_indel") <= before, F.lit(False))
    # of a bin, its ends are enough to compare it with the bin before it
    found = cut.withColumn("_early", early(F.col("_before"))).filter("_before IS NULL OR _last OR _early")
    over_bins = Window.partitionBy("sample_id", "chrom").orderBy("line_no")
    found = found.withColumn("_ends", F.lag(here).over(over_bins))
    return found.filter(F.col("_early") | (F.col("_before").isNull() & early(F.col("_ends")))).select(*names)


def refuse_conflicts(records: DataFrame, region: tuple[str, int | None, int | None] | None = None) -> None:
    """Raise on the first of :func:`order_conflicts` in the rows of :func:`with_locus` that reach into the region."""
    if region:
        chrom, low, high = region
        records = records.filter(F.col("chrom") == chrom)
        records = records if low is None else records.filter(F.col("locus_end") >= low)
        records = records if high is None else records.filter(F.col("pos") <= high)
    bad = order_conflicts(records.select("sample_id", "chrom", "line_no", "pos", "is_indel", "locus_end")).orderBy("sample_id", "line_no").first()
    if bad:
        raise ValueError(f"unexpected position order in sample {bad['sample_id']}: {bad['chrom']}:{bad['pos']} does not come after the record before it")


def murdock(records: DataFrame, width: int = ordered.BIN) -> DataFrame:
    """Rows of :func:`with_locus` that begin after the last kept row's end; the rest are dropped.

    Whether a row is kept depends on the rows kept before it, but only back to the last place that no earlier row reaches
    over. Such places (by a running maximum) cut a chromosome into clusters, and each cluster is a short fold.
    """
    order = ["pos", "is_indel", "line_no"]
    found = ordered.max_before(records, ["sample_id", "chrom"], "pos", order, F.col("locus_end"), "_reach", width, keep=True)
    fresh = F.when(F.col("_reach").isNull() | (F.col("pos") > F.col("_reach")), 1).otherwise(0).cast("long")
    found = ordered.sum_through(found.withColumn("_fresh", fresh), ["sample_id", "chrom"], "pos", order, F.col("_fresh"), "_cluster", width)
    found = found.repartition("sample_id", "chrom", "_cluster").sortWithinPartitions("sample_id", "chrom", "_cluster", *order)
    names = found.columns
    at = [names.index(name) for name in ("sample_id", "chrom", "_cluster", "pos", "is_indel", "locus_end")]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, (0, False)
        for batch in batches:
            flags = []
            for sample, chrom, cluster, pos, indel, end in zip(*(batch.column(k).to_pylist() for k in at), strict=True):
                if (sample, chrom, cluster) != key:
                    key, last = (sample, chrom, cluster), (0, False)
                flags.append((pos, indel) > last)
                if flags[-1]:
                    last = (end, indel)
            yield batch.filter(pa.array(flags))

    return found.mapInArrow(keep, found.schema).select(*records.columns)


def with_calls(records: DataFrame, options: CallOptions = CallOptions()) -> DataFrame:
    """Rows of :func:`with_locus` with ``gt, passes, depth``: all that :func:`spread` reads of FILTER, INFO and the sample."""
    return records.withColumns({"gt": R.try_gt(R.format_prefix_value("GT")), "passes": is_call(options), "depth": mapped_depth()})


def settled(records: DataFrame, reference: DataFrame, options: CallOptions, exclude: list[str], region: tuple[str, int | None, int | None] | None, drop_overlaps: bool, indels: bool, more: tuple[str, ...]) -> DataFrame:
    """Rows of :func:`with_calls` on the reference, with the columns ``more``, in order and without overlaps.

    Lines are parsed once and stored, as both the check of their order and the tool read them.
    """
    records = placed(on_reference(without_chromosomes(records, exclude), reference), reference, region)
    records = with_locus(records.filter(F.col("chrom") == region[0]) if region else records)
    names = ["sample_id", "chrom", "line_no", "pos", "ref", "alt", "is_indel", "n_sites", "locus_end", "gt", "passes", "depth", *[c for c in more if c in records.columns]]
    found = stored(with_calls(records, options).select(*names), "settled")
    found = found if indels else found.filter("NOT is_indel")
    if drop_overlaps:
        return murdock(found)
    refuse_conflicts(found, region)
    return found


def spread(found: DataFrame, reference: DataFrame, indels: bool = False, region: tuple[str, int | None, int | None] | None = None) -> DataFrame:
    """:func:`expanded` for rows of :func:`with_calls`."""
    if not indels:
        found = found.filter("NOT is_indel")
    begin, end = F.col("pos"), F.col("locus_end")
    if region:
        chrom, low, high = region
        found = found.filter(F.col("chrom") == chrom)
        if low is not None:
            begin = F.greatest(begin, F.when(F.col("is_indel"), begin).otherwise(F.lit(low)))
            found = found.filter((F.col("locus_end") >= low) & (~F.col("is_indel") | (F.col("pos") >= low)))
        if high is not None:
            end = F.least(end, F.lit(high))
            found = found.filter(F.col("pos") <= high)
    rows = found.withColumn("site_pos", F.explode(F.sequence(begin, F.greatest(begin, end))))
    rows = ref.with_base(rows, reference, pos="site_pos")
    site = F.col("site_pos") - F.col("pos")
    alleles = F.when(F.col("is_indel"), R.indel_alleles(F.col("gt"), "ref", "alt")).otherwise(R.site_alleles(F.col("gt"), "alt", site, F.col("ref_base")))
    known = F.col("is_indel") | ~F.exists(F.col("gt"), lambda a: (a < 0) | (a > F.size("alt")))
    return rows.withColumn("alleles", alleles).withColumn("called", F.coalesce(F.col("passes") & (F.size("gt") == 2) & known, F.lit(False))).drop("passes")


def expanded(records: DataFrame, reference: DataFrame, options: CallOptions = CallOptions(), indels: bool = False, region: tuple[str, int | None, int | None] | None = None) -> DataFrame:
    """One row for each position that a record covers (for an indel, if ``indels``, one row at its POS).

    Columns: those of the records, and ``site_pos, is_indel, ref_base, alleles, called, depth``. A site is called if its
    record is, and it has exactly two known alleles. A region clips blocks to its ends.
    """
    return spread(with_calls(with_locus(records), options), reference, indels, region)
