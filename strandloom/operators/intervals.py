"""Interval operators: merging, called regions, and splitting records by regions.

Regions are ``chrom, begin, end``, 0-based and half-open: a region acts on the 1-based positions begin+1 to end. Records meet
regions by an equi-join on position bins, so neither side needs a nested loop; a bin's regions are one array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import records as R
from strandloom.plans import ordered
from strandloom.plans.storage import stored
from strandloom.sources import reference as ref

#: Positions of a bin of the region join.
WIDTH = 1 << 12
HAPLOID_CONFLICT = "HAPLOID_CONFLICT"
ORIGINAL_PL = "OPL"


def coalesced(ranges: DataFrame, width: int = ordered.BIN) -> DataFrame:
    """Overlapping or adjacent ranges of a chromosome as one, by gaps and islands."""
    order = ["begin"]
    firsts = stored(ranges.groupBy("chrom", "begin").agg(F.max("end").alias("end")), "ranges")
    found = ordered.max_before(firsts, ["chrom"], "begin", order, F.col("end"), "reach", width, keep=True)
    found = ordered.sum_through(found, ["chrom"], "begin", order, F.when(F.col("begin") > F.col("reach"), 1).otherwise(0).cast("long"), "island", width)
    return found.groupBy("chrom", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("island")


def merge_regions(regions: DataFrame) -> DataFrame:
    """Regions sorted into disjoint ones that don't touch; ``chrom, begin, end``."""
    return coalesced(regions)


def called_ranges(records: DataFrame) -> DataFrame:
    """The range that each passing record calls, 0-based and half-open; insertions call nothing."""
    begin, end = R.called_range()
    return records.filter(R.is_pass()).select("chrom", (begin - 1).alias("begin"), end.alias("end")).filter("end > begin")


def called_regions(records: DataFrame) -> DataFrame:
    """Maximal ranges that passing records call."""
    return coalesced(called_ranges(records))


def with_hits(records: DataFrame, regions: DataFrame, width: int = WIDTH) -> DataFrame:
    """Records with ``stop`` (their last position) and ``hits``: the merged regions that overlap POS to END, in order.

    Records within one bin meet their regions by the join alone; those that cross bins are put together again by their
    place: ``line_no`` with the chromosome and position, and file and sample if there are several.
    """
    names = records.columns
    bins = F.sequence(F.floor(F.col("begin") / width), F.floor(F.col("end") / width))
    by_bin = merge_regions(regions).select(F.col("chrom").alias("_rc"), F.struct("begin", "end").alias("_r"), F.explode(bins).alias("_rb"))
    by_bin = by_bin.groupBy("_rc", "_rb").agg(F.array_sort(F.collect_list("_r")).alias("_rs"))
    own = records.withColumn("stop", R.record_end()).withColumns({"_first": F.floor(F.col("pos") / width), "_last": F.floor(F.col("stop") / width)})
    overlap = F.filter("_rs", lambda r: (F.col("stop") > r["begin"]) & (F.col("pos") <= r["end"]))
    nothing = F.array().cast("array<struct<begin:bigint,end:bigint>>")

    def met(part: DataFrame) -> DataFrame:
        joined = part.join(by_bin, (F.col("chrom") == F.col("_rc")) & (F.col("_bin") == F.col("_rb")), "left")
        return joined.select(*names, "stop", F.coalesce(overlap, nothing).alias("hits"))

    single = met(own.filter("_first >= _last").withColumn("_bin", F.col("_first")))
    several = met(own.filter("_first < _last").withColumn("_bin", F.explode(F.sequence(F.col("_first"), F.col("_last")))))
    key = [c for c in ("sample_id", "file", "line_no", "chrom", "pos") if c in names]
    row = F.first(F.struct(*names, "stop")).alias("_row")
    several = several.groupBy(*key).agg(row, F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"))
    return single.unionByName(several.select("_row.*", "hits"))


def overlapping(records: DataFrame, regions: DataFrame) -> DataFrame:
    """Records that overlap a region (an interval semi-join)."""
    return with_hits(records, regions).filter(F.size("hits") > 0).drop("hits", "stop")


def pieces(records: DataFrame, regions: DataFrame) -> DataFrame:
    """Records cut at the borders of regions: each row is the largest piece that lies inside or outside.

    ``piece`` numbers them, ``pos`` and ``stop`` are the piece's ends, ``in_region`` says where it lies, and ``touched`` whether
    the record meets a region at all.
    """
    names = [c for c in records.columns if c != "pos"]
    cuts = F.flatten(F.transform("hits", lambda r: F.array(r["begin"] + 1, r["end"] + 1)))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array("pos"), F.filter(cuts, lambda c: (c > F.col("pos")) & (c <= F.col("stop"))))))
    cut = with_hits(records, regions).withColumn("cuts", cuts).withColumn("last", F.col("stop"))
    rows = cut.select(*names, "hits", "cuts", "last", F.posexplode("cuts").alias("piece", "pos"))
    rows = rows.withColumn("stop", F.coalesce(F.get("cuts", F.col("piece") + 1) - 1, F.col("last")))
    inside = F.exists("hits", lambda r: (F.col("pos") > r["begin"]) & (F.col("pos") <= r["end"]))
    return rows.select(*records.columns, "piece", "stop", inside.alias("in_region"), (F.size("hits") > 0).alias("touched"))


def _with_ref(rows: DataFrame, reference: DataFrame, where: Column) -> DataFrame:
    """REF of the rows where ``where`` holds taken from the reference, in its own case."""
    found = ref.with_base(rows.withColumn("_look", F.when(where, F.col("pos"))), reference, pos="_look", name="_base")
    return found.withColumn("ref", F.when(F.col("_look").isNotNull(), F.col("_base")).otherwise(F.col("ref"))).drop("_look", "_base")


def _with_end(rows: DataFrame) -> DataFrame:
    """END set where a piece has more than one position, and deleted where it has one; untouched records stay."""
    info = F.when(F.col("stop") > F.col("pos"), R.info_set("info", "END", F.col("stop").cast("string"))).otherwise(R.info_delete("info", "END"))
    return rows.withColumn("info", F.when(F.col("touched"), info).otherwise(F.col("info")))


def by_region(records: DataFrame, regions: DataFrame, reference: DataFrame, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The general region tool: cut records, set REF and END of the pieces, and apply ``process`` to the pieces."""
    cut = _with_ref(pieces(records, regions), reference, F.col("piece") > 0)
    return process(_with_end(cut))


def _result(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*columns, "piece")


def remove_region(records: DataFrame, regions: DataFrame, reference: DataFrame) -> DataFrame:
    """Records and parts of blocks outside all regions; ``piece`` orders a record's pieces."""
    return _result(by_region(records, regions, reference, lambda rows: rows.filter("NOT in_region")), records.columns)


def break_blocks(records: DataFrame, regions: DataFrame, reference: DataFrame, exclude_off_target: bool = False, include_variants: bool = False) -> DataFrame:
    """Blocks cut into single positions inside regions.

    ``exclude_off_target`` drops what lies outside, of which ``include_variants`` keeps records with a called alternate allele.
    """
    cut = _with_end(_with_ref(pieces(records, regions), reference, F.col("piece") > 0))
    outside = cut.filter("NOT in_region")
    if exclude_off_target:
        outside = outside.filter(R.is_variant_strict()) if include_variants else outside.filter(F.lit(False))
    inside = cut.filter("in_region").withColumn("info", R.info_delete("info", "END"))
    inside = inside.withColumns({"_begin": F.col("pos"), "pos": F.explode(F.sequence("pos", "stop"))})
    inside = _with_ref(inside, reference, F.col("pos") > F.col("_begin")).drop("_begin")
    return _result(outside.unionByName(inside), records.columns)


def haploid(rows: DataFrame, where: Column) -> DataFrame:
    """Diploid calls rewritten as haploid where ``where`` holds.

    Equal alleles become one, and PL moves to OPL; different alleles get a filter; other genotypes stay.
    """
    gt = R.try_gt(R.sample_value("GT"))
    diploid = where & (F.size(gt) == 2)
    rows = rows.withColumns({"_same": F.coalesce(diploid & (F.get(gt, F.lit(0)) == F.get(gt, F.lit(1))), F.lit(False)), "_differ": F.coalesce(diploid & (F.get(gt, F.lit(0)) != F.get(gt, F.lit(1))), F.lit(False))})
    allele = F.when(F.get(gt, F.lit(0)) >= 0, F.get(gt, F.lit(0)).cast("string")).otherwise(F.lit("."))
    format, sample = R.sample_set("GT", allele)
    rows = rows.withColumns({"format": F.when(F.col("_same"), format).otherwise(F.col("format")), "sample": F.when(F.col("_same"), sample).otherwise(F.col("sample"))})
    rows = rows.withColumn("_pl", F.when(F.col("_same"), R.sample_value("PL")))
    format, sample = R.sample_set(ORIGINAL_PL, F.col("_pl"))
    rows = rows.withColumns({"format": F.when(F.col("_pl").isNotNull(), format).otherwise(F.col("format")), "sample": F.when(F.col("_pl").isNotNull(), sample).otherwise(F.col("sample"))})
    format, sample = R.sample_delete("PL")
    rows = rows.withColumns({"format": F.when(F.col("_pl").isNotNull(), format).otherwise(F.col("format")), "sample": F.when(F.col("_pl").isNotNull(), sample).otherwise(F.col("sample"))})
    return rows.withColumn("filter", F.when(F.col("_differ"), R.filter_add("filter", HAPLOID_CONFLICT)).otherwise(F.col("filter"))).drop("_same", "_differ", "_pl")


def set_haploid(records: DataFrame, regions: DataFrame, reference: DataFrame) -> DataFrame:
    """Records with diploid calls rewritten as haploid inside regions; blocks are cut at the borders."""
    return _result(by_region(records, regions, reference, lambda rows: haploid(rows, F.col("in_region"))), records.columns)


def reference_conflicts(records: DataFrame, reference: DataFrame) -> DataFrame:
    """Records whose REF is not the (standardised) reference at their place, with ``expected``, null past a contig's end."""
    key = ["line_no"]
    found = ref.with_slice(records, ref.standardized(reference), key, F.length("ref"), name="expected")
    return found.filter(~F.col("ref").eqNullSafe(F.col("expected")))


def check_reference(records: DataFrame, reference: DataFrame) -> None:
    """Raise for the first record, in file order, whose REF conflicts with the reference."""
    first = reference_conflicts(records, reference).orderBy("line_no").limit(1).collect()
    if first:
        row = first[0]
        at = f"{row['chrom']}:{row['pos']}"
        raise ValueError(f"REF {row['ref']!r} at {at} is past the contig's end" if row["expected"] is None else f"REF {row['ref']!r} conflicts with the reference {row['expected']!r} at {at}")


def extract_variants(records: DataFrame, invert: bool = False) -> DataFrame:
    """Records with a called alternate allele, or all others."""
    return records.filter(~R.is_variant_record() if invert else R.is_variant_record())
