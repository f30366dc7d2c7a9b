"""Merging of samples into one multi-sample file of variant loci."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import records as R
from strandloom.operators import sites as S
from strandloom.sources import reference as ref


def _codes(alleles: Column, own: Column) -> Column:
    """Genotype text of a sample's alleles by their places in the locus's list."""
    return F.array_join(F.transform(own, lambda a: (F.array_position(alleles, a) - 1).cast("string")), "/")


def loci(records: DataFrame, reference: DataFrame, options: S.CallOptions = S.CallOptions(), exclude: list[str] | None = None, region: tuple[str, int | None, int | None] | None = None, drop_overlaps: bool = False) -> DataFrame:
    """One row for each position and kind (``chrom, pos, is_indel, ref_base``) with ``samples``: what each sample has there, by sample.

    Unordered or overlapping records are an error unless they are dropped.
    """
    records = S.settled(records, reference, options, exclude or [], region, drop_overlaps, indels=True, more=("filter", "format", "sample"))
    found = S.spread(records, ref.standardized(reference), indels=True, region=region)
    own = F.struct("sample_id", "called", "alleles", "ref", "filter", "format", "sample")
    return found.groupBy("chrom", F.col("site_pos").alias("pos"), "is_indel").agg(F.first("ref_base").alias("ref_base"), F.array_sort(F.collect_list(own)).alias("samples"))


def variant_loci(found: DataFrame) -> DataFrame:
    """Loci that the merged file has: every indel, and sites with a called allele other than the reference, which isn't N."""
    varies = F.exists("samples", lambda s: s["called"] & F.exists(s["alleles"], lambda a: a != F.col("ref_base")))
    return found.filter(F.col("is_indel") | ((F.col("ref_base") != "N") & varies))


def merged_records(found: DataFrame, n_samples: int) -> DataFrame:
    """Loci as records: ``chrom, pos, is_indel, id, ref, alt, qual, filter, info, format, genotypes``.

    Alleles are numbered as they are met, sample by sample, after the reference. An indel's REF is the longest one (the
    first of equals), and alleles of shorter ones get its rest. FILTER and FORMAT are unions in the order met; genotypes are
    numbered anew, a sample that isn't there is ``.``, and an unknown allele makes a site's genotype ``.`` and counts as 0 in an
    indel's.
    """
    longest = F.aggregate("samples", F.lit(""), lambda held, s: F.when(F.length(s["ref"]) > F.length(held), s["ref"]).otherwise(held))
    rows = found.withColumn("ref", F.when(F.col("is_indel"), longest).otherwise(F.col("ref_base")))
    full = F.transform(
        "samples",
        lambda s: F.when(F.col("is_indel"), F.transform(s["alleles"], lambda a: F.when(a == "X", a).otherwise(F.concat(a, F.substr(F.col("ref"), F.length(s["ref"]) + 1))))).otherwise(s["alleles"]),
    )
    rows = rows.withColumn("own", full)
    unknown = F.when(F.col("is_indel"), F.lit("X")).otherwise(F.lit("N"))
    rows = rows.withColumn("dictionary", F.array_distinct(F.concat(F.array("ref"), F.filter(F.flatten("own"), lambda a: a != unknown))))
    own = F.transform("own", lambda alleles: F.when(F.col("is_indel"), _codes(F.col("dictionary"), F.transform(alleles, lambda a: F.when(a == "X", F.col("ref")).otherwise(a)))).when(F.exists(alleles, lambda a: a == "N"), F.lit(".")).otherwise(_codes(F.col("dictionary"), alleles)))
    rows = rows.withColumn("codes", own)
    labels = F.array_distinct(F.filter(F.flatten(F.col("samples.filter")), lambda f: f != "PASS"))
    rows = rows.withColumns({"filter": R.filter_default(labels), "format": F.array_distinct(F.flatten(F.col("samples.format")))})

    def value(s: Column, code: Column, key: Column) -> Column:
        at = F.array_position(s["format"], key)
        return F.when(at <= 0, F.lit(".")).when(key == "GT", code).otherwise(F.coalesce(F.get(s["sample"], (at - 1).cast("int")), F.lit(".")))

    paired = F.arrays_zip(F.col("samples").alias("s"), F.col("codes").alias("code"))
    rows = rows.withColumn("paired", paired)

    def genotype(k: Column) -> Column:
        here = F.filter("paired", lambda p: p["s"]["sample_id"] == k)
        p = F.get(here, F.lit(0))
        text = F.array_join(F.transform("format", lambda key: value(p["s"], p["code"], key)), ":")
        return F.when((F.size(here) > 0) & (F.size("format") > 0), text).otherwise(F.lit("."))

    genotypes = F.array(*[genotype(F.lit(k)) for k in range(n_samples)])
    alt = F.slice("dictionary", 2, F.greatest(F.size("dictionary") - 1, F.lit(0)))
    return rows.select("chrom", "pos", "is_indel", F.lit(".").alias("id"), "ref", alt.alias("alt"), F.lit(".").alias("qual"), "filter", R.empty().alias("info"), "format", genotypes.alias("genotypes"))


def merge_variants(records: DataFrame, reference: DataFrame, n_samples: int, options: S.CallOptions = S.CallOptions(), **choices) -> DataFrame:
    """The merged file's records; order them by contig, ``pos`` and ``is_indel``."""
    return merged_records(variant_loci(loci(records, reference, options, **choices)), n_samples)


def line_of() -> Column:
    parts = ["chrom", F.col("pos").cast("string"), "id", "ref", R.unlisted("alt", ","), "qual", R.unlisted("filter", ";"), R.unlisted("info", ";"), R.unlisted("format", ":"), F.array_join("genotypes", "\t")]
    return F.concat_ws("\t", *parts)
