"""Concordance of twins (or replicates) and of trios: merge by position, counters, events and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import sites as S
from strandloom.sources import reference as ref

# The labels of reports, in their order.
CHILD_HET = "P(child-het|parent-samehet) for non-conflicting snps (neutral site expect 1/2)"
PARENT_SAME_HET = "P(parent-samehet|(parent-samehet or parent-diffhom)) for non-conflicting snps (neutral site expect 2/3)"
STATES = ("samehom", "diffhom", "samehet", "diffhet", "homhet")
CHILD = ("hom", "het")
TWINS = ("twin1", "twin2")
TRIO = ("mother", "father", "child")


def prepared(records: DataFrame, reference: DataFrame, options: S.CallOptions = S.CallOptions(), exclude: list[str] | None = None, region: tuple[str, int | None, int | None] | None = None, drop_overlaps: bool = False) -> DataFrame:
    """Sites of all samples on the (standardised) reference, without positions where it is N; unordered or overlapping records
    are an error unless they are dropped, and positions beyond a contig always are."""
    found = S.settled(records, reference, options, exclude or [], region, drop_overlaps, indels=False, more=("raw",))
    return S.spread(found, ref.standardized(reference), region=region).filter("ref_base <> 'N'")


def merged(sites: DataFrame, samples: tuple[str, ...]) -> DataFrame:
    """One row for each position: ``chrom, pos, ref_base``, and for each sample ``<name>_mapped, _called, _a1, _a2, _raw``.

    A full outer merge of any number of samples as one aggregation, so one shuffle by position. A sample has one row at most
    for a position, so rows are dealt out as they are (nothing to aggregate before), and lines apart, for those who read them.
    """
    sites = sites.select("sample_id", "chrom", F.col("site_pos").alias("pos"), "ref_base", "depth", "called", F.get("alleles", F.lit(0)).alias("a1"), F.get("alleles", F.lit(1)).alias("a2"), "raw" if "raw" in sites.columns else F.lit(None).cast("string").alias("raw"))
    own = lambda k, value: F.max(F.when(F.col("sample_id") == k, value))
    parts = [own(k, F.struct("depth", "called", "a1", "a2")).alias(f"_{name}") for k, name in enumerate(samples)]
    lines = [own(k, F.col("raw")).alias(f"{name}_raw") for k, name in enumerate(samples)]
    rows = sites.repartition("chrom", "pos").groupBy("chrom", "pos").agg(F.first("ref_base").alias("ref_base"), *parts, *lines)
    columns = [F.col("chrom"), F.col("pos"), F.col("ref_base")]
    for name in samples:
        own = F.col(f"_{name}")
        columns += [F.coalesce(own["depth"] != 0, F.lit(False)).alias(f"{name}_mapped"), F.coalesce(own["called"], F.lit(False)).alias(f"{name}_called"), own["a1"].alias(f"{name}_a1"), own["a2"].alias(f"{name}_a2"), F.col(f"{name}_raw")]
    return rows.select(*columns)


def _state(hom_a: Column, hom_b: Column, a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    """How two genotypes relate; the order of alleles counts for heterozygous ones."""
    return F.when(hom_a != hom_b, "homhet").when(hom_a, F.when(a1 == b1, "samehom").otherwise("diffhom")).otherwise(F.when((a1 == b1) & (a2 == b2), "samehet").otherwise("diffhet"))


def _judged(rows: DataFrame, samples: tuple[str, ...]) -> DataFrame:
    every = lambda kind: [F.col(f"{name}_{kind}") for name in samples]
    all_of, any_of = (lambda flags: F.forall(F.array(*flags), lambda x: x)), (lambda flags: F.exists(F.array(*flags), lambda x: x))
    rows = rows.withColumns({"all_mapped": all_of(every("mapped")), "any_mapped": any_of(every("mapped")), "all_called": all_of(every("called")), "any_called": any_of(every("called"))})
    for name in samples:
        a1, a2, base = F.col(f"{name}_a1"), F.col(f"{name}_a2"), F.col("ref_base")
        rows = rows.withColumns({f"{name}_hom": a1 == a2, f"{name}_snp": F.col(f"{name}_called") & ~((a1 == base) & (a2 == base))})
    return rows


def twin_sites(rows: DataFrame, samples: tuple[str, str] = TWINS) -> DataFrame:
    """Merged positions with ``consistent, state, snp``, null unless both are called."""
    a, b = samples
    rows = _judged(rows, samples)
    c = lambda name: F.col(name)
    consistent = ((c(f"{a}_a1") == c(f"{b}_a1")) & (c(f"{a}_a2") == c(f"{b}_a2"))) | ((c(f"{a}_a2") == c(f"{b}_a1")) & (c(f"{a}_a1") == c(f"{b}_a2")))
    state = _state(c(f"{a}_hom"), c(f"{b}_hom"), c(f"{a}_a1"), c(f"{b}_a1"), c(f"{a}_a2"), c(f"{b}_a2"))
    reference_call = c(f"{a}_hom") & c(f"{b}_hom") & (c(f"{a}_a1") == c("ref_base"))
    rows = rows.withColumn("consistent", F.when(c("all_called"), consistent))
    return rows.withColumns({"state": F.when(c("all_called"), state), "snp": F.when(c("all_called"), ~c("consistent") | ~reference_call)})


def trio_sites(rows: DataFrame, samples: tuple[str, str, str] = TRIO) -> DataFrame:
    """Merged positions with ``consistent`` (the child can have its alleles from both parents), ``state`` of the parents,
    ``child_state``, ``snp``, ``same_het`` and ``hethet_hom``, null unless all are called."""
    m, f, k = samples
    rows = _judged(rows, samples)
    c = lambda name, part: F.col(f"{name}_{part}")
    in_f, in_m = (lambda a: (a == c(f, "a1")) | (a == c(f, "a2"))), (lambda a: (a == c(m, "a1")) | (a == c(m, "a2")))
    consistent = (in_f(c(k, "a1")) & in_m(c(k, "a2"))) | (in_m(c(k, "a1")) & in_f(c(k, "a2")))
    called = F.col("all_called")
    state = _state(c(m, "hom"), c(f, "hom"), c(m, "a1"), c(f, "a1"), c(m, "a2"), c(f, "a2"))
    reference_call = c(k, "hom") & c(m, "hom") & c(f, "hom") & (c(k, "a1") == F.col("ref_base"))
    hets = ~c(m, "hom") & ~c(f, "hom")
    alike = (c(m, "a1") == c(f, "a1")) & (c(m, "a1") == c(k, "a1")) & (c(m, "a2") == c(f, "a2")) & (c(m, "a2") == c(k, "a2"))
    rows = rows.withColumn("consistent", F.when(called, consistent))
    rows = rows.withColumns({"state": F.when(called, state), "child_state": F.when(called, F.when(c(k, "hom"), "hom").otherwise("het")), "snp": F.when(called, ~F.col("consistent") | ~reference_call)})
    good = called & F.col("consistent") & F.col("snp")
    return rows.withColumns({"same_het": good & hets & ~c(k, "hom") & alike, "hethet_hom": good & hets & c(k, "hom") & (c(k, "a1") != F.col("ref_base"))})


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, True))


def counters(judged: DataFrame, samples: tuple[str, ...], trio: bool) -> DataFrame:
    """All counters of a report in one row, by one aggregation."""
    good = F.col("all_called") & F.col("consistent") & F.col("snp")
    bad = F.col("all_called") & ~F.col("consistent")
    sums = [
        _count(F.col("any_mapped") & ~F.col("all_mapped")).alias("some_mapped"),
        _count(F.col("all_mapped")).alias("all_mapped"),
        _count(F.col("any_called") & ~F.col("all_called")).alias("some_called"),
        _count(F.col("all_called")).alias("all_called"),
        _count(bad).alias("incorrect"),
        _count(good).alias("snp_correct"),
    ]
    for name in samples:
        sums += [
            _count(F.col(f"{name}_mapped")).alias(f"mapped_{name}"),
            _count(F.col(f"{name}_called")).alias(f"called_{name}"),
            _count(F.col(f"{name}_snp")).alias(f"snp_{name}"),
            _count(F.col(f"{name}_snp") & ~F.col(f"{name}_hom")).alias(f"snp_het_{name}"),
            _count(good & ~F.col(f"{name}_hom")).alias(f"correct_het_{name}"),
            _count(good & F.col(f"{name}_hom") & (F.col(f"{name}_a1") != F.col("ref_base"))).alias(f"correct_hom_{name}"),
        ]
    for state in STATES:
        for child in CHILD if trio else ("",):
            here = F.col("state") == state
            here = here & (F.col("child_state") == child) if trio else here
            tail = f"{state}_{child}" if trio else state
            sums += [_count(bad & here).alias(f"conflict_{tail}"), _count(good & here).alias(f"agree_{tail}")]
    return judged.agg(*sums)


def _ratio(n: int, d: int) -> float:
    return n / d if d else 0.0


def report(row: dict, size: int, known: int, samples: tuple[str, ...], trio: bool) -> list[tuple[str, str]]:
    """The report's lines as (metric, value), numbers with six significant digits."""
    if known < row["some_mapped"] + row["all_mapped"]:
        raise ValueError(f"known sites ({known}) are fewer than mapped sites")
    g = "{:g}".format
    out: list[tuple[str, str]] = [("sites", str(size)), ("known_sites", str(known))]
    out += [(f"sites_mapped_{name}", str(row[f"mapped_{name}"])) for name in samples]
    out += [("sites_mapped_in_no_samples", str(known - row["some_mapped"] - row["all_mapped"])), ("sites_mapped_in_some_samples", str(row["some_mapped"])), ("sites_mapped_in_all_samples", str(row["all_mapped"]))]
    out += [(f"sites_called_{name}", str(row[f"called_{name}"])) for name in samples]
    out += [("sites_called_in_no_samples", str(known - row["some_called"] - row["all_called"])), ("sites_called_in_some_samples", str(row["some_called"])), ("sites_called_in_all_samples", str(row["all_called"])), ("sites_called_in_all_samples_conflict", str(row["incorrect"]))]
    out += [("fraction_of_known_sites_called_in_all_samples", g(_ratio(row["all_called"], known))), ("fraction_of_sites_called_in_all_samples_in_conflict", g(_ratio(row["incorrect"], row["all_called"])))]
    snps = row["snp_correct"] + row["incorrect"]

    def hets(label: str, name: str, het: int, hom: int) -> tuple[str, str]:
        return f"{label}_total_het_hom_het/hom_P(het)_{name}", f"{het + hom} {het} {hom} {g(_ratio(het, hom))} {g(_ratio(het, het + hom))}"

    out += [hets("sites_with_snps_called", name, row[f"snp_het_{name}"], row[f"snp_{name}"] - row[f"snp_het_{name}"]) for name in samples]
    out += [("sites_called_in_all_samples_with_snps_called_any_sample", str(snps)), ("fraction_of_snp_sites_in_conflict", g(_ratio(row["incorrect"], snps)))]
    out += [hets("snp_non_conflict", name, row[f"correct_het_{name}"], row[f"correct_hom_{name}"]) for name in samples]
    for label, kind in (("snp_conflict_type", "conflict"), ("snp_non_conflict_type", "agree")):
        for state in STATES:
            if trio:
                out += [(f"{label}_parent-{state}_child-{child}", str(row[f"{kind}_{state}_{child}"])) for child in CHILD]
            else:
                out.append((f"{label}_{state}", str(row[f"{kind}_{state}"])))
    if trio:
        same = row["agree_samehet_het"] + row["agree_samehet_hom"]
        diff = row["agree_diffhom_het"] + row["agree_diffhom_hom"]
        out.append((CHILD_HET, g(_ratio(row["agree_samehet_het"], same))))
        out.append((PARENT_SAME_HET, g(_ratio(same, same + diff))))
    return out


def report_frame(spark: SparkSession, lines: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(k, metric, value) for k, (metric, value) in enumerate(lines)], "line int, metric string, value string")


def event_lines(rows: DataFrame, samples: tuple[str, ...]) -> DataFrame:
    """Event rows as text, in order of ``chrom, pos, k``: an EVENT line, then each sample's label and record."""
    parts = [F.concat(F.lit("EVENT\t"), F.col("chrom"), F.lit("\t"), F.col("pos").cast("string"))] + [F.concat(F.lit(f"{name}\t\t"), F.coalesce(F.col(f"{name}_raw"), F.lit(""))) for name in samples]
    return rows.select("chrom", "pos", F.posexplode(F.array(*parts)).alias("k", "value"))


def twins(records: DataFrame, reference: DataFrame, options: S.CallOptions = S.CallOptions(), samples: tuple[str, str] = TWINS, exclude: list[str] | None = None, region: tuple[str, int | None, int | None] | None = None, drop_overlaps: bool = False) -> tuple[DataFrame, DataFrame]:
    """Judged positions of two samples (``sample_id`` 0 and 1), and the counters' row."""
    judged = twin_sites(merged(prepared(records, reference, options, exclude, region, drop_overlaps), samples), samples)
    return judged, counters(judged, samples, trio=False)


def trio(records: DataFrame, reference: DataFrame, options: S.CallOptions = S.CallOptions(), samples: tuple[str, str, str] = TRIO, exclude: list[str] | None = None, region: tuple[str, int | None, int | None] | None = None, drop_overlaps: bool = False) -> tuple[DataFrame, DataFrame]:
    """Judged positions of mother, father and child (``sample_id`` 0, 1 and 2), and the counters' row."""
    judged = trio_sites(merged(prepared(records, reference, options, exclude, region, drop_overlaps), samples), samples)
    return judged, counters(judged, samples, trio=True)

