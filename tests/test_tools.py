"""Small fixtures worked out by hand, from files to files."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from strandloom import cli
from strandloom.functions import records as R
from strandloom.operators import blocks, concordance, filters, intervals, merge, sites
from strandloom.sources import reference as ref
from strandloom.sources import regions, vcf


def lines_frame(spark, rows):
    return spark.createDataFrame([(k, "\t".join(row.split(" "))) for k, row in enumerate(rows)], "line_no long, value string")


def records(spark, *rows, tool="block"):
    return vcf.parse_records(lines_frame(spark, rows), tool)


def written(df, order="line_no"):
    return [row["line"].replace("\t", " ") for row in df.orderBy(*([order] if isinstance(order, str) else order)).select(vcf.line_of().alias("line")).collect()]


def bed(spark, *rows):
    return regions.parse_bed(spark.createDataFrame([(row,) for row in rows], "value string"))


@pytest.fixture(scope="module")
def genome(spark):
    return ref.from_sequences(spark, {"chr1": "acgtRNACGTACGTACGT", "chr2": "AAAAA"}, chunk=ref.CHUNK)


def test_called_regions(spark):
    rows = records(
        spark,
        "chr1 1 . A . . PASS END=10 GT 0/0",
        "chr1 11 . C . . PASS . GT 0/0",
        "chr1 12 . G . . LowGQX . GT 0/0",
        "chr1 13 . A T . PASS . GT 0/1",
        "chr1 14 . A AT . PASS . GT 0/1",
        "chr1 14 . ACG A . PASS . GT 0/1",
    )
    assert sorted(map(tuple, intervals.called_regions(rows).collect())) == [("chr1", 0, 11), ("chr1", 12, 13), ("chr1", 14, 16)]


def test_regions_split_blocks(spark, genome):
    rows = records(spark, "chr1 1 . A . . PASS END=10 GT:PL 0/0:5", tool="region")
    cut = bed(spark, "track x", "chr1 3 5")
    place = lambda df: [(r["pos"], next((i for i in r["info"] if i.startswith("END")), None)) for r in df.orderBy("piece", "pos").collect()]
    assert place(intervals.break_blocks(rows, cut, genome)) == [(1, "END=3"), (4, None), (5, None), (6, "END=10")]
    assert place(intervals.break_blocks(rows, cut, genome, exclude_off_target=True)) == [(4, None), (5, None)]
    assert place(intervals.remove_region(rows, cut, genome)) == [(1, "END=3"), (6, "END=10")]
    haploid = intervals.set_haploid(rows, cut, genome).orderBy("piece").collect()
    assert [(r["pos"], r["format"], r["sample"]) for r in haploid] == [(1, ["GT", "PL"], ["0/0", "5"]), (4, ["GT", "OPL"], ["0", "5"]), (6, ["GT", "PL"], ["0/0", "5"])]
    assert [r["ref"] for r in haploid] == ["A", "t", "N"]
    assert place(intervals.remove_region(rows, bed(spark, "chr1 5 5"), genome)) == [(1, "END=5"), (6, "END=10")]


def test_block_compression(spark):
    depths = [30, 31, 33, 40, 10, 0]
    rows = records(spark, *[f"chr1 {k + 1} . A . 60 . MQ=60 GT:GQ:DP 0/0:60:{dp}" for k, dp in enumerate(depths)])
    found, _ = blocks.block_vcf(rows)
    assert written(found, "pos") == [
        "chr1 1 . A . . PASS END=3;BLOCKAVG_min30p3a GT:DP:GQX:MQ 0/0:30:60:60",
        "chr1 4 . A . . PASS . GT:DP:GQX:MQ 0/0:40:60:60",
        "chr1 5 . A . . PASS . GT:DP:GQX:MQ 0/0:10:60:60",
        "chr1 6 . A . . PASS . GT 0/0",
    ]


def test_default_filters(spark):
    rows = records(spark, "chr1 1 . A G 15 PASS MQ=19.6;QD=3.0;AC=1;DP=30 GT:GQ 0/1:99")
    assert written(filters.write_gqx(filters.groom(rows))) == ["chr1 1 . A G 15 LowGQX;LowQD MQ=20;QD=3.0;DP=30 GT:GQ:MQ:GQX 0/1:99:20:15"]


def test_options(spark):
    options = filters.BlockOptions().with_thresholds(no_defaults=True, min_qd="5")
    assert options.min_gqx is None and [each.label for each in options.thresholds] == ["LowQD"]
    with pytest.raises(ValueError, match="unknown filters"):
        filters.BlockOptions().with_thresholds(x="1")


def test_het_deletion(spark):
    head = ["chr1 10 . ACG A 50 PASS . GT:GQ:PL 0/1:50:1"]
    sites_ = ["chr1 11 . C . 50 PASS . GT:GQ:PL 0/0:50:2", "chr1 12 . G T 50 PASS . GT:GQ:PL 0/1:50:3", "chr1 13 . T . 50 PASS . GT:GQ:PL 0/0:50:4"]
    got = written(blocks.groom_buffers(filters.groom(records(spark, *head, *sites_))))
    assert got == [head[0], "chr1 11 . C . 50 PASS . GT:GQ 0:50", "chr1 12 . G T . SiteConflict;LowGQX . GT .", sites_[2]]
    both = written(blocks.groom_buffers(filters.groom(records(spark, head[0].replace("0/1", "1/1"), *sites_))))
    assert both[1] == "chr1 11 . C . . LowGQX . GT ." and both[2] == "chr1 12 . G T . LowGQX . GT ." and both[3] == sites_[2]
    # the next indel closes the buffer, which then is left as it is
    after = written(blocks.groom_buffers(filters.groom(records(spark, head[0], sites_[0], "chr1 12 . GT G 50 PASS . GT:GQ:PL 0/1:50:9"))))
    assert after[1] == sites_[0]


def sequential_buffers(rows):
    """Buffers by the record-at-a-time rule: (number, buffered) of each (pos, indel, ref length)."""
    start = end = number = 0
    out = []
    for pos, indel, size in rows:
        if indel:
            inside = not (pos + 2 > end or pos + size < start)
            number += not inside
            start = min(start, pos + 1) if inside else pos + 1
            end = max(end, pos + size - 1)
            out.append((number, True))
        else:
            out.append((number, bool(number) and pos <= end))
    return out


def test_buffers_against_sequential_rule(spark):
    import random

    rnd = random.Random(5)
    rows, pos = [], 1
    for _ in range(400):
        pos += rnd.randint(1, 3)
        indel = rnd.random() < 0.3
        rows.append((pos, indel, rnd.randint(2, 7) if indel else 1))
    frame = records(spark, *[f"chr1 {p} . {'A' * n} {'A' if i else '.'} 50 PASS . GT 0/1" for p, i, n in rows])
    got = blocks.with_buffers(frame, width=64).orderBy("line_no").collect()
    assert [(r["buffer"], r["buffered"]) for r in got] == sequential_buffers(rows)


def test_reference_check(spark, genome):
    bad = records(spark, "chr1 1 . a . . . .", "chr1 5 . R . . . .", tool="check")
    good = records(spark, "chr1 1 . A . . . .", "chr1 5 . N . . . .", "chr1 3 . GT . . . .", tool="check")
    intervals.check_reference(good, genome)
    assert intervals.reference_conflicts(bad, genome).count() == 2
    with pytest.raises(ValueError, match="chr1:1"):
        intervals.check_reference(bad, genome)
    with pytest.raises(ValueError, match="past the contig's end"):
        intervals.check_reference(records(spark, "chr1 900 . A . . . .", tool="check"), genome)


def test_murdock(spark):
    rows = records(spark, "chr1 1 . A . . PASS END=10 GT 0/0", "chr1 5 . A . . PASS END=20 GT 0/0", "chr1 15 . A . . PASS END=18 GT 0/0", tool="multi").withColumn("sample_id", F.lit(0))
    assert [r["pos"] for r in sites.murdock(sites.with_locus(rows)).orderBy("pos").collect()] == [1, 15]
    assert sites.order_conflicts(sites.with_locus(rows)).count() == 2


def test_merge(spark):
    genome = ref.from_sequences(spark, {"chr1": "ACGTAACCGT"})
    first = records(spark, "chr1 5 . A G . PASS . GT:DP 0/1:20", "chr1 7 . ACC A . PASS . GT 0/1", tool="multi").withColumn("sample_id", F.lit(0))
    second = records(spark, "chr1 1 . A . . PASS END=6 GT:GQX 0/0:50", "chr1 7 . AC A . PASS . GT 0/1", tool="multi").withColumn("sample_id", F.lit(1))
    got = [r["line"].replace("\t", " ") for r in merge.merge_variants(first.unionByName(second), genome, 2).orderBy("pos").select(merge.line_of().alias("line")).collect()]
    assert got == ["chr1 5 . A G . PASS . GT:DP:GQX 0/1:20:. 0/0:.:50", "chr1 7 . ACC A,AC . PASS . GT 0/1 0/2"]


def test_malformed_lines(spark):
    for row, what in (("chr1 1 . A .", "too few"), ("chr1 x . A . . . .", "position"), ("chr1 1 . A . . . . GT 0/0:3", "do not agree")):
        with pytest.raises(Exception, match=what):
            records(spark, row).collect()
    assert records(spark, "chr1 1 . A . . . . GT:DP 0/0").first()["sample"] == ["0/0", "."]


def test_region_text():
    assert vcf.parse_region("chr1") == ("chr1", None, None)
    assert vcf.parse_region("chr1:1,000-2,000") == ("chr1", 1000, 2000)
    with pytest.raises(ValueError, match="can't parse"):
        vcf.parse_region("chr1:5-2")


def read(path):
    return [line.rstrip("\n") for part in sorted(glob.glob(f"{path}/part-*")) for line in open(part)]


HEADER = ["##fileformat=VCFv4.1", "##INFO=<ID=AC,Number=A>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1"]


def save(path, rows):
    path.write_text("\n".join([*HEADER, *("\t".join(row.split(" ")) for row in rows)]) + "\n")
    return str(path)


def test_command_line(spark, tmp_path):
    fasta = tmp_path / "g.fa"
    fasta.write_text(">chr1 x\nACGT\nAACCGT\n>chr2\nAAAA\n")
    source = save(tmp_path / "a.vcf", ["chr1 1 . A . 60 . MQ=60 GT:GQ:DP 0/0:60:30", "chr1 2 . C . 60 . MQ=60 GT:GQ:DP 0/0:60:30", "chr1 5 . A G 60 PASS MQ=60;QD=9 GT:GQ:DP 0/1:60:30"])
    assert cli.main(["check_reference", source, "--ref", str(fasta)], spark) == 0
    cli.main(["extract_variants", source, str(tmp_path / "v")], spark)
    assert read(tmp_path / "v") == [*HEADER, "chr1\t5\t.\tA\tG\t60\tPASS\tMQ=60;QD=9\tGT:GQ:DP\t0/1:60:30"]
    cli.main(["gatk_to_gvcf", source, str(tmp_path / "b")], spark)
    out = read(tmp_path / "b")
    assert not any("ID=AC" in line for line in out) and any("LowGQX" in line for line in out)
    assert out[-2].startswith("chr1\t1\t.\tA\t.\t.\tPASS\tEND=2;BLOCKAVG")
    bed_file = tmp_path / "r.bed"
    bed_file.write_text("chr1\t0\t1\n")
    cli.main(["remove_region", source, str(tmp_path / "r"), "--region-file", str(bed_file), "--ref", str(fasta)], spark)
    assert [line.split("\t")[1] for line in read(tmp_path / "r") if not line.startswith("#")] == ["2", "5"]
    other = save(tmp_path / "c.vcf", ["chr1 5 . A G 60 PASS . GT:GQ:DP 1/0:60:30"])
    cli.main(["twins", str(tmp_path / "t"), "--ref", str(fasta), "--twin1", source, "--twin2", other, "--no-variable-metadata", "--conflict-file", str(tmp_path / "e")], spark)
    report = dict(line.split(": ", 1) for line in read(tmp_path / "t") if ": " in line)
    assert report["sites"] == "14" and report["snp_non_conflict_type_diffhet"] == "1" and report["sites_called_in_all_samples"] == "1"
    assert report["snp_non_conflict_total_het_hom_het/hom_P(het)_twin1"] == "1 1 0 0 1"
    cli.main(["merge_variants", str(tmp_path / "m"), "--ref", str(fasta), "--input", source, "--input", other], spark)
    assert read(tmp_path / "m")[-1] == "chr1\t5\t.\tA\tG\t.\tPASS\t.\tGT:GQ:DP\t0/1:60:30\t1/0:60:30"
    cli.main(["get_called_regions", source, str(tmp_path / "k")], spark)
    assert read(tmp_path / "k") == ["chr1\t4\t5"]


def test_order_conflicts_reach_over_bins(spark):
    rnd = random.Random(7)
    rows, pos = [], 0
    for k in range(300):
        pos += rnd.choice((1, 4, 4, 90, 70_000))
        at = max(1, pos - (200_000 if rnd.random() < 0.05 else 0))
        rows.append((k % 2, "chr1" if k < 200 else "chr2", k, at, at + rnd.choice((0, 3, 100, 80_000)), rnd.random() < 0.2))
    want, last = [], {}
    for sample, chrom, k, at, end, indel in rows:
        before = last.get((sample, chrom))
        if before and (at, indel) <= before:
            want.append(k)
        last[sample, chrom] = (end, indel)
    df = spark.createDataFrame(rows, "sample_id int, chrom string, line_no long, pos long, locus_end long, is_indel boolean").repartition(3)
    assert want
    placed = df.withColumn("line_no", F.struct(F.floor(F.col("line_no") / 100).alias("start"), F.col("line_no").alias("row")))
    for width in (7, 1 << 16):
        assert sorted(r["line_no"] for r in sites.order_conflicts(df, width).collect()) == want
        assert sorted(r["line_no"]["row"] for r in sites.order_conflicts(placed, width).collect()) == want


def test_overlaps_are_refused_unless_dropped(spark):
    genome = ref.from_sequences(spark, {"chr1": "ACGTAACCGT"})
    both = [records(spark, *rows, tool="multi").withColumn("sample_id", F.lit(k)) for k, rows in enumerate([("chr1 1 . A . . PASS END=6 GT:DP 0/0:9", "chr1 5 . A G . PASS . GT:DP 0/1:20"), ("chr1 1 . A . . PASS END=10 GT:DP 0/0:9",)])]
    rows = both[0].unionByName(both[1])
    for tool in (lambda **choices: merge.loci(rows, genome, **choices), lambda **choices: concordance.twins(rows, genome, **choices)[0]):
        with pytest.raises(ValueError, match="sample 0: chr1:5"):
            tool()
        assert tool(drop_overlaps=True).count() == tool(region=("chr1", 7, 10)).count() + 6


def test_positions_beyond_contigs_are_refused(spark):
    genome = ref.from_sequences(spark, {"chr1": "ACGTAACCGT"})
    good = records(spark, "chr1 1 . A . . PASS . GT:DP 0/0:9", tool="multi").withColumn("sample_id", F.lit(0))
    for text, message in (("chr1 11 . A . . PASS . GT:DP 0/0:9", "beyond the end of its contig: chr1:11"), ("chr1 0 . A . . PASS . GT:DP 0/0:9", "position less than 1: chr1:0")):
        rows = good.unionByName(records(spark, text, tool="multi").withColumn("sample_id", F.lit(1)))
        for tool in (lambda **choices: merge.loci(rows, genome, **choices), lambda **choices: concordance.twins(rows, genome, **choices)[0]):
            for drop in (False, True):
                with pytest.raises(Exception, match=message):
                    tool(drop_overlaps=drop).collect()
    beyond = good.unionByName(records(spark, "chr1 11 . A . . PASS . GT:DP 0/0:9", tool="multi").withColumn("sample_id", F.lit(1)))
    assert concordance.twins(beyond, genome, region=("chr1", 1, 4))[0].count() == 1


def test_slices_over_chunks(spark):
    rnd = random.Random(4)
    text = "".join(rnd.choice("ACGT") for _ in range(23))
    rows = [(k, "chr1" if k % 7 else "chr9", rnd.randint(0, 25), rnd.randint(0, 12)) for k in range(120)]
    df = spark.createDataFrame(rows, "line_no long, chrom string, pos long, n int")
    for chunk in (4, 100):
        genome = ref.from_sequences(spark, {"chr1": text}, chunk=chunk)
        got = {r["line_no"]: r["ref_slice"] for r in ref.with_slice(df, genome, ["line_no"], F.col("n"), chunk=chunk).collect()}
        assert len(got) == len(rows)
        for key, chrom, pos, n in rows:
            if pos >= 1:
                assert got[key] == ((text[pos - 1 : pos - 1 + n] or None) if chrom == "chr1" else None), (chunk, pos, n)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_parsed_once_for_check_and_tool(spark):
    genome = ref.from_sequences(spark, {"chr1": "ACGTAACCGT"})
    rows = records(spark, "chr1 1 . A . . PASS END=6 GT:DP 0/0:9", "chr1 7 . C T . PASS . GT:DP 0/1:9", tool="multi").withColumn("sample_id", F.lit(0))
    rows = rows.unionByName(rows.withColumn("sample_id", F.lit(1)))
    for found in (concordance.twins(rows, genome)[0], merge.loci(rows, genome)):
        assert "split(value" not in plan_of(found) and found.count() == 7
    judged = plan_of(concordance.twins(rows, genome)[0].select("chrom", "pos", "state"))
    assert not any("raw" in line for line in judged.splitlines() if "Aggregate" in line)  # lines go to those who read them


def test_base_lookups_walk_over_short_pieces(spark):
    rnd = random.Random(9)
    text = "".join(rnd.choice("ACGTN") for _ in range(ref.CHUNK + 3 * ref.PIECE + 5))
    genome = ref.from_sequences(spark, {"chr1": text})
    at = [-5, 0, 1, ref.PIECE, ref.PIECE + 1, ref.CHUNK, ref.CHUNK + 1, len(text) - 1, len(text), len(text) + 1, 3 * ref.CHUNK] + [rnd.randint(1, len(text)) for _ in range(200)]
    found = ref.with_base(spark.createDataFrame([("chr1", p) for p in at], "chrom string, pos long"), genome)
    assert all(r["ref_base"] == (text[r["pos"] - 1] if 1 <= r["pos"] <= len(text) else "N") for r in found.collect())
    assert "seq" not in plan_of(found).split("Join")[0]  # the chunk's whole text stays on the reference's side


def test_integers_that_do_not_fit(spark):
    texts = ["2147483647", "2147483648", "-2147483648", "-2147483649", "+7x", "9" * 30, "0" * 40 + "5", "x", "", "4294967295", "4294967296", "9223372036854775808"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", R.parse_int("t").alias("i"), R.parse_unsigned("t").alias("u"), R.parse_long("t").alias("l")).orderBy("k").collect()
    assert [r["i"] for r in rows] == [2147483647, None, -2147483648, None, 7, None, 5, None, None, None, None, None]
    assert [r["u"] for r in rows] == [2147483647, 2147483648, None, None, 7, None, 5, None, None, 4294967295, None, None]
    assert [r["l"] for r in rows] == [2147483647, 2147483648, -2147483648, -2147483649, 7, None, 5, None, None, 4294967295, 4294967296, None]
