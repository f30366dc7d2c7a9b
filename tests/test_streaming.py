"""The stateful tools on a stream of several micro-batches give what the batch tools give."""

import json
import os

import pytest
from pyspark.sql import functions as F

from strandloom.operators import blocks, intervals
from strandloom.sources import vcf
from strandloom.streaming import tools


def lines(n):
    out = []
    for k in range(1, n):
        gap = k // 40
        kind = "T" if k % 13 == 0 else "."
        out.append((k, f"chr{1 + k // 120}\t{k + gap}\t.\tA\t{kind}\t60\t{'PASS' if k % 9 else 'LowGQX'}\t.\tGT:GQ:DP:MQ\t{'0/1' if kind == 'T' else '0/0'}:60:{20 + k % 11}:60"))
    return out


def run(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()


def test_streams(spark, tmp_path):
    rows = lines(240)
    source = tmp_path / "in"
    source.mkdir()
    ends = [(10_000 + k, f"END\tchr{k}") for k in (1, 2)]
    for part in range(4):
        chunk = rows[part * 60 : (part + 1) * 60] + (ends if part == 3 else [])
        path = source / f"{part}.json"
        path.write_text("\n".join(json.dumps({"line_no": k, "value": v}) for k, v in chunk))
        os.utime(path, (1_000_000 + part, 1_000_000 + part))  # a stream takes files in the order of their times
    stream = spark.readStream.schema("line_no long, value string").option("maxFilesPerTrigger", 1).json(str(source))
    records = vcf.parse_records(stream.filter("value NOT LIKE 'END%'"), keep=())
    closing = tools.end_of(stream.filter("value LIKE 'END%'").select(F.substring_index("value", "\t", -1).alias("chrom")), records)
    everything = records.unionByName(closing)
    batch = vcf.parse_records(spark.createDataFrame(rows, "line_no long, value string"))

    run(tools.called_regions(everything), "regions")
    want = sorted(map(tuple, intervals.called_regions(batch).collect()))
    assert sorted(map(tuple, spark.table("regions").collect())) == want and len(want) > 5

    run(tools.blocks(everything), "blocks")
    summary = blocks.compress(batch)[1]
    want = sorted((r["chrom"], r["block"], r["size"], r["min_dp"]) for r in summary.collect())
    got = sorted((r["chrom"], r["pos"], r["end"] - r["pos"] + 1, r["dp"]) for r in spark.table("blocks").collect())
    assert got == want and len(got) > 5

    run(tools.extract_variants(records).select("line_no"), "variants")
    assert spark.table("variants").count() == intervals.extract_variants(batch).count()


def test_late_records(spark, tmp_path):
    """A record that arrives after what lies behind it was sent on is dropped, or stops the stream."""
    rows = [(k, f"chr1\t{k * (3 if k % 5 == 0 else 1)}\t.\tA\t.\t60\tPASS\t.\tGT:GQ:DP:MQ\t0/0:60:30:60") for k in (1, 2, 3, 11, 12, 13, 31, 32, 33)]
    late = (99, "chr1\t4\t.\tA\t.\t60\tPASS\t.\tGT:GQ:DP:MQ\t0/0:60:30:60")
    source = tmp_path / "in"
    source.mkdir()
    for part, chunk in enumerate((rows[:3], rows[3:6], rows[6:], [late, (100, "END\tchr1")])):
        (source / f"{part}.json").write_text("\n".join(json.dumps({"line_no": k, "value": v}) for k, v in chunk))
        os.utime(source / f"{part}.json", (1_000_000 + part, 1_000_000 + part))
    stream = spark.readStream.schema("line_no long, value string").option("maxFilesPerTrigger", 1).json(str(source))
    records = vcf.parse_records(stream.filter("value NOT LIKE 'END%'"), keep=())
    everything = records.unionByName(tools.end_of(stream.filter("value LIKE 'END%'").select(F.substring_index("value", "\t", -1).alias("chrom")), records))
    batch = vcf.parse_records(spark.createDataFrame(rows, "line_no long, value string"))

    run(tools.called_regions(everything, late="drop"), "late_regions")
    assert sorted(map(tuple, spark.table("late_regions").collect())) == sorted(map(tuple, intervals.called_regions(batch).collect()))
    run(tools.blocks(everything, late="drop"), "late_blocks")
    want = sorted((r["chrom"], r["block"], r["size"]) for r in blocks.compress(batch)[1].collect())
    assert sorted((r["chrom"], r["pos"], r["end"] - r["pos"] + 1) for r in spark.table("late_blocks").collect()) == want
    for number, tool in enumerate((tools.called_regions, tools.blocks)):
        with pytest.raises(Exception, match="arrived after"):
            run(tool(everything), f"stopped{number}")
    run(tools.unblocked(records).select("line_no"), "unblocked")
    assert spark.table("unblocked").count() == 0
