"""Parsing, fields, genotypes and ranges."""

import pytest
from pyspark.sql import functions as F

from strandloom.functions import records as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "alleles"), [("0/1", [0, 1]), ("1|0", [1, 0]), (".", [-1]), ("./.", [-1, -1]), ("12/3", [12, 3])])
def test_parse_gt(spark, text, alleles):
    assert one(spark, R.parse_gt(F.lit(text))) == alleles


@pytest.mark.parametrize("text", ["0/", "x", "0/1:30"])
def test_parse_gt_refuses(spark, text):
    with pytest.raises(Exception, match="can't parse genotype"):
        one(spark, R.parse_gt(F.lit(text)))


def test_parse_gt_with_rest(spark):
    assert one(spark, R.parse_gt(F.lit("0/1:30"), allow_rest=True)) == [0, 1]


def test_numbers(spark):
    assert one(spark, R.parse_int(F.lit("123abc"))) == 123
    assert one(spark, R.strict(R.parse_int, F.lit("123abc"))) is None
    assert one(spark, R.parse_unsigned(F.lit("-2"))) is None
    assert one(spark, R.parse_unsigned(F.lit("12345678901234567890"))) is None
    assert one(spark, R.parse_long(F.lit("-9000000000"))) == -9000000000
    assert one(spark, R.parse_double(F.lit("2.0e+100"))) == 2.0e100
    assert one(spark, R.parse_double(F.lit("Infinity"))) == float("inf")
    assert one(spark, R.parse_double(F.lit("."))) is None
    assert [one(spark, R.round_half_away(F.lit(x))) for x in (3.5, -1.5, -1.2)] == [4, -2, -1]


def test_text_helpers(spark):
    assert one(spark, R.basename(F.lit("/a/b/c.vcf"))) == "c.vcf"
    assert one(spark, R.listed(F.lit("A:B:C"), ":")) == ["A", "B", "C"]
    assert one(spark, R.listed(F.lit("."), ":")) == []
    assert one(spark, R.ratio(F.lit(1), F.lit(0))) == 0.0


def test_fields(spark):
    row = spark.createDataFrame([(["CIEND=9", "DP=7", "X", "MQ=1"], ["GT", "DPI", "DP"], ["0/1", "3", "4"])], "info array<string>, format array<string>, sample array<string>")
    got = row.select(
        R.info_value("info", "DP").alias("dp"),
        R.info_value("info", "X").alias("flag"),
        R.end_value("info").alias("end"),
        R.info_set("info", "DP", F.lit("8")).alias("set"),
        R.info_set("info", "N", F.lit("1")).alias("new"),
        R.info_delete("info", "MQ").alias("gone"),
        R.format_prefix_value("DP").alias("prefix"),
        R.sample_value("DP").alias("exact"),
        R.sample_delete("DPI")[1].alias("cut"),
        R.sample_rename("DP", "D").alias("renamed"),
    ).first()
    assert got["dp"] == "7" and got["flag"] is None and got["end"] == 9
    assert got["set"] == ["CIEND=9", "DP=8", "X", "MQ=1"] and got["new"][-1] == "N=1" and got["gone"] == ["CIEND=9", "DP=7", "X"]
    assert got["prefix"] == "3" and got["exact"] == "4" and got["cut"] == ["0/1", "4"] and got["renamed"] == ["GT", "DPI", "D"]


def test_filters_and_reference(spark):
    assert one(spark, R.filter_add(F.array(F.lit("PASS")), "A")) == ["A"]
    assert one(spark, R.filter_add(F.array(F.lit("A")), "A")) == ["A"]
    assert one(spark, R.standardize_reference(F.lit("acgtRNu"))) == "ACGTNNT"
    with pytest.raises(Exception, match="invalid base"):
        one(spark, R.standardize_reference(F.lit("AC!")))
    assert one(spark, R.reverse_complement(F.lit("AACN"))) == "NGTT"
    assert [one(spark, R.base_to_id(F.lit(b))) for b in "ACGTN"] == [0, 1, 2, 3, 4]
