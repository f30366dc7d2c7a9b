"""Variant-like inputs derived from the star-schema tables, by SQL that Spark and DuckDB read alike.

Every derived value is integer arithmetic on whole tables, so both engines have the same rows. A record's ``line_no`` is
its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.plans.storage import stored
from strandloom.sources import reference as ref
from strandloom.sources import vcf

#: Positions of a derived contig, and those of its records; more than a bin or chunk of any operator holds.
CONTIG, SPAN = 10_010, 10_000


def base(p: str) -> str:
    """SQL of the reference base at a position."""
    return f"CASE WHEN ({p}) > {CONTIG} OR ({p}) < 1 OR ({p}) % 97 = 0 THEN 'N' ELSE substring('ACGT', CAST((({p}) * 7 + FLOOR(({p}) / 5)) % 4 AS INT) + 1, 1) END"


def other(b: str) -> str:
    return f"CASE {b} WHEN 'A' THEN 'G' WHEN 'C' THEN 'T' WHEN 'G' THEN 'A' ELSE 'C' END"


_PLACE = f"'chr' || CAST(FLOOR(l_orderkey / {SPAN}) + 1 AS BIGINT) AS chrom, l_orderkey % {SPAN} + 1 AS pos"

#: One record for each order: sites, SNPs, deletions and insertions of one sample.
CALLS = f"""
o AS (SELECT l_orderkey AS k, {_PLACE}, count(*) AS n, CAST(FLOOR(max(l_quantity)) AS BIGINT) AS q, CAST(FLOOR(min(l_quantity)) AS BIGINT) AS mn, max(l_suppkey) AS s, CAST(FLOOR(max(l_extendedprice)) AS BIGINT) AS p FROM lineitem GROUP BY l_orderkey),
t AS (SELECT *, (s + n * 5) % 23 AS kind, {base('pos')} AS b0, {base('pos + 1')} AS b1, {base('pos + 2')} AS b2 FROM o),
c AS (SELECT k, k AS line_no, chrom, pos, kind,
  CASE WHEN kind = 2 THEN b0 || b1 || b2 WHEN s % 31 = 0 THEN {other('b0')} ELSE b0 END AS ref,
  CASE WHEN kind IN (0, 1) THEN {other('b0')} WHEN kind = 2 THEN b0 WHEN kind = 3 THEN b0 || 'TG' ELSE '.' END AS alt,
  CASE WHEN s % 37 = 0 THEN '.' ELSE '' || (p % 90 + 5) END AS qual,
  CASE WHEN s % 29 = 0 THEN 'q10' WHEN s % 3 = 0 THEN '.' ELSE 'PASS' END AS filter,
  20 + s % 41 - n AS mq, p % 9 AS qd, q % 40 + 1 AS dpi, s % 71 AS fs,
  CASE WHEN kind = 0 OR kind = 3 OR (kind = 2 AND s % 2 = 0) THEN '0/1' WHEN kind IN (1, 2) THEN '1/1' WHEN kind = 22 THEN './.' ELSE '0/0' END AS gt,
  CASE WHEN s % 19 = 0 THEN '.' ELSE '' || ((mn * 3 + n) % 70) END AS gq,
  CASE WHEN s % 41 = 0 THEN '.' ELSE '' || (q % 45) END AS dp,
  CASE WHEN s % 13 = 0 THEN '' || CAST(FLOOR((q % 40 + 1) / 2) AS BIGINT) ELSE '' || (q % 40 + 1) END AS ad0
  FROM t),
calls AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'AC=1;' ELSE '' END || 'MQ=' || mq || '.6;QD=' || qd || ';FS=' || fs || ';DP=' || dpi AS info, 'GT:GQ:DP:AD:PL' AS format, gt || ':' || gq || ':' || dp || ':' || ad0 || ',1:9' AS sample FROM c)
"""
CALL_LINES = "SELECT line_no, chrom || '\t' || pos || '\t.\t' || ref || '\t' || alt || '\t' || qual || '\t' || filter || '\t' || info || '\t' || format || '\t' || sample AS value FROM calls"

#: Block records, one for each eight orders.
BLOCKS = f"""
g AS (SELECT CAST(FLOOR(l_orderkey / 8) AS BIGINT) AS k, count(*) AS n, max(l_suppkey) AS s FROM lineitem GROUP BY CAST(FLOOR(l_orderkey / 8) AS BIGINT)),
h AS (SELECT k, k AS line_no, 'chr' || CAST(FLOOR(k * 8 / {SPAN}) + 1 AS BIGINT) AS chrom, k * 8 % {SPAN} + 1 AS pos, n, s FROM g),
blocks AS (SELECT *, pos + n % 8 AS stop, {base('pos')} AS ref, CASE WHEN s % 5 = 0 THEN '0/1' WHEN s % 5 = 1 THEN '.' WHEN s % 5 = 2 THEN './.' ELSE '0/0' END AS gt, CASE WHEN s % 3 = 0 THEN 'PASS' WHEN s % 3 = 1 THEN '.' ELSE 'LowGQX' END AS filter FROM h)
"""
BLOCK_LINES = "SELECT line_no, chrom || '\t' || pos || '\t.\t' || ref || '\t.\t.\t' || filter || '\t' || CASE WHEN stop > pos THEN 'END=' || stop || ';X' ELSE '.' END || '\tGT:PL:DP\t' || gt || ':5:' || n AS value FROM blocks"

#: Regions, five orders to a begin; lengths from 0 to 3.
REGIONS = f"""
regions AS (SELECT 'chr' || CAST(FLOOR(o_orderkey / {SPAN}) + 1 AS BIGINT) AS chrom, CAST(FLOOR(o_orderkey % {SPAN} / 5) * 5 AS BIGINT) AS begin, CAST(FLOOR(o_orderkey % {SPAN} / 5) * 5 + o_custkey % 4 AS BIGINT) AS "end" FROM orders)
"""

#: Records of three samples, by line number modulo three.
SAMPLES = f"""
a AS (SELECT l_orderkey AS k, l_linenumber % 3 AS sample_id, {_PLACE}, count(*) AS n, sum(l_suppkey) AS s, CAST(FLOOR(max(l_quantity)) AS BIGINT) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber % 3),
e AS (SELECT *, (s + sample_id) % 6 AS x, {base('pos')} AS b0, {base('pos + 1')} AS b1 FROM a),
f AS (SELECT k, k AS line_no, CAST(sample_id AS INT) AS sample_id, chrom, pos, x, s, q, s % 17 = 0 AS indel,
  CASE WHEN s % 17 = 0 THEN b0 || b1 ELSE b0 END AS ref,
  CASE WHEN s % 17 = 0 THEN b0 WHEN x IN (2, 3, 4) THEN {other('b0')} ELSE '.' END AS alt,
  CASE WHEN s % 11 = 0 THEN 'LowGQX;q' || s % 3 WHEN s % 11 = 1 THEN '.' ELSE 'PASS' END AS filter,
  CASE x WHEN 2 THEN '0/1' WHEN 3 THEN '1/1' WHEN 4 THEN '1/0' WHEN 5 THEN './.' ELSE '0/0' END AS gt,
  CASE WHEN s % 7 = 0 THEN '.' ELSE '' || q END AS gqx, '' || (q % 30) AS dp FROM e),
samples AS (SELECT * FROM f)
"""
SAMPLE_LINES = "SELECT sample_id, line_no, chrom || '\t' || pos || '\t.\t' || ref || '\t' || alt || '\t.\t' || filter || '\tQD=' || q || '\tGT:' || CASE WHEN s % 2 = 0 THEN 'GQX:DP' ELSE 'DP:GQX' END || '\t' || gt || ':' || CASE WHEN s % 2 = 0 THEN gqx || ':' || dp ELSE dp || ':' || gqx END AS value FROM samples"

#: Overlapping ranges of one sample.
RANGES = f"""
r AS (SELECT l_orderkey AS k, {_PLACE}, CAST(FLOOR(max(l_quantity)) AS BIGINT) AS q FROM lineitem GROUP BY l_orderkey),
ranges AS (SELECT k, k AS line_no, chrom, pos, pos + q % 4 AS stop, {base('pos')} AS ref FROM r)
"""
RANGE_LINES = "SELECT line_no, chrom || '\t' || pos || '\t.\t' || ref || '\t.\t.\tPASS\tEND=' || stop || '\tGT:DP\t0/0:9' AS value FROM ranges"


def _sql(spark: SparkSession, sf_dir: str, ctes: str, select: str) -> DataFrame:
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("lineitem", "orders") if f"FROM {name}" in ctes}
    text = f"WITH {ctes} {select}".replace('"end"', "`end`")
    for name in tables:
        text = text.replace(f"FROM {name}", "FROM {" + name + "}")
    return spark.sql(text, **tables)


def _lines(spark: SparkSession, sf_dir: str, ctes: str, select: str) -> DataFrame:
    """Lines as a file would have them: written and read, so that what derives them isn't a part of each tool's expressions."""
    return stored(_sql(spark, sf_dir, ctes, select), "lines")


def call_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, CALLS, CALL_LINES)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcf.parse_records(call_lines(spark, sf_dir))


def block_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcf.parse_records(_lines(spark, sf_dir, BLOCKS, BLOCK_LINES), "region")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, REGIONS, "SELECT * FROM regions")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcf.parse_records(_lines(spark, sf_dir, SAMPLES, SAMPLE_LINES), "multi", keep=("sample_id",))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcf.parse_records(_lines(spark, sf_dir, RANGES, RANGE_LINES), "multi").withColumn("sample_id", F.lit(0))


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference of every contig that records lie on."""
    contigs = _sql(spark, sf_dir, CALLS, f"SELECT DISTINCT CAST(FLOOR(k / {SPAN}) AS BIGINT) AS chrom_idx, chrom FROM calls")
    # the rule of base() repeats itself after 20 * 97 positions
    unit = "".join("N" if p % 97 == 0 else "ACGT"[(p * 7 + p // 5) % 4] for p in range(1, 20 * 97 + 1))
    letters = F.substr(F.repeat(F.lit(unit), CONTIG // len(unit) + 1), F.lit(1), F.lit(CONTIG))
    return stored(ref.rechunked(contigs.select("chrom", "chrom_idx", F.lit(0).cast("long").alias("start"), letters.alias("seq"))), "reference")


def depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CALLS, "SELECT chrom, CAST(10 + max(k) % 3 AS DOUBLE) AS depth FROM calls GROUP BY chrom")
