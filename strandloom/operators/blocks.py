"""Records around indels made consistent, and non-variant sites compressed into blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strandloom.functions import records as R
from strandloom.operators import filters
from strandloom.operators.filters import BlockOptions
from strandloom.plans import ordered
from strandloom.plans.storage import stored

ORDER = ["pos", "line_no"]
#: Columns of parsed lines that the tool's output doesn't read.
UNREAD = ("raw", "n_word")


def with_buffers(records: DataFrame, width: int = ordered.BIN) -> DataFrame:
    """Records with the indel buffer that holds them.

    An indel opens a buffer (``opens``) unless it lies inside the reach of the indels before it, which is the largest end so
    far; a site is buffered up to that reach. ``buffer`` numbers the buffers of a chromosome, and ``buffered`` says whether
    the record is in its buffer or behind it. The reach is a running maximum and the number a running sum, so there is no
    fold over the chromosome.
    """
    indel = R.is_indel_any_long()
    end = F.when(indel, F.col("pos") + F.length("ref") - 1)
    found = ordered.max_before(records, ["chrom"], "pos", ORDER, end, "_reach", width, keep=True)
    opens = indel & (F.col("_reach").isNull() | (F.col("pos") + 2 > F.col("_reach")))
    found = found.withColumns({"_indel": indel, "opens": opens})
    found = ordered.sum_through(found, ["chrom"], "pos", ORDER, F.col("opens").cast("long"), "buffer", width)
    buffered = F.col("_indel") | F.coalesce(F.col("pos") <= F.col("_reach"), F.lit(False))
    return found.withColumns({"buffered": buffered, "_end": end})


def groom_buffers(records: DataFrame, options: BlockOptions = BlockOptions(), width: int = ordered.BIN) -> DataFrame:
    """Groomed records with those that overlap an indel made consistent with it.

    A buffer is judged when a site behind it, or the chromosome's end, closes it; one that the next indel closes is left as
    it is, as is one of a single record. With one indel, its filters go to the buffered records in its span, and het
    deletions leave one copy: homozygous calls become haploid, heterozygous ones unknown and in conflict. Otherwise there is
    no copy, and calls become unknown; several indels give a conflict filter instead of their own. Changed records are
    groomed again.
    """
    records = records.select(*[c for c in records.columns if c not in UNREAD])
    names = [c for c in records.columns if c != "_bin"]
    found = stored(with_buffers(records, width), "buffers")
    member = F.when(F.col("buffered"), True)
    sole = F.struct("line_no", F.col("filter").alias("filters"), R.try_gt(R.sample_value("GT")).alias("gt"))
    groups = found.filter("buffer > 0").groupBy("chrom", "buffer").agg(
        F.count(member).alias("_members"),
        F.count(F.when(F.col("_indel"), True)).alias("_indels"),
        F.count(F.when(~F.col("buffered"), True)).alias("_behind"),
        F.min(F.when(F.col("_indel"), F.col("pos"))).alias("_open_pos"),
        F.max(F.greatest("_end", F.when(F.col("_indel"), F.col("_reach")))).alias("_span_end"),
        F.min_by(sole, F.when(F.col("_indel"), F.struct("pos", "line_no"))).alias("_sole"),
    )
    last = groups.groupBy("chrom").agg(F.max("buffer").alias("_last")).withColumnRenamed("chrom", "_lc")
    groups = groups.join(last, F.col("chrom") == F.col("_lc"))
    judged = groups.filter("_members > 1 AND (_behind > 0 OR buffer = _last)")
    judged = judged.select(F.col("chrom").alias("_gc"), F.col("buffer").alias("_gb"), "_indels", (F.col("_open_pos") + 1).alias("_span_begin"), "_span_end", "_sole")
    # only what is in a buffer meets it, so the rest needs no shuffle
    within = found.filter("buffered")
    met = within.join(judged, (F.col("chrom") == F.col("_gc")) & (F.col("buffer") == F.col("_gb")), "left")
    change = F.coalesce(F.col("pos").between(F.col("_span_begin"), F.col("_span_end")), F.lit(False))
    met = met.withColumn("_change", change)
    changed = adjusted(met.filter("_change"), options)
    groomed = filters.groom(changed.select(*names), options)
    return found.filter("NOT buffered").select(*names).unionByName(met.filter("NOT _change").select(*names)).unionByName(groomed.select(*names))


def adjusted(rows: DataFrame, options: BlockOptions) -> DataFrame:
    """Buffered records of judged buffers, rewritten; columns ``_indels`` and ``_sole`` describe the buffer."""
    one = F.col("_indels") == 1
    passing = (F.size("_sole.filters") == 1) & (F.get("_sole.filters", F.lit(0)) == "PASS")
    given = F.when(~one, F.array(F.lit(options.indel_conflict))).when(passing, R.empty()).otherwise(F.col("_sole.filters"))
    a, b = F.get("_sole.gt", F.lit(0)), F.get("_sole.gt", F.lit(1))
    half = F.coalesce(one & (F.size("_sole.gt") == 2) & (((a == 0) & (b > 0)) | ((b == 0) & (a > 0))), F.lit(False))
    gt = R.try_gt(R.sample_value("GT"))
    x, y = F.get(gt, F.lit(0)), F.get(gt, F.lit(1))
    size = F.coalesce(F.size(gt), F.lit(0))
    rows = rows.withColumns({"_given": given, "_half": half, "_haploid": F.coalesce(half & (size == 2) & (x == y) & (x >= 0), F.lit(False)), "_conflict": F.coalesce(half & (size == 2) & (x != y), F.lit(False)), "_stays": half & (size == 1), "_allele": x.cast("string")})
    had = F.when(R.is_pass(), R.empty()).otherwise(F.col("filter"))
    more = F.filter(F.array_distinct(F.concat("_given", F.when(F.col("_conflict"), F.array(F.lit(options.site_conflict))).otherwise(R.empty()))), lambda label: ~F.array_contains(F.col("filter"), label))
    rows = rows.withColumn("filter", F.when(F.size(more) > 0, F.concat(had, more)).otherwise(F.col("filter")))
    unknown = ~F.col("_haploid") & ~F.col("_stays")
    gone = F.when(unknown, F.array(*map(F.lit, ("PL", "GQ", "GQX")))).when(F.col("_haploid"), F.array(F.lit("PL"))).otherwise(R.empty())
    call = F.when(F.col("_haploid"), F.col("_allele")).when(unknown, F.lit("."))
    rows = rows.withColumns({"_gone": gone, "_call": call, "qual": F.when(unknown, F.lit(".")).otherwise(F.col("qual"))})
    pairs = F.filter(F.arrays_zip("format", "sample"), lambda p: ~F.array_contains(F.col("_gone"), p["format"]))
    pairs = F.transform(pairs, lambda p: F.when((p["format"] == "GT") & F.col("_call").isNotNull(), F.struct(p["format"], F.col("_call").alias("sample"))).otherwise(p))
    rows = rows.withColumn("_pairs", pairs)
    lacking = F.col("_call").isNotNull() & ~F.array_contains("format", "GT")
    return rows.withColumns(
        {
            "format": F.concat(F.col("_pairs.format"), F.when(lacking, F.array(F.lit("GT"))).otherwise(R.empty())),
            "sample": F.concat(F.col("_pairs.sample"), F.when(lacking, F.array("_call")).otherwise(R.empty())),
        }
    )


def islands(records: DataFrame, options: BlockOptions = BlockOptions(), width: int = ordered.BIN) -> DataFrame:
    """Records with ``blockable`` and, for blockable ones, ``island``: runs that only the tolerances can cut further.

    Rows of an island follow each other position by position with nothing between, and share filters, genotype and whether
    they are covered (their DP is neither missing nor 0).
    """
    dp = R.maybe_int(R.sample_value("DP"))
    found = records.withColumns(
        {
            "blockable": filters.is_blockable(options),
            "gt": F.coalesce(R.sample_value("GT"), F.lit("")),
            "dp": dp,
            "gqx": R.gqx(),
            "mq": R.maybe_int(R.sample_value("MQ")),
            "covered": F.coalesce(dp != 0, F.lit(False)),
        }
    )
    here = F.struct(F.col("pos"), F.col("blockable"), F.array_join("filter", ";").alias("filter"), F.col("gt"), F.col("covered"))
    found = ordered.last_before(found, ["chrom"], "pos", ORDER, here, "_last", width, keep=True)
    same = F.col("_last.blockable") & (F.col("pos") == F.col("_last.pos") + 1) & (F.array_join("filter", ";") == F.col("_last.filter")) & (F.col("gt") == F.col("_last.gt")) & (F.col("covered") == F.col("_last.covered"))
    found = found.withColumn("_new", F.when(F.coalesce(same, F.lit(False)) & F.col("blockable"), 0).otherwise(1).cast("long")).drop("_last")
    return ordered.sum_through(found, ["chrom"], "pos", ORDER, F.col("_new"), "island", width).drop("_new")


def within_tolerance(low: int, high: int, fraction: float, absolute: int) -> bool:
    """Whether a block's values from ``low`` to ``high`` are near enough to its minimum."""
    if low + absolute >= high:
        return True
    relative = math.floor(low * fraction)
    return relative > absolute and low + relative >= high


class OpenBlock:
    """The fold's state: the block's first values, and the range of each value so far."""

    def __init__(self, fraction: float, absolute: int) -> None:
        self.fraction, self.absolute = fraction, absolute
        self.key: tuple | None = None
        self.first: tuple = ()
        self.ranges: list[tuple[int, int] | None] = []
        self.start = 0

    def takes(self, key: tuple, values: tuple) -> bool:
        """``values`` are GQX, DP and MQ; a missing GQX fits any, a missing DP or MQ only a missing one."""
        if key != self.key:
            return False
        for k, (new, first, held) in enumerate(zip(values, self.first, self.ranges, strict=True)):
            if new is None or first is None:
                if k and (new is None) != (first is None):
                    return False
            elif held and not within_tolerance(min(held[0], new), max(held[1], new), self.fraction, self.absolute):
                return False
        return True

    def add(self, key: tuple, pos: int, values: tuple) -> int:
        """The first position of the block that the site joins or opens."""
        if not self.takes(key, values):
            self.key, self.first, self.start, self.ranges = key, values, pos, [None, None, None]
        self.ranges = [held if new is None else (min(held[0], new), max(held[1], new)) if held else (new, new) for new, held in zip(values, self.ranges, strict=True)]
        return self.start


def with_blocks(found: DataFrame, options: BlockOptions = BlockOptions()) -> DataFrame:
    """Blockable rows of :func:`islands` with ``block``, the first position of their block.

    An island that isn't covered is one block. In a covered one a site joins while all values stay within the tolerances,
    which depends on the sites before it: a fold with constant state, streamed over rows sorted by island. Islands are dealt
    out by key, so no task needs a chromosome.
    """
    flat = found.filter("blockable AND NOT covered")
    firsts = flat.groupBy("chrom", "island").agg(F.min("pos").alias("block")).select(F.col("chrom").alias("_c"), F.col("island").alias("_i"), "block")
    flat = flat.join(firsts, (F.col("chrom") == F.col("_c")) & (F.col("island") == F.col("_i"))).drop("_c", "_i")
    folded = found.filter("blockable AND covered").repartition("chrom", "island").sortWithinPartitions("chrom", "island", "pos")
    fraction, absolute = options.range_factor, options.absolute_tolerance
    names = folded.columns
    at = [names.index(name) for name in ("chrom", "island", "pos", "gqx", "dp", "mq")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = OpenBlock(fraction, absolute)
        for batch in batches:
            chrom, island, pos, gqx, dp, mq = (batch.column(k).to_pylist() for k in at)
            blocks = [state.add((c, i), p, values) for c, i, p, *values in zip(chrom, island, pos, gqx, dp, mq, strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(blocks, pa.int64())], names=[*names, "block"])

    return flat.unionByName(folded.mapInArrow(fold, StructType([*folded.schema.fields, StructField("block", LongType())])))


def block_summary(rows: DataFrame) -> DataFrame:
    """One row for each block: its first record, size, and the count, minimum and standard error of each value."""
    sums = []
    for name in ("gqx", "dp", "mq"):
        sums += [F.count(name).alias(f"n_{name}"), F.min(name).alias(f"min_{name}"), (F.stddev_samp(name) / F.sqrt(F.count(name))).alias(f"se_{name}")]
    first = F.min_by(F.struct("line_no", "id", "ref", "filter", "gt", "covered"), "pos").alias("first")
    return rows.groupBy("chrom", "island", "block").agg(first, F.count(F.lit(1)).alias("size"), *sums)


def block_records(summary: DataFrame, label: str = "BLOCKAVG_min30p3a") -> DataFrame:
    """Blocks as records: END for more than one site, the label if a value has more than one observation, minima in the sample."""
    covered = F.col("first.covered")
    averaged = covered & ((F.col("n_dp") > 1) | (F.col("n_gqx") > 1) | (F.col("n_mq") > 1))
    end = F.when(F.col("size") > 1, F.array(F.concat(F.lit("END="), (F.col("block") + F.col("size") - 1).cast("string")))).otherwise(R.empty())
    info = F.concat(end, F.when(averaged, F.array(F.lit(label))).otherwise(R.empty()))
    minima = [F.coalesce(F.col(f"min_{name}").cast("string"), F.lit(".")) for name in ("dp", "gqx", "mq")]
    return summary.select(
        F.col("first.line_no").alias("line_no"),
        "chrom",
        F.col("block").alias("pos"),
        F.col("first.id").alias("id"),
        F.col("first.ref").alias("ref"),
        R.empty().alias("alt"),
        F.lit(".").alias("qual"),
        F.col("first.filter").alias("filter"),
        info.alias("info"),
        F.when(covered, F.array(*map(F.lit, ("GT", "DP", "GQX", "MQ")))).otherwise(F.array(F.lit("GT"))).alias("format"),
        F.when(covered, F.array(F.col("first.gt"), *minima)).otherwise(F.array(F.col("first.gt"))).alias("sample"),
    )


def block_stats(summary: DataFrame, least: int = 5) -> DataFrame:
    """One row on covered blocks: size statistics, and each value's mean standard error over blocks with enough observations."""
    covered = summary.filter("first.covered")
    size = F.col("size").cast("double")
    return covered.agg(
        F.count(F.lit(1)).alias("blocks"),
        F.avg(size).alias("size_mean"),
        F.stddev_samp(size).alias("size_sd"),
        (F.stddev_samp(size) / F.sqrt(F.count(F.lit(1)))).alias("size_se"),
        F.min("size").alias("size_min"),
        F.max("size").alias("size_max"),
        *[F.avg(F.when(F.col(f"n_{name}") >= least, F.col(f"se_{name}"))).alias(f"mean_se_{name}") for name in ("gqx", "dp", "mq")],
    )


def stream_stat(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, variance, standard deviation, standard error, minimum and maximum; NaN where there are too few values."""
    x = F.col(value).cast("double")
    nan = lambda c: F.coalesce(c, F.lit(float("nan")))
    return df.groupBy(*(by or [])).agg(
        F.count(x).alias("n"),
        nan(F.avg(x)).alias("mean"),
        nan(F.var_samp(x)).alias("variance"),
        nan(F.stddev_samp(x)).alias("sd"),
        nan(F.stddev_samp(x) / F.sqrt(F.count(x))).alias("se"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )


#: What blocks read of their sites.
IN_BLOCKS = ["line_no", "chrom", "pos", "id", "ref", "filter", "gt", "covered", "blockable", "island", "gqx", "dp", "mq"]
OUT = ["line_no", "chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample"]


def compress(records: DataFrame, options: BlockOptions = BlockOptions(), width: int = ordered.BIN) -> tuple[DataFrame, DataFrame]:
    """Records with non-variant sites in blocks, and the blocks' summary for :func:`block_stats`."""
    found = stored(islands(records.select(*[c for c in records.columns if c not in UNREAD]), options, width), "islands")
    rest = filters.write_gqx(found.filter("NOT blockable")).select(*OUT)
    summary = block_summary(with_blocks(found.select(*IN_BLOCKS), options))
    return rest.unionByName(block_records(summary, options.label)), summary


def block_vcf(records: DataFrame, options: BlockOptions = BlockOptions(), depths: DataFrame | None = None, width: int = ordered.BIN) -> tuple[DataFrame, DataFrame]:
    """The whole tool: repeats dropped, records groomed, overlaps with indels settled, sites compressed; and the summary."""
    if depths is not None:
        records = filters.with_depth_limit(records, depths, options.max_depth_factor)
    records = stored(records.select(*[c for c in records.columns if c not in UNREAD]), "records")
    groomed = filters.groom(filters.without_repeats(records, width, keep=True), options)
    return compress(stored(groom_buffers(groomed, options, width), "settled"), options, width)

