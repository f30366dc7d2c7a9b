"""The tools on streams.

Extraction, filters and grooming depend on one record at a time: the batch functions take a streaming DataFrame. Grooming is
a deep expression, whose analysis overflowed a stream thread of default stack size when it was tried together with the
folds below; groom before the stream, or give the driver a larger thread stack.
Block compression and called regions keep state for each chromosome (an open block or range) between micro-batches, with
``applyInPandasWithState``. Records of a chromosome arrive in order; an end-of-chromosome row (``pos`` null) closes what is
open, as no time bounds it.

Late data: a record that belongs before what was sent on already is an error, as unordered records are for the tools on
files; ``late="drop"`` leaves it out instead. Within a micro-batch any order is put right. What is neither blocked nor an
indel goes on at once, by :func:`unblocked`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandloom.functions import records as R
from strandloom.operators import filters, intervals
from strandloom.operators.blocks import OpenBlock
from strandloom.operators.filters import BlockOptions


def extract_variants(records: DataFrame, invert: bool = False) -> DataFrame:
    return intervals.extract_variants(records, invert)


def groom(records: DataFrame, options: BlockOptions = BlockOptions()) -> DataFrame:
    return filters.groom(records, options)


def end_of(chroms: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of ``records``' schema that end the chromosomes of ``chroms``."""
    return chroms.select(*[F.col("chrom") if f.name == "chrom" else F.lit(None).cast(f.dataType).alias(f.name) for f in records.schema.fields])


def unblocked(records: DataFrame, options: BlockOptions = BlockOptions()) -> DataFrame:
    """The records of a stream that no block takes, as the tool writes them: a step without state, beside :func:`blocks`."""
    return filters.write_gqx(records.filter(~F.coalesce(filters.is_blockable(options), F.lit(False)) & F.col("pos").isNotNull()))


def _too_late(late: str, chrom: str, place: int) -> None:
    if late != "drop":
        raise ValueError(f"a record at {chrom}:{place} arrived after what lies behind it was sent on")


def called_regions(records: DataFrame, late: str = "error") -> DataFrame:
    """Called regions of a stream, each sent on when a gap or the chromosome's end closes it; ``late`` is ``error`` or ``drop``."""
    begin, end = R.called_range()
    ranges = records.filter(R.is_pass() | F.col("pos").isNull()).select("chrom", (begin - 1).alias("begin"), end.alias("end"))
    ranges = ranges.filter("begin IS NULL OR end > begin")

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *open_range, sent = state.get if state.exists else (None, None, None)
        held = tuple(open_range) if open_range[0] is not None else None
        out: list[tuple] = []
        rows = pd.concat(list(parts))
        closing = bool(rows["begin"].isna().any())
        for low, high in rows.dropna(subset=["begin"]).sort_values(["begin", "end"])[["begin", "end"]].astype("int64").itertuples(index=False):
            if sent is not None and low <= sent:
                _too_late(late, key[0], low + 1)
            elif held is not None and low <= held[1] and high >= held[0]:
                held = (min(held[0], low), max(held[1], high))
            elif held is not None and low < held[0]:
                out.append((key[0], low, high))
                sent = max(sent or 0, high)
            else:
                if held is not None:
                    out.append((key[0], *held))
                    sent = held[1]
                held = (low, high)
        if closing and held is not None:
            out.append((key[0], *held))
            held = None
        if closing:
            if state.exists:
                state.remove()
        elif held is not None or sent is not None:
            state.update((*(held or (None, None)), sent))
        yield pd.DataFrame(out, columns=["chrom", "begin", "end"])

    return ranges.groupBy("chrom").applyInPandasWithState(fold, "chrom string, begin long, end long", "begin long, end long, sent long", "append", GroupStateTimeout.NoTimeout)


def blocks(records: DataFrame, options: BlockOptions = BlockOptions(), late: str = "error") -> DataFrame:
    """Blocks of a stream of groomed records: ``chrom, pos, end, filter, gt, covered, dp, gqx, mq`` (minima).

    A record that can't be in a block closes the open one and isn't sent on here, but by :func:`unblocked`. ``late`` is
    ``error`` or ``drop``.
    """
    dp = R.maybe_int(R.sample_value("DP"))
    rows = records.select(
        "chrom",
        "pos",
        F.coalesce(filters.is_blockable(options), F.lit(False)).alias("blockable"),
        F.array_join("filter", ";").alias("filter"),
        F.coalesce(R.sample_value("GT"), F.lit("")).alias("gt"),
        F.coalesce(dp != 0, F.lit(False)).alias("covered"),
        R.gqx().alias("gqx"),
        dp.alias("dp"),
        R.maybe_int(R.sample_value("MQ")).alias("mq"),
    )
    fraction, absolute = options.range_factor, options.absolute_tolerance
    columns = ["chrom", "pos", "end", "filter", "gt", "covered", "dp", "gqx", "mq"]

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        block, last, seen = OpenBlock(fraction, absolute), None, None
        if state.exists:
            seen, filters_text, gt, covered, start, last, *numbers = state.get
            if last is not None:
                block.key, block.start = (filters_text, gt, covered), start
                block.first = tuple(numbers[:3])
                block.ranges = [None if low is None else (low, high) for low, high in zip(numbers[3::2], numbers[4::2], strict=True)]
        out: list[tuple] = []

        def close() -> None:
            nonlocal last
            if last is not None:
                gqx, dp, mq = ((held[0] if held else None) if block.key[2] else None for held in block.ranges)
                out.append((key[0], block.start, last, *block.key, dp, gqx, mq))
            block.key, last = None, None

        rows = pd.concat(list(parts))
        closing = bool(rows["pos"].isna().any())
        rows = rows.dropna(subset=["pos"]).sort_values("pos", kind="stable")
        before = seen
        for row in rows.itertuples(index=False):
            if before is not None and int(row.pos) < before:  # another micro-batch has gone beyond it
                _too_late(late, key[0], int(row.pos))
                continue
            seen = max(seen or 0, int(row.pos))
            if not row.blockable:
                close()
                continue
            values = tuple(None if pd.isna(v) else int(v) for v in (row.gqx, row.dp, row.mq)) if row.covered else (None, None, None)
            here = (row.filter, row.gt, bool(row.covered))
            if last is not None and (int(row.pos) != last + 1 or not block.takes(here, values)):
                close()
            block.add(here, int(row.pos), values)
            last = int(row.pos)
        if closing:
            close()
        if closing:
            if state.exists:
                state.remove()
        elif last is not None:
            flat = [bound for held in block.ranges for bound in (held or (None, None))]
            state.update((seen, *block.key, block.start, last, *block.first, *flat))
        elif seen is not None:
            state.update((seen, *[None] * 14))
        yield pd.DataFrame(out, columns=columns).astype({c: "Int64" for c in ("dp", "gqx", "mq")})

    held = "seen long, filter string, gt string, covered boolean, start long, last long, gqx int, dp int, mq int, gqx_low int, gqx_high int, dp_low int, dp_high int, mq_low int, mq_high int"
    return rows.groupBy("chrom").applyInPandasWithState(fold, "chrom string, pos long, end long, filter string, gt string, covered boolean, dp int, gqx int, mq int", held, "append", GroupStateTimeout.NoTimeout)
