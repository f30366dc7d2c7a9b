"""Running values along an order within a key, without one task for a whole key.

A window over all rows of a chromosome is one task's work. Here each key's order is cut into bins; a bin's total is a
partial aggregation, totals run over bins (few rows, one for thousands of positions, so they are broadcast), and a window within
each bin adds its own part. Rows are dealt out to their bins before anything is computed from them; a step that keeps the bins
(``keep``) spares the next one over the same order the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Positions of a bin.
BIN = 1 << 13


def binned(df: DataFrame, place: str, width: int = BIN) -> DataFrame:
    """``df`` with its rows' bins; of a struct, such as a line's place in a file, the last field is cut."""
    kind, at = df.schema[place].dataType, F.col(place)
    if isinstance(kind, StructType):
        *first, last = kind.names
        return df.withColumn("_bin", F.struct(*[at[name].alias(name) for name in first], F.floor(at[last] / width).alias(last)))
    return df.withColumn("_bin", F.floor(at / width))


def _gone(keep: bool) -> list[str]:
    return ["_carried", "_within"] + ([] if keep else ["_bin"])


def _before(df: DataFrame, by: list[str], order: list[Column | str], total, add, width: int, place: str) -> DataFrame:
    dealt = "_bin" in df.columns
    cut = df if dealt else binned(df, place, width)
    sums = cut.groupBy(*by, "_bin").agg(total.alias("_total"))
    over_bins = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_bin").alias("_of_bin"), add("_total", over_bins).alias("_carried"))
    same = F.col("_bin") == F.col("_of_bin")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    within = Window.partitionBy(*by, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = cut if dealt else cut.repartition(*by, "_bin")
    return rows.join(F.broadcast(carried), same).withColumn("_within", add(None, within)).drop("_of_bin", *[f"_of_{c}" for c in by])


def max_before(df: DataFrame, by: list[str], place: str, order: list[Column | str], value: Column, name: str, width: int = BIN, keep: bool = False) -> DataFrame:
    """``df`` with the largest ``value`` of earlier rows of the key, null for the first; ``place`` rises with ``order``."""

    def add(column: str | None, window) -> Column:
        return F.max(F.col(column) if column else value).over(window)

    found = _before(df, by, order, F.max(value), add, width, place)
    return found.withColumn(name, F.greatest("_carried", "_within")).drop(*_gone(keep))


def sum_through(df: DataFrame, by: list[str], place: str, order: list[Column | str], value: Column, name: str, width: int = BIN, keep: bool = False) -> DataFrame:
    """``df`` with the sum of ``value`` over earlier rows of the key and the row itself."""

    def add(column: str | None, window) -> Column:
        return F.coalesce(F.sum(F.col(column) if column else value).over(window), F.lit(0))

    found = _before(df, by, order, F.sum(value), add, width, place)
    return found.withColumn(name, F.col("_carried") + F.col("_within") + value).drop(*_gone(keep))


def last_before(df: DataFrame, by: list[str], place: str, order: list[Column | str], value: Column, name: str, width: int = BIN, keep: bool = False) -> DataFrame:
    """``df`` with ``value`` (a non-null struct or number) of the row before, null for the first of the key."""
    rank = F.struct(*order)

    def add(column: str | None, window) -> Column:
        return F.last(F.col(column), ignorenulls=True).over(window) if column else F.last(value).over(window)

    found = _before(df, by, order, F.max_by(value, rank), add, width, place)
    return found.withColumn(name, F.coalesce("_within", "_carried")).drop(*_gone(keep))
