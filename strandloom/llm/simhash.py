"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are built per document; equal ones are one node from then on, with the smallest identifier (aggregated on the
map side, so a hot group of copies is one row before any comparison). Nodes go to tiles by the population counts of their
four 16-bit quarters. Two fingerprints within the radius have quarter counts that differ by at most the radius in sum, so
a tile meets only the tiles whose counts are that near; all other tile pairs are skipped. A tile's own nodes ("home") meet
the nodes that visit from nearer-or-equal tiles of smaller key, block by block, with numpy exclusive-or and bit counts. A
tile pair never lists its links: it keeps labels and writes only links that join two label sets, a forest, so a dense
group costs its size rather than its square. Tiles are split by a hash of the fingerprint when they are large: home nodes
into parts, with visitors (and the tile's other parts) sent to each of them.

The forests' links then go through rounds of large-star and small-star contraction on DataFrames until nothing changes;
each round is written to the shared folder.

Defined results: a null text counts as empty; a text without words has fingerprint zero, linked like any other; a null
identifier takes part and loses to any other as a component's name; repeated rows each give a row; an empty table gives
none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import batches_of, rows_of, small_batches, stored, tidied, whole_text

#: Rows of a block of a tile comparison.
BLOCK = 512
#: Home nodes of one part of a tile.
PART_NODES = 32_768
#: Visitors that a task holds at a time; more of them are compared in turns.
MOST_VISITORS = 1 << 20


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash over word shingles: a bit is one if it is set in over half the shingles' XXH64 hashes."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), seed)
    hashed = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False))
    hashes = np.fromiter((hashed(gram, seed) for gram in grams), "<u8", len(found) - words + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id, hashed`` (of the text), ``print`` (the fingerprint's bits as a long)."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("hashed", pa.int64()), ("print", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(text, words, seed) for text in batch.column(2).to_pylist()], np.uint64)
            yield pa.record_batch([*batch.columns[:2], pa.array(prints.view(np.int64), pa.int64())], schema=schema)

    text = whole_text(docs[text_col])
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("hashed"), text.cast("binary").alias("text"))
    return own.mapInArrow(tidied(run), "doc_id long, hashed long, print long")


def _offsets(radius: int) -> list[int]:
    """Differences of packed quarter counts that tiles within the radius can have, smaller keys only."""
    near = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    return sorted({((d[0] * 32 + d[1]) * 32 + d[2]) * 32 + d[3] for d in near if d < (0, 0, 0, 0)})


def forest(home: np.ndarray, visitors: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between ``home`` and ``visitors`` within the radius, without those that join nothing new."""
    links: list[tuple[int, int]] = []
    h_label, v_label = np.arange(len(home)), len(home) + np.arange(len(visitors))
    if len(home):  # a node of the tile that visits is the same node
        order = np.argsort(home)
        at = order[np.minimum(np.searchsorted(home, visitors, sorter=order), len(home) - 1)]
        v_label = np.where(home[at] == visitors, at, v_label)
    for at in range(0, len(home), BLOCK):
        block = home[at : at + BLOCK]
        for to in range(0, len(visitors), 4 * BLOCK):
            apart = np.bitwise_count(block[:, None] ^ visitors[None, to : to + 4 * BLOCK])
            near = (apart - np.uint8(1)) < radius  # in eight bits, so that a node doesn't meet itself
            for row in np.flatnonzero(near.any(1)).tolist():
                found = to + np.flatnonzero(near[row])
                labels = v_label[found]
                mine = h_label[at + row]
                others, first = np.unique(labels, return_index=True)
                new = others != mine
                if not new.any():
                    continue
                links.extend((int(block[row]), int(visitors[found[k]])) for k in first[new].tolist())
                joined = others[new]
                h_label[np.isin(h_label, joined)] = mine
                v_label[np.isin(v_label, joined)] = mine
    return links


def links(prints: DataFrame, radius: int = 2, part_nodes: int = PART_NODES) -> DataFrame:
    """Links ``a, b`` (``a < b`` as longs) between distinct values of the column ``print`` that connect all within the radius."""
    count = [F.bit_count(F.shiftrightunsigned("print", 48 - 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    key = ((count[0] * 32 + count[1]) * 32 + count[2]) * 32 + count[3]
    nodes = stored(prints.select("print").distinct().withColumn("tile", key.cast("int")), "simhash-nodes")
    sizes = nodes.groupBy("tile").agg(F.count(F.lit(1)).alias("held")).select(F.col("tile").alias("at"), F.greatest(F.lit(1), F.ceil(F.col("held") / part_nodes)).cast("int").alias("parts"))
    # at most 17**4 rows, whatever the input
    sizes = F.broadcast(sizes)
    part = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    homes = nodes.join(sizes, F.col("tile") == F.col("at")).select("print", "tile", part.alias("part"), F.lit(True).alias("home"))
    # a tile's own nodes also visit its parts: each of them when there are more than one
    steps = F.array(*[F.lit(step) for step in [*_offsets(radius), 0]])
    visits = nodes.select("print", F.explode(F.transform(steps, lambda step: F.col("tile") - step)).alias("to"))
    visits = visits.join(sizes, F.col("to") == F.col("at")).select("print", F.col("to").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("home"))
    dealt = homes.unionByName(visits).repartition("tile", "part").sortWithinPartitions("tile", "part", F.desc("home"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home: list[np.ndarray] = []
        visitors: list[np.ndarray] = []

        def compare() -> Iterator[tuple]:
            if home and visitors:
                for a, b in forest(np.concatenate(home).view(np.uint64), np.concatenate(visitors).view(np.uint64), radius):
                    a, b = (x - (1 << 64) if x >> 63 else x for x in (a, b))
                    yield min(a, b), max(a, b)
            visitors.clear()

        def rows() -> Iterator[tuple]:
            now = None
            for batch in batches:
                prints, tile, part, own = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
                keys = (tile.astype(np.int64) << 32 | part) << 1 | ~own.astype(bool)
                edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
                for a, b in zip(edges, edges[1:], strict=False):
                    if keys[a] >> 1 != now:
                        yield from compare()
                        home.clear()
                    now = keys[a] >> 1
                    (visitors if keys[a] & 1 else home).append(prints[a:b])
                    if sum(map(len, visitors)) >= MOST_VISITORS:
                        yield from compare()
            yield from compare()

        yield from batches_of(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64())]), 10_000)

    return dealt.mapInArrow(tidied(run), "a long, b long").filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an undirected graph of links ``a, b``; the root is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): links at most double a node's own, the number of
    rounds grows with the logarithm of the graph's diameter, and each round is written to the shared folder.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "star")
    # two sums that do not depend on order tell whether a round has changed anything
    state = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u")), F.bit_xor(F.xxhash64("u", "v", F.lit(1)))).first()
    was = state(edges)
    while True:
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("low")).select(F.col("v").alias("x"), F.least("low", "v").alias("low"))
        large = both.join(least, F.col("v") == F.col("x")).filter("u > v").select(F.col("u").alias("v"), F.col("low").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("low")).select(F.col("v").alias("x"), "low")
        small = large.join(least, F.col("v") == F.col("x"))
        small = small.select("v", F.col("low").alias("u")).union(small.filter("u > low").select(F.col("u").alias("v"), F.col("low").alias("u"))).distinct()
        edges = stored(small, "star")
        now = state(edges)
        if now == was:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()
        was = now


def named(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows ``doc_id, hashed, print`` with ``component_id`` and ``class`` by links between values of ``print``."""
    roots = components(edges)
    lowest = prints.groupBy("print").agg(F.min("doc_id").alias("lowest"))
    classes = lowest.join(roots, F.col("print") == F.col("node"), "left").select("print", "lowest", F.coalesce("root", "print").alias("class"))
    names = classes.groupBy("class").agg(F.min("lowest").alias("component_id")).select(F.col("class").alias("named"), "component_id")
    classes = classes.join(names, F.col("class") == F.col("named")).select(F.col("print").alias("of_print"), "component_id", "class")
    found = prints.join(classes, F.col("print") == F.col("of_print"))
    return found.select("doc_id", "hashed", "print", "component_id", "class")


def near_groups(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id, fingerprint`` (16 lowercase hex digits), ``component_id`` (smallest identifier reachable),
    ``hashed`` (of the text), ``class`` (the same value throughout a component)."""
    prints = stored(fingerprints(docs, words, 42, id_col, text_col), "simhash-prints")
    found = named(prints, links(prints, radius))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "hashed", "class")


def representatives(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: the one with the smallest identifier."""
    return least_rows(docs, near_groups(docs, words, radius, id_col, text_col), id_col, text_col)


def least_rows(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each ``class`` of ``groups`` (``doc_id, hashed, class``): the one with the smallest identifier."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hashed")
    stay = groups.groupBy("class").agg(F.min(order).alias("least"))
    stay = stay.select(F.col("least.doc_id").alias("stay_id"), F.col("least.hashed").alias("stay_hashed")).distinct()
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("own_id"), F.xxhash64(whole_text(docs[text_col])).alias("own_hashed"))
    met = packed.join(stay, F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("own_hashed") == F.col("stay_hashed")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("own_id", "own_hashed").orderBy(F.lit(1)))
    return met.withColumn("nth", nth).filter("nth = 1").select("row.*")
