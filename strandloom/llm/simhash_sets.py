"""SimHash near-dedup of word-shingle sets: tiled comparison of wide fingerprints, then an exact check of similarity.

:mod:`simhash` links fingerprints within a few bits. To reach every pair of texts whose sets of shingles have a Jaccard
similarity of ``least`` the radius must be wide, so fingerprints here have 256 bits, which still tell unrelated texts apart
(about 128 bits differ), and each pair within the radius is checked against the sets themselves.

1. A text is the set of its shingles' XXH64 hashes; equal sets are one node. A node's fingerprint has a bit where over half
   of the set's (mixed) hashes have it.
2. Nodes go to tiles by the logarithm of their set's size: a similarity of 0.8 needs sizes within a factor of 1.25, so a tile
   meets itself and its smaller neighbour. Blocks of a tile are compared with exclusive-or and bit counts; block pairs whose
   sizes or population counts are too far apart are skipped. Large tiles are split, and each pair of parts is one task, which
   writes a forest of its candidates, never all pairs.
3. Nodes that are connected by candidates are a case. A case's sets meet in one task, or, if they are large, in one task
   for each pair of its parts; common shingles of all its pairs are counted there from inverted lists, so no pair is ever
   written, and only a forest of links of sufficient similarity leaves.

The exact check makes every link right. The radius (:func:`radii`) lies five deviations above the bits that differ at the
least similarity, so it decides nothing but for about one pair in a million at the threshold itself. Comparisons grow with
the square of the nodes of like size.

Defined results: words are split at ASCII white space, A-Z lowered; a text of at most ``words`` words is one shingle; a null
text counts as empty, which is one shingle too; a null identifier takes part and loses to any other; of rows that share
identifier and text one stays; an empty table gives none; the caller's other columns come back untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import simhash
from strandloom.llm.common import batches_of, marked_only, rows_of, small_batches, stored, tidied, whole_text
from strandloom.llm.decontaminate import bounded

#: 64-bit words of a fingerprint.
WIDE = 4
#: The least similarity as a fraction.
LEAST = (4, 5)
#: Home nodes and visitors of a block comparison.
BLOCK, ACROSS = 256, 1024
#: Parts of tiles hold this share of all nodes, within these bounds.
TASKS, LEAST_NODES, MOST_NODES = 256, 1 << 15, 1 << 18
#: Bytes of sets of one part of a case.
PART_BYTES = 32 << 20
#: Entries of inverted lists that are counted at a time.
LISTED = 1 << 20

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def radii(least: tuple[int, int] = LEAST) -> tuple[int, int]:
    """Most differing bits of a fingerprint's first half, and of the whole, for sets of the least similarity.

    Sets of equal size and Jaccard similarity s are at an angle whose cosine is 2s / (1 + s); a bit differs with a chance of
    the angle over pi, and a quarter more in sets of a few shingles, where ties are frequent.
    """
    s = least[0] / least[1]
    chance = min(0.5, 1.25 * math.acos(2 * s / (1 + s)) / math.pi)
    most = lambda bits, deviations: math.ceil(bits * chance + deviations * math.sqrt(bits * chance * (1 - chance)))
    return most(32 * WIDE, 6), most(64 * WIDE, 5)


def shingles(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    found = text.lower().split()
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)], np.uint64).view(np.int64)
    hashed = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False))
    return np.unique(np.fromiter((hashed(gram, seed) for gram in grams), "<u8", len(found) - words + 1).view(np.int64))


def wide_print(grams: np.ndarray) -> bytes:
    """The fingerprint of a set of hashes: a bit is one if it is set in over half of them, each mixed into ``WIDE`` words."""
    counts = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(grams), 255):
        part = grams[at : at + 255].view(np.uint64)
        mixed = np.empty((len(part), WIDE), "<u8")
        mixed[:, 0] = part
        for k in range(1, WIDE):
            word = part * _ODD[k]
            word ^= word >> np.uint64(32)
            word *= _ODD[k - 1]
            mixed[:, k] = word ^ (word >> np.uint64(29))
        # at most 255 rows, so that eight bits hold each sum
        counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(grams), bitorder="little").tobytes()


def _node(grams: np.ndarray) -> int:
    value = xxhash.xxh64_intdigest(grams.tobytes())
    return value - (1 << 64) if value >> 63 else value


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(docs[text_col])
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("hashed"), text.cast("binary").alias("text"))


def prints(texts: DataFrame, words: int = 5, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row for each text: ``doc_id, hashed, print`` (a hash of its set), ``n`` (the set's size), ``band`` (its tile), ``bits``."""
    step = math.log(least[1] / least[0])
    schema = pa.schema([("doc_id", pa.int64()), ("hashed", pa.int64()), ("print", pa.int64()), ("n", pa.int64()), ("band", pa.int32()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text, words) for text in batch.column(2).to_pylist()]
            sizes = list(map(len, sets))
            bands = [math.floor(math.log(size) / step) for size in sizes]
            yield pa.record_batch([*batch.columns[:2], pa.array(map(_node, sets), pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.int32()), pa.array(map(wide_print, sets), pa.binary())], schema=schema)

    return texts.mapInArrow(tidied(run), "doc_id long, hashed long, print long, n long, band int, bits binary")


class Nodes:
    """Nodes of a tile in order of their size."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        names, sizes, bits = (np.concatenate(column) for column in zip(*parts, strict=True))
        order = np.argsort(sizes, kind="stable")
        self.names, self.sizes, self.bits = names[order], sizes[order], bits[order]
        self.population = np.bitwise_count(self.bits).sum(1, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.names)


def candidates(home: Nodes, visitors: Nodes, own: bool, least: tuple[int, int] = LEAST) -> list[tuple[int, int]]:
    """Pairs of nodes within the radius whose sizes allow the similarity, without those that join nothing new.

    ``own`` says that the visitors are the same tile's nodes, so that those of a size below a block's have met it already.
    """
    first_half, whole = radii(least)
    links: list[tuple[int, int]] = []
    h_label, v_label = np.arange(len(home)), len(home) + np.arange(len(visitors))
    order = np.argsort(home.names)
    at = order[np.minimum(np.searchsorted(home.names, visitors.names, sorter=order), len(home) - 1)]
    v_label = np.where(home.names[at] == visitors.names, at, v_label)  # the same node
    for at in range(0, len(home), BLOCK):
        block = slice(at, min(at + BLOCK, len(home)))
        smallest, largest = int(home.sizes[block][0]), int(home.sizes[block][-1])
        begin = np.searchsorted(visitors.sizes, smallest if own else -(-smallest * least[0] // least[1]))
        end = np.searchsorted(visitors.sizes, largest * least[1] // least[0], "right")
        h_bits, h_population = home.bits[block], home.population[block]
        for to in range(int(begin), int(end), ACROSS):
            across = slice(to, min(to + ACROSS, int(end)))
            v_population = visitors.population[across]
            if v_population.min() - h_population.max() > whole or h_population.min() - v_population.max() > whole:
                continue
            v_bits = visitors.bits[across]
            apart = np.zeros((len(h_bits), len(v_bits)), np.uint8)
            for k in range(WIDE // 2):
                apart += np.bitwise_count(h_bits[:, k, None] ^ v_bits[None, :, k])
            rows, columns = np.nonzero(apart <= first_half)
            if not len(rows):
                continue
            total = apart[rows, columns].astype(np.int64)
            for k in range(WIDE // 2, WIDE):
                total += np.bitwise_count(h_bits[rows, k] ^ v_bits[columns, k])
            a, b = home.sizes[at + rows], visitors.sizes[to + columns]
            near = (total <= whole) & (np.minimum(a, b) * least[1] >= np.maximum(a, b) * least[0])
            rows, columns = at + rows[near], to + columns[near]
            edges = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1], [True]])) if len(rows) else []
            for low, high in zip(edges, edges[1:], strict=False):
                row, found = int(rows[low]), columns[low:high]
                others, first = np.unique(v_label[found], return_index=True)
                mine = h_label[row]
                new = others != mine
                if new.any():
                    links.extend((int(home.names[row]), int(visitors.names[found[k]])) for k in first[new].tolist())
                    h_label[np.isin(h_label, others[new])] = mine
                    v_label[np.isin(v_label, others[new])] = mine
    return links


def candidate_links(nodes: DataFrame, least: tuple[int, int] = LEAST, part_nodes: int | None = None) -> DataFrame:
    """Links ``a, b`` that connect all candidates among ``nodes`` (``print, n, band, bits``), a forest of each pair of parts.

    A tile's nodes are dealt to parts of about ``part_nodes`` (by default ``1 / TASKS`` of all nodes within bounds), and each
    pair of its parts, and of its parts and the smaller neighbour's, is one task, so tiles of any size are many like tasks.
    """
    part_nodes = part_nodes or min(MOST_NODES, max(LEAST_NODES, nodes.count() // TASKS))
    # bands are logarithms of sizes, some hundred at most
    sizes = F.broadcast(nodes.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / part_nodes).cast("int").alias("parts")))
    at = lambda step, name: sizes.select((F.col("band") - step).alias(f"{name}_band"), F.col("parts").alias(f"{name}_parts"))
    own, lower, upper = at(0, "own"), at(-1, "lower"), at(1, "upper")
    met = nodes.join(own, F.col("band") == F.col("own_band")).withColumn("part", F.pmod(F.xxhash64("print"), F.col("own_parts")).cast("int"))
    met = met.join(lower, F.col("band") == F.col("lower_band"), "left").join(upper, F.col("band") == F.col("upper_band"), "left")
    to = lambda band, i, kind, j, role: F.struct(band.alias("band"), i.cast("int").alias("i"), F.lit(kind).alias("kind"), j.cast("int").alias("j"), role.cast("int").alias("role"))
    part, each = F.col("part"), lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    within = F.transform(each("own_parts"), lambda k: to(F.col("band"), F.least(k, part), 0, F.greatest(k, part), part > k))
    down = F.when(F.col("lower_parts").isNotNull(), F.transform(each("lower_parts"), lambda k: to(F.col("band"), part, 1, k, F.lit(0))))
    up = F.when(F.col("upper_parts").isNotNull(), F.transform(each("upper_parts"), lambda k: to(F.col("band") + 1, k, 1, part, F.lit(1))))
    none = F.slice(within, 1, 0)
    dealt = met.select("print", "n", "bits", F.explode(F.concat(within, F.coalesce(down, none), F.coalesce(up, none))).alias("to")).select("print", "n", "bits", "to.*")
    dealt = dealt.repartition("band", "i", "kind", "j").sortWithinPartitions("band", "i", "kind", "j", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home: list[tuple] = []
        visitors: list[tuple] = []

        def compare(key: tuple) -> Iterator[tuple]:
            own = key[2] == 0 and key[1] == key[3]
            if home and (visitors or own):
                first = Nodes(home)
                for a, b in candidates(first, first if own else Nodes(visitors), own, least):
                    yield min(a, b), max(a, b)
            home.clear()
            visitors.clear()

        def rows() -> Iterator[tuple]:
            now = None
            for batch in batches:
                names, sizes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                bits = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(-1, WIDE)
                keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3, 8)], 1)
                edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
                for a, b in zip(edges, edges[1:], strict=False):
                    if a == b:
                        continue
                    *key, role = keys[a].tolist()
                    if tuple(key) != now:
                        if now:
                            yield from compare(now)
                        now = tuple(key)
                    (visitors if role else home).append((names[a:b], sizes[a:b], bits[a:b]))
            if now:
                yield from compare(now)

        yield from batches_of(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64())]), 10_000)

    return dealt.mapInArrow(tidied(run), "a long, b long").filter("a <> b").distinct()


def similar(names: list[int], sets: list[np.ndarray], first: int, least: tuple[int, int] = LEAST) -> list[tuple[int, int]]:
    """Links of sufficient similarity between the sets before place ``first`` and those from there on, or among all sets if
    ``first`` is 0; without those that join nothing new.
    """
    m = len(sets)
    sizes = np.array(list(map(len, sets)))
    owner = np.repeat(np.arange(m), sizes)
    _, gram = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(gram, kind="stable")
    lists = owner[order]
    begins = np.concatenate([[0], np.cumsum(np.bincount(gram))])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    label = np.arange(m)
    links: list[tuple[int, int]] = []
    for row in range(first or m):
        if (label == label[0]).all():
            break
        own = gram[ends[row] : ends[row + 1]]
        a, lengths = begins[own], begins[own + 1] - begins[own]
        a, lengths = a[lengths > 1], lengths[lengths > 1]
        common = np.zeros(m, np.int64)
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        at = 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + LISTED, "right")) - 1)
            places = np.repeat(a[at:to] - (cuts[at:to] - cuts[at]), lengths[at:to]) + np.arange(cuts[to] - cuts[at])
            common += np.bincount(lists[places], minlength=m)
            at = to
        near = common * (least[0] + least[1]) >= least[0] * (sizes[row] + sizes)  # of the union, common is ``least`` at the least
        near[: first or row + 1] = False
        found = np.flatnonzero(near)
        others, where = np.unique(label[found], return_index=True)
        new = others != label[row]
        if new.any():
            links.extend((names[row], names[found[k]]) for k in where[new].tolist())
            label[np.isin(label, others[new])] = label[row]
    return links


def checked_links(cases: DataFrame, nodes: DataFrame, texts: DataFrame, words: int = 5, least: tuple[int, int] = LEAST, part_bytes: int = PART_BYTES) -> DataFrame:
    """Links ``a, b`` of sufficient similarity within cases (``node, root``), which connect all such pairs of a case.

    ``nodes`` has ``print, doc_id, hashed`` of every text, and ``n``, its set's size.
    """
    known = nodes.join(bounded(cases), F.col("print") == F.col("node")).groupBy("print", "root").agg(F.min("n").alias("n"), F.min(F.struct("hashed", "doc_id")).alias("one"))
    known = stored(known.select("print", "root", "n", "one.doc_id", "one.hashed"), "simhash-cases")
    held = known.groupBy("root").agg(F.ceil(F.sum("n") * 8 / part_bytes).cast("int").alias("parts")).select(F.col("root").alias("of_root"), "parts")
    part = F.pmod(F.xxhash64("print", F.lit(7)), F.col("parts")).cast("int")
    placed = known.join(bounded(held), F.col("root") == F.col("of_root")).select(F.col("print").alias("name"), "root", "parts", part.alias("part"))
    marked = marked_only(texts, known.select("doc_id", "hashed"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (text,) in rows_of(batches):
                grams = shingles(text, words)
                yield _node(grams), grams.tobytes()

        yield from batches_of(rows(), pa.schema([("node", pa.int64()), ("grams", pa.binary())]))

    # a text that the bit map lets through without need meets no case; repeated sets are one
    found = marked.select("text").mapInArrow(tidied(hashes), "node long, grams binary").join(bounded(placed), F.col("node") == F.col("name")).dropDuplicates(["node"])
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, "part").alias("i"), F.greatest(k, "part").alias("j")))
    dealt = found.select("root", F.explode(pairs).alias("pair"), "part", "node", "grams").select("root", "pair.i", "pair.j", "part", "node", "grams")
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "part", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(key: tuple, group: list[tuple]) -> Iterator[tuple]:
            first = sum(part == key[1] for part, _, _ in group) if key[1] < key[2] else 0
            if len(group) > 1 and (first or key[1] == key[2]) and first < len(group):
                for a, b in similar([node for _, node, _ in group], [np.frombuffer(grams, np.int64) for _, _, grams in group], first, least):
                    yield min(a, b), max(a, b)

        def rows() -> Iterator[tuple]:
            key, group = None, []
            for root, i, j, part, node, grams in rows_of(batches):
                if (root, i, j) != key:
                    if group:
                        yield from settle(key, group)
                    key, group = (root, i, j), []
                group.append((part, node, grams))
            if group:
                yield from settle(key, group)

        yield from batches_of(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64())]), 10_000)

    return stored(dealt.mapInArrow(tidied(compare), "a long, b long").distinct(), "simhash-links")


def similar_groups(docs: DataFrame, words: int = 5, least: tuple[int, int] = LEAST, id_col: str = "doc_id", text_col: str = "text", part_nodes: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row for each input row: ``doc_id, hashed`` (of the text), ``print`` (of the set), ``component_id`` (smallest identifier
    reachable over links of sufficient similarity) and ``class`` (the same value throughout a component)."""
    small_batches(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    found = stored(prints(texts, words, least), "simhash-sets")
    nodes = stored(found.groupBy("print").agg(F.min("n").alias("n"), F.min("band").alias("band"), F.min("bits").alias("bits")), "simhash-nodes")
    cases = simhash.components(candidate_links(nodes, least, part_nodes))
    links = checked_links(cases, found, texts, words, least, part_bytes)
    return simhash.named(found.select("doc_id", "hashed", "print"), links)


def representatives(docs: DataFrame, words: int = 5, least: tuple[int, int] = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: the one with the smallest identifier."""
    return simhash.least_rows(docs, similar_groups(docs, words, least, id_col, text_col), id_col, text_col)
