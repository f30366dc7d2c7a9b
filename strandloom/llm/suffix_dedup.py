"""Suffix-array deduplication of repeated byte strings, over sampled suffixes.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else. A full suffix array would
shuffle every suffix; this one holds a sample that loses nothing. Of every string of ``length`` bytes the *anchor* is the
position whose next ``GRAM`` bytes hash lowest (leftmost on ties), so equal strings have equal anchors, and about one
suffix in 85 is an anchor. The strings that share an anchor are neighbours: a *run*, of up to 169 start positions, with
one text. Two equal strings always lie in runs whose anchors begin with the same bytes.

1. One pass over all texts gives the runs, with 64-bit hashes of their leading bytes and of their whole text, which together
   stand for the text where runs are counted. Equal runs within
   an Arrow batch are settled there and send on one row, so copies are pre-aggregated before any shuffle.
2. Runs meet by their leading bytes. Where all runs with the same leading bytes have the same text, all their strings are
   repeated. Where texts differ, each text counts once, with its number of occurrences.
3. Texts that occur once among differing ones are compared in full. Each is cut into bands of start positions, whose
   suffixes are range-partitioned by their leading bytes (the bytes that all strings of the band share, over half a
   string's length, so a frequent short phrase is no hot key). Sampled splitters never part equal leading bytes, so no
   group lies across a boundary. Within a bucket, suffixes to the right and reversed prefixes to the left are sorted by
   multikey quicksort, and neighbours' common lengths say for each start position whether its string is repeated.
4. Repeated start positions become byte ranges for each document. Only documents that lose some bytes and keep others
   meet their text again; a bit map of fixed size keeps the rest out of that shuffle.

Documents are known by identifier and text hash. Defined results: a null text counts as empty; texts shorter than
``length`` lose nothing; rows that share identifier and text are two documents, which repeat each other; null identifiers
are allowed; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import batches_of, marked_only, rows_of, small_batches, stored, tidied, whole_text
from strandloom.llm.decontaminate import bounded

#: Leading bytes by which anchors are chosen and meet; a multiple of eight.
GRAM = 32
BANDS = 2
#: Start positions that are hashed at a time.
SEGMENT = 1 << 19
#: Groups up to this size are compared pair by pair, larger ones by sorting.
FEW = 6
#: Pieces of a group from which on it is cut into narrower bands, and these bands' start positions.
MOST_PIECES = 20_000
NARROW = (8, 1)

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_HIGH = np.uint64(0xFFFFFFFF00000000)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at every position that has as many."""
    n = len(data) - GRAM + 1
    words = np.empty(len(data) - 7, np.uint64)
    for k in range(8):
        part = data[k : k + (len(data) - k) // 8 * 8].view("<u8")
        words[k::8] = part[: len(words[k::8])]
    hashes = words[:n] * _M[0]
    for k in range(8, GRAM, 8):
        hashes ^= words[k : k + n]
        hashes *= _M[1 + k // 8 % 3]
        hashes ^= hashes >> np.uint64(29)
    hashes *= _M[0]
    return hashes


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first start, number of starts and leading hash of every run; positions are in the joined texts."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(text) for text in texts])
    ends = np.cumsum(sizes)
    valid = np.zeros(len(joined) + 1, np.int8)
    long = sizes >= length
    np.add.at(valid, ends[long] - sizes[long], 1)
    np.add.at(valid, ends[long] - length + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).view(bool)
    window = length - GRAM + 1
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(0, len(joined) - length + 1), SEGMENT):
        starts = at + np.flatnonzero(valid[at : at + SEGMENT])
        if not len(starts):
            continue
        data = np.ascontiguousarray(joined[at : at + SEGMENT + length - 1])
        hashes = _gram_hashes(data)
        low = (hashes & _HIGH) | np.arange(len(hashes), dtype=np.uint64)
        step = 1
        while step * 2 <= window:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < window:
            low = np.minimum(low[: len(low) - (window - step)], low[window - step :])
        anchors = (low[starts - at] & ~_HIGH).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        found.append((anchors[new] + at, starts[new], np.diff(np.concatenate([new, [len(starts)]])), hashes[anchors[new]]))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    anchors, first, count, lead = (np.concatenate(parts) for parts in zip(*found, strict=True))
    # a run that a segment's end has cut in two
    same = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (first[1:] != first[:-1] + count[:-1])])
    return anchors[same], first[same], np.add.reduceat(count, np.flatnonzero(same)), lead[same]


_RUNS = pa.schema([("doc_id", pa.int64()), ("hashed", pa.int64()), ("lead", pa.int64()), ("body", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("d", pa.int32()), ("weight", pa.int32()), ("n_bytes", pa.int64()), ("whole", pa.string())])


def _find_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            texts = batch.column(2).to_pylist()
            n = len(texts)
            nothing = [pa.nulls(n, kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())]
            yield pa.record_batch([batch.column(0), batch.column(1), *nothing, pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(text).hexdigest() for text in texts])], schema=_RUNS)
            anchors, first, count, lead = runs(texts, length)
            if not len(anchors):
                continue
            joined = memoryview(b"".join(texts))
            body = np.array([digest(joined[a:b]) for a, b in zip(first.tolist(), (first + count + (length - 1)).tolist(), strict=True)], np.uint64)
            sizes = np.array([len(text) for text in texts])
            ends = np.cumsum(sizes)
            doc = np.searchsorted(ends, first, "right")
            # equal runs of this batch: the first stands for all, and the others are known to be repeated
            order = np.lexsort((body, lead))
            new = np.concatenate([[True], (lead[order][1:] != lead[order][:-1]) | (body[order][1:] != body[order][:-1])])
            heads = np.flatnonzero(new)
            weight = np.zeros(len(lead), np.int32)
            weight[order[heads]] = np.diff(np.concatenate([heads, [len(lead)]]))
            take = pa.array(doc)
            m = len(doc)
            columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(lead.view(np.int64)), pa.array(body.view(np.int64)), pa.array(first - (ends - sizes)[doc]), pa.array(count.astype(np.int32)), pa.array((anchors - first).astype(np.int32)), pa.array(weight), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string())]
            yield pa.record_batch(columns, schema=_RUNS)

    return run


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    high = min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    low = 0
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def multikey_sorted(keys: list[bytes]) -> list[int]:
    """Order of byte strings by multikey quicksort (Bentley and Sedgewick, 1997), eight bytes at a time."""
    order: list[int] = []
    stack = [(list(range(len(keys))), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) == 1 or depth < 0:
            order.extend(rows)
            continue
        pivot = keys[rows[len(rows) // 2]][depth : depth + 8]
        less, same, more = [], [], []
        for row in rows:
            part = keys[row][depth : depth + 8]
            (less if part < pivot else more if part > pivot else same).append(row)
        if more:
            stack.append((more, depth))
        stack.append((same, depth + 8 if len(pivot) == 8 else -1))
        if less:
            stack.append((less, depth))
    return order


def repeated_starts(group: list[tuple[bytes, int, int, bool]], core: int, length: int) -> list[list[tuple[int, int]]]:
    """For each text of a group that shares ``core`` bytes, ranges of start positions whose string others have too.

    A member is (text, place of the core in it, number of start positions, whether its ranges are wanted).
    """
    lefts = [text[:at][::-1] for text, at, _, _ in group]
    rights = [text[at + core :] for text, at, _, _ in group]
    if len(group) <= FEW:
        out = []
        for i, (_, at, n, wanted) in enumerate(group):
            ranges = []
            for j in range(len(group)) if wanted else ():
                if i != j:
                    # a start d bytes before the core needs d equal bytes on the left and length - core - d on the right
                    most, least = min(_common(lefts[i], lefts[j]), at), max(length - core - _common(rights[i], rights[j]), at - n + 1)
                    if least <= most:
                        ranges.append((at - most, at - least + 1))
            out.append(ranges)
        return out
    m = len(group)

    def sorted_lengths(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        order = multikey_sorted(keys)
        return np.array(order), np.array([_common(keys[a], keys[b]) for a, b in zip(order, order[1:], strict=False)])

    (l_order, l_same), (r_order, r_same) = sorted_lengths(lefts), sorted_lengths(rights)
    places, counts = np.array([at for _, at, _, _ in group]), np.array([n for _, _, n, _ in group])
    l_size, r_size = np.array([len(key) for key in lefts]), np.array([len(key) for key in rights])
    out = [[] for _ in group]
    l_class, r_class = np.empty(m, np.int64), np.empty(m, np.int64)
    for d in range(max(0, int((places - counts + 1).min())), int(places.max()) + 1):
        need = length - core - d
        if need < 0:
            break
        here = np.flatnonzero((d <= places) & (d > places - counts) & (l_size >= d) & (r_size >= need))
        if len(here) < 2:
            continue
        l_class[l_order] = np.concatenate([[0], np.cumsum(l_same < d)])
        r_class[r_order] = np.concatenate([[0], np.cumsum(r_same < need)])
        both = l_class[here] * m + r_class[here]
        _, inverse, number = np.unique(both, return_inverse=True, return_counts=True)
        for row in here[number[inverse] > 1].tolist():
            if group[row][3]:
                start = int(places[row]) - d
                if out[row] and out[row][-1][0] == start + 1:
                    out[row][-1] = (start, out[row][-1][1])
                else:
                    out[row].append((start, start + 1))
    return out


def _bands(length: int, bands: int) -> list[tuple[int, int]]:
    """Ranges of anchor distances, nearly equal."""
    edges = np.linspace(0, length - GRAM + 1, bands + 1).astype(int).tolist()
    return [(a, b - 1) for a, b in zip(edges, edges[1:], strict=False)]


_PIECES = pa.schema([("core", pa.binary()), ("band", pa.int32()), ("lead", pa.int64()), ("body", pa.int64()), ("text", pa.binary()), ("place", pa.int32()), ("n", pa.int32()), ("first", pa.int32()), ("wanted", pa.bool_())])
_PIECES_SQL = "core binary, band int, lead long, body long, text binary, place int, n int, first int, wanted boolean"


def _cut_pieces(length: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for text, cases in rows_of(batches):
                for case in cases:
                    at, n, d = case["at"], case["n"], case["d"]
                    anchor = at + d
                    for band, (low, high) in enumerate(_bands(length, bands)):
                        begin, end = max(at, anchor - high), min(at + n - 1, anchor - low)
                        if begin <= end:
                            core = text[anchor - low : anchor - high + length]
                            yield core, band, case["lead"], case["body"], text[begin : end + length], anchor - low - begin, end - begin + 1, begin - at, case["wanted"]

        yield from batches_of(rows(), _PIECES, 5000)

    return run


def _recut(length: int, width: int):
    """Pieces cut again into bands of ``width`` start positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for core, band, lead, body, text, place, n, first, wanted in rows_of(batches):
                for low in range(0, length - len(core) + 1, width):
                    high = min(low + width - 1, length - len(core))
                    begin, end = max(0, place - high), min(n - 1, place - low)
                    if begin <= end:
                        yield text[place - low : place - high + length], band << 10 | low, lead, body, text[begin : end + length], place - low - begin, end - begin + 1, first + begin, wanted

        yield from batches_of(rows(), _PIECES, 5000)

    return run


def compared(pieces: DataFrame, length: int, most_pieces: int = MOST_PIECES) -> DataFrame:
    """``lead, body, low, high``: of stored ``pieces`` the start positions of wanted texts whose strings other texts of their group have.

    Groups of more than ``most_pieces`` are cut into narrower bands first, so a task's list of pieces is bounded; what is
    alone in its band then is dropped, and single strings are only counted.
    """
    key = F.xxhash64("core", "band")
    settled: list[DataFrame] = []
    small: list[DataFrame] = []
    for width in NARROW:
        sizes = pieces.groupBy(key.alias("of_key")).agg(F.count(F.lit(1)).alias("held"))
        large = stored(sizes.filter(F.col("held") > most_pieces).select("of_key"), "hot-pieces")
        if large.isEmpty():
            break
        small.append(pieces.join(bounded(large), key == F.col("of_key"), "left_anti"))
        cut = stored(pieces.join(bounded(large), key == F.col("of_key"), "left_semi").mapInArrow(tidied(_recut(length, width)), _PIECES_SQL), "narrow-pieces", compression="zstd")
        shared = cut.groupBy(key.alias("of_key")).agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
        pieces = stored(cut.join(shared, key == F.col("of_key"), "left_semi"), "shared-pieces", compression="zstd")
        if width == 1:
            many = pieces.groupBy(F.col("core").alias("of_core")).agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
            found = pieces.filter("wanted").join(many, F.col("core") == F.col("of_core"), "left_semi")
            settled.append(found.select("lead", "body", F.col("first").alias("low"), (F.col("first") + F.col("n")).alias("high")))
            pieces = pieces.limit(0)
    for part in small:
        pieces = pieces.union(part)
    ranges = pieces.repartitionByRange("core", "band").sortWithinPartitions("core", "band").mapInArrow(tidied(_compare(length)), "lead long, body long, low int, high int")
    for part in settled:
        ranges = ranges.union(part)
    return ranges


def _compare(length: int):
    schema = pa.schema([("lead", pa.int64()), ("body", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(group: list[tuple]) -> Iterator[tuple]:
            if len(group) > 1 and any(row[8] for row in group):
                for row, ranges in zip(group, repeated_starts([(row[4], row[5], row[6], row[8]) for row in group], len(group[0][0]), length), strict=True):
                    for low, high in ranges:
                        yield row[2], row[3], row[7] + low, row[7] + high

        def rows() -> Iterator[tuple]:
            group: list[tuple] = []
            for row in rows_of(batches):
                if group and (row[1], row[0]) != (group[0][1], group[0][0]):
                    yield from settle(group)
                    group = []
                group.append(row)
            yield from settle(group)

        yield from batches_of(rows(), schema, 10_000)

    return run


def _merged(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("hashed", pa.int64()), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, hashed, ranges in rows_of(batches):
                begins: list[int] = []
                ends: list[int] = []
                for low, high in sorted((each["low"], each["high"]) for each in ranges):
                    if begins and low <= ends[-1]:
                        ends[-1] = max(ends[-1], high + length - 1)
                    else:
                        begins.append(low)
                        ends.append(high + length - 1)
                yield doc_id, hashed, begins, ends

        yield from batches_of(rows(), schema)

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for doc_id, hashed, text, begins, ends in rows_of(batches):
            digest, at = hashlib.sha256(), 0
            for low, high in zip(begins, ends, strict=True):
                digest.update(text[at:low])
                at = high
            digest.update(text[at:])
            yield doc_id, hashed, digest.hexdigest()

    yield from batches_of(rows(), pa.schema([("doc_id", pa.int64()), ("hashed", pa.int64()), ("kept", pa.string())]))


def repeated_ranges(docs: DataFrame, length: int = 200, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents (``doc_id, hashed, n_bytes, whole``, one row for each input row) and, of those that lose bytes, the merged
    byte ranges (``doc_id, hashed, begins, ends``, one row for each document)."""
    if length < 2 * GRAM:
        raise ValueError(f"length is {2 * GRAM} at least")
    small_batches(docs.sparkSession)
    text = whole_text(docs[text_col])
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("hashed"), text.cast("binary").alias("text"))
    found = stored(own.mapInArrow(tidied(_find_runs(length)), "doc_id long, hashed long, lead long, body long, at long, n int, d int, weight int, n_bytes long, whole string"), "runs", compression="zstd")
    met = found.filter("weight > 0").select("doc_id", "hashed", "lead", "body", "at", "n", "d", "weight")
    # sums by partial aggregation and a join, whose hot keys adaptive execution can split, rather than a window over a key
    totals = met.groupBy(F.col("lead").alias("t_lead")).agg(F.sum("weight").alias("total"), (F.min("body") != F.max("body")).alias("mixed")).filter("total > 1")
    met = stored(met.join(totals, F.col("lead") == F.col("t_lead")).drop("t_lead", "total"), "met", compression="zstd")

    of_doc = F.struct("doc_id", "hashed", "at", "n", "d")
    classes = met.filter("mixed").groupBy("lead", "body").agg(F.sum("weight").alias("count"), F.min(of_doc).alias("case"))
    classes = stored(classes, "classes", compression="zstd")
    # stored, so that the join has plain exchanges on both sides and adaptive execution can split a hot lead
    open_leads = stored(classes.filter("count = 1").select(F.col("lead").alias("o_lead")).distinct(), "open-leads", compression="zstd")
    cases = classes.join(open_leads, F.col("lead") == F.col("o_lead"), "left_semi").select("case.doc_id", "case.hashed", F.struct("case.at", "case.n", "case.d", "lead", "body", (F.col("count") == 1).alias("wanted")).alias("case"))
    cases = cases.groupBy("doc_id", "hashed").agg(F.collect_list("case").alias("cases"))
    cases = stored(cases, "cases", compression="zstd").withColumnsRenamed({"doc_id": "c_id", "hashed": "c_hashed"})
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("hashed") == F.col("c_hashed"))
    texts = marked_only(own, cases.select(F.col("c_id").alias("doc_id"), F.col("c_hashed").alias("hashed")))
    pieces = stored(texts.join(cases, same).select("text", "cases").mapInArrow(tidied(_cut_pieces(length, bands)), _PIECES_SQL), "pieces", compression="zstd")
    ranges = compared(pieces, length).groupBy("lead", "body").agg(F.collect_set(F.struct("low", "high")).alias("ranges")).withColumnsRenamed({"lead": "r_lead", "body": "r_body"})
    verdicts = classes.select(F.col("lead").alias("v_lead"), F.col("body").alias("v_body"), "count")
    verdicts = verdicts.join(ranges, (F.col("v_lead") == F.col("r_lead")) & (F.col("v_body") == F.col("r_body")), "left").filter("count > 1 OR ranges IS NOT NULL")

    whole = [F.col("at").alias("low"), (F.col("at") + F.col("n")).alias("high")]
    known = found.filter("weight = 0").select("doc_id", "hashed", *whole)
    alike = met.filter("NOT mixed OR weight > 1").select("doc_id", "hashed", *whole)
    judged = met.filter("mixed AND weight = 1").join(verdicts, (F.col("lead") == F.col("v_lead")) & (F.col("body") == F.col("v_body")))
    of_text = F.when(F.col("count") > 1, F.array(F.struct(F.lit(0).alias("low"), F.col("n").alias("high")))).otherwise(F.col("ranges"))
    judged = judged.select("doc_id", "hashed", "at", F.explode(of_text).alias("range")).select("doc_id", "hashed", (F.col("at") + F.col("range.low")).alias("low"), (F.col("at") + F.col("range.high")).alias("high"))
    covered = known.union(alike).union(judged).groupBy("doc_id", "hashed").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    merged = stored(covered.mapInArrow(tidied(_merged(length)), "doc_id long, hashed long, begins array<long>, ends array<long>"), "ranges", compression="zstd")
    return found.filter("whole IS NOT NULL").select("doc_id", "hashed", "n_bytes", "whole"), merged


def without_repeats(docs: DataFrame, length: int = 200, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    every, ranges = repeated_ranges(docs, length, bands, id_col, text_col)
    ranges = ranges.withColumnsRenamed({"doc_id": "r_id", "hashed": "r_hashed"})
    removed = F.coalesce(F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda total, size: total + size), F.lit(0))
    base = every.join(ranges, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("hashed") == F.col("r_hashed")), "left")
    base = stored(base.select("doc_id", "hashed", "n_bytes", "whole", "begins", "ends", removed.alias("n_removed")), "removed", compression="zstd")
    part = base.filter("n_removed > 0 AND n_removed < n_bytes").select("doc_id", "hashed", "begins", "ends").dropDuplicates(["doc_id", "hashed"])
    text = whole_text(docs[text_col])
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("hashed"), text.cast("binary").alias("text"))
    parts = part.withColumnsRenamed({"doc_id": "p_id", "hashed": "p_hashed"})
    met = marked_only(own, part.select("doc_id", "hashed")).join(parts, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("hashed") == F.col("p_hashed")))
    kept = met.select("doc_id", "hashed", "text", "begins", "ends").mapInArrow(tidied(_keep), "doc_id long, hashed long, kept string").distinct().withColumnsRenamed({"doc_id": "k_id", "hashed": "k_hashed"})
    found = base.join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("hashed") == F.col("k_hashed")), "left")
    digest = F.when(F.col("n_removed") == 0, F.col("whole")).when(F.col("n_removed") == F.col("n_bytes"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept"))
    return found.select("doc_id", "n_bytes", "n_removed", F.coalesce(F.size("begins"), F.lit(0)).cast("long").alias("n_spans"), digest.alias("kept_sha256"))
