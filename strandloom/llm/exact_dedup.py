"""Exact deduplication with Patricia-trie owners.

Texts go to partitions by their length and content hash. Before that shuffle each map task inserts its texts into a
compressed radix trie, so a text that a task holds ten thousand times leaves it once; if the trie outgrows its budget the
heaviest subtrees leave early, as partial counts. Behind the shuffle each partition inserts its full byte strings, in order,
into one trie: which texts are equal is decided byte by byte. Terminal nodes store the identifier that stays and the number of
rows. As the strings come in order, every subtree beside the path to the newest one is complete, and when the trie outgrows
its budget these subtrees are written out and freed, so memory holds the budget and one path. Rows of the input find their
owner by an equi-join on the text's SHA-256, which stands for the text there; the owner side has one row for each distinct
text, so adaptive execution can split a hot group's rows over many tasks.

Defined results: a null text counts as empty; a null identifier loses to any other; rows that share both identifier and
text are ties, of which exactly one is kept; an empty table gives an empty result; the caller's other columns are never
read by name and come back untouched from :func:`deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import batches_of, lower_ascii, rows_of, small_batches, tidied, whole_text

#: Bytes that a task's trie may hold: edges, and what a node takes besides.
TRIE_BYTES = 48 << 20
NODE_BYTES = 400


class Node:
    __slots__ = ("best", "count", "edge", "kids", "tag")

    def __init__(self, edge: bytes) -> None:
        self.edge = edge
        self.kids: dict[int, Node] = {}
        self.count = 0
        self.best: int | None = None
        self.tag: object = None


class PatriciaTrie:
    """Compressed radix trie over byte strings; terminal nodes hold a row count, the best identifier and a tag."""

    def __init__(self, largest: bool = False) -> None:
        self.root = Node(b"")
        self.held = 0
        self.largest = largest

    def insert(self, key: bytes, best: int | None, count: int = 1, tag: object = None) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.kids.get(key[at])
            if child is None:
                child = Node(key[at:])
                self.held += len(child.edge) + NODE_BYTES
                node.kids[key[at]] = child
                node, at = child, len(key)
            elif key.startswith(child.edge, at):
                at += len(child.edge)
                node = child
            else:
                same = _common(child.edge, key, at)
                upper = Node(child.edge[:same])
                child.edge = child.edge[same:]
                upper.kids[child.edge[0]] = child
                node.kids[key[at]] = upper
                self.held += NODE_BYTES
                node, at = upper, at + same
        if not node.count:
            node.best, node.tag = best, tag
        elif best is not None and (node.best is None or (best > node.best) == self.largest):
            node.best = best
        node.count += count

    def terminals(self, node: Node | None = None, before: bytes = b"") -> Iterator[tuple[bytes, Node]]:
        """Every stored string below ``node`` with its terminal node."""
        stack = [(node or self.root, before)]
        while stack:
            top, prefix = stack.pop()
            key = prefix + top.edge
            if top.count:
                yield key, top
            stack.extend((kid, key) for kid in top.kids.values())

    def shed(self) -> Iterator[tuple[bytes, Node]]:
        """Empty the heavier half of the root's subtrees."""
        weights = sorted(((sum(len(n.edge) + NODE_BYTES for n in _nodes(kid)), first) for first, kid in self.root.kids.items()), reverse=True)
        goal = self.held // 2
        for weight, first in weights:
            yield from self.terminals(self.root.kids.pop(first))
            self.held -= weight
            if self.held <= goal:
                break

    def shed_before(self, key: bytes) -> Iterator[tuple[bytes, Node]]:
        """Take out the subtrees of all strings that lie before ``key`` and are none of its beginnings."""
        node, at = self.root, 0
        while True:
            for first in [first for first in node.kids if at < len(key) and first < key[at]]:
                kid = node.kids.pop(first)
                self.held -= sum(len(n.edge) + NODE_BYTES for n in _nodes(kid))
                yield from self.terminals(kid, key[:at])
            child = node.kids.get(key[at]) if at < len(key) else None
            if child is None or not key.startswith(child.edge, at):
                return
            node, at = child, at + len(child.edge)


def _nodes(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        top = stack.pop()
        yield top
        stack.extend(top.kids.values())


def _common(edge: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``edge`` and ``key[at:]``, which differ or end within the edge."""
    low, high = 0, min(len(edge), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if edge[low:middle] == key[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


_PARTIAL = pa.schema([("n_bytes", pa.int64()), ("cell", pa.int64()), ("digest", pa.string()), ("key", pa.binary()), ("best", pa.int64()), ("n", pa.int64())])
_OWNER = pa.schema([("digest", pa.string()), ("best", pa.int64()), ("n", pa.int64())])


def _gather(largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            trie = PatriciaTrie(largest)
            for best, key, cell, digest in rows_of(batches):
                trie.insert(key, best, 1, (cell, digest))
                if trie.held > TRIE_BYTES:
                    for text, node in trie.shed():
                        yield len(text), node.tag[0], node.tag[1], text, node.best, node.count
            for text, node in trie.terminals():
                yield len(text), node.tag[0], node.tag[1], text, node.best, node.count

        yield from batches_of(rows(), _PARTIAL)

    return run


def _own(largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            trie = PatriciaTrie(largest)
            for _, _, digest, key, best, count in rows_of(batches):
                trie.insert(key, best, count, digest)
                if trie.held > TRIE_BYTES:
                    for _, node in trie.shed_before(key):
                        yield node.tag, node.best, node.count
            for _, node in trie.terminals():
                yield node.tag, node.best, node.count

        yield from batches_of(rows(), _OWNER, 10_000)

    return run


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fold_case: bool = True) -> DataFrame:
    """One row for each distinct text: ``digest`` (SHA-256, lowercase hex), ``best`` (the identifier that stays), ``n``."""
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    small_batches(docs.sparkSession)
    text = whole_text(docs[text_col])
    text = lower_ascii(text) if fold_case else text
    own = docs.select(docs[id_col].cast("long").alias("best"), text.alias("key"))
    own = own.select("best", F.col("key").cast("binary").alias("key"), F.xxhash64("key").alias("cell"), F.sha2(F.col("key"), 256).alias("digest"))
    partial = own.mapInArrow(tidied(_gather(keep == "max")), "n_bytes long, cell long, digest string, key binary, best long, n long")
    dealt = partial.repartition("n_bytes", "cell").sortWithinPartitions("key")
    return dealt.mapInArrow(tidied(_own(keep == "max")), "digest string, best long, n long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fold_case: bool = True) -> DataFrame:
    """One row for each input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    text = whole_text(docs[text_col])
    text = lower_ascii(text) if fold_case else text
    members = docs.select(docs[id_col].cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))
    members = members.withColumn("nth", F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy(F.lit(1))))
    found = owners(docs, id_col, text_col, keep, fold_case).select(F.col("digest").alias("text_sha256"), F.col("best").alias("keep_id"), F.col("n").alias("group_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return members.join(found, "text_sha256").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fold_case: bool = True) -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with all their columns."""
    text = whole_text(docs[text_col])
    text = lower_ascii(text) if fold_case else text
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("best"), F.sha2(text, 256).alias("digest"))
    stay = owners(docs, id_col, text_col, keep, fold_case).select(F.col("digest").alias("own_digest"), F.col("best").alias("own_best"))
    met = packed.join(stay, (F.col("digest") == F.col("own_digest")) & F.col("best").eqNullSafe(F.col("own_best")))
    nth = F.row_number().over(Window.partitionBy("digest", "best").orderBy(F.lit(1)))
    return met.withColumn("nth", nth).filter("nth = 1").select("row.*")
