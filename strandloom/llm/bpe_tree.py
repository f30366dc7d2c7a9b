"""Byte-level BPE encoding and decoding by tree concatenation.

A text longer than a leaf is cut into leaves that are encoded in parallel tasks and then joined pairwise, level by level.
A join re-encodes a window around the cut and grows it until both sides agree with it exactly:

* a side agrees where the window ends at a *safe* place, that is before a space that a visible character follows. The
  pre-tokenizer always starts a piece there and scans on without memory, so nothing across that place can change;
* in text without such places, a side agrees if its part of the window and the four characters beyond are a single piece
  and the window's outermost token is the side's own token at that place. A BPE encoding is exactly a sequence whose
  adjacent tokens are all compatible, so an equal outermost token makes the joined sequence the encoding of the whole;
* a window that reaches the far end of a side needs no agreement on that side.

Cuts never fall inside a special string. Leaves are encoded by chunks between safe places, which repeat and are kept in a
bounded memo; a text with a special string or with white space beyond ASCII goes to the library as it is.

Defined results: a null text counts as empty (no ids, empty text); a null identifier stays null; repeated rows each give
a row; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import batches_of, rows_of, small_batches, tidied, whole_text
from strandloom.llm.tokens import Memo, library, pack, settings, special_strings

#: Characters of a leaf; a parameter of the operators, as is the first window's bytes on either side.
LEAF_CHARS = 32_768
WINDOW_BYTES = 64

#: White space whose neighbours the chunking does not reason about.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_CHUNK = re.compile(rb" ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]")
_VISIBLE = bytes([*range(0x21, 0x7F), *range(0xC3, 0xE0)])  # first bytes of characters that are visible for certain


class TreeEncoder:
    """Encodes and decodes with one byte-level tokenizers file."""

    def __init__(self, path: str) -> None:
        config = settings(path)
        pre = config["pre_tokenizer"] or {}
        if config["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or config["model"]["type"] != "BPE":
            raise ValueError("a byte-level BPE tokenizer without normaliser and prefix space is asked for")
        if any(config["model"].get(key) for key in ("ignore_merges", "dropout", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix")):
            raise ValueError("a BPE model is asked for whose ids depend on nothing but its merges, as agreement around a join relies on them")
        self.tokenizer = library(path)
        self.specials = special_strings(path)
        found = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, found))) if found else None
        starts = {text.encode()[0] for text in found}
        self.safe = re.compile(rb" (?=[" + re.escape(bytes(byte for byte in _VISIBLE if byte not in starts)) + rb"])")
        self.special_reach = max(map(len, found), default=1) - 1
        widths = {number: len(token) for token, number in config["model"]["vocab"].items()} | {number: len(text.encode()) for text, number in self.specials.items()}
        self.widths = np.zeros(max(widths) + 1, np.int64)
        self.widths[list(widths)] = list(widths.values())
        self.memo = Memo(self._batch)

    def _batch(self, chunks: list[bytes]) -> list[bytes]:
        return [pack(each.ids) for each in self.tokenizer.encode_batch([chunk.decode() for chunk in chunks], add_special_tokens=False)]

    def whole(self, text: str) -> bytes:
        """Packed ids by the library itself."""
        return pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def leaf(self, text: str) -> bytes:
        """Packed ids of one leaf."""
        if _OTHER_SPACE.search(text) or (self.special and self.special.search(text)):
            return self.whole(text)
        return b"".join(self.memo.of(_CHUNK.findall(text.encode())))

    def cuts(self, text: str, leaf_chars: int) -> list[str]:
        """The text's leaves: halves of halves until none is longer than ``leaf_chars``."""
        if len(text) <= leaf_chars:
            return [text]
        at = len(text) // 2
        reach = self.special_reach
        for found in self.special.finditer(text, max(0, at - reach), min(len(text), at + reach)) if self.special else ():
            if found.start() < at < found.end():
                at = found.start()
        if not at:
            return [text]
        return self.cuts(text[:at], leaf_chars) + self.cuts(text[at:], leaf_chars)

    def join(self, left: tuple[bytes, np.ndarray], right: tuple[bytes, np.ndarray], window: int = WINDOW_BYTES) -> tuple[bytes, np.ndarray]:
        """The (text, ids) of two neighbours as one."""
        (a, a_ids), (b, b_ids) = left, right
        if not len(a) or not len(b):
            return a + b, np.concatenate([a_ids, b_ids])
        a_ends, b_ends = np.cumsum(self.widths[a_ids]), np.cumsum(self.widths[b_ids])
        reach = window
        while True:
            begin, left_safe = self._left(a, a_ends, reach)
            end, right_safe = self._right(b, b_ends, reach)
            text = a[begin:] + b[:end]
            middle = np.frombuffer(self.whole(text.decode()), "<u4")
            i, j = int(np.searchsorted(a_ends, begin, "right")), int(np.searchsorted(b_ends, end, "left")) + 1
            left_ok = left_safe or (middle[0] == a_ids[i] and self._one_piece(a[max(0, begin - 16) : begin].decode("utf-8", "ignore")[-4:], a[begin:].decode()))
            right_ok = right_safe or (middle[-1] == b_ids[j - 1] and self._one_piece(b[end : end + 16].decode("utf-8", "ignore")[:4], b[:end].decode(), True))
            if left_ok and right_ok:
                return a + b, np.concatenate([a_ids[:i], middle, b_ids[j:]])
            reach *= 4

    def _left(self, a: bytes, ends: np.ndarray, reach: int) -> tuple[int, bool]:
        """Where a window of about ``reach`` bytes begins in ``a``, and whether that place is safe."""
        start = len(a) - reach
        if start <= 0:
            return 0, True
        if found := self.safe.search(a, start, len(a)):
            return found.start(), True
        starts = ends[np.searchsorted(ends, start, "left") :]
        for place in starts[:8].tolist():
            if place < len(a) and a[place] & 0xC0 != 0x80:
                return place, False
        return 0, True

    def _right(self, b: bytes, ends: np.ndarray, reach: int) -> tuple[int, bool]:
        """Where a window of about ``reach`` bytes ends in ``b``, and whether that place is safe."""
        if reach >= len(b):
            return len(b), True
        last = None
        for last in self.safe.finditer(b, 1, reach):
            pass
        if last:
            return last.start(), True
        at = int(np.searchsorted(ends, reach, "left"))
        for place in ends[at : at + 8].tolist():
            if place >= len(b):
                break
            if b[place] & 0xC0 != 0x80:
                return place, False
        return len(b), True

    def _one_piece(self, beyond: str, part: str, after: bool = False) -> bool:
        """Whether a side's part of the window, with four characters beyond it, is inside one piece in any surroundings."""
        seen = part + beyond if after else beyond + part
        return len(beyond) == 4 <= len(part) and "'" not in seen and not re.search(r"\s", seen) and len(self.tokenizer.pre_tokenizer.pre_tokenize_str(seen)) == 1

    def fold(self, leaves: list[tuple[bytes, np.ndarray]]) -> tuple[bytes, np.ndarray]:
        """Neighbours joined pairwise until one is left."""
        while len(leaves) > 1:
            leaves = [self.join(leaves[k], leaves[k + 1]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
        return leaves[0]

    def encode(self, text: str, leaf_chars: int = LEAF_CHARS) -> np.ndarray:
        """Ids of a whole text, by leaves and joins, in this process."""
        return self.fold([(part.encode(), np.frombuffer(self.leaf(part), "<u4")) for part in self.cuts(text, leaf_chars)])[1]

    def decode(self, packed: list[bytes]) -> list[str]:
        return self.tokenizer.decode_batch([np.frombuffer(ids, "<u4").tolist() for ids in packed], skip_special_tokens=False)


@functools.lru_cache(maxsize=4)
def tree_encoder(path: str) -> TreeEncoder:
    return TreeEncoder(path)


_DONE = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_()), ("ids", pa.binary())])
_DONE_SQL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean, ids binary"


def encoded(docs: DataFrame, tokenizer_path: str, leaf_chars: int = LEAF_CHARS, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True, lists: bool = False) -> DataFrame:
    """One row for each input row: ``doc_id, n_tokens, ids_sha256``, then ``decoded_sha256`` and ``round_trip`` (whether the decoded
    text is the text) if ``decoded``, and ``ids`` (packed, little-endian unsigned 32-bit integers) if ``lists``.

    Texts of one leaf are encoded where they are read and shuffle nothing. Leaves of longer texts are dealt out by text and
    number, encoded, and met again by the text's digest; one task then holds one such text at a time.
    """
    small_batches(docs.sparkSession)

    def digest(doc_id: int | None, packed: bytes, text: str, whole: bool) -> tuple:
        return doc_id, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest() if decoded else None, whole if decoded else None, packed if lists else None

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tree_encoder(tokenizer_path)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                names, texts = (column.to_pylist() for column in batch.columns)
                packed = [tool.leaf(text) for text in texts]
                back = tool.decode(packed) if decoded else [""] * len(packed)
                yield from map(digest, names, packed, back, map(str.__eq__, back, texts))

        yield from batches_of(rows(), _DONE)

    part = pa.schema([("doc_id", pa.int64()), ("same", pa.binary()), ("k", pa.int32()), ("leaf", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tree_encoder(tokenizer_path)

        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches):
                same = xxhash.xxh3_128_digest(text.encode())
                for k, leaf in enumerate(tool.cuts(text, leaf_chars)):
                    yield doc_id, same, k, leaf.encode()

        yield from batches_of(rows(), part)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tree_encoder(tokenizer_path)
        yield from batches_of(((*row, tool.leaf(row[3].decode())) for row in rows_of(batches)), part.append(pa.field("ids", pa.binary())))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tree_encoder(tokenizer_path)

        def finish(group: list[tuple]) -> Iterator[tuple]:
            by_k = {row[2]: row for row in group}
            text, ids = tool.fold([(by_k[k][3], np.frombuffer(by_k[k][4], "<u4")) for k in sorted(by_k)])
            packed = ids.astype("<u4").tobytes()
            back = tool.decode([packed])[0] if decoded else ""
            for _ in range(sum(row[2] == 0 for row in group)):  # rows that share identifier and text
                yield digest(group[0][0], packed, back, back.encode() == text)

        def rows() -> Iterator[tuple]:
            group: list[tuple] = []
            for row in rows_of(batches):
                if group and row[:2] != group[0][:2]:
                    yield from finish(group)
                    group = []
                group.append(row)
            if group:
                yield from finish(group)

        yield from batches_of(rows(), _DONE)

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), whole_text(docs[text_col]).alias("text"))
    long = F.length("text") > leaf_chars
    leaves = own.filter(long).mapInArrow(tidied(cut), "doc_id long, same binary, k int, leaf binary").repartition("doc_id", "same", "k")
    leaves = leaves.mapInArrow(tidied(encode), "doc_id long, same binary, k int, leaf binary, ids binary")
    met = leaves.repartition("doc_id", "same").sortWithinPartitions("doc_id", "same", "k").mapInArrow(tidied(meet), _DONE_SQL)
    found = own.filter(~long).mapInArrow(tidied(at_once), _DONE_SQL).union(met)
    return found.drop(*(["ids"] if not lists else []), *(["decoded_sha256", "round_trip"] if not decoded else []))
