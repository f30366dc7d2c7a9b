"""Token counts by byte-pair merging with a heap over a linked list.

The lowest-rank adjacent pair is popped again and again; a text's count is its initial symbols minus its merges, and no
identifier is ever made. The tokenizers library gives the normaliser and the pre-tokenizer, so pieces are the library's;
the merging is done here. Pieces and white-space chunks repeat, so their counts are remembered in bounded memos.

Defined results: a null text counts as empty and has no token; a special string inside a text is one token, as the
library takes it by default; a null identifier stays null; repeated rows each give a row; an empty table gives none.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import small_batches, tidied, whole_text
from strandloom.llm.tokens import Memo, drops_white_space, library, settings, special_strings

PLAIN_ENDS = frozenset(b".,;:!?")


class MergeCounter:
    """Counts tokens of texts for one tokenizers file with a BPE model."""

    def __init__(self, path: str) -> None:
        model = settings(path)["model"]
        if model["type"] != "BPE" or model["continuing_subword_prefix"] or model["dropout"] or model["ignore_merges"] or model["byte_fallback"] or model["unk_token"]:
            raise ValueError("a plain BPE model is asked for")
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])}
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocabulary = frozenset(token for token in model["vocab"] if len(token) <= 1 + len(self.suffix))
        tokenizer = library(path)
        self.normalise = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        specials = sorted(special_strings(path), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.by_chunk = drops_white_space(path)
        self.plain = self.by_chunk and all([piece for piece, _ in self.split(self.normalise("aBc" + chr(mark)))] == ["abc", chr(mark)] for mark in PLAIN_ENDS)
        self.pieces = Memo(lambda keys: [self.merge(key.decode()) for key in keys], 500_000)
        self.chunks = Memo(self.chunk_counts)

    def merge(self, piece: str) -> int:
        """Tokens of one pre-tokenized piece: initial symbols minus merges."""
        symbols: list[str | None] = list(piece)
        if self.suffix and symbols:
            symbols[-1] += self.suffix
        for symbol in symbols:
            if symbol not in self.vocabulary:
                raise ValueError(f"the vocabulary has no symbol {symbol!r}")
        n = len(symbols)
        if n < 2:
            return n
        ranks = self.ranks
        heap = [(rank, at) for at in range(n - 1) if (rank := ranks.get((symbols[at], symbols[at + 1]))) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            rank, at = heapq.heappop(heap)
            left, right = symbols[at], after[at]
            if left is None or right >= n or ranks.get((left, symbols[right])) != rank:
                continue  # one of the two has merged with another neighbour meanwhile
            symbols[at] = left = left + symbols[right]
            symbols[right] = None
            after[at] = follows = after[right]
            merges += 1
            if follows < n:
                before[follows] = at
                if (rank := ranks.get((left, symbols[follows]))) is not None:
                    heapq.heappush(heap, (rank, at))
            if (leads := before[at]) >= 0 and (rank := ranks.get((symbols[leads], left))) is not None:
                heapq.heappush(heap, (rank, leads))
        return n - merges

    def chunk_counts(self, chunks: list[bytes]) -> list[int]:
        """Tokens of chunks between ASCII white space; plain letters, with one mark at most behind them, need no splitting."""
        split = []
        for chunk in chunks:
            if self.plain and chunk.isalpha():
                split.append((0, [chunk.lower()]))
            elif self.plain and chunk[-1] in PLAIN_ENDS and chunk[:-1].isalpha():
                split.append((0, [chunk[:-1].lower(), chunk[-1:]]))
            else:
                split.append(self.split_text(chunk.decode("utf-8", "replace")))
        counts = self.pieces.of_texts([pieces for _, pieces in split])
        return [specials + sum(found) for (specials, _), found in zip(split, counts, strict=True)]

    def split_text(self, text: str) -> tuple[int, list[bytes]]:
        """The number of special strings in a text, and the pieces of the rest."""
        count, at, parts = 0, 0, []
        for found in self.special.finditer(text) if self.special else ():
            parts.append(text[at : found.start()])
            count, at = count + 1, found.end()
        parts.append(text[at:])
        return count, [piece.encode() for part in parts if part for piece, _ in self.split(self.normalise(part))]

    def batch(self, texts: list[bytes]) -> list[int]:
        """Token counts of whole texts."""
        if self.by_chunk:
            return [sum(found) for found in self.chunks.of_texts([text.split() for text in texts])]
        split = [self.split_text(text.decode("utf-8", "replace")) for text in texts]
        counts = self.pieces.of_texts([pieces for _, pieces in split])
        return [specials + sum(found) for (specials, _), found in zip(split, counts, strict=True)]


@functools.lru_cache(maxsize=4)
def merge_counter(path: str) -> MergeCounter:
    return MergeCounter(path)


_COUNTED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = merge_counter(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(count.batch(texts), pa.int64())], schema=_COUNTED)

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), whole_text(docs[text_col]).cast("binary").alias("text"))
    counted = own.mapInArrow(tidied(run), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
