"""What the tokenizer operators share: the library's tokenizers in a worker, and memos of what white space separates.

A memo lives as long as its Python worker and is emptied when it is full, so its memory is bounded at any input size.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

import numpy as np

#: Entries of a memo before it forgets what it has not used lately.
MEMO_ENTRIES = 300_000


@functools.lru_cache(maxsize=4)
def library(path: str):
    """The tokenizers library's tokenizer for a JSON file, without truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@functools.lru_cache(maxsize=4)
def settings(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def special_strings(path: str) -> dict[str, int]:
    """Strings that the library takes as one token wherever a text has them, with their ids."""
    found = {}
    for token in settings(path)["added_tokens"]:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"] or re.search(r"\s", token["content"]):
            raise ValueError(f"added token {token['content']!r} depends on its surroundings")
        found[token["content"]] = token["id"]
    return found


def drops_white_space(path: str) -> bool:
    """Whether the pre-tokenizer ends pieces at white space and leaves it out."""
    pre = library(path).pre_tokenizer.pre_tokenize_str
    pieces = lambda text: [piece for piece, _ in pre(text)]
    return pieces("a b\n.c") == pieces("a") + pieces("b") + pieces(".c")


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if packed.itemsize != 4:
        raise ValueError("unsigned int has four bytes on supported platforms")
    return packed.tobytes()


class Memo:
    """Values of keys, computed together for those that are missing; when full it keeps what was used since the last time."""

    def __init__(self, compute, entries: int = MEMO_ENTRIES) -> None:
        self.compute, self.entries = compute, entries
        self.known: dict = {}
        self.old: dict = {}

    def fill(self, keys: set[bytes]) -> None:
        """Make sure that all ``keys`` are known."""
        missing = keys.difference(self.known)
        if len(self.known) + len(missing) > self.entries:
            self.old, self.known = self.known, {}
            missing = keys
        if self.old:
            again = missing.difference(missing.difference(self.old))  # looks up only what is missing, however much was known
            self.known.update(zip(again, map(self.old.__getitem__, again), strict=True))
            missing = missing.difference(again)
        if missing:
            new = list(missing)
            self.known.update(zip(new, self.compute(new), strict=True))

    def of(self, keys: list[bytes]) -> list:
        """The values of ``keys``, in order."""
        return self.of_texts([keys])[0]

    def of_texts(self, split: list[list[bytes]]) -> list[list]:
        """For each text, the values of its chunks: one look-up for each chunk, and a second one for new chunks."""
        found: list[list] = []
        new: set[bytes] = set()
        gaps: list[tuple[list, list[bytes], list[int]]] = []
        for chunks in split:
            values = list(map(self.known.get, chunks))
            found.append(values)
            if None in values:
                at = [k for k, value in enumerate(values) if value is None]
                new.update([chunks[k] for k in at])
                gaps.append((values, chunks, at))
        if new:
            self.fill(new)
            known = self.known
            for values, chunks, at in gaps:
                for k in at:
                    values[k] = known[chunks[k]]
        return found


class BulkMerger:
    """Byte-pair merging of many pieces at once: each round merges every piece's lowest-rank pair, on whole arrays.

    Pieces are byte strings of one pre-tokenized piece each. Pair ranks are in an open-addressing table, so that a lookup
    is a few array reads.
    """

    NONE = np.int32(2**31 - 1)

    def __init__(self, path: str) -> None:
        model = settings(path)["model"]
        if model["type"] != "BPE" or any(model[key] for key in ("continuing_subword_prefix", "dropout", "ignore_merges", "byte_fallback", "unk_token")):
            raise ValueError("a plain BPE model is asked for")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[symbol] for symbol in symbols], np.int64)
        self.last = np.array([vocab[symbol + suffix] for symbol in symbols], np.int64)
        pairs = [tuple(merge) if isinstance(merge, list) else tuple(merge.split(" ")) for merge in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.bits = max(4, len(pairs).bit_length() + 3)
        size = 1 << self.bits
        self.keys, self.ranks, self.probes = np.full(size, -1, np.int64), np.full(size, self.NONE, np.int32), 1
        wanted = np.array([vocab[a] << 24 | vocab[b] for a, b in pairs], np.int64)
        for rank, (key, at) in enumerate(zip(wanted.tolist(), self._slot(wanted).tolist(), strict=True)):
            for probe in range(size):
                place = (at + probe) & (size - 1)
                if self.keys[place] in (-1, key):
                    break
            if self.keys[place] == -1:
                self.keys[place], self.ranks[place] = key, rank
            self.probes = max(self.probes, probe + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where two symbols never merge."""
        keys = a << 24 | b
        at = self._slot(keys)
        found = np.where(self.keys[at] == keys, self.ranks[at], self.NONE)
        for probe in range(1, self.probes):
            at = (at + 1) & (len(self.keys) - 1)
            hit = self.keys[at] == keys
            if hit.any():
                found = np.where(hit, self.ranks[at], found)
        return found

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            by_length.setdefault(len(piece), []).append(k)
        for length, rows in by_length.items():
            if length:
                for at in range(0, len(rows), max(1, 2_000_000 // length)):
                    part = rows[at : at + max(1, 2_000_000 // length)]
                    self._same_length(pieces, length, np.array(part), out)
        return out

    def _same_length(self, pieces: list[bytes], length: int, rows: np.ndarray, out: list[bytes]) -> None:
        letters = np.frombuffer(b"".join([pieces[k] for k in rows.tolist()]), np.uint8).reshape(-1, length)
        ids = self.inner[letters]
        ids[:, -1] = self.last[letters[:, -1]]
        ranks = self.rank(ids[:, :-1], ids[:, 1:]) if length > 1 else np.zeros((len(ids), 0), np.int32)
        while len(rows):
            width = ids.shape[1]
            at = ranks.argmin(1) if width > 1 else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if width > 1 else np.full(len(rows), self.NONE)
            going = best != self.NONE
            if not going.all():
                ended = ~going
                data, step = ids[ended].astype("<u4").tobytes(), 4 * width
                for k, row in enumerate(rows[ended].tolist()):
                    out[row] = data[k * step : (k + 1) * step]
                rows, ids, ranks, at, best = rows[going], ids[going], ranks[going], at[going], best[going]
                if not len(rows):
                    return
            here, places = np.arange(len(rows)), np.arange(width)
            ids[here, at] = self.merged[best]
            ids = ids[places[None, :] != at[:, None] + 1].reshape(len(rows), width - 1)
            ranks = ranks[places[None, :-1] != at[:, None]].reshape(len(rows), width - 2)
            left = at > 0
            if left.any():
                r, c = here[left], at[left]
                ranks[r, c - 1] = self.rank(ids[r, c - 1], ids[r, c])
            right = at < width - 2
            if right.any():
                r, c = here[right], at[right]
                ranks[r, c] = self.rank(ids[r, c], ids[r, c + 1])


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(byte) if byte in plain else chr(next(others)) for byte in range(256)]


class Places:
    """Numbers of byte strings of at most 16 bytes without zeros: open addressing on whole arrays, keys compared in full."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.held = bits, 0
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.number = np.full(1 << bits, -1, np.int32)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(32)
        return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it has none."""
        found, slot, going = np.full(len(low), -1, np.int32), self._slot(low, high), np.arange(len(low))
        while len(going):
            number = self.number[slot]
            hit = (number >= 0) & (self.low[slot] == low[going]) & (self.high[slot] == high[going])
            found[going[hit]] = number[hit]
            on = (number >= 0) & ~hit
            going, slot = going[on], (slot[on] + 1) & (len(self.number) - 1)
        return found

    def add(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        """Store distinct keys that have no number yet."""
        while (self.held + len(low)) * 2 > len(self.number):
            old = np.flatnonzero(self.number >= 0)
            held = self.low[old], self.high[old], self.number[old]
            self.__init__(self.bits + 1)
            self.add(*held)
        slot = self._slot(low, high)
        self.held += len(low)
        while len(low):
            free = np.flatnonzero(self.number[slot] < 0)
            at, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.low[at], self.high[at], self.number[at] = low[taken], high[taken], number[taken]
            on = np.ones(len(low), bool)
            on[taken] = False
            low, high, number, slot = low[on], high[on], number[on], (slot[on] + 1) & (len(self.number) - 1)


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space, on whole arrays.

    ASCII white space always separates pieces, is never part of one, and composes with nothing under normalisation, so a
    text's ids are those of its chunks one after the other. Chunks of Latin letters, with one mark after them at most, are
    two pieces at most; pieces of up to 16 bytes are numbered in a table and merged in bulk when they are new. The library
    encodes all other chunks, and a memo numbers them. Both forget everything when they are full.
    """

    MARKS = b".,;:!?"
    #: Bytes of texts that are encoded at a time, but for a chunk that is longer.
    SEGMENT = 1 << 20
    #: Pieces, and other chunks, from which on everything is forgotten.
    PIECES, OTHERS = 1 << 21, 1 << 18

    def __init__(self, path: str) -> None:
        if not drops_white_space(path):
            raise ValueError("this tokenizer keeps white space")
        special_strings(path)
        self.tokenizer = library(path)
        self.merger = BulkMerger(path)
        probe = "\u00c0b\u00df\u00ff."
        pieces = [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(probe))]
        symbols = byte_symbols()
        self.plain = pieces == ["".join(symbols[byte] for byte in part.encode()) for part in ("\u00e0b\u00df\u00ff", ".")]
        self.white = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
        self.forget()

    def forget(self) -> None:
        self.places, self.others = Places(), {}
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.begins, self.sizes, self.numbered = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0
        self.marks = np.full(256, -1, np.int32)
        self.marks[np.frombuffer(self.MARKS, np.uint8)] = self._number(self.merger([bytes([mark]) for mark in self.MARKS]))

    def _number(self, packed: list[bytes]) -> np.ndarray:
        """Numbers of new packed ids, which are stored."""
        ids, sizes = np.frombuffer(b"".join(packed), "<i4"), np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        self.ids = _with_room(self.ids, self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        numbers = np.arange(self.numbered, self.numbered + len(packed), dtype=np.int32)
        self.begins, self.sizes = (_with_room(each, self.numbered + len(packed)) for each in (self.begins, self.sizes))
        self.begins[numbers], self.sizes[numbers] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.numbered = self.used + len(ids), self.numbered + len(packed)
        return numbers

    def _pieces(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        found = self.places.find(low, high)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            order = missing[np.lexsort((high[missing], low[missing]))]
            new = order[np.concatenate([[True], (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])])]
            raw = np.stack([low[new], high[new]], 1).astype("<u8").tobytes()
            numbers = self._number(self.merger([raw[at : at + 16].rstrip(b"\0") for at in range(0, len(raw), 16)]))
            self.places.add(low[new], high[new], numbers)
            found[missing] = self.places.find(low[missing], high[missing])
        return found

    def _rest(self, chunks: list[bytes]) -> list[int]:
        new = list(set(chunks).difference(self.others))
        if new:
            found = self.tokenizer.encode_batch([chunk.decode("utf-8", "replace") for chunk in new], add_special_tokens=False)
            self.others.update(zip(new, self._number([pack(each.ids) for each in found]).tolist(), strict=True))
        return list(map(self.others.__getitem__, chunks))

    def _segment(self, data: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the chunks of ``data`` begin, how many ids each has, and all their ids. ``fresh`` marks where texts begin.

        In UTF-8 the Latin letters beyond ASCII are byte 195 and a second byte; capitals have the second byte 32 lower.
        """
        if len(self.others) > self.OTHERS or self.places.held > self.PIECES:
            self.forget()
        space = self.white[data]
        begin, last = ~space, ~space
        begin[1:] &= space[:-1] | fresh[1:]
        last[:-1] &= space[1:] | fresh[1:]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
        sizes = ends - starts
        capital = (data >= 65) & (data <= 90)
        second = np.zeros(len(data), bool)
        second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7) & ~fresh[1:]
        letter = capital | ((data >= 97) & (data <= 122)) | second
        letter[:-1] |= second[1:]
        lowered = np.zeros(len(data) + 16, np.uint8)
        lowered[: len(data)] = data + 32 * (capital | (second & (data < 0x9F))).astype(np.uint8)
        others = np.zeros(len(data) + 1, np.int32)
        np.cumsum(~letter, out=others[1:])
        others = others[ends] - others[starts]
        marked = (others == 1) & (sizes > 1) & (self.marks[data[ends - 1]] >= 0)
        body = sizes - marked
        known = (body <= 16) & (marked | (others == 0)) & self.plain
        numbers = np.zeros(len(starts), np.int32)
        eight = np.ndarray((len(data) + 9,), "<u8", lowered, strides=(1,))
        few, at, size = np.flatnonzero(known), starts[known], body[known]
        mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        numbers[few] = self._pieces(eight[at] & mask[np.minimum(size, 8)], eight[np.minimum(at + 8, len(data))] & mask[np.clip(size - 8, 0, 8)])
        rest = np.flatnonzero(~known)
        if len(rest):
            raw = data.tobytes()
            numbers[rest] = self._rest([raw[a:b] for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)])
        marked &= known
        after = np.cumsum(marked)
        units = np.zeros(len(starts) + int(marked.sum()), np.int32)
        places = np.arange(len(starts)) + after - marked
        units[places] = numbers
        units[places[marked] + 1] = self.marks[data[ends[marked] - 1]]
        counts = self.sizes[units].astype(np.int64)
        before = np.cumsum(counts) - counts
        ids = self.ids[np.repeat(self.begins[units] - before, counts) + np.arange(counts.sum())]
        per_chunk = counts[places]
        per_chunk[marked] += counts[places[marked] + 1]
        return starts, per_chunk, ids

    def encode(self, data: np.ndarray, ends: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts that lie one after the other in ``data`` up to ``ends``, and how many each text has; ``end_id``, if any, comes after each text."""
        ends = np.asarray(ends, np.int64)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        fresh = np.zeros(len(data), bool)
        fresh[begins[begins < ends]] = True
        totals = np.zeros(len(ends), np.int64)
        found, at = [np.zeros(0, np.int32)], 0
        while at < len(data):
            to = self._cut(data, fresh, at)
            starts, counts, ids = self._segment(data[at:to], fresh[at:to])
            np.add.at(totals, np.searchsorted(ends, starts + at, "right"), counts)
            found.append(ids)
            at = to
        ids = np.concatenate(found)
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(totals), end_id)
            totals = totals + 1
        return ids, totals

    def _cut(self, data: np.ndarray, fresh: np.ndarray, at: int) -> int:
        """Where the segment that begins at ``at`` ends: at white space or a text's begin, the last one within its size if there is one."""
        to = at + self.SEGMENT
        if to >= len(data):
            return len(data)
        breaks = np.flatnonzero(self.white[data[at + 1 : to]] | fresh[at + 1 : to])
        if len(breaks):
            return at + 1 + int(breaks[-1])
        while to < len(data):
            breaks = np.flatnonzero(self.white[data[to : to + self.SEGMENT]] | fresh[to : to + self.SEGMENT])
            if len(breaks):
                return to + int(breaks[0])
            to += self.SEGMENT
        return len(data)


def _with_room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


@functools.lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
