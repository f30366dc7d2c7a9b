"""Counts, encodings and token files against the tokenizers library."""

import array
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyarrow import parquet

from strandloom.llm import bpe_tree, token_counts, token_store, tokens

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
ODD = [
    None, "", " \n\t", "İstanbul ΣΑΣ ΟΔΟΣ's don't we'll I'M", "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|> <|endoftext", "é ́x Å b c\x1cd\x85e",
    "漢字かな交じり文　全角 123４５６ ½", "a" * 3000 + "b" * 2000, "!!!???...'''ss'ss 'S'T", "😀👩‍👧 emoji\x00nul", "ﬁ Å Ǆ ẞ Ünder, Straße. ÀÉ; x×y", "foo  \n bar\t\tbaz \r\n", "word, Word. WORD! word",
]


def frame(spark):
    rnd = random.Random(1)
    rows = [(k, " ".join("".join(rnd.choice("etaoinshrdlué") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(0, 60)))) for k in range(50)]
    rows += [(1000 + k, text) for k, text in enumerate(ODD)] + [(None, "x y"), (7, "twice"), (7, "twice")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS n_tokens", "1 AS part").repartition(3)


def test_counts(spark):
    path = P.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows, df = frame(spark)
    want = sorted(((k, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 20) for k, t in rows), key=str)
    assert sorted(map(tuple, token_counts.token_counts(df, path, 20).collect()), key=str) == want
    byte_path = P.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(byte_path)
    counter = token_counts.merge_counter(byte_path)
    assert counter.batch([(t or "").encode() for _, t in rows]) == [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]


def test_tree_encoding(spark):
    path = P.path("byte_bpe_50k.json")
    library, tool = tokenizers.Tokenizer.from_file(path), bpe_tree.tree_encoder(path)
    rnd = random.Random(2)
    parts = ["a", "b", "'", "s", "re", "'ll", " ", "  ", "\n", "\t", "\r\n", "1", "23", "!", "...", "é", "漢", "<|endoftext|>", "<|", "|>", "😀", "́", " of", "ing", "\x1c", "\x85", "А"]
    for _ in range(1200):
        some = rnd.sample(parts, rnd.randint(1, 7))
        text = "".join(rnd.choice(some) for _ in range(rnd.choice((5, 80, 400))))
        assert tool.encode(text, rnd.choice((3, 8, 40, 200))).tolist() == library.encode(text, add_special_tokens=False).ids, text
    for text in ["a" * 3000, "ab" * 4000, "漢字" * 1500, "12345" * 500, " " * 2000, "x'" * 900 + "lls" * 300, "foo " + "".join(rnd.choice("etaoins") for _ in range(6000))]:
        for leaf in (40, 257, 2000):
            assert tool.encode(text, leaf).tolist() == library.encode(text, add_special_tokens=False).ids
    rows, df = frame(spark)
    want = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((key, len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    for leaf in (30, 100_000):
        got = bpe_tree.encoded(df, path, leaf_chars=leaf, lists=True).collect()
        assert sorted((tuple(row)[:4] for row in got), key=str) == sorted(want, key=str)
        assert all(row["round_trip"] and hashlib.sha256(row["ids"]).hexdigest() == row["ids_sha256"] for row in got)
    assert bpe_tree.encoded(df.limit(0), path).count() == 0
    assert token_counts.token_counts(df.limit(0), path).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, tmp_path, encoding):
    path = P.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows, df = frame(spark)
    out = str(tmp_path / "tokens")
    token_store.write_tokens(df, out, path, encoding=encoding, page_rows=10)
    start, want = 0, []
    for key, text in sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((key, start, len(ids), zlib.crc32(array.array("I", ids).tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_store.layout_of(spark, out).collect()), key=str) == sorted(want, key=str)
    part = token_store.read_tokens(spark, out, ["doc_id", "n_tokens"], first=1000)
    assert part.count() == len(ODD) and "ids" not in part.columns


@pytest.mark.parametrize("limits", [(4 << 20, 1 << 21, 1 << 18), (7, 3, 2), (64, 50, 9)])
def test_words_on_whole_arrays(monkeypatch, limits):
    path = P.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    for name, value in zip(("SEGMENT", "PIECES", "OTHERS"), limits, strict=True):
        monkeypatch.setattr(tokens.WordEncoder, name, value)
    encoder = tokens.WordEncoder(path)
    rnd = random.Random(3)
    parts = ["a", "B", "the", "Thé", "É", "ß", "ß", "×", ".", ",", "!", " ", "  ", "\n", "1", "漢", "́", "<|endoftext|>", "abcdefgh", "ijklmnop", "Ã", "\x00"]
    texts = [t or "" for t in ODD] + ["".join(rnd.choices(parts, k=rnd.choice((0, 1, 4, 30)))) for _ in range(400)]
    for _ in range(2):  # the second time from the memos
        rnd.shuffle(texts)
        raw = [text.encode() for text in texts]
        ids, counts = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(list(map(len, raw))), 1)
        want = [[*library.encode(text, add_special_tokens=False).ids, 1] for text in texts]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    assert encoder.encode(np.zeros(0, np.uint8), np.zeros(2, np.int64), 1)[0].tolist() == [1, 1]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_layout_of_files(spark, tmp_path, encoding):
    rnd = random.Random(4)
    rows = [(k, " ".join(rnd.choices(["one", "two", "three", "four"], k=200))) for k in range(4000)]
    out = tmp_path / "tokens"
    token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(out), P.path("word_bpe_49k.json"), encoding=encoding, page_rows=100, row_group_bytes=1 << 17)
    groups = 0
    for file in out.glob("*.parquet"):
        footer = parquet.ParquetFile(file).metadata
        groups += footer.num_row_groups
        for k in range(footer.num_row_groups):
            columns = {footer.row_group(k).column(c).path_in_schema: footer.row_group(k).column(c) for c in range(footer.num_columns)}
            ids = next(column for name, column in columns.items() if name.startswith("ids"))
            assert ("RLE_DICTIONARY" in ids.encodings or "PLAIN_DICTIONARY" in ids.encodings) == (encoding == "dictionary")
            assert ("DELTA_BINARY_PACKED" in ids.encodings) == (encoding == "delta")
            assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index and ids.has_offset_index
    assert groups > len(list(out.glob("*.parquet")))
    assert token_store.read_tokens(spark, str(out), ["n_tokens"], first=100, last=102).count() == 3


def test_rows_of_one_identifier(spark, tmp_path):
    rows = [(5, "one two"), (5, "three"), (5, None), (None, "x"), (None, None)]
    out = str(tmp_path / "tokens")
    token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), out, P.path("word_bpe_49k.json"))
    found = token_store.layout_of(spark, out).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, None, 5, 5, 5]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:], strict=False))


def test_empty_token_files(spark, tmp_path):
    _, df = frame(spark)
    out = str(tmp_path / "none")
    token_store.write_tokens(df.limit(0), out, P.path("word_bpe_49k.json"))
    assert token_store.layout_of(spark, out).count() == 0
