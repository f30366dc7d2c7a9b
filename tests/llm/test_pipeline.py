"""The corpus pipeline against plain versions of its stages, one after the other, and each stage's edge cases."""

import array
import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F
from test_dedup import EDGE, brute_near
from test_filters import brute_hits, plain_scores

import corpus_pipeline
from strandloom.llm import common, quality

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
TINY = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_run_against_plain_stages(spark):
    before = set(os.listdir(f"{common.shared_dir(spark)}/strandloom")) if os.path.isdir(f"{common.shared_dir(spark)}/strandloom") else set()
    got = {row["doc_id"]: row for row in corpus_pipeline.run(spark, TINY).collect()}
    left = set(os.listdir(f"{common.shared_dir(spark)}/strandloom")) - before
    assert len(left) == 1 and left.pop().startswith("pipeline-4")
    table = spark.read.parquet(f"{TINY}/documents.parquet")
    docs = [(row["doc_id"], row["text"]) for row in table.collect()]
    assert len({key for key, _ in docs}) == len(docs)
    held = lambda key: zlib.crc32(str(key).encode()) % 4 == 2
    labels = {row["doc_id"]: row["quality"] for row in spark.read.parquet(f"{TINY}/labels.parquet").collect() if row["quality"] is not None and not held(row["doc_id"])}
    turns = {row["doc_id"]: (row["turn"], row["doc_id"]) for row in table.select("doc_id", F.xxhash64("doc_id").alias("turn")).collect()}
    order = sorted((row for row in docs if row[0] in labels), key=lambda row: turns[row[0]])
    assert len(order) <= quality.TRAIN_ROWS
    scores = plain_scores([(text, labels[key]) for key, text in order], [text for _, text in docs], quality.BITS, quality.EPOCHS)
    assert all(abs(score - quality.THRESHOLD) > 1e-4 for score in scores)
    docs = [row for row, score in zip(docs, scores, strict=True) if score >= quality.THRESHOLD]
    best = {}
    for key, text in docs:
        best[(text or "").translate(FOLD)] = max(key, best.get((text or "").translate(FOLD), key))
    docs = [row for row in docs if best[(row[1] or "").translate(FOLD)] == row[0]]
    stay = set(brute_near(docs))
    docs = [row for row in docs if row[0] in stay]
    bench = [(row["item_id"], row["text"]) for row in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    bad = {row[0] for row in brute_hits(docs, bench) if row[4]}
    docs = [row for row in docs if row[0] not in bad]
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert set(got) == {key for key, _ in docs} and len(docs) > 50
    for key, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = array.array("I", ids).tobytes()
        assert got[key]["ids"] == packed and got[key]["n_tokens"] == len(ids) and got[key]["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert got[key]["round_trip"] and got[key]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("k", range(5))
def test_stage_edges(spark, k):
    """Nulls, empty and long texts, ties and repeated rows, clashing columns, and an empty table."""
    _, stage = corpus_pipeline.STAGES[k]
    clash = ["label", "hashed", "print", "item", "ids", "score", "digest", "same"]
    df = spark.createDataFrame([*EDGE, (908, "word " * 40_000)], "doc_id long, text string").repartition(3).select("*", *[F.lit("c").alias(name) for name in clash])
    found = stage(spark, df, TINY)
    rows = found.collect()
    n = len(EDGE) + 1
    ids = [row["doc_id"] for row in rows]
    if k < 4:
        assert found.columns == df.columns
    if k == 0:  # equal texts share their fate
        fate = {}
        for row in df.collect():
            fate.setdefault(row["text"] or "", set()).add(row["doc_id"] in ids)
        assert all(len(kept) == 1 for kept in fate.values())
    elif k == 1:  # "", "a b", "É x", "é x", "zz..", "word .."
        assert sorted(map(str, ids)) == ["901", "904", "905", "906", "907", "908"]
    elif k == 2:
        assert sorted(map(str, ids)) == ["900", "902", "904", "905", "907", "908"]
    elif k == 3:
        assert len(rows) == n
    else:
        assert len(rows) == n and all(row["round_trip"] for row in rows) and sum(row["n_tokens"] == 0 for row in rows) == 3
    assert stage(spark, df.limit(0), TINY).count() == 0
