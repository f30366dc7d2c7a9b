"""Exact, suffix and SimHash deduplication against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash

from strandloom.llm import exact_dedup, simhash, suffix_dedup

DOCS = "doc_id long, text string"


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.selectExpr("*", "1 AS n", "'x' AS digest", "2 AS best", "'c' AS lead", "'r' AS hashed") if clash else df


EDGE = [(900, None), (901, ""), (902, "A b"), (903, "a B"), (None, "a b"), (None, None), (904, "É x"), (905, "é x"), (906, "a b"), (906, "a b"), (907, "z" * 30_000)]


def test_trie():
    rnd = random.Random(1)
    trie, known = exact_dedup.PatriciaTrie(largest=True), {}
    for k in range(3000):
        key = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))).encode()
        trie.insert(key, k)
        known[key] = (k, known.get(key, (0, 0))[1] + 1)
    assert {key: (node.best, node.count) for key, node in trie.terminals()} == known
    held = dict(trie.shed())
    assert held and trie.held >= 0
    assert {key: (node.best, node.count) for key, node in trie.terminals()} | {key: (node.best, node.count) for key, node in held.items()} == known


def test_trie_in_order():
    """Subtrees that leave early are complete, and memory holds little more than the newest path."""
    rnd = random.Random(2)
    known = collections.Counter("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40))).encode() for _ in range(3000))
    trie, found, most = exact_dedup.PatriciaTrie(), [], 0
    for key in sorted(known.elements()):
        trie.insert(key, 1)
        if trie.held > 20_000:
            found.extend((text, node.count) for text, node in trie.shed_before(key))
        most = max(most, trie.held)
    found.extend((text, node.count) for text, node in trie.terminals())
    assert len(found) == len(known) and dict(found) == known and most < 60_000


@pytest.mark.parametrize("budget", [48 << 20, 2000])
def test_exact_groups(spark, monkeypatch, budget):
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", budget)
    rows = [(k, f"Text {k % 7}") for k in range(60)] + EDGE
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = collections.defaultdict(list)
    for key, text in rows:
        groups[(text or "").translate(fold)].append(key)
    got = exact_dedup.exact_groups(frame(spark, rows), keep="max").collect()
    assert len(got) == len(rows)
    by_text = {hashlib.sha256(text.encode()).hexdigest(): keys for text, keys in groups.items()}
    for row in got:
        keys = by_text[row["text_sha256"]]
        assert row["group_size"] == len(keys) and row["keep_id"] == max((k for k in keys if k is not None), default=None)
    assert collections.Counter(row["text_sha256"] for row in got if row["kept"]) == dict.fromkeys(by_text, 1)
    kept = exact_dedup.deduplicated(frame(spark, rows), keep="min")
    assert kept.count() == len(groups) and "digest" in kept.columns
    assert exact_dedup.exact_groups(frame(spark, rows).limit(0)).count() == 0


def brute_repeats(rows, length):
    texts = [(key, (text or "").encode()) for key, text in rows]
    seen = collections.Counter(text[k : k + length] for _, text in texts for k in range(len(text) - length + 1))
    out = []
    for key, text in texts:
        cover = np.zeros(len(text) + 1, int)
        for k in range(len(text) - length + 1):
            if seen[text[k : k + length]] > 1:
                cover[k] += 1
                cover[k + length] -= 1
        gone = np.cumsum(cover)[: len(text)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((key, len(text), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(text, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [20_000, 3, 1])
def test_repeats(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup.compared, "__defaults__", (most,))
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abcdef ") for _ in range(n))
    passages = [word(rnd.randint(150, 420)) for _ in range(6)]
    rows = []
    for k in range(60):
        text = word(rnd.randint(0, 400))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            text += p[rnd.randint(0, 60) : len(p) - rnd.randint(0, 60)] + word(rnd.randint(0, 150))
        rows.append((k, text))
    base = word(1200)
    rows += [(200 + k, "".join("#" if rnd.random() < 0.002 else c for c in base)) for k in range(30)]
    rows += [(300, "z" * 1500), (301, "z" * 700 + "y"), (302, "q" * 199), (303, "q" * 200), (304, "é" * 150), *EDGE, (5, rows[5][1])]
    got = suffix_dedup.without_repeats(frame(spark, rows), 200).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows, 200)


def test_one_line_in_many_texts(spark, monkeypatch):
    """A line of 150 bytes in differing surroundings is no repeat, and no list of its texts is long."""
    monkeypatch.setattr(suffix_dedup.compared, "__defaults__", (100,))
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    line = word(150)
    rows = [(k, word(200) + line + word(200)) for k in range(3000)] + [(5000, "x" * 30 + rows_of_line) for rows_of_line in [line + "y" * 60]] + [(5001, "z" * 30 + line + "y" * 60)]
    seen = spark.sparkContext.accumulator(0)
    settle = suffix_dedup.repeated_starts

    def watched(group, core, length):
        if len(group) > 100:
            seen.add(1)
        return settle(group, core, length)

    monkeypatch.setattr(suffix_dedup, "repeated_starts", watched)
    got = {row["doc_id"]: row["n_removed"] for row in suffix_dedup.without_repeats(frame(spark, rows), 200).collect()}
    assert {key: n for key, n in got.items() if n} == {5000: 210, 5001: 210} and len(got) == len(rows)
    assert suffix_dedup.without_repeats(frame(spark, rows).limit(0), 200).count() == 0


def test_large_groups_compare_as_pairs_do():
    rnd = random.Random(3)
    base = bytes(rnd.choice(b"ab") for _ in range(369))
    group = []
    for _ in range(40):
        text = bytearray(base)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.choice([k for k in range(369) if not 84 <= k < 200])
            text[at] = ord("#") + rnd.randint(0, 1)
        group.append((bytes(text), 84, 85, True))
    few, found = suffix_dedup.FEW, []
    for limit in (0, 1000):
        suffix_dedup.FEW = limit
        found.append([{k for low, high in ranges for k in range(low, high)} for ranges in suffix_dedup.repeated_starts(group, 116, 200)])
    suffix_dedup.FEW = few
    assert found[0] == found[1] and any(found[0])
    keys = [member[0] for member in group]
    assert [keys[k] for k in suffix_dedup.multikey_sorted(keys)] == sorted(keys)


def test_runs_do_not_depend_on_segments(monkeypatch):
    rnd = random.Random(4)
    texts = [bytes(rnd.choice(b"abc") for _ in range(n)) for n in (0, 5000, 199, 200, 3000)]
    whole = suffix_dedup.runs(texts, 200)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    assert all(np.array_equal(a, b) for a, b in zip(whole, suffix_dedup.runs(texts, 200), strict=True))


def brute_print(text, n=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(gram, 42) for gram in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("part_nodes", [32_768, 3])
def test_simhash(spark, part_nodes):
    rnd = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    base = rnd.choices(words, k=300)
    rows = [(k, " ".join(rnd.choices(words, k=rnd.randint(0, 60)))) for k in range(80)]
    for k in range(120):
        copy = list(base)
        for _ in range(rnd.randint(0, 2)):
            copy[rnd.randrange(300)] = "new"
        rows.append((500 + k, " ".join(copy)))
    rows += [row for row in EDGE if row[0] != 906]
    prints = [brute_print(text) for _, text in rows]
    values = sorted(set(prints))
    near = np.array(values, np.uint64)
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for v in values:
        for w in near[np.bitwise_count(near ^ np.uint64(v)) <= 2].tolist():
            label[root(v)] = root(w)
    lowest = {}
    for (key, _), p in zip(rows, prints, strict=True):
        lowest[root(p)] = min((k for k in (key, lowest.get(root(p))) if k is not None), default=None)
    want = sorted(((key, f"{p:016x}", lowest[root(p)]) for (key, _), p in zip(rows, prints, strict=True)), key=str)
    df = frame(spark, rows)
    if part_nodes != 32_768:
        found = {(r["a"], r["b"]) for r in simhash.links(simhash.fingerprints(df), 2, part_nodes).collect()}
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        for v in values:
            label[v] = v
        for a, b in found:
            a, b = a % (1 << 64), b % (1 << 64)
            assert (a ^ b).bit_count() <= 2
            label[root(a)] = root(b)
        assert len({root(v) for v in values}) == len(set(lowest)) and signed(1) == 1
        return
    got = simhash.near_groups(df).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want
    stay = simhash.representatives(df)
    assert stay.count() == len(lowest) and stay.columns == df.columns


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 300), (300, 200), (7, 7)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[k] == 0 for k in range(41)) and got[200] == got[300] == got[100] == 100


def brute_near(rows, words=5):
    """The row that stays of each component, by comparing every pair of texts."""
    sets = []
    for _, text in rows:
        found = (text or "").encode().lower().split()
        sets.append({b" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))})
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    best = {}
    for k, row in enumerate(rows):
        key = (row[0] is None, row[0] or 0)
        best[root(k)] = min(best.get(root(k), key), key)
    return sorted((None if no else key for no, key in best.values()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_near_stage_keeps_no_similar_pair(spark, monkeypatch, small):
    import corpus_pipeline
    from strandloom.llm import simhash_sets

    if small:  # many parts of tiles and of cases, and few entries of inverted lists at a time
        monkeypatch.setattr(simhash_sets.similar_groups, "__defaults__", (5, (4, 5), "doc_id", "text", 7, 3000))
        monkeypatch.setattr(simhash_sets, "LISTED", 9)
        monkeypatch.setattr(simhash_sets, "BLOCK", 3)
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 90)))) for k in range(60)]
    for key, text in rows[:60]:
        for _ in range(rnd.randint(0, 4)):
            edited = text.split()
            for _ in range(rnd.randint(0, 3)):
                edited[rnd.randrange(len(edited))] = rnd.choice(vocabulary)
            rows.append((100 + len(rows), " ".join(edited)))
    rows += [(1000 + k, f"{rows[0][1]} {rows[1][1]} a{k} b") for k in range(40)] + EDGE
    rows = list(dict.fromkeys(rows))
    got = corpus_pipeline.near_stage(spark, frame(spark, rows), "")
    assert "digest" in got.columns
    assert sorted((row["doc_id"] for row in got.collect()), key=str) == brute_near(rows)


def test_near_stage_of_nothing(spark):
    import corpus_pipeline

    assert corpus_pipeline.near_stage(spark, frame(spark, EDGE).limit(0), "").count() == 0
