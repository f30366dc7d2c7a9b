"""Quality, extraction, URL lists, decontamination and the pipeline."""

import collections
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import decontaminate, html_extract, quality, queries, url_filter

SMALL = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    found = quality.scored(docs, quality.train(docs, labels)).join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    assert sum(row["predicted"] == row["quality"] for row in found) >= 0.95 * len(found)
    one = spark.createDataFrame([(2, None), (3, ""), (None, "a b"), (4, "x " * 50_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    rows = {row["doc_id"]: row for row in quality.scored(one, quality.train(docs, labels)).collect()}
    assert rows[2]["score"] == rows[3]["score"] and 0 <= rows[4]["score"] <= 1 and not rows[None]["held_out"]
    assert rows[2]["held_out"] == (zlib.crc32(b"2") % 4 == 2)
    assert quality.train(docs, labels.limit(0)) is None
    assert quality.accepted(one, labels.limit(0)).columns == one.columns and quality.accepted(one, labels.limit(0)).count() == 4


def plain_features(text, bits):
    """A text's features, counted one by one."""
    words = [word.encode() for word in (text or "").split()]
    shape = lambda word: re.sub(rb"(.)\1+", rb"\1", bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("9") if 48 <= b <= 57 else b for b in word), flags=re.S)
    own, shapes = [xxhash.xxh32_intdigest(word, 1) for word in words], [xxhash.xxh32_intdigest(shape(word), 2) for word in words]
    keys = [x * 0x9E3779B97F4A7C15 for x in own] + [x * 0x94D049BB133111EB for x in shapes]
    keys += [(7 << 60 if a == b else a * 0x9E3779B1 + b * 0x85EBCA77) * 0xBF58476D1CE4E5B9 for a, b in itertools.pairwise(own)]
    keys += [(a * 0xC2B2AE3D + b * 0x27D4EB4F + 1) * 0xD6E8FEB86659FD93 for a, b in itertools.pairwise(shapes)]
    counts = collections.Counter(key % (1 << 64) >> 64 - bits for key in keys)
    norm = math.sqrt(sum(n * n for n in counts.values()))
    return {place: n / norm for place, n in counts.items()}


def plain_scores(training, texts, bits, epochs):
    """Scores by FTRL-proximal updates, one coordinate after the other."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    weight = lambda k: 0.0 if abs(z[k]) <= 0.01 else -(z[k] - math.copysign(0.01, z[k])) / ((1 + math.sqrt(n[k])) + 0.1)
    score = lambda x: 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))
    rows = [(plain_features(text, bits) | {"bias": 1.0}, label) for text, label in training]
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)).tolist():
            x, label = rows[k]
            p, old = score(x), {key: weight(key) for key in x}
            for key, value in x.items():
                g = (p - label) * value
                z[key] += g - (math.sqrt(n[key] + g * g) - math.sqrt(n[key])) * old[key]
                n[key] += g * g
    return [score(plain_features(text, bits) | {"bias": 1.0}) for text in texts]


def test_quality_against_plain_updates(spark):
    rnd = random.Random(12)
    words = ["good", "bad", "Fine", "x1", "2024", "the", "é", "!!", "the"]
    rows = [(k, " ".join(rnd.choices(words, k=rnd.randint(0, 25)))) for k in range(60)] + [(300, None), (301, ""), (302, "good " * 3000)]
    rows += [(5, "another text of five"), (5, "another text of five"), (None, "good")]  # several texts, and a repeated row
    labels = [(k, int(text.count("good") > text.count("bad"))) for k, text in rows[:60]] + [(5, 1), (6, None), (None, 1), (999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("label", F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    held = lambda key: key is not None and zlib.crc32(str(key).encode()) % 4 == 2
    truth = {}
    for key, label in labels:
        if key is not None and label is not None and not held(key):
            truth[key] = max(label, truth.get(key, 0))
    hashes = {(row["doc_id"], row["text"]): row for row in docs.select("doc_id", "text", F.xxhash64("doc_id").alias("turn"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hashed")).collect()}
    order = sorted({(hashes[key, text]["turn"], key, hashes[key, text]["hashed"], text) for key, text in rows if key in truth})
    for most in (1000, 17):
        got = quality.scored(docs, quality.train(docs, marks, bits=12, train_rows=most, epochs=3)).collect()
        found = collections.defaultdict(list)
        for row in got:
            found[row["doc_id"]].append(row["score"])
        want = collections.defaultdict(list)
        for (key, _), score in zip(rows, plain_scores([(text, truth[key]) for _, key, _, text in order[:most]], [text for _, text in rows], 12, 3), strict=True):
            want[key].append(score)
        assert len(got) == len(rows)
        for key in want:
            assert np.allclose(sorted(found[key]), sorted(want[key]), atol=1e-5)
    assert quality.scored(docs.limit(0), quality.train(docs.limit(0), marks)).count() == 0


def test_extraction_of_all_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {row["page_id"]: row for row in html_extract.main_texts(pages).collect()}
    import html as entities

    for row in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", " ", part)).split()) for part in re.split(r"</?(?:p|h1)>", inner)]
        assert got[row["page_id"]]["text"] == "\n".join(filter(None, blocks))
        assert got[row["page_id"]]["n_chars"] == len(got[row["page_id"]]["text"])


def test_extraction_of_odd_pages(spark):
    page = '<html><body><div id="site">Site</div><div class="content"><h2>T&amp;{n}</h2>tail <b>{n}</b>y<div class=comments>bad</div><ul><li>1<li>{n}</ul><form>f</form></div><script>if(a<b)</script></body>'
    rows = [(k, "http://h/a", page.replace("{n}", f"v{k}")) for k in range(5)] + [(10, None, None), (11, "http://x/", ""), (12, "http://y/", "<p>a<p>b<li>c"), (13, "http://z/", "<div>" * 3000 + "deep"), (14, "http://z/", "<p>" + "w " * 50_000)]
    got = {row["page_id"]: row["text"] for row in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))).collect()}
    assert got[3] == "T&v3\ntail v3y\n1\nv3"
    assert got[10] == got[11] == "" and got[12] == "a\nb\nc" and got[13] == "deep" and len(got[14]) == 99_999


def test_url_lists(spark):
    entries = url_filter.entries_frame(spark, [("l", "domain", "bad.org", "add", "2024-01-10 00:00:00"), ("l", "domain", "bad.org", "remove", "2024-02-01 00:00:00"), ("m", "prefix", "x.com/a", "add", "2024-01-01 00:00:00"), ("m", "host", "y.com", "add", "2024-01-05 00:00:00")])
    rows = [
        (1, "http://u@www.BAD.org:80/x?q", "2024-01-10 00:00:00", True),
        (2, "http://bad.org", "2024-01-09 23:59:59", False),
        (3, "http://bad.org", "2024-02-01 00:00:00", False),
        (4, "http://notbad.org", "2024-01-15 00:00:00", False),
        (5, "https://x.com/a/b#f", "2024-01-15 00:00:00", True),
        (6, "https://x.com/ab", "2024-01-15 00:00:00", False),
        (7, "https://z.y.com/", "2024-01-15 00:00:00", False),
        (8, "//y.com", "2024-01-15 00:00:00", True),
        (9, None, "2024-01-15 00:00:00", False),
        (10, "http://bad.org", None, False),
        (10, "http://bad.org", None, False),
    ]
    df = spark.createDataFrame([row[:3] for row in rows], "id long, url string, at string").select("id", "url", F.to_timestamp("at").alias("fetched"), F.lit("c").alias("kind"))
    got = sorted((row["id"], row["blocked"]) for row in url_filter.verdicts(df, entries).collect())
    assert got == [(row[0], row[3]) for row in rows]
    assert url_filter.allowed(df, entries).columns == df.columns
    assert url_filter.verdicts(df, entries.limit(0)).filter("blocked").count() == 0


def test_url_list_edges(spark):
    """Entries of one date, null dates and patterns, paths with capitals, very long URLs, and no captures."""
    day = "2024-01-10 00:00:00"
    listed = [("l", "domain", "one.org", "remove", day), ("l", "domain", "one.org", "add", day), ("m", "prefix", "TWO.org/Path/", "add", day), ("n", "domain", "d.e.f.g.org", "add", day), ("p", "prefix", "long.org" + "/a" * 3, "add", day)]
    undated = "l string, k string, p string, a string, d timestamp"
    entries = url_filter.entries_frame(spark, listed).union(spark.createDataFrame([("x", "host", "three.org", "add", None), ("x", "host", None, "add", None)], undated))
    rows = [(1, "http://one.org/", True), (2, "http://two.org/Path/x", True), (3, "http://two.org/path/x", False), (4, "http://three.org", False), (5, "http://c.d.e.f.g.org", True), (6, "http://f.g.org", False)]
    rows += [(7, "http://long.org" + "/a" * 500_000, True), (8, "http://" + "a." * 50_000 + "one.org", True), (9, "http://long.org/a/a", False), (10, "", False), (11, "not a url", False)]
    df = spark.createDataFrame([row[:2] for row in rows], "id long, url string").select("id", "url", F.lit("2024-01-15").cast("timestamp").alias("fetched"))
    began = time.perf_counter()
    assert sorted((row["id"], row["blocked"]) for row in url_filter.verdicts(df, entries).select("id", "blocked").collect()) == [(row[0], row[2]) for row in rows]
    assert time.perf_counter() - began < 30
    assert url_filter.verdicts(df.limit(0), entries).count() == 0 == url_filter.allowed(df.limit(0), entries).count()


def brute_hits(docs, items, window=10):
    split = lambda text: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    out = []
    for key, text in docs:
        words, hit, names = split(text), set(), set()
        for item, phrase in items:
            terms = split(phrase)
            span = min(window, len(terms))
            for k in range(len(terms) - span + 1) if terms else ():
                for at in range(len(words) - span + 1):
                    if words[at : at + span] == terms[k : k + span]:
                        hit |= set(range(at, at + span))
                        names |= {item} - {None}
        out.append((key, len(words), len(hit), len(names), bool(hit)))
    return sorted(out, key=str)


def brute_near(docs, items, window=10, slop=2):
    """For each document, how many items have a window whose words all lie within ``slop`` of their places."""
    split = lambda text: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    out = []
    for key, text in docs:
        at = collections.defaultdict(set)
        for place, word in enumerate(split(text)):
            at[word].add(place)
        names = set()
        for item, phrase in items:
            terms = split(phrase)
            span = min(window, len(terms))
            for k in range(len(terms) - span + 1) if terms else ():
                part = terms[k : k + span]
                tried = sorted({p + d for p in at[part[0]] for d in range(-slop, slop + 1)})
                if item is not None and any(all(any(p + j + d in at[word] for d in range(-slop, slop + 1)) for j, word in enumerate(part)) for p in tried):
                    names.add(item)
        out.append((key, len(names)))
    return sorted(out, key=str)


def test_proximity(spark):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rnd.choices(words, k=rnd.randint(1, 14)))) for k in range(25)] + [(100, "solo"), (101, "same same same"), (None, "w1 w2")]
    docs = [(0, "same " * 300), (1, None), (2, "solo"), (3, "")]
    for key, text in items * 4:
        terms = text.split()
        for _ in range(rnd.randint(0, 3)):
            terms.insert(rnd.randrange(len(terms) + 1), rnd.choice(words))
        for _ in range(rnd.randint(0, 2)):
            k = rnd.randrange(len(terms))
            terms[k : k + 2] = terms[k : k + 2][::-1]
        docs.append((len(docs), " ".join(rnd.choices(words, k=rnd.randint(0, 50)) + terms + rnd.choices(words, k=rnd.randint(0, 50)))))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((row["doc_id"], row["n_near_items"]) for row in got.collect()), key=str) == brute_near(docs, items)
    assert got.filter("n_near_items > n_items").count() > 10 and got.filter("n_near_items < n_items").count() == 0
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_hit", "n_items", "contaminated").collect()), key=str) == brute_hits(docs, items)


def test_contamination(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item!"), (3, None), (4, ""), (5, "the the the the the the the the the the the"), (6, "Short item!"), (None, "null named thing")]
    docs = [
        (1, "x One, two three four five six seven eight nine TEN y"),
        (2, "one two three four five six seven eight nine"),
        (3, "--two three four five six seven eight nine ten eleven twelve"),
        (4, "a short item here, short item"),
        (5, "the " * 15),
        (6, None),
        (7, ""),
        (7, "short  item"),
        (None, "null named thing"),
        (8, "w " * 20_000 + "short item"),
        (9, "Éa short itemé short item"),
        (9, "Éa short itemé short item"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS term", "'c' AS item", "3 AS hashed").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("span", F.lit(1))
    got = decontaminate.contamination(df, bench).select("doc_id", "n_words", "n_hit", "n_items", "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == brute_hits(docs, items)
    clean = decontaminate.clean(df, bench)
    assert sorted(row["doc_id"] for row in clean.collect()) == [2, 6, 7] and clean.columns == df.columns
    assert decontaminate.contamination(df, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    got = decontaminate.contamination(df, bench).select("doc_id", "n_near_items").collect()
    assert sorted(map(tuple, got), key=str) == brute_near(docs, items)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {row["doc_id"]: row["quality"] for row in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    (_, first), (_, second), (_, third), (_, fourth), (_, last) = corpus_pipeline.STAGES
    kept = first(spark, docs, SMALL)
    rows = kept.collect()
    assert kept.columns == docs.columns
    assert sum(labels.get(row["doc_id"], 1) for row in rows) >= 0.97 * sum(labels.values())
    kept = spark.createDataFrame(rows, docs.schema)
    unique = second(spark, kept, SMALL).collect()
    assert len(unique) == len({row["text"].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for row in rows})
    apart = third(spark, spark.createDataFrame(unique, docs.schema), SMALL)
    assert apart.columns == docs.columns
    clean = fourth(spark, apart, SMALL)
    assert clean.columns == docs.columns
    bench = [(row["item_id"], row["text"]) for row in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    sample = clean.orderBy("doc_id").limit(60).collect()
    assert not any(row[4] for row in brute_hits([(row["doc_id"], row["text"]) for row in sample], bench))
    done = last(spark, clean, SMALL)
    assert done.count() == clean.count() and done.filter("n_tokens = 0").count() == 0


def test_registered_queries():
    names = queries.queries()
    assert [name.split("_")[0] for name in sorted(names, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{n}" for n in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op6_url_filter", "op10_decontaminate"])
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    got = queries.queries()[name](spark, "/root/testdata/sf0.001")
    columns = sorted(got.columns)
    want = con.execute(queries.oracle_sql()[name]).df()[columns]
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(map(tuple, want.itertuples(index=False)), key=str)


def texts_of(pages):
    """The main texts of one host's pages, without Spark."""
    first = list(dict.fromkeys(pages))[: html_extract.SEEDS]
    order = html_extract.unpacked(html_extract.packed(html_extract.medoid([html_extract.skeleton(html_extract.parse(page)) for page in first])))
    place, sums = {id(node): k for k, node in enumerate(order)}, {}
    for page in pages:
        for node, other in html_extract.aligned(order[0], html_extract.skeleton(html_extract.parse(page))):
            n, low, high, size = sums.get(place[id(node)], (0, other.same, other.same, 0))
            sums[place[id(node)]] = n + 1, min(low, other.same), max(high, other.same), size + other.size
    region, template = html_extract.rules(order, sums)
    return [html_extract.extract(html_extract.parse(page), order, region, template) for page in pages]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_extraction_keeps_what_lies_beside_a_nested_body(n):
    inner = "<h1>Title {k}</h1><div class=lead>lead {k}</div><div class=entry>" + "long body {k} " * 40 + "</div>"
    want = lambda k: f"Title {k}\nlead {k}\n" + " ".join([f"long body {k}"] * 40)
    for page in ("<article>" + inner + "</article>", "<div class=wrap><nav>n{k}</nav><main><h1>Title {k}</h1><div class=lead>lead {k}</div><article>" + "long body {k} " * 40 + "</article></main></div>", "<div class=post>" + inner + "</div>", "<div><div><article>" + inner + "</article></div><div>other {k}</div></div>"):
        assert texts_of([f"<body>{page}</body>".replace("{k}", f"v{k}") for k in range(n)]) == [want(f"v{k}") for k in range(n)]


def test_extraction_keeps_constant_headings():
    for n in (1, 2, 3, 5):
        pages = [f"<body><article><h1>Title {k}</h1><h2>Summary</h2><p>text {k}</p></article></body>" for k in range(n)]
        assert texts_of(pages) == [f"Title {k}\nSummary\ntext {k}" for k in range(n)]


@pytest.mark.parametrize("deep", [100, 160, 5000])
def test_extraction_at_any_depth(deep):
    inner = "<div>inner</div><div class=ads>bad<div>worse</div></div><nav>MENU</nav>rest"
    page = "<body><article><div>" + "<div>" * deep + inner + "</div>" * deep + "</div><p>after</p></article><div class=nav>menu</div></body>"
    assert texts_of([page, page.replace("inner", "other")]) == ["inner\nrest\nafter", "other\nrest\nafter"]
    assert texts_of(["first" + "<div>" * deep + "<nav>MENU TEXT</nav>" + "</div>" * deep + "after"]) == ["first\nafter"]


def test_matching_takes_polynomial_time():
    """Chains of two pages that differ at every level, with like nodes on both sides."""
    chain = lambda names: "".join(f"<div class={x}></div><div class=b>" for x in names) + "end"
    one, two = (html_extract.skeleton(html_extract.parse(chain(names))) for names in (["c", "d"] * 100, ["d", "b"] * 100))
    began = time.perf_counter()
    assert html_extract.aligned(one, two)
    assert time.perf_counter() - began < 1
    long = "".join(f"<h2>{k}</h2><p>{k}</p><ul><li>{k}</li></ul>" for k in range(300))
    one, two = html_extract.skeleton(html_extract.parse("<div></div>" + long)), html_extract.skeleton(html_extract.parse(long + "<div></div>"))
    assert len(html_extract.aligned(one, two)) >= 1200


def brute_matching(a, b):
    """The most pairs of simple tree matching, by its recursive definition."""
    if (a.label, a.noise) != (b.label, b.noise):
        return 0
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + brute_matching(x, y))
    return best[-1][-1] + 1


def test_matching_is_the_largest():
    rnd = random.Random(8)

    def tree(depth):
        slot = html_extract.Slot("div", rnd.choice("ab"), False)
        slot.kids = [tree(depth - 1) for _ in range(rnd.randint(0, 3))] if depth else []
        return slot

    for _ in range(300):
        one, two = tree(3), tree(3)
        one.label = two.label = "a"
        pairs = html_extract.aligned(one, two)
        assert all(x.label == y.label for x, y in pairs)
        # like ends are paired at once, which can only cost pairs below them
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs) <= brute_matching(one, two)


def test_extraction_judges_inline_and_weak_words():
    page = "<body><article><h1>Title {k}</h1><p>text {k} <span class='advert'>BUY <span>NOW</span></span>goes on</p><div class='legal related'><p>A body paragraph {k}.</p></div><div class='related'>See <a href=x>another page {k}</a> <a href=y>and more</a></div></article><div class=legal>terms {k}</div></body>"
    for n in (1, 3):
        assert texts_of([page.replace("{k}", str(k)) for k in range(n)]) == [f"Title {k}\ntext {k} goes on\nA body paragraph {k}." for k in range(n)]


def test_extraction_without_articles():
    """Varying slots are content and constant nodes are template, whatever they are called."""
    page = "<body><div id=top><p>Our Site</p></div><div><div class=x1><p>All rights kept</p><p>since ever</p></div><div class=x2><h1>Title {k}</h1><h2>Summary</h2><p>text {k}</p>{extra}</div></div></body>"
    for n in (2, 3, 8):
        pages = [page.replace("{k}", f"v{k}").replace("{extra}", "<p>more</p>" * (k % 3)) for k in range(n)]
        assert texts_of(pages) == ["\n".join([f"Title v{k}", "Summary", f"text v{k}"] + ["more"] * (k % 3)) for k in range(n)]
    # two regions that vary, with a constant one between them
    page = "<body><div class=a><p>left {k}</p></div><div class=b><p>same</p></div><div class=c><p>right {k}</p></div></body>"
    assert texts_of([page.replace("{k}", str(k)) for k in range(4)]) == [f"left {k}\nright {k}" for k in range(4)]
    # equal pages tell nothing apart
    assert texts_of(["<body><div><p>a</p></div><p>b</p></body>"] * 3) == ["a\nb"] * 3


def test_extraction_does_not_depend_on_partitions(spark):
    rnd = random.Random(9)
    rows = []
    for k in range(120):
        parts = [f"<div class=box{rnd.choice('abc')}><p>{rnd.choice(('same', f'v{k}'))}</p></div>" for _ in range(rnd.randint(0, 5))]
        rows.append((k, f"http://h{k % 3}/", "<body><div class=c><h1>T{k}</h1></div>" + "".join(parts)))
    rows += rows[:5] + [(200, "http://h1/", None)]
    found = [sorted(map(tuple, html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)).collect())) for n in (1, 3, 50)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    assert html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)).count() == 0
