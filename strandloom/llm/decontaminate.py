"""Benchmark decontamination over a distributed positional inverted index, with DataFrame operations only.

1. Texts are split into words once. The postings (document, position, term) of every term that the benchmark uses are
   stored in the shared folder, after a broadcast join with the benchmark's vocabulary.
2. Term frequencies over all documents come from the stored postings. Each window of an item gets its rarest terms.
3. Postings of those terms, adjusted by their place in the item, meet on the diagonal (document, item, position minus
   place): a window is a candidate where all of its rarest terms lie on one diagonal, and one for proximity where they lie on
   diagonals at most ``2 * slop`` apart.
4. Candidates meet their documents again, and all of a window's words are compared: exact phrase matches have every word in
   its place; proximity matches have a place from which every word occurs within ``slop`` words of where it belongs. A bit
   map of fixed size keeps documents without candidates out of that shuffle.

Each posting joins only the item places whose window has it among its rarest terms, and postings of one diagonal are
aggregated before they are tested, so a frequent passage costs its number of occurrences. The benchmark is the stated
query set; its tables are broadcast only when a count proves them small (:func:`bounded`), and joined by shuffle otherwise.
The index holds the terms of that benchmark and no others: another benchmark needs another index.

Documents are known by identifier and text hash, so rows that share an identifier but not a text stay apart and equal
rows get equal results. Defined results: a null or empty text has no words and no hit; an item without words matches
nothing; a null item identifier counts its hits but names no item; an empty table on either side gives no hit; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import lower_ascii, marked_only, stored, whole_text

#: After A-Z are lower-cased, runs of these separate words: ASCII but for a-z and 0-9. Fixed value of the word rule.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Rarest terms of a window whose postings are intersected.
RAREST = 2
#: Words by which a word may be out of its place in a proximity match.
SLOP = 2
#: Diagonals that meet in one group for proximity, and diagonals whose candidates are one row.
REACH, SLICE = 32, 4096
#: Rows of a benchmark table that may be broadcast; rows are a term, or an item with its words.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = 64 << 20) -> DataFrame:
    """``df`` marked for broadcast if its rows and the bytes of their text form are within bounds, else as it is."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if size["n"] <= rows and size["b"] <= most_bytes else df


def split_words(text: Column) -> Column:
    """Words with an empty string before a leading and after a trailing separator; positions count those too."""
    return F.split(lower_ascii(text), SEPARATORS)


def word_count(words: Column) -> Column:
    first, last = F.element_at(words, 1) == "", F.element_at(words, -1) == ""
    return F.size(words) - first.cast("int") - (last & (F.size(words) > 1)).cast("int")


def items_of(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, item_id, item_words, span``: distinct items that have words; span is the words of a window."""
    own = benchmark.select(benchmark[id_col].alias("item_id"), whole_text(benchmark[text_col]).alias("t")).distinct()
    words = own.select("item_id", F.filter(split_words(F.col("t")), lambda w: w != "").alias("item_words")).filter(F.size("item_words") > 0)
    return stored(words.select(F.monotonically_increasing_id().alias("item"), "item_id", "item_words", F.least(F.lit(window), F.size("item_words")).alias("span")), "items")


def postings(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The stored positional index, and the vocabulary ``term, word``.

    Index rows are ``doc_id, hashed, n_words, pos, term``. Each document also has a row of term -1, which no word has.
    """
    words = items.select(F.explode("item_words").alias("word")).distinct()
    vocabulary = stored(words.select(F.monotonically_increasing_id().alias("term"), "word"), "vocabulary")
    # the mark of a document holds a space, so it is not a word
    mark = docs.sparkSession.range(1).select(F.lit(-1).cast("long").alias("term"), F.lit(" ").alias("word"))
    known = bounded(vocabulary.union(mark))
    text = whole_text(docs[text_col])
    split = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("hashed"), split_words(text).alias("words"))
    counted = split.select("doc_id", "hashed", word_count(F.col("words")).cast("long").alias("n_words"), F.concat("words", F.array(F.lit(" "))).alias("words"))
    tokens = counted.select("doc_id", "hashed", "n_words", F.posexplode("words").alias("pos", "token"))
    index = tokens.join(known, F.col("token") == F.col("word")).select("doc_id", "hashed", "n_words", "pos", "term")
    return stored(index, "postings"), vocabulary


def chosen_places(items: DataFrame, vocabulary: DataFrame, index: DataFrame, rarest: int = RAREST) -> DataFrame:
    """``item, k, place, term``: the places of the rarest terms of the window that starts at word ``k`` of an item."""
    frequency = index.filter("term >= 0").groupBy("term").agg(F.count(F.lit(1)).alias("frequency")).withColumnRenamed("term", "of_term")
    known = vocabulary.join(frequency, F.col("term") == F.col("of_term"), "left").select("term", "word", F.coalesce("frequency", F.lit(0)).alias("frequency"))
    places = items.select("item", "span", F.size("item_words").alias("n"), F.posexplode("item_words").alias("place", "token"))
    places = places.join(known, F.col("token") == F.col("word"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("place") - F.col("span") + 1), F.least(F.col("place"), F.col("n") - F.col("span")))
    windows = places.select("item", F.explode(starts).alias("k"), "place", "term", "frequency")
    order = Window.partitionBy("item", "k").orderBy("frequency", "place")
    return stored(windows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= rarest).select("item", "k", "place", "term"), "places")


def candidates(index: DataFrame, places: DataFrame, slop: int = SLOP) -> DataFrame:
    """``doc_id, hashed, item, cases``: windows whose rarest terms are all in place (``near`` false) or near it (``near`` true).

    A case is ``near, diagonal, ks``: the windows that begin at the item's words ``ks``, with the item's first word at ``diagonal``.
    """
    spots = bounded(places.select("item", F.col("place"), F.col("term").alias("at_term")).distinct())
    met = index.join(spots, F.col("term") == F.col("at_term")).select("doc_id", "hashed", "item", (F.col("pos") - F.col("place")).alias("diagonal"), "place")
    tests = places.groupBy("item", "k").agg(F.collect_list("place").alias("needs")).groupBy("item").agg(F.collect_list(F.struct("k", "needs")).alias("tests"), F.min(F.size("needs")).alias("fewest"))
    tests = bounded(stored(tests.withColumnRenamed("item", "of_item"), "tests"))

    lines = met.groupBy("doc_id", "hashed", "item", "diagonal").agg(F.collect_set("place").alias("found"))
    hold = F.filter("tests", lambda test: F.size(F.array_except(test["needs"], F.col("found"))) == 0)
    exact = lines.join(tests, F.col("item") == F.col("of_item")).withColumn("ks", F.transform(hold, lambda test: test["k"])).filter(F.size("ks") > 0)

    # a diagonal is in its group, and in the one before if something there may be within reach of it
    group = F.floor(F.col("diagonal") / REACH)
    groups = F.when(F.col("diagonal") - group * REACH < 2 * slop, F.array(group, group - 1)).otherwise(F.array(group))
    near = met.withColumn("group", F.explode(groups)).groupBy("doc_id", "hashed", "item", "group").agg(F.collect_set(F.struct("diagonal", "place")).alias("found"), (F.min("place") != F.max("place")).alias("several"))
    near = near.join(tests, F.col("item") == F.col("of_item")).filter("several OR fewest = 1")

    def anchors(test):
        other = lambda spot: F.exists("found", lambda each: (each["place"] == test["needs"][1]) & (F.abs(each["diagonal"] - spot["diagonal"]) <= 2 * slop))
        fit = F.filter("found", lambda spot: (spot["place"] == test["needs"][0]) & ((F.size(test["needs"]) == 1) | other(spot)))
        return F.transform(fit, lambda spot: F.struct(spot["diagonal"].alias("diagonal"), F.array(test["k"]).alias("ks")))

    near = near.select("doc_id", "hashed", "item", F.explode(F.flatten(F.transform("tests", anchors))).alias("case")).distinct()
    both = exact.select("doc_id", "hashed", "item", F.lit(False).alias("near"), "diagonal", "ks").union(near.select("doc_id", "hashed", "item", F.lit(True).alias("near"), "case.diagonal", "case.ks"))
    # slices bound a row of a document that repeats an item's words all along
    grouped = both.groupBy("doc_id", "hashed", "item", F.floor(F.col("diagonal") / SLICE).alias("slice")).agg(F.collect_list(F.struct("near", "diagonal", "ks")).alias("cases"))
    return stored(grouped.select("doc_id", "hashed", "item", "cases"), "candidates")


def matches(docs: DataFrame, found: DataFrame, items: DataFrame, slop: int = SLOP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, hashed, item_id, near, starts, span``: word positions at which windows of the item occur, each one compared in full.

    Rows with ``near`` are proximity matches, exact ones among them; their positions are where the window's first word belongs.
    """
    cases = found.withColumnsRenamed({"doc_id": "c_id", "hashed": "c_hashed"}).join(bounded(items.withColumnRenamed("item", "of_item")), F.col("item") == F.col("of_item"))
    text = whole_text(docs[text_col])
    own = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("hashed"), text.alias("t"))
    own = marked_only(own, found.select("doc_id", "hashed")).dropDuplicates(["doc_id", "hashed"])
    met = own.join(cases.hint("merge"), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("hashed") == F.col("c_hashed")))
    words = met.select("doc_id", "hashed", "item_id", "item_words", "span", "cases", split_words(F.col("t")).alias("words"))

    def same(at: Column, k: Column) -> Column:
        inside = (at >= 0) & (at + F.col("span") <= F.size("words"))
        return inside & (F.slice(F.col("words"), F.greatest(at, F.lit(0)) + 1, F.col("span")) == F.slice(F.col("item_words"), k + 1, F.col("span")))

    def around(start: Column, k: Column) -> Column:
        """Whether each of the window's words lies near its place if the item's first word belongs at ``start``."""

        def there(j: Column) -> Column:
            low = F.greatest(start + j - slop, F.lit(0))
            part = F.slice(F.col("words"), low + 1, F.greatest(start + j + slop + 1 - low, F.lit(0)))
            return F.array_contains(part, F.get("item_words", j))

        return F.forall(F.sequence(k, k + F.col("span") - 1), there)

    def starts(case: Column) -> Column:
        exact = F.transform(F.filter(case["ks"], lambda k: same(case["diagonal"] + k, k)), lambda k: case["diagonal"] + k)
        tried = F.sequence(case["diagonal"] - slop, case["diagonal"] + slop)
        near = F.flatten(F.transform(case["ks"], lambda k: F.transform(F.slice(F.filter(tried, lambda start: around(start, k)), 1, 1), lambda start: start + k)))
        return F.struct(case["near"].alias("near"), F.when(case["near"], near).otherwise(exact).alias("starts"))

    checked = words.select("doc_id", "hashed", "item_id", "span", F.explode(F.transform("cases", starts)).alias("case"))
    return checked.select("doc_id", "hashed", "item_id", "case.near", "case.starts", "span").filter(F.size("starts") > 0)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", slop: int = SLOP) -> DataFrame:
    """One row for each input row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items, hashed``.

    ``n_near_items`` counts the items with a proximity match, which every exact match is, too.
    """
    items = items_of(benchmark, window, item_id_col, item_text_col)
    index, vocabulary = postings(docs, items, id_col, text_col)
    places = chosen_places(items, vocabulary, index)
    spans = stored(matches(docs, candidates(index, places, slop), items, slop, id_col, text_col).distinct(), "spans")
    exact = spans.filter("NOT near")
    covered = F.flatten(F.transform("starts", lambda at: F.sequence(at, at + F.col("span") - 1)))
    hits = exact.select("doc_id", "hashed", F.explode(F.array_distinct(covered)).alias("at")).distinct().groupBy("doc_id", "hashed").agg(F.count(F.lit(1)).alias("n_hit"))
    name = F.col("item_id").cast("string")
    named = spans.groupBy("doc_id", "hashed").agg(F.array_sort(F.collect_set(F.when(~F.col("near"), name))).alias("names"), F.size(F.collect_set(name)).cast("long").alias("n_near_items"))
    hits = hits.withColumnsRenamed({"doc_id": "h_id", "hashed": "h_hashed"})
    named = named.withColumnsRenamed({"doc_id": "i_id", "hashed": "i_hashed"})
    found = index.filter("term = -1").select("doc_id", "hashed", "n_words")
    found = found.join(hits, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("hashed") == F.col("h_hashed")), "left")
    found = found.join(named, F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("hashed") == F.col("i_hashed")), "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return found.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near_items", F.lit(0)).alias("n_near_items"),
        "hashed",
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with all their columns."""
    bad = contamination(docs, benchmark, window, id_col, text_col).filter("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("hashed").alias("bad_hashed")).distinct()
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("own_id"), F.xxhash64(whole_text(docs[text_col])).alias("own_hashed"))
    kept = packed.join(stored(bad, "contaminated"), F.col("own_id").eqNullSafe(F.col("bad_id")) & (F.col("own_hashed") == F.col("bad_hashed")), "left_anti")
    return kept.select("row.*")
