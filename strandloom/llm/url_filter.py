"""URL filtering against dated lists by a temporal join, with DataFrame operations only.

List entries are dated: an entry adds or removes a pattern of a list. Each pattern's entries become validity intervals,
from an entry to the next one of the same pattern; an as-of join then judges every capture by the entries active when it
was fetched (from an entry's own time, until just before the next one's).

Patterns are of three kinds: ``domain`` (the host or any parent of it), ``host`` (the host alone) and ``prefix`` (host and
path up to a segment's end). A capture turns into the keys that could match it, so the join is an equi-join on kind and key
with a time condition. Keys are built only for the numbers of labels and segments that the list's patterns have, so a long
URL costs its length for each of these few numbers, not its square. The intervals are broadcast if they are proven small,
else both sides are shuffled by key, where adaptive execution splits a hot host's captures.

Defined results: a null or unparsable URL has the empty host and matches nothing; a null fetch time matches nothing;
entries with a null date or pattern are ignored; entries of a pattern with the same date count in the order remove, add
(so the pattern is active); repeated captures each give a row; empty tables give no match or no row; the caller's other
columns come back untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import lower_ascii, stored
from strandloom.llm.decontaminate import bounded

#: list, kind, pattern, action, date: fixed entries of the list that the registered query applies.
EXAMPLE_ENTRIES = [
    ("spam", "domain", "spam-farm.example.org", "add", "2024-01-01 00:00:00"),
    ("spam", "domain", "cheap-pills.example.com", "add", "2024-02-10 00:00:00"),
    ("spam", "domain", "cheap-pills.example.com", "remove", "2024-06-01 12:00:00"),
    ("spam", "domain", "cheap-pills.example.com", "add", "2024-08-15 00:00:00"),
    ("spam", "host", "thther.example.org", "add", "2024-03-01 00:00:00"),
    ("spam", "host", "thther.example.org", "remove", "2024-03-02 00:00:00"),
    ("optout", "domain", "example.net", "add", "2024-09-01 00:00:00"),
    ("optout", "domain", "example.net", "remove", "2024-11-01 00:00:00"),
    ("optout", "prefix", "thering.example.com/en", "add", "2024-01-15 00:00:00"),
    ("optout", "prefix", "blog.tionble.example.com/fr", "add", "2024-04-01 00:00:00"),
    ("optout", "prefix", "blog.tionble.example.com/fr", "add", "2024-05-01 00:00:00"),
    ("optout", "prefix", "blog.tionble.example.com/fr", "remove", "2024-10-01 00:00:00"),
    ("legal", "domain", "spam-farm.example.org", "add", "2024-05-01 00:00:00"),
    ("legal", "host", "www.cheap-pills.example.com", "add", "2024-01-01 00:00:00"),
]


def entries_frame(spark: SparkSession, entries: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """A short list as a DataFrame, ``dated`` in UTC."""
    quoted = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join("(" + ", ".join(map(quoted, entry)) + ")" for entry in entries)
    if not entries:
        return spark.createDataFrame([], "list_name string, kind string, pattern string, action string, dated timestamp")
    return spark.sql(f"SELECT list_name, kind, pattern, action, timestamp(dated || ' UTC') AS dated FROM VALUES {rows} AS t(list_name, kind, pattern, action, dated)")


def entries_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A list as large as its table: every host, every domain of two labels and every first path segment that ``pages`` has is
    added at a time that the smallest identifier with it gives, and removed 30, 10 or 60 days later."""
    host, segment = host_of(F.col("u")), F.get(F.split(path_of(F.col("u")), "/", 3), F.lit(1))
    own = pages.select(pages[id_col].alias("i"), pages[url_col].alias("u")).select("i", host.alias("h"), F.coalesce(segment, F.lit("")).alias("s")).filter("h <> ''")
    labels = F.split("h", "[.]")
    parent = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    named = lambda name, kind, pattern, days: own.select(F.lit(name).alias("list_name"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(days).alias("days"), "i", "s")
    all_kinds = named("hosts", "host", F.col("h"), 30).union(named("domains", "domain", parent, 10)).union(named("paths", "prefix", F.concat("h", F.lit("/"), "s"), 60).filter("s <> ''"))
    first = all_kinds.groupBy("list_name", "kind", "pattern", "days").agg(F.min("i").alias("i"))
    since = F.lit(1_704_067_200) + F.col("i") * 104_729 % 525_600 * 60
    both = F.array(F.struct(F.lit("add").alias("action"), since.alias("at")), F.struct(F.lit("remove").alias("action"), (since + F.col("days") * 86_400).alias("at")))
    return first.withColumn("entry", F.explode(both)).select("list_name", "kind", "pattern", "entry.action", F.timestamp_seconds("entry.at").alias("dated"))


def intervals(entries: DataFrame) -> DataFrame:
    """``list_name, kind, pattern, since, until``: when each pattern is active; ``until`` is null where it still is."""
    raw = F.col("pattern")
    folded = F.concat(lower_ascii(F.regexp_extract(raw, "^[^/]*", 0)), F.regexp_replace(raw, "^[^/]*", ""))  # paths keep their case
    pattern = F.regexp_replace(folded, "[./]+$", "")
    own = entries.select("list_name", "kind", pattern.alias("pattern"), "action", "dated").filter("dated IS NOT NULL AND pattern IS NOT NULL AND pattern <> ''")
    order = Window.partitionBy("list_name", "kind", "pattern").orderBy("dated", F.desc("action"))
    ended = own.withColumn("until", F.lead("dated").over(order)).filter("action = 'add' AND (until IS NULL OR until > dated)")
    return ended.select("list_name", "kind", "pattern", F.col("dated").alias("since"), "until")


def depths_of(active: DataFrame) -> dict[str, list[int]]:
    """For ``domain`` and ``prefix`` patterns, the numbers of labels or segments that they have: a few, however long the list is."""
    depth = F.when(F.col("kind") == "domain", F.size(F.split("pattern", "[.]"))).otherwise(F.size(F.split("pattern", "/")))
    found = active.filter("kind IN ('domain', 'prefix')").select("kind", depth.alias("depth")).distinct().collect()
    return {kind: sorted(row["depth"] for row in found if row["kind"] == kind) for kind in ("domain", "prefix")}


def host_of(url: Column) -> Column:
    authority = F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    host = F.regexp_replace(lower_ascii(F.regexp_replace(authority, "^.*@", "")), ":[0-9]*$", "")
    return F.regexp_replace(host, "[.]+$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)


def keys_of(url: Column, depths: dict[str, list[int]]) -> Column:
    """All ``(kind, key)`` that a pattern of one of the ``depths`` could have to match the URL."""
    host = host_of(url)
    key = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("key"))
    labels = F.split(host, "[.]")
    found = [F.array(key("host", host))]
    if depths["domain"]:
        fit = F.filter(F.array(*map(F.lit, depths["domain"])), lambda k: k <= F.size(labels))
        found.append(F.transform(fit, lambda k: key("domain", F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))))
    if depths["prefix"]:
        parts = F.split(path_of(url), "/", max(depths["prefix"]) + 1)  # the last part is the rest
        fit = F.filter(F.array(*map(F.lit, depths["prefix"])), lambda k: k <= F.size(parts))
        found.append(F.transform(fit, lambda k: key("prefix", F.concat(host, F.array_join(F.slice(parts, F.lit(1), k), "/")))))
    return F.concat(*found)


def verdicts(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """The captures with ``n_active`` (entries that match and are active), ``lists`` (their names, sorted) and ``blocked``."""
    active = stored(intervals(entries), "intervals")
    depths = depths_of(active)
    active = bounded(active)
    own = captures.select(F.struct(*[captures[c] for c in captures.columns]).alias("row"), captures[url_col].alias("u"), captures[time_col].alias("t"))
    seen = own.select("u", "t").distinct().withColumn("pair", F.explode(keys_of(F.col("u"), depths))).select("u", "t", F.col("pair.kind").alias("of_kind"), F.col("pair.key").alias("key"))
    met = seen.join(active, (F.col("of_kind") == F.col("kind")) & (F.col("key") == F.col("pattern")) & (F.col("t") >= F.col("since")) & (F.col("until").isNull() | (F.col("t") < F.col("until"))))
    judged = met.groupBy(F.col("u").alias("j_u"), F.col("t").alias("j_t")).agg(F.count(F.lit(1)).alias("n_active"), F.array_join(F.array_sort(F.collect_set("list_name")), ",").alias("lists"))
    found = own.join(judged, F.col("u").eqNullSafe(F.col("j_u")) & F.col("t").eqNullSafe(F.col("j_t")), "left")
    return found.select("row.*", F.coalesce("n_active", F.lit(0)).alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), F.col("n_active").isNotNull().alias("blocked"))


def allowed(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """The captures that no active entry matches, with their own columns."""
    return verdicts(captures, entries, url_col, time_col).filter("NOT blocked").select(*captures.columns)
