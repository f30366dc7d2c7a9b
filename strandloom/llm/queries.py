"""The training-data queries that the driver registers, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe_tree, decontaminate, exact_dedup, html_extract, quality, simhash, suffix_dedup, token_counts, token_store, url_filter
from strandloom.llm.common import shared_dir, table

WORDS = "word_bpe_49k.json"
BYTES = "byte_bpe_50k.json"


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


OP1_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

OP6_SQL = """
WITH c AS (SELECT DISTINCT page_id, url, 1704067200 + (page_id * 7919 %% 525600) * 60 AS fetched FROM pages),
h AS (SELECT *, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS authority, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1) AS path FROM c),
g AS (SELECT *, regexp_replace(regexp_replace(translate(regexp_replace(authority, '^.*@', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':[0-9]*$', ''), '[.]+$', '') AS host FROM h),
f AS (SELECT page_id, host, array_to_string(string_split(host, '.')[-2:], '.') AS parent, split_part(path, '/', 2) AS seg FROM g WHERE host <> ''),
t AS (SELECT 'hosts' AS list_name, 'host' AS kind, host AS pattern, min(page_id) AS i, 30 AS days FROM f GROUP BY host
  UNION ALL SELECT 'domains', 'domain', parent, min(page_id), 10 FROM f GROUP BY parent
  UNION ALL SELECT 'paths', 'prefix', host || '/' || seg, min(page_id), 60 FROM f WHERE seg <> '' GROUP BY host, seg),
x(list_name, kind, pattern, action, dated) AS (VALUES
%s),
e AS (SELECT list_name, kind, pattern, action, epoch(CAST(dated AS TIMESTAMP)) AS dated FROM x
  UNION ALL SELECT list_name, kind, pattern, 'add', 1704067200 + (i * 104729 %% 525600) * 60 FROM t
  UNION ALL SELECT list_name, kind, pattern, 'remove', 1704067200 + (i * 104729 %% 525600) * 60 + days * 86400 FROM t),
n AS (SELECT list_name, kind, regexp_replace(pattern, '[./]+$', '') AS pattern, action, dated FROM e),
v AS (SELECT *, lead(dated) OVER (PARTITION BY list_name, kind, pattern ORDER BY dated, action DESC) AS until FROM n WHERE dated IS NOT NULL AND pattern <> ''),
k AS (SELECT page_id, url, fetched, 'host' AS kind, host AS key FROM g
  UNION ALL SELECT page_id, url, fetched, 'domain', unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) FROM g
  UNION ALL SELECT page_id, url, fetched, 'prefix', unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: host || array_to_string(string_split(path, '/')[1:i], '/'))) FROM g),
m AS (SELECT k.page_id, k.url, k.fetched, count(*) AS n_active, string_agg(DISTINCT v.list_name, ',' ORDER BY v.list_name) AS lists
  FROM k JOIN v ON k.kind = v.kind AND k.key = v.pattern AND v.action = 'add' AND k.fetched >= v.dated AND (v.until IS NULL OR k.fetched < v.until)
  GROUP BY ALL)
SELECT p.page_id, p.url, CAST(1704067200 + (p.page_id * 7919 %% 525600) * 60 AS BIGINT) AS fetched, coalesce(m.n_active, 0) AS n_active, coalesce(m.lists, '') AS lists, m.n_active IS NOT NULL AS blocked
FROM pages p LEFT JOIN m ON p.page_id IS NOT DISTINCT FROM m.page_id AND p.url IS NOT DISTINCT FROM m.url
""" % ",\n".join(str(entry) for entry in url_filter.EXAMPLE_ENTRIES)

OP10_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS span FROM i WHERE len(w) > 0),
k AS (SELECT item_id, w, span, unnest(range(0, len(w) - span + 1)) AS k FROM s),
win AS (SELECT DISTINCT item_id, span, w[k + 1 : k + span] AS g FROM k),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
g AS (SELECT doc_id, p, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS g FROM t),
spans AS (SELECT DISTINCT span FROM win),
grams AS (SELECT doc_id, p, span, g[1:span] AS g FROM g, spans WHERE len(g) >= span),
m AS (SELECT DISTINCT doc_id, p, span, item_id FROM grams JOIN win USING (span, g)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + span)) AS q FROM m) GROUP BY doc_id),
freq AS (SELECT word, count(*) AS c FROM t GROUP BY word),
places AS (SELECT item_id, w, span, k, unnest(range(k, k + span)) AS j FROM k),
rare AS (SELECT item_id, w, span, k, arg_min(j, (coalesce(c, 0), j)) AS j FROM places LEFT JOIN freq ON word = w[j + 1] GROUP BY item_id, w, span, k),
spots AS (SELECT doc_id, item_id, w, span, k, p - 1 - j AS s FROM rare JOIN t ON t.word = w[j + 1]),
tried AS (SELECT DISTINCT doc_id, item_id, w, span, k, s + d AS s FROM spots, (SELECT unnest(range(-2, 3)) AS d)),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM tried JOIN (SELECT doc_id, w AS dw FROM d) USING (doc_id)
  WHERE list_bool_and(list_transform(range(k, k + span), lambda j: list_contains(dw[greatest(s + j - 1, 1) : greatest(s + j + 3, 0)], w[j + 1]))) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near_items
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)
"""


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer(WORDS), limit=2048)


def op3_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encoded(table(spark, sf_dir, "documents"), tokenizer(BYTES))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), words=3, radius=2).drop("hashed", "class")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/strandloom/tokens-{uuid.uuid4().hex}"
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer(WORDS), end_id=1)
    return token_store.layout_of(spark, path)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), length=200)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the fixed entries and a list derived from all pages; fetch times are derived from page_id, as pages have none."""
    pages = table(spark, sf_dir, "pages")
    fetched = F.lit(1_704_067_200) + F.col("page_id") * 7919 % 525_600 * 60
    captures = pages.select("page_id", "url", F.timestamp_seconds(fetched).alias("fetched"))
    entries = url_filter.entries_frame(spark, url_filter.EXAMPLE_ENTRIES).union(url_filter.entries_of(pages))
    found = url_filter.verdicts(captures, entries, time_col="fetched")
    return found.select("page_id", "url", F.unix_seconds("fetched").alias("fetched"), "n_active", "lists", "blocked")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10).drop("hashed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_bpe_tree": op3_bpe_tree,
        "op4_quality": op4_quality,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_url_filter": op6_url_filter,
        "op7_simhash": op7_simhash,
        "op8_html_extract": op8_html_extract,
        "op9_token_store": op9_token_store,
        "op10_decontaminate": op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op6_url_filter": OP6_SQL,
        "op10_decontaminate": OP10_SQL,
    }
