"""Queries of the text pipeline: sentences, chunks, hashes, ingestion, redaction, web pages, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.functions import tables
from loomwell.functions import text as tx
from loomwell.functions import vector as vx
from loomwell.functions import wikitext
from loomwell.operators import chunking
from loomwell.sources import files
from loomwell.streaming import ingest


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, f"{sf_dir}/documents.parquet")


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tx.sentences(F.coalesce("text", F.lit("")))
    return _docs(spark, sf_dir).select("doc_id", F.size(s).alias("n_sentences"), F.sha2(F.array_join(s, "\n\n"), 256).alias("sentences_sha256"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.col("source").alias("entity"), F.lit("Lore > Part 1/2").alias("section"), F.coalesce("text", F.lit("")).alias("text"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 200 tokens with 30 of overlap."""
    return chunking.chunk(_pages(spark, sf_dir), 200).select("doc_id", "idx", "chunk_id", "content_hash", tx.token_estimate(F.col("chunk_text")).alias("tokens"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))


def chunk_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir)
    return p.select("doc_id", tx.chunk_id(F.col("entity"), F.col("section"), F.col("doc_id") % 5, F.col("text")).alias("chunk_id"))


def contextual_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    aliases = F.slice(F.array(*(F.concat("source", F.lit(f"-{i}")) for i in range(7))), F.lit(1), (F.col("doc_id") % 8).cast("int"))
    categories = F.slice(F.array(*(F.concat("lang", F.lit(f"/{i}")) for i in range(8))), F.lit(1), (F.col("doc_id") % 9).cast("int"))
    return d.select("doc_id", chunking.header(F.col("source"), aliases, F.lit("Introduction"), categories).alias("header"))


def upsert_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents are there already; what the odd ones add."""
    rows = _docs(spark, sf_dir).select("doc_id", F.col("doc_id").alias("seq"), tx.content_hash(F.col("text")).alias("content_hash"))
    there = ingest.new_rows(rows.where("doc_id % 2 = 0"), None)
    return ingest.new_rows(rows.where("doc_id % 2 = 1"), there).select("doc_id", "content_hash")


def embedding_cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which chunks have a cached vector of the right length, by hash; a vector's length is kept for a check."""
    docs = _docs(spark, sf_dir).select("doc_id", tx.content_hash(F.col("text")).alias("h"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where((F.size("embedding") == 64) & (F.col("label") != 9))
    cache = docs.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").groupBy("h").agg(F.max_by("embedding", "doc_id").alias("e"))
    return docs.join(cache, "h", "left").select("doc_id", F.col("e").isNotNull().alias("cached"), F.round(vx.norm(F.col("e")), 4).alias("norm"))


def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, "Authorization: Bearer abc.DEF-123/x=="), (-2, "use sk-abcdefgh1234 or SK-no, api-key = zzz;next"), (-3, "token: t0 secret=s1 Password : p")], "id long, text string")
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    chats = tables.read(spark, f"{sf_dir}/conversations.parquet").select((F.lit(1 << 40) + F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    clean = tx.redacted(F.coalesce("text", F.lit("")))
    return own.unionByName(docs).unionByName(chats).select("id", (clean != F.coalesce("text", F.lit(""))).alias("changed"), F.sha2(clean, 256).alias("clean_sha256"))


def wikitext_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup of the kinds that occur, templates up to twelve deep, around every page's title, which is
    no markup and whose ampersands are decoded; its words as a list field."""
    pages = tables.read(spark, f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("t"))
    title, deep = F.regexp_replace("t", r"[\[\]{}|<>•*\-\s,()]+", " "), (F.col("page_id") % 12 + 1).cast("int")
    inside = F.concat(F.lit("<br/>{{S|1|{{W|in}}}}  "), F.repeat(F.lit("{{a|"), deep), F.lit("x"), F.repeat(F.lit("}}"), deep), F.lit("{{s|no}}{{gone}}"))
    raw = F.concat(F.lit("<!-- x -->{{Nihongo|"), wikitext.literal(F.replace(title, F.lit("&amp;"), F.lit("&"))), F.lit("|kanji|romaji}} [[Target|label]]<ref name='a'>no</ref>"), inside)
    words = F.split(title, " ")
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
    listed = F.concat(F.lit("• a"), F.get(words, F.lit(0)), F.lit(", b"), word(1), F.lit("\n* c (d, "), word(2), F.lit(")\n\n- f"))
    return pages.select("page_id", wikitext.value(raw).alias("plain"), F.array_join(tx.multivalue(listed), "|").alias("parts"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page text by rule: furniture elements out, tags to line ends; pages under 50 characters go."""
    h = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<!--.*?-->", "")
    for tag in ("script", "style", "nav", "footer", "header", "aside"):
        h = F.regexp_replace(h, rf"(?is)<{tag}[\s>].*?</{tag}\s*>", "")
    title = F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)
    lines = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(h, r"(?is)<title[^>]*>.*?</title>", ""), r"(?s)<[^>]*>", "\n"), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    rows = tables.read(spark, f"{sf_dir}/pages.parquet").select("page_id", F.when(title != "", title).otherwise(F.col("url")).alias("title"), F.array_join(lines, "\n").alias("body"))
    return rows.where(F.length("body") >= 50).select("page_id", "title", F.length("body").alias("n_chars"), F.sha2("body", 256).alias("body_sha256"))


def link_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.links(tables.read(spark, f"{sf_dir}/pages.parquet"))


def valid_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, "http://a/b.PDF"), (-2, "ftp://a"), (-3, "https://a/b.zip?x"), (-4, "http://a/b.jpeg"), (-5, None)], "page_id long, url string")
    rows = own.unionByName(tables.read(spark, f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return rows.select("page_id", files.valid_url(F.col("url")).alias("valid"))


def local_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that local files named after documents would have."""
    d = _docs(spark, sf_dir)
    path = F.concat(F.lit("/data/"), "source", F.lit("_"), "lang", F.lit("-lore_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select("doc_id", files.title_of(path).alias("title"))


def incremental_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "purchase", "edit").when(F.col("event_type") == "signup", "new").otherwise("log")
    changes = e.select(F.concat(F.lit("page "), F.col("user_id").cast("string")).alias("title"), kind.alias("type"), "ts")
    return ingest.changed_titles(changes, "2024-01-20 00:00:00")


def stream_ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken up twice by a file stream; the second run finds nothing new."""
    folder = tables.shared_folder(spark) + f"/stream-{uuid.uuid4().hex}"
    schema = "doc_id long, seq long, content_hash string"
    _docs(spark, sf_dir).select("doc_id", F.col("doc_id").alias("seq"), tx.content_hash(F.col("text")).alias("content_hash")).write.parquet(f"{folder}/landing")
    for _ in range(2):
        table = ingest.ingest_stream(spark, f"{folder}/landing", schema, f"{folder}/table", f"{folder}/state")
    return table.rows().select("doc_id", "content_hash")


_SENT = r"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
_PLAIN = "replace(replace(replace({}, ' > ', '__'), ' ', '_'), '/', '_')"
#: Chunks of documents' texts, ``folded`` (doc_id, idx, chunk): one step of the recursion is one chunk of each document. A
#: chunk begins with the last sentences of the one before that fit the overlap; sums of estimates tell where it ends.
FOLDED = r"""RECURSIVE sent AS (SELECT doc_id, """ + _SENT + r""" AS s FROM documents),
sized AS (SELECT doc_id, s, list_transform(s, lambda x: greatest(1, CAST(floor(len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) * 1.3) AS INT))) AS n FROM sent WHERE len(s) > 0),
-- ends[i]: the tokens of the first i sentences.
sums AS (SELECT doc_id, s, list_prepend(0, list_transform(range(1, len(n) + 1), lambda i: list_sum(n[1:i]))) AS ends FROM sized),
cut AS (
  SELECT doc_id, 0 AS idx, 1::BIGINT AS low, coalesce(list_min(list_filter(range(2, len(s) + 1), lambda j: ends[j + 1] > {most})), len(s) + 1) AS high FROM sums
  UNION ALL
  SELECT doc_id, idx + 1, low2, coalesce(list_min(list_filter(range(high + 1, len(s) + 1), lambda j: ends[j + 1] - ends[low2] > {most})), len(s) + 1)
  FROM (SELECT c.doc_id, c.idx, c.high, x.s, x.ends, coalesce(list_min(list_filter(range(c.low, c.high), lambda j: x.ends[c.high] - x.ends[j] <= {overlap})), c.high) AS low2
        FROM cut c JOIN sums x USING (doc_id) WHERE c.high <= len(x.s))),
folded AS (SELECT doc_id, idx, array_to_string(s[low:high - 1], ' ') AS chunk FROM cut JOIN sums USING (doc_id))"""
_FURNITURE = "regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g')"
for _tag in ("script", "style", "nav", "footer", "header", "aside"):
    _FURNITURE = rf"regexp_replace({_FURNITURE}, '(?is)<{_tag}[\s>].*?</{_tag}\s*>', '', 'g')"
_REDACTED = r"regexp_replace(regexp_replace(regexp_replace(t, '(?i)(Bearer\s+)[A-Za-z0-9._~+/=-]+', '\1[REDACTED]', 'g'), '(?i)((?:api[_-]?key|token|secret|password)\s*[=:]\s*)[^\s,;]+', '\1[REDACTED]', 'g'), '\b(sk-[A-Za-z0-9_-]{8,}|sk-or-v1-[A-Za-z0-9_-]{8,})\b', '[REDACTED]', 'g')"
ORACLE = {
    "sentence_split": f"SELECT doc_id, CAST(len(s) AS INT) AS n_sentences, sha256(array_to_string(s, chr(10) || chr(10))) AS sentences_sha256 FROM (SELECT doc_id, {_SENT} AS s FROM documents)",
    "token_estimate": r"SELECT doc_id, greatest(1, CAST(trunc(len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '')) * 1.3::DOUBLE) AS INT)) AS tokens FROM documents",
    "content_hash": "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents",
    "chunk_documents": rf"""
WITH {FOLDED.format(most=200, overlap=30)}
SELECT doc_id, CAST(idx AS INT) AS idx, {_PLAIN.format('source')} || '__' || {_PLAIN.format(repr('Lore > Part 1/2'))} || '__c' || idx || '__' || left(sha256(chunk), 10) AS chunk_id, sha256(chunk) AS content_hash,
  greatest(1, CAST(trunc(len(list_filter(string_split_regex(chunk, '\s+'), lambda w: w <> '')) * 1.3::DOUBLE) AS INT)) AS tokens FROM folded JOIN documents USING (doc_id)""",
    "chunk_id": f"SELECT doc_id, {_PLAIN.format('source')} || '__' || {_PLAIN.format(repr('Lore > Part 1/2'))} || '__c' || (doc_id % 5) || '__' || left(sha256(coalesce(text, '')), 10) AS chunk_id FROM documents",
    "contextual_header": """
SELECT doc_id, 'Entity: ' || source || ' | Aliases: ' || coalesce(nullif(array_to_string([source || '-' || i for i in range(least(5, doc_id % 8))], ', '), ''), 'None') || ' | Section: Introduction'
  || ' | Categories: ' || coalesce(nullif(array_to_string([lang || '/' || i for i in range(least(6, doc_id % 9))], ', '), ''), 'General') || chr(10) AS header FROM documents""",
    "upsert_insert_if_absent": "SELECT min(doc_id) AS doc_id, h AS content_hash FROM (SELECT doc_id, sha256(text) AS h FROM documents) GROUP BY h HAVING count(*) FILTER (WHERE doc_id % 2 = 0) = 0",
    "embedding_cache_join": """
WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents),
c AS (SELECT h, arg_max(embedding, doc_id) AS e FROM d JOIN embeddings ON vec_id = doc_id WHERE len(embedding) = 64 AND label <> 9 GROUP BY h)
SELECT doc_id, e IS NOT NULL AS cached, round(sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in e])), 4) AS norm FROM d LEFT JOIN c USING (h)""",
    "redact_secrets": f"""
WITH a AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 1099511627776 + conv_id * 1000 + turn, coalesce(text, '') FROM conversations
UNION ALL VALUES (-1, 'Authorization: Bearer abc.DEF-123/x=='), (-2, 'use sk-abcdefgh1234 or SK-no, api-key = zzz;next'), (-3, 'token: t0 secret=s1 Password : p'))
SELECT id, c <> t AS changed, sha256(c) AS clean_sha256 FROM (SELECT id, t, {_REDACTED} AS c FROM a)""",
    "html_text": rf"""
WITH h AS (SELECT page_id, url, {_FURNITURE} AS h FROM pages),
b AS (SELECT page_id, coalesce(nullif(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1), ''), url) AS title,
  array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(h, '(?is)<title[^>]*>.*?</title>', '', 'g'), '(?s)<[^>]*>', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS body FROM h)
SELECT page_id, title, CAST(length(body) AS INT) AS n_chars, sha256(body) AS body_sha256 FROM b WHERE length(body) >= 50""",
    "link_discovery": r"""
WITH f AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"#]+)', 1)) AS h FROM pages),
l AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, CASE WHEN regexp_matches(h, '^https?://') THEN h WHEN h[1:2] = '//' THEN regexp_extract(url, '^(https?:)', 1) || h
  WHEN h[1] = '/' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || h ELSE regexp_extract(url, '^(https?://[^?#]*/)', 1) || h END AS link FROM f)
SELECT DISTINCT page_id, link FROM l WHERE regexp_extract(link, '^(https?://[^/?#]+)', 1) = root AND link[1:4] = 'http' AND NOT regexp_matches(link, '(?i)\.(png|jpe?g|pdf|zip|exe)$')""",
    "valid_urls": r"""
SELECT page_id, coalesce(url[1:4] = 'http' AND NOT regexp_matches(url, '(?i)\.(png|jpe?g|pdf|zip|exe)$'), false) AS valid
FROM (SELECT page_id, url FROM pages UNION ALL VALUES (-1, 'http://a/b.PDF'), (-2, 'ftp://a'), (-3, 'https://a/b.zip?x'), (-4, 'http://a/b.jpeg'), (-5, NULL))""",
    "local_titles": "SELECT doc_id, upper(left(source, 1)) || substring(source, 2) || ' ' || upper(left(lang, 1)) || substring(lang, 2) || ' Lore ' || doc_id AS title FROM documents",
    "incremental_changes": "SELECT DISTINCT 'page ' || user_id AS title FROM events WHERE event_type IN ('purchase', 'signup') AND ts > TIMESTAMP '2024-01-20 00:00:00'",
    "wikitext_clean": r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '[\[\]{}|<>•*\-\s,()]+', ' ', 'g') AS t FROM pages),
w AS (SELECT *, string_split(t, ' ') AS w FROM p)
SELECT page_id, trim(regexp_replace(replace(t, '&amp;', '&') || ' label', ' +', ' ', 'g')) || chr(10) || ' (1)' AS plain,
  'a' || w[1] || '|b' || coalesce(w[2], '') || '|c (d, ' || coalesce(w[3], '') || ')|f' AS parts FROM w""",
    "stream_ingest_dedup": "SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY 2",
}
QUERIES = {f.__name__: f for f in (sentence_split, token_estimate, chunk_documents, content_hash, chunk_id, contextual_header, upsert_insert_if_absent, embedding_cache_join, redact_secrets, wikitext_clean, html_text, link_discovery, valid_urls, local_titles, incremental_changes, stream_ingest_dedup)}
