"""Readers of pages, chunks, local documents and golden questions, with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.functions import tables

PAGE = "page_id long, title string, canonical_url string, revision_id long, revision_timestamp string, categories array<string>, raw_wikitext string, fetched_at double"
CHUNK = "chunk_id string, page_id long, entity string, section_path string, chunk_type string, chunk_text string, raw_text string, content_hash string, canonical_url string, categories array<string>, aliases array<string>, language string, fetched_at double"
GOLDEN = "id string, question string, archetype string, language string, expected_entities array<string>, expected_answer_keywords array<string>, notes string"
API_ANSWER = (
    "query struct<pages:array<struct<pageid:bigint,title:string,missing:boolean,categories:array<struct<title:string>>,"
    "revisions:array<struct<revid:bigint,timestamp:string,slots:struct<main:struct<content:string>>>>>>>"
)
#: File endings that local documents have, and those of links that are not pages.
TEXT_FILES = ("md", "txt", "markdown", "json")
NOT_PAGES = r"(?i)\.(png|jpe?g|pdf|zip|exe)$"


def write_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    """Rows as JSON, one a line: added to a table there or in its place."""
    rows.write.mode("append" if append else "overwrite").json(path)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages; a line that is no record becomes a row with the line as ``raw_wikitext`` and an ``error``."""
    rows = spark.read.schema(f"{PAGE}, bad_record string").json(path, columnNameOfCorruptRecord="bad_record")
    return rows.withColumn("error", F.when(F.col("bad_record").isNotNull(), "not a record")).withColumn("raw_wikitext", F.coalesce("bad_record", "raw_wikitext")).drop("bad_record")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(path)


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions; none where there is no such file."""
    if not tables.exists(spark, path):
        return spark.createDataFrame([], GOLDEN)
    return spark.read.schema(GOLDEN).json(path, multiLine=True)


def title_of(path: Column) -> Column:
    """A file's name without its ending, ``_`` and ``-`` as spaces, words capitalised."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return F.initcap(F.translate(F.url_decode(F.replace(stem, F.lit("+"), F.lit("%2B"))), "_-", "  "))


def local_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(title, path, raw_text) of all text files below a folder."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"))
    wanted = files.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*TEXT_FILES))
    return wanted.select(title_of(F.col("path")).alias("title"), "path", F.col("value").alias("raw_text"))


def valid_url(url: Column) -> Column:
    return F.coalesce(url.startswith("http") & ~url.rlike(NOT_PAGES), F.lit(False))


def links(pages_table: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, link): links to pages of the same host, made absolute; each once a page."""
    found = pages_table.select("page_id", F.col(url).alias("u"), F.explode(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"#]+)'), 1)).alias("h"))
    root = F.regexp_extract("u", r"^(https?://[^/?#]+)", 1)
    absolute = F.when(F.col("h").rlike(r"^https?://"), F.col("h")).when(F.col("h").startswith("//"), F.concat(F.regexp_extract("u", r"^(https?:)", 1), "h"))
    absolute = absolute.when(F.col("h").startswith("/"), F.concat(root, "h")).otherwise(F.concat(F.regexp_extract("u", r"^(https?://[^?#]*/)", 1), "h"))
    rows = found.select("page_id", root.alias("root"), absolute.alias("link")).where(F.regexp_extract("link", r"^(https?://[^/?#]+)", 1) == F.col("root"))
    return rows.where(valid_url(F.col("link"))).select("page_id", "link").distinct()


def api_pages(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """Pages of landed API answers (one a line, each with many pages): those that are missing are left out, of revisions the
    first counts, categories lose their prefix, and the address is made of ``base`` and the title."""
    answers = spark.read.schema(API_ANSWER).json(path).select(F.explode("query.pages").alias("p"), F.col("_metadata.file_modification_time").alias("landed"))
    rows = answers.where(~F.coalesce("p.missing", F.lit(False))).select("p.*", "landed").withColumn("r", F.get("revisions", F.lit(0)))
    named = F.filter(F.transform("categories", lambda c: F.replace(c["title"], F.lit("Category:"), F.lit(""))), lambda c: c != "")
    address = F.concat(F.lit(base.rstrip("/") + "/"), F.replace("title", F.lit(" "), F.lit("_"))) if base else F.lit("")
    return rows.select(
        F.col("pageid").alias("page_id"), "title", address.alias("canonical_url"), F.coalesce("r.revid", F.lit(0)).alias("revision_id"), F.coalesce("r.timestamp", F.lit("")).alias("revision_timestamp"),
        F.coalesce(named, F.array().cast("array<string>")).alias("categories"), F.coalesce("r.slots.main.content", F.lit("")).alias("raw_wikitext"), F.unix_timestamp("landed").cast("double").alias("fetched_at"),
    )
