"""Line dedup: drop lines that many documents share.

Every text is split at ``\\n`` and exploded to (document, position, key hash). The distinct documents of each hash are
counted in two steps, by (hash, document) and by hash, both with map-side combination; the frequent ones are joined back to the positions, and each text is put together again by
position without them. Only built-in functions run; line texts themselves never travel, their 16-byte hashes do.

Defined results: a null or empty text is one empty line and is kept as an empty text; lines whose key is empty are
never dropped; rows with one ``doc_id`` are one document, however often given, and rows with equal id and text are
treated alike; a null ``doc_id`` is kept and is no document in the count, as in SQL's ``count(DISTINCT doc_id)``; an empty table gives an empty table. Input columns are only touched by name, so extra columns
(also ones named like internal ones) pass through ``dedup_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm.common import checkpointed, table

#: ``[\x20\x09-\x0D]``, stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Production parameters: the shortest key in code points, and the number of documents at which a line goes.
MIN_KEY, MIN_DOCS = 1, 10


def line_key(line: Column) -> Column:
    """A line stripped of ASCII white space, with A-Z (only) in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def key_hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


def _row_key(doc_id: Column, text: Column) -> Column:
    """Equal for rows with equal id and text, which have equal results."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), text)))


def dropped_positions(docs: DataFrame, doc_id: str, text: str, min_key: int, min_docs: int) -> DataFrame:
    """(row key, drops array<int>) for the documents that lose lines."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(F.col(doc_id).alias("doc"), _row_key(F.col(doc_id), body).alias("row"), F.transform(F.split(body, "\n", -1), line_key).alias("keys"))
    long_enough = lambda k: F.length(k) >= min_key
    frequent = checkpointed(
        lines.where(F.col("doc").isNotNull())
        .select("doc", F.explode(F.array_distinct(F.filter("keys", long_enough))).alias("k"))
        .select("doc", key_hash(F.col("k")).alias("h"))
        .distinct()
        .groupBy("h")
        .agg(F.count(F.lit(1)).alias("docs"))
        .where(F.col("docs") >= min_docs)
        .select("h")
    )
    placed = lines.select("row", F.posexplode("keys").alias("pos", "k")).where(long_enough(F.col("k"))).select("row", "pos", key_hash(F.col("k")).alias("h"))
    # The frequent hashes are written out, so both sides of this join are dealt out for it alone: Spark can
    # broadcast them if they turn out small, and can split the partition of a line that is everywhere.
    hits = placed.join(frequent, "h").select("row", "pos")
    return hits.groupBy("row").agg(F.collect_set("pos").alias("drops"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_key: int = MIN_KEY, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs``, the text without frequent lines, and a struct ``_lines`` (n_lines, n_dropped)."""
    body = F.coalesce(F.col(text), F.lit(""))
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("given"), _row_key(F.col(doc_id), body).alias("row"), body.alias("body"))
    drops = dropped_positions(docs, doc_id, text, min_key, min_docs)
    joined = given.join(drops, "row", "left").withColumn("lines", F.split("body", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("drops", F.array().cast("array<int>")))
    kept = F.when(F.col("drops").isNull(), F.col("body")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    counts = F.struct(F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"))
    columns = [kept.alias(c) if c == text else F.col(f"given.`{c}`").alias(c) for c in docs.columns]
    return joined.select(*columns, counts.alias("_lines"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many lines it had and lost, and the digest of what stays."""
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_KEY = r"""translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""
#: (doc_id, pos, line, key, frequent) of every line of ``source``; shared with the pipeline's SQL.
LINES_SQL = f"""
SELECT doc_id, pos, line, key, length(key) >= 1 AND docs >= 10 AS frequent
FROM (SELECT *, count(DISTINCT doc_id) OVER (PARTITION BY key) AS docs
      FROM (SELECT doc_id, pos, line, {_KEY} AS key
            FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
                  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {{source}}))))
"""
ORACLE = {
    "op5_line_dedup": f"""
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(frequent AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT frequent), '')) AS kept_sha256
FROM ({LINES_SQL.format(source='documents')}) GROUP BY doc_id
"""
}
QUERIES = {"op5_line_dedup": op5_line_dedup}
