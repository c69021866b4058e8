"""Queries of wiki pages, answers, settings and counts, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.functions import tables, wikitext
from loomwell.operators import answers, wiki
from loomwell.plans import retrieval

TABLES = ("documents", "pages", "embeddings", "conversations", "benchmark", "labels")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read(spark, f"{sf_dir}/{name}.parquet")


def _wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as wiki pages: an infobox in one of three layouts, a lead of all kinds of marks, headings of changing level over their lines."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[=\[\]{}|<>'&*#:;!-]", "")
    d, n = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.split(text, "\n").alias("lines")), F.col("doc_id")
    bar = lambda i: F.repeat(F.lit("="), (1 + i % 4).cast("int"))
    title = lambda i: F.when(i % 7 == 5, "References").otherwise(F.concat(F.lit("Part "), i.cast("string")))
    body = F.array_join(F.transform("lines", lambda x, i: F.concat(bar(i), F.lit(" "), title(i), F.lit(" "), bar(i), F.lit("\n  "), x, F.lit("\n"))), "")
    name, race = F.concat(F.lit("[[N|"), "source", F.lit("]]")), F.concat(F.lit("{{S|''"), "lang", F.lit("''}}"))
    box = F.when(n % 3 == 0, F.concat(F.lit("{{Infobox character|name="), name, F.lit("|race="), race, F.lit("}}")))
    box = box.when(n % 3 == 1, F.concat(F.lit("{{Character Infobox\n|name="), name, F.lit("\n|race="), race, F.lit("}}")))
    box = box.otherwise(F.concat(F.lit("{{Character Infobox\n| name = "), name, F.lit("\n|race=once\n| none =\n| race = {{gone|x\n}}"), race, F.lit("\n}}")))
    lead = F.concat(
        F.lit("\n'''Lead''' of [["), "lang", F.lit("#x|l]] &amp; [[File:a.png]] [[pt-br:x]] [[api:"), (n % 9).cast("string"), F.lit("]] [["), "source",
        F.lit("]], see [http://x.y site] [http://z]<ref>no</ref> {{Nihongo|[[a|b]]|k}}{{gone}} <nowiki>{{</nowiki>\n"),
    )
    return d.select("doc_id", F.concat(box, lead, body).alias("raw"))


def wiki_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _wiki(spark, sf_dir).select("doc_id", wikitext.parsed(F.col("raw")).alias("page"))
    rows = pages.select("doc_id", F.posexplode("page.sections").alias("pos", "s"))
    # Written here, so that the parser gets batches of few bytes, however long pages are.
    with tables.small_batches(spark):
        return tables.written(rows.select("doc_id", "pos", "s.title", "s.level", "s.path", F.sha2("s.content", 256).alias("content_sha256")))


def wiki_infobox(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _wiki(spark, sf_dir).select("doc_id", wikitext.parsed(F.col("raw")).alias("page"))
    field = lambda name: F.try_element_at(wikitext.fields_map(F.col("page")), F.lit(name)).alias(name)
    with tables.small_batches(spark):
        return tables.written(pages.select("doc_id", F.size("page.fields").alias("n"), field("name"), field("race"), F.array_join("page.links", "|").alias("links"), "page.lead"))


def page_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that pages made of suppliers tell of."""
    s = _table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    other = lambda n: F.concat(F.lit("S"), ((k + n) % 50).cast("string"))
    fields = F.create_map(F.lit("Old Master"), F.concat(F.lit("[["), other(1), F.lit("]], "), other(2), F.lit("; x")), F.lit("servants"), F.concat(other(3), F.lit("<br/>http://no")), F.lit("Nation"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string"), F.lit("0")), F.lit("age"), F.lit("12"))
    pages = s.select(
        F.concat(F.lit("S"), (k % 50).cast("string")).alias("entity"), F.when(k % 2 == 0, F.concat(F.lit("kind "), (k % 5).cast("string"))).alias("species"), F.array(F.concat(F.lit("T"), (k % 9).cast("string"))).alias("titles"),
        fields.alias("fields"), F.when(k % 3 == 0, "lead").otherwise("").alias("lead"), F.array(other(0), other(7), F.lit("File:a")).alias("links"),
    )
    return wiki.page_edges(pages)


def rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of the first question, which alone is asked."""
    found = retrieval.hybrid_retrieve(spark, sf_dir, retrieval.ASKED[:1]).withColumnRenamed("source", "title")
    return answers.prompt(found).select(F.sha2("prompt", 256).alias("prompt_sha256"), "n", "confident")


def verification_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as checkers' answers: in fenced JSON, as plain words, and fenced without JSON."""
    c, text = _table(spark, sf_dir, "conversations"), F.coalesce("text", F.lit(""))
    fenced = lambda x, kind="": F.concat(F.lit(f"```{kind}\n"), x, F.lit("\n```"))
    verdict = F.when(F.col("turn") % 2 == 0, "ok").otherwise("wrong")
    told = F.when(F.col("turn") % 3 == 0, fenced(F.to_json(F.struct(verdict.alias("verdict"), text.alias("summary"))), "json")).when(F.col("turn") % 3 == 1, text).otherwise(fenced(text))
    return c.select("conv_id", "turn", answers.verification(told).alias("v")).select("conv_id", "turn", "v.verdict", F.sha2("v.summary", 256).alias("summary_sha256"))


def settings_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    rows = n.select(F.concat(F.lit("key"), (F.col("n_nationkey") % 6).cast("string")).alias("key"), F.when(F.col("n_nationkey") % 2 == 0, "global").otherwise("project").alias("scope"), F.concat(F.lit("p"), (F.col("n_regionkey") % 2).cast("string")).alias("project"), F.col("n_name").alias("value"))
    return answers.settings(rows.unionByName(spark.createDataFrame([("api_key", "global", "", "x")], "key string, scope string, project string, value string")), "p1")


def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (_table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("what"), "n") for t in TABLES))


_HYBRID = retrieval.ORACLE["hybrid_retrieve"]
ORACLE = {
    "wiki_infobox": """
SELECT doc_id, CAST(2 AS INT) AS n, source AS name, '(' || lang || ')' AS race, 'N|' || lang || '#x|api:' || doc_id % 9 || '|' || source || '|a' AS links,
  'Lead of l & File:a.png pt-br:x api:' || doc_id % 9 || ' ' || source || ', see site b {{' AS lead FROM documents""",
    "wiki_sections": r"""
WITH d AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[=\[\]{}|<>''&*#:;!-]', '', 'g'), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
s AS (SELECT *, i % 4 + 1 AS level, i % 7 = 5 AS left_out, 'Part ' || i AS title FROM l),
-- The last heading of each level above, if no later one of a lower level closed it.
w AS (SELECT *, max(CASE WHEN level = 1 AND NOT left_out THEN i END) OVER b AS a1, max(CASE WHEN level = 2 AND NOT left_out THEN i END) OVER b AS a2,
             max(CASE WHEN level = 3 AND NOT left_out THEN i END) OVER b AS a3
      FROM s WINDOW b AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, coalesce(CASE WHEN level > 1 THEN 'Part ' || a1 || ' > ' END, '') || coalesce(CASE WHEN level > 2 AND a2 > coalesce(a1, -1) THEN 'Part ' || a2 || ' > ' END, '')
             || coalesce(CASE WHEN level > 3 AND a3 > coalesce(greatest(a1, a2), -1) THEN 'Part ' || a3 || ' > ' END, '') || title AS path FROM w WHERE NOT left_out)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS pos, title, CAST(level AS INT) AS level, path,
  sha256(title || CASE WHEN trim(line, ' ' || chr(9) || chr(13)) <> '' THEN chr(10) || trim(regexp_replace(line, '[ \t]+', ' ', 'g'), ' ' || chr(13)) ELSE '' END) AS content_sha256 FROM p""",
    "page_graph": """
WITH p AS (SELECT 'S' || (s_suppkey % 50) AS e, s_suppkey AS k, s_nationkey AS nk FROM supplier),
x AS (SELECT e AS source, 'kind ' || (k % 5) AS target, 'species_of' AS relation, 1.0 AS confidence FROM p WHERE k % 2 = 0 UNION ALL SELECT e, 'T' || (k % 9), 'has_title', 1.0 FROM p
  UNION ALL SELECT e, 'S' || ((k + 1) % 50), 'disciple_of', 0.9 FROM p UNION ALL SELECT e, 'S' || ((k + 2) % 50), 'disciple_of', 0.9 FROM p UNION ALL SELECT 'S' || ((k + 3) % 50), e, 'subordinate_of', 0.9 FROM p
  UNION ALL SELECT e, 'N' || nk || '0', 'affiliated_with', 0.95 FROM p UNION ALL SELECT e, 'S' || ((k + 7) % 50), 'associated_with', 0.7 FROM p WHERE k % 3 = 0)
SELECT DISTINCT source, target, relation, confidence::DOUBLE AS confidence FROM x""",
    "rag_prompt": f"SELECT sha256(string_agg('[' || citation || '] ' || source || chr(10) || snippet, chr(10) || chr(10) ORDER BY citation)) AS prompt_sha256, count(*) AS n, coalesce(max(score) >= 0.35, false) AS confident FROM ({_HYBRID}) WHERE question = 0",
    "verification_parse": r"""
SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN 'unverified' WHEN turn % 2 = 0 THEN 'ok' ELSE 'wrong' END AS verdict,
  sha256(CASE WHEN turn % 3 = 0 THEN t ELSE left(regexp_replace(t, '^\s+|\s+$', '', 'g'), 1000) END) AS summary_sha256 FROM (SELECT *, coalesce(text, '') AS t FROM conversations)""",
    "settings_lookup": """
SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY scope = 'global', value) AS n FROM (
  SELECT 'key' || (n_nationkey % 6) AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'global' ELSE 'project' END AS scope, 'p' || (n_regionkey % 2) AS project, n_name AS value FROM nation) WHERE scope = 'global' OR project = 'p1') WHERE n = 1""",
    "table_stats": " UNION ALL ".join(f"SELECT '{t}' AS what, count(*) AS n FROM {t}" for t in TABLES),
}
QUERIES = {f.__name__: f for f in (wiki_sections, wiki_infobox, page_graph, rag_prompt, verification_parse, settings_lookup, table_stats)}
