"""Evaluation of whole retrievals on golden questions, with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwell.functions import tables
from loomwell.functions import text as tx
from loomwell.operators import hybrid
from loomwell.operators import knowledge as kn
from loomwell.plans import retrieval
from loomwell.sources import files

TOP = 5


def _golden(spark: SparkSession, sf_dir: str) -> str:
    """A file of golden questions: passages ask for the documents that hold them, their last words are the keywords.

    Documents and passages meet by a passage's rarest term that documents have, then by the passage's tokens in a row.
    """
    bench, docs = retrieval._table(spark, sf_dir, "benchmark"), retrieval._table(spark, sf_dir, "documents")
    asked = tables.written(bench.where("text is not null").select("item_id", F.col("text").alias("question"), tx.tokens(F.col("text")).alias("passage")))
    held = docs.select("doc_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    terms = asked.select("item_id", F.explode(F.array_distinct("passage")).alias("term"))
    held = tables.written(held.join(terms.select("term").distinct(), "term", "left_semi"))
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarest = terms.join(df, "term").withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy("df", "term"))).where("n = 1")
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    likely = held.join(rarest, "term").select("item_id", "doc_id").join(asked, "item_id").join(docs.select("doc_id", "text"), "doc_id")
    expected = likely.where(F.contains(spaced(tx.tokens(F.col("text"))), spaced(F.col("passage")))).groupBy("item_id").agg(F.collect_set(F.col("doc_id").cast("string")).alias("expected_entities"))
    rows = asked.join(expected, "item_id").select(
        F.col("item_id").cast("string").alias("id"), "question", F.lit("general").alias("archetype"), F.lit("en").alias("language"), "expected_entities",
        F.slice(F.reverse("passage"), 1, 3).alias("expected_answer_keywords"), F.lit("").alias("notes"),
    )
    path = f"{tables.shared_folder(spark)}/golden-{uuid.uuid4().hex}"
    # A golden set is one JSON list.
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).write.text(path)
    return path


def eval_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden questions against the whole retrieval without and with its lexical list: hit rates, reciprocal rank and
    keyword recall of the context, means and their difference."""
    golden = tables.written(files.golden(spark, _golden(spark, sf_dir)).withColumn("q_id", F.col("id").cast("long")))
    corpus = retrieval._corpus(spark, sf_dir)
    told = hybrid.understood(golden.select("q_id", F.col("question").alias("q")), corpus)
    legs = hybrid.lists(corpus, told, TOP)
    best = lambda mode, legs: hybrid.placed(corpus, told, legs, TOP).select(F.lit(mode).alias("mode"), F.col("q_id").alias("question"), F.col("place").alias("rank"), "id")
    # Without the lexical list the others are the same.
    ranked = tables.written(best("hybrid", legs).unionByName(best("dense", legs.where("leg <> 2"))))
    expected = golden.select(F.col("q_id").alias("question"), F.explode(F.col("expected_entities").cast("array<long>")).alias("id"))
    each = kn.evaluation(ranked, expected, TOP)
    texts = corpus.chunks.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    wanted = golden.select(F.col("q_id").alias("question"), F.explode(F.array_distinct("expected_answer_keywords")).alias("word"))
    found = ranked.join(texts, "id").join(wanted, "question").where(F.contains("text", F.lower("word"))).groupBy("mode", "question").agg(F.count_distinct("word").alias("found"))
    counts = wanted.groupBy("question").agg(F.count(F.lit(1)).alias("wanted"))
    recall = each.join(counts, "question").join(found, ["mode", "question"], "left").withColumn("keywords", F.coalesce("found", F.lit(0)) / F.col("wanted"))
    return kn.summary(recall, ("hit_1", "hit_k", "mrr", "keywords"), "hybrid", "dense")


_TOKENS = r"list_filter(string_split_regex(lower(text), '[^\pL\pN]+'), lambda x: x <> '')"
_ROWS = "SELECT '{mode}' AS mode, question, citation AS rank, id, text FROM (WITH {sql} SELECT question, citation, id, text FROM o WHERE citation <= 5)"
_ASKED = "SELECT item_id AS question, text AS q FROM benchmark WHERE text IS NOT NULL"
ORACLE = {
    "eval_golden": f"""
WITH k AS ({_ROWS.format(mode='hybrid', sql=retrieval._hybrid(_ASKED, 15))} UNION ALL {_ROWS.format(mode='dense', sql=retrieval._hybrid(_ASKED, 15, False))}),
q AS (SELECT item_id AS question, {_TOKENS} AS passage FROM benchmark WHERE text IS NOT NULL),
t AS (SELECT doc_id AS id, ' ' || array_to_string({_TOKENS}, ' ') || ' ' AS body FROM documents),
e AS (SELECT question, id FROM t JOIN q ON contains(body, ' ' || array_to_string(passage, ' ') || ' ')),
m AS (SELECT mode, question, min(rank) AS best FROM k JOIN e USING (question, id) GROUP BY ALL),
w AS (SELECT DISTINCT question, unnest(list_reverse(passage)[1:3]) AS word FROM q),
f AS (SELECT mode, question, count(DISTINCT word) AS found FROM k JOIN w USING (question) WHERE contains(lower(coalesce(text, '')), lower(word)) GROUP BY ALL),
n AS (SELECT question, count(*) AS wanted FROM w GROUP BY question),
j AS (SELECT mode, question, coalesce((best <= 1)::INT, 0) AS hit_1, coalesce((best <= 5)::INT, 0) AS hit_k, coalesce(1.0::DOUBLE / best, 0) AS mrr, coalesce(found, 0) / wanted::DOUBLE AS keywords
  FROM (SELECT DISTINCT question FROM e) CROSS JOIN (SELECT DISTINCT mode FROM k) LEFT JOIN m USING (mode, question) LEFT JOIN f USING (mode, question) JOIN n USING (question)),
s AS (SELECT mode, count(*) AS n, avg(hit_1) AS hit_1, avg(hit_k) AS hit_k, avg(mrr) AS mrr, avg(keywords) AS keywords FROM j GROUP BY mode),
g AS (FROM s UNION ALL SELECT 'delta', x.n, x.hit_1 - y.hit_1, x.hit_k - y.hit_k, x.mrr - y.mrr, x.keywords - y.keywords FROM s x, s y WHERE x.mode = 'hybrid' AND y.mode = 'dense')
SELECT mode, n, round(hit_1, 6) AS hit_1, round(hit_k, 6) AS hit_k, round(mrr, 6) AS mrr, round(keywords, 6) AS keywords FROM g"""
}
QUERIES = {"eval_golden": eval_golden}
