"""Queries of facts, timelines, audits, entity pages, evaluation and chat reads, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwell.functions import tables
from loomwell.functions import text as tx
from loomwell.functions.tables import written
from loomwell.operators import knowledge as kn
from loomwell.operators import routing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read(spark, f"{sf_dir}/{name}.parquet")


def _infoboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infoboxes made of parts: the brand is the entity, a part one of its rows."""
    p = _table(spark, sf_dir, "part")
    kept = lambda test, c: F.when(test, c).otherwise("")
    size = F.col("p_size")
    box = F.create_map(
        F.lit("Species"), kept(size % 3 == 0, F.col("p_type")), F.lit("D Rank"), F.lit(""), F.lit("Rank"), F.lit("an earlier one"), F.lit("rank"), F.concat(F.lit("R"), (size % 7).cast("string")),
        F.lit("Skill"), kept(size % 5 == 0, F.replace("p_name", F.lit(" "), F.lit(" , "))), F.lit("weapon"), kept(size > 25, F.col("p_type")),
    )
    category = F.when(size % 11 == 0, F.array(F.lit("Main Characters"))).otherwise(F.array(F.lit("Lore")))
    return p.select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("entity"), category.alias("categories"), F.map_filter(box, lambda k, v: v != "").alias("infobox"))


def facts_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn.facts(_infoboxes(spark, sf_dir))


def facts_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kn.matching(kn.facts(_infoboxes(spark, sf_dir)).where(F.lower("rank") == F.lower(F.lit("r3"))), "brand e", ("entity", *kn.FIELDS))
    return found.orderBy(F.lower("entity"), "entity").limit(50).select("entity", "entity_type", "rank", "species", "skills")


#: Rows that no table has: Thai and Unicode edge cases.
EDGES = (
    (-1, "มังกร", "", "ที่เล่ม 4 ตอนที่ 12 ก่อน"), (-2, "มังกร", "", "เล่ม 7"), (-3, "x", "", "beforehand after_ volumes 3"), (-4, "", "", "volume 1"), (-5, "x", "  Later ", "vol. 9\tch 2"), (-6, "x", "", "  "),
)


def _event_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks told from events: a third dated, a third with a relation, a third with neither."""
    e = _table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Volume "), (F.col("event_id") % 12).cast("string"), F.lit("  chapter "), (F.col("user_id") % 30).cast("string"), F.lit(" after "), "event_type"))
    text = text.when(F.col("event_id") % 3 == 1, F.concat(F.lit("Prior to the "), "event_type", F.lit(" at "), (F.col("event_id") % 50).cast("string"))).otherwise(F.concat(F.lit("the "), "event_type"))
    rows = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("entity"), F.concat(F.lit("Log > "), "event_type").alias("section"), text.alias("text"))
    return rows.unionByName(spark.createDataFrame(list(EDGES), "seq long, entity string, section string, text string"))


def timeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn.timeline(_event_chunks(spark, sf_dir))


def timeline_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kn.matching(kn.timeline(_event_chunks(spark, sf_dir)).where(F.lower("entity").contains("user 1")), "log purchase", ("entity", "event_text", "section"))
    return found.orderBy(F.col("volume").asc_nulls_last(), F.col("chapter").asc_nulls_last(), "event_id").limit(50).select("event_id", "entity", "volume", "chapter", "relation")


def temporal_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("section", F.lit(" "), "text")
    joined = lambda word: F.array_join(F.transform(routing.numbers(t, word), lambda x: x.cast("string")), ",")
    return _event_chunks(spark, sf_dir).select("seq", joined(routing.VOLUME).alias("volumes"), joined(routing.CHAPTER).alias("chapters"), routing.has_word(t, routing.BEFORE_OR_AFTER).alias("before_after"))


def quality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").cast("string").alias("chunk_id"), F.sha2("text", 256).alias("content_hash"), F.when(F.col("doc_id") % 97 == 0, " ").otherwise(F.col("source")).alias("entity"), F.col("text").alias("chunk_text"), F.col("n_chars").cast("double").alias("fetched_at"))
    return kn.audit(rows)


def entity_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    cards = d.groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("doc_id").alias("first_doc"), F.min_by("lang", "doc_id").alias("lang"), F.min_by(F.left("text", F.lit(80)), "doc_id").alias("snippet"))
    return cards.orderBy("first_doc").limit(50)


def conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    shells = c.select("conv_id").distinct().unionByName(spark.createDataFrame([(-7,)], "conv_id long"))
    messages = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last_turn"), F.min_by(F.left("text", F.lit(200)), F.when(F.col("role") == "user", F.col("turn"))).alias("title"))
    joined = shells.join(messages, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).alias("n_messages"), F.coalesce("last_turn", F.lit(-1)).alias("last_turn"), F.coalesce("title", F.lit("")).alias("title"))
    return joined.orderBy(F.desc("last_turn"), "conv_id").limit(500)


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", place.cast("int").alias("place"), "role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


#: Terms of a passage that it is searched by, the rarest ones, and how many of them are its keywords.
RARE, KEYWORDS = 8, 3


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as questions: mean hit rates, reciprocal ranks and keyword recall of two rankings, and their difference.

    Documents that hold a passage's tokens in a row are the right answers. Rankings are by the shared ones of a
    passage's rarest terms, in number and by rarity. Documents meet passages by these terms only, so no common word
    makes a pair; candidates for a right answer meet by the rarest term.
    """
    bench, docs = _table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents")
    asked = bench.select(F.col("item_id").alias("question"), tx.tokens(F.col("text")).alias("passage"))
    terms = asked.select("question", F.explode(F.array_distinct("passage")).alias("term"))
    held = docs.select("doc_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    held = written(held.join(terms.select("term").distinct(), "term", "left_semi"))
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarest = F.row_number().over(Window.partitionBy("question").orderBy("df", "term"))
    rare = written(terms.join(df, "term").withColumn("place", rarest).where(F.col("place") <= RARE))
    hits = written(held.join(rare, "term").select("question", "doc_id", "term", "df", "place"))
    pairs = hits.groupBy("question", F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("shared"), F.round(F.sum(1 / F.col("df")), 9).alias("rarity"))
    both = pairs.select("question", "id", F.explode(F.create_map(F.lit("shared"), "shared", F.lit("rarity"), "rarity")).alias("mode", "score"))
    top = Window.partitionBy("mode", "question").orderBy(F.desc("score"), "id")
    ranked = written(both.withColumn("rank", F.row_number().over(top)).where("rank <= 10").select("mode", "question", "rank", "id"))
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    likely = hits.where("place = 1").select("question", "doc_id").join(asked, "question").join(docs.select("doc_id", "text"), "doc_id")
    expected = likely.where(F.contains(spaced(tx.tokens(F.col("text"))), spaced(F.col("passage")))).select("question", F.col("doc_id").alias("id"))
    each = kn.evaluation(ranked, expected, 5)
    found = ranked.where("rank <= 5").join(hits.where(F.col("place") <= KEYWORDS), (ranked["question"] == hits["question"]) & (ranked["id"] == hits["doc_id"]))
    found = found.groupBy(ranked["mode"], ranked["question"]).agg(F.count_distinct("term").alias("found"))
    wanted = rare.where(F.col("place") <= KEYWORDS).groupBy("question").agg(F.count(F.lit(1)).alias("wanted"))
    recall = each.join(found, ["mode", "question"], "left").join(wanted, "question").withColumn("keywords", F.coalesce("found", F.lit(0)) / F.col("wanted"))
    return kn.summary(recall, ("hit_1", "hit_k", "mrr", "keywords"), "rarity", "shared")


def keyword_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    words = F.slice(F.array(F.lit("THE"), F.lit("and"), F.lit("zzz")), F.lit(1), (F.col("turn") % 4).cast("int"))
    return c.select("conv_id", "turn", F.round(kn.keyword_recall(F.coalesce("text", F.lit("")), words), 6).alias("recall"))


_BOX = """box AS (SELECT p_partkey AS seq, p_brand AS entity, p_size % 11 = 0 AS character, CASE WHEN p_size % 3 = 0 THEN p_type ELSE '' END AS species, 'R' || (p_size % 7) AS rank,
  CASE WHEN p_size % 5 = 0 THEN array_to_string(string_split(p_name, ' '), ', ') ELSE '' END AS skills, CASE WHEN p_size > 25 THEN p_type ELSE '' END AS equipment FROM part),
r AS (SELECT *, CAST((species <> '')::INT + 1 + (skills <> '')::INT + (equipment <> '')::INT AS INT) AS richness FROM box),
facts AS (SELECT entity, CASE WHEN character THEN 'character' WHEN skills <> '' THEN 'skill' WHEN equipment <> '' THEN 'equipment' WHEN species <> '' THEN 'race' ELSE 'character' END AS entity_type,
  species, rank, '' AS status, '' AS affiliation, skills, equipment, '' AS evolution, richness FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY richness DESC, seq) AS n FROM r) WHERE n = 1)"""
_WS = r"[\s\x{85}\x{A0}\x{3000}]*"
_EDGE_ROWS = ", ".join(f"({a}, '{b}', '{c}', '{d}')" for a, b, c, d in EDGES)
_CHUNKS = f"""chunks AS (SELECT event_id AS seq, 'user ' || user_id AS entity, 'Log > ' || event_type AS section, CASE event_id % 3 WHEN 0 THEN 'Volume ' || (event_id % 12) || '  chapter ' || (user_id % 30) || ' after ' || event_type
  WHEN 1 THEN 'Prior to the ' || event_type || ' at ' || (event_id % 50) ELSE 'the ' || event_type END AS text FROM events UNION ALL VALUES {_EDGE_ROWS})"""


def _all(word: str) -> str:
    return rf"regexp_extract_all(bth, '(?i)(?:^|[^\pL\pN_]){word}{_WS}([0-9]+)', 1)"


def _has(words: str) -> str:
    return rf"regexp_matches(bth, '(?i)(?:^|[^\pL\pN_]){words}(?:[^\pL\pN_]|$)')"


_TIMELINE = f"""{_CHUNKS},
t AS (SELECT seq, trim(entity) AS entity, trim(section) AS section, trim(text) AS body, trim(section) || ' ' || trim(text) AS bth FROM chunks WHERE trim(entity) <> '' AND trim(text) <> ''),
u AS (SELECT seq, entity, section, left(regexp_replace(body, '[\\s\\x{{85}}\\x{{A0}}\\x{{3000}}]+', ' ', 'g'), 500) AS event_text, TRY_CAST({_all(routing.VOLUME)}[1] AS BIGINT) AS volume, TRY_CAST({_all(routing.CHAPTER)}[1] AS BIGINT) AS chapter,
  CASE WHEN {_has(routing.BEFORE)} THEN 'before' WHEN {_has(routing.AFTER)} THEN 'after' ELSE '' END AS relation FROM t),
tl AS (SELECT event_id, arg_max(entity, seq) AS entity, arg_max(section, seq) AS section, arg_max(event_text, seq) AS event_text, any_value(volume) AS volume, any_value(chapter) AS chapter, arg_max(relation, seq) AS relation,
  CASE WHEN any_value(volume) IS NOT NULL OR any_value(chapter) IS NOT NULL THEN 0.85 ELSE 0.6 END::DOUBLE AS confidence
  FROM (SELECT *, sha1(entity || '|' || section || '|' || coalesce(volume::VARCHAR, 'None') || '|' || coalesce(chapter::VARCHAR, 'None') || '|' || event_text) AS event_id FROM u WHERE volume IS NOT NULL OR chapter IS NOT NULL OR relation <> '') GROUP BY event_id)"""
_SEQ = r"list_filter(string_split_regex(lower(text), '[^\pL\pN]+'), lambda x: x <> '')"
ORACLE = {
    "facts_rebuild": f"WITH {_BOX} FROM facts",
    "facts_search": f"""WITH {_BOX} SELECT entity, entity_type, rank, species, skills FROM facts WHERE lower(rank) = 'r3'
  AND contains(lower(concat_ws(chr(1), entity, species, rank, skills, equipment)), 'brand') AND contains(lower(concat_ws(chr(1), entity, species, rank, skills, equipment)), 'e') ORDER BY lower(entity), entity LIMIT 50""",
    "timeline_events": f"WITH {_TIMELINE} FROM tl",
    "timeline_search": f"""WITH {_TIMELINE} SELECT event_id, entity, volume, chapter, relation FROM tl WHERE contains(lower(entity), 'user 1') AND contains(lower(concat_ws(chr(1), entity, event_text, section)), 'log') AND contains(lower(concat_ws(chr(1), entity, event_text, section)), 'purchase')
  ORDER BY volume NULLS LAST, chapter NULLS LAST, event_id LIMIT 50""",
    "temporal_metadata": f"""WITH {_CHUNKS} SELECT seq, array_to_string({_all(routing.VOLUME)}, ',') AS volumes, array_to_string({_all(routing.CHAPTER)}, ',') AS chapters, {_has(routing.BEFORE_OR_AFTER)} AS before_after FROM (SELECT seq, section || ' ' || text AS bth FROM chunks)""",
    "quality_audit": """
WITH d AS (SELECT sha256(text) AS h, doc_id % 97 = 0 OR source IS NULL AS no_entity, coalesce(trim(text), '') = '' AS no_text, doc_id, n_chars FROM documents),
g AS (SELECT count(*) AS n FROM d WHERE h IS NOT NULL GROUP BY h),
s AS (SELECT count(*) AS n_rows, count(DISTINCT h) AS n_hashes, (SELECT count(*) FROM g WHERE n > 1) AS duplicate_groups, count(*) FILTER (WHERE doc_id IS NULL) AS missing_chunk_id, count(*) FILTER (WHERE h IS NULL) AS missing_content_hash,
  count(*) FILTER (WHERE no_entity) AS missing_entity, count(*) FILTER (WHERE no_text) AS missing_chunk_text, max(nullif(n_chars, 0))::DOUBLE AS latest FROM d)
SELECT *, duplicate_groups + missing_chunk_id + missing_content_hash + missing_entity + missing_chunk_text = 0 AS ok FROM s""",
    "entity_cards": "SELECT source, count(*) AS n_chunks, min(doc_id) AS first_doc, arg_min(lang, doc_id) AS lang, arg_min(left(text, 80), doc_id) AS snippet FROM documents GROUP BY source ORDER BY first_doc LIMIT 50",
    "conversation_list": """
WITH s AS (SELECT DISTINCT conv_id FROM conversations UNION ALL SELECT -7)
SELECT conv_id, count(turn) AS n_messages, coalesce(max(turn), -1) AS last_turn, coalesce(arg_min(left(text, 200), turn) FILTER (WHERE role = 'user'), '') AS title
FROM s LEFT JOIN conversations USING (conv_id) GROUP BY conv_id ORDER BY last_turn DESC, conv_id LIMIT 500""",
    "conversation_messages": "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS place, role, sha256(coalesce(text, '')) AS text_sha256 FROM conversations",
    "eval_metrics": f"""
WITH q AS (SELECT item_id AS question, {_SEQ} AS passage FROM benchmark), a AS (SELECT question, unnest(list_distinct(passage)) AS term FROM q),
d AS (SELECT doc_id, unnest(list_distinct({_SEQ})) AS term FROM documents), df AS (SELECT term, count(*) AS df FROM d WHERE term IN (SELECT term FROM a) GROUP BY term),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY df, term) AS place FROM a JOIN df USING (term)) WHERE place <= 8),
h AS (SELECT question, doc_id AS id, term, df, place FROM d JOIN r USING (term)),
p AS (SELECT question, id, count(*)::DOUBLE AS shared, round(sum(1.0::DOUBLE / df), 9) AS rarity FROM h GROUP BY ALL),
b AS (SELECT 'shared' AS mode, question, id, shared AS score FROM p UNION ALL SELECT 'rarity', question, id, rarity FROM p),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mode, question ORDER BY score DESC, id) AS rank FROM b) WHERE rank <= 10),
t AS (SELECT doc_id AS id, ' ' || array_to_string({_SEQ}, ' ') || ' ' AS body FROM documents),
e AS (SELECT question, id FROM t JOIN q ON contains(body, ' ' || array_to_string(passage, ' ') || ' ')),
m AS (SELECT mode, question, min(rank) AS best FROM k JOIN e USING (question, id) GROUP BY ALL),
f AS (SELECT mode, question, count(DISTINCT term) AS found FROM k JOIN h USING (question, id) WHERE rank <= 5 AND place <= 3 GROUP BY ALL),
w AS (SELECT question, count(*) AS wanted FROM r WHERE place <= 3 GROUP BY question),
j AS (SELECT mode, question, coalesce((best <= 1)::INT, 0) AS hit_1, coalesce((best <= 5)::INT, 0) AS hit_k, coalesce(1.0::DOUBLE / best, 0) AS mrr, coalesce(found, 0) / wanted::DOUBLE AS keywords
  FROM (SELECT DISTINCT question FROM e) CROSS JOIN (SELECT DISTINCT mode FROM k) LEFT JOIN m USING (mode, question) LEFT JOIN f USING (mode, question) JOIN w USING (question)),
s AS (SELECT mode, count(*) AS n, avg(hit_1) AS hit_1, avg(hit_k) AS hit_k, avg(mrr) AS mrr, avg(keywords) AS keywords FROM j GROUP BY mode),
g AS (FROM s UNION ALL SELECT 'delta', x.n, x.hit_1 - y.hit_1, x.hit_k - y.hit_k, x.mrr - y.mrr, x.keywords - y.keywords FROM s x, s y WHERE x.mode = 'rarity' AND y.mode = 'shared')
SELECT mode, n, round(hit_1, 6) AS hit_1, round(hit_k, 6) AS hit_k, round(mrr, 6) AS mrr, round(keywords, 6) AS keywords FROM g""",
    "keyword_recall": """
SELECT conv_id, turn, round(CASE WHEN turn % 4 = 0 THEN 1.0 ELSE (contains(t, 'the')::INT + (turn % 4 > 1 AND contains(t, 'and'))::INT + (turn % 4 > 2 AND contains(t, 'zzz'))::INT) / (turn % 4)::DOUBLE END, 6) AS recall
FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations)""",
}
QUERIES = {f.__name__: f for f in (facts_rebuild, facts_search, timeline_events, timeline_search, temporal_metadata, quality_audit, entity_cards, conversation_list, conversation_messages, eval_metrics, keyword_recall)}
