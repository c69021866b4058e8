"""Queries of parsed pages, lookups, pages of lists, chat writes, sinks and model hooks, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.functions import tables
from loomwell.functions import text as tx
from loomwell.operators import answers, chats, chunking, graph, hybrid, routing, wiki
from loomwell.operators import knowledge as kn
from loomwell.plans import knowledge, texts
from loomwell.sources import dumps, files
from loomwell.streaming import ingest, keyed


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read(spark, f"{sf_dir}/{name}.parquet")


def _text(*parts) -> F.Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as wiki pages, with redirects as aliases."""
    s, k = _table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    said = F.regexp_replace(F.substring(F.substring_index("text", "\n", 1), 1, 200), "[^A-Za-z0-9]+", " ")
    s = s.join(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("s_suppkey"), said.alias("said")), "s_suppkey", "left")
    said = F.coalesce("said", F.lit(""))
    raw = _text(
        "{{Character Infobox\n| name = [[X|Name ", k, "]]\n| titles = {{Nihongo|[[l|Lord ", k % 7, "]]|x}}<br/>Duke, Count\n| race = {{S|kin ", k % 3, "}}|alias = A", k % 5, "\n| power = {{W|''p''}}",
        k, "{{gone|a\nb}}\n| none = <!-- x -->\n}}\n'''Lead''' of [[N", F.col("s_nationkey"), "|nation]] &amp; [[File:a.png|f]]it, see [http://x.y site].<ref>no [[r]]</ref> ", said,
        "\n== History ==\nText a ", k, ". More.\n=== Early ===\n\nText  b {{gone|{{x}}}}here.\n== References ==\nno\n=== Late ===\n[[pt-br:z]]c <nowiki>{{</nowiki>\n== Skills ==\n{{s|note}} Text [[d#e]]. ",
        said, "\n== Empty ==\n",
    )
    pages = s.select(k.alias("page_id"), F.col("s_name").alias("title"), raw.alias("raw_text"), F.array(F.lit("Lore"), _text("N", F.col("s_nationkey"))).alias("categories"))
    blank = spark.createDataFrame([(-1, "blank", " \n", []), (-2, "null", None, [])], pages.schema)
    redirects = s.where(k % 2 == 0).select(k.alias("seq"), _text("R", k % 4).alias("alias"), F.col("s_name").alias("target"))
    redirects = redirects.withColumn("alias", _text(F.col("alias"), "-", F.col("seq")))
    return wiki.quarantined(wiki.parse_pages(pages.unionByName(blank), routing.alias_map(redirects)))[0]


def parse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = F.array_join(F.transform("sections", lambda s: F.concat(s["path"], F.lit("="), s["content"])), "|")
    joined = lambda c: F.array_join(c, "|").alias(c)
    return _parsed(spark, sf_dir).select("page_id", joined("aliases"), "lead", paths.alias("sections"), joined("links"), F.size("infobox").alias("n_fields"))


def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.chunk_pages(_parsed(spark, sf_dir)).select("page_id", "section", "idx", "chunk_type", "chunk_id", "content_hash")


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages, some lines of which are no records: what is read of each, and what is put aside with an error."""
    c, k = _table(spark, sf_dir, "customer"), F.col("c_custkey")
    raw = F.when(k % 5 == 1, "a {{b").when(k % 5 == 2, "a <!-- b").when(k % 5 == 3, "<nowiki>{{</nowiki> fine").otherwise(_text("''", F.col("c_mktsegment"), "'' {{b}} <!-- c -->"))
    line = F.to_json(F.struct(k.alias("page_id"), F.col("c_name").alias("title"), raw.alias("raw_wikitext")))
    path = f"{tables.shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    c.select(F.when(k % 7 == 0, F.substring_index(line, ",", 2)).otherwise(line)).write.text(path)
    pages = files.pages(spark, path).select("page_id", "title", F.col("raw_wikitext").alias("raw_text"), "error")
    good, bad = wiki.quarantined(wiki.parse_pages(pages, spark.createDataFrame([], "canonical string, aliases array<string>")))
    return good.select("page_id", F.lit("").alias("error"), F.col("lead").alias("text")).unionByName(bad.select("page_id", "error", F.col("raw_text").alias("text")))


def api_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as landed API answers of 50 pages each, some pages missing or without revisions or categories."""
    c, k = _table(spark, sf_dir, "customer"), F.col("c_custkey")
    slots = F.struct(F.struct(F.concat(F.lit("text of "), "c_name").alias("content")).alias("main"))
    revision = F.struct((k * 10).alias("revid"), F.concat(F.lit("2024-01-"), (k % 28 + 1).cast("string")).alias("timestamp"), slots.alias("slots"))
    page = F.struct(
        F.when(k % 9 != 0, k).alias("pageid"), F.replace("c_name", F.lit("#"), F.lit(" ")).alias("title"), F.when(k % 9 == 0, True).alias("missing"), F.when(k % 4 != 0, F.array(revision)).alias("revisions"),
        F.when(k % 5 != 0, F.array(F.struct(F.concat(F.lit("Category:"), "c_mktsegment").alias("title")), F.struct(F.lit("").alias("title")))).alias("categories"),
    )
    path = f"{tables.shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    c.groupBy((k / 50).cast("int").alias("answer")).agg(F.to_json(F.struct(F.struct(F.collect_list(page).alias("pages")).alias("query"))).alias("value")).select("value").write.text(path)
    return files.api_pages(spark, path, "https://w.org/wiki/").select("page_id", "title", "canonical_url", "revision_id", "revision_timestamp", F.array_join("categories", "|").alias("categories"), "raw_wikitext")


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents written as JSON lines and read back by their schema."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.explode(chunking.fold(F.coalesce("text", F.lit("")), 200)).alias("chunk_text"))
    d = d.withColumn("content_hash", tx.content_hash(F.col("chunk_text"))).withColumn("chunk_id", tx.chunk_id(F.col("source"), F.col("lang"), F.col("doc_id"), F.col("chunk_text")))
    path = f"{tables.shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    rows = d.select("chunk_id", F.col("doc_id").alias("page_id"), F.col("source").alias("entity"), "chunk_text", "content_hash", F.array("lang").alias("categories"), F.col("lang").alias("language"))
    files.write_lines(rows, path)
    read = files.chunks(spark, path)
    return read.groupBy("page_id", "entity", "language").agg(F.count(F.lit(1)).alias("n"), F.sum((tx.content_hash(F.col("chunk_text")) == F.col("content_hash")).cast("long")).alias("n_same"), F.sum(F.length("chunk_text")).alias("chars"))


def dump_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed dumps of customers, some lines of which are no records, taken up by a stream into a keyed table in runs that
    stop and go on: what lands or is appended in between is read once."""
    c, k = _table(spark, sf_dir, "customer"), F.col("c_custkey")
    line = F.to_json(F.struct(k.alias("page_id"), F.col("c_name").alias("title"), F.concat(F.lit("about "), "c_mktsegment").alias("raw_wikitext"), F.array(F.concat(F.lit("Category:"), "c_mktsegment")).alias("categories")))
    lines = c.select(k.alias("k"), F.when(k % 7 == 0, F.concat(F.lit("{"), k.cast("string"))).otherwise(line).alias("value"))
    folder = f"{tables.shared_folder(spark)}/dumps-{uuid.uuid4().hex}"
    dumps.register(spark)
    fields, schema = ("key", "page_id", "title", "raw_text", "category", "error"), "key string, page_id long, title string, raw_text string, category string, error string"

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("key", F.coalesce(F.col("page_id").cast("string"), "raw_text")).withColumn("category", F.get("categories", F.lit(0)))
        keyed.insert(keyed.open_table(spark, f"{folder}/table", "key", schema), rows.select(*fields), "page_id", number)

    for part in range(3):
        lines.where(F.col("k") % 3 == part).select("value").write.mode("append").text(f"{folder}/landed")
        stream = spark.readStream.format("page_dumps").load(f"{folder}/landed").writeStream.foreachBatch(write)
        stream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return keyed.open_table(spark, f"{folder}/table", "key", schema).rows().select(*fields)


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as JSON lines in two parts, the first one twice in its place, and read back."""
    n = _table(spark, sf_dir, "customer")
    rows = n.select(F.col("c_custkey").alias("page_id"), F.col("c_name").alias("title"), _text('text "', F.col("c_mktsegment"), '"\n').alias("raw_wikitext"), F.array("c_mktsegment").alias("categories"))
    path = f"{tables.shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    for part, append in ((0, False), (0, False), (1, True)):
        files.write_lines(rows.where(F.col("page_id") % 2 == part), path, append)
    return files.pages(spark, path).select("page_id", "title", "raw_wikitext", F.col("categories")[0].alias("category"))


def replace_on_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, from a keyed table that takes up the events in three batches."""
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    path = f"{tables.shared_folder(spark)}/keyed-{uuid.uuid4().hex}"
    table = keyed.open_table(spark, path, "user_id", "user_id long, event_id long, event_type string", 16)
    for batch in (e.where("event_id % 10 < 6"), e.where("event_id % 10 = 6"), e.where("event_id % 10 > 6")):
        known = table.rows().select("user_id", F.col("event_id").alias("_known"))
        newer = batch.join(known, "user_id", "left").where(F.col("_known").isNull() | (F.col("event_id") > F.col("_known"))).drop("_known")
        table = keyed.upsert(table, newer, "event_id")
    return table.rows()


def ascii_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.ascii_safe(F.coalesce("text", F.lit(""))), 256).alias("ascii_sha256"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of entities named by source and language."""
    d, k = _table(spark, sf_dir, "documents"), F.col("doc_id")
    none, kind = F.array().cast("array<string>"), F.when(k % 7 == 0, "infobox").otherwise("text")
    return d.select(
        k.alias("seq"), _text(F.col("source"), "/", F.col("lang")).alias("entity"), _text("http://w/", k % 10).alias("canonical_url"), kind.alias("chunk_type"), _text("part ", k % 4).alias("section"),
        F.col("text"), F.when(k % 3 == 0, F.array(_text("Main ", F.col("lang")), F.lit("x"))).otherwise(none).alias("categories"), F.when(k % 4 == 1, F.array(_text("al", k))).otherwise(none).alias("aliases"),
        F.when((kind == "infobox") & (k % 2 == 0), _text('{"k": ', k, "}")).alias("infobox"),
    )


def entity_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kn.details(_chunks(spark, sf_dir))
    listed = F.array_join(F.transform("sections", lambda s: F.concat_ws("/", s["section"], s["chunk_type"], F.length(s["text"]).cast("string"))), ",")
    joined = lambda c: F.array_join(c, "|").alias(c)
    return found.select("entity", "canonical_url", F.coalesce("infobox", F.lit("")).alias("infobox"), joined("categories"), joined("aliases"), F.sha2(listed, 256).alias("sections_sha256"))


def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred chunks of one entity that have a category with "ain e" in it."""
    rows = kn.of_category(_chunks(spark, sf_dir), "ain e")
    return rows.where("entity = 'src6/en'").orderBy("seq").limit(100).select("seq", "section")


def entity_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of brands by first part, the second ten of them, with their facts."""
    p = _table(spark, sf_dir, "part")
    cards = p.groupBy(F.col("p_brand").alias("entity")).agg(F.count(F.lit(1)).alias("n_chunks"), F.min("p_partkey").alias("first"))
    limit, offset = kn.page(10, 10)
    some = tables.written(cards.orderBy("first").offset(offset).limit(limit))
    return kn.cards(some, kn.facts(knowledge._infoboxes(spark, sf_dir)).where("entity_type <> 'race'")).select("entity", "n_chunks", "entity_type", "species", "rank")


def facts_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn.facts_page(kn.facts(knowledge._infoboxes(spark, sf_dir)), "brand", 5, 3, entity_type="skill").select("entity", "entity_type", "rank", "species")


def facts_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kn.facts(knowledge._infoboxes(spark, sf_dir))
    return rows.where(F.col("entity") == "Brand#13").select("entity", "entity_type", "rank", "species", "skills", "richness")


def timeline_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kn.events_page(kn.timeline(knowledge._event_chunks(spark, sf_dir)), "log", volume=6, relation="after", limit=20, offset=5)
    return found.select("event_id", "entity", "volume", "chapter", "relation")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of nations, regions and suppliers with types, and the edges between them."""
    from loomwell.plans.graphs import _edges

    edges = _edges(spark, sf_dir)
    kinds = {"nation": "Location", "region": "Great locations", "supplier": "Trading group", "part": "Magic things"}
    category = F.coalesce(*(F.when(F.col("id").startswith(f"{k}:"), c) for k, c in kinds.items()), F.lit("other"))
    ids = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().where("id not like '%9'")
    return ids.select("id", F.upper("id").alias("name"), graph.node_type(F.array(category)).alias("entity_type")), edges


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0]


def graph_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0].where("id = 'supplier:7'")


def graph_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty best-connected organizations and the edges of one relation among them and all regions' nations."""
    nodes, edges = _graph(spark, sf_dir)
    top, kept = graph.overview_graph(nodes, edges, 30, "location", "in_region")
    return top.select(F.lit("node").alias("what"), "id", "degree").unionByName(kept.select(F.lit("edge").alias("what"), F.concat_ws(">", "source", "target").alias("id"), F.col("edge_id").alias("degree")))


def graph_subgraph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes one step from a nation, those that have a node row."""
    nodes, edges = _graph(spark, sf_dir)
    return graph.subgraph(edges, "nation:3", 1, 500, 500, relation="of_nation", nodes=nodes)[0].select("id", "name", "entity_type", "depth")


def graph_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _graph(spark, sf_dir)[1].select("edge_id", F.concat_ws(" é/", "source", "relation").alias("source"), F.when(F.col("edge_id") % 3 == 0, "chunk").alias("source_chunk_id"))
    return graph.with_sources(edges, "http://wiki/base/").select("edge_id", "source_url", "evidence")


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log made of the conversations: each is created, gets its messages, some are renamed, deleted, created again."""
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    none = F.lit(None).cast("string")

    def writes(rows: DataFrame, place, kind: str, message_id=none, role=none, content=none, title=none) -> DataFrame:
        seq = (F.col("conv_id") * 1000 + place).cast("long")
        return rows.select(seq.alias("seq"), (seq * 2).alias("at"), F.lit(kind).alias("kind"), "conv_id", message_id.alias("message_id"), role.alias("role"), content.alias("content"), title.alias("title"))

    ids, m = c.select("conv_id").distinct(), _text("m", F.col("turn"))
    out = writes(ids, F.lit(0), "create", title=F.when(F.col("conv_id") % 3 > 0, F.repeat(_text("title ", F.col("conv_id"), " "), 40)).otherwise(""))
    out = out.unionByName(writes(c, 10 + F.col("turn"), "message", m, F.col("role"), F.col("text"))).unionByName(writes(c.where("turn % 2 = 1"), 400 + F.col("turn"), "verify", m, content=_text('{"v": ', F.col("turn"), "}")))
    out = out.unionByName(writes(ids.where("conv_id % 5 = 0"), F.lit(500), "rename", title=F.lit("renamed"))).unionByName(writes(ids.where("conv_id % 4 = 0"), F.lit(600), "delete"))
    out = out.unionByName(writes(ids.where("conv_id % 8 = 0"), F.lit(700), "create", title=F.lit("again")))
    return out.unionByName(writes(c.where("conv_id % 8 = 0 and turn = 0"), F.lit(701), "message", F.lit("m0"), F.col("role"), F.lit("after"))).unionByName(writes(ids.where("conv_id = 1"), F.lit(-999_999_000), "message", F.lit("lost"), F.lit("user"), F.lit("x")))


def chat_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.applied(_writes(spark, sf_dir))[0]


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chats.applied(_writes(spark, sf_dir))[1]
    return rows.select("conv_id", "message_id", F.col("place").cast("int").alias("place"), "role", F.sha2("content", 256).alias("content_sha256"), "verification")


def settings_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _table(spark, sf_dir, "part"), F.col("p_partkey")
    rows = p.select(k.alias("seq"), _text("key", k % 9).alias("key"), F.when(k % 2 == 0, "global").otherwise("project").alias("scope"), F.when(k % 2 == 0, "").otherwise(_text("p", k % 3)).alias("project"), F.col("p_name").alias("value"))
    return chats.saved_settings(rows)


def _letters():
    """A stand-in for a user's encoder: how often each of eight letters occurs."""
    return lambda texts: [[float(t.count(x)) for x in "abcdefgh"] for t in texts]


def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded, a third of them from a cache."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("content_hash", tx.content_hash(F.col("text")))
    cached = d.where("doc_id % 3 = 0").select("content_hash").distinct().withColumn("embedding", F.array(*[F.lit(0.5)] * 8))
    found = hybrid.embed_texts(d, "text", _letters, cached)
    return found.select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def _by_length():
    """A stand-in for a user's scorer."""
    return lambda question, texts: [float(len(t) % 97 + len(question)) for t in texts]


def rerank_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hybrid.rerank(_table(spark, sf_dir, "benchmark"), "what is it", "text", _by_length)
    return rows.orderBy(F.desc("rerank"), "item_id").limit(20).select("item_id", "rerank")


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: counts of the tables, the share of chunks with a vector, and the data's version."""
    docs, vectors, pages, asked = (_table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias(t)) for t in ("documents", "embeddings", "pages", "conversations"))
    changed = _table(spark, sf_dir, "events").agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("changed"))
    one = docs.crossJoin(vectors).crossJoin(pages).crossJoin(asked).crossJoin(changed)  # one row each
    share = F.round(F.least(F.lit(1.0), F.col("embeddings") / F.greatest(F.lit(1), F.col("documents"))), 6)
    return one.select("documents", "embeddings", "pages", "conversations", share.alias("progress"), answers.data_version("lore", F.col("documents"), F.col("changed")).alias("data_version"))


def checker_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checker's prompt for each answer, and the answer with its attribution."""
    c, k = _table(spark, sf_dir, "conversations").where("role = 'assistant'"), F.col("turn")
    source = lambda i: F.struct(F.when((k + i) % 3 > 0, _text("E", k + i)).alias("entity"), F.when((k + i) % 2 == 0, _text("S", k)).alias("section"), F.left(F.coalesce("text", F.lit("")), F.lit(20)).alias("snippet"))
    prompt = answers.checker_prompt(_text("question ", k), F.coalesce("text", F.lit("")), F.array(source(0), source(1)), ["names", "numbers"], "Check strictly.")
    shown = answers.attributed(F.coalesce("text", F.lit("")), "Lore", "http://wiki", "CC-BY-SA")
    return c.select("conv_id", "turn", F.sha2(prompt, 256).alias("prompt_sha256"), F.sha2(shown, 256).alias("answer_sha256"))


_HEAD = "'Entity: ' || title || ' | Aliases: ' || aliases || ' | Section: ' || {} || ' | Categories: Lore, N' || n || chr(10) || chr(10)"
_PAGES = """p AS (SELECT s_suppkey AS page_id, s_suppkey AS k, s_name AS title, s_nationkey AS n, CASE WHEN s_suppkey % 2 = 0 THEN 'R' || s_suppkey % 4 || '-' || s_suppkey || ', ' ELSE '' END || 'A' || s_suppkey % 5 AS aliases,
  trim(regexp_replace(coalesce(substr(split_part(text, chr(10), 1), 1, 200), ''), '[^A-Za-z0-9]+', ' ', 'g')) AS said FROM supplier LEFT JOIN documents ON doc_id = s_suppkey)"""
_ID = "replace(replace(replace({}, ' > ', '__'), ' ', '_'), '/', '_')"
_CHUNKED = """chunks AS (SELECT doc_id AS seq, source || '/' || lang AS entity, 'http://w/' || doc_id % 10 AS url, CASE WHEN doc_id % 7 = 0 THEN 'infobox' ELSE 'text' END AS kind, 'part ' || doc_id % 4 AS section, text,
  CASE WHEN doc_id % 3 = 0 THEN 'Main ' || lang || '|x' END AS categories, CASE WHEN doc_id % 4 = 1 THEN 'al' || doc_id END AS aliases, CASE WHEN doc_id % 14 = 0 THEN '{"k": ' || doc_id || '}' END AS infobox FROM documents)"""
_NODES = """nodes AS (SELECT DISTINCT id, upper(id) AS name, CASE split_part(id, ':', 1) WHEN 'nation' THEN 'location' WHEN 'region' THEN 'location' WHEN 'part' THEN 'skill' WHEN 'supplier' THEN 'organization' ELSE 'character' END AS entity_type
  FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) WHERE id NOT LIKE '%9')"""


def _oracle() -> dict[str, str]:
    from loomwell.plans.graphs import _EDGES
    from loomwell.plans.knowledge import _BOX, _TIMELINE

    return {
        "parse_pages": f"""
WITH {_PAGES} SELECT page_id, replace(aliases, ', ', '|') AS aliases, trim('Lead of nation & fit, see site. ' || said) AS lead,
  'History=History' || chr(10) || 'Text a ' || k || '. More.|History > Early=Early' || chr(10) || 'Text b here.|History > Late=Late' || chr(10) || 'pt-br:zc {{{{|Skills=Skills' || chr(10)
    || trim('(note) Text d#e. ' || said) || '|Empty=Empty' AS sections, 'X|l|N' || n || '|r|d#e' AS links, 5 AS n_fields FROM p""",
        "chunk_pages": f"""
WITH {_PAGES}, s AS (SELECT page_id, title, aliases, n, 'text' AS chunk_type, unnest(['Introduction', 'History', 'History > Early', 'History > Late', 'Skills', 'Empty']) AS section,
    unnest([trim('Lead of nation & fit, see site. ' || said), 'History' || chr(10) || 'Text a ' || k || '. More.', 'Early' || chr(10) || 'Text b here.', 'Late' || chr(10) || 'pt-br:zc {{{{',
      'Skills' || chr(10) || trim('(note) Text d#e. ' || said), 'Empty']) AS raw FROM p),
t AS (SELECT page_id, title, section, chunk_type, {_HEAD.format('section')} || raw AS body FROM s UNION ALL
  SELECT page_id, title, 'Infobox', 'infobox', {_HEAD.format("'Infobox & Overview'")} || '[INFOBOX FACT SHEET]' || chr(10) || 'Name: Name ' || k || chr(10) || 'Aliases: A' || k % 5 || chr(10) || 'Species: (kin ' || k % 3 || ')'
    || chr(10) || 'Titles: Lord ' || k % 7 || ', Duke, Count' || chr(10) || 'Race: (kin ' || k % 3 || ')' || chr(10) || 'Alias: A' || k % 5 || chr(10) || 'Power: p' || k FROM p)
SELECT page_id, section, CAST(0 AS INT) AS idx, chunk_type, {_ID.format('title')} || '__' || {_ID.format('section')} || '__c0__' || left(sha256(body), 10) AS chunk_id, sha256(body) AS content_hash FROM t""",
        "quarantine": """
WITH c AS (SELECT c_custkey AS k, c_name, c_mktsegment AS m, c_custkey % 5 AS r FROM customer)
SELECT CASE WHEN k % 7 <> 0 THEN k END AS page_id, CASE WHEN k % 7 = 0 THEN 'not a record' ELSE '' END AS error,
  CASE WHEN k % 7 = 0 THEN '{"page_id":' || k || ',"title":"' || c_name || '"' WHEN r = 1 THEN 'a {{b' WHEN r = 2 THEN 'a <!-- b' WHEN r = 3 THEN '{{ fine' ELSE m END AS text FROM c""",
        "api_pages": """
SELECT c_custkey AS page_id, replace(c_name, '#', ' ') AS title, 'https://w.org/wiki/' || replace(replace(c_name, '#', ' '), ' ', '_') AS canonical_url, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey * 10 END AS revision_id,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '2024-01-' || (c_custkey % 28 + 1) END AS revision_timestamp, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS categories,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'text of ' || c_name END AS raw_wikitext FROM customer WHERE c_custkey % 9 <> 0""",
        "chunk_lines": rf"""
WITH {texts.FOLDED.format(most=200, overlap=30)}
SELECT doc_id AS page_id, source AS entity, lang AS language, count(*) AS n, count(*) AS n_same, CAST(sum(length(chunk)) AS BIGINT) AS chars FROM folded JOIN documents USING (doc_id) GROUP BY ALL""",
        "dump_stream": """
SELECT CASE WHEN c_custkey % 7 = 0 THEN '{' || c_custkey ELSE c_custkey::VARCHAR END AS key, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS page_id, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS title,
  CASE WHEN c_custkey % 7 = 0 THEN '{' || c_custkey ELSE 'about ' || c_mktsegment END AS raw_text, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS category,
  CASE WHEN c_custkey % 7 = 0 THEN 'not a record: JSONDecodeError' END AS error FROM customer""",
        "jsonl_round_trip": """SELECT c_custkey AS page_id, c_name AS title, 'text "' || c_mktsegment || '"' || chr(10) AS raw_wikitext, c_mktsegment AS category FROM customer""",
        "replace_on_write": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
        "ascii_copy": r"SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '?', 'g')) AS ascii_sha256 FROM documents",
        "entity_detail": f"""
WITH {_CHUNKED}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq) AS n FROM chunks) WHERE n <= 100)
SELECT entity, arg_max(url, seq) AS canonical_url, coalesce(arg_max(infobox, seq) FILTER (WHERE infobox IS NOT NULL), '') AS infobox, coalesce(arg_min(categories, seq) FILTER (WHERE categories IS NOT NULL), '') AS categories,
  coalesce(arg_min(aliases, seq) FILTER (WHERE aliases IS NOT NULL), '') AS aliases, sha256(string_agg(concat_ws('/', section, kind, length(text)::VARCHAR), ',' ORDER BY seq)) AS sections_sha256 FROM f GROUP BY entity""",
        "entity_lookup": f"WITH {_CHUNKED} SELECT seq, section FROM chunks WHERE entity = 'src6/en' AND contains(categories, 'ain e') ORDER BY seq LIMIT 100",
        "entity_page": f"""
WITH {_BOX}, c AS (SELECT p_brand AS entity, count(*) AS n_chunks, min(p_partkey) AS first FROM part GROUP BY 1 ORDER BY first LIMIT 10 OFFSET 10)
SELECT entity, n_chunks, coalesce(entity_type, '') AS entity_type, coalesce(species, '') AS species, coalesce(rank, '') AS rank FROM c LEFT JOIN (FROM facts WHERE entity_type <> 'race') f USING (entity)""",
        "facts_page": f"WITH {_BOX} SELECT entity, entity_type, rank, species FROM facts WHERE entity_type = 'skill' AND contains(lower(entity), 'brand') ORDER BY lower(entity), entity LIMIT 5 OFFSET 3",
        "facts_get": f"WITH {_BOX} SELECT entity, entity_type, rank, species, skills, richness FROM facts WHERE entity = 'Brand#13'",
        "timeline_page": f"""WITH {_TIMELINE} SELECT event_id, entity, volume, chapter, relation FROM tl WHERE volume = 6 AND relation = 'after' AND contains(lower(concat_ws(chr(1), entity, event_text, section)), 'log')
  ORDER BY volume NULLS LAST, chapter NULLS LAST, event_id LIMIT 20 OFFSET 5""",
        "graph_nodes": f"WITH {_EDGES}, {_NODES} FROM nodes",
        "graph_node": f"WITH {_EDGES}, {_NODES} FROM nodes WHERE id = 'supplier:7'",
        "graph_overview": f"""
WITH {_EDGES}, {_NODES}, g AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id),
t AS (SELECT id, degree FROM nodes JOIN g USING (id) WHERE entity_type = 'location' ORDER BY degree DESC, lower(name), id LIMIT 30),
e AS (SELECT edge_id, source || '>' || target AS id FROM edges WHERE relation = 'in_region' AND source IN (SELECT id FROM t) AND target IN (SELECT id FROM t) ORDER BY edge_id LIMIT 100)
SELECT 'node' AS what, id, degree FROM t UNION ALL SELECT 'edge', id, edge_id FROM e""",
        "graph_subgraph_nodes": f"""
WITH {_EDGES}, {_NODES}, n AS (SELECT 'nation:3' AS id, 0 AS depth UNION ALL (SELECT source, 1 FROM edges WHERE relation = 'of_nation' AND target = 'nation:3' ORDER BY edge_id LIMIT 499))
SELECT id, name, entity_type, CAST(depth AS INT) AS depth FROM n JOIN nodes USING (id)""",
        "graph_sources": f"""WITH {_EDGES} SELECT edge_id, 'http://wiki/base/' || replace(url_encode(replace(source || ' é/' || relation, ' ', '_')), '%2F', '/') AS source_url, CASE WHEN edge_id % 3 = 0 THEN 'source_chunk' ELSE 'entity_page' END AS evidence FROM edges""",
        "chat_conversations": """
WITH c AS (SELECT DISTINCT conv_id FROM conversations), m AS (SELECT conv_id, count(*) AS n, max(turn) AS last FROM conversations GROUP BY 1), z AS (SELECT conv_id, count(*) AS n FROM conversations WHERE turn = 0 GROUP BY 1)
SELECT conv_id, CASE WHEN conv_id % 8 = 0 THEN 'again' WHEN conv_id % 5 = 0 THEN 'renamed' WHEN conv_id % 3 = 0 THEN 'New chat' ELSE left(repeat('title ' || conv_id || ' ', 40), 200) END AS title,
  2 * (conv_id * 1000 + CASE WHEN conv_id % 8 = 0 THEN CASE WHEN z.n > 0 THEN 701 ELSE 700 END WHEN conv_id % 5 = 0 THEN greatest(500, 10 + last) ELSE 10 + last END)::BIGINT AS updated_at, CASE WHEN conv_id % 8 = 0 THEN coalesce(z.n, 0) ELSE m.n END AS n_messages
FROM c JOIN m USING (conv_id) LEFT JOIN z USING (conv_id) WHERE conv_id % 4 <> 0 OR conv_id % 8 = 0""",
        "chat_messages": """
WITH m AS (SELECT conv_id, 'm' || turn AS message_id, turn, role, coalesce(text, '') AS content, CASE WHEN turn % 2 = 1 THEN '{"v": ' || turn || '}' ELSE '{}' END AS verification FROM conversations WHERE conv_id % 4 <> 0
  UNION ALL SELECT conv_id, 'm0', 0, role, 'after', '{}' FROM conversations WHERE conv_id % 8 = 0 AND turn = 0)
SELECT conv_id, message_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS place, role, sha256(content) AS content_sha256, verification FROM m""",
        "settings_saved": """
SELECT 'key' || p_partkey % 9 AS key, CASE WHEN p_partkey % 2 = 0 THEN 'global' ELSE 'project' END AS scope, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'p' || p_partkey % 3 END AS project, arg_max(p_name, p_partkey) AS value FROM part GROUP BY 1, 2, 3""",
        "embed_texts": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), known AS (SELECT DISTINCT t FROM d WHERE doc_id % 3 = 0),
v AS (SELECT doc_id, t, [(length(t) - length(replace(t, x, '')))::DOUBLE for x in ['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h']] AS e FROM d)
SELECT doc_id, round(CASE WHEN t IN (SELECT t FROM known) THEN 4.0 ELSE list_sum(e) / greatest(sqrt(list_sum([x * x for x in e])), 1e-12) END, 5) AS total FROM v""",
        "rerank_scorer": "SELECT item_id, (length(text) % 97 + 10)::DOUBLE AS rerank FROM benchmark ORDER BY rerank DESC, item_id LIMIT 20",
        "status_rollup": """
WITH d AS (SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM conversations) AS conversations, (SELECT epoch_us(max(ts)) FROM events) AS changed)
SELECT documents, embeddings, pages, conversations, round(least(1.0, embeddings / greatest(1, documents)::DOUBLE), 6) AS progress, 'lore-' || documents || '-' || changed AS data_version FROM d""",
        "checker_prompt": """
WITH c AS (SELECT conv_id, turn AS k, coalesce(text, '') AS t FROM conversations WHERE role = 'assistant'),
l AS (SELECT *, list_transform([0, 1], lambda i: '[' || (i + 1) || '] ' || CASE WHEN (k + i) % 3 > 0 THEN 'E' || (k + i) ELSE 'Unknown' END || ' / ' || CASE WHEN (k + i) % 2 = 0 THEN 'S' || k ELSE 'General' END || ': ' || left(t, 20)) AS ls FROM c)
SELECT conv_id, k AS turn, sha256('Check strictly.' || chr(10) || 'ตัวเลขและวันที่, ชื่อบุคคล สถานที่ และชื่อเฉพาะ' || chr(10) || chr(10) || 'question ' || k || chr(10) || t || chr(10) || 'Sources:' || chr(10) || array_to_string(ls, chr(10))) AS prompt_sha256,
  sha256(t || chr(10) || chr(10) || '---' || chr(10) || '*Content derived from Lore (http://wiki) under CC-BY-SA license.*') AS answer_sha256 FROM l""",
    }


ORACLE = _oracle()
QUERIES = {
    f.__name__: f
    for f in (
        parse_pages, chunk_pages, quarantine, api_pages, chunk_lines, dump_stream, jsonl_round_trip, replace_on_write, ascii_copy, entity_detail, entity_lookup, entity_page, facts_page, facts_get, timeline_page, graph_nodes, graph_node,
        graph_overview, graph_subgraph_nodes, graph_sources, chat_conversations, chat_messages, settings_saved, embed_texts, rerank_scorer, status_rollup, checker_prompt,
    )
}
