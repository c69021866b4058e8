"""Structured facts, timeline events, quality audit, entity cards, evaluation and chat reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import text as tx
from loomwell.operators import routing

FIELDS = ("species", "rank", "status", "affiliation", "skills", "equipment", "evolution")
#: Field names in an infobox, by preference; words of entity types, in the order tested.
NAMES = {
    "species": ("species", "race"), "rank": ("rank", "drank", "arank"), "status": ("status",),
    "affiliation": ("affiliation", "faffiliation", "organization", "group"),
    "skills": ("skills", "skill", "abilities", "ability", "magic", "spells"),
    "equipment": ("weapons", "weapon", "equipment", "items", "armaments"),
    "evolution": ("evolution", "evolves_to", "evolved_form"),
}
LISTS = ("affiliation", "skills", "equipment")
TYPE_WORDS = (
    ("skill", ("skill", "magic", "ability", "เวทมนตร์", "สกิล")), ("equipment", ("weapon", "equipment", "item", "อาวุธ", "อุปกรณ์")),
    ("race", ("race", "species", "เผ่าพันธุ์")), ("location", ("location", "สถานที่")), ("organization", ("organization", "group", "องค์กร")),
)


def lowered(infobox: Column) -> Column:
    """An infobox with keys in lower case and spaces as underscores; the last of equal keys counts."""
    entries = F.transform(F.map_entries(infobox), lambda e: F.struct(F.replace(F.lower(e["key"]), F.lit(" "), F.lit("_")).alias("key"), e["value"].alias("value")))
    later = F.reverse(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(later, e["key"]) == F.size(entries) - i))


def field(low: Column, names: tuple[str, ...]) -> Column:
    """The first non-empty value of a lowered infobox under one of ``names``."""
    return F.coalesce(*(F.nullif(F.trim(F.try_element_at(low, F.lit(n))), F.lit("")) for n in names), F.lit(""))


def values(c: Column) -> Column:
    """A list field: a JSON list, or text split at ``, ; • |`` and line ends."""
    listed = F.when(c.startswith("["), F.from_json(c, "array<string>"))
    return F.filter(F.transform(F.coalesce(listed, F.split(c, r"[,;\n•|]")), tx.stripped), lambda x: x != "")


def entity_type(categories: Column, infobox: Column) -> Column:
    words = F.lower(F.concat_ws(" ", categories, F.map_keys(infobox)))
    out = F.when(F.exists(categories, lambda c: F.lower(c).contains("character")), "character")
    for name, found in TYPE_WORDS:
        out = out.when(tx.contains_any(words, found), name)
    return out.otherwise("character")


def facts(rows: DataFrame) -> DataFrame:
    """(seq, entity, categories, infobox map) to one row an entity, the one with most fields; the first of equals."""
    named = rows.where(F.trim("entity") != "")
    # A projection of its own: the lowered map is made once a row, then looked up.
    found = named.select("seq", "entity", entity_type(F.col("categories"), F.col("infobox")).alias("entity_type"), lowered(F.col("infobox")).alias("_low"))
    found = found.select("seq", "entity", "entity_type", *(field(F.col("_low"), NAMES[f]).alias(f) for f in FIELDS))
    found = found.withColumn("richness", reduce(lambda x, y: x + y, ((F.col(f) != "").cast("int") for f in FIELDS)))
    best = Window.partitionBy("entity").orderBy(F.desc("richness"), "seq")
    top = found.withColumn("place", F.row_number().over(best)).where("place = 1")
    return top.select("entity", "entity_type", *(F.array_join(values(F.col(f)), ", ").alias(f) if f in LISTS else F.col(f) for f in FIELDS), F.col("richness").cast("int").alias("richness"))


def page(limit: int, offset: int) -> tuple[int, int]:
    """A page's bounds: 1 to 500 rows, from 0 on."""
    return max(1, min(500, limit)), max(0, offset)


def facts_page(table: DataFrame, query: str = "", limit: int = 50, offset: int = 0, entity_type: str | None = None, rank: str | None = None) -> DataFrame:
    """A page of the facts that match, by entity in any case."""
    rows = table if entity_type is None else table.where(F.col("entity_type") == entity_type)
    rows = rows if rank is None else rows.where(F.lower("rank") == rank.lower())
    limit, offset = page(limit, offset)
    return matching(rows, query, ("entity", *FIELDS)).orderBy(F.lower("entity"), "entity").offset(offset).limit(limit)


def events_page(events: DataFrame, query: str = "", entity: str | None = None, volume: int | None = None, chapter: int | None = None, relation: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the timeline events that match, by volume and chapter, those without last."""
    rows = events if entity is None else events.where(F.lower("entity").contains(entity.lower()))
    rows = rows.where(reduce(lambda x, y: x & y, (F.col(c) == v for c, v in (("volume", volume), ("chapter", chapter), ("relation", relation)) if v is not None), F.lit(True)))
    limit, offset = page(limit, offset)
    found = matching(rows, query, ("entity", "event_text", "section"))
    return found.orderBy(F.col("volume").asc_nulls_last(), F.col("chapter").asc_nulls_last(), "event_id").offset(offset).limit(limit)


def of_category(rows: DataFrame, category: str) -> DataFrame:
    """Rows with a category that has ``category`` in it; case matters."""
    return rows.where(F.exists("categories", lambda c: c.contains(category)))


def details(chunks: DataFrame, most: int = 100) -> DataFrame:
    """Chunks (seq, entity, canonical_url, chunk_type, section, text, categories, aliases, infobox) to one row an entity.

    Its first ``most`` chunks count: the first categories and aliases that are not empty, the last address and infobox,
    and all sections in order. An entity's rank limit is pushed to the tasks, so no entity is collected whole.
    """
    first = chunks.withColumn("_n", F.row_number().over(Window.partitionBy("entity").orderBy("seq"))).where(F.col("_n") <= most)
    some = lambda c: F.min_by(c, F.when(F.size(c) > 0, F.col("seq"))).alias(c)
    none = F.array().cast("array<string>")
    box = F.when((F.col("chunk_type") == "infobox") & F.col("infobox").isNotNull(), F.col("seq"))
    sections = F.transform(F.array_sort(F.collect_list(F.struct("seq", "section", "chunk_type", "text"))), lambda s: F.struct(s["section"].alias("section"), s["chunk_type"].alias("chunk_type"), s["text"].alias("text")))
    found = first.groupBy("entity").agg(F.max_by("canonical_url", "seq").alias("canonical_url"), F.max_by("infobox", box).alias("infobox"), some("categories"), some("aliases"), sections.alias("sections"))
    return found.withColumns({c: F.coalesce(c, none) for c in ("categories", "aliases")})


def cards(entities: DataFrame, facts_table: DataFrame) -> DataFrame:
    """Entity cards with their facts; missing facts are empty."""
    known = facts_table.select("entity", "entity_type", *FIELDS)
    return entities.join(known, "entity", "left").select(*entities.columns, *(F.coalesce(c, F.lit("")).alias(c) for c in ("entity_type", *FIELDS)))


def matching(rows: DataFrame, query: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows in which every word of the query occurs in one of the columns, in any case."""
    words = query.lower().split()
    per_word = (reduce(lambda x, y: x | y, (F.coalesce(F.lower(c).contains(w), F.lit(False)) for c in columns)) for w in words)
    return rows.where(reduce(lambda x, y: x & y, per_word, F.lit(True)))


def timeline(chunks: DataFrame) -> DataFrame:
    """(seq, entity, section, text) to dated events; rows without any sign of time, text or entity go; the last of equal ids stays."""
    body, section, entity = tx.stripped(F.coalesce("text", F.lit(""))), tx.stripped(F.coalesce("section", F.lit(""))), tx.stripped(F.coalesce("entity", F.lit("")))
    rows = chunks.select("seq", entity.alias("entity"), section.alias("section"), body.alias("body")).where("entity <> '' and body <> ''")
    both = F.concat("section", F.lit(" "), "body")
    first = lambda word: F.get(routing.numbers(both, word), F.lit(0))
    relation = F.when(routing.has_word(both, routing.BEFORE), "before").when(routing.has_word(both, routing.AFTER), "after").otherwise("")
    rows = rows.select("seq", "entity", "section", F.left(F.regexp_replace("body", r"(?U)\s+", " "), F.lit(500)).alias("event_text"), first(routing.VOLUME).alias("volume"), first(routing.CHAPTER).alias("chapter"), relation.alias("relation"))
    rows = rows.where("volume is not null or chapter is not null or relation <> ''")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    rows = rows.withColumn("event_id", F.sha1(F.concat_ws("|", "entity", "section", text_of("volume"), text_of("chapter"), "event_text")))
    rows = rows.withColumn("confidence", F.when(F.col("volume").isNotNull() | F.col("chapter").isNotNull(), 0.85).otherwise(0.6))
    last = rows.groupBy("event_id").agg(F.max_by(F.struct("entity", "section", "event_text", "volume", "chapter", "relation", "confidence"), "seq").alias("e"))
    return last.select("event_id", "e.*")


def audit(rows: DataFrame) -> DataFrame:
    """One row of quality counts over (chunk_id, content_hash, entity, chunk_text, fetched_at)."""
    blank = lambda c: (tx.stripped(F.coalesce(F.col(c), F.lit(""))) == "").cast("long")
    empty = lambda c: (F.coalesce(F.col(c), F.lit("")) == "").cast("long")
    # Counted by hash first, so duplicates need no second pass.
    by_hash = rows.groupBy(F.nullif("content_hash", F.lit("")).alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(empty("chunk_id")).alias("chunk_id"), F.sum(empty("content_hash")).alias("content_hash"), F.sum(blank("entity")).alias("entity"), F.sum(blank("chunk_text")).alias("chunk_text"), F.max(F.nullif("fetched_at", F.lit(0.0))).alias("latest")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counts = by_hash.agg(
        total("n").alias("n_rows"), F.count("h").alias("n_hashes"), total(F.when(F.col("h").isNotNull() & (F.col("n") > 1), 1).otherwise(0)).alias("duplicate_groups"),
        *(total(c).alias(f"missing_{c}") for c in ("chunk_id", "content_hash", "entity", "chunk_text")), F.max("latest").alias("latest"),
    )
    return counts.withColumn("ok", F.expr("duplicate_groups + missing_chunk_id + missing_content_hash + missing_entity + missing_chunk_text = 0"))


def evaluation(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(mode, question, rank, id) and (question, id) to (mode, question, hit_1, hit_k, mrr)."""
    hits = results.join(expected, ["question", "id"]).groupBy("mode", "question").agg(F.min("rank").alias("best"))
    asked = expected.select("question").distinct().join(results.select("mode").distinct())
    joined = asked.join(hits, ["mode", "question"], "left")
    return joined.select("mode", "question", F.coalesce((F.col("best") <= 1).cast("double"), F.lit(0.0)).alias("hit_1"), F.coalesce((F.col("best") <= k).cast("double"), F.lit(0.0)).alias("hit_k"), F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("mrr"))


def summary(each: DataFrame, metrics: tuple[str, ...], new: str, old: str) -> DataFrame:
    """(mode, n, means of ``metrics``) of each mode, and a row ``delta``: those of ``new`` less those of ``old``."""
    means = each.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(m) for m in metrics))
    change = lambda m: F.sum(F.when(F.col("mode") == new, F.col(m)).when(F.col("mode") == old, -F.col(m))).alias(m)
    delta = means.agg(F.max(F.when(F.col("mode") == new, F.col("n"))).alias("n"), *map(change, metrics)).where("n is not null").select(F.lit("delta").alias("mode"), "n", *metrics)
    return means.unionByName(delta).select("mode", "n", *(F.round(m, 6).alias(m) for m in metrics))


def keyword_recall(answer: Column, keywords: Column) -> Column:
    found = F.size(F.filter(keywords, lambda w: F.lower(answer).contains(F.lower(w))))
    return F.when(F.size(keywords) == 0, 1.0).otherwise(found / F.size(keywords))
