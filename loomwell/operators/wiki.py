"""Wiki pages: infobox, sections with breadcrumbs, links, and the graph edges that a page tells of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.functions import text as tx
from loomwell.functions import wikitext
from loomwell.operators import chunking

#: An edge's confidence by relation.
CONFIDENCE = {"species_of": 1.0, "has_title": 1.0, "disciple_of": 0.9, "subordinate_of": 0.9, "affiliated_with": 0.95, "associated_with": 0.7}
#: Typed fields of an infobox with the keys that they are read from, in the order of a fact sheet.
SINGLE = {
    "name": ("name", "title", "kanji_name"), "kanji": ("kanji",), "romaji": ("romaji",), "species": ("species", "race", "evolution"), "gender": ("gender",), "age": ("age",),
    "status": ("status",), "country": ("country", "base", "origin"), "rank": ("rank", "drank", "arank"),
    "first_appearance": ("light", "manga", "anime", "web", "first_appearance"), "image_url": ("image", "image1"),
}
MANY = {
    "aliases": ("alias", "aliases", "fnames"), "affiliation": ("affiliation", "faffiliation"), "occupation": ("occupations", "occupation", "class"),
    "titles": ("titles", "ftitles"), "family": ("family", "relatives"),
}
SHEET = ("name", "kanji", "romaji", "aliases", "species", "gender", "age", "status", "country", "affiliation", "occupation", "titles", "family", "rank", "first_appearance", "image_url")


def typed(fields: Column) -> dict[str, Column]:
    """The typed fields of an infobox map: text, or an array for a list field; the first key that is there counts."""
    first = lambda keys: F.coalesce(*(F.try_element_at(fields, F.lit(k)) for k in keys))
    none = F.array().cast("array<string>")
    return {n: first(k) for n, k in SINGLE.items()} | {n: F.coalesce(tx.multivalue(first(k)), none) for n, k in MANY.items()}


def fact_sheet(fields: Column) -> Column:
    """Lines "Key: value" of the typed fields that have values, then of the other fields; lists as "a, b"."""
    title = lambda k: F.concat(F.upper(F.left(k, F.lit(1))), F.lower(F.substring(k, 2, 1 << 30)))
    of, lines, known = typed(fields), [], []
    for name in SHEET:
        value = F.array_join(of[name], ", ") if name in MANY else of[name]
        lines.append(F.when(value != "", F.concat(title(F.lit(name)), F.lit(": "), value)))
        known.append(F.lit(name) if name in MANY else F.when(of[name].isNotNull(), F.lit(name)))
    others = F.transform(F.filter(F.map_entries(fields), lambda e: ~F.array_contains(F.array_compact(F.array(*known)), e["key"])), lambda e: F.concat(title(e["key"]), F.lit(": "), e["value"]))
    return F.array_join(F.concat(F.array_compact(F.array(*lines)), others), "\n")


def parse_pages(pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """(title, raw_text, ...) and (canonical, aliases) to the same with infobox, aliases, lead, sections, links and error.

    Pages without text go. Aliases are those of redirects, then those of the infobox, each once. ``error`` says why a
    page could not be read, as ``pages`` tells (a record that is none) or the parser; see ``quarantined``.
    """
    known = aliases.select(F.col("canonical").alias("title"), F.col("aliases").alias("_known"))
    told = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    rows = pages.where(tx.stripped(F.coalesce("raw_text", F.lit(""))) != "").join(known, "title", "left").withColumn("_told", told)
    # One call a page; what follows takes its fields.
    rows = rows.withColumn("_page", wikitext.parsed(F.when(F.col("_told").isNull(), F.col("raw_text"))))
    rows = rows.withColumn("infobox", wikitext.fields_map(F.col("_page")))
    own = F.coalesce("_known", F.array().cast("array<string>"))
    rows = rows.withColumn("aliases", F.array_distinct(F.concat(own, typed(F.col("infobox"))["aliases"])))
    read = {c: F.col(f"_page.{c}") for c in ("lead", "sections", "links")}
    return rows.withColumns(read | {"error": F.coalesce("_told", "_page.error")}).drop("_page", "_known", "_told")


def quarantined(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages that were read, and (title, page_id, error, raw_text) of those that could not be."""
    return parsed.where("error is null").drop("error"), parsed.where("error is not null").select("title", "page_id", "error", "raw_text")


def chunk_pages(parsed: DataFrame, most: int = 800) -> DataFrame:
    """One row a chunk of parsed pages: the infobox's fact sheet, the lead, and the sections, all in one pass."""
    piece = lambda kind, section, place, text: F.struct(F.lit(kind).alias("chunk_type"), section.alias("section"), place.alias("idx"), text.alias("raw"))
    none = F.array().cast("array<struct<chunk_type:string,section:string,idx:int,raw:string>>")
    sheet = F.when(F.size("infobox") > 0, F.array(piece("infobox", F.lit("Infobox"), F.lit(0), fact_sheet(F.col("infobox"))))).otherwise(none)
    texts = F.concat(F.array(F.struct(F.lit("Introduction").alias("path"), F.col("lead").alias("content"))), F.transform("sections", lambda s: F.struct(s["path"].alias("path"), s["content"].alias("content"))))
    cut = F.flatten(F.transform(texts, lambda t: F.transform(chunking.fold(t["content"], most), lambda c, i: piece("text", t["path"], i, c))))
    rows = parsed.withColumn("_piece", F.explode(F.concat(sheet, cut)))
    rows = rows.select(*parsed.columns, "_piece.*")
    shown = F.when(F.col("chunk_type") == "infobox", "Infobox & Overview").otherwise(F.col("section"))
    body = F.when(F.col("chunk_type") == "infobox", F.concat(F.lit("[INFOBOX FACT SHEET]\n"), F.col("raw"))).otherwise(F.col("raw"))
    rows = rows.withColumn("chunk_text", tx.stripped(F.concat(chunking.header(F.col("title"), F.col("aliases"), shown, F.col("categories")), F.lit("\n"), body)))
    hashed = rows.withColumn("content_hash", tx.content_hash(F.col("chunk_text")))
    return hashed.withColumn("chunk_id", tx.chunk_id(F.col("title"), F.col("section"), F.col("idx"), F.col("chunk_text"))).drop("infobox", "lead", "sections", "links", "raw_text", "error")


def split_values(c: Column) -> Column:
    """Names of a list field: no brackets, quotes or bullets around, more than one character, no addresses."""
    parts = F.transform(F.split(c, r"[,;\n•]|<br\s*/?>"), lambda x: F.regexp_replace(x, r"^[ \[\]{}*\"']+|[ \[\]{}*\"']+$", ""))
    return F.filter(parts, lambda x: (F.length(x) > 1) & ~x.startswith("http"))


def page_edges(pages: DataFrame) -> DataFrame:
    """(source, target, relation, confidence) of (entity, species, titles, fields map, lead, links); each triple once."""

    def edges(rows: DataFrame, source: Column, target: Column, relation: str | Column) -> DataFrame:
        kind = F.lit(relation) if isinstance(relation, str) else relation
        return rows.select(source.alias("source"), target.alias("target"), kind.alias("relation"))

    key = F.lower("key")
    has = lambda *words: reduce(lambda x, y: x | y, (key.contains(w) for w in words))
    kind = F.when(has("master", "teacher", "mentor"), "disciple_of").when(has("subordinate", "servant"), "subordinate_of").when(has("country", "nation", "affiliation"), "affiliated_with")
    fields = pages.select("entity", F.explode("fields").alias("key", "value")).select("entity", kind.alias("relation"), F.explode(split_values(F.col("value"))).alias("name")).where("relation is not null")
    back = F.col("relation") == "subordinate_of"
    linked = pages.where(F.coalesce("lead", F.lit("")) != "").select("entity", F.explode(F.slice("links", 1, 15)).alias("link"))
    linked = linked.where((F.col("link") != F.col("entity")) & ~F.col("link").rlike("^(File|Category):"))
    out = edges(pages.where(F.coalesce("species", F.lit("")) != ""), F.col("entity"), F.col("species"), "species_of")
    out = out.unionByName(edges(pages.select("entity", F.explode("titles").alias("title")), F.col("entity"), F.col("title"), "has_title"))
    out = out.unionByName(edges(fields, F.when(back, F.col("name")).otherwise(F.col("entity")), F.when(back, F.col("entity")).otherwise(F.col("name")), F.col("relation")))
    out = out.unionByName(edges(linked, F.col("entity"), F.col("link"), "associated_with"))
    confidence = F.create_map(*(F.lit(x) for pair in CONFIDENCE.items() for x in pair))
    return out.distinct().withColumn("confidence", confidence[F.col("relation")])
