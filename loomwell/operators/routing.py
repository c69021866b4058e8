"""What a question is about: language, archetype, aliases, times."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import tables
from loomwell.functions.text import LEFT, RIGHT, contains_any

# The words of each archetype, tested in this order of archetypes.
COMPARATIVE = ("เปรียบเทียบ", "เก่งกว่า", "ใครชนะ", "แกร่งกว่า", "ต่างกันยังไง", "compare", "versus", " vs ", "stronger than", "who wins", "difference between")
RELATIONAL = ("ความสัมพันธ์", "เป็นอะไรกับ", "เกี่ยวข้องกับ", "ลูกน้อง", "อาจารย์", "คู่หู", "เพื่อน", "relationship", "related to", "subordinate", "master", "partner", "friend", "ally", "connection")
TIMELINE = ("เล่มที่", "ตอนที่", "ช่วงไหน", "ภาค", "วิวัฒนาการตอน", "volume", "chapter", "episode", "season", "arc", "when did", "timeline")
FACTUAL = (
    "เผ่า", "อายุ", "เพศ", "สถานะ", "ฉายา", "ตำแหน่ง", "คันจิ", "ส่วนสูง", "แรงค์", "คือตัวอะไร", "ใครคือ",
    "species", "race", "gender", "age", "status", "title", "titles", "rank", "kanji", "height", "who is", "what is",
)
ARCHETYPES = (("comparative", COMPARATIVE), ("relational", RELATIONAL), ("timeline", TIMELINE), ("factual", FACTUAL))
# Words that mark times.
VOLUME, CHAPTER = r"(?:volume|vol\.?|เล่ม)", r"(?:chapter|ch\.?|ตอนที่)"
BEFORE, AFTER = r"(?:before|prior to|earlier|ก่อน|ก่อนหน้า)", r"(?:after|later|following|หลัง|ภายหลัง|ต่อมา)"
BEFORE_OR_AFTER = r"(?:before|after|ก่อน|หลัง|ภายหลัง|ต่อมา)"
SPACE = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]*"


def language(c: Column) -> Column:
    return F.when(c.rlike(r"[\u0E00-\u0E7F]"), "th").otherwise("en")


def archetype(c: Column) -> Column:
    low, out = F.lower(c), None
    for name, words in ARCHETYPES:
        hit = contains_any(low, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def numbers(c: Column, word: str) -> Column:
    """All numbers after ``word``, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"(?iu){LEFT}{word}{SPACE}([0-9]+)"), 1), lambda x: x.try_cast("bigint"))


def has_word(c: Column, words: str) -> Column:
    return c.rlike(f"(?iu){LEFT}{words}{RIGHT}")


def alias_map(redirects: DataFrame) -> DataFrame:
    """(canonical, aliases) from (seq, alias, target): an alias belongs to its last target, aliases in first-seen order."""
    last = redirects.groupBy("alias").agg(F.max_by("target", "seq").alias("canonical"), F.min("seq").alias("seq"))
    return last.groupBy("canonical").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "alias"))), lambda x: x["alias"]).alias("aliases"))


#: Characters of aliases that one automaton holds.
MOST_CHARS = 4_000_000


def mentions(questions: DataFrame, aliases: DataFrame, least: int = 3) -> DataFrame:
    """(q_id, seq, canonical): the aliases of ``least`` characters or more that each question holds, in any case.

    The aliases become an Aho-Corasick automaton, made once in each worker, and a question is walked once however many
    aliases there are or begin alike. Where they have more than ``MOST_CHARS`` characters, which are counted, they are
    parted by hash, and each part is one pass over the questions.
    """
    spark = questions.sparkSession
    low = aliases.select("seq", F.lower("alias").alias("low"), "canonical").where((F.length("alias") >= least) & F.col("canonical").isNotNull())
    first = low.groupBy("low", "canonical").agg(F.min("seq").alias("seq"))
    size = first.agg(F.sum(F.length("low") + F.length("canonical"))).first()[0] or 0
    parts, asked, out = max(1, -(-size // MOST_CHARS)), questions.select("q_id", F.lower("q").alias("low")).where("low is not null"), None
    numbered = tables.written(first.withColumn("part", F.pmod(F.xxhash64("low"), F.lit(parts)).cast("int")))
    kind = questions.schema["q_id"].dataType.simpleString()
    for part in range(parts):
        named = numbered.where(F.col("part") == part).drop("part").toArrow()
        found = asked.mapInArrow(_walk(spark.sparkContext.broadcast(named)), f"q_id {kind}, seq long, canonical string")
        out = found if out is None else out.unionByName(found)
    return out


#: The automaton that a worker keeps, by its broadcast's number.
_KEPT: dict = {}


def _automaton(named: Broadcast, number: int):
    """The automaton of a broadcast table of aliases, or None if it has none."""
    import ahocorasick

    if number not in _KEPT:
        made, rows = ahocorasick.Automaton(), {}
        for low, canonical, seq in zip(*(named.value.column(c).to_pylist() for c in ("low", "canonical", "seq"))):
            rows.setdefault(low, []).append((seq, canonical))
        for low, those in rows.items():
            made.add_word(low, those)
        made.make_automaton()
        _KEPT.clear()
        _KEPT[number] = made if rows else None
    return _KEPT[number]


def _walk(named: Broadcast):
    number = named._jbroadcast.id()

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(named, number)
        for batch in found:
            rows: list[tuple] = []
            for i, low in enumerate(batch.column("low").to_pylist() if machine is not None else ()):
                rows += [(i, *row) for row in {row for _, those in machine.iter(low) for row in those}]
            at, seq, canonical = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([batch.column("q_id").take(pa.array(at, pa.int64())), pa.array(seq, pa.int64()), pa.array(canonical, pa.string())], names=["q_id", "seq", "canonical"])

    return batches


def expand(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(q_id, q) with ``expanded`` and ``matched``; ``aliases`` is (seq, alias, canonical), an entity's own name among them.

    Entities are matched in the order of their first alias in the question, each once. For each that has aliases beside
    its own name, the first three of them are added to the question.
    """
    others = aliases.where(F.lower("alias") != F.lower("canonical"))
    place = F.row_number().over(Window.partitionBy("canonical").orderBy("seq", "alias"))
    three = others.withColumn("n", place).where(F.col("n") <= 3).groupBy("canonical").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "alias"))), lambda x: x["alias"]).alias("names"))
    each = mentions(questions, aliases).groupBy("q_id", "canonical").agg(F.min("seq").alias("seq")).join(three, "canonical", "left")
    told = each.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("seq", "canonical", "names"))).alias("told"))
    named = questions.join(told, "q_id", "left")
    added = F.transform(F.filter("told", lambda t: t["names"].isNotNull()), lambda t: F.concat(F.lit(" (also known as: "), F.array_join(t["names"], ", "), F.lit(")")))
    return named.select(*questions.columns, F.transform("told", lambda t: t["canonical"]).alias("matched"), F.concat("q", F.coalesce(F.array_join(added, ""), F.lit(""))).alias("expanded"))
