"""Around an answer: prompt and citations, the check of an answer, and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the score that the best source must have.
LEAST_SCORE = 0.35


def prompt(sources: DataFrame) -> DataFrame:
    """(citation, title, snippet, score) of a bounded result list to one row: numbered blocks, their number, the check."""
    block = F.concat(F.lit("["), F.col("citation").cast("string"), F.lit("] "), "title", F.lit("\n"), "snippet")
    blocks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("citation", block.alias("b")))), lambda x: x["b"]), "\n\n")
    return sources.agg(blocks.alias("prompt"), F.count(F.lit(1)).alias("n"), F.coalesce(F.max("score") >= LEAST_SCORE, F.lit(False)).alias("confident"))


#: What a checker may be asked to look at, by name.
CHECKS = {
    "numbers": "ตัวเลขและวันที่", "names": "ชื่อบุคคล สถานที่ และชื่อเฉพาะ", "skill_ranks": "ระดับและชื่อสกิล/อาวุธ",
    "relationships": "ความสัมพันธ์และสังกัด", "citations": "การอ้างอิงแหล่งข้อมูล", "unsupported": "ข้อความที่ไม่มีหลักฐานรองรับ",
}
GENERAL = "ความสอดคล้องทั่วไป"


def checker_sources(sources: Column) -> Column:
    """Numbered lines of an array of (entity, section, snippet)."""
    or_else = lambda c, other: F.coalesce(c, F.lit(other))
    line = lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), or_else(s["entity"], "Unknown"), F.lit(" / "), or_else(s["section"], "General"), F.lit(": "), or_else(s["snippet"], ""))
    return F.array_join(F.transform(sources, line), "\n")


def checker_prompt(question: Column, answer: Column, sources: Column, checks: list[str], instructions: str) -> Column:
    """The text that a checking model gets: a caller's instructions, the named checks, question, answer and sources."""
    named = ", ".join(CHECKS[c] for c in CHECKS if c in checks) or GENERAL
    return F.concat(F.lit(f"{instructions}\n{named}\n\n"), question, F.lit("\n"), answer, F.lit("\nSources:\n"), checker_sources(sources))


#: Fixed value: the line that names the source and its license.
ATTRIBUTION = "\n\n---\n*Content derived from {title} ({url}) under {license} license.*"


def attributed(answer: Column, title: str, url: str, license: str) -> Column:
    """The answer with its source's title, address and license below."""
    return F.concat(answer, F.lit(ATTRIBUTION.format(title=title, url=url, license=license)))


def data_version(project: str, n_chunks: Column, changed: Column) -> Column:
    return F.concat_ws("-", F.lit(project), n_chunks.cast("string"), changed.cast("string"))


def verification(answer: Column) -> Column:
    """A checker's JSON answer, code fences taken off; text that is no such JSON becomes the summary, 1000 characters of it."""
    plain = F.regexp_replace(F.regexp_replace(answer, r"^\s*```(?:json)?\s*|\s*```\s*$", ""), r"^\s+|\s+$", "")
    kind = "struct<verdict:string,summary:string>"
    read = F.from_json(plain, kind)
    usable = read.isNotNull() & plain.startswith("{") & read["verdict"].isNotNull()
    return F.when(usable, read).otherwise(F.struct(F.lit("unverified").alias("verdict"), F.left(plain, F.lit(1000)).alias("summary")))


def settings(rows: DataFrame, project: str) -> DataFrame:
    """(key, value) from (key, scope, project, value): a project's value before the global one; secrets are left out."""
    mine = rows.where((F.col("scope") == "global") | (F.col("project") == project)).where(~F.lower("key").rlike("api_key|secret|token|password"))
    best = Window.partitionBy("key").orderBy(F.col("scope") == "global", "value")
    return mine.withColumn("n", F.row_number().over(best)).where("n = 1").select("key", "value")
