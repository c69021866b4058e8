"""Splitting texts into overlapping chunks of whole sentences, as expressions and SQL folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.functions import text as tx

_STATE = "struct<done:array<string>,now:array<struct<s:string,n:int>>,size:int>"


def fold(text: Column, most: int = 800, share: float = 0.15) -> Column:
    """Chunks of a text: sentences are added while their token estimates fit ``most``.

    A chunk that is full is closed, and the next one begins with the closed one's last sentences that fit ``most *
    share`` tokens. A sentence is never split. The state holds one document's sentences, nothing else.
    """
    overlap = int(most * share)
    sized = F.transform(tx.sentences(text), lambda s: F.struct(s.alias("s"), tx.token_estimate(s).alias("n")))
    joined = lambda part: F.array_join(F.transform(part, lambda x: x["s"]), " ")

    def tail(part: Column) -> Column:
        """The longest run at the end that fits the overlap: (sentences, open, size)."""
        start = F.struct(F.array().cast("array<struct<s:string,n:int>>").alias("got"), F.lit(True).alias("open"), F.lit(0).alias("size"))

        def add(acc: Column, x: Column) -> Column:
            fits = acc["open"] & (acc["size"] + x["n"] <= overlap)
            return F.struct(F.when(fits, F.concat(F.array(x), acc["got"])).otherwise(acc["got"]).alias("got"), fits.alias("open"), F.when(fits, acc["size"] + x["n"]).otherwise(acc["size"]).alias("size"))

        return F.aggregate(F.reverse(part), start, add)

    def step(state: Column, x: Column) -> Column:
        full = (state["size"] + x["n"] > most) & (F.size(state["now"]) > 0)
        kept = tail(state["now"])
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(joined(state["now"])))).otherwise(state["done"]).alias("done"),
            F.concat(F.when(full, kept["got"]).otherwise(state["now"]), F.array(x)).alias("now"),
            (F.when(full, kept["size"]).otherwise(state["size"]) + x["n"]).alias("size"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<struct<s:string,n:int>>").alias("now"), F.lit(0).alias("size")).cast(_STATE)
    return F.aggregate(sized, start, step, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(joined(s["now"])))).otherwise(s["done"]))


def header(entity: Column, aliases: Column, section: Column, categories: Column) -> Column:
    """The line put in front of a chunk: up to five aliases, up to six categories."""
    some = lambda c, n, none: F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, n), ", ")).otherwise(none)
    return F.concat(F.lit("Entity: "), entity, F.lit(" | Aliases: "), some(aliases, 5, "None"), F.lit(" | Section: "), section, F.lit(" | Categories: "), some(categories, 6, "General"), F.lit("\n"))


def chunk(pages: DataFrame, most: int = 800) -> DataFrame:
    """(entity, section, text) and any other columns, to one row a chunk with index, chunk_id and content_hash."""
    rows = pages.select(*pages.columns, F.posexplode(fold(F.col("text"), most)).alias("idx", "chunk_text"))
    return rows.withColumn("content_hash", tx.content_hash(F.col("chunk_text"))).withColumn("chunk_id", tx.chunk_id(F.col("entity"), F.col("section"), F.col("idx"), F.col("chunk_text")))
