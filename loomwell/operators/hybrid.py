"""The whole retrieval of a question: routing, expansion, four ranked lists, fusion, promotion and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import tables
from loomwell.functions import vector as vx
from loomwell.operators import graph, lexical, metric, routing
from loomwell.operators import retrieval as rt

#: Related names of a question: of so many matched entities, so many each, so many in all.
MATCHED, EACH, NAMES = 8, 12, 24
#: Fused rows that are sent to the chunks; more meet them by a shuffle.
SENT = 100_000


@dataclass(frozen=True)
class Corpus:
    """What is searched: chunks (id, chunk_type, text and what filters name), their vectors and texts, as indexes or, for one
    search, without, aliases (seq, alias, canonical), graph edges, and ``embed``, from a text to its vector."""

    chunks: DataFrame
    vectors: metric.MetricIndex | metric.Unindexed
    index: lexical.LexicalIndex | lexical.Unindexed
    aliases: DataFrame
    edges: DataFrame
    embed: Callable[[Column], Column]
    searched: tuple[str, ...] = ("text",)


def understood(questions: DataFrame, corpus: Corpus) -> DataFrame:
    """(q_id, q) with expanded form, named and related entities, archetype and language."""
    told = routing.expand(questions, corpus.aliases).withColumn("matched", F.coalesce("matched", F.array().cast("array<string>")))
    told = tables.written(told.withColumn("archetype", routing.archetype(F.col("q"))).withColumn("language", routing.language(F.col("q"))))
    named = told.select("q_id", F.posexplode(F.slice("matched", 1, MATCHED)).alias("pos", "node"))
    related = graph.neighbours_of(corpus.edges, named, EACH, NAMES).groupBy("q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "other"))), lambda x: x["other"]).alias("related"))
    return tables.written(told.join(related, "q_id", "left").withColumn("related", F.coalesce("related", F.array().cast("array<string>"))))


def temporal(text: Column) -> Column:
    """What a chunk says about its time: volumes, chapters, and whether it names a before or after."""
    c = F.coalesce(text, F.lit(""))
    return F.struct(
        routing.numbers(c, routing.VOLUME).alias("volumes"), routing.numbers(c, routing.CHAPTER).alias("chapters"), routing.has_word(c, routing.BEFORE_OR_AFTER).alias("has_relation")
    )


def lists(corpus: Corpus, told: DataFrame, k: int, filters: dict | None = None, expand: bool = True, use_lexical: bool = True) -> DataFrame:
    """(q_id, leg, rank, id, score) of understood questions: 1 nearest vectors, 2 lexical, 3 lexical by the names of graph
    neighbours of the entities that are named (also without list 2), 4 structured terms."""
    n = rt.candidates(k)
    asked = told.select("q_id", (F.col("expanded") if expand else F.col("q")).alias("q"))
    chosen = corpus.chunks.where(rt.equal_to(filters or {}))
    allowed = chosen.select(F.col("id").alias("doc")) if filters else None
    leg = lambda rows, number, score: rows.select("q_id", F.lit(number).alias("leg"), "rank", F.col("doc").alias("id"), score.cast("double").alias("score"))
    near = metric.search(corpus.vectors, asked.select("q_id", corpus.embed(F.col("q")).alias("q")), n, allowed).withColumnRenamed("id", "doc")
    # Lists 2 and 3 of all questions are one search.
    words = told.where(F.size("related") > 0).select(F.struct("q_id", F.lit(3).alias("leg")).alias("q_id"), F.array_join("related", " ").alias("q"))
    if use_lexical:
        words = words.unionByName(asked.select(F.struct("q_id", F.lit(2).alias("leg")).alias("q_id"), "q"))
    found = lexical.search(corpus.index, words, n, allowed)
    found = found.select(F.col("q_id.q_id").alias("q_id"), F.col("q_id.leg").alias("leg"), "rank", F.col("doc").alias("id"), "score")
    terms = leg(rt.term_scores(chosen, asked, list(corpus.searched), n, "id"), 4, F.col("score"))
    return tables.written(leg(near, 1, 1 / (1 + F.col("distance"))).unionByName(found).unionByName(terms))


def placed(corpus: Corpus, told: DataFrame, legs: DataFrame, k: int, scorer: Callable | None = None) -> DataFrame:
    """The ``k`` best chunks of fused lists for each question, with what is known of question and chunk."""
    fused = tables.sent_if_few(tables.written(rt.fuse_each(legs, rt.candidates(k))), SENT)
    rows = corpus.chunks.select("id", "chunk_type", "text").join(fused, "id").join(told.select("q_id", "q", "archetype", "language", "matched", "related"), "q_id")
    late = (F.col("archetype") == "factual") & (F.col("chunk_type") != "infobox")
    found = rows.withColumn("place", F.row_number().over(Window.partitionBy("q_id").orderBy(late, "fused")))
    if scorer is not None:
        scored = rerank(found, F.col("q"), "text", scorer)
        found = scored.withColumn("place", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("rerank"), "place")))
    best = found.where(F.col("place") <= k).withColumn("temporal", temporal(F.col("text")))
    return best.select("q_id", "place", "id", "chunk_type", "rrf", "first_leg", "first_rank", "raw_score", "archetype", "language", "matched", "related", "temporal")


def retrieve(
    corpus: Corpus, questions: DataFrame, k: int, filters: dict | None = None, expand: bool = True, use_lexical: bool = True, scorer: Callable | None = None
) -> DataFrame:
    """The ``k`` best chunks for each question (q_id, q): (q_id, place, id, chunk_type, rrf, first_leg, first_rank, raw_score)
    and what is known of question and chunk (archetype, language, matched, related, temporal).

    All questions go through one plan. Only a factual question puts infobox chunks first. With a ``scorer``, see
    ``rerank``, the fused candidates are ordered by it.
    """
    told = understood(questions, corpus)
    return placed(corpus, told, lists(corpus, told, k, filters, expand, use_lexical), k, scorer)


def rerank(rows: DataFrame, question: Column | str, text: str, scorer: Callable[[], Callable[[str, list[str]], list[float]]]) -> DataFrame:
    """``rows`` with ``rerank``, the score that a user's model gives a pair of question and text.

    ``scorer`` makes the model, once in each worker; the model scores a question's texts of a batch at once.
    """

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = scorer()
        for asked, texts in parts:
            out = pd.Series(0.0, index=texts.index)
            for q, mine in texts.groupby(asked, sort=False):
                out[mine.index] = list(map(float, model(q, [t or "" for t in mine])))
            yield out

    return rows.withColumn("rerank", score(F.lit(question) if isinstance(question, str) else question, F.col(text)))


def embed_texts(rows: DataFrame, text: str, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], cache: DataFrame | None = None) -> DataFrame:
    """``rows`` (with content_hash) with ``embedding``, of length 1, by a user's model; texts with a cached vector are not encoded;
    rows without a hash are encoded each.

    ``encoder`` makes the model, once in each worker; the model encodes a batch of texts. Equal hashes are encoded once.
    """

    @F.pandas_udf("array<double>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for part in parts:
            yield pd.Series([list(map(float, v)) for v in model([t or "" for t in part])])

    hashed, bare = rows.where("content_hash is not null"), rows.where("content_hash is null")
    texts = hashed.groupBy("content_hash").agg(F.first(text).alias("_text"))
    known = cache.select("content_hash", "embedding") if cache is not None else None
    new = (texts if known is None else texts.join(known, "content_hash", "left_anti")).select("content_hash", encode("_text").alias("_v"))
    made = new.select("content_hash", vx.normalised(F.col("_v")).alias("embedding"))
    vectors = made if known is None else made.unionByName(known)
    own = bare.withColumn("_v", encode(text)).withColumn("embedding", vx.normalised(F.col("_v"))).drop("_v")
    return hashed.join(vectors, "content_hash", "left").unionByName(own)
