"""Queries on odd tables, and their steps on what large tables bring."""

import duckdb
import pytest
from pyspark.sql import functions as F

from loomwell.plans import catalog
from tests.conftest import same_rows


def with_tables(spark, folder, **tables):
    """A folder of tables, and a DuckDB connection that sees them."""
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


def test_wikitext_clean_shows_titles_as_they_are(spark, tmp_path):
    titles = ["Pour. token = &quot;7702344ead3", "a=b=c", "it''s '''so'''", "### que&amp;&amp; x", "; x: y", " : &lt;b&gt; &amp;lt; &amp", "- # x &#42;", "plain", "", None]
    pages = [(i, f"<html><title>{t}</title>" if t is not None else None) for i, t in enumerate(titles)]
    con = with_tables(spark, tmp_path, pages=(pages, "page_id long, html string"))
    assert same_rows(catalog.queries()["wikitext_clean"](spark, str(tmp_path)), con, catalog.oracle_sql()["wikitext_clean"]) == len(titles)


def test_index_blocks_are_made_in_their_task(spark, monkeypatch):
    """Postings are packed before they are shuffled: a task's documents give a row for each term and block."""
    from collections import Counter

    import pyarrow as pa

    from loomwell.operators import lexical

    texts = {i * 7 % 101: ["the"] * (i % 9) + [f"w{i % 13}", "x"] * (i % 4) for i in range(101)}
    batches = pa.table({"doc": list(texts), "t": pa.array(list(texts.values()), pa.list_(pa.string()))}).to_batches(max_chunksize=40)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 5)
    monkeypatch.setattr(lexical, "STEP_DOCS", 16)
    for most in (100, 1 << 22):
        monkeypatch.setattr(lexical, "MOST_TOKENS", most)
        rows = [r for b in lexical._packed(iter(batches)) for r in b.to_pylist()]
        got = {(r["term"], d): (tf, n) for r in rows for d, tf, n in zip(r["docs"], r["tfs"], r["lengths"])}
        assert got == {(t, d): (c, len(ts)) for d, ts in texts.items() for t, c in (Counter(ts) | {lexical.ANY: 1}).items()}
        assert len({(r["term"], r["block"]) for r in rows}) == len(rows) < len(got)
        for r in rows:
            assert r["docs"] == sorted(r["docs"]) and (r["df"], r["most"], r["least"]) == (len(r["docs"]), max(r["tfs"]), min(r["lengths"])) and r["df"] <= 5
            assert max(r["lengths"]) <= 1.2 * (r["least"] + 1)
        in_block = {}
        for r in rows:
            in_block.setdefault(r["block"], set()).update(r["docs"])
        assert sum(map(len, in_block.values())) == len(texts)


def test_terms_of_many_questions_in_one_pass(spark, monkeypatch):
    from loomwell.operators import retrieval

    rows = [(i, "ab"[i % 2], " ".join(f"W{i * j % 17}" for j in range(i % 11)) if i % 10 else None) for i in range(300)]
    asked = [(q, f"w{q % 17} W1 w1  a {'xyz' * (q % 3)}" if q % 50 else None) for q in range(700)]
    docs, queries = spark.createDataFrame(rows, "id long, kind string, text string").repartition(3), spark.createDataFrame(asked, "q_id long, q string")
    want = {}
    for q, text in asked:
        words = [w for w in (text or "").lower().split() if len(w) >= 2]
        scores = [(-sum(w in " ".join(x for x in (kind, body) if x is not None).lower() for w in words), i) for i, kind, body in rows]
        want |= {(q, n): (i, -s) for n, (s, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:7], 1)}
    for most in (1_000_000, 3000):
        monkeypatch.setattr(retrieval, "MOST_CHARS", most, raising=False)
        found = retrieval.term_scores(docs, queries, ["kind", "text"], 7, "id")
        assert {(r["q_id"], r["rank"]): (r["doc"], r["score"]) for r in found.collect()} == want
        if most == 1_000_000:
            assert found._jdf.queryExecution().optimizedPlan().toString().count("Repartition 3") == 1


def test_nearest_rows_meet_in_groups(spark, monkeypatch):
    """Zones and slices, large groups of copies, and queries without a vector or with one of another length."""
    import numpy as np

    from loomwell.operators import metric

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((700, 8)), np.tile(rng.standard_normal((3, 8)), (200, 1))]).astype(np.float32)
    for name, value in (("CELL_ROWS", 60), ("PART_ROWS", 150), ("SLICE", 30), ("SIDE_BY_SIDE", 7), ("PAIRS", 50)):
        monkeypatch.setattr(metric, name, value, raising=False)
    index = metric.build(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
    asked = [(i, x[i * 11].tolist()) for i in range(110)] + [(500, None), (501, [1.0])]
    got = {(r["q_id"], r["rank"]): (r["id"], r["distance"]) for r in metric.search(index, spark.createDataFrame(asked, "q_id long, q array<float>"), 9).collect()}
    want = {}
    for q, v in asked[:110]:
        d = np.cumsum((x.astype(float) - np.array(v, dtype=np.float32).astype(float)) ** 2, axis=1)[:, -1]
        want |= {(q, n + 1): (int(i), float(d[i])) for n, i in enumerate(np.lexsort((np.arange(len(x)), d))[:9])}
    assert got == want
    # Some cells share a zone; no zone has many more rows than a part.
    zone = F.get(F.array(*map(F.lit, index.zones)), F.col("cell")) + F.col("part")
    sizes = index.rows.groupBy(zone).count().collect()
    assert len(sizes) < len(set((r["cell"], r["part"]) for r in index.rows.select("cell", "part").collect())) and max(r["count"] for r in sizes) < 3 * 150


@pytest.mark.parametrize("pushed, sent", [(1000, 1000), (2, 1000), (2, 2)])
def test_one_search_moves_the_edges_it_meets(spark, monkeypatch, pushed, sent):
    """Searches without an index give what those with one give, by pushed names, by a semi-join and by an index made late."""
    import random

    from loomwell.operators import graph

    rng = random.Random(8)
    rows = [(e * 11 % 500, f"n{rng.randrange(40)}", f"n{rng.choice([rng.randrange(40), 0])}", "rs"[e % 2], 1.0) for e in range(150)] + [(900, "n3", "n3", "r", 1.0), (901, "far", "away", "r", 1.0)]
    edges = graph.upserted(spark.createDataFrame(rows, "seq long, source string, target string, relation string, confidence double"))
    index, made = graph.adjacency(edges), []
    monkeypatch.setattr(graph, "PUSHED", pushed)
    monkeypatch.setattr(graph, "SENT", sent, raising=False)
    build = graph.adjacency
    monkeypatch.setattr(graph, "adjacency", lambda e: made.append(1) or build(e))
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    for a, b in (("n5", "n30"), ("n2", "away")):
        assert rows_of(graph.shortest_path(edges, a, b)) == rows_of(graph.shortest_path(index, a, b))
    for mine, other in zip(graph.subgraph(edges, "n7", 3, 25, 4, "r"), graph.subgraph(index, "n7", 3, 25, 4, "r")):
        assert rows_of(mine) == rows_of(other)
    assert bool(made) == (sent == 2)


def test_both_ways_reads_edges_once(spark):
    from loomwell.operators import graph

    rows = [(1, "a", "b", "r", 1.0), (2, "a", "a", "r", 1.0), (3, "c", None, "r", 1.0)]
    edges = graph.upserted(spark.createDataFrame(rows, "seq long, source string, target string, relation string, confidence double"))
    both = graph.both_ways(edges)
    assert {tuple(r) for r in both.collect()} == {("a", "b", 1, "a", "b", "r"), ("b", "a", 1, "a", "b", "r"), ("a", "a", 2, "a", "a", "r"), ("c", None, 3, "c", None, "r")}
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_parser_holds_few_pages(spark, monkeypatch):
    """Pages become Arrow rows some at a time, and queries give the parser batches of few bytes."""
    import pyarrow as pa

    from loomwell.functions import tables, wikitext

    sources = [f"lead [[a{i}]]\n== Part ==\n  text {i}" if i % 9 else None for i in range(300)]
    sizes, rows = [], pa.array

    class Watched:
        array = staticmethod(lambda x, kind=None: sizes.append(len(x)) or rows(x, kind))
        concat_arrays = staticmethod(pa.concat_arrays)

    raw = pa.array(sources)
    monkeypatch.setattr(wikitext, "pa", Watched)
    assert wikitext.parsed.func(raw).to_pylist() == [wikitext.parsed_page(s or "") for s in sources]
    assert max(sizes) == 64
    usual = spark.conf.get(tables.BATCH, None)
    with tables.small_batches(spark):
        assert spark.conf.get(tables.BATCH) == str(8 << 20)
    assert spark.conf.get(tables.BATCH, None) == usual


def test_texts_searched_once_need_no_index(spark, monkeypatch):
    """One search gives what an index gives: copies, ties, rows without text or terms, filters; many terms make an index."""
    from loomwell.operators import lexical

    rows = [(i * 7 % 600, "the " * (i % 5) + " ".join(f"W{i * j % 23}" for j in range(i % 12)) if i % 10 else ("" if i % 20 else None)) for i in range(600)]
    docs = spark.createDataFrame([*rows, *((1000 + i, "the copy, The copy") for i in range(300))], "id long, text string").repartition(5)
    asked = spark.createDataFrame([(q, q % 2, t) for q, t in enumerate(["the w3", "w1 W1 w2, w5 w7", "copy the", "gone", "", None, "THE"])], "a int, b int, q string")
    asked, only = asked.select(F.struct("a", "b").alias("q_id"), "q"), docs.where("id % 3 = 1").select(F.col("id").alias("doc"))
    index, made = lexical.build(docs, "id"), []
    build = lexical.build
    monkeypatch.setattr(lexical, "build", lambda *a: made.append(1) or build(*a))
    monkeypatch.setattr(lexical, "STEP_DOCS", 16)
    found = lambda source, allowed: {(r["q_id"].a, r["q_id"].b, r["rank"]): (r["doc"], round(r["score"], 9)) for r in lexical.search(source, asked, 9, allowed).collect()}
    want = [found(index, allowed) for allowed in (None, only)]
    assert len(want[0]) == 4 * 9
    for most in (10_000, 3):
        monkeypatch.setattr(lexical, "SEARCHED_TERMS", most)
        source = lexical.Unindexed(docs, "id")
        assert [found(source, allowed) for allowed in (None, only)] == want and len(made) == (most == 3)
    monkeypatch.setattr(lexical, "SEARCHED_TERMS", 10_000)
    assert lexical.search(lexical.Unindexed(docs.limit(0), "id"), asked, 9).count() == lexical.search(lexical.Unindexed(docs, "id"), asked.limit(0), 9).count() == 0


def test_vectors_searched_once_need_no_index(spark, monkeypatch):
    """Queries meet the rows of their length: copies, filters, ids of any kind; many queries make an index."""
    import numpy as np

    from loomwell.operators import metric

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((400, 6)), np.tile(rng.standard_normal((2, 6)), (150, 1))]).astype(np.float32)
    rows = [(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame([*rows, ("w", None), ("x", [1.0]), ("y", [float("nan")] * 6), ("z", [None, *[0.0] * 5])], "vec_id string, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(i, x[i * 17].tolist()) for i in range(40)] + [(500, None), (501, [3.0])], "q_id long, q array<float>")
    for name, value in (("SIDE_BY_SIDE", 7), ("PAIRS", 50)):
        monkeypatch.setattr(metric, name, value)
    found = lambda source, allowed=None: {(r["q_id"], r["rank"]): (r["id"], r["distance"]) for r in metric.search(source, asked, 9, allowed).collect()}

    def brute(ids):
        out = {}
        for q in range(40):
            d = np.cumsum((x[ids].astype(float) - x[q * 17].astype(float)) ** 2, axis=1)[:, -1]
            out |= {(q, n): (rows[ids[i]][0], float(d[i])) for n, i in enumerate(np.lexsort((ids, d))[:9], 1)}
        return out

    every = np.arange(len(x))
    assert found(metric.Unindexed(vectors)) == brute(every) | {(501, 1): ("x", 4.0)}
    assert found(metric.Unindexed(vectors), vectors.where("vec_id like '%3'").select(F.col("vec_id").alias("doc"))) == brute(every[3::10])
    monkeypatch.setattr(metric, "SLICE", 30)
    source = metric.Unindexed(vectors.where("vec_id like 'v%'"))
    assert found(source) == brute(every) and source.index is not None


@pytest.mark.parametrize("name", ["hybrid_retrieve", "rag_prompt"])
def test_three_questions_build_no_index(spark, duck, monkeypatch, name):
    from loomwell.operators import lexical, metric

    def built(*_):
        raise AssertionError("an index of all texts or vectors for one search")

    for module in (lexical, metric):
        monkeypatch.setattr(module, "build", built)
    from tests.conftest import SF

    assert same_rows(catalog.queries()[name](spark, SF), duck, catalog.oracle_sql()[name])


def test_prompt_asks_its_own_question_only(spark, duck, monkeypatch):
    from loomwell.operators import hybrid
    from loomwell.plans import retrieval
    from tests.conftest import SF

    asked, retrieve = [], hybrid.retrieve
    monkeypatch.setattr(hybrid, "retrieve", lambda corpus, questions, *a: asked.append([tuple(r) for r in questions.collect()]) or retrieve(corpus, questions, *a))
    assert same_rows(catalog.queries()["rag_prompt"](spark, SF), duck, catalog.oracle_sql()["rag_prompt"]) == 1
    assert asked == [[(0, retrieval.ASKED[0])]]
