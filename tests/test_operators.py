"""Operators against hand-made cases and plain Python models."""

import re

import pytest
from pyspark.sql import functions as F

from loomwell.functions import text as tx
from loomwell.functions import wikitext
from loomwell.operators import chunking, graph, knowledge, retrieval, routing
from loomwell.sources import files
from loomwell.streaming import ingest


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def model_chunks(text, most):
    overlap, done, now, size = int(most * 0.15), [], [], 0
    for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text)):
        if not s:
            continue
        n = max(1, int(len(s.split()) * 1.3))
        if size + n > most and now:
            done.append(" ".join(x for x, _ in now))
            kept, size = [], 0
            for x in reversed(now):
                if size + x[1] > overlap:
                    break
                kept.insert(0, x)
                size += x[1]
            now = kept
        now.append((s, n))
        size += n
    return done + ([" ".join(x for x, _ in now)] if now else [])


def test_chunk_fold_is_the_model(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()]
    texts += [(-1, ""), (-2, "One."), (-3, "a b c. " * 300), (-4, "no end " * 400)]
    got = {r["i"]: r["c"] for r in spark.createDataFrame(texts, "i long, t string").select("i", chunking.fold(F.col("t"), 60).alias("c")).collect()}
    assert got == {i: model_chunks(t, 60) for i, t in texts}


def test_fusion_example(spark):
    legs = spark.createDataFrame([(1, 1, "A", 0.95), (1, 2, "B", 0.85), (1, 3, "C", 0.75), (2, 1, "B", 12.5), (2, 2, "D", 10.1), (2, 3, "A", 8.0)], "leg int, rank int, id string, score double")
    assert [r["id"] for r in retrieval.fuse(legs, 3).collect()] == ["B", "A", "D"]


def test_fusion_skips_rows_without_id(spark):
    legs = spark.createDataFrame([(1, 1, None, 1.0), (1, 2, "A", 0.9), (1, 3, "A", 0.8)], "leg int, rank int, id string, score double")
    assert retrieval.fuse(legs, 3).first()["rrf"] == pytest.approx(1 / 62 + 1 / 63)


@pytest.mark.parametrize(
    "question, expected",
    [("What species is the dragon?", "factual"), ("relationship of A and B", "relational"), ("Compare A and B", "comparative"), ("เปรียบเทียบ ก กับ ข", "comparative"), ("ใครคือ", "factual"), ("เพื่อนของเขา", "relational"), ("search", "timeline"), ("hello", "general")],
)
def test_archetype(spark, question, expected):
    assert one(spark, routing.archetype(F.lit(question))) == expected


def test_language(spark):
    assert [one(spark, routing.language(F.lit(q))) for q in ("มังกร", "Dragon", "Dragon คือ")] == ["th", "en", "th"]


def test_numbers_beside_thai_and_spaces(spark):
    assert one(spark, routing.numbers(F.lit("ที่เล่ม 4 Volume 7 volumes 3 vol.9"), routing.VOLUME)) == [4, 7, 9]
    assert one(spark, routing.has_word(F.lit("beforehand after_"), routing.BEFORE_OR_AFTER)) is False


def test_wikitext(spark):
    raw = "[[A|b]] {{S|x}}<br>{{Nihongo|n|k}} <ref>z</ref>{{outer|{{inner}}}}<!-- c -->"
    plain = one(spark, wikitext.value(F.lit(raw)))
    assert plain == "b (x)\nn" and "[" not in plain


def test_multivalue(spark):
    assert one(spark, tx.multivalue(F.lit("• a, b\n* c (d, e)\n\n- f"))) == ["a", "b", "c (d, e)", "f"]


def test_redaction(spark):
    assert one(spark, tx.redacted(F.lit("Bearer abc api_key=xyz, sk-abcdefgh1"))) == "Bearer [REDACTED] api_key=[REDACTED], [REDACTED]"


def test_chunk_id(spark):
    assert one(spark, tx.chunk_id(F.lit("A b"), F.lit("x > y/z"), F.lit(3), F.lit("t"))).startswith("A_b__x__y_z__c3__")


def test_title(spark):
    assert one(spark, files.title_of(F.lit("file:/x/dragon_lore.md"))) == "Dragon Lore"


def test_local_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "dragon_lore.md").write_text("hello\nworld")
    (tmp_path / "image.png").write_text("no")
    assert [(r["title"], r["raw_text"]) for r in files.local_documents(spark, str(tmp_path)).collect()] == [("Dragon Lore", "hello\nworld")]


def test_audit(spark):
    rows = spark.createDataFrame([("a", "h", "E", "t", 5.0), ("b", "h", " ", " ", 0.0)], "chunk_id string, content_hash string, entity string, chunk_text string, fetched_at double")
    r = knowledge.audit(rows).first()
    assert (r["n_rows"], r["n_hashes"], r["duplicate_groups"], r["missing_entity"], r["missing_chunk_text"], r["latest"], r["ok"]) == (2, 1, 1, 1, 1, 5.0, False)
    empty = knowledge.audit(rows.limit(0)).first()
    assert (empty["n_rows"], empty["latest"], empty["ok"]) == (0, None, True)


def test_keyword_recall(spark):
    words = F.array(F.lit("blue"), F.lit("stone"), F.lit("tower"))
    assert one(spark, knowledge.keyword_recall(F.lit("A Blue Stone"), words)) == pytest.approx(2 / 3)
    assert one(spark, knowledge.keyword_recall(F.lit("x"), F.array().cast("array<string>"))) == 1.0


def test_new_rows_null_hash_is_a_value(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "seq long, content_hash string")
    assert sorted(r["seq"] for r in ingest.new_rows(rows, None).collect()) == [1, 3]
    assert [r["seq"] for r in ingest.new_rows(rows, rows.where("seq = 1")).collect()] == [3]


EDGES = [(1, "R", "V", "ally"), (2, "V", "I", "ally"), (3, "R", "X", "foe"), (4, "X", "Y", "foe"), (5, "Y", "I", "foe"), (6, "R", "R", "self")]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame([(*e, 1.0) for e in EDGES], "edge_id long, source string, target string, relation string, confidence double")


def test_subgraph_depth(edges):
    nodes = lambda d: {r["id"] for r in graph.subgraph(edges, "R", d)[0].collect()}
    assert nodes(1) == {"R", "V", "X"} and nodes(2) == {"R", "V", "X", "I", "Y"}


def test_subgraph_cap_keeps_edges(edges):
    nodes, kept = graph.subgraph(edges, "R", 2, most=2)
    assert {r["id"] for r in nodes.collect()} == {"R", "V"}
    assert {r["edge_id"] for r in kept.collect()} == {1, 3, 6}


def test_subgraph_relation(edges):
    assert {r["id"] for r in graph.subgraph(edges, "R", 2, relation="foe")[0].collect()} == {"R", "X", "Y"}


def test_shortest_path(edges):
    path = sorted((r["step"], r["edge_id"]) for r in graph.shortest_path(edges, "I", "R").collect())
    assert path == [(1, 2), (2, 1)]
    assert graph.shortest_path(edges, "R", "R").count() == 0
    assert graph.shortest_path(edges, "R", "nobody").count() == 0


def test_degrees_count_loops_twice(edges):
    assert {r["id"]: r["degree"] for r in graph.degrees(edges).collect()}["R"] == 4


def test_nearest_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert retrieval.nearest(empty, [1.0], 3).count() == 0


def test_bm25_of_blank(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert retrieval.bm25(docs, "  ", 5).count() == 0
    assert [r["doc"] for r in retrieval.bm25(docs, "b", 5).collect()] == [1]


def model_sections(raw):
    out, open_, now, lines = [], [], None, []

    def close():
        content = re.sub(r"[ \t]+", " ", "\n".join(x.strip() for x in lines if x.strip()))
        if now and content:
            out.append((*now, content))

    for line in raw.split("\n"):
        m = re.match(r"^(={1,6})\s*([^=].*?)\s*={1,6}\s*$", line)
        if not m:
            lines.append(line)
            continue
        close()
        level, title = len(m[1]), m[2].strip()
        lines = [title]
        if title.lower() in ("references", "gallery", "external links", "navigation"):
            now = None
            continue
        open_ = [p for p in open_ if p[0] < level] + [(level, title)]
        now = (title, level, " > ".join(t for _, t in open_))
    close()
    return out


def test_sections_are_the_model():
    pages = [
        "lead\n== A ==\ntext\n=== B ===\n\n==== C ====\n  deep \t x\n== References ==\nno\n=== D ===\nyes\n== E ==",
        "== Gallery ==\n=== x ===\na\n== y ==\nb\n\n c", "", "no headings", "== a ==\n1\n==== b ====\n2\n=== c ===\n3", "= Top =\nx\n== A ==\n= Next =\ny",
    ]
    for page in pages:
        assert [tuple(s.values()) for s in wikitext.parsed_page(page)["sections"]] == model_sections(page)


def box(raw):
    return {f["key"]: f["value"] for f in wikitext.parsed_page(raw)["fields"]}


def test_infobox_and_links(spark):
    raw = "{{Char Infobox\n| a = [[x|y]]\n| a = z\n|b={{S|t}}<br>u\n| none\n}}\n[[P#q|r]] [[File:f]] [[P]] [[de:x]]"
    row = spark.createDataFrame([(raw,)], "raw string").select(wikitext.parsed("raw").alias("p")).select(wikitext.fields_map(F.col("p")).alias("f"), "p.links", "p.error").first()
    assert (row["f"], row["links"], row["error"]) == ({"a": "z", "b": "(t)\nu", "1": "none"}, ["x", "P#q", "P"], None)
    assert box("no box") == {}


@pytest.mark.parametrize("raw, fields", [
    ("{{Infobox character|name=A|race=B}}", {"name": "A", "race": "B"}),
    ("{{Infobox character\n|name=A\n|race=B}}", {"name": "A", "race": "B"}),
    ("{{Infobox c\n|name=A|race=B\n|q={{X|a\n}}c\n}}", {"name": "A", "race": "B", "q": "c"}),
    ("{{Infobox c|k={{Nihongo|[[a|b]]|k}}|x=[http://x.y site]|e=R &amp; D|s='''b''' it''s}}", {"k": "b", "x": "site", "e": "R & D", "s": "b it''s"}),
    ("{{Infobox c|kanji = リムル＝テンペスト|titles = C<br>G|species=[[True Dragon]] {{S|[[U]]}}|link=[[a|b=c]]}}", {"kanji": "リムル＝テンペスト", "titles": "C\nG", "species": "True Dragon (U)", "link": "b=c"}),
    ("{{Outer|{{Infobox in|a=1}}}} {{Infobox two|b=2}}", {"a": "1"}),
    ("{{Infobox out|in={{Infobox in|a=1}}|b=2}}", {"b": "2"}),
])
def test_infobox_layouts(raw, fields):
    assert box(raw) == fields


@pytest.mark.parametrize("raw, lead, links", [
    ("'''Rimuru''' ''x'' &amp; king, see [http://x.y site] [http://q] it''s http://bare", "Rimuru x & king, see site it''s http://bare", []),
    ("[[Slime#Kinds|s]] [[File:a|thumb|cap]] [[b]]", "s thumb|cap b", ["Slime#Kinds", "b"]),
    ("<nowiki>{{</nowiki> fine page", "{{ fine page", []),
    ("a {{b <!-- c [[d", "a {{b <!-- c [[d", []),
    ("{{s|{{s|x}}}} {{Nihongo|n|k}} {{W|gone}}<ref>[[in]]</ref><ref name=x/>t<gallery>g</gallery>", "((x)) n t", ["in"]),
    ("* a\n:# b\n----\n{| class=x\n|-\n! h\n| c || d\n|}", "a\nb\n! h\nc d", []),
    ("[[a\nb]] ]] }} <b>c</b> <3", "[[a\nb]] ]] }} c <3", []),
])
def test_page_text(raw, lead, links):
    page = wikitext.parsed_page(raw)
    assert (page["lead"], page["links"], page["error"]) == (lead, links, None)


@pytest.mark.parametrize("many", ["{{a|b}}", "{{S|", "[[", "{{S|x [[a|b]] '''c'''}} &amp;\n", "<!--", "<ref>", "[[<ref>", "[[{{a", "== a ==\nb {{x}}\n", "[http://a b", "<nowiki>", "{{a|[["])
def test_marks_in_linear_time(many):
    import time

    spent = []
    for n in (5_000, 40_000):
        began = time.process_time()
        wikitext.parsed_page(many * n + "}}" * n)
        spent.append(time.process_time() - began)
    assert spent[1] < 24 * spent[0] + 0.5


def test_pages_that_cannot_be_read_are_put_aside(spark, tmp_path, monkeypatch):
    from loomwell.operators import wiki

    (tmp_path / "a.json").write_text('{"page_id": 1, "title": "A", "raw_wikitext": "x {{"}\n{"page_id": 2, "ti\n\n{"page_id": 3, "title": "B", "raw_wikitext": " "}\n')
    pages = files.pages(spark, str(tmp_path)).withColumnRenamed("raw_wikitext", "raw_text")
    good, bad = wiki.quarantined(wiki.parse_pages(pages, spark.createDataFrame([("A", ["B"])], "canonical string, aliases array<string>")))
    assert [(r["page_id"], r["lead"], r["aliases"]) for r in good.collect()] == [(1, "x {{", ["B"])]
    assert [tuple(r) for r in bad.collect()] == [(None, None, "not a record", '{"page_id": 2, "ti')]


TEXTS = [" ".join(f"w{(i * j * 7 + j) % (3 + j % 40)}" for j in range(3 + i % 50)) for i in range(300)] + ["", "rare w1", "rare rare w2", "  ...  "]


def full_search(texts, query, k):
    """BM25 over all documents, term by term."""
    import math
    from collections import Counter

    docs = {i: Counter(re.findall(r"[^\W_]+", t.lower())) for i, t in texts.items() if t is not None}
    n, mean = len(docs), sum(sum(c.values()) for c in docs.values()) / len(docs)
    score = Counter()
    for term in set(re.findall(r"[^\W_]+", query.lower())):
        df = sum(term in c for c in docs.values())
        for i, c in docs.items():
            if term in c:
                score[i] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[term] * 2.2 / (c[term] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
    return [(i, round(s, 9)) for i, s in sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]]


def test_lexical_index_is_kept_up(spark, tmp_path, monkeypatch):
    """Pruned searches are full ones, with one segment, with several and merged; what is there is not rewritten; a writer that fails changes nothing."""
    import glob
    import os

    from loomwell.operators import lexical

    monkeypatch.setattr(lexical, "BLOCK_DOCS", 60)
    texts = dict(enumerate(TEXTS)) | {500: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    queries = ["w1 W2 w7", "rare w1", "w0 w1 w2 w3 w4 w5", "nothing here", ""]
    asked = spark.createDataFrame(list(enumerate(queries)), "q_id int, q string")

    def check(index, known):
        for pruned in (True, False):
            rows = lexical.search(index, asked, 7, pruned=pruned).orderBy("q_id", "rank").collect()
            for n, q in enumerate(queries):
                assert [(r["doc"], round(r["score"], 9)) for r in rows if r["q_id"] == n] == full_search(known, q, 7), (n, pruned)

    path = str(tmp_path / "index")
    index = lexical.build(docs.where("doc_id < 150"), path=path)
    assert index.n == 150
    check(index, {i: t for i, t in texts.items() if i < 150})
    files = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/segments/*/*/*.parquet")}
    for low, high in ((150, 220), (220, 1000)):
        index = lexical.add(index, docs.where(f"doc_id >= {low} and doc_id < {high}"))
    check(index, texts)
    assert len(index.segments) == 3 and all(os.path.getmtime(f) == m for f, m in files.items())
    only = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("doc"))
    some = lexical.search(index, asked, 400, allowed=only).collect()
    every = {(r["q_id"], r["doc"]): r["score"] for r in lexical.search(index, asked, 400).collect()}
    assert {(r["q_id"], r["doc"]): r["score"] for r in some} == {k: s for k, s in every.items() if k[1] % 2 == 0}

    def broken(*_):
        raise RuntimeError

    with monkeypatch.context() as m:
        m.setattr(lexical, "_committed", broken)
        with pytest.raises(RuntimeError):
            lexical.add(index, docs.limit(5))
    again = lexical.open_index(spark, path)
    assert again == index
    one = lexical.merged(again)
    assert len(one.segments) == 1 and one.version == index.version + 1 and (one.n, one.mean) == (index.n, pytest.approx(index.mean))
    check(one, texts)
    # A term's rows are in one file of a bucket.
    assert max(len(glob.glob(f"{path}/segments/{one.segments[0]}/bucket={b}/*.parquet")) for b in range(lexical.BUCKETS)) == 1


def test_lexical_blocks_are_left_out(spark, monkeypatch):
    """A rare word decides, so blocks that have common words only need not be scored."""
    from loomwell.operators import lexical

    monkeypatch.setattr(lexical, "BLOCK_DOCS", 20)
    rows = [(i, " ".join(["the"] * (1 + i % 60) + (["grail"] * 3 if i in (3, 4) else []))) for i in range(600)]
    index = lexical.build(spark.createDataFrame(rows, "doc_id long, text string"))
    seen, left = [], lexical._left

    def told(placed, near, k):
        seen.append((placed.count(), (out := left(placed, near, k)).count()))
        return out

    monkeypatch.setattr(lexical, "_left", told)
    found = lexical.search(index, spark.createDataFrame([(0, "the grail")], "q_id int, q string"), 2).orderBy("rank").collect()
    assert [(r["doc"], round(r["score"], 9)) for r in found] == full_search(dict(rows), "the grail", 2) and seen[0][1] < seen[0][0] / 4


def test_metric_index_is_exact(spark, monkeypatch):
    import numpy as np

    from loomwell.operators import metric

    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16)) * 3
    x = np.concatenate([centres[rng.integers(0, 12, 900)] + 0.2 * rng.standard_normal((900, 16)), np.tile(centres[0], (100, 1))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [1.0])]
    monkeypatch.setattr(metric, "CELL_ROWS", 50)
    monkeypatch.setattr(metric, "PART_ROWS", 40)
    index = metric.build(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert index.rows.count() == 1000 and max(index.parts) > 1
    asked = [(i, x[i * 17].tolist()) for i in range(40)] + [(100, (x[0] + 5).tolist())]
    queries = spark.createDataFrame(asked, "q_id int, q array<double>")
    got = {(r["q_id"], r["rank"]): (r["id"], round(r["distance"], 9)) for r in metric.search(index, queries, 6).collect()}
    want, odd = {}, {}
    for q, v in asked:
        d = ((x - np.array(v)) ** 2).sum(axis=1)
        for where, ids in ((want, np.arange(1000)), (odd, np.arange(1, 1000, 2))):
            where.update({(q, n + 1): (int(i), round(float(d[i]), 9)) for n, i in enumerate(ids[np.lexsort((ids, d[ids].round(12)))][:6])})
    assert got == want
    only = spark.range(1, 1000, 2).select(F.col("id").alias("doc"))
    assert {(r["q_id"], r["rank"]): (r["id"], round(r["distance"], 9)) for r in metric.search(index, queries, 6, only).collect()} == odd
    assert metric.compared(index, queries, 6) < 0.25 * 1000 * len(asked)
    assert metric.search(metric.build(spark.createDataFrame([], "vec_id long, embedding array<double>")), queries, 3).count() == 0


@pytest.mark.parametrize("most", [4_000_000, 2000])
def test_mentions_of_many_aliases(spark, monkeypatch, most):
    """Aliases with one common beginning, in one part and in several; overlapping, repeated and short ones."""
    monkeypatch.setattr(routing, "MOST_CHARS", most)
    aliases = [(i, f"Item {i}", f"E{i % 700}") for i in range(1000)] + [(2000, "em 1", "X"), (2001, "it", "short"), (2002, "ITEM 5", "E5"), (2003, None, "none"), (2004, "élan", "É"), (2005, "x y", None)]
    questions = [(0, "item 17 and ITEM 999"), (1, "It is"), (2, None), (3, "Élan of item 5"), (4, "")]
    q, a = spark.createDataFrame(questions, "q_id int, q string"), spark.createDataFrame(aliases, "seq long, alias string, canonical string")
    want = set()
    for n, text in questions:
        for seq, alias, canonical in aliases:
            if text is not None and alias and canonical and len(alias) >= 3 and alias.lower() in text.lower():
                want.add((n, min(s for s, b, c in aliases if b and (b.lower(), c) == (alias.lower(), canonical)), canonical))
    got = [tuple(r) for r in routing.mentions(q, a).collect()]
    assert set(got) == want and len(got) == len(want)


def test_expansion_names_the_aliases_of_each_entity(spark):
    aliases = [(0, "Rimuru", "Rimuru"), (1, "Slime", "Rimuru"), (2, "Satoru", "Rimuru"), (3, "Lord", "Rimuru"), (4, "King", "Rimuru"), (5, "Veldora", "Veldora"), (6, "dragon", "Veldora")]
    questions = spark.createDataFrame([(0, "the dragon and the slime"), (1, "nobody"), (2, "VELDORA")], "q_id int, q string")
    rows = {r["q_id"]: (r["matched"], r["expanded"]) for r in routing.expand(questions, spark.createDataFrame(aliases, "seq long, alias string, canonical string")).collect()}
    assert rows == {
        0: (["Rimuru", "Veldora"], "the dragon and the slime (also known as: Slime, Satoru, Lord) (also known as: dragon)"), 1: (None, "nobody"), 2: (["Veldora"], "VELDORA (also known as: dragon)"),
    }


def test_keyed_table(spark, tmp_path, monkeypatch):
    """Inserts and upserts against a dictionary; only touched buckets are read; failures and repeats change nothing."""
    from loomwell.streaming import keyed

    schema, path = "k string, seq long, v string", str(tmp_path / "t")
    open_ = lambda: keyed.open_table(spark, path, "k", schema, 8)
    df = lambda rows: spark.createDataFrame(rows, schema)
    as_dict = lambda t: {r["k"]: (r["seq"], r["v"]) for r in t.rows().collect()}
    table, want = open_(), {}
    assert as_dict(table) == {}
    for n in range(4):
        rows = [(f"k{(i * 13 + n * 40) % 150}", 1000 * n + i, f"v{n}") for i in range(60)] + [(None, 1000 * n + 70, f"null{n}"), (f"k{n}", 1000 * n + 80, "late")]
        table = keyed.insert(table, df(rows), "seq", n)
        for k, seq, v in rows:
            want.setdefault(k, (seq, v))
        assert as_dict(table) == want and table.rows().count() == len(want)
    assert keyed.insert(table, df([("fresh", 1, "x")]), "seq", 3) is table
    table, want = keyed.insert(table, df([("no order", None, "x")]), "seq", 4), want | {"no order": (None, "x")}
    assert as_dict(table) == want
    rows = [("k5", 1, "old"), ("k5", 9, "new"), ("brand new", 3, "x"), (None, 5, "n")]
    read = []
    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedTable, "rows", lambda self, buckets=None, real=keyed.KeyedTable.rows: read.append(buckets) or real(self, buckets))
        newer = keyed.upsert(table, df(rows), "seq")
    assert len(read) == 1 and len(read[0]) <= 3
    want |= {"k5": (9, "new"), "brand new": (3, "x"), None: (5, "n")}
    assert as_dict(newer) == want and {p[1] for p in newer.parts if p[0] not in read[0]} <= {p[1] for p in table.parts}

    def broken(*_):
        raise RuntimeError

    with monkeypatch.context() as m:
        m.setattr(keyed, "_committed", broken)
        with pytest.raises(RuntimeError):
            keyed.upsert(newer, df(rows), "seq")
    assert as_dict(open_()) == want and open_().version == newer.version
    monkeypatch.setattr(keyed, "MOST_PARTS", 2)
    newer = keyed.insert(newer, df([(f"n{i}", i, "z") for i in range(40)]), "seq")
    want |= {f"n{i}": (i, "z") for i in range(40)}
    assert as_dict(newer) == want
    assert keyed.vacuum(newer) > 0 and as_dict(open_()) == want
    # Filters keep most new keys from reading anything.
    told = keyed._may_be_there(newer, df([(f"other{i}", i, "z") for i in range(500)])).where("_may").count()
    assert told < 10


def test_chat_log_applied_again(spark):
    """Creates that repeat lose nothing, a replayed log changes nothing, roles are checked, deletes take messages along."""
    from loomwell.operators import chats

    schema = "seq long, at long, kind string, conv_id long, message_id string, role string, content string, title string"
    log = [
        (1, 1, "create", 1, None, None, None, "first"), (2, 2, "message", 1, "a", "user", "hi", None), (3, 3, "create", 1, None, None, None, "again"), (4, 4, "rename", 1, None, None, None, "named"),
        (5, 5, "message", 1, "b", "tool", "no", None), (6, 6, "verify", 1, "a", None, "{1}", None), (7, 7, "message", 2, "c", "user", "early", None), (8, 8, "create", 2, None, None, None, None),
        (9, 9, "message", 2, "d", "assistant", "x", None), (10, 10, "delete", 2, None, None, None, None), (11, 11, "message", 2, "e", "user", "late", None), (12, 12, "create", 3, None, None, None, "t" * 300),
        (13, 13, "delete", 3, None, None, None, None), (14, 14, "create", 3, None, None, None, ""), (15, 15, "message", 3, "f", "system", "s", None),
    ]
    again = [(s + 100, at, *rest) for s, at, *rest in log if rest[1] == 1]
    for rows in (log, log + again):
        conversations, messages = chats.applied(spark.createDataFrame(rows, schema))
        assert {(r["conv_id"], r["title"], r["updated_at"], r["n_messages"]) for r in conversations.collect()} == {(1, "named", 4, 1), (3, "New chat", 15, 1)}
        assert {tuple(r) for r in messages.select("conv_id", "message_id", "place", "role", "verification").collect()} == {(1, "a", 1, "user", "{1}"), (3, "f", 1, "system", "{}")}


def test_retrieval_with_filters_and_scorer(spark):
    """Many questions at once: filters hold for all lists, a scorer orders the candidates, metadata come along."""
    from loomwell.functions import vector as vx
    from loomwell.operators import hybrid, lexical, metric

    texts = ["slime king of volume 3", "dragon of the north chapter 7", "slime before the war", "", None, "dragon and slime"]
    chunks = spark.createDataFrame([(i, "infobox" if i == 5 else "text", "a" if i % 2 else "b", t) for i, t in enumerate(texts)], "id long, chunk_type string, wiki string, text string")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<double>")
    aliases = spark.createDataFrame([(0, "Rimuru", "Rimuru"), (1, "slime", "Rimuru"), (2, "Veldora", "Veldora")], "seq long, alias string, canonical string")
    edges = spark.createDataFrame([(1, "Rimuru", "dragon", "knows", 1.0), (2, "north", "Veldora", "home", 1.0)], "edge_id long, source string, target string, relation string, confidence double")
    embed = lambda q: vx.normalised(F.array(F.length(q).cast("double"), F.lit(1.0)))
    corpus = hybrid.Corpus(chunks, metric.build(vectors), lexical.build(chunks, "id"), aliases, edges, embed)
    asked = spark.createDataFrame([(7, "what is the slime"), (8, "Veldora"), (9, "nothing")], "q_id long, q string")
    rows = hybrid.retrieve(corpus, asked, 3).collect()
    by = {q: sorted((r for r in rows if r["q_id"] == q), key=lambda r: r["place"]) for q in (7, 8, 9)}
    assert all([r["place"] for r in mine] == [1, 2, 3] for mine in by.values())
    first = by[7][0]
    assert (first["id"], first["chunk_type"], first["archetype"], first["matched"], first["related"]) == (5, "infobox", "factual", ["Rimuru"], ["dragon"])
    assert by[8][0]["related"] == ["north"] and by[9][0]["matched"] == [] and {r["language"] for r in rows} == {"en"}
    told = {r["id"]: r["temporal"] for r in rows}
    assert all(told[i]["volumes"] == ([3] if i == 0 else []) and told[i]["chapters"] == ([7] if i == 1 else []) and told[i]["has_relation"] == (i == 2) for i in told)
    only = hybrid.retrieve(corpus, asked, 3, filters={"wiki": "a"}).collect()
    assert {r["id"] for r in only} <= {1, 3, 5} and len({r["q_id"] for r in only}) == 3
    scorer = lambda: lambda q, texts: [float(len(t)) + (100.0 if q == "Veldora" and "war" in t else 0.0) for t in texts]
    scored = {r["q_id"]: r["id"] for r in hybrid.retrieve(corpus, asked, 1, scorer=scorer).collect()}
    assert scored[8] == 2 and scored[9] == 1


def test_page_dumps(spark, tmp_path):
    """Every line once: in splits of any size, and in micro-batches over appended and new files, with a line half written."""
    import json

    from loomwell.sources import dumps

    land, out, state = tmp_path / "land", str(tmp_path / "out"), str(tmp_path / "state")
    land.mkdir()
    pages = [json.dumps({"page_id": i, "title": f"T{i}", "raw_wikitext": "é" * (i % 60), "categories": ["Category:A"]}, ensure_ascii=False) for i in range(200)]
    (land / "a.jsonl").write_text("\n".join(pages[:120]) + "\n{broken\n\n[1]\n")
    dumps.register(spark)
    for split in (50, 333, 1 << 20):
        rows = spark.read.format("page_dumps").option("splitBytes", split).load(str(land)).collect()
        assert sorted(r["page_id"] for r in rows if r["error"] is None) == list(range(120))
        assert sorted(r["raw_text"] for r in rows if r["error"]) == ["[1]", "{broken"] and len(rows) == 122
    assert {(r["title"], r["raw_text"], tuple(r["categories"])) for r in rows if r["page_id"] == 7} == {("T7", "é" * 7, ("A",))}

    def run():
        stream = spark.readStream.format("page_dumps").option("maxBytes", 3000).option("splitBytes", 500).load(str(land)).writeStream.format("parquet")
        stream.option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(out).select("file", "at", "page_id").collect()
        assert len({(r["file"], r["at"]) for r in rows}) == len(rows)
        return rows

    assert 0 < len(run()) < 122
    with open(land / "a.jsonl", "a") as f:
        f.write("\n".join(pages[120:150]) + "\n" + pages[150][:20])
    for _ in range(8):
        rows = run()
    assert sorted(r["page_id"] for r in rows if r["page_id"] is not None) == list(range(150))
    with open(land / "a.jsonl", "a") as f:
        f.write(pages[150][20:] + "\n")
    (land / "b.jsonl").write_text("\n".join(pages[151:]) + "\n")
    for _ in range(4):
        rows = run()
    assert sorted(r["page_id"] for r in rows if r["page_id"] is not None) == list(range(200)) and len(rows) == 202


def test_shortest_paths_of_a_model(spark, monkeypatch):
    """Least edge ids among all shortest paths, on a graph with hubs, loops, double edges and parts that do not meet."""
    import random

    rng, rows = random.Random(4), []
    for e in range(160):
        a, b = rng.randrange(60), rng.choice([rng.randrange(60), 0, 1])
        rows.append((e * 7 % 1000, f"n{a}", f"n{b}", "r"))
    rows += [(2000, "far", "away", "r"), (2001, "n3", "n3", "loop")]
    rows = list({(r[1], r[2]): r for r in rows}.values())
    links = {}
    for e, a, b, _ in rows:
        links.setdefault(a, []).append((e, b))
        links.setdefault(b, []).append((e, a))

    def model(start, end):
        level, seen = {start: []}, {start}
        while level and end not in level:
            new = {}
            for node, path in level.items():
                for e, other in links.get(node, ()):
                    if other not in seen:
                        new[other] = min(new.get(other, [10**9]), [*path, e])
            seen |= set(new)
            level = new
        return level.get(end, [])

    monkeypatch.setattr(graph, "BLOCK_IDS", 100)
    edges = spark.createDataFrame(rows, "edge_id long, source string, target string, relation string")
    index = graph.adjacency(edges)
    for n, (a, b) in enumerate([("n5", "n40"), ("n2", "n33"), ("n0", "n1"), ("n7", "away"), ("n12", "n55")]):
        monkeypatch.setattr(graph, "PUSHED", 1000 if n % 2 else 0)
        assert [r["edge_id"] for r in graph.shortest_path(index, a, b).orderBy("step").collect()] == model(a, b)


def test_api_pages(spark, tmp_path):
    answer = '{"query": {"pages": [{"pageid": 1, "title": "A b", "revisions": [{"revid": 7, "timestamp": "t", "slots": {"main": {"content": "x"}}}, {"revid": 6}], "categories": [{"title": "Category:C"}, {"title": ""}]}, '
    answer += '{"title": "gone", "missing": true}, {"pageid": 2, "title": "B"}]}}'
    (tmp_path / "a.json").write_text(answer + "\n{}\n")
    rows = files.api_pages(spark, str(tmp_path), "http://w/").drop("fetched_at").collect()
    assert sorted(map(tuple, rows)) == [(1, "A b", "http://w/A_b", 7, "t", ["C"], "x"), (2, "B", "http://w/B", 0, "", [], "")]


def test_verification(spark):
    from loomwell.operators import answers

    assert tuple(one(spark, answers.verification(F.lit('```json\n{"verdict": "bad", "summary": "x"}\n```')))) == ("bad", "x")
    assert tuple(one(spark, answers.verification(F.lit("[1]")))) == ("unverified", "[1]")
