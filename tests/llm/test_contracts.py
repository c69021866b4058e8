"""Each query of the training-data operators: SQL where there is some, else plain Python; odd and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwell.llm import decontaminate, near_dedup, registry
from tests.conftest import SF, same_rows
from tests.llm.conftest import SF01, odd_documents, remainder


def read(spark, folder, name="documents"):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, duck, name):
    assert same_rows(registry.queries()[name](spark, SF), duck, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_odd_tables(spark, odd_dir, name):
    rows = registry.queries()[name](spark, odd_dir).collect()
    table = {"op4": None, "op3": None, "op10": "pages", "op11": None, "op13": None}.get(name.split("_")[0], "documents")
    if table and not name.startswith("op2"):
        assert len(rows) == spark.read.parquet(f"{odd_dir}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, empty_dir, name):
    assert registry.queries()[name](spark, empty_dir).count() == (1 if name.startswith("op4") else 0)


def check_media(rows, docs):
    want = Counter()
    for d in docs:
        raw = (d["text"] or "").encode("utf-8")
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        want[d["doc_id"], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want


def test_op1(spark, odd_dir):
    check_media(registry.queries()["op1_webp_lossless"](spark, SF).collect(), read(spark, SF))
    check_media(registry.queries()["op1_webp_lossless"](spark, odd_dir).collect(), read(spark, odd_dir))


def test_large_payloads_become_several_images(spark, monkeypatch):
    """Files read one by one give the payload back; features are of the samples."""
    import pandas as pd

    from loomwell.llm import vp8l, webp_media

    monkeypatch.setattr(webp_media, "IMAGE_BYTES", 128)
    texts = ["a" * 500, "", None, "xyz" * 100, "é" * 32]
    frame = pd.DataFrame({"k": range(5), "t": texts})
    rows = pd.concat(webp_media.described(frame)).to_dict("records")
    check_media(rows, [{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    for r, t in zip(rows, texts):
        payload, _ = webp_media.to_payload(t)
        files = webp_media._encoded([payload])[0]
        assert len(files) == -(-len(payload) // 128)
        assert b"".join((vp8l.decode(f) >> 8 & 255).astype(np.uint8).tobytes() for f in files)[: len(payload)] == payload
        assert (r["media_bytes"], r["media_sha256"]) == (sum(map(len, files)), hashlib.sha256(b"".join(files)).hexdigest())
        x = np.frombuffer(payload, np.uint8).astype(float)
        assert f";mean={x.mean():.4f};var={x.var():.4f};" in r["feature"] and r["feature"].endswith(f"levels={len(set(payload))}")


def check_packing(rows, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d in docs:
        ids = [*tok.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        first, start, piece = len(ids) % 1024 or 1024, 0, 0
        while start < len(ids):
            part = ids[start : start + (first if not piece else 1024)]
            want[d["doc_id"], piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
            start, piece = start + len(part), piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    placed = defaultdict(list)
    for r in rows:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for got in placed.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(placed) <= -(-sum(r["length"] for r in rows) // 1024) * 1.02 + 1


def test_op2(spark, odd_dir):
    check_packing(registry.queries()["op2_best_fit_packing"](spark, SF01).collect(), read(spark, SF01))
    check_packing(registry.queries()["op2_best_fit_packing"](spark, odd_dir).collect(), read(spark, odd_dir))


def least_edits(passage, text):
    """The least edits of any stretch of ``text`` for the passage: bit vectors, one step a character."""
    m, places = len(passage), {}
    for i, c in enumerate(passage):
        places[c] = places.get(c, 0) | 1 << i
    every, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = every, 0, m, m
    for c in text:
        eq = places.get(c, 0)
        xv, xh = eq | down, (((eq & up) + up) ^ up) | eq
        ph, mh = (down | ~(xh | up)) & every, up & xh
        score += bool(ph & top) - bool(mh & top)
        best = min(best, score)
        ph, mh = ph << 1, mh << 1
        up, down = (mh | ~(xv | ph)) & every, ph & xv & every
    return best


def test_least_edits():
    assert [least_edits("abcdef", t) for t in ("xxabcdefxx", "xxabdefxx", "abcXdef", "", "zzz", "abXdXf")] == [0, 1, 1, 6, 6, 2]


def test_op3_exact_passages(spark, odd_dir):
    norm = decontaminate.normalised
    for folder in (SF01, odd_dir):
        docs, items = read(spark, folder), read(spark, folder, "benchmark")
        holds = lambda d, i: norm(i) and (norm(i) in norm(d) if len(norm(i)) >= decontaminate.SHORT else f" {norm(i)} " in f" {norm(d)} ")
        want = Counter((d["doc_id"], i["item_id"]) for d in docs for i in items if holds(d["text"], i["text"]))
        got = Counter((r["doc_id"], r["item_id"]) for r in registry.queries()["op3_benchmark_leaks"](spark, folder).collect() if r["edits"] == 0)
        assert got == want and want


def test_op3_all_pairs_by_edit_distance(spark):
    """Every document against every passage, near matches too; planted ones with edits make sure that there are some."""
    norm, rng = decontaminate.normalised, np.random.default_rng(4)
    items = read(spark, SF, "benchmark")[::5]
    docs = [(d["doc_id"], d["text"]) for d in read(spark, SF) if len(d["text"] or "") < 4000]
    for k, i in enumerate(items):
        chars = list(i["text"])
        for at in rng.integers(0, len(chars) - 1, 2 + 2 * k):
            chars[at] = chars[at] + "q" if at % 3 == 0 else "" if at % 3 == 1 else "z"
        docs.append((10_000 + k, f"{docs[k][1][:300]} {''.join(chars)} {docs[k + 1][1][:300]}"))
    want = {}
    for d, t in docs:
        for i in items:
            edits, p = least_edits(norm(i["text"]), norm(t)), norm(i["text"])
            if edits <= decontaminate.edits_allowed(len(p)):
                want[d, i["item_id"]] = edits
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in found} == want and len(set(want.values())) > 4 and len(found) == len(want)


def base_spans(text):
    """The fixed patterns, one start after the other."""
    found = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_op8(spark, odd_dir):
    kinds = ("assign", "access", "hex")
    for folder in (SF01, odd_dir):
        want = Counter()
        for d in read(spark, folder):
            spans = base_spans(d["text"] or "")
            listed = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)
            want[(d["doc_id"], *(sum(k == n for _, k, _ in spans) for n in range(3)), hashlib.sha256(listed.encode()).hexdigest())] += 1
        rows = registry.queries()["op8_secret_scan"](spark, folder).collect()
        assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows) == want


def brute_groups(docs, threshold):
    sets = {}
    for d in docs:
        w = (d["text"] or "").encode().lower().split()
        sets[d["doc_id"]] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    for d, s in sets.items():
        if d is None:
            continue
        for e, common in Counter(e for x in s for e in where[x] if e is not None and e < d).items():
            if 100 * common >= threshold * (len(s) + len(sets[e]) - common):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("small", [64, 2])
def test_op9(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "SMALL_RARE", small)
    monkeypatch.setattr(near_dedup, "AT_A_TIME", 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in registry.queries()["op9_near_dedup"](spark, SF01).collect()}
    assert got == brute_groups(read(spark, SF01), 85)


def test_op9_odd(spark, odd_dir):
    rows = registry.queries()["op9_near_dedup"](spark, odd_dir).collect()
    want = brute_groups([d for d in read(spark, odd_dir) if d["doc_id"] is not None], 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == want
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert want[100][1] == 6


def test_op9_many_unlinked_neighbours_and_chains(spark, monkeypatch):
    """A shared passage with own words puts many sets just under the threshold; chains link through others."""
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "SMALL_RARE", 8)
    monkeypatch.setattr(near_dedup, "AT_A_TIME", 3)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join([*passage, *(f"d{i}w{j}" for j in range(6 + i % 3))])) for i in range(60)]
    chain = [f"c{i}" for i in range(200)]
    rows += [(100 + i, " ".join(chain[4 * i : 4 * i + 100])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(docs, threshold=85).collect()}
    assert got == brute_groups([{"doc_id": i, "text": t} for i, t in rows], 85)


def test_op6_accuracy_on_held_out(spark):
    lang = {d["doc_id"]: d["lang"] for d in read(spark, SF01)}
    rows = registry.queries()["op6_language_id"](spark, SF01).collect()
    assert all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_op6_undetermined(spark, odd_dir):
    got = {r["doc_id"]: r["lang_pred"] for r in registry.queries()["op6_language_id"](spark, odd_dir).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[3] != "und"


def test_op7_held_out(spark):
    toxic = {d["doc_id"]: d["toxic"] for d in read(spark, "/root/testdata/sf0.1", "labels")}
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.col("doc_id").isin(*list(toxic))).select("doc_id", "text")
    from loomwell.llm import toxicity

    model = toxicity.fit_on(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    score = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    held = [(score[d], y) for d, y in toxic.items() if d in score and y is not None and remainder(d, 5) == 0]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good])
    assert auc > 0.94 and np.mean([s >= 0.5 for s in bad]) > 0.8 and np.mean([s >= 0.5 for s in good]) < 0.02


def test_op7_scores_are_those_of_the_model(spark, odd_dir):
    """Scores recomputed window by window without any cache; the model is the same on a second run, ids given twice included."""
    import zstandard

    from loomwell.llm import toxicity as tx

    docs, labels = (spark.read.parquet(f"{SF01}/{name}.parquet") for name in ("documents", "labels"))
    twice = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" more"))))
    models = [tx.fit_on(d, labels) for d in (docs, docs.repartition(7), twice, twice.repartition(5))]
    assert models[0].__getstate__()[:2] == models[1].__getstate__()[:2] and models[2].__getstate__()[:2] == models[3].__getstate__()[:2]
    assert np.allclose(models[0].weights, models[1].weights) and models[0].toxic != models[0].ordinary
    assert len(models[0].toxic) == len(models[0].ordinary) and len(models[0].toxic) in tx.SIZES
    settings = zstandard.ZstdCompressionParameters(window_log=17, chain_log=14, hash_log=14, search_log=5, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)

    def length(content, window):
        whole = content + tx.PADDING
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(whole, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings).compress(window + tx.PADDING))

    got = {r["doc_id"]: r["score"] for r in registry.queries()["op7_toxicity"](spark, SF01).collect()}
    for d in read(spark, SF01)[:12]:
        words = (d["text"] or "").lower().encode().split()
        saved = [length(models[0].ordinary, b" " + w + b" ") - length(models[0].toxic, b" " + w + b" ") for w in words]
        reach = [sum(x >= step for x in saved) for step in tx.STEPS]
        x = [1.0, *np.log1p(reach), *np.sqrt(np.array(reach) / (len(words) + 20.0)), np.log1p(len(words))]
        assert got[d["doc_id"]] == pytest.approx(1 / (1 + np.exp(-np.clip(np.dot(x, models[0].weights), -30, 30))), abs=1e-9)


def test_op7_is_chosen_and_calibrated_out_of_fold():
    """No document is described by dictionaries that saw it, and the taken size has the least loss."""
    from loomwell.llm import toxicity as tx

    rng = np.random.default_rng(1)
    common, rude = [f"word{i}" for i in range(60)], ["grumblesnark", "vilewretch"]
    texts = [" ".join([*rng.choice(common, 40), *(rng.choice(rude, 2) if i % 2 else ())]) for i in range(120)]
    ids, toxic = list(range(120)), [bool(i % 2) for i in range(120)]
    rows = [r for fold in range(tx.FOLDS + 1) for r in tx.fitted(ids, texts, toxic, fold).to_dict("records")]
    for r in rows:
        assert (r["fold"] == tx.FOLDS) == (r["toxic_side"] is not None) and (r["fold"] == tx.FOLDS or tx.fold_of(r["doc_id"]) == r["fold"])
    assert sum(r["fold"] < tx.FOLDS for r in rows) == 120 * len(tx.SIZES)
    held = [i for i in ids if tx.fold_of(i) == 0]
    alone = tx.dictionaries([tx.words_of(texts[i]) for i in ids if toxic[i] and i not in held], [tx.words_of(texts[i]) for i in ids if not toxic[i] and i not in held])
    told = {(r["doc_id"], r["size"]): r["x"] for r in rows if r["fold"] == 0}
    assert all(np.allclose(told[i, size], alone[size].described(texts[i])) for i in held for size in tx.SIZES)
    model = tx.chosen(rows)
    assert all((model.score(t) >= 0.5) == y for t, y in zip(texts, toxic))
    assert len(tx.chosen([]).weights) == 0 and tx.chosen([]).score("x") == 0.0


def test_op10_article_only(spark):
    import html

    got = {r["page_id"]: r["text"] for r in registry.queries()["op10_html_extract"](spark, SF01).collect()}
    for p in read(spark, SF01, "pages"):
        article = re.search("<article>(.*)</article>", p["html"], re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split("</?(?:p|h1)>", article))
        assert got[p["page_id"]] == "\n".join(b for b in blocks if b)


def test_line_dedup_keeps_columns(spark, odd_dir):
    from loomwell.llm import line_dedup

    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    done = line_dedup.dedup_lines(docs, min_docs=2)
    assert done.columns == [*docs.columns, "_lines"]
    lines = {r["doc_id"]: (r["text"], r["_lines"]["n_lines"], r["_lines"]["n_dropped"]) for r in done.collect() if r["doc_id"] is not None}
    assert lines[0] == ("", 1, 0) and lines[3] == ("", 1, 1) and lines[4] == ("", 1, 1)
    assert lines[5] == ("line\nline\n\nline", 4, 0)


@pytest.mark.parametrize("ids, n_dropped", [([7] * 10, 0), ([None] * 10, 0), ([*range(9), None, None], 0), ([*range(9), 3, 3], 0), (range(10), 1)])
def test_line_dedup_counts_documents(spark, tmp_path, ids, n_dropped):
    """Repeated rows are one document, rows without an id are none."""
    import duckdb

    rows = [(i, "line\nand more" if i == 3 else "line") for i in ids] + [(100, "Line \nother")]
    # 100 holds the line as well, so it takes nine ids beside it.
    rows = [r for r in rows if r[0] != 0]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    done = registry.queries()["op5_line_dedup"](spark, str(tmp_path)).collect()
    assert len(done) == len(rows) and {r["n_dropped"] for r in done} == {n_dropped}
    if len(set(rows)) == len(rows):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted(map(tuple, done)) == sorted(con.execute(registry.oracle_sql()["op5_line_dedup"]).fetchall())


def unusable(v):
    return not v or any(x is None or not np.isfinite(x) for x in v) or not any(v)


def brute_neighbours(rows, k=20):
    """For each query row the k nearest of the others: largest product, then smallest id."""
    rows = {(r["vec_id"], tuple(r["embedding"])) for r in rows if not unusable(r["embedding"]) and len(r["embedding"]) == 2 or len(r["embedding"] or ()) == 64}
    want = []
    for q, v in rows:
        if q is None or q % 20:
            continue
        near = sorted(((-sum(a * b for a, b in zip(v, w)), i is None, i) for i, w in rows if (i, w) != (q, v)), key=lambda x: (x[0], x[1], x[2] or 0))
        want += [(q, n + 1, i, -s) for n, (s, _, i) in enumerate(near[:k])]
    return want


def test_op13_odd(spark, odd_dir):
    got = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in registry.queries()["op13_one_bit_search"](spark, odd_dir).collect())
    assert got == Counter(brute_neighbours(read(spark, odd_dir, "embeddings"))) and len(got) > 20


@pytest.mark.parametrize("parts", [4096, 40])
def test_op13_recall(spark, monkeypatch, parts):
    """Against brute force on the given vectors; small cells, parts and slices make every query visit many."""
    from loomwell.llm import one_bit_search

    monkeypatch.setattr(one_bit_search, "PART_ROWS", parts)
    monkeypatch.setattr(one_bit_search, "CELL_ROWS", parts * 2)
    monkeypatch.setattr(one_bit_search, "SLICE_QUERIES", 8 if parts == 40 else 4096)
    rows = read(spark, SF01, "embeddings")
    got = registry.queries()["op13_one_bit_search"](spark, SF01).collect()
    want = {(q, i): s for q, _, i, s in brute_neighbours(rows)}
    assert len(got) == len(want) and [r["rank"] for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))] == list(range(1, 21)) * (len(got) // 20)
    found = [(r["query_id"], r["vec_id"]) for r in got if (r["query_id"], r["vec_id"]) in want]
    assert len(found) >= 0.99 * len(want) and all(abs(r["score"] - want[r["query_id"], r["vec_id"]]) < 1e-12 for r in got if (r["query_id"], r["vec_id"]) in want)


def test_op13_copies_and_clusters(spark):
    """A third of the rows are one vector; tight clusters let bounds rule cells out; every list is exact."""
    from loomwell.llm import one_bit_search

    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 64))
    rows = [{"vec_id": i, "embedding": (centres[0] if i % 3 == 0 else centres[i % 30] + 0.05 * rng.standard_normal(64)).astype(np.float32).tolist()} for i in range(900)]
    docs = spark.createDataFrame([(r["vec_id"], r["embedding"]) for r in rows], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in one_bit_search.search(docs).collect()}
    assert got == {(q, n): (i, round(s, 9)) for q, n, i, s in brute_neighbours(rows)}


def test_op13_estimates_keep_their_bounds():
    from loomwell.llm import one_bit_search as ob

    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 32)) * rng.uniform(0.1, 3, (2000, 1))
    model = ob.Model(x, 4, 32)
    cell, bits, scale, deviation, rest = model.code(x)
    assert bits.shape == (2000, model.bits // 8) and np.allclose(model.rotation.T @ model.rotation, np.eye(32))
    q = rng.standard_normal((50, 32))
    signs = (np.unpackbits(bits, axis=1) * 2.0 - 1) / np.sqrt(model.bits)
    off = (q @ model.rotation.T @ signs.T * scale + q @ model.centres[cell].T - q @ x.T) / np.maximum(deviation, 1e-12) / np.linalg.norm(q, axis=1)[:, None]
    assert abs(off.mean()) < 0.05 and off.std() < 1.1 and (np.abs(off) > ob.DEVIATIONS).mean() < 0.005


def test_op11_counts_one_by_one(spark, odd_dir):
    """Every order walked for every row of the odd documents."""
    from itertools import permutations

    docs, labels = read(spark, odd_dir), read(spark, odd_dir, "labels")
    first = {}
    for d in docs:
        if d["doc_id"] is not None:
            t = d["text"] or ""
            first[t] = min(first.get(t, d["doc_id"]), d["doc_id"])

    def fails(d):
        t = d["text"] or ""
        words = t.encode().split()
        e = d["doc_id"] is not None and d["doc_id"] > first[t]
        return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": e}

    said = lambda c, i: i is not None and any(r["doc_id"] == i and r[c] == 1 for r in labels)
    told = [(d["lang"] or "", fails(d), said("quality", d["doc_id"]), said("toxic", d["doc_id"])) for d in docs]
    want, shapley = {}, Counter()
    for part in {p for p, *_ in told}:
        mine = [x for x in told if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone, failing = [x for x in left if x[1][f]], [x for x in mine if x[1][f]]
                left = [x for x in left if not x[1][f]]
                only = sum(sum(x[1].values()) == 1 for x in failing)
                want[part, order, step] = (len(left), len(gone), len(failing) - len(gone), only, sum(x[2] for x in gone), sum(x[3] for x in gone))
                shapley[part, f] += len(gone)
    rows = registry.queries()["op11_filter_audit"](spark, odd_dir).collect()
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"]) for r in rows}
    assert got == want and len(rows) == len(want) and all(r["shapley"] == shapley[r["part"], r["filter_order"][r["step"] - 1]] for r in rows)


def test_op11_parts(spark, monkeypatch):
    """More parts than a task adds up at once, and words across stretches."""
    from loomwell.llm import filter_audit

    monkeypatch.setattr(filter_audit, "PARTS_AT_ONCE", 3)
    rows = [(i, "a b " * (i % 120), f"l{i % 17}") for i in range(200)]
    done = filter_audit.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(done) == 17 * 600 and sum(r["kept"] + r["removed"] for r in done if r["step"] == 1 and r["filter_order"] == "ABCDE") == 200
    text = ("word é\n" * 7 + "Xx y#z ").encode() * 50
    whole = filter_audit.text_mask(text)
    monkeypatch.setattr(filter_audit, "STRETCH", 13)
    assert filter_audit.text_mask(text) == whole and [w for x in filter_audit.stretches(text) for w in x.split()] == text.split()


def test_op12_checkpoints(spark, monkeypatch):
    """Cuts found through the index are those of the text itself, for code points and for patterns."""
    import regex

    from loomwell.llm import fill_in_middle as fim

    monkeypatch.setattr(fim, "STRETCH", 50)
    text = "aé的😀\n <x> e\u0301\u0302 " * 40
    for every in (1, 7, 1024):
        points = fim.Checkpoints(text.encode(), every)
        assert points.units == len(text) and len(points.at) == -(-len(text) // every)
        for u in range(0, len(text) + 1):
            assert points.cut(u) == (len(text[:u].encode()), u)
        for pattern in (r"\X", r"\S+\s*|\s+", r"[^\n]*\n?"):
            units = [m.start() for m in regex.finditer(pattern, text, regex.DOTALL)]
            index = fim.Checkpoints(text.encode(), every, regex.compile(pattern, regex.DOTALL))
            assert index.units == len(units)
            for u, at in [*enumerate(units), (len(units), len(text))]:
                assert index.cut(u) == (len(text[:at].encode()), at)
    long = "é" * 3_000_000
    assert fim.Checkpoints(long.encode()).cut(2_999_999) == (5_999_998, 2_999_999)


def test_op12_gives_texts_back(spark, odd_dir):
    from loomwell.llm import fill_in_middle as fim

    tricky = [(1000 + i, t, None, None, None) for i, t in enumerate(["<", "a<P", "<P>x", "x<S>y", "<M>", "<<>>" * 30, "S>", "x" * 99] * 20)]
    docs = spark.createDataFrame([(d[0], d[1]) for d in [*tricky, *odd_documents()]], "doc_id long, text string")
    for unit in (None, r"\X", r"\S+\s*|\s+"):
        rows = fim.fill_in_middle(docs, unit=unit).select("*", fim.restored(F.col("output").cast("string"), F.col("form")).alias("back")).collect()
        assert Counter((r["doc_id"], r["back"]) for r in rows) == Counter((d[0], d[1] or "") for d in [*tricky, *odd_documents()])
        assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
        for r in rows:
            if r["form"] != "plain":
                out, b = r["output"], (r["prefix_bytes"], r["middle_bytes"])
                middle = out[out.rindex(b"<M>") + 3 :]
                assert len(middle) == b[1] and len(middle.decode()) == r["middle_chars"]


def test_odd_rows_are_odd():
    assert sum(r[1] is None for r in odd_documents()) == 2
