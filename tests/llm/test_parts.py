"""Inner parts: the image format, the network, the packing plan, alignment, parsing, the pipeline's stages."""

import html
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from loomwell.llm import chat_format, decontaminate, html_extract, language_id, line_dedup, near_dedup, packing, secret_scan, toxicity, vp8l
from tests.conftest import SF
from tests.llm.test_contracts import brute_groups, check_packing, least_edits


@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (0, 1, 2), (3,), (3, 0)])
@pytest.mark.parametrize("cache, references", [(0, False), (5, True)])
def test_image_round_trip(transforms, cache, references):
    rng = np.random.default_rng(len(transforms) + cache)
    colours = rng.integers(0, 1 << 32, 3 if 3 in transforms else 500, np.uint32)
    pixels = colours[rng.integers(0, len(colours), (13, 21))]
    pixels[5:9] = pixels[1:5]
    data = vp8l.encode(pixels, transforms, cache_bits=cache, references=references)
    assert (vp8l.decode(data) == pixels).all()


@pytest.mark.parametrize("colours", [1, 2, 4, 16, 17, 256])
def test_palette_sizes(colours):
    pixels = (np.arange(31 * 9, dtype=np.uint32) % colours * np.uint32(0x01020305) | np.uint32(0xFF000000)).reshape(9, 31)
    assert (vp8l.decode(vp8l.encode(pixels, (3,))) == pixels).all()


def test_plain_images_are_ordinary_files():
    rng = np.random.default_rng(3)
    images = [rng.integers(0, k, (n, 64), np.uint8) for k, n in ((1, 1), (2, 3), (256, 40), (90, 200))] * 15
    files = vp8l.encode_batch(images)
    assert all((a == b).all() for a, b in zip(vp8l.decode_batch(files), images))
    assert ((vp8l.decode(files[2]) >> 8 & 255) == images[2]).all()


def test_broken_images_are_refused():
    with pytest.raises(ValueError):
        vp8l.decode(b"RIFF0000WEBP")
    data = vp8l.encode(np.zeros((4, 4), np.uint32))
    with pytest.raises(ValueError):
        vp8l.decode(b"RIFF" + data[4:8] + b"WEBPVP8X" + data[16:])


def test_network_gradient():
    net = language_id.Network(["a", "b"], states=3, seed=1)
    for part in (net.forward.w, net.backward.w, net.out):
        for k in part:
            part[k] = part[k].astype(np.float64)
    symbols = np.random.default_rng(0).integers(0, 5, (6, 4)).astype(np.int16)
    symbols[5, 1] = language_id.PAD
    answer = np.array([0, 1, 1, 0])
    seen = {}

    class Keep:
        def update(self, weights, grads):
            seen["grads"] = grads

    net.train_step(symbols, answer, Keep())
    rng = np.random.default_rng(1)
    for part, grad in zip((net.out, net.forward.w, net.backward.w), seen["grads"]):
        for k, w in part.items():
            for _ in range(6):
                at = (rng.integers(w.shape[0]), rng.integers(5 if k == "input" else w.shape[1]))
                keep, step, loss = w[at], 1e-2, []
                for d in (step, -step):
                    w[at] = keep + d
                    loss.append(net.train_step(symbols, answer, type("No", (), {"update": lambda *_: None})()))
                w[at] = keep
                assert (loss[0] - loss[1]) / (2 * step) == pytest.approx(grad[k][at], abs=2e-3)


def test_pooling_is_by_byte():
    net = language_id.Network(["a", "b"])
    p = net.pooled([b"", b"x" * 300, b"y"])
    assert p[0].sum() == 0 and p[1].sum() == pytest.approx(1, abs=1e-4) and p[2].sum() == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece(seed):
    rng = random.Random(seed)
    counts = {n: rng.randrange(1, 40) for n in rng.sample(range(1, 101), 20)}
    used = {}
    for lengths, times in packing.plan(counts, 100):
        assert sum(lengths) <= 100 and times > 0
        for n in lengths:
            used[n] = used.get(n, 0) + times
    assert used == counts


def test_plan_finds_triples():
    assert packing.plan({50: 1, 20: 1, 17: 1, 13: 1}, 100) == [((50, 20, 17, 13), 1)]


def edit_distance_inside(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_are_those_within_the_budget():
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n)).strip() or "a"
    passages = [text(n) for n in (60, 90, 150)]
    block = decontaminate.Block(list(enumerate(passages)))
    for trial in range(60):
        k = trial % 3
        p, budget = passages[k], decontaminate.edits_allowed(len(passages[k]))
        chars = list(p)
        for _ in range(rng.randrange(0, budget + 3)):
            at = rng.randrange(len(chars))
            rng.choice((lambda: chars.pop(at), lambda: chars.insert(at, "z"), lambda: chars.__setitem__(at, "q")))()
        whole = text(rng.randrange(1, 80)) + "".join(chars) + text(rng.randrange(1, 80))
        best = edit_distance_inside(p, whole)
        got = [r[1] for r in block.found(whole) if r[0] == k]
        assert got == ([best] if best <= budget else [])


def test_short_passages_are_found_between_word_limits():
    items = [(1, "what is rain"), (1, "what is rain"), (2, "rain"), (3, "x"), (4, ""), (5, "what is rain made of"), (6, "a" * 39), (7, "b" * 40)]
    block = decontaminate.Block(items)
    assert sorted(block.found("so what is rain what is rain")) == [(1, 0, 3, 15, 12), (1, 0, 3, 15, 12), (2, 0, 11, 15, 4)]
    assert block.found("somewhat is rainy xx") == [] and block.found("") == []
    assert [r[:2] for r in block.found("x" + "a" * 39 + "yy")] == [(6, 2)]  # the spaces are edits
    assert sorted(block.found("x " + "a" * 39 + " " + "b" * 40)) == [(3, 0, 0, 1, 1), (6, 0, 2, 41, 39), (7, 0, 42, 82, 40)]
    assert block.holds_any("it rain") and not block.holds_any("so what is grain")


@pytest.mark.parametrize("passage", ["what is rain", "how is it made", "why do leaves fall in autumn now", "the tallest tower of all towns stands"])
def test_short_passages_within_the_budget(passage):
    """Passages of 12 to 38 characters against texts with edited copies: found when a stretch between spaces is within the budget."""
    rng, block, most = random.Random(len(passage)), decontaminate.Block([(1, passage)]), decontaminate.edits_allowed(len(passage))
    found = 0
    for trial in range(200):
        chars = list(passage)
        for _ in range(trial % 5):
            at = rng.randrange(len(chars))
            chars[at] = rng.choice(["", "z", chars[at] + "k"])
        text = decontaminate.normalised("some words here " * rng.randrange(3) + "".join(chars) + " and more" * rng.randrange(3))
        best = least_edits(f" {passage} ", f" {text} ")
        got = block.found(text)
        assert [r[1] for r in got] == ([best] if best <= most else [])
        assert all(0 <= r[2] <= r[3] <= len(text) for r in got)
        found += len(got)
    assert 20 < found < 190


def test_many_copies_and_repetitive_texts_stay_cheap(monkeypatch):
    import time

    rng = random.Random(2)
    text = lambda n, of="abcdefghijklmnop ": "".join(rng.choice(of) for _ in range(n)).strip()
    passage = text(230)
    block = decontaminate.Block([(1, passage)])

    def edited(n):
        chars = list(passage)
        for at in rng.sample(range(len(chars)), n):
            chars[at] = rng.choice("qrstuv")
        return "".join(chars)

    copies = " ".join(edited(5 + k % 12) for k in range(400))
    began = time.perf_counter()
    (row,) = block.found(copies)
    assert row[1] == 5 and time.perf_counter() - began < 1
    many = decontaminate.Block([(k, text(k + 80, "ab ")) for k in range(100)])
    began = time.perf_counter()
    whole = many.found(text(20_000, "ab "))
    assert time.perf_counter() - began < 20
    # In small parts the same rows come out.
    for name in ("CHUNK_CHARS", "PAIRS", "DIAGONALS"):
        monkeypatch.setattr(decontaminate, name, 1000)
    assert block.found(copies) == [row]
    assert many.found(copies) == [] and whole is not None


def test_several_blocks_are_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    items = [(i, f"the question number {i} asks for the name of thing {i * i}") for i in range(5)]
    docs = spark.createDataFrame([(i, f"so {t}, yes") for i, t in items[:4]] + [(9, "clean"), (10, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect() if r["edits"] == 0} == {(i, i) for i in range(4)}
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()) == [9, 10]


def test_short_passages_reach_the_tasks(spark):
    docs = spark.createDataFrame([(1, "Why, is it RAINING?"), (2, "is it")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "Is it raining"), (8, None), (9, " ? ")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.find_leaks(docs, bench).collect()] == [(1, 7, 0, 4, 17, 13)]
    assert [r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()] == [2]


def test_chat_parts(spark):
    parts = [("text", "see <|image|> <\\|end|>", None, None, None, None, None), ("image", None, "i.png", 57, 28, None, None), ("audio", None, "a.wav", None, None, 1.5, None), None, ("hologram", "x", None, None, None, None, None), ("document", None, "d.pdf", None, None, None, 3)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None, None, None, None)]), (1, 2, "user", None)], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    r = chat_format.format_chats(turns).withColumn("turns", chat_format.read_turns(chat_format.F.col("formatted"))).withColumn("loss", chat_format.loss_text(chat_format.F.col("segments"))).first()
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "i.png", 3), ("audio", "a.wav", 38), ("document", "d.pdf", 3072)]
    assert r["n_attachment_tokens"] == 3113 and r["loss"] == "ok" and len(r["turns"]) == 3
    assert r["turns"][0]["text"] == "see <|image|> <\\|end|><|image|><|audio|><|document|>"
    assert r["formatted"].count("<|end|>") == 3


def test_secret_kinds():
    key = "q7Xk2mPz9Rt4Wv8Lb3Nc6Jd1"
    base, spans = secret_scan.scan(f"id {key} done")
    assert base == [] and secret_scan.listed(spans) == f"random:3:{3 + len(key)}"
    assert secret_scan.scan("internationalization_of_documentation and d41d8cd98f00b204e9800998ecf8427e")[1] == secret_scan.scan("internationalization_of_documentation and d41d8cd98f00b204e9800998ecf8427e")[0]
    assert secret_scan.scan("")[1] == [] and secret_scan.scan(None)[1] == []


def test_random_letters_of_one_case_are_measured():
    for run in ("xqzvkjwpfhgtrnbvcxzqwkjd", "XQZVKJWPFHGTRNBVCXZQWKJD", "xqzvkj-wpfhgt-rnbvcx-zqwkjd"):
        assert secret_scan.listed(secret_scan.scan(f"pass {run} end")[1]) == f"random:5:{5 + len(run)}"
    for run in ("internationalization_of_documentation", "CONFIGURATION_DIRECTORY_NAME", "getConnectionFactoryBuilder", "docs/reference/configuration", "antidisestablishmentarianism"):
        assert secret_scan.scan(f"see {run} there")[1] == []


def test_bound_of_early_dropping():
    """No pair at the threshold is dropped with more than the chosen probability."""
    from math import comb

    for n, least in near_dedup.least_matches(85):
        assert sum(comb(n, m) * 0.85**m * 0.15 ** (n - m) for m in range(least)) < 2e-7


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><nav>m</nav><article><h1>T</h1><p>a  b<p>c<br>d</article><footer>f</footer>", "T\na b\nc d"),
        ("<div class='cookie-notice'>x</div><div><p>main</p></div><aside>y</aside>", "main"),
        ("<script>var a='<p>no</p>'</script><p>yes &lt;b&gt; &amp;&#65;</p><!-- <p>no -->", "yes <b> &A"),
        ("<article><p>a</p><section id='comments'><p>c</p></section><form>f</form></article>", "a"),
        ("<main><ul><li>one<li>two</ul></main><div>out</div>", "one\ntwo"),
        ("plain", "plain"), ("", ""), (None, ""), ("<p>a</b></div></p>b", "a\nb"), ("<table><tr><td>x<td>y</table>", "x\ny"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("attributes", ["style='overflow:hidden'", "style=overflow:hidden", "alt='a hidden valley'", "data-id='menu-1'", "data-class=nav", "title='x class=ad role=menu'", "data-hidden", "aria-hidden=false", "aria-hidden", "class=text class=ad", 'title="class=ad'])
def test_attributes_are_whole(attributes):
    """Words inside other attributes' names and values condemn nothing; the named attributes themselves do."""
    for tag in ("body", "article", "div"):
        assert html_extract.main_text(f"<{tag} {attributes}><p>all the text</p></{tag}>") == "all the text"
    for real in ("hidden", "HIDDEN=''", "aria-hidden='true'", "role=menu", "class='x ad'", "alt=x id=menu", "data-x='a'class=ad"):
        assert html_extract.main_text(f"<div {real}>gone</div><p>all the text</p>") == "all the text"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html class='no-js cookie'><body class='home no-sidebar menu'><p>all the text</p></body>", "all the text"),
        ("<div class='has-sidebar content'><p>all</p></div><div id='main-with-menu'><p>the text</p></div><div class='sidebar'>x</div>", "all\nthe text"),
        ("<article class='post social-history'><p>all the text</p></article><div>x</div>", "all the text"),
        ("<main class='banner'><p>all the text</p></main>", "all the text"),
        ("<div id='widget'><main><p>all the text</p></main></div><div>x</div>", "all the text"),
        ("<div class='banner-page'><article><p>all the text</p></article></div><div>x</div>", "all the text"),
        ("<div class='related'><article>x</article></div><p>all the text</p>", "x\nall the text"),
        ("<form><header><main><p>all the text</p></main></header></form><footer>f</footer>", "all the text"),
        ("<div class='social-history'><p>the text and most of it</p></div><p>short</p><div class='social'>x</div>", "the text and most of it\nshort"),
        ("<article><h1>T</h1><div class='overlay'><p>all the text</p></div></article>", "T\nall the text"),
        ("<article><p>all</p><div class='comments'>longer than the text itself</div></article>", "all"),
        ("<div class='comments'><p>all the text</p></div><nav>m</nav>", "all the text"),
        ("<div class='related'><article>x</article></div><article>all the text</article>", "all the text"),
        ("<aside><article>x</article></aside><article>all</article>", "all"),
        ("<article><p>a</p><div class='related-work'><p>b</p></div></article>", "a\nb"),
        ("<main><div class='social-history'><p>all the text</p></div></main>", "all the text"),
        ("<p>teaser</p><article>card</article><div class='body'>main text and most of it</div>", "teaser\ncard\nmain text and most of it"),
        ("<article><p>all the text</p><div class='ad-slot'>x</div><div class='related posts'>y</div><div id='share-buttons'>z</div></article>", "all the text"),
    ],
)
def test_class_words_are_guesses(page, text):
    assert html_extract.main_text(page) == text


def test_style_tree_finds_repeated_branches(spark):
    """On one host a box without telling marks repeats; on another it differs from page to page."""
    rows = []
    for i in range(12):
        words = " ".join(f"w{i}x{j}" for j in range(30))
        rows.append((i, "http://same.org/a", f"<body><div class='zone'>Follow our channel</div><div class='body'><p>{words}</p></div>"))
        rows.append((100 + i, "http://other.org/a", f"<body><div class='zone'>told {i} once</div><div class='body'><p>{words}</p></div>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(pages).collect()}
    for i, _, source in rows:
        body = html.unescape(source.split("<p>")[1].split("</p>")[0])
        assert got[i] == (body if i < 100 else f"told {i - 100} once\n{body}")


def test_style_tree_keeps_pages_that_are_copies(spark):
    pages = spark.createDataFrame([(i, "http://h/x", "<body><div class='zone'><p>all the text there is</p></div>") for i in range(20)], "page_id long, url string, html string")
    assert {r["text"] for r in html_extract.extract_main_text(pages).collect()} == {"all the text there is"}


def test_style_tree_judges_text_blocks_and_comes_first(spark):
    """Notices in articles, text beside an article, copies and near copies, all without telling names."""
    words = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows, want = [], {}

    def add(host, source, text):
        rows.append((len(rows), f"http://{host}/a", source))
        want[len(rows) - 1] = text

    for i in range(12):
        add("notices", f"<article><p>{words(i, 30)}</p><p>All rights are ours</p><ul><li>Write to us<li>item {i}</ul></article>", f"{words(i, 30)}\nAll rights are ours\nWrite to us\nitem {i}")
        add("beside", f"<article><p>{words(i, 30)}</p></article><div class='zone'><p>told {i} once</p></div><div class='box'><p>Follow us</p></div>", f"{words(i, 30)}\ntold {i} once")
        add("copies", "<article><p>all the text there is</p></article>", "all the text there is")
        add("near", f"<article><p>all the text there is</p><p>{i}</p></article>", f"all the text there is\n{i}")
    for i in range(4):
        add("copies", f"<article><p>{words(i, 30)}</p></article>", words(i, 30))
    add("single", "<article><p>a</p><p>All rights are ours</p></article><div>x</div>", "a\nAll rights are ours")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract_main_text(pages).collect()} == want


def recipe_pages():
    """Two hosts whose articles share headings, lines and boxes; one has furniture within and around the article."""
    rows, want = [], {}
    words = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    for i in range(12):
        rows.append((i, "http://dishes/a", f"<body><article><h1>Dish {i}</h1><h2>Ingredients</h2><p>{words(i, 20)}</p><h2>Method</h2><p>{words(100 + i, 20)}</p><p>Serves four.</p></article></body>"))
        want[i] = f"Dish {i}\nIngredients\n{words(i, 20)}\nMethod\n{words(100 + i, 20)}\nServes four."
        box = "<div class='facts'><p>Open daily from nine.</p><p>yes</p></div>"
        more = "<div class='q'><a href='/x'>See all offers</a> <a href='/y'>Get the app</a></div>"
        for k, (begin, end) in enumerate((("<article>", "</article>"), ("<div class='story'>", "</div>"))):
            rows.append((100 * (k + 1) + i, f"http://places{k}/a", f"<body><div class='zone'>Follow our channel</div>{begin}<h1>Place {i}</h1>{box}<p>{words(i, 30)}</p>{more}<p>The end.</p>{end}<div class='low'>Made by us</div></body>"))
            want[100 * (k + 1) + i] = f"Place {i}\nOpen daily from nine.\nyes\n{words(i, 30)}\nThe end."
    return rows, want


@pytest.mark.parametrize("most", [100_000, 0])
def test_style_tree_keeps_what_articles_share(spark, monkeypatch, most):
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", most)
    rows, want = recipe_pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract_main_text(pages).collect()} == want


def test_style_tree_importances_are_the_model(spark):
    """Importances of all nodes of the given pages, from plain counts of pages."""
    path = "/root/testdata/sf0.01/pages.parquet"
    hosts = {}
    for r in spark.read.parquet(path).collect():
        blocks = html_extract.parse(r["html"])
        host = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", r["url"] or "")
        elements = {e.path: tuple(e.children) for b in blocks for e in [*html_extract.chain(b.element)][::-1]}
        hosts.setdefault(host[1].lower() if host else "", {})[tuple(b.text for b in blocks)] = (elements, {(b.element.path, b.text) for b in blocks})
    want = {}
    for host, pages in hosts.items():
        styles, texts = {}, {}
        for elements, blocks in pages.values():
            for p, children in elements.items():
                styles.setdefault(p, Counter())[children] += 1
            for p, text in blocks:
                texts.setdefault(p, Counter())[text] += 1
        pages_of = {p: sum(c.values()) for p, c in styles.items()}
        for p, m in pages_of.items():
            if m < 2:
                continue
            own = sum(-n / m * math.log(n / m, m) for n in styles[p].values())
            below = [1 - math.log(k, pages_of[q]) for q, c in texts.items() if (q == p or q.startswith(p + "/")) and pages_of.get(q, 0) > 1 for k in c.values() for _ in range(k)]
            content = sum(below) / len(below) if below else 1.0
            want[host, p] = 1 - (1 - content) * (1 - own)
    tree, _ = html_extract.style_tree(spark.read.parquet(path))
    got = {(r["host"], r["path"]): r["importance"] for r in tree.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def furnished_pages(marks):
    """Forty pages of one host whose menu, advert and footer come from some dozen texts each; articles of changing build."""
    rng, rows, want = random.Random(8), [], {}
    texts = [" ".join(f"t{k}w{j}" for j in range(8)) for k in range(12)]
    for i in range(40):
        paragraphs = [" ".join(f"w{i}x{j}y{k}" for j in range(30)) for k in range(1 + i % 7)]
        nav, ad, foot = (rng.choice(texts) for _ in range(3))
        menu = "".join(f"<li>{w}" for w in nav.split()[: 3 + i % 3])
        body = "".join(f"<p>{x}</p>" for x in paragraphs)
        rows.append((i, "http://h/a", f"<body><div class={marks[0]}><ul>{menu}</ul></div><div class={marks[1]}>{ad}</div><div class=b><h1>title {i}</h1>{body}</div><div class={marks[2]}>(c) {foot}</div></body>"))
        want[i] = "\n".join([f"title {i}", *paragraphs])
    return rows, want


@pytest.mark.parametrize("most", [100_000, 0])
def test_style_tree_alone_removes_furniture(spark, monkeypatch, most):
    """Without any furniture words or tags the tree finds menus, adverts and footers that recur but are not the same on all pages."""
    for name in ("FURNITURE_WORDS", "FURNITURE_TAGS", "FURNITURE_ROLES", "ARTICLE"):
        monkeypatch.setattr(html_extract, name, frozenset())
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", most)
    rows, want = furnished_pages(("x", "y", "z"))
    rows += [(100, None, "<body><p>other</p>"), (101, "http://h/a", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract_main_text(pages).collect()} == want | {100: "other", 101: ""}


def test_style_tree_finds_branches_of_the_given_pages(spark):
    """The tree removes menus, adverts and footers there, and no article loses text to it."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    told = html_extract.verdicts(pages).where("repeated is null and not important").collect()
    assert len(told) > 10 and all(any(x in r["path"] for x in ("/nav", "/div.ad", "/footer")) for r in told)


def test_joined_verdicts_are_the_sent_ones(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = lambda: sorted((r["page_id"], r["text"]) for r in html_extract.extract_main_text(pages).collect())
    sent = texts()
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", 0)
    assert texts() == sent


def fit(toxic, ordinary):
    """The model of labelled texts, fold by fold."""
    texts = [*toxic, *ordinary]
    told = [i < len(toxic) for i in range(len(texts))]
    return toxicity.chosen([r for fold in range(toxicity.FOLDS + 1) for r in toxicity.fitted(list(range(len(texts))), texts, told, fold).to_dict("records")])


def test_toxicity_without_labels():
    model = fit([], ["a"])
    assert model.score("x") == 0.0 and fit(["bad words"] * 9, ["good words"] * 9).score(None) < 1


def test_step_removes_its_tables_only(spark, tmp_path):
    """Also when it fails; tables of a step in another thread and those made outside of steps stay."""
    import threading

    from loomwell.functions import tables
    from loomwell.llm import common

    made, inside = [], threading.Event()
    path = lambda df: df.inputFiles()[0].rsplit("/", 1)[0]
    outside = path(common.checkpointed(spark.range(3).repartition(1)))

    def other():
        with common.step(spark):
            made.append(path(common.checkpointed(spark.range(4).repartition(1))))
            inside.wait(60)
            made.append(tables.exists(spark, made[0]))

    thread = threading.Thread(target=other)
    thread.start()
    with pytest.raises(ZeroDivisionError), common.step(spark):
        mine = path(common.checkpointed(spark.range(5).repartition(1)))
        raise ZeroDivisionError
    inside.set()
    thread.join()
    assert made[1] and not tables.exists(spark, mine) and not tables.exists(spark, made[0]) and tables.exists(spark, outside)


def test_toxicity_learns_from_whole_texts():
    """A text of 50000 characters that only swears at its end teaches the word."""
    plain = [" ".join(f"w{(7 * i + j) % 991}" for j in range(400)) for i in range(40)]
    long = " ".join(f"w{j % 991}" for j in range(9000))
    model = fit([f"{long} blastedly {p} blastedly" for p in plain[:12]], [*plain[12:], long])
    assert len(long) > 40_000 and model.difference(b"blastedly") >= 4
    assert model.score(f"{plain[30]} blastedly") > 2 * model.score(plain[30])


def test_telling_words_are_those_of_plain_counts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 8))).encode()
    good, bad = [[[word() for _ in range(rng.randrange(0, 150))] for _ in range(n)] for n in (60, 20)]
    for words in bad:
        words[::17] = [b"xyzzyx"] * len(words[::17])
    good[3] += [b"xyzzyx"]
    marked, known = toxicity.telling_words(bad, good)
    stretches = lambda texts: [words[k : k + toxicity.STRETCH] for words in texts for k in range(0, len(words), toxicity.STRETCH)]
    pieces = lambda words: {w[i : i + n] for w in (b" " + w + b" " for w in words) for n in toxicity.GRAMS for i in range(len(w) - n + 1)}
    of_bad, of_good = [pieces(s) for s in stretches(bad)], [pieces(s) for s in stretches(good)]
    telling = set()
    for p in set().union(*of_bad):
        n, e = sum(p in s for s in of_bad), (sum(p in s for s in of_good) + 0.5) * len(of_bad) / len(of_good)
        if n > toxicity.RATIO * e and n - e > toxicity.SURE * (e + 1) ** 0.5 and sum(p in pieces(w) for w in bad) >= toxicity.LEAST_DOCUMENTS:
            telling.add(p)
    assert [bool(pieces([w]) & telling) for words in bad for w in words] == marked.tolist() and marked.any()
    assert known == {b"xyzzyx"} == {w for words in good for w in words if pieces([w]) & telling}


def brute_lines(docs, least):
    key = lambda x: x.strip(line_dedup.BLANKS).translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    n = {}
    for d in docs:
        for x in {key(x) for x in (d["text"] or "").split("\n")}:
            n[x] = n.get(x, 0) + 1
    return {d["doc_id"]: "\n".join(x for x in (d["text"] or "").split("\n") if not (key(x) and n[key(x)] >= least)) for d in docs}


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs, steps = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        steps[name] = before, [r.asDict() for r in docs.collect()]
        if name != "packing":
            assert docs.columns == columns
    model = toxicity.fit_on(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    before, after = steps["toxicity"]
    assert ids(after) == ids(d for d in before if model.score(d["text"]) < 0.5) and len(after) < len(before)
    before, after = steps["line_dedup"]
    assert {d["doc_id"]: d["text"] for d in after} == brute_lines(before, 10)
    before, after = steps["near_dedup"]
    assert ids(after) == sorted(d for d, (_, c) in brute_groups(before, 80).items() if d == c)
    before, after = steps["decontamination"]
    items = [decontaminate.normalised(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    near = lambda i, t: i in t or any(least_edits(i, t[max(0, k - len(i)) : k + 2 * len(i)]) <= decontaminate.edits_allowed(len(i)) for k in range(0, len(t), len(i)))
    clean = ids(d for d in before if not any(i in decontaminate.normalised(d["text"]) for i in items))
    lost = set(clean) - set(ids(after))
    assert set(ids(after)) <= set(clean) and all(any(near(i, decontaminate.normalised(d["text"])) for i in items) for d in before if d["doc_id"] in lost)
    before, after = steps["packing"]
    check_packing(after, before)


def test_pipeline_of_nothing(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_pipeline_of_odd_rows(spark, odd_dir):
    assert corpus_pipeline.run(spark, odd_dir).count() > 0
