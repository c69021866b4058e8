import random
import zlib

import pytest

SF01 = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k string, t string, v long, label long, digest string, given string, row string, body string, item_id long, a string, b string, score string, sequence_id string"


def odd_documents():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "über", "n'est", "día", "的", "😀", "x"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [None, "", " \n\t ", "one", "One", "line\nline\n\nline", prose(60), prose(60), prose(3000), "퟿\x00\x01", "<|turn|> </s> <|endoftext|>", "password=hunter2xx AKIA" + "A1" * 10, "no\r\nletters 123"]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None if t is None else len(t)))
    rows.append(rows[6])  # a repeated row
    rows.append((100, rows[6][1], "de", "s", 5))  # a copy
    rows.append((None, rows[7][1], "en", None, None))  # no id
    rows.append((None, None, None, None, None))
    return [(*r, *(["z", "z", 1, 1, "z", "z", "z", "z", 2, "z", "z", "z", "z"])) for r in rows]


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    """A folder of tables with odd rows and clashing extra columns."""
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_documents(), DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, 1, 0, "z"), (1, 1, 1, "z"), (6, 0, 1, None), (7, 1, 0, "z"), (8, None, None, "z"), (None, 0, 1, "z")], "doc_id long, quality int, toxic int, text string").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, None, 1), (1, "", 1), (2, odd_documents()[8][1][:200], 1), (2, "short", 1), (None, odd_documents()[8][1][300:500], 1)], "item_id long, text string, doc_id long").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "user", None, 1), (1, 1, "assistant", "", 1), (1, 1, "assistant", "tie", 1), (1, 1, "assistant", "tie", 1), (2, None, None, "<|end|><\\|turn|>", 1), (None, 3, "assistant", "x", 1)], "conv_id long, turn long, role string, text string, segments long").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(1, None, None, 1), (2, "", "", 1), (3, "http://h/x", "<p>a<div class=ad>b</div>", 1), (3, "http://h/x", "<p>a<div class=ad>b</div>", 1), (None, "x", "<" * 50 + "p>" * 40 + "é&amp;&#x41", 1)], "page_id long, url string, html string, host long").write.parquet(f"{d}/pages.parquet")
    vectors = [(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.6, 0.8]), (2, [0.6, 0.8]), (20, [0.6, 0.8]), (40, [0.0, 1.0]), (40, [1.0, 1.0]), (None, [2.0, 0.0]), (None, None), (3, None), (60, None), (4, [0.0, 0.0]), (5, [1.0, None]),
               (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (80, [1e30, -1e30]), (-20, [-1.0, 0.0])]
    spark.createDataFrame([(*r, 1, 1, [1.0], "z") for r in vectors], "vec_id long, embedding array<float>, label int, part int, v array<double>, score string").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="session")
def empty_dir(spark, odd_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    for name in ("documents", "labels", "benchmark", "conversations", "pages", "embeddings"):
        spark.read.parquet(f"{odd_dir}/{name}.parquet").limit(0).write.parquet(f"{d}/{name}.parquet")
    return d


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n
