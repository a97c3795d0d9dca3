"""Declared languages and page evidence rebuilt by hand, rows with odd ids in vector searches, locations of shared folders."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import ann_forest, common, language_id

PAGES = [
    ("<html " + "data-x='" + "y" * 5000 + "' lang=fr>text", "fr"), ('<html data-a="a>b" lang="de-AT">', "de"), ("<!-- <html lang=fr> --><html lang='es'>", "es"),
    ("<script>var s = '<html lang=\"fr\">';</script><html xml:lang=EN>", "en"), ("<p title='<html lang=fr>'>x<html lang=de>", "de"),
    ('<META content="es, en" HTTP-EQUIV=Content-Language><p>', "es"), ('<meta name="content-language" content=fr><html lang="de">', "de"), ("<html lang=''><meta http-equiv=content-language content=es>", "es"),
    ("<htmlx lang=fr>", ""), ("<html lang>", ""), ("<html lang=7>", ""), ("<html data-lang=fr>", ""), ("<!-- <html lang=fr>", ""), ("a < b <html\nlang = fr >", "fr"), ("", ""), ("<", ""), ("<html lang='fr", "fr"),
    ("<style>x</style><html lang=it>", "it"), ("<html lang=de lang=fr>", "de"), ("</html lang=fr>", ""), ("<html/lang=fr>", "fr"),
]


@pytest.mark.parametrize(("html", "code"), PAGES)
def test_declared_language(html, code):
    assert language_id.declared_language(html) == code


def test_declared_language_takes_linear_time():
    import time

    for part in ("<html lang", '<a b="', "<!--", "<script>", "<html a='", "<p x=\"'", "< <", "<html lang="):
        began = time.perf_counter()
        language_id.declared_language(part * 200_000)
        assert time.perf_counter() - began < 20, part


def test_evidence_by_hand(spark):
    """Trigrams, text likelihoods, declared codes and addresses of pages, counted again in plain Python."""
    docs = spark.createDataFrame([("The stone and the river.", "en"), ("der Fluß und der Stein", "de"), ("la piedra", "es"), (None, "fr"), ("x", "xx")], "text string, lang string")
    rows = [
        (1, "https://user@WWW.Example.co.uk:80/de/x", "<html lang=es><head>no</head><p>the &amp; river<script>der</script></p>"), (2, None, "<p>der Stein"), (3, "ftp://h/fr?x", None),
        (4, "http://a.b.example.com/x/de/", "<html lang=zz>la"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")

    def bucket(a, b, c):
        m = 0xFFFFFFFF
        x = (ord(a) * 0x9E3779B1 & m) ^ (ord(b) * 0x85EBCA77 & m) ^ (ord(c) * 0xC2B2AE3D & m)
        x = (x ^ x >> 15) * 0x2C1B3C6D & m
        return x >> 19

    def trigrams(text):
        plain = "".join(ch if "a" <= ch <= "z" or ord(ch) >= 0xAA else " " for ch in text.lower())
        return Counter(bucket(*plain[i : i + 3]) for i in range(len(plain) - 2) if plain[i : i + 3].strip())

    logs = []
    for lang in language_id.LANGUAGES:
        counts = sum((trigrams(r["text"]) for r in docs.collect() if r["lang"] == lang and r["text"]), Counter())
        whole = sum(counts.values()) + 0.5 * language_id.BUCKETS
        logs.append(lambda b, counts=counts, whole=whole: math.log((counts[b] + 0.5) / whole))
    texts = {1: "   the & river  ", 2: " der Stein", 3: "", 4: " la"}
    want = {1: ("www.example.co.uk", "example.co.uk", "uk", "es", "de"), 2: ("", "", "", "none", "none"), 3: ("h", "", "h", "none", "fr"), 4: ("a.b.example.com", "example.com", "com", "none", "none")}
    got = {r["page_id"]: r for r in language_id.page_evidence(pages, language_id.text_model(docs)).collect()}
    for i, r in got.items():
        assert (r["host"], r["domain"], r["suffix"], r["declared"], r["in_address"]) == want[i]
        assert np.allclose(r["text_log"], [sum(n * log(b) for b, n in trigrams(texts[i]).items()) for log in logs])


def test_rows_with_null_and_repeated_ids_take_part(spark):
    one = [1.0] * 8
    rows = [(20, one), (None, [9.0] * 8), (7, [8.0] * 8), (7, [7.0] * 8), (8, [6.0] * 8), (20, [2.0] * 8), (None, None), (9, [0.0] * 8), (10, [float("nan")] * 8), (11, [1.0, None] * 4)]
    got = ann_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", F.desc("score")).collect()
    lists = {}
    for r in got:
        lists.setdefault((r["query_id"], r["rank"]), []).append((r["vec_id"], r["score"]))
    assert set(lists[20, 1]) == {(None, 72.0), (None, 144.0)}
    assert {x[1] for x in lists[20, 2]} == {64.0, 128.0} and {x[1] for x in lists[20, 3]} == {56.0, 112.0} and {x[1] for x in lists[20, 5]} == {16.0}
    assert len(got) == 10 and sum(r["vec_id"] is None for r in got) == 2


def test_clustered_vectors_with_odd_ids_keep_recall(spark):
    rng = random.Random(2)
    np_rng = np.random.default_rng(2)
    centres = np_rng.standard_normal((40, 16))
    x = centres[np_rng.integers(0, 40, 3000)] + 0.2 * np_rng.standard_normal((3000, 16))
    ids = [rng.choice([None, i, i, i // 2]) for i in range(3000)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = ann_forest.nearest(table, F.col("vec_id") % 100 == 0, 10).collect()
    queries = [k for k, i in enumerate(ids) if i is not None and i % 100 == 0]
    scores = x @ x.T
    want = Counter()
    for k in queries:
        order = np.argsort(-np.delete(scores[k], k))[:10]
        want.update((ids[k], round(float(s), 6)) for s in np.delete(scores[k], k)[order])
    met = Counter((r["query_id"], round(r["score"], 6)) for r in got)
    assert len(got) == 10 * len(queries) and sum((met & want).values()) >= 0.9 * sum(want.values())


def test_locations(tmp_path):
    from pyarrow import fs

    for uri in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        store, path = common.filesystem(uri)
        assert isinstance(store, fs.LocalFileSystem) and path == str(tmp_path)
    store, path = common.filesystem("s3a://bucket/key?region=us-east-1")
    assert store.type_name == "s3" and path == "bucket/key"
    with pytest.raises(ValueError, match="dbfs"):
        common.filesystem("dbfs:/x")
