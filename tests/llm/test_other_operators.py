"""Archives, token files, piece codec, classifier, languages, neighbours and the pipeline, on odd rows."""

import gzip
import hashlib
import io
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import ann_forest, factorization, language_id, packing, sentencepiece_codec, token_file, tokens, warc
from quillspark.llm.common import small_batches, work_dir
from quillspark.llm.tokens import encoder, tokenizer_path
from tests.llm import fixtures


@pytest.fixture(scope="module")
def docs(spark):
    return fixtures.documents(spark).cache()


# -- archives -----------------------------------------------------------------------------------

LONG = "<html lang='de'>" + "ä text " * 300
PAGES = [
    (1, "http://a.example.de/x y", LONG), (2, "http://a.example.de/2", LONG), (7, None, LONG), (3, "u", "short"), (4, "u", "short"), (5, "u", None),
    (6, "u", ""), (-8, "u\r\nX: y", LONG + "!"), (7, "again", LONG), (None, "n", LONG), (9, "big", "z" * 300_000),
]


def pages_table(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("mine"))


def test_archives_come_back(spark):
    manifest = warc.write_archives(pages_table(spark), work_dir(spark, "w"))
    got = Counter(tuple(r) for r in warc.read_archives(manifest).drop("url", "error").collect())
    want = Counter()
    for page_id, _, html in PAGES:
        payload = (html or "").encode()
        revisit = html == LONG and page_id != 7
        want[(page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None, True)] += 1
    assert got == want
    empty = warc.write_archives(pages_table(spark).limit(0), work_dir(spark, "w"))
    assert warc.read_archives(empty).count() == 0


def test_every_record_is_a_member_of_its_own():
    members = [warc.record(i, "http://x", b"p" * n, None, "2020-01-01T00:00:00Z") for i, n in enumerate((0, 5, 200_000))]
    for m in members:
        assert gzip.decompress(m).startswith(b"WARC/1.1\r\n")
    got = list(warc.read_records(io.BytesIO(b"".join(members)), with_payload=True))
    assert [len(r["payload"]) for r in got] == [0, 5, 200_000] and all(r["digest_ok"] for r in got)


def test_damage_is_noticed():
    whole = gzip.decompress(warc.record(1, "u", b"payload", None, "d"))
    changed = gzip.compress(whole.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))
    assert [r["digest_ok"] for r in warc.read_records(io.BytesIO(changed))] == [False]
    for broken in (whole + b"x", whole[:-6], whole.split(b"\r\n\r\n")[0], b"no record\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(gzip.compress(broken))))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(gzip.compress(whole)[:-20])))


def foreign(kind, block, *fields, length=None):
    head = [f"WARC-Type: {kind}", *fields, f"Content-Length: {len(block) if length is None else length}"]
    return gzip.compress(("WARC/1.0\r\n" + "\r\n".join(head)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_archives_of_others(spark, tmp_path):
    """No digests, digests of other kinds, records that are no HTTP messages, and broken ones between good ones."""
    page = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    http = "Content-Type: application/http; msgtype=response"
    md5, sha = hashlib.md5(b"body").hexdigest(), hashlib.sha256(page).hexdigest()
    members = [
        foreign("warcinfo", b"software: x\r\n\r\nmore", "Content-Type: application/warc-fields", "WARC-Record-ID: <http://x/y>"),
        foreign("response", page, http, "WARC-Record-ID: <urn:uuid:not-one>"),
        foreign("response", page, http, f"WARC-Payload-Digest: md5:{md5}", f"WARC-Block-Digest: sha-256:{sha}"),
        foreign("response", page, http, "WARC-Payload-Digest: md5:" + "0" * 32),
        foreign("response", page, http, "WARC-Payload-Digest: blake9:xyz"),
        foreign("response", page, http, length=999),
        gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\n\r\n"),
        gzip.compress(b"hello"),
        foreign("conversion", b"z" * 300_000, "Content-Type: text/plain"),
        foreign("revisit", b"HTTP/1.1 200 OK\r\n\r\n", http),
        foreign("response", b"y" * 2_000_000, http),
        foreign("resource", b"cut")[:-9],
    ]
    whole = b"".join(members)
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(whole)))
    got = list(warc.read_records(io.BytesIO(whole), keep_on=True))
    seen = [(r["record_type"], r["payload_bytes"], r["digest_ok"], r["error"] is None) for r in got]
    body = ("response", 4, None, True)
    assert seen == [
        ("warcinfo", 19, None, True), body, ("response", 4, True, True), ("response", 4, False, True), body, (None, None, None, False), (None, None, None, False),
        (None, None, None, False), ("conversion", 300_000, None, True), ("revisit", None, None, True), ("response", 2_000_000, None, True), (None, None, None, False),
    ]
    assert all(r["page_id"] is None for r in got)
    (tmp_path / "a.warc.gz").write_bytes(whole)
    rows = warc.read_archives(spark.createDataFrame([(f"{tmp_path}/a.warc.gz",)], "path string")).collect()
    assert len(rows) == 12 and sum(r["error"] is not None for r in rows) == 4


def test_record_ids_hold_the_page():
    assert [warc.page_of(warc.record_id(i)) for i in (0, -1, 2**62, None)] == [0, -1, 2**62, None]


# -- tokens -------------------------------------------------------------------------------------

PARTS = ["a", "B", "é", " ", "  ", "\n", "\t", ".", "!!", "***", "'s", "9", "ß", "Ω", "\x1f", "\xa0", "-", "(", '"', "tion", "The", " \n", "日", "<|endoftext|>", "😀"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_library_s(name):
    enc, plain, rnd = encoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name)), random.Random(2)
    for _ in range(1500):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 12)))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    for mark in ("<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"):
        for text in (mark, f"a {mark} b", f"x{mark}{mark}", mark[:-1]):
            assert np.frombuffer(enc.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert enc.encode(None) == b""


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_batches_are_the_library_s(name, monkeypatch):
    monkeypatch.setattr(tokens, "GROUP_BYTES", 300)  # several groups, and texts that are longer than one
    enc, plain, rnd = tokens.TextEncoder(tokenizer_path(name), 100), Tokenizer.from_file(tokenizer_path(name)), random.Random(3)
    words = [*PARTS, "The", "Über.", "und,", "ÿ!", " ", " ", " ", "\nWas", "\r\n", "\x0b", "\u2003", "×", "don't", "A.B", "#***", "\"So", "<|endofTEXT|>"]
    texts = ["".join(rnd.choice(words) for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    texts += [None, "", " ", "a " * 200 + "b", "<|endoftext|>", "a <|startoftext|> b", "x\n", "a\nb\tc\rd", "\nA b"]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    for kind in (pa.string(), pa.large_string()):
        got = enc.encode_all(pa.array([None, *texts], kind).slice(1))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert list(enc.encode_all(pa.array([], pa.string()))) == []
    assert list(enc.encode_all(pa.array([None, ""], pa.string()))) == [b"", b""]


def test_a_batch_asks_for_each_word_once():
    enc, asked = tokens.TextEncoder(tokenizer_path("byte_bpe_50k.json")), Counter()

    class Asked(dict):
        def __missing__(self, word):
            asked[word] += 1
            return enc._piece(" " + word)

    enc.after_space = Asked()
    texts = pa.array(["the more the more, the merrier"] * 50)
    assert set(enc.encode_all(texts)) == {enc.encode(texts[0].as_py())}
    assert asked == {"the": 1, "more": 1, "merrier": 1}


def test_batches_of_whole_texts_are_small(spark, docs):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    spark.conf.unset(name)
    packing.pieces(docs, tokenizer_path("word_bpe_49k.json"))
    texts = spark.range(0, 5000, 1, 1).select(F.repeat(F.lit("text "), 1000).alias("text"))
    found = [r["n"] for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(found) >= 5000 * 5000 and max(found) <= 9_000_000
    spark.conf.set(name, "1m")
    small_batches(spark)
    assert spark.conf.get(name) == "1m"
    spark.conf.unset(name)


def test_token_crcs_are_the_library_s(spark, small):
    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    at = 0
    got = {r["doc_id"]: r for r in token_file.op10_token_file(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*plain.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        assert got[r["doc_id"]].asDict() == {"doc_id": r["doc_id"], "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        at += len(ids)


def test_token_files_come_back(spark, docs):
    path = tokenizer_path("byte_bpe_50k.json")
    manifest = token_file.write_token_files(docs.withColumn("start", F.lit(9)), work_dir(spark, "t"), path)
    got = token_file.read_token_files(manifest).orderBy("start").collect()
    enc, at, want = encoder(path), 0, []
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"], r["text"] or "")):
        ids = enc.encode(r["text"]) + bytes(4)
        want.append((r["doc_id"], at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert [tuple(r) for r in got] == want
    assert token_file.read_token_files(token_file.write_token_files(docs.limit(0), work_dir(spark, "t"), path)).count() == 0


def test_token_file_random_access(spark, docs):
    path = tokenizer_path("byte_bpe_50k.json")
    row = token_file.write_token_files(docs.coalesce(1), work_dir(spark, "t"), path, sequence=64).orderBy("part").first()
    file = token_file.TokenFile(row["path"])
    size = -(-row["n_tokens"] // 64)
    kept = np.concatenate([file.ids(k)[file.mask(k)] for k in range(size)])
    assert len(kept) == row["n_tokens"]
    assert not file.ids(0).flags.owndata and len(file.ids(size - 1)) == 64


def test_pieces_are_the_library_s():
    c, rnd = sentencepiece_codec.codec(tokenizer_path("piece_bpe_32k.model")), random.Random(3)
    for _ in range(1500):
        text = "".join(rnd.choice([*PARTS, "▁", "ing"]) for _ in range(rnd.randint(0, 12)))
        ids = np.frombuffer(c.encode(text), "<i4").tolist()
        assert ids == c.library.encode(text)
        assert c.decode(ids) == c.library.decode(ids)


def test_unigram_path_is_the_best():
    c = sentencepiece_codec.Codec(tokenizer_path("piece_bpe_32k.model"))
    import ahocorasick

    c.unigram, c.score = True, {"a": -1.0, "b": -2.0, "ab": -2.5, "ba": -1.5, "bab": -4.0}
    c.ids = {p: i for i, p in enumerate(c.score)}
    c.floor = -14.0
    c.automaton = ahocorasick.Automaton()
    for p in c.ids:
        c.automaton.add_word(p, p)
    c.automaton.make_automaton()

    def worth(parts):
        return sum(c.score.get(p, c.floor) for p in parts)

    def ways(text):
        if not text:
            yield []
        for n in range(1, min(3, len(text)) + 1):
            if text[:n] in c.score or (n == 1 and text[0] not in c.score):
                for rest in ways(text[n:]):
                    yield [text[:n], *rest]

    rnd = random.Random(1)
    for _ in range(200):
        text = "".join(rnd.choice("aab?") for _ in range(rnd.randint(0, 8)))
        parts = [p for p, _ in c.segment(text)]
        assert "".join(parts) == text and worth(parts) == max(map(worth, ways(text)))


def test_piece_tables(spark, docs):
    path = tokenizer_path("piece_bpe_32k.model")
    out = sentencepiece_codec.encode(docs.withColumn("ids", F.lit(1)), path).cache()
    assert out.count() == docs.count() and out.where("not round_trip").count() == 0
    back = Counter((r["doc_id"], r["text"]) for r in sentencepiece_codec.decode(out, path).collect())
    assert back == Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert sentencepiece_codec.encode(docs.limit(0), path).count() == 0


# -- classifier and languages -------------------------------------------------------------------


def test_pairs_in_linear_time():
    rng = np.random.default_rng(0)
    m = factorization.fit([], [])
    m.w, m.v = rng.standard_normal(m.w.shape), rng.standard_normal(m.v.shape)
    idx, x = np.array([3, 9, 70_000 % factorization.BUCKETS, 12]), rng.standard_normal(4)
    pairs = sum(m.v[idx[i]] @ m.v[idx[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert m.raw(idx, x)[0] == pytest.approx(m.bias + m.w[idx] @ x + pairs)


def test_held_out_documents_teach_nothing(spark, docs):
    kept = {r["doc_id"]: r["h"] for r in docs.select("doc_id", factorization.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in kept.items())
    marks = fixtures.labels(spark, docs)
    turned = marks.withColumn("quality", F.when(factorization.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = factorization.train(docs, marks), factorization.train(docs, turned)
    assert np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v)


def test_scores(spark, docs):
    odd = docs.withColumn("score", F.lit("mine"))
    marks = fixtures.labels(spark, docs)
    m = factorization.train(docs, marks)
    got = factorization.score(docs, m).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = factorization.keep_good(odd, marks)
    assert kept.columns == odd.columns and kept.count() == sum(r["score"] >= factorization.CUTOFF for r in got)
    assert factorization.keep_good(odd.limit(0), marks.limit(0)).count() == 0
    assert factorization.score(docs.drop("n_chars"), m).count() == docs.count()
    assert factorization.score(odd, m).columns == docs.columns + ["score"] and factorization.score(odd, m).where("score between 0 and 1").count() == docs.count()
    again = factorization.train(docs.union(docs).union(docs), marks)
    assert np.array_equal(again.w, m.w)


def test_classifier_on_held_out_rows(spark):
    got = factorization.op6_quality_classifier(spark, "/root/testdata/sf0.01").where("held_out")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    hits = [r["predicted"] == r["quality"] for r in got.join(marks, "doc_id").collect()]
    assert len(hits) > 50 and sum(hits) / len(hits) > 0.95


def test_languages(spark):
    words = {"en": "the and of that with", "de": "und der nicht ist mit", "fr": "les des est une pour", "es": "los que para una del"}
    docs = spark.createDataFrame([(t * 20, lang) for lang, t in words.items()] + [(None, "en"), ("x", None)], "text string, lang string")
    rows = [(i, f"http://h{i % 2}.example.com/{lang}/p", f"<html lang='{lang}'><p>{t}</p>") for i, (lang, t) in enumerate(words.items())]
    rows += [(10, None, None), (11, "http://h0.example.com/", "<html><p>" + words["fr"] + "</p>"), (12, "x", ""), (None, "http://only.example.org/de", None)]
    out = language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n", F.lit(1)), docs)
    got = {r["page_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    assert [got[i]["lang"] for i in range(4)] == list(words) and got[11]["lang"] == "fr" and got[None]["lang"] == "de"
    assert all(abs(sum(r["beliefs"]) - 1) < 1e-9 for r in got.values())
    assert language_id.identify(spark.createDataFrame([], "page_id long, url string, html string"), docs.limit(0)).count() == 0


def test_visible_text_in_one_pass():
    v = language_id.visible
    assert v("a<b>c</b><!-- x > y -->d<SCRIPT>if (1 < 2)</script >e").split() == ["a", "c", "d", "e"]
    assert v("1 < 2 and <script>open").split()[0] == "1"
    began = time.perf_counter()
    for mark in ("<script>", "<", "<!--", "<style", "<nav x"):
        v(mark * 100_000)
    assert time.perf_counter() - began < 5


def test_fusion_against_brute_force(spark, docs):
    """All steps from the evidence on, in plain Python: trust in codes, host, domain and suffix priors, beliefs."""
    rnd = random.Random(3)
    words = {"en": "the and of that with", "de": "und der nicht ist mit", "fr": "les des est une pour", "es": "los que para una del"}
    docs = spark.createDataFrame([(" ".join(rnd.choices(t.split(), k=60)), lang) for lang, t in words.items() for _ in range(5)], "text string, lang string")
    pages = []
    for i in range(120):
        lang = rnd.choice(list(words))
        host = rnd.choice([f"{lang}.a.example.co.uk", f"h{i % 7}.example.com", "big.example.org", "solo%d.de" % i])
        code = rnd.choice([lang, "en", "xx", None])
        body = " ".join(rnd.choices(words[lang].split(), k=rnd.choice([0, 1, 3, 40])))
        head = f"<html lang={code}>" if i % 3 else f'<meta http-equiv="content-language" content="{code}">'
        pages.append((i, f"http://{host}/{rnd.choice([lang, 'p', 'es'])}/x" if i % 11 else None, (head if code else "") + f"<p>{body}</p>" if i % 13 else None))
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    names = language_id.LANGUAGES
    own = {r["page_id"]: r for r in language_id.page_evidence(table, language_id.text_model(docs)).collect()}
    norm = lambda xs: (lambda e: e / e.sum())(np.exp(np.array(xs) - max(xs)))
    text = {i: np.array(r["text_log"]) * language_id.TEXT_WEIGHT for i, r in own.items()}

    def trust(column):
        held = np.array([[language_id.TRUST if c == x else language_id.DISTRUST for x in names] for c in names])
        for i, r in own.items():
            if r[column] in names:
                held[names.index(r[column])] += norm(text[i])
        logs = np.log(held / held.sum(axis=0))
        return {i: logs[names.index(r[column])] if r[column] in names else np.zeros(4) for i, r in own.items()}

    said, at = trust("declared"), trust("in_address")
    log = {i: text[i] + said[i] + at[i] for i in own}
    belief = {i: norm(x) for i, x in log.items()}
    total = lambda keep: (sum((belief[i] for i, r in own.items() if keep(r)), np.zeros(4)), sum(map(keep, own.values())))
    got = {r["page_id"]: r for r in language_id.identify(table, docs).collect()}
    assert {own[i]["domain"] for i in own if own[i]["host"].endswith("co.uk")} == {"example.co.uk"}
    for i, r in own.items():
        sums, n = total(lambda x: True)
        prior = (sums + 1) / (n + 4)
        for key, weight in (("suffix", language_id.SUFFIX_WEIGHT), ("domain", language_id.DOMAIN_WEIGHT)):
            sums, n = total(lambda x: x[key] == r[key] and x["suffix"] == r["suffix"])  # noqa: B023
            prior = (sums + weight * prior) / (n + weight)
        sums, n = total(lambda x: x["host"] == r["host"])  # noqa: B023
        prior = (np.maximum(sums - belief[i], 0) + language_id.HOST_WEIGHT * prior) / (n - 1 + language_id.HOST_WEIGHT)
        if not r["host"]:  # shares no prior with others that have none
            sums, n = total(lambda x: True)
            prior = (sums + 1) / (n + 4)
        want = norm(log[i] + np.log(prior))
        assert np.allclose(got[i]["beliefs"], want, atol=1e-9) and got[i]["confidence"] == pytest.approx(want.max())
    known = [(i, rnd.choice(list(words))) for i in range(400)]
    rows = [(i, f"http://{x}{i % 9}.example.net/", f"<p>{' '.join(rnd.choices(words[x].split(), k=12))}</p>") for i, x in known]
    out = {r["page_id"]: r["lang"] for r in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert sum(out[i] == x for i, x in known) >= 0.97 * len(known)


def test_trigram_counts_cover_all_documents(spark, docs):
    n = {r["lang"]: r["n"] for r in language_id.trigram_counts(docs).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    assert n == {"en": sum(len(language_id._trigrams(r["text"])) for r in docs.collect() if r["lang"] == "en" and r["text"] is not None)}


# -- neighbours ---------------------------------------------------------------------------------


def brute_neighbours(rows, k):
    """For each query id, the ids that all its rows find, counted."""
    usable = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    x = np.stack([v for _, v in usable])
    out = {}
    for at, (i, v) in enumerate(usable):
        if i is not None and i % 20 == 0:
            scores = [(-float(np.round((x[j] * v).sum(), 9)), c is None, c or 0, j) for j, (c, _) in enumerate(usable) if j != at]
            out.setdefault(i, Counter()).update(usable[j][0] for *_, j in sorted(scores)[:k])
    return out


def test_neighbours_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 16))
    rows = [(i, (centres[i % 6] + 0.05 * rng.standard_normal(16)).astype("float32").tolist()) for i in range(900)]
    rows[7] = (7, rows[1][1])
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [None] + [1.0] * 15), (1060, [float("nan")] * 16), (1080, [float("inf")] * 16), (None, [1.0] * 16), rows[20]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    got = {}
    for r in ann_forest.nearest(table, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute_neighbours(rows, 20)
    assert set(got) == set(want) and all(len(v) == (40 if q == 20 else 20) for q, v in got.items())
    recall = sum(sum((Counter(got[q]) & want[q]).values()) for q in want) / sum(sum(w.values()) for w in want.values())
    assert recall >= 0.9


def test_few_vectors_and_none(spark):
    table = spark.createDataFrame([(20, [1.0, 2.0]), (40, [1.0, 2.0]), (3, [5.0, 5.0])], "vec_id long, embedding array<float>")
    got = ann_forest.nearest(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(20, 3, 15.0), (20, 40, 5.0), (40, 3, 15.0), (40, 20, 5.0)]
    assert ann_forest.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_widths_do_not_mix(spark):
    rows = [(i, [float(i), 1.0] if i % 3 else [1.0, float(i), 2.0]) for i in range(90)]
    got = ann_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 5).collect()
    width = {i: len(v) for i, v in rows}
    assert len(got) == 25 and all(width[r["query_id"]] == width[r["vec_id"]] for r in got)


def test_clusters_are_found_without_scoring_all(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((200, 32))
    x = (centres[np.arange(12_000) % 200] + 0.2 * rng.standard_normal((12_000, 32))).astype("float32")
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann_forest.nearest(table, F.col("vec_id") % 400 == 0, 20).collect()
    want = {q: set((-(x.astype(float) @ x[q].astype(float)) + 1e9 * (np.arange(len(x)) == q)).argsort()[:20].tolist()) for q in range(0, 12_000, 400)}
    assert sum(r["vec_id"] in want[r["query_id"]] for r in got) >= 0.9 * 20 * len(want)
    assert sum(r["n_scored"] for r in got if r["rank"] == 1) <= 0.4 * len(x) * len(want)


def test_recall_on_the_table(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want = brute_neighbours(rows, 20)
    got = ann_forest.op9_ann_forest(spark, "/root/testdata/sf0.01").collect()
    assert sum(r["vec_id"] in want[r["query_id"]] for r in got) >= 0.9 * 20 * len(want)
    assert sum(r["n_scored"] for r in got if r["rank"] == 1) <= 0.8 * len(rows) * len(want)


# -- pipeline -----------------------------------------------------------------------------------


def test_pipeline_end_to_end(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, held = docs.columns, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = held.count()
        held = spark.createDataFrame(stage(spark, held, small).collect(), docs.schema).cache()
        assert held.columns == columns and 0 < held.count() <= before
    good = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").join(docs, "doc_id")
    long_good = [r["doc_id"] for r in good.collect() if len(r["text"].split()) >= 60]
    passed = {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, small).collect()}
    assert sum(i in passed for i in long_good) >= 0.9 * len(long_good)
    out = corpus_pipeline.run(spark, small)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in held.collect()}
