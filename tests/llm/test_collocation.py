"""Collocations against plain Python on odd rows, at several lengths, and over several chunks of a task."""

import random
import re
from collections import Counter

import pytest

from quillspark.llm import collocation
from tests.llm import fixtures


def plain(rows, longest, least, first):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    dropped = set()
    for (lang, ws), a in candidates.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                inner = (lang, ws[i : i + m])
                if 100 * a >= 50 * candidates[inner]:
                    dropped.add(inner)
    out = {}
    for key in candidates.keys() - dropped:
        (lang, ws), a = key, candidates[key]
        cuts = [(1_000_000 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return {
        (lang, i, p.decode(), -a, left, right, n[lang], -s)
        for lang, found in out.items()
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:first], 1)
    }


def check(docs, longest, least, first):
    got = {tuple(r) for r in collocation.collocations(docs, longest, least, first).collect()}
    want = plain([(r["lang"], r["text"]) for r in docs.collect()], longest, least, first)
    assert got == want
    return want


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(4)
    words = ["of", "the", "of the", "New York", "new york city", "NEW YORK", "Ünder", "ünder", "a\tb", "x y", "end.", "so, that", "wow!?", "z\n"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    texts += [None, "", " \t ", "...", "the " * 500, "a b " * 400, "one", "last sep last sep"]
    rows = [(i, t, ("en", None, "und", "de", "")[i % 5], "s", 1, "clash", "clash", 7) for i, t in enumerate(texts)]
    rows += [rows[3]] * 12
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, head string, words string, f long").cache()


@pytest.mark.parametrize(("longest", "least", "first"), [(3, 10, 2000), (2, 3, 5), (4, 5, 40), (5, 2, 300)])
def test_against_plain_python(docs, longest, least, first):
    assert len(check(docs, longest, least, first)) > 10


def test_chunks_and_slices(spark, docs, monkeypatch):
    monkeypatch.setattr(collocation, "CHUNK_WORDS", 50)
    monkeypatch.setattr(collocation, "SLICE_ROWS", 7)
    run = collocation._counted(3)
    rows = docs.select("lang", "text").na.fill("und", ["lang"]).coalesce(1).mapInArrow(run, "head string, last string, n long").collect()
    texts = [(r["lang"], r["text"]) for r in docs.collect()]
    seen = Counter()
    for r in rows:
        head, lang = r["head"].split("\n", 1)
        seen[lang, head, r["last"]] += r["n"]
    want = Counter()
    for lang, text in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for i in range(len(ws)):
                want["und" if lang is None else lang, " ".join(ws[i : i + 2]), ws[i + 2] if i + 2 < len(ws) else None] += 1
    assert seen == want and len(rows) > len(want)


def test_empty_and_ties(spark, docs):
    assert collocation.collocations(docs.limit(0)).count() == 0
    assert collocation.collocations(docs.where("text is null or text = ''")).count() == 0
    rows = [(1, "b c, a d, " * 20, "en"), (2, "a d, b c, " * 20, None)]
    got = collocation.collocations(spark.createDataFrame(rows, "doc_id long, text string, lang string"), first=1).collect()
    assert sorted((r["lang"], r["phrase"]) for r in got) == [("en", "a d"), ("und", "a d")]
    with pytest.raises(ValueError):
        collocation.phrase_counts(docs, longest=1)


def test_long_texts(spark):
    rnd = random.Random(1)
    rows = [(1, fixtures.sentence(rnd, 60_000), "en"), (2, "w" * 300_000 + " of the " * 3000, "en")]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 3, 10, 2000)
