"""The whole pipeline on a small table of odd rows, against the same five steps in plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import factorization, secret_scan
from quillspark.llm.tokens import tokenizer_path
from tests.llm import fixtures
from tests.llm.test_text_operators import base_counts


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()


def keep_one_of_each(rows):
    sets = [{tuple(low(r["text"])[k : k + 5]) for k in range(max(1, len(low(r["text"])) - 4))} if low(r["text"]) else set() for r in rows]
    label = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return [min((r for r, x in zip(rows, label, strict=True) if x == c), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for c in dict.fromkeys(label)]


def masked(text):
    spans = []
    for k, rule in enumerate(secret_scan.RULES):
        spans += [(m.start(), k, m.end()) for m in re.finditer(rule.pattern, text, re.ASCII) if len(m[rule.group]) >= rule.least]
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], secret_scan.MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def test_pipeline_against_plain_python(spark, tmp_path):
    docs = fixtures.documents(spark)
    first = docs.collect()
    odd = [(None, first[10]["text"] + " with more", "de", None, None), (None, None, None, None, None), (900, first[12]["text"] + " token=abcdefgh99 AKIA" + "Z9" * 12, "en", "s", 5)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    labels = fixtures.labels(spark, docs.where("doc_id is not null"))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # fewer than 90 good labels: the base checks alone decide
    rows = [r for r in docs.collect() if not (base_counts(r["text"])[0] < 50 or 100 * base_counts(r["text"])[4] > 50 * base_counts(r["text"])[0])]
    machine = factorization.train(spark.createDataFrame(rows, docs.schema), labels)
    rows = [r for r in rows if machine.score(r["text"], r["n_chars"]) >= factorization.CUTOFF]
    rows = keep_one_of_each(rows)
    plain, want = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), Counter()
    for r in rows:
        ids = np.array([*plain.encode(masked(r["text"]), add_special_tokens=False).ids, 0], "<u4")
        for k, i in enumerate(range(0, len(ids), 2048)):
            want[(r["doc_id"], k, i, len(ids[i : i + 2048]), zlib.crc32(ids[i : i + 2048].tobytes()))] += 1
    assert len(rows) > 30 and Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
