"""Weighted fingerprints: likeness against the exact generalised Jaccard similarity, edited texts and next documents in plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import weighted_sampling as ws
from tests.llm import fixtures


def terms(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    x, y = terms(a), terms(b)
    return sum((x & y).values()) / sum((x | y).values()) if x | y else 1.0


def ordered(rows):
    return sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))


def test_query_against_plain_python(spark, tmp_path):
    docs = fixtures.documents(spark, n=80)
    rows = [r for i, r in enumerate(ordered(docs.collect())) if i == 0 or r["doc_id"] != 3] + [next(r for r in docs.collect() if r["doc_id"] == 3)]
    rows = ordered(rows)
    d = spark.createDataFrame(rows, docs.schema).withColumn("row", F.lit("clash")).withColumn("terms", F.lit(1))
    d.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in ws.op11_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    prints, errors = {}, []
    for i, r in enumerate(rows):
        own, after = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        q = len(own) // 4
        edited = own[: len(own) - q] + after[:q]
        g = got[r["doc_id"]]
        assert (g["n_chars"], g["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(own, g["fingerprint"]) == g["fingerprint"] and len(g["fingerprint"]) in (0, 4 * ws.SAMPLES)
        if edited == own:
            assert g["fingerprint"] == g["edited_fingerprint"] and g["near_edited"] == 1.0
        if own == after:
            assert g["near_next"] == 1.0
        errors += [g["near_edited"] - similarity(own, edited), g["near_next"] - similarity(own, after)]
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 5 * 0.5 / ws.SAMPLES**0.5


@pytest.mark.parametrize(("ranges", "sampled"), [(4, 50), (16, 16), (4096, 65_536)])
def test_next_documents_over_ranges(spark, monkeypatch, ranges, sampled):
    monkeypatch.setattr(ws, "RANGES", ranges)
    monkeypatch.setattr(ws, "SAMPLED", sampled)
    rnd = random.Random(ranges)
    rows = [(rnd.choice([None, 7, rnd.randint(0, 400), -rnd.randint(0, 9)]), f"text {rnd.randint(0, 250)}") for _ in range(300)] + [(7, "same")] * 100
    d = ws.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(d) == 400 and Counter((r["doc_id"], r["text"]) for r in d) == Counter(rows)
    by_row = {r["row"]: r for r in d}
    # one ring through all rows, in ascending doc_id, nulls first
    start = at = next(r["row"] for r in d if r["doc_id"] is None and not any(x["next_row"] == r["row"] and x["doc_id"] is None for x in d))
    ring = []
    while True:
        ring.append(by_row[at])
        assert by_row[by_row[at]["next_row"]]["text"] == by_row[at]["next_text"]
        at = by_row[at]["next_row"]
        if at == start:
            break
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in ring]
    assert len(ring) == 400 and keys == sorted(keys)


def test_weights_give_the_generalised_similarity(spark):
    """Words with many repeats: collisions over 512 samples against sums of lesser and greater weights."""
    rnd = random.Random(4)
    pairs = []
    for _ in range(12):
        parts = [" ".join(f"w{rnd.randint(0, 9)}{k}" for k in range(5)) for _ in range(8)]
        # whole runs repeated: a run's weight grows with its repeats
        pairs.append([" ".join(" ".join([p] * rnd.randint(1, 9)) for p in rnd.sample(parts, 6)) for _ in range(2)])
    texts = [(2 * i + j, p[j]) for i, p in enumerate(pairs) for j in range(2)]
    samples = 128
    got = dict(ws.fingerprints(spark.createDataFrame(texts, "doc_id long, text string"), samples).collect())
    for i, (a, b) in enumerate(pairs):
        x, y = got[2 * i], got[2 * i + 1]
        near = sum(x[k : k + 4] == y[k : k + 4] for k in range(0, 4 * samples, 4)) / samples
        assert abs(near - similarity(a, b)) < 4.5 * 0.5 / samples**0.5
    assert max(max(terms(t).values()) for _, t in texts) >= 5


def test_likeness_and_odd_tables(spark):
    d = spark.createDataFrame([("", ""), ("", "00ff"), ("00ff", "00fe"), ("00ff1234", "00ff1235")], "x string, y string")
    assert [r[0] for r in d.select(ws.likeness(F.col("x"), F.col("y"))).collect()] == [1.0, 0.0, 0.0, 0.5]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ws.edited_likeness(empty, 4).count() == 0 and ws.fingerprints(empty, 4).count() == 0
    one = ws.edited_likeness(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string"), 4).first()
    assert one["near_next"] == 1.0
    heavy = spark.createDataFrame([(1, "x " * 80_000), (2, "x " * 80_000 + "y")], "doc_id long, text string")
    a, b = (r["fingerprint"] for r in ws.fingerprints(heavy, 8).orderBy("doc_id").collect())
    assert a[:4] and sum(a[k : k + 4] == b[k : k + 4] for k in range(0, 32, 4)) >= 7


def test_main_path_is_native(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (2, "b")], "doc_id long, text string")
    plan = ws.fingerprints(d, 4)._jdf.queryExecution().toString() + ws.with_next(d)._jdf.queryExecution().toString()
    assert not re.search(r"Python|Arrow|Pandas", plan)
