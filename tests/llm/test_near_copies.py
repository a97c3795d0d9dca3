"""Near copies in families just below and just above the similarity, compared in many blocks."""

import random

import pytest

from quillspark.llm import near_copies, simhash
from tests.llm import fixtures


def test_family_below_the_similarity_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    rnd = random.Random(21)
    base = fixtures.sentence(rnd, 300).split()
    rows = []
    for i in range(150):
        other = list(base)
        for at in rnd.sample(range(300), 13 if i % 3 else 5):  # some pairs at 0.8 and more, most of them below
            other[at] = f"v{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(other)))
    sets = [{tuple(t.lower().split()[k : k + 5]) for k in range(296)} for _, t in rows]
    label = list(range(len(rows)))
    links = 0
    for j in range(len(rows)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links += 1
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8)
    assert 0 < links < 150 * 149 / 8 and 20 < len(set(label)) < 149
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))


def test_family_makes_rows_of_texts_and_links_only(spark, monkeypatch):
    sent = []
    keep = near_copies.stored
    monkeypatch.setattr(near_copies, "stored", lambda df, name="stored": sent.append((name, keep(df, name))) or sent[-1][1])
    rnd = random.Random(23)
    base = fixtures.sentence(rnd, 300).split()
    rows = []
    for i in range(200):  # alike around 0.8: 19900 pairs, of which many lie just below
        other = list(base)
        for at in rnd.sample(range(300), 5):
            other[at] = f"w{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(other)))
    simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).collect()
    size = {name: df.count() for name, df in sent}
    # 24 keys of each text are the most rows of any stored table
    assert max(size.values()) <= 24 * len(rows) and size["links"] < len(rows)


@pytest.mark.parametrize("similarity", [0.9, 0.97])
def test_higher_similarities(spark, similarity):
    rnd = random.Random(22)
    rows = []
    for i in range(60):
        words = fixtures.sentence(rnd, 200).split()
        other = list(words)
        for at in rnd.sample(range(200), rnd.randint(1, 5)):
            other[at] = f"c{i}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    sets = [{tuple(t.lower().split()[k : k + 5]) for k in range(196)} for _, t in rows]
    want = [i for i in range(120) if i % 2 == 0 or len(sets[i] & sets[i - 1]) < similarity * len(sets[i] | sets[i - 1])]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similarity=similarity)
    assert sorted(r["doc_id"] for r in kept.collect()) == want and 60 < len(want) < 120


@pytest.mark.parametrize(("most", "texts_dealt"), [(10, False), (1, True)])
def test_few_keys_go_to_the_texts(spark, monkeypatch, most, texts_dealt):
    monkeypatch.setattr(near_copies, "MOST_SENT", most)
    rows = spark.createDataFrame([(k % 9, f"text {k % 9}") for k in range(30)], "_key long, text string")
    keys = spark.createDataFrame([(2,), (4,), (77,)], "_key long")
    with_join = near_copies._of_keys(rows, keys, "text")
    assert sorted(map(tuple, with_join.collect())) == [(2, "text 2"), (4, "text 4")]
    assert ("rightHint=(strategy=broadcast)" not in with_join._jdf.queryExecution().optimizedPlan().toString()) == texts_dealt


def test_lower_similarities_are_refused(spark):
    with pytest.raises(ValueError, match="0.8"):
        simhash.drop_near_duplicates(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), similarity=0.5)
