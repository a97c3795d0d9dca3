"""Operators on small tables, and every reference query on the smallest data folder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.jobs.evaluation_sql import EVALUATION_SQL
from quillspark.jobs.evaluations import EVALUATIONS
from quillspark.jobs.oracles import ORACLES
from quillspark.jobs.queries import QUERIES
from quillspark.operators import metrics as AG
from quillspark.operators import prep as DP
from quillspark.operators import quality as DQ
from quillspark.operators import vector as VE


def test_top_k_is_exact_and_breaks_ties_by_id(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8))
    x[10] = x[11]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    queries = corpus.where("id < 5").select(F.col("id").alias("query_id"), "v")
    got = {}
    for r in VE.top_k(queries, corpus, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for i in range(5):
        scores = x @ x[i]
        scores[i] = -np.inf
        assert got[i] == sorted(range(60), key=lambda j: (-round(scores[j], 9), j))[:4]


def test_ties_of_many_copies_go_to_the_smallest_ids(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 16))
    ids = rng.permutation(400)
    copies = ids[:100]
    x[copies] = x[copies[0]]
    corpus = spark.createDataFrame([(int(i), x[i].tolist()) for i in ids], "id long, v array<double>")
    queries = spark.createDataFrame([(int(q), x[copies[0]].tolist()) for q in (*copies[:3], *range(1000, 1003))], "query_id long, v array<double>")
    for k in (3, 5):
        got = {}
        for r in VE.top_k(queries, corpus, k).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == {r["query_id"]: sorted(int(i) for i in copies if i != r["query_id"])[:k] for r in queries.collect()}


def test_top_k_of_few_rows_and_of_none(spark):
    corpus = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, v array<double>")
    queries = corpus.select(F.col("id").alias("query_id"), "v")
    assert VE.top_k(queries, corpus, 5).count() == 2
    assert VE.top_k(queries.limit(0), corpus.limit(0), 5).count() == 0


def test_unseen_leaves_out_pairs(spark):
    corpus = spark.createDataFrame([(i, [float(i)]) for i in range(1, 8)], "id long, v array<double>")
    queries = corpus.where("id = 1").select(F.col("id").alias("query_id"), "v")
    seen = spark.createDataFrame([(1, 7)], "query_id long, id long")
    assert [r["id"] for r in VE.top_k_unseen(queries, corpus, seen, 2, 1).orderBy("rank").collect()] == [6, 5]


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False)], "query_id long, rank int, relevant boolean")
    gold = spark.createDataFrame([(1, 2), (2, 0)], "query_id long, n_gold long")
    a, b = VE.ranking_metrics(ranked, gold, 2).orderBy("query_id").collect()
    assert (a["hit"], a["recall"], a["precision"], a["mrr"], a["first_hit"]) == (True, 0.5, 0.5, 0.5, 2)
    assert (b["hit"], b["recall"], b["mrr"], b["first_hit"]) == (False, 0.0, 0.0, None)


def test_summary_tells_null_groups_from_left_out_columns(spark):
    df = spark.createDataFrame([("a", True), (None, False), ("", None)], "g string, ok boolean")
    got = {(r["group_type"], r["g"], r["n"], r["rate"]) for r in AG.summary(df, {"all": [], "g": ["g"]}, [F.count("*").alias("n"), AG.rate(F.col("ok")).alias("rate")]).collect()}
    assert got == {("all", "", 3, 0.5), ("g", "a", 1, 1.0), ("g", "", 1, 0.0), ("g", "", 1, None)}


def test_one_against_rest(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "b")], "e string, p string")
    got = {r["label"]: (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"]) for r in AG.one_against_rest(df, "e", "p").collect()}
    assert got == {"a": (1, 0, 1, 1.0, 0.5), "b": (0, 2, 0, 0.0, None), "c": (0, 0, 1, None, 0.0)}


def test_issues_reasons_and_status(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 20)], "k int, v int")
    rules = [("error", "big", F.col("v") > 10), ("warning", "some", F.col("v") > 1)]
    found = DQ.issues(df, "k", rules)
    assert sorted((r["k"], r["category"]) for r in found.collect()) == [(1, "some"), (3, "big"), (3, "some")]
    assert DQ.status(found).first()["status"] == "FAIL"
    assert DQ.status(found.where("level = 'warning'")).first()["status"] == "PASS_WITH_WARNINGS"
    assert DQ.status(found.limit(0)).first()["status"] == "PASS"
    named = [(n, c) for _, n, c in rules]
    assert [r[0] for r in df.orderBy("k").select(DQ.reasons(named)).collect()] == ["some", "", "big|some"]


def test_keys_and_reconciliation(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (1,), (None,)], "c int")
    assert tuple(DQ.key_check(b, "c").first()) == (3, 1, 1, 1)
    assert {r["key"]: r["n_children"] for r in DQ.reconcile(a, b, "k", "c").collect()} == {1: 2, 2: 0, None: 0}


def test_preparation(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "k int, g string")
    done = spark.createDataFrame([(1,)], "k int")
    assert sorted(r["k"] for r in DP.remaining(a, done, "k").collect()) == [2, 3]
    assert sorted(r["k"] for r in DP.head_of_groups(a, "g", "k", 1).collect()) == [1, 3]
    assert [r["k"] for r in DP.hash_sample(a, "k", 2, "s").collect()] == [r["k"] for r in DP.hash_sample(a.repartition(3), "k", 2, "s").collect()]
    assert DP.conform(a, ["g", "z"]).first().asDict() == {"g": "x", "z": ""}
    ids = spark.createDataFrame([(2, "b")], "k int, new_id string")
    assert [r["k"] for r in DP.remap(a, ids, "k").collect()] == ["b"]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and set(EVALUATIONS) == set(EVALUATION_SQL)


@pytest.mark.parametrize("name", QUERIES | EVALUATIONS)
def test_query_against_sql(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    base = duckdb.connect()
    for table in ("embeddings", "documents", "labels", "conversations", "events", "part", "lineitem", "orders", "benchmark"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    found = base.execute((ORACLES | EVALUATION_SQL)[name])
    names = [x[0] for x in found.description]
    got = (QUERIES | EVALUATIONS)[name](spark, small)
    assert sorted(got.columns) == sorted(names)
    shown = lambda v: "" if v is None else repr(v)
    wanted = sorted(tuple(shown(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    assert sorted(tuple(shown(r[c]) for c in sorted(names)) for r in got.collect()) == wanted
