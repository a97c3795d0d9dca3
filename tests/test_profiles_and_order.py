"""Kinds of questions, validated decisions, dense numbering, and the active loop's budgets and stops."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import profile as P
from quillspark.functions import rules as R
from quillspark.functions import text as T
from quillspark.operators import active_loop, prep


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lits(*values):
    return [F.lit(v).cast("string") for v in values]


def test_options(spark):
    pairs = lambda o: [tuple(x) for x in o]
    none = lits(None, "", " ", None)
    assert pairs(one(spark, P.options(lits("a", None, " c ", ""), F.lit('["x"]')))) == [("A", "a"), ("C", "c")]
    assert pairs(one(spark, P.options(none, F.lit('{"B": "two", "A": " one ", "E": "no"}')))) == [("A", "one"), ("B", "two")]
    assert pairs(one(spark, P.options(none, F.lit(json.dumps(["p", "", 3, None, "fifth"]))))) == [("A", "p"), ("C", "3")]
    for bad in ("", "no list", "7", '{"A": ', None):
        assert pairs(one(spark, P.options(none, F.lit(bad).cast("string")))) == []
    assert [one(spark, P.has_options(c, F.lit(x).cast("string"))) for c, x in ((lits(*"abcd"), ""), (lits("a", "b", "c", ""), ""), (none, '["a", "b"]'), (none, '["a", " "]'), (none, None))] == [True, False, True, False, False]


def test_letters(spark):
    assert [one(spark, P.letter_of_index(F.lit(v).cast("string"))) for v in ("0", "3", "4", "1.0", "5", "-1", "x", None)] == ["A", "D", "D", "B", "", "", "", ""]
    assert [one(spark, P.letter(F.lit(v).cast("string"))) for v in ("b", " c ", "2", "it is (d)", "cab", "", None)] == ["B", "C", "C", "D", "", "", ""]
    choices = P.options(lits("New York", "Párís", "", ""), F.lit(""))
    assert one(spark, P.letter_of_text(choices, F.lit("paris!"))) == "B" and one(spark, P.letter_of_text(choices, F.lit(""))) == ""
    gold = lambda numbers, texts: one(spark, P.gold_letter(lits(*numbers), lits(*texts), choices))
    assert [gold(["x", "1"], ["new york"]), gold([None], ["nowhere", "new york"]), gold([""], ["c"]), gold([], ["neither"])] == ["B", "A", "C", ""]


@pytest.mark.parametrize(
    ("choices", "dataset", "case", "source", "want"),
    [
        (True, "HotpotQA", "rag_x", "", ("multiple_choice", "conservative", "multiple_choice")), (False, "my HotpotQA", "", "", ("open_retrieval", "aggressive", "open")),
        (False, "", "RAG_bridge", "", ("open_retrieval", "aggressive", "open")), (False, None, None, "id7", ("open_retrieval", "aggressive", "open")),
        (False, "TruthfulQA", "x", "", ("open_direct", "conservative", "open")), (False, "", "ambiguous_who", "", ("ambiguous", "conservative", "open")),
        (False, None, None, None, ("open_qa", "balanced", "open")),
    ],
)
def test_task_profiles(spark, choices, dataset, case, source, want):
    assert tuple(one(spark, P.task_profile(F.lit(choices), *lits(dataset, case, source)))) == want
    assert tuple(one(spark, P.task_profile(F.lit(choices), *lits(dataset, case, source), task="open_qa", bias="conservative"))) == ("open_qa", "conservative", "open")


def test_row_kinds_and_decisions(spark):
    assert [one(spark, P.is_choice_row(*lits(*x))) for x in (("MMLU", "", "", ""), ("", "", "Multiple choice", ""), ("", "", "", "direct-mmlu"), ("", "", "", "direct mmlu"), ("", None, "open", ""))] == [True, True, False, True, False]
    got = one(spark, P.decision(*lits("Use-RAG", "Multi hop", "82", None)))
    assert tuple(got) == ("retrieve", "multi_step", 0.82, "No reason given by the router.")
    assert tuple(one(spark, P.decision(*lits("elsewhere", "single", "x", "why")))) == ("direct", "none", 0.0, "why")
    assert tuple(one(spark, P.decision(*lits("rag", "??", "2,5", "why")))) == ("retrieve", "single_step", 0.025, "why")
    assert tuple(one(spark, P.retrieval_decision(*lits("yes", "0.4", "")))) == (True, 0.4, "No reason given.")
    assert tuple(one(spark, P.retrieval_decision(*lits("perhaps", None, "r")))) == (False, 0.0, "r")


def test_dense_order(spark):
    rows = [(i * 7 % 1000, i % 3) for i in range(1000)]
    want = sorted((hashlib.md5(f"{i}:s".encode()).hexdigest(), i) for i, _ in rows)
    for parts in (1, 7):
        d = prep.seeded_order(spark.createDataFrame(rows, "id long, g int").repartition(parts), "id", "s")
        assert [r["id"] for r in d.orderBy("place").collect()] == [i for _, i in want]
    d = prep.numbered(spark.createDataFrame(rows, "id long, g int").repartition(5), F.desc("g"), "id", name="n")
    got = [(r["n"], r["g"], r["id"]) for r in d.orderBy("n").collect()]
    assert got == [(n, g, i) for n, (g, i) in enumerate(sorted(((g, i) for i, g in rows), key=lambda x: (-x[0], x[1])))]
    assert "SinglePartition" not in d._jdf.queryExecution().toString()
    assert prep.numbered(spark.createDataFrame([], "id long"), "id").count() == 0
    assert sorted(r["place"] for r in prep.numbered(spark.createDataFrame([(None,), (None,), (3,)], "id long"), "id").collect()) == [0, 1, 2]


def test_sentences_are_cleaned_and_appended(spark):
    d = spark.createDataFrame([("- A  b.", "c"), ("", '"Only."'), ("No end", "Next"), ("Q?", ""), ("x", "y" * 800)], "p string, s string")
    got = [r[0] for r in d.select(T.appended(T.said_sentence(F.col("p")), T.said_sentence(F.col("s")))).collect()]
    assert got == ["A b. c", "Only.", "No end. Next", "Q?", "x. " + "y" * 700 + " [...]"]
    assert one(spark, T.said_sentence(F.lit(None).cast("string"))) is None


def write(spark, sentences, pieces, task="open_qa", **budgets):
    """One answer's trace; ``pieces`` all fit any search, the first best."""
    d = spark.createDataFrame([(1, "Who was it?", sentences, task, "aggressive")], "k int, question string, sentences array<string>, task string, bias string")
    d = d.withColumn("asked", R.question_signs(F.col("question")))
    texts = spark.createDataFrame([(p, 1.0 - p / 100, t) for p, t in enumerate(pieces)], "piece long, rank_score double, text string")

    def search(asking):
        s = R.scores_against(T.normal(F.col("candidate")), T.tokens(T.normal(F.col("candidate"))), T.normal(F.col("text")), T.tokens(T.normal(F.col("text"))))
        return asking.join(texts, F.col("piece") >= 0).select("k", "piece", "rank_score", s.alias("s"), T.negated(T.normal(F.col("text"))).alias("en"))

    trace = active_loop.write_answers(d, ["k"], search, **budgets)
    rows = sorted(trace.collect(), key=lambda r: r["step"])
    return rows, active_loop.final_answers(d, trace, ["k"]).first()


def test_active_loop(spark):
    facts = ["Ana was born in 1950.", "Ben was born in 1960.", "Cleo was born in 1970.", "Dan was born in 1980.", "Eve was born in 1990."]
    rows, end = write(spark, facts, facts + ["other words"])
    # two unseen pieces a step; the third sentence's own piece comes up in its step
    assert [list(r["retrieved"]) for r in rows] == [[0, 1], [2, 3], [4, 5], []][: len(rows)]
    assert [r["status"] for r in rows][0] == "supported" and rows[0]["rule"] == "number_or_date"
    rows, end = write(spark, [facts[0], "It is red.", facts[0], facts[0]], facts, searches=1)
    assert [(r["searched"], r["skipped"]) for r in rows] == [(True, ""), (False, ""), (False, "max_retrieval_steps_reached"), (False, "max_retrieval_steps_reached")]
    assert (rows[-1]["stop"], end["stop"], end["n_steps"], end["n_searches"], end["abstained"]) == ("max_steps", "max_steps", 4, 1, False)
    assert end["answer"] == "Ana was born in 1950. It is red. Ana was born in 1950. Ana was born in 1950."
    rows, end = write(spark, [facts[0], facts[0]], facts, most=2)
    assert [r["skipped"] for r in rows] == ["", "max_total_chunks_reached"] and list(end["evidence"]) == [0, 1] and end["stop"] == "finished"
    rows, end = write(spark, [facts[0], "More."], facts, task="open_retrieval")
    assert [r["stop"] for r in rows] == ["settled"] and end["answer"] == facts[0]
    rows, end = write(spark, ["Zoe was born in 1900.", "More."], ["nothing like it at all"])
    assert [(r["status"], r["abstains"], r["stop"]) for r in rows] == [("not_enough_info", True, "abstained")] and end["abstained"] and end["answer"] == active_loop.NOTHING_FOUND
    rows, end = write(spark, ["Please clarify.", "More."], facts)
    assert [r["stop"] for r in rows] == ["clarification"]
    rows, end = write(spark, [], facts)
    assert rows == [] and (end["answer"], end["abstained"], end["confidence"], end["stop"]) == (active_loop.NOTHING_FOUND, True, 0.0, "finished")
    with pytest.raises(ValueError, match="positive"):
        write(spark, [], facts, steps=0)
