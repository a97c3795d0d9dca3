"""Labels, choices, gold matches, kinds of error and nested examples, on odd values."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.functions import evaluate as E
from quillspark.functions import match as M
from quillspark.functions import text as T
from quillspark.operators import nested


def values(spark, fn, rows):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r["y"] for r in d.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_labels(spark):
    assert values(spark, E.label, [" No-Answer ", "use rag", None]) == ["no_answer", "use_rag", ""]
    assert values(spark, E.plain_label, ["No-Answer!", "Ask  clarification"]) == ["noanswer", "ask_clarification"]
    assert values(spark, E.route_name, ["Use RAG", "refuse", "clarify", "sideways", None]) == ["retrieve", "abstain", "clarify", "", ""]
    assert values(spark, E.behaviour, ["abstention", "needs clarification", "", None, "x"]) == ["abstain", "clarify", "answer", "answer", "answer"]
    assert values(spark, T.plain_float, [" 120.5 ", "82%", "nan", None]) == [120.5, None, None, None]


def test_choices(spark):
    raw = ["b", " C. ", "D)", "The answer is a", "opción B", "I take C here", "no letter", "", None, "ABC", "option: d"]
    assert values(spark, E.choice_letter, raw) == ["B", "C", "D", "A", "B", "C", "", "", "", "", "D"]


def overlap(spark, pairs):
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    return [r["n"] for r in d.select("i", M.overlap(F.col("a"), F.col("b")).alias("n")).orderBy("i").collect()]


def test_overlap_counts_repeats(spark):
    rnd = random.Random(5)
    pairs = [([rnd.choice("abcde") for _ in range(rnd.randint(0, 9))], [rnd.choice("cdefg") for _ in range(rnd.randint(0, 9))]) for _ in range(200)]
    assert overlap(spark, pairs) == [sum((Counter(a) & Counter(b)).values()) for a, b in pairs]


def test_long_lists_take_no_time_squared(spark):
    import time

    words = [f"w{i % 5000}" for i in range(60_000)]
    began = time.perf_counter()
    assert overlap(spark, [(words, words[::-1])]) == [60_000]
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize(
    ("wanted", "answer", "score"),
    [("", "x", 0.0), ("composed by mozart", "it was composed by mozart", 0.98), ("composed by mozart", "it was not composed by mozart", 0.25), ("same", "same", 1.0)],
)
def test_falsehood(spark, wanted, answer, score):
    d = spark.createDataFrame([(wanted, answer)], "w string, a string")
    got = d.select(M.falsehood(F.col("w"), T.tokens(F.col("w")), F.col("a"), T.tokens(F.col("a")))).first()[0]
    assert got == score


def test_gold_match_takes_the_first_of_the_best(spark):
    d = spark.createDataFrame([("the red stone bridge", ["", "blue", "red stone", "bridge", "The red stone bridge!"]), ("", ["x"]), ("zzz", ["x"])], "a string, g array<string>")
    got = [r["m"] for r in d.select(E.gold_match(F.col("g"), F.col("a"), T.tokens(F.col("a"))).alias("m")).collect()]
    assert got[0]["exact"] and got[0]["at"] == -4 and got[0]["score"] == 1.0
    assert got[1] is None and got[2] is None


def test_nested_examples(spark):
    rows = [
        ("q1", "who", "me", [("The A", "text a"), ("B", "text b"), ("the a!", "more")], ["the  A"]),
        ("q2", "what", None, [("X", None)], None),
        ("q3", "none", "", [], ["B"]),
    ]
    examples = spark.createDataFrame(rows, nested.EXAMPLE)
    passages = nested.chunks(examples)
    assert sorted((r["chunk_id"], r["is_gold"]) for r in passages.collect()) == [
        ("q1_chunk_00", True), ("q1_chunk_01", False), ("q1_chunk_02", True), ("q2_chunk_00", False),
    ]
    assert nested.judgements(passages).count() == 2
    got = {r["id"]: (r["n_context"], r["n_gold"], r["gold_ids"]) for r in nested.questions(examples, passages).collect()}
    assert got == {"q1": (3, 2, "q1_chunk_00|q1_chunk_02"), "q2": (1, 0, ""), "q3": (0, 0, "")}
    shown = passages.select(nested.embedding_text(F.col("title"), F.col("text")).alias("t")).where("chunk_id = 'q2_chunk_00'")
    assert shown.first()["t"] == "X"
