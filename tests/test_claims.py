"""Abstention as each evaluation reads it, statements of an answer, repairs."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import evaluate as E
from quillspark.functions import rules as R
from quillspark.functions import text as T


def values(spark, fn, rows):
    d = spark.createDataFrame(list(enumerate(rows)), "i int, x string")
    return [r["y"] for r in d.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_abstention_is_read_in_normalised_text(spark):
    said = ["I don’t know.", "I don't  know", "Not enough\ninformation", "NO SÉ", "Cannot determine, from this.", "no evidence", "It is red.", "", None]
    got = {k: values(spark, lambda c: E.abstains(T.normal(c), k), said) for k in ("open", "retrieved", "adaptive", "claims")}  # noqa: B023
    assert got["adaptive"] == [True, True, True, True, True, True, False, False, False]
    assert got["retrieved"] == got["claims"] == [True, True, True, True, True, False, False, False, False]
    assert got["open"] == [True, True, True, True, False, False, False, False, False]


def test_clarification(spark):
    said = ["¿Podrías  aclarar?", "Not clear\nwho", "that is unclear", "clear", None]
    assert values(spark, lambda c: E.clarifies(T.normal(c), "adaptive"), said) == [True, True, True, False, False]
    assert values(spark, lambda c: E.clarifies(T.normal(c), "claims"), said) == [True, False, True, False, False]


def test_statements(spark):
    said = [
        "Two things:\n- first bullet here\n\n * second one! third", "A line that\nis wrapped. Next", '- "Quoted here."', "• dotted", "a. B. it is.", "x", "", None,
        "w" * 700, "'One.' Two",
    ]
    assert values(spark, T.claim_sentences, said) == [
        ["Two things:.", "first bullet here.", "second one!", "third"], ["A line that is wrapped.", "Next"], ["Quoted here."], ["dotted"], ["a.", "B.", "it is."], ["x"], [], [],
        ["w" * 600 + " [...]"], ["One.' Two"],
    ]


def test_claims_of_marked_answers(spark):
    said = ["It is red. It is old.", "We  do not say: NOT ENOUGH\nEVIDENCE here.", "Red is ambiguous. So?", "As an AI. It is red."]
    got = values(spark, R.claims, said)
    assert [[c["claim_type"] for c in cs] for cs in got] == [["factual", "factual"], ["abstention"], ["clarification"], ["factual"]]
    assert got[1][0]["claim_text"] == "We do not say: NOT ENOUGH EVIDENCE here." and got[3][0]["importance"] == "core"


@pytest.mark.parametrize(
    ("n", "flags", "decision", "abstained", "corrected", "confidence"),
    [
        (0, "", "no_claims", True, False, 0.7), (1, "c", "clarification_kept", True, False, 0.95), (1, "a", "abstained", True, False, 0.95),
        (2, "ro", "abstained", True, True, 0.85), (2, "o", "abstained", True, True, 0.8), (2, "s", "unchanged", False, False, 0.9), (2, "", "unchanged", False, False, 0.65),
    ],
)
def test_repairs(spark, n, flags, decision, abstained, corrected, confidence):
    d = spark.range(1).select(R.repair(F.lit(n), *[F.lit(f in flags) for f in "caros"]).alias("r"))
    assert tuple(d.first()["r"]) == (decision, abstained, corrected, confidence)
