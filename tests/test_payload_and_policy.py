"""Raw output parsing, sentence policy, claims, error kinds, and routing over a stream."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import payload
from quillspark.functions import rules as R
from quillspark.streaming.routing import route_stream, routed


@pytest.mark.parametrize(
    ("raw", "answer", "confidence", "method"),
    [
        ('{"answer": "B", "confidence": 0.82}', "B", 0.82, "json"),
        ('```json\n{"answer": "B", "confidence": "82%"}\n```', "B", 0.82, "json"),
        ('Well: {"answer": "a } b { \\" c", "confidence": 7} and {"answer": "x"}', 'a } b { " c', 0.07, "json"),
        ('{"answer": "B", "conf', '{"answer": "B", "conf', None, "fallback"),
        ('["B"]', '["B"]', None, "fallback"),
        ("B", "B", None, "fallback"),
        ("  ", "", None, "empty"),
        (None, "", None, "empty"),
    ],
)
def test_answers(spark, raw, answer, confidence, method):
    got = spark.createDataFrame([(raw,)], "r string").select(payload.answer(F.col("r")).alias("p")).first()["p"]
    assert (got["answer"], got["confidence"], got["method"], got["valid"]) == (answer, confidence, method, method == "json")


@pytest.mark.parametrize(
    ("sentence", "confidence", "task", "bias", "needs", "rule"),
    [
        (None, None, "open_qa", "balanced", False, "empty_candidate"),
        ("There is not enough information here", None, "open_qa", "balanced", False, "abstention_sentence"),
        ("Could you clarify the place?", None, "open_qa", "balanced", False, "clarification_sentence"),
        ("We need to determine the year", None, "open_qa", "balanced", False, "generic_intro"),
        ("It was in 1999", None, "multiple_choice", "balanced", False, "multiple_choice_direct_no_retrieval"),
        ("the documents say so", None, "multiple_choice", "balanced", False, "suppressed_documental_cue_multiple_choice"),
        ("the documents say so", None, "open_qa", "aggressive", True, "documental_cue"),
        ("It was in 1999", None, "open_direct", "conservative", False, "open_direct_conservative_no_retrieval"),
        ("It was in 1999", 0.6, "open_qa", "conservative", True, "number_or_date"),
        ("It was in 1999", 0.8, "open_qa", "conservative", False, "suppressed_number_or_date"),
        ("the film was directed by someone", None, "open_qa", "balanced", True, "factual_relation_cue"),
        ("the two are both red", 0.9, "open_qa", "balanced", False, "suppressed_comparison_cue"),
        ("seen by Ana Ruiz there", 0.5, "open_qa", "balanced", True, "named_entity"),
        ("it was a very red old stone", None, "open_qa", "balanced", True, "question_multi_entity"),
        ("it was red", None, "open_qa", "balanced", False, "fallback_no_retrieval"),
    ],
)
def test_policy(spark, sentence, confidence, task, bias, needs, rule):
    df = spark.createDataFrame([("Did Ana Ruiz see Bob Marsh?", sentence, confidence, task, bias)], "q string, s string, c double, t string, b string")
    got = df.select(R.retrieval_policy(*[F.col(c) for c in "qsctb"]).alias("p")).first()["p"]
    assert (got["needs_retrieval"], got["rule"]) == (needs, rule)


def test_claims(spark):
    rows = [("The answer is b.",), ("Please clarify which one. It is red.",), ("I don't know.",), ("I think so. It is red. It is old.",), (None,), ("1. " + "x is y. " * 9,)]
    got = [r[0] for r in spark.createDataFrame(rows, "a string").select(R.claims(F.col("a"))).collect()]
    assert [(c["claim_text"], c["claim_type"]) for c in got[0]] == [("The selected answer is B.", "answer_choice")]
    assert [c["claim_type"] for c in got[1]] == ["clarification"] and [c["claim_type"] for c in got[2]] == ["abstention"]
    assert [(c["claim_text"], c["importance"]) for c in got[3]] == [("It is red.", "core"), ("It is old.", "supporting")]
    assert got[4] == [] and len(got[5]) == 5


def test_error_kinds(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (true, false, true, true, false, true), (false, true, true, true, false, true), (false, true, true, false, false, true), (false, true, false, false, false, true), "
        "(false, false, false, false, false, true), (false, false, true, false, false, true), (false, false, true, true, false, true), (true, false, true, true, true, true), (true, false, true, true, false, false) AS t(c, a, h, f, e, v)"
    )
    got = [r[0] for r in df.select(R.answer_error(*[F.col(x) for x in "cahfev"])).collect()]
    assert got == [
        "correct", "wrong_abstention_despite_full_retrieval", "wrong_abstention_with_partial_retrieval", "wrong_abstention_no_gold_retrieved", "retrieval_miss",
        "partial_retrieval_or_generation_error", "generation_error_after_full_retrieval", "run_error", "format_error",
    ]


@pytest.mark.parametrize(
    ("expected", "predicted", "mode", "kind"),
    [
        ("direct", "fly", "none", "invalid_route"), ("retrieve", "retrieve", "none", "inconsistent_retrieval_mode"),
        ("retrieve", "retrieve", "multi_step", "route_correct_mode_wrong"), ("retrieve", "retrieve", "single_step", "correct"),
        ("retrieve", "direct", "none", "under_retrieval"), ("direct", "retrieve", "single_step", "over_retrieval"), ("clarify", "direct", "none", "missed_clarify"),
        ("abstain", "direct", "none", "missed_abstain"), ("direct", "clarify", "none", "unnecessary_clarify"), ("direct", "abstain", "none", "unnecessary_abstain"),
    ],
)
def test_route_errors(spark, expected, predicted, mode, kind):
    df = spark.createDataFrame([(expected, predicted, mode)], "e string, p string, m string").withColumn("a", F.array().cast("array<string>"))
    assert df.select(R.route_error(F.col("e"), F.col("p"), F.col("a"), F.col("m"), F.lit("single_step"))).first()[0] == kind


def test_stream_gives_what_the_table_gives_and_resumes(spark, small, tmp_path):
    table = spark.read.parquet(f"{small}/conversations.parquet")
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    table.where("conv_id % 2 = 0").coalesce(1).write.parquet(source)
    route_stream(spark, source, target, mark).awaitTermination(120)
    table.where("conv_id % 2 = 1").coalesce(1).write.mode("append").parquet(source)
    route_stream(spark, source, target, mark).awaitTermination(120)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.read.parquet(target)) == key(routed(table))
