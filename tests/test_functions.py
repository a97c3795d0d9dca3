"""Column functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import match as M
from quillspark.functions import rules as R
from quillspark.functions import text as T


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.select(column(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def test_confidence(spark):
    rows = ["0.82", "82", "82%", "0,82", "1.5", "150", "-0.1", "", "x", None]
    assert values(spark, rows, T.confidence) == [0.82, 0.82, 0.82, 0.82, 0.015, None, None, None, None, None]
    assert values(spark, rows, T.clamped) == [0.82, 0.82, 0.82, 0.82, 0.015, 1.0, 0.0, 0.0, 0.0, 0.0]


def test_boolean(spark):
    rows = ["true", "Sí", "n", "1", "0", "2", "maybe", "", None]
    assert values(spark, rows, T.boolean) == [True, True, False, True, False, None, None, None, None]
    assert values(spark, ["x", None], lambda c: T.boolean(c, False)) == [False, False]


def test_integer_and_clean(spark):
    assert values(spark, ["3.9", "x", None, "-2.5"], T.integer) == [3, 0, 0, -2]
    assert values(spark, ["  a ", None, ""], T.clean) == ["a", "", ""]
    assert values(spark, ["  ", None, "a"], T.blank) == [True, True, False]


def test_normal_and_tokens(spark):
    rows = ["  ¡Él  dijo: \"Café\"!\n", None, "a.b-c", "THE big, big Dog"]
    assert values(spark, rows, T.normal) == ["¡el dijo cafe", "", "abc", "the big big dog"]
    assert values(spark, rows, lambda c: T.tokens(T.normal(c)))[3] == ["big", "big", "dog"]


def test_entities_words_sentences(spark):
    q = "Which film did Ana Ruiz de Leon and Bob make? The end"
    assert values(spark, [q, None], T.entity_count) == [1, 0]
    assert values(spark, ["canción única él", None], T.word_count) == [3, 0]
    assert values(spark, ["A b. C d?  E\n\nf", None, ""], T.sentences) == [["A b.", "C d?", "E", "f"], [], []]
    assert values(spark, ["abcdef", "ab"], lambda c: T.truncated(c, 3)) == ["abc [...]", "ab"]


def test_list_cells(spark):
    rows = ['["a", "b"]', "a|b| ", "a, b", "one text", "", None]
    assert values(spark, rows, T.list_cell) == [["a", "b"], ["a", "b"], ["a", "b"], ["one text"], [], []]


def scored(spark, pairs, f):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, g string")
    n = lambda c: T.normal(F.col(c))
    return [r[0] for r in df.select(f(n("a"), T.tokens(n("a")), n("g"), T.tokens(n("g"))).alias("y"), "i").orderBy("i").select("y").collect()]


def test_token_scores(spark):
    got = scored(spark, [("big big dog", "big dog dog"), ("", "dog"), ("cat", "dog")], lambda a, at, g, gt: M.token_scores(at, gt))
    assert [round(r["f1"], 6) for r in got] == [round(2 / 3, 6), 0, 0]


def test_similarity_ladder(spark):
    pairs = [("Red cars.", "red cars"), ("the red sports cars there", "red sports cars"), ("red sports cars", "the red sports cars there"), ("", "x"), ("cat", "dog")]
    assert scored(spark, pairs, lambda a, at, g, gt: M.similarity(g, gt, a, at)) == [1.0, 0.98, 0.95, 0.0, 0.0]


def test_best_match_takes_the_first_of_equals(spark):
    df = spark.sql("SELECT array('red dog', 'blue cat', 'red dog') AS c, 'blue cat' AS a, array('nope') AS none")
    n = T.normal(F.col("a"))
    best = df.select(M.best_match(F.col("c"), n, T.tokens(n)).alias("b"), M.best_match(F.col("none"), n, T.tokens(n)).alias("z")).first()
    assert (best["b"]["candidate"], best["b"]["score"]) == ("blue cat", 1.0)
    assert (best["z"]["candidate"], best["z"]["score"]) == ("", 0.0)


@pytest.mark.parametrize(
    ("question", "route", "rule"),
    [
        ("", "clarify", "empty_question"),
        (None, "clarify", "empty_question"),
        ("When was he born?", "clarify", "ambiguous_exact"),
        ("Is it red?", "clarify", "short_with_unresolved_reference"),
        ("According to the available corpus, what is the secret code of the office in town?", "abstain", "synthetic_no_answer_marker"),
        ("Say what the papers in the corpus tell about red cars and trains now", "retrieve", "explicit_corpus_or_document_cue"),
        ("Are Bob Marsh older or was Ana Ruiz older than Bob Marsh by then?", "retrieve", "multi_entity_multi_step_cue"),
        ("Please tell where Ana Ruiz, Bob Marsh and, later, Carl Jung went to school", "retrieve", "many_named_entities"),
        ("What is gravity and who needs gravity anyway in life", "direct", "conceptual_or_general_question"),
        ("Sing a song", "direct", "fallback_direct"),
    ],
)
def test_routes(spark, question, route, rule):
    got = spark.createDataFrame([(question,)], "q string").select(R.route(F.col("q")).alias("r")).first()["r"]
    assert (got["route"], got["rule"]) == (route, rule)


def test_claim_verdicts(spark):
    pairs = [("red cars drive fast", "red cars drive fast today"), ("red cars drive fast", "red cars never drive fast"), ("red cars", ""), ("red cars", "blue boats sail")]
    got = scored(spark, pairs, R.claim_verdict)
    assert [r["verdict"] for r in got] == ["supported", "refuted", "not_enough_info", "not_enough_info"]


def test_open_answer_is_undecided_in_between(spark):
    df = spark.sql("SELECT * FROM VALUES (0.9D, 0.1D, 5, false), (0.1D, 0.9D, 5, false), (0.3D, 0.3D, 5, false), (0.9D, 0.1D, 2, false), (0.9D, 0.1D, 5, true) AS t(r, w, n, a)")
    got = [x[0] for x in df.select(R.open_answer(F.col("r"), F.col("w"), F.col("n"), F.col("a"))).collect()]
    assert got == [True, False, None, False, False]
