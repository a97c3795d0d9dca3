"""Registered queries on small tables made to meet thresholds exactly and to tie, held against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import profile as P
from quillspark.functions import text as T
from quillspark.jobs.evaluation_sql import EVALUATION_SQL
from quillspark.jobs.evaluations import EVALUATIONS
from quillspark.operators import lexical

#: A question of six tokens and an answer of three, so a search has nine.
QUESTION, ANSWER = "alpha bravo carol delta echo foxes", "Marie painted rivers."


def conversation(spark, folder, *turns):
    """The turns as the only conversation of the folder; ``turns`` are texts, users' first."""
    rows = [(8, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def piece(shared, n):
    """A text of n tokens that shares so many with the question."""
    return " ".join(QUESTION.split()[:shared] + [f"other{i}" for i in range(n - shared)])


def both(spark, folder, name, *columns):
    """The query's rows, which must be those of its SQL, in order."""
    base = duckdb.connect()
    base.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    found = base.execute(EVALUATION_SQL[name])
    names = [x[0] for x in found.description]
    wanted = sorted(found.fetchall())
    rows = EVALUATIONS[name](spark, folder).select(*names).collect()
    assert sorted(tuple(r) for r in rows) == wanted
    return [tuple(r[c] for c in columns) for r in sorted(rows)]


#: (shared, tokens) of two pieces and the evidence: F1 of exactly the least; equal F1, from precision and recall a little higher in the later one.
EXACT = [((2, 11), (0, 5), "0|2"), ((3, 9), (4, 15), "0|2")]


@pytest.mark.parametrize(("first", "second", "evidence"), EXACT)
def test_active_answers_take_pieces_of_exactly_the_least_and_the_smaller_of_equals(spark, tmp_path, first, second, evidence):
    folder = conversation(spark, tmp_path, QUESTION, ANSWER, piece(*first), "", piece(*second))
    assert both(spark, folder, "active_answers", "turn", "evidence")[0] == (1, evidence)


@pytest.mark.parametrize(("first", "second", "evidence"), EXACT)
def test_active_steps_take_the_same_pieces_in_long_conversations(spark, tmp_path, first, second, evidence):
    more = [t for i in range(lexical.FEW) for t in ("", f"filler{i} words")]
    folder = conversation(spark, tmp_path, QUESTION, ANSWER, piece(*first), "", piece(*second), *more)
    assert both(spark, folder, "active_steps", "turn", "step", "retrieved")[0] == (1, 1, evidence)


def test_active_steps_find_a_long_piece_that_holds_question_and_sentence(spark, tmp_path):
    # nine of 109 tokens: below the least, but the text is held whole
    holding = " ".join([QUESTION, ANSWER, *(f"other{i}" for i in range(100))])
    more = [t for i in range(lexical.FEW) for t in ("", f"filler{i} words")]
    folder = conversation(spark, tmp_path, QUESTION, ANSWER, holding, *more)
    assert both(spark, folder, "active_steps", "turn", "retrieved", "status")[0] == (1, "2|0", "supported")


def test_task_profiles_find_options_in_capitals_of_several_letters(spark, tmp_path):
    # turns 1, 4, 7, ... name the second word in capitals; (8 + turn) % 5 says where the options are
    texts = ["zu weiß dem grün", "der aßo enera auf", "in ßa nicht", "ein weiß weiß da", "Straße STRASSE", "ßß ß", "eins", ""]
    rows = [(8, 3 * i + 1, "user", t) for i, t in enumerate(texts * 5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    gold = dict(both(spark, str(tmp_path), "task_profiles", "turn", "gold"))
    assert [gold[t] for t in (4, 7, 28, 85, 88)] == ["A", "A", "A", "", "B"]


def test_letterwise_capitals(spark):
    d = spark.createDataFrame([("weiß é ŉ a𐐨 𐐨ß",), ("plain",), ("",), (None,)], "x string")
    assert [r[0] for r in d.select(T.upper(F.col("x"))).collect()] == ["WEIß É ŉ A𐐀 𐐀ß", "PLAIN", "", None]
    # among letters of any script no letter of such a word stands alone
    assert [d.select(P.letter(F.lit(v), a)).first()[0] for v in ("aßo", "ça") for a in (P.ALONE, P.ALONE_ASCII)] == ["", "A", "", "A"]
