"""Column functions that compare two texts given as normalised text and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import text as T


def overlap(a: Column, b: Column) -> Column:
    """How many tokens two lists share, repeated ones as often as both have them."""
    whole = lambda xs: F.size(F.array_distinct(xs)) == F.size(xs)
    # without repeats on one side each shared token counts once
    return T.let(F.size(F.array_intersect(a, b)), lambda n: F.when((n <= 0) | whole(a) | whole(b), F.greatest(n, F.lit(0))).otherwise(_repeated_overlap(a, b)))


def _repeated_overlap(a: Column, b: Column) -> Column:
    """``overlap`` of lists with repeats: one walk over both, sorted together."""
    side = lambda xs, k: F.transform(xs, lambda t: F.struct(t.alias("t"), F.lit(k).alias("side")))
    both = F.sort_array(F.concat(side(a, 0), side(b, 1)))

    def step(acc, x):
        same = acc["t"].eqNullSafe(x["t"])
        held = F.when(same, acc["left"]).otherwise(0)
        met = (x["side"] == 1) & (held > 0)
        left = F.when(x["side"] == 0, held + 1).otherwise(F.when(met, held - 1).otherwise(held))
        return F.struct(x["t"].alias("t"), left.alias("left"), (acc["n"] + met.cast("int")).alias("n"))

    zero = F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("left"), F.lit(0).alias("n"))
    return F.coalesce(F.aggregate(both, zero, step, lambda acc: acc["n"]), F.lit(0))


def token_scores(answer: Column, gold: Column, by_counts: bool = False) -> Column:
    """Struct of precision, recall and f1 of two token lists; all 0 without a shared token.

    ``by_counts``: f1 is 2 * shared / (n + m), rounded once, so equal ones are equal and a threshold met exactly is met;
    from precision and recall it may lie a last digit beside.
    """
    some = (F.size(answer) > 0) & (F.size(gold) > 0)
    share = lambda n, xs: F.when(some, n / F.size(xs)).otherwise(0.0)
    counted = lambda n: F.when(n > 0, 2.0 * n / (F.size(answer) + F.size(gold))).otherwise(0.0)
    of_shares = lambda p, r: F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    f1 = lambda s: counted(s["n"]) if by_counts else of_shares(s["p"], s["r"])
    parts = T.let(overlap(answer, gold), lambda n: F.struct(n.alias("n"), share(n, answer).alias("p"), share(n, gold).alias("r")))
    return T.let(parts, lambda s: F.struct(s["p"].alias("precision"), s["r"].alias("recall"), f1(s).alias("f1")))


def coverage(wanted: Column, answer: Column) -> Column:
    """Share of the wanted tokens that the answer has."""
    hit = F.size(F.filter(wanted, lambda t: F.array_contains(answer, t)))
    return F.when((F.size(wanted) > 0) & (F.size(answer) > 0), hit / F.size(wanted)).otherwise(0.0)


def similarity(wanted: Column, wanted_tokens: Column, answer: Column, answer_tokens: Column) -> Column:
    """A ladder: equal 1; the longer holds the shorter .98 or .95; else the better of F1 and .85 of coverage."""
    return (
        F.when((wanted == "") | (answer == ""), 0.0)
        .when(wanted == answer, 1.0)
        .when((F.length(wanted) >= 12) & answer.contains(wanted), 0.98)
        .when((F.length(answer) >= 12) & wanted.contains(answer), 0.95)
        .otherwise(F.greatest(token_scores(answer_tokens, wanted_tokens)["f1"], 0.85 * coverage(wanted_tokens, answer_tokens)))
    )


def falsehood(wanted: Column, wanted_tokens: Column, answer: Column, answer_tokens: Column) -> Column:
    """Likeness to a wrong answer: equal 1; held whole .98, or .25 if one of the four words before it negates; else F1."""
    at = F.instr(answer, wanted)
    before = F.substring(answer, F.greatest(at - 25, F.lit(1)), F.least(at - 1, F.lit(25)))
    words = F.filter(F.split(before, " "), lambda w: w != "")
    last = F.slice(words, F.greatest(F.size(words) - 3, F.lit(1)), 4)
    negated = F.arrays_overlap(last, F.array(*map(F.lit, L.NEGATION_BEFORE)))
    return (
        F.when((wanted == "") | (answer == ""), 0.0)
        .when(wanted == answer, 1.0)
        .when((F.length(wanted) >= 12) & answer.contains(wanted), F.when(negated, 0.25).otherwise(0.98))
        .otherwise(token_scores(answer_tokens, wanted_tokens)["f1"])
    )


def best_of(candidates: Column, score) -> Column:
    """Struct (score, candidate) of the first candidate with the highest ``score(norm, tokens)``; 0 and "" if none has any."""
    zero = F.struct(F.lit(0.0).alias("score"), F.lit("").alias("candidate"))
    scored = F.transform(
        candidates, lambda c: F.struct(T.let(T.normal(c), lambda n: T.let(T.tokens(n), lambda t: score(n, t))).alias("score"), c.alias("candidate"))
    )
    return F.aggregate(scored, zero, lambda best, x: F.when(x["score"] > best["score"], x).otherwise(best))


def best_match(candidates: Column, answer: Column, answer_tokens: Column) -> Column:
    """Struct (score, candidate) of the candidate that resembles the answer most, by ``similarity``."""
    return best_of(candidates, lambda n, t: similarity(n, t, answer, answer_tokens))
