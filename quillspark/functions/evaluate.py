"""Column functions that judge an answer: labels, choices, gold matches, behaviour, kinds of error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import match as M
from quillspark.functions import rules as R
from quillspark.functions import text as T

# Fixed values.
ROUTES = ("direct", "retrieve", "abstain", "clarify")
ROUTE_ALIASES = {
    "no_retrieval": "direct", "no_retrieve": "direct", "direct_answer": "direct", "answer_directly": "direct", "rag": "retrieve", "retrieval": "retrieve",
    "use_retrieval": "retrieve", "use_rag": "retrieve", "active": "retrieve", "active_retrieval": "retrieve", "ask_clarification": "clarify",
    "needs_clarification": "clarify", "clarification": "clarify", "not_enough_information": "abstain", "insufficient_information": "abstain",
    "no_answer": "abstain", "refuse": "abstain",
}
ABSTAIN_LABELS = ("abstain", "abstention", "no_answer", "not_enough_information", "insufficient_information")
CLARIFY_LABELS = ("clarify", "ask_clarification", "needs_clarification", "clarification")
#: Where a chosen letter stands, surest first.
CHOICES = (r"(?i)^\s*([ABCD])\s*[\.)]?\s*$", r"(?i)(?:respuesta|answer|opci[oó]n|option)\s*(?:es|is|:)?\s*([ABCD])\b", r"(?i)\b([ABCD])\b")


def label(c: Column) -> Column:
    """A label in lower case with underscores for spaces and hyphens; other marks stay."""
    return F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), " -", "__")


def plain_label(c: Column) -> Column:
    """A label as normalised text with underscores for its spaces."""
    return F.replace(T.normal(c), F.lit(" "), F.lit("_"))


def canonical(c: Column, aliases: dict[str, str], default: Column | None = None) -> Column:
    """A label under its one name: by ``aliases``, else itself (or ``default``)."""
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(known, c), c if default is None else default)


def route_name(c: Column) -> Column:
    """A route under its one name; "" if it is none of the four."""
    return T.let(canonical(label(c), ROUTE_ALIASES), lambda x: F.when(x.isin(*ROUTES), x).otherwise(""))


def behaviour(c: Column) -> Column:
    """What is expected of an answer: abstain, clarify, or else answer."""
    return T.let(label(c), lambda x: F.when(x.isin(*ABSTAIN_LABELS), "abstain").when(x.isin(*CLARIFY_LABELS), "clarify").otherwise("answer"))


def choice_letter(c: Column) -> Column:
    """The chosen letter of a raw output, "" if there is none."""
    found = [F.nullif(F.upper(F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), p, 1)), F.lit("")) for p in CHOICES]
    return F.coalesce(*found, F.lit(""))


def gold_answers(columns: list[Column], cell: Column) -> Column:
    """Accepted answers: the filled columns, then those of a list cell, each once."""
    return F.array_distinct(F.concat(F.filter(F.array(*map(T.clean, columns)), lambda x: x != ""), T.list_cell(cell)))


def gold_match(golds: Column, answer: Column, answer_tokens: Column) -> Column:
    """Struct of the gold that fits a normalised answer best (equal, held, holding, F1; the first of equals); null without any."""

    def against(gold: Column, i: Column) -> Column:
        def scored(norm: Column, s: Column) -> Column:
            held, holds = answer.contains(norm), norm.contains(answer)
            part = F.greatest(s["f1"], F.when(held, 0.95).otherwise(0.0), F.when(holds, 0.9).otherwise(0.0))
            return F.struct(
                F.when(norm == "", 0.0).when(norm == answer, 1.0).otherwise(part).alias("score"),
                (-i).alias("at"),
                (norm == answer).alias("exact"),
                held.alias("contains_gold"),
                holds.alias("gold_contains"),
                s["f1"].alias("f1"),
            )

        return T.let(T.normal(gold), lambda n: T.let(M.token_scores(answer_tokens, T.tokens(n)), lambda s: scored(n, s)))

    return F.when(answer != "", F.array_max(F.filter(F.transform(golds, against), lambda x: x["score"] > 0)))


def markers(phrases) -> list[str]:
    """Normalised markers, each once."""
    return list(dict.fromkeys(map(T.plain_phrase, phrases)))


def outcome(expected: Column, abstained: Column, clarified: Column, right: Column) -> Column:
    """Struct (behaviour_correct, answer_correct, final_correct) of an answer."""
    plain = ~abstained & ~clarified
    pick = lambda answer: F.when(expected == "abstain", abstained).when(expected == "clarify", clarified).otherwise(answer)
    return F.struct(pick(plain).alias("behaviour_correct"), pick(right).alias("answer_correct"), pick(plain & right).alias("final_correct"))


def _misbehaviour(expected: Column, abstained: Column, clarified: Column):
    return [
        ((expected == "answer") & abstained, "wrong_abstention"),
        ((expected == "answer") & clarified, "wrong_clarification"),
        ((expected == "abstain") & ~abstained, "missing_abstention"),
        ((expected == "clarify") & ~clarified, "missing_clarification"),
    ]


# The kinds of error below and the order of their rules.
def _first(rules, default: str) -> Column:
    return R.cascade([*[(c, {"kind": k}) for c, k in rules], (None, {"kind": default})])["kind"]


def adaptive_error(run_error, valid, router_valid, final, expected, abstained, clarified, under, over, acceptable, used, n_gold, hit, full) -> Column:
    """What went wrong with an answer behind a router, as one of 14 kinds."""
    retrieved = (expected == "answer") & (used == "retrieve") & (n_gold > 0)
    return _first(
        [
            (run_error, "run_error"),
            (~valid, "format_error"),
            (~router_valid, "router_format_error"),
            (final, "correct"),
            *_misbehaviour(expected, abstained, clarified),
            (under, "under_retrieval_route_error"),
            (over & ~F.coalesce(acceptable, F.lit(False)), "over_retrieval_route_error"),
            (retrieved & ~hit, "retrieval_miss"),
            (retrieved & ~full, "partial_retrieval_or_generation_error"),
            (expected == "answer", "answer_mismatch"),
        ],
        "behavior_error",
    )


def active_error(run_error, valid, final, expected, abstained, clarified, under, over, active, n_gold, hit, full) -> Column:
    """What went wrong with an answer that retrieves while it is written."""
    retrieved = (expected == "answer") & active & (n_gold > 0)
    return _first(
        [
            (run_error, "run_error"),
            (~valid, "format_error"),
            (final, "correct"),
            *_misbehaviour(expected, abstained, clarified),
            (under, "under_retrieval"),
            (over, "over_retrieval"),
            (retrieved & ~hit, "retrieval_miss"),
            (retrieved & ~full, "partial_retrieval_or_generation_error"),
            (expected == "answer", "answer_mismatch"),
        ],
        "behavior_error",
    )


def claims_error(run_error, parse_warning, valid, final, expected, abstained, clarified, n_refuted, n_open) -> Column:
    """What went wrong with an answer whose claims were verified."""
    return _first(
        [
            (run_error, "run_error"),
            (parse_warning, "parse_warning"),
            (~valid, "format_error"),
            (final, "correct"),
            *_misbehaviour(expected, abstained, clarified),
            (n_refuted > 0, "claim_refuted"),
            (n_open > 0, "claim_nei"),
            (expected == "answer", "answer_mismatch"),
        ],
        "behavior_error",
    )


def abstains(norm: Column, kind: str) -> Column:
    """Does a normalised answer abstain, by the markers of one kind of evaluation?"""
    return T.contains_any(norm, markers(L.ABSTENTION[kind]))


def clarifies(norm: Column, kind: str) -> Column:
    """Does a normalised answer ask what is meant, by the markers of one kind of evaluation?"""
    return T.contains_any(norm, markers(L.CLARIFICATION[kind]))
