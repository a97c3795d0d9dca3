"""Ordered rules as one CASE expression, and the rule sets built on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import match as M
from quillspark.functions import text as T


def cascade(rules: list[tuple[Column | None, dict[str, object]]]) -> Column:
    """The outputs of the first rule whose condition holds, as a struct; a rule without condition always does."""
    out = None
    for condition, values in reversed(rules):
        row = F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])
        out = row if condition is None else F.when(F.coalesce(condition, F.lit(False)), row).otherwise(out)
    return out


def route(question: Column) -> Column:
    """Struct (route, retrieval_mode, confidence, rule) of a question, before any model is asked."""
    q = F.trim(F.regexp_replace(F.coalesce(question, F.lit("")), r"\s+", " "))
    texts = T.let(q, lambda q: F.struct(q.alias("q"), T.rule_text(q).alias("low")))

    def signs(t: Column) -> Column:
        padded = F.concat(F.lit(" "), t["low"], F.lit(" "))
        refers = F.arrays_overlap(F.regexp_extract_all(t["low"], F.lit(r"([\p{L}\p{N}_]+)")), F.array(*map(F.lit, L.AMBIGUOUS_REFERENCES)))
        return F.struct(
            (t["q"] == "").alias("empty"),
            t["low"].alias("low"),
            T.word_count(t["q"]).alias("words"),
            T.entity_count(t["q"]).alias("names"),
            T.contains_any(padded, L.MULTI_STEP_CUES).alias("multi"),
            refers.alias("refers"),
            T.contains_any(padded, L.CONCEPTUAL_CUES).alias("conceptual"),
        )

    # the confidences and thresholds are fixed values
    says = lambda r, m, c, n: {"route": r, "retrieval_mode": m, "confidence": c, "rule": n}
    return T.let(
        T.let(texts, signs),
        lambda s: cascade(
            [
                (s["empty"], says("clarify", "none", 1.0, "empty_question")),
                (F.regexp_replace(s["low"], r"\?+$", "").isin(*L.AMBIGUOUS_QUESTIONS), says("clarify", "none", 0.96, "ambiguous_exact")),
                ((s["words"] <= 8) & s["refers"], says("clarify", "none", 0.9, "short_with_unresolved_reference")),
                (
                    s["low"].contains("according to the available corpus") & T.contains_any(s["low"], L.NO_ANSWER_MARKERS),
                    says("abstain", "none", 0.93, "synthetic_no_answer_marker"),
                ),
                (
                    T.contains_any(s["low"], L.RETRIEVAL_CUES),
                    says("retrieve", F.when(s["multi"], "multi_step").otherwise("single_step"), 0.84, "explicit_corpus_or_document_cue"),
                ),
                ((s["names"] >= 2) & s["multi"], says("retrieve", "multi_step", 0.82, "multi_entity_multi_step_cue")),
                ((s["names"] >= 3) & (s["words"] >= 9), says("retrieve", "single_step", 0.74, "many_named_entities")),
                (s["conceptual"] & (s["names"] <= 1), says("direct", "none", 0.72, "conceptual_or_general_question")),
                (None, says("direct", "none", 0.58, "fallback_direct")),
            ]
        ),
    )


def claim_verdict(claim_norm: Column, claim_tokens: Column, evidence_norm: Column, evidence_tokens: Column) -> Column:
    """Struct (verdict, f1): a claim against one piece of evidence, by shared tokens and polarity."""
    inside = (F.length(claim_norm) > 0) & evidence_norm.contains(claim_norm)
    lifted = lambda s: F.when(inside, F.greatest(s["f1"], F.lit(0.98))).otherwise(s["f1"])
    scores = T.let(
        M.token_scores(claim_tokens, evidence_tokens),
        lambda s: F.struct(lifted(s).alias("f1"), s["precision"].alias("precision"), s["recall"].alias("recall")),
    )
    unlike = T.negated(claim_norm) != T.negated(evidence_norm)
    return T.let(
        scores,
        lambda s: cascade(
            [
                ((claim_norm == "") | (evidence_norm == ""), {"verdict": "not_enough_info", "f1": s["f1"]}),
                ((s["f1"] >= 0.6) & unlike, {"verdict": "refuted", "f1": s["f1"]}),
                ((s["f1"] >= 0.45) | ((s["precision"] >= 0.55) & (s["recall"] >= 0.25)), {"verdict": "supported", "f1": s["f1"]}),
                (None, {"verdict": "not_enough_info", "f1": s["f1"]}),
            ]
        ),
    )


#: Scores of a claim against a piece of evidence, below which no verdict but "not enough" follows.
LEAST_LIKENESS = 0.34


def scores_against(claim_norm: Column, claim_tokens: Column, norm: Column, tokens: Column, by_counts: bool = False) -> Column:
    """Struct (f1, precision, recall) of a claim against a piece; .98 at least if the piece holds the claim. ``by_counts`` as in ``token_scores``."""
    inside = (claim_norm != "") & norm.contains(claim_norm)
    lift = lambda s, x: F.when(inside, F.greatest(s[x], F.lit(0.98))).otherwise(s[x]).alias(x)
    return T.let(M.token_scores(claim_tokens, tokens, by_counts), lambda s: F.struct(lift(s, "f1"), lift(s, "precision"), lift(s, "recall")))


def verdict_on(claim_norm: Column, claim_type: Column, n_pieces: Column, best: Column, negated: Column) -> Column:
    """Struct (verdict, confidence) of a claim from its best piece's scores and whether any piece negates."""
    f1, unlike = F.coalesce(best["f1"], F.lit(0.0)), T.negated(claim_norm) != negated
    within = lambda low, high: F.least(F.lit(high), F.greatest(F.lit(low), f1))
    says = lambda v, c: {"verdict": v, "confidence": c}
    return cascade(
        [
            (claim_norm == "", says("not_enough_info", 1.0)),
            (claim_type != "factual", says("supported", 1.0)),
            (n_pieces == 0, says("not_enough_info", 0.9)),
            ((f1 >= 0.6) & unlike, says("refuted", within(0.55, 0.85))),
            ((f1 >= 0.45) | ((best["precision"] >= 0.55) & (best["recall"] >= 0.25)), says("supported", within(0.55, 0.92))),
            (None, says("not_enough_info", 0.72)),
        ]
    )


def open_answer(correct: Column, incorrect: Column, n_tokens: Column, abstained: Column, low=0.35, high=0.45, margin=0.05, informative=3) -> Column:
    """Tri-state outcome of an open answer from its similarity to right and to wrong answers; null is undecided."""
    right = (correct >= low) & (correct >= incorrect + margin)
    wrong = (incorrect >= high) & (incorrect >= correct + margin)
    return (
        F.when(abstained, F.lit(False))
        .when(right & ~wrong, n_tokens >= informative)
        .when(wrong & ~right, F.lit(False))
    )


# Fixed values.
#: A letter alone, or "the answer is", "option" and their Spanish forms before it.
CHOICE = r"(?i)^\s*(?:(?:the\s+)?answer\s+is\s+|(?:la\s+)?respuesta\s+es\s+|option\s+|opci[oó]n\s+)?([ABCD])\.?\s*$"


def has_number_or_date(c: Column) -> Column:
    """A number of two to four digits as a word, or the name of a month."""
    return c.rlike(r"\b\d{2,4}\b") | c.rlike(rf"(?i)\b({'|'.join(L.MONTHS)})\b")


def question_signs(question: Column) -> Column:
    """Struct (cues, names): what ``retrieval_policy`` asks of a question."""
    return F.struct(T.contains_any(F.lower(F.coalesce(question, F.lit(""))), L.DOCUMENT_CUES).alias("cues"), T.entity_count(question).alias("names"))


def retrieval_policy(question: Column, sentence: Column, confidence: Column, task: Column, bias: Column, asked: Column | None = None) -> Column:
    """Struct (needs_retrieval, confidence, rule): must evidence be retrieved for a sentence that is about to be said?

    Weak signals (names, comparisons) and factual ones (numbers, relations) are suppressed by task,
    by bias, and by how sure the sentence is; an unknown confidence counts as -1. ``asked``: the
    question's signs, where they were worked out once for all its sentences.
    """
    said = F.trim(F.coalesce(sentence, F.lit("")))
    asked = question_signs(question) if asked is None else asked
    texts = T.let(said, lambda s: F.struct(s.alias("said"), F.trim(F.regexp_replace(F.lower(s), r"\s+", " ")).alias("low")))
    signs = lambda t: F.struct(
        t["said"].alias("said"),
        t["low"].alias("low"),
        F.concat(F.lit(" "), t["low"], F.lit(" ")).alias("padded"),
        (asked["cues"] | T.contains_any(t["low"], L.DOCUMENT_CUES)).alias("explicit"),
    )
    sure = F.coalesce(confidence, F.lit(-1.0))
    choice = task == "multiple_choice"
    weak = choice | (bias == "conservative") | ((bias == "balanced") & (sure >= 0.85))
    factual = choice | ((bias == "conservative") & (sure >= 0.7))
    # the confidences are fixed values
    yes = lambda c, n: {"needs_retrieval": True, "confidence": c, "rule": n}
    no = lambda c, n: {"needs_retrieval": False, "confidence": c, "rule": n}

    def unless(suppressed, when, name, confidence, quiet):
        """One outcome for a sign, so that it is looked for once: suppressed or not."""
        values = {
            "needs_retrieval": ~suppressed,
            "confidence": F.when(suppressed, quiet).otherwise(confidence),
            "rule": F.when(suppressed, f"suppressed_{name}").otherwise(name),
        }
        return (when, values)

    def rules(s: Column) -> Column:
        many = (asked["names"] >= 2) & (F.size(F.split(s["low"], " ")) >= 6)
        return cascade(
            [
                (s["said"] == "", no(1.0, "empty_candidate")),
                (T.contains_any(s["low"], L.ABSTENTION_MARKERS), no(0.94, "abstention_sentence")),
                (T.contains_any(s["low"], L.CLARIFICATION_MARKERS), no(0.94, "clarification_sentence")),
                (T.contains_any(s["low"], L.INTRO_MARKERS), no(0.82, "generic_intro")),
                (choice & ~s["explicit"], no(0.95, "multiple_choice_direct_no_retrieval")),
                (s["explicit"] & choice, no(0.92, "suppressed_documental_cue_multiple_choice")),
                (s["explicit"], yes(F.when(bias == "aggressive", 0.9).otherwise(0.86), "documental_cue")),
                ((task == "open_direct") & (bias == "conservative"), no(0.92, "open_direct_conservative_no_retrieval")),
                unless(factual, has_number_or_date(s["said"]), "number_or_date", 0.84, 0.78),
                unless(factual, T.contains_any(s["padded"], L.FACTUAL_CUES), "factual_relation_cue", 0.83, 0.78),
                unless(weak, T.contains_any(s["padded"], L.COMPARISON_CUES), "comparison_cue", 0.78, 0.78),
                unless(weak, T.entity_count(s["said"]) >= 1, "named_entity", 0.74, 0.8),
                unless(weak, many, "question_multi_entity", 0.7, 0.78),
                (None, no(0.62, "fallback_no_retrieval")),
            ]
        )

    return T.let(T.let(texts, signs), rules)


def claims(answer: Column, most: int | None = 5) -> Column:
    """Array of (claim_text, claim_type, requires_evidence, importance) of an answer, ``most`` at most (None: all).

    A chosen letter, a request to clarify and an abstention are one claim; else each sentence is
    one, short remarks left out. The first is the core.
    """
    said = F.trim(F.coalesce(answer, F.lit("")))

    low = lambda s: F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))

    def kind(s: Column) -> Column:
        return T.let(
            low(s),
            lambda x: F.when(T.contains_any(x, L.ABSTENTION["extraction"]), "abstention")
            .when(T.contains_any(x, L.CLARIFICATION["extraction"]), "clarification")
            .when(T.contains_any(x, L.META_MARKERS), "meta")
            .when(s.rlike(CHOICE), "answer_choice")
            .otherwise("factual"),
        )

    one = lambda text, k: F.struct(text.alias("claim_text"), k.alias("claim_type"))
    short = lambda c: (c["claim_type"] == "meta") & (F.size(F.split(c["claim_text"], r"\s+")) <= 5)

    def found(s: Column) -> Column:
        each = F.filter(F.transform(T.claim_sentences(s), lambda x: one(x, kind(x))), lambda c: ~short(c))
        chosen = F.concat(F.lit("The selected answer is "), F.upper(F.regexp_extract(s, CHOICE, 1)), F.lit("."))
        return (
            F.when(s == "", F.array().cast("array<struct<claim_text:string,claim_type:string>>"))
            .when(s.rlike(CHOICE), F.array(one(chosen, F.lit("answer_choice"))))
            .when(T.contains_any(low(s), L.CLARIFICATION["extraction"]), F.array(one(T.claim_text(s), F.lit("clarification"))))
            .when(T.contains_any(low(s), L.ABSTENTION["extraction"]), F.array(one(T.claim_text(s), F.lit("abstention"))))
            .otherwise(each if most is None else F.slice(each, 1, most))
        )

    return F.transform(
        T.let(said, found),
        lambda c, i: F.struct(
            c["claim_text"].alias("claim_text"),
            c["claim_type"].alias("claim_type"),
            (c["claim_type"] == "factual").alias("requires_evidence"),
            F.when(i == 0, "core").otherwise("supporting").alias("importance"),
        ),
    )


def search_terms(claim_tokens: Column, question_tokens: Column, most: int | None = 12) -> Column:
    """The next search: the claim's words, then the question's, each once, ``most`` at most (None: all)."""
    words = F.array_distinct(F.concat(claim_tokens, question_tokens))
    return F.array_join(words if most is None else F.slice(words, 1, most), " ")


def answer_error(correct: Column, abstained: Column, hit: Column, full: Column, run_error: Column, valid: Column) -> Column:
    """What went wrong with an answer from retrieved passages, as one of nine kinds."""
    return (
        F.when(run_error, "run_error")
        .when(~valid, "format_error")
        .when(correct, "correct")
        .when(abstained & full, "wrong_abstention_despite_full_retrieval")
        .when(abstained & hit, "wrong_abstention_with_partial_retrieval")
        .when(abstained, "wrong_abstention_no_gold_retrieved")
        .when(~hit, "retrieval_miss")
        .when(~full, "partial_retrieval_or_generation_error")
        .otherwise("generation_error_after_full_retrieval")
    )


def route_error(expected: Column, predicted: Column, acceptable: Column, mode: Column, expected_mode: Column) -> Column:
    """What went wrong with a predicted route; without acceptable routes only the expected one is."""
    valid = predicted.isin("direct", "retrieve", "abstain", "clarify")
    consistent = F.when(predicted == "retrieve", mode.isin("single_step", "multi_step")).otherwise(mode == "none")
    fine = F.when(F.size(acceptable) > 0, F.array_contains(acceptable, predicted)).otherwise(predicted == expected)
    return (
        F.when(~valid, "invalid_route")
        .when(~consistent, "inconsistent_retrieval_mode")
        .when((predicted == expected) & (expected == "retrieve") & (mode != expected_mode), "route_correct_mode_wrong")
        .when(predicted == expected, "correct")
        .when(fine, "acceptable_alternative")
        .when(expected == "retrieve", "under_retrieval")
        .when(predicted == "retrieve", "over_retrieval")
        .when(expected == "clarify", "missed_clarify")
        .when(expected == "abstain", "missed_abstain")
        .when(predicted == "clarify", "unnecessary_clarify")
        .when(predicted == "abstain", "unnecessary_abstain")
        .otherwise("wrong_route")
    )


def repair(n_claims: Column, clarification: Column, abstention: Column, refuted: Column, open_: Column, supported: Column) -> Column:
    """Struct (decision, abstained, corrected, confidence): what becomes of an answer after its claims were verified.

    The flags speak of its core claims: all of them ask to clarify, all abstain, one is refuted, one is open, all are supported.
    """
    as_ = lambda decision, abstained, corrected, confidence: {"decision": decision, "abstained": abstained, "corrected": corrected, "confidence": confidence}
    return cascade(
        [
            (n_claims == 0, as_("no_claims", True, False, 0.7)),
            (clarification, as_("clarification_kept", True, False, 0.95)),
            (abstention, as_("abstained", True, False, 0.95)),
            (refuted, as_("abstained", True, True, 0.85)),
            (open_, as_("abstained", True, True, 0.8)),
            (supported, as_("unchanged", False, False, 0.9)),
            (None, as_("unchanged", False, False, 0.65)),
        ]
    )


def topic(words: Column, topics: dict[str, tuple[str, ...]], default: str = "other") -> Column:
    """The topic with the most of its words among distinct ``words``; the first of equals, ``default`` without any."""
    counts = {name: F.size(F.array_intersect(words, F.array(*map(F.lit, keys)))) for name, keys in topics.items()}
    best = F.greatest(*counts.values())
    out = F.when(best == 0, default)
    for name, n in counts.items():
        out = out.when(n == best, name)
    return out
