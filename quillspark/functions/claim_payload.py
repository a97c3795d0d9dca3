"""Claim payloads of models to typed columns, through VARIANT: any shape is read, wrong types fall back field by field.

A payload is a VARIANT (``json_object``); fields that are absent, null or of no use take their default.
Lists of ids may be JSON lists, texts of such, or separated by bars. Elements of a list that are no
objects are left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import evaluate as E
from quillspark.functions import lexicon as L
from quillspark.functions import payload
from quillspark.functions import text as T

# Fixed values.
VERDICTS = ("supported", "refuted", "not_enough_info")
VERDICT_ALIASES = {
    "support": "supported", "supports": "supported", "entailed": "supported", "entails": "supported", "contradicted": "refuted",
    "contradiction": "refuted", "nei": "not_enough_info", "unknown": "not_enough_info", "unsupported": "not_enough_info",
}
VERIFIER_ALIASES = VERDICT_ALIASES | {"not_enough": "not_enough_info", "insufficient": "not_enough_info"}
CLAIM_TYPES = ("factual", "answer_choice", "abstention", "clarification", "meta")
IMPORTANCE = ("core", "supporting")
DECISIONS = ("unchanged", "corrected", "abstained", "clarification_kept", "no_claims", "error")
RATIONALES = {
    "supported": "Claim supported by retrieved evidence.", "refuted": "Claim refuted by retrieved evidence.",
    "not_enough_info": "Retrieved evidence is not sufficient to verify the claim.",
}

_NO_IDS = "array<string>"


def json_object(raw: Column) -> Column:
    """Struct (value VARIANT, error): the first JSON object of a raw output, fenced or inside prose; else why there is none."""
    found = payload.first_object(payload.unfenced(F.coalesce(raw, F.lit(""))))
    value = F.try_parse_json(F.nullif(found, F.lit("")))
    error = F.when(F.coalesce(found, F.lit("")) == "", "no JSON object").when(value.isNull(), "invalid JSON").otherwise("")
    return F.struct(value.alias("value"), error.alias("error"))


def parsed(cell: Column) -> Column:
    """A cell's JSON as VARIANT; null if it is none."""
    return F.try_parse_json(F.nullif(F.trim(cell), F.lit("")))


def is_a(value: Column, kind: str) -> Column:
    """Is a VARIANT an ``OBJECT`` or an ``ARRAY``? Null is neither."""
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def text(value: Column, path: str) -> Column:
    """A field as trimmed text; null where it is absent, null or blank."""
    return F.nullif(F.trim(F.try_variant_get(value, f"$.{path}", "string")), F.lit(""))


def objects(value: Column, path: str | None = None) -> Column:
    """The objects of a list field (or of a list itself); of anything else none."""
    inner = F.try_variant_get(value, f"$.{path}" if path else "$", "array<variant>")
    return F.filter(F.coalesce(inner, F.array().cast("array<variant>")), lambda x: is_a(x, "OBJECT"))


def _cell_ids(cell: Column) -> Column:
    inner = F.try_variant_get(parsed(cell), "$", _NO_IDS)
    return F.when(inner.isNotNull(), inner).when(cell.contains("|"), F.split(cell, r"\|", -1)).when(F.coalesce(cell, F.lit("")) != "", F.array(cell)).otherwise(F.array().cast(_NO_IDS))


def _filled(ids: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def ids(value: Column, path: str) -> Column:
    """A field's ids, each once: a list, a text of a JSON list, ids separated by bars, or one id."""
    listed = F.try_variant_get(value, f"$.{path}", _NO_IDS)
    return _filled(F.coalesce(F.when(is_a(F.try_variant_get(value, f"$.{path}", "variant"), "ARRAY"), listed), _cell_ids(text(value, path))))


def cell_ids(cell: Column) -> Column:
    """``ids`` of a plain cell."""
    return _filled(_cell_ids(F.trim(cell)))


def whole(value: Column, path: str) -> Column:
    """A field as a whole number, written with a point or a comma; null if it is none."""
    return F.replace(text(value, path), F.lit(","), F.lit(".")).try_cast("double").cast("long")


def share(c: Column) -> Column:
    """A number as a share: over 1 and up to 100 is a percentage; brought into [0, 1]; null if it is none."""
    x = F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")
    x = F.when((x > 1) & (x <= 100), x / 100).otherwise(x)
    return F.when(x.isNotNull() & ~F.isnan(x), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def _one_of(c: Column, values, default: str) -> Column:
    return T.let(E.label(c), lambda x: F.when(x.isin(*values), x).otherwise(default))


def verdict(c: Column) -> Column:
    """A verdict under its one name; an unknown one stays as it is."""
    return T.let(E.label(c), lambda x: E.canonical(x, VERDICT_ALIASES))


def chunks(value: Column) -> Column:
    """Array of (rank, chunk_id, doc_id, title, source, topic, score, text) of a list of passages; those without text are left out.

    A passage without an id or rank takes its place in the list for it.
    """
    inner = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))

    def one(x: Column, i: Column) -> Column:
        place = (i + 1).cast("string")
        plain = [F.coalesce(text(x, n), F.lit("")).alias(n) for n in ("doc_id", "title", "source", "topic")]
        return F.struct(
            F.coalesce(whole(x, "rank"), (i + 1).cast("long")).alias("rank"), F.coalesce(text(x, "chunk_id"), F.concat(F.lit("chunk_inline_"), place)).alias("chunk_id"),
            *plain, F.try_variant_get(x, "$.score", "double").alias("score"), F.coalesce(text(x, "text"), F.lit("")).alias("text"),
        )

    placed = F.transform(inner, lambda x, i: F.struct(is_a(x, "OBJECT").alias("fine"), one(x, i).alias("c")))
    return F.transform(F.filter(placed, lambda p: p["fine"] & (p["c"]["text"] != "")), lambda p: p["c"])


def _kind_of(answer: Column) -> Column:
    low = F.trim(F.regexp_replace(F.lower(answer), r"\s+", " "))
    return T.let(
        low,
        lambda x: F.when(T.contains_any(x, L.CLARIFICATION["extraction"]), "clarification").when(T.contains_any(x, L.ABSTENTION["extraction"]), "abstention").otherwise("factual"),
    )


def extraction(value: Column, answer: Column, most: int | None = 5) -> Column:
    """Struct (claims, needs_verification, notes) of an extractor's payload: claims (claim_id, claim_text, claim_type, requires_evidence, importance).

    Claims without text go, of claims alike but for case and spacing the first stays, ``most`` at most (None:
    all). Without any the whole answer is one claim.
    """

    def claim(x: Column) -> Column:
        kind = _one_of(text(x, "claim_type"), CLAIM_TYPES, "factual")
        return T.let(
            kind,
            lambda k: F.struct(
                T.claim_text(F.coalesce(text(x, "claim_text"), F.lit(""))).alias("claim_text"), k.alias("claim_type"),
                F.coalesce(T.boolean(text(x, "requires_evidence")), k == "factual").alias("requires_evidence"),
                _one_of(text(x, "importance"), IMPORTANCE, "core").alias("importance"),
            ),
        )

    key = lambda c: F.trim(F.regexp_replace(F.lower(c["claim_text"]), r"\s+", " "))

    def kept(cs: Column) -> Column:
        keys = F.transform(cs, key)
        first = F.filter(cs, lambda c, i: F.array_position(keys, key(c)) == i + 1)
        return first if most is None else F.slice(first, 1, most)

    stated = T.let(F.filter(F.transform(objects(value, "claims"), claim), lambda c: c["claim_text"] != ""), kept)
    said = T.claim_text(F.coalesce(answer, F.lit("")))
    alone = T.let(said, lambda s: T.let(_kind_of(s), lambda k: F.struct(s.alias("claim_text"), k.alias("claim_type"), (k == "factual").alias("requires_evidence"), F.lit("core").alias("importance"))))
    fallen = T.let(alone, lambda c: F.filter(F.array(c), lambda x: x["claim_text"] != ""))

    def whole_payload(cs: Column) -> Column:
        none = F.size(cs) == 0
        found = F.when(none, fallen).otherwise(cs)
        numbered = F.transform(found, lambda c, i: F.struct(F.concat(F.lit("c"), (i + 1).cast("string")).alias("claim_id"), c["claim_text"].alias("claim_text"), c["claim_type"].alias("claim_type"), c["requires_evidence"].alias("requires_evidence"), c["importance"].alias("importance")))
        needs = F.when(none, F.size(found) > 0).otherwise(T.boolean(text(value, "needs_verification"), True)) & F.exists(found, lambda c: c["requires_evidence"])
        return F.struct(numbered.alias("claims"), needs.alias("needs_verification"), F.coalesce(text(value, "extraction_notes"), F.lit("")).alias("notes"))

    return T.let(stated, whole_payload)


def verification(value: Column, chunk_ids: Column, needs_more: Column | bool = False) -> Column:
    """Struct (verdict, confidence, rationale, supporting, refuting, needs_more, next_search) of a verifier's payload.

    Ids count only if they are among ``chunk_ids``; a decided verdict without any takes the first of those,
    and neither asks for more nor searches on. An unknown verdict is "not enough".
    """
    named = T.let(E.canonical(E.label(text(value, "verdict")), VERIFIER_ALIASES), lambda v: F.when(v.isin(*VERDICTS), v).otherwise("not_enough_info"))
    own = lambda path: F.array_intersect(ids(value, path), chunk_ids)

    def fields(v: Column) -> Column:
        decided = v != "not_enough_info"
        of = lambda kind, path: T.let(own(path), lambda x: F.when((v == kind) & (F.size(x) == 0), F.slice(chunk_ids, 1, 1)).otherwise(x))
        rationale = F.coalesce(text(value, "rationale"), E.canonical(v, RATIONALES))
        more = F.coalesce(T.boolean(text(value, "needs_more_evidence")), needs_more if isinstance(needs_more, Column) else F.lit(needs_more))
        return F.struct(
            v.alias("verdict"), F.coalesce(share(text(value, "confidence")), F.lit(0.0)).alias("confidence"), rationale.alias("rationale"),
            of("supported", "supporting_chunk_ids").alias("supporting"), of("refuted", "refuting_chunk_ids").alias("refuting"),
            (more & ~decided).alias("needs_more"), F.when(~decided, text(value, "next_search_query")).alias("next_search"),
        )

    return T.let(named, fields)


def results(value: Column) -> Column:
    """Array of (claim_id, claim_text, verdict, requires_evidence, rounds, supporting, refuting, evidence, retrieved) of ``claim_results``."""

    def one(x: Column) -> Column:
        traced = F.flatten(F.transform(objects(x, "rounds_trace"), lambda r: ids(r, "retrieved_chunk_ids")))
        return F.struct(
            F.coalesce(text(x, "claim_id"), F.lit("")).alias("claim_id"), F.coalesce(text(x, "claim_text"), F.lit("")).alias("claim_text"), verdict(text(x, "verdict")).alias("verdict"),
            T.boolean(text(x, "requires_evidence"), False).alias("requires_evidence"), F.coalesce(whole(x, "rounds"), F.lit(0)).alias("rounds"),
            ids(x, "supporting_chunk_ids").alias("supporting"), ids(x, "refuting_chunk_ids").alias("refuting"), ids(x, "evidence_ids").alias("evidence"),
            F.concat(ids(x, "retrieved_chunk_ids"), traced).alias("retrieved"),
        )

    return F.transform(objects(value, "claim_results"), one)


def claims_object(raw: Column, cells: dict[str, Column]) -> Column:
    """Struct of a verified answer's fields: from its raw output, or else from its own columns ``cells``, field by field.

    ``cells`` may hold answer, confidence, abstained, final_decision, correction_applied, evidence_ids,
    retrieved_chunk_ids, claim_results (JSON) and error. Counts that the object lacks follow from the results.
    """
    cell = lambda name: cells.get(name, F.lit(None).cast("string"))

    def fields(o: Column) -> Column:
        v, fine = o["value"], o["error"] == ""
        # what the results are read from: the object's own, or the column's where there is no object
        held = F.when(fine, F.transform(results(v), lambda r: r)).otherwise(results(F.try_parse_json(F.concat(F.lit('{"claim_results":'), F.coalesce(F.nullif(F.trim(cell("claim_results")), F.lit("")), F.lit("[]")), F.lit("}")))))
        pick = lambda name: F.coalesce(F.when(fine, text(v, name)), F.nullif(F.trim(cell(name)), F.lit("")))

        def counted(rs: Column) -> Column:
            n = lambda name, own: F.coalesce(F.when(fine, whole(v, name)), own.cast("long")).alias(name)
            of = lambda kind: F.size(F.filter(rs, lambda r: r["verdict"] == kind))
            joined = lambda field: F.array_distinct(F.flatten(F.transform(rs, lambda r: r[field])))
            listed = lambda kind: F.array_distinct(F.filter(F.transform(F.filter(rs, lambda r: r["verdict"] == kind), lambda r: r["claim_id"]), lambda x: x != ""))
            some = lambda name, field: T.let(F.coalesce(F.when(fine, ids(v, name)), cell_ids(cell(name))), lambda x: F.when(F.size(x) > 0, x).otherwise(joined(field)))
            bar = lambda xs: F.array_join(xs, "|")
            decision = T.let(E.label(pick("final_decision")), lambda d: F.when(d == "run_error", "error").otherwise(d))
            answer, failed = F.coalesce(pick("answer"), F.lit("")), F.coalesce(pick("error"), F.lit("")) != ""
            retrieved = some("retrieved_chunk_ids", "retrieved")
            raw_given = F.coalesce(F.trim(raw), F.lit("")) != ""
            odd = (decision != "") & ~decision.isin(*DECISIONS)
            why = F.concat_ws("; ", F.when(raw_given & ~fine, o["error"]), F.when(answer == "", "no answer"), F.when(odd, F.concat(F.lit("unknown decision "), decision)))
            return F.struct(
                answer.alias("answer"), share(pick("confidence")).alias("confidence"), T.boolean(pick("abstained"), False).alias("abstained"), decision.alias("final_decision"),
                T.boolean(pick("correction_applied"), False).alias("correction_applied"),
                n("num_claims", F.size(rs)), n("num_supported_claims", of("supported")), n("num_refuted_claims", of("refuted")), n("num_nei_claims", of("not_enough_info")),
                n("num_claims_requiring_evidence", F.size(F.filter(rs, lambda r: r["requires_evidence"]))),
                n("num_verification_rounds", F.aggregate(rs, F.lit(0).cast("long"), lambda s, r: s + r["rounds"])),
                bar(listed("supported")).alias("supported_ids"), bar(listed("refuted")).alias("refuted_ids"), bar(listed("not_enough_info")).alias("open_ids"),
                bar(joined("supporting")).alias("supporting_chunk_ids"), bar(joined("refuting")).alias("refuting_chunk_ids"),
                bar(some("evidence_ids", "evidence")).alias("evidence_ids"), bar(retrieved).alias("retrieved_chunk_ids"),
                F.coalesce(F.nullif(F.coalesce(F.when(fine, whole(v, "num_chunks_retrieved_total")), F.lit(0)), F.lit(0)), F.size(retrieved).cast("long")).alias("num_chunks_retrieved_total"),
                ((answer != "") & ~failed & (decision != "error")).alias("valid"), failed.alias("run_error"),
                F.when(~raw_given, "columns").when(fine, "raw_output_json").otherwise("columns_after_parse_error").alias("method"), why.alias("parse_error"),
            )

        return T.let(held, counted)

    return T.let(json_object(raw), fields)
