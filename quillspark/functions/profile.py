"""What kind of question a row is: its options, gold and chosen letter, task, retrieval bias, and validated decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import claim_payload as C
from quillspark.functions import evaluate as E
from quillspark.functions import text as T

# Fixed values.
LETTERS = ("A", "B", "C", "D")
#: A letter between characters that are no letters or digits of any script; of ASCII only, so the A of "ßA" stands alone.
ALONE, ALONE_ASCII = r"\b([ABCD])\b", r"(?<![A-Za-z0-9_])([ABCD])(?![A-Za-z0-9_])"
MODE_ALIASES = {
    "no_retrieval": "none", "no_retrieve": "none", "single": "single_step", "single_step_retrieval": "single_step", "one_step": "single_step", "simple": "single_step",
    "multi": "multi_step", "multi_hop": "multi_step", "multihop": "multi_step", "multi_step_retrieval": "multi_step", "iterative": "multi_step",
}
ROUTER_ALIASES = {k: v for k, v in E.ROUTE_ALIASES.items() if k not in ("active", "active_retrieval")}
BIASES = {"multiple_choice": "conservative", "open_direct": "conservative", "ambiguous": "conservative", "open_retrieval": "aggressive"}

_OPTIONS = "array<struct<label:string,text:string>>"


def options(columns: list[Column], cell: Column) -> Column:
    """Array of (label, text): the filled ones of four columns, or else those of a JSON object or list; at most four, none without text."""
    named = lambda texts: F.filter(F.array(*[F.struct(F.lit(x).alias("label"), T.clean(t).alias("text")) for x, t in zip(LETTERS, texts, strict=True)]), lambda o: o["text"] != "")

    def of_cell(v: Column) -> Column:
        elements = F.try_variant_get(v, "$", "array<string>")
        return (
            F.when(C.is_a(v, "OBJECT"), named([C.text(v, x) for x in LETTERS]))
            .when(C.is_a(v, "ARRAY"), named([F.get(elements, F.lit(i)) for i in range(len(LETTERS))]))
            .otherwise(F.array().cast(_OPTIONS))
        )

    return T.let(named(columns), lambda own: F.when(F.size(own) > 0, own).otherwise(T.let(C.parsed(cell), of_cell)))


def has_options(columns: list[Column], cell: Column) -> Column:
    """All four columns are filled, or a cell lists two options at least."""
    full = F.size(F.filter(F.array(*map(T.clean, columns)), lambda t: t != "")) == len(LETTERS)
    inner = F.try_variant_get(C.parsed(cell), "$", "array<string>")
    return full | F.coalesce(F.size(F.filter(inner, lambda x: F.trim(x) != "")) >= 2, F.lit(False))


def letter_of_index(c: Column) -> Column:
    """The letter of an option's number: from 0, and 4 is the last one counted from 1; "" if it is none."""
    at = F.trim(c.cast("string")).try_cast("double").cast("int")
    return F.coalesce(F.when(at.between(0, 3), F.substring(F.lit("ABCD"), at + 1, F.lit(1))).when(at == 4, "D"), F.lit(""))


def letter(c: Column, alone: str = ALONE) -> Column:
    """A letter as it stands, by its number, or the first that stands alone in a text; "" if there is none."""
    return T.let(
        T.upper(T.clean(c)),
        lambda x: F.when(x.isin(*LETTERS), x).otherwise(F.coalesce(F.nullif(letter_of_index(x), F.lit("")), F.nullif(F.regexp_extract(x, alone, 1), F.lit("")), F.lit(""))),
    )


def letter_of_text(choices: Column, c: Column) -> Column:
    """The label of the first option whose normalised text is the given one; "" if there is none."""
    return T.let(T.normal(c), lambda want: F.coalesce(F.get(F.filter(choices, lambda o: (want != "") & (T.normal(o["text"]) == want)), F.lit(0))["label"], F.lit("")))


def gold_letter(indices: list[Column], texts: list[Column], choices: Column, alone: str = ALONE) -> Column:
    """The gold option: by the first readable number, else by the first text that names a letter or is an option."""
    found = [letter_of_index(c) for c in indices]
    for c in texts:
        found += [letter(c, alone), letter_of_text(choices, c)]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found], F.lit(""))


def is_choice_row(dataset: Column, source_dataset: Column, case_type: Column, kind: Column) -> Column:
    """Is a row a multiple-choice question by its labels?"""
    d, s, c, k = (E.plain_label(x) for x in (dataset, source_dataset, case_type, kind))
    return (d == "mmlu") | (s == "mmlu") | (k == "direct_mmlu") | c.isin("multiple_choice", "multiplechoice")


def task_profile(choices: Column, dataset: Column, case_type: Column, source_id: Column, task: str = "auto", bias: str = "auto") -> Column:
    """Struct (task_type, retrieval_bias, question_format) from a row's columns, or as given.

    ``choices`` says whether the row has options. Gold answers and expected routes are not looked at.
    """
    data, case = F.lower(T.clean(dataset)), F.lower(T.clean(case_type))
    found = (
        F.when(choices, "multiple_choice")
        .when(data.contains("hotpot") | (T.clean(source_id) != "") | case.contains("rag_"), "open_retrieval")
        .when(data.contains("truthful") | case.contains("truthfulqa"), "open_direct")
        .when(case.contains("ambiguous"), "ambiguous")
        .otherwise("open_qa")
    )

    def whole(t: Column) -> Column:
        leaning = E.canonical(t, BIASES, F.lit("balanced")) if bias == "auto" else F.lit(bias)
        return F.struct(t.alias("task_type"), leaning.alias("retrieval_bias"), F.when(t == "multiple_choice", "multiple_choice").otherwise("open").alias("question_format"))

    return T.let(found if task == "auto" else F.lit(task), whole)


def decision(route: Column, mode: Column, confidence: Column, reason: Column) -> Column:
    """Struct (route, retrieval_mode, confidence, reason) of a router's decision: unknown routes are direct, only retrieval has a mode."""
    named = lambda c: F.replace(T.rule_text(c), F.lit(" "), F.lit("_"))

    def whole(r: Column) -> Column:
        stated = T.let(E.canonical(named(mode), MODE_ALIASES), lambda m: F.when(r != "retrieve", "none").when(m.isin("single_step", "multi_step"), m).otherwise("single_step"))
        return F.struct(
            r.alias("route"), stated.alias("retrieval_mode"), F.coalesce(C.share(confidence), F.lit(0.0)).alias("confidence"),
            F.coalesce(F.nullif(T.clean(reason), F.lit("")), F.lit("No reason given by the router.")).alias("reason"),
        )

    known = T.let(E.canonical(named(route), ROUTER_ALIASES), lambda r: F.when(r.isin(*E.ROUTES), r).otherwise("direct"))
    return T.let(known, whole)


def retrieval_decision(needs: Column, confidence: Column, reason: Column) -> Column:
    """Struct (needs_retrieval, confidence, reason) of a decision to retrieve."""
    return F.struct(
        T.boolean(needs, False).alias("needs_retrieval"), F.coalesce(C.share(confidence), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.nullif(T.clean(reason), F.lit("")), F.lit("No reason given.")).alias("reason"),
    )
