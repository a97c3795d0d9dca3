"""Raw model output to typed columns: code fences, the first JSON object in free text, its fields."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions import text as T

FENCE = r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$"


def unfenced(c: Column) -> Column:
    """The inside of a text that is one code fence; else the text, trimmed."""
    inner = F.regexp_extract(c, FENCE, 1)
    return F.when(c.rlike(FENCE), inner).otherwise(F.trim(c))


def _first_object(text: str | None) -> str:
    if not text:
        return ""
    if text.startswith("{") and text.endswith("}"):
        return text
    start = text.find("{")
    if start < 0:
        return ""
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)):
        ch = text[i]
        if escaped:
            escaped = False
        elif ch == "\\":
            escaped = True
        elif ch == '"':
            quoted = not quoted
        elif not quoted and ch in "{}":
            depth += 1 if ch == "{" else -1
            if depth == 0:
                return text[start : i + 1]
    return ""


@F.pandas_udf(StringType())
def first_object(text: pd.Series) -> pd.Series:
    """The first balanced JSON object of each text, "" if there is none. Balance is no regular language,
    so no built-in function can say this; texts pass in Arrow batches."""
    return text.map(_first_object, na_action=None)


def answer(raw: Column) -> Column:
    """Struct (answer, confidence, abstained, valid, method) of a raw output.

    A JSON object with an answer is valid; anything else is read as the answer itself.
    """
    plain = unfenced(F.coalesce(raw, F.lit("")))
    fields = F.from_json(first_object(plain), "answer string, confidence string, abstained string")
    said = F.trim(fields["answer"])
    valid = F.coalesce(said != "", F.lit(False))
    return F.struct(
        F.when(valid, said).otherwise(plain).alias("answer"),
        F.when(valid, T.confidence(fields["confidence"])).alias("confidence"),
        F.when(valid, T.boolean(fields["abstained"])).alias("abstained"),
        valid.alias("valid"),
        F.when(plain == "", "empty").when(valid, "json").otherwise("fallback").alias("method"),
    )
