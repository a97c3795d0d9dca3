"""Data-quality rules as data: issues of rows, checks of tables, their status, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(df: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(key, level, category) for each rule (level, category, condition) that a row breaks."""
    broken = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(name).alias("category"))) for level, name, c in rules]
    return df.select(key, F.inline(F.filter(F.array(*broken), lambda x: x.isNotNull())))


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """The names of the rules that hold, joined by bars; "" if none does."""
    return F.concat_ws("|", *[F.when(c, F.lit(name)) for name, c in rules])


def status(found: DataFrame) -> DataFrame:
    """One row: PASS, PASS_WITH_WARNINGS or FAIL, and the numbers of errors and warnings."""
    counts = found.agg(F.count_if(F.col("level") == "error").alias("n_errors"), F.count_if(F.col("level") == "warning").alias("n_warnings"))
    word = F.when(F.col("n_errors") > 0, "FAIL").when(F.col("n_warnings") > 0, "PASS_WITH_WARNINGS").otherwise("PASS")
    return counts.select(word.alias("status"), "n_errors", "n_warnings")


def key_check(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, keys that repeat, rows without a key."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.sum("n").alias("n_rows"),
        F.count_if(F.col(key).isNotNull()).alias("n_keys"),
        F.count_if((F.col("n") > 1) & F.col(key).isNotNull()).alias("n_repeated"),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("n_without"),
    )


def reconcile(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """(key, n_children): every parent with its number of children, 0 included."""
    counts = children.groupBy(F.col(child_key).alias("key")).agg(F.count("*").alias("n"))
    found = parents.select(F.col(parent_key).alias("key")).join(counts, "key", "left")
    return found.select("key", F.coalesce("n", F.lit(0)).alias("n_children"))
