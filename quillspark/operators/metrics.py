"""Grouped metrics: rates with null rules, stacked groupings in one pass, confusion, precision and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(c: Column) -> Column:
    """Mean of a boolean; nulls do not count, and without any value it is null."""
    return F.avg(c.cast("int"))


def summary(df: DataFrame, groupings: dict[str, list[str]], metrics: list[Column]) -> DataFrame:
    """(group_type, the grouping columns as text, metrics) for several groupings, in one aggregation.

    A null group is its own group, shown as ``""`` like a column that a grouping leaves out;
    ``group_type`` tells the two apart.
    """
    columns = list(dict.fromkeys(c for cols in groupings.values() for c in cols))
    sets = [[F.col(c) for c in cols] for cols in groupings.values()]
    ids = {
        name: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in cols) for name, cols in groupings.items()
    }
    kind = F.lit(None).cast("string")
    for name, number in ids.items():
        kind = F.when(F.col("gid") == number, name).otherwise(kind)
    grouped = df.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.grouping_id().alias("gid"), *metrics)
    names = [c for c in grouped.columns if c not in (*columns, "gid")]
    return grouped.select(
        kind.alias("group_type"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns], *names
    )


def confusion(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """(expected, predicted, n) for the pairs there are."""
    return df.groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def one_against_rest(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) of each label; a rate over nothing is null.

    One pass: the confusion counts, exploded by the two labels that each pair touches.
    """
    pairs = confusion(df, expected, predicted)
    same = F.col("expected").eqNullSafe(F.col("predicted"))
    n = F.col("n")
    row = lambda label, tp, fp, fn: F.struct(label.alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    zero = F.lit(0).cast("long")
    touched = F.when(same, F.array(row(F.col("expected"), n, zero, zero))).otherwise(
        F.array(row(F.col("expected"), zero, zero, n), row(F.col("predicted"), zero, n, zero))
    )
    counts = pairs.select(F.inline(touched)).where("label is not null").groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return counts.select("label", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) of each value of several columns, nulls shown as "<null>", in one pass."""
    cells = [F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("<null>")).alias("value")) for c in columns]
    return df.select(F.inline(F.array(*cells))).groupBy("field", "value").agg(F.count("*").alias("n"))
