"""Pairs of texts alike by their tokens, through postings instead of all pairs.

Likeness is the F1 of two token lists, 2 * shared / (n + m), repeats counted as often as both have them.
A list's elements are (token, which occurrence), ordered from rare to frequent. Two lists of F1 ``least``
share so many elements that one of them lies in the first few of both (prefix filter), and the places
of the first shared one bound how many can follow (position filter). So frequent tokens, which most
lists have, are no postings at all, and no pair of likeness ``least`` or more is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces of a group up to which its texts meet all of them.
FEW = 16


def _elements(side: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, n, t, k): the elements of each list of ``tokens``."""
    d = side.select(group, key, F.size("tokens").alias("n"), F.explode("tokens").alias("t")).groupBy(group, key, "n", "t").agg(F.count("*").alias("c"))
    return d.select(group, key, "n", "t", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("k"))


def _needed(n: Column, m: Column, least: float) -> Column:
    """Elements that lists of n and m elements share at least, at F1 ``least``; a little less for rounding."""
    return F.greatest(F.lit(1), F.ceil(least * (n + m) / 2 - 1e-9))


def _prefix(elements: DataFrame, frequency: DataFrame, group: str, key: str, least: float) -> DataFrame:
    """The elements of each list that can be the first shared one, with their place."""
    place = F.row_number().over(Window.partitionBy(group, key).orderBy(F.coalesce("often", F.lit(0)), "t", "k"))
    d = elements.join(frequency, ["t", "k"], "left").withColumn("at", place)
    shortest = F.ceil(F.col("n") * least / (2 - least) - 1e-9)
    return d.where(F.col("at") <= F.col("n") - _needed(F.col("n"), shortest, least) + 1).select(group, key, "n", "t", "k", "at")


def postings(right: DataFrame, group: str, right_key: str, least: float) -> tuple[DataFrame, DataFrame]:
    """How often each element is in ``right (group, right_key, tokens)``, and the postings: the elements that can be the first shared one."""
    found = _elements(right, group, right_key)
    frequency = found.groupBy("t", "k").agg(F.count("*").alias("often"))
    return frequency, _prefix(found, frequency, group, right_key, least).select(group, right_key, F.col("n").alias("m"), "t", "k", F.col("at").alias("bt"))


def alike_candidates(left: DataFrame, right: DataFrame, group: str, left_key: str, right_key: str, least: float, posted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(group, left_key, right_key): all pairs of a group whose F1 is ``least`` or more, and few others.

    ``left (group, left_key, tokens)``, ``right (group, right_key, tokens)``; 0 < ``least`` <= 1. ``posted``: ``postings`` of ``right``, where they are at hand.
    """
    frequency, b = posted or postings(right, group, right_key, least)
    a = _prefix(_elements(left, group, left_key), frequency, group, left_key, least)
    met = a.join(b, [group, "t", "k"])
    most = 1 + F.least(F.col("n") - F.col("at"), F.col("m") - F.col("bt"))
    short = F.least("n", "m") * 2 >= F.lit(least) * (F.col("n") + F.col("m")) - 1e-9
    return met.where(short & (most >= _needed(F.col("n"), F.col("m"), least))).select(group, left_key, right_key).distinct()


def inside_candidates(left: DataFrame, right: DataFrame, group: str, left_key: str, right_key: str) -> DataFrame:
    """Pairs in which the right text may hold the left one whole: by a word of the left text that is whole in any text that holds it.

    ``left (group, left_key, inner)`` with the tokens of all words but the first and the last, ``right (group, right_key, tokens)``.
    Left texts without such a word are not met here.
    """
    keyed = left.select(group, left_key, F.explode(F.array_distinct("inner")).alias("t"))
    posted = right.select(group, right_key, F.explode(F.array_distinct("tokens")).alias("t"))
    # the rarest of the inner words leads to the fewest
    often = posted.groupBy(group, "t").agg(F.count("*").alias("often"))
    led = keyed.join(often, [group, "t"]).groupBy(group, left_key).agg(F.min(F.struct("often", "t")).alias("least"))
    return led.select(group, left_key, F.col("least.t").alias("t")).join(posted, [group, "t"]).select(group, left_key, right_key)
