"""Preparing data sets: resuming, first rows of groups, samples by hash, strata, remapped ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.stored import stored


def remaining(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``source`` whose key ``done`` does not have."""
    return source.join(done.select(key), key, "left_anti")


def head_of_groups(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group; the window and its filter become a partial limit before the shuffle."""
    place = Window.partitionBy(group).orderBy(order)
    return df.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)


def hash_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows without replacement, the same ones in every run: those with the smallest hash of key and seed."""
    mark = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed)).cast("binary"))
    return df.withColumn("mark", mark).orderBy("mark", key).limit(n)


def numbered(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """``df`` with the place of each row, from 0, in the given order; no row passes one task.

    Rows are dealt by ranges, sorted within them and stored with their place there; how many lie in the
    ranges before, one number for each range, is added. Rows alike in all of ``order`` share a range.
    """
    d = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    d = stored(d.select("*", F.spark_partition_id().alias("_range"), at.alias("_at")), "numbered")
    counts = {r["_range"]: r["n"] for r in d.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    before = [sum(n for r, n in counts.items() if r < k) for k in range(max(counts, default=0) + 1)]
    return d.withColumn(name, F.get(F.array(*[F.lit(n).cast("long") for n in before]), F.col("_range")) + F.col("_at")).drop("_range", "_at")


def seeded_order(df: DataFrame, key: str, seed: str, name: str = "place") -> DataFrame:
    """A full shuffle of ``df`` that is the same in every run and engine: places by the hash of key and seed, then by key."""
    mark = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed)).cast("binary"))
    return numbered(df.withColumn("_mark", mark), "_mark", key, name=name).drop("_mark")


def conform(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly ``columns`` in this order; one that is absent is ""."""
    return df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def strata(parts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """The union of named parts, each row with its part's name as ``stratum``."""
    out = None
    for name, part in parts.items():
        rows = conform(part, columns).withColumn("stratum", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def remap(judged: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``judged`` with its key replaced by ``new_id`` of ``ids (key, new_id)``; rows without one go."""
    return judged.join(ids, key).drop(key).withColumnRenamed("new_id", key)
