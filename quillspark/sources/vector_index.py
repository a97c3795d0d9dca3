"""A vector index as a table: parts of rows in order of their ids, and a manifest that says what each part must hold.

Rows are numbered densely, so row and vector stay aligned by position over all parts, and any range of
positions is a few files. The manifest is written last: an index without one was not finished.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.prep import numbered

#: Rows of a part.
PART = 100_000
#: How far a norm may be from 1.
TOLERANCE = 1e-3


def _described(rows: DataFrame) -> DataFrame:
    """(part, n_rows, first, last, min_dim, max_dim, mark, norm_error): ``mark`` changes with any id, place or component."""
    norm = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    return rows.groupBy("part").agg(
        F.count("*").alias("n_rows"), F.min("place").alias("first"), F.max("place").alias("last"), F.min(F.size("v")).alias("min_dim"), F.max(F.size("v")).alias("max_dim"),
        F.bit_xor(F.xxhash64("place", "id", "v")).alias("mark"), F.round(F.max(F.abs(norm - 1)), 6).alias("norm_error"),
    )


def write_index(corpus: DataFrame, path: str, part: int = PART) -> DataFrame:
    """Writes ``corpus (id, v, ...)`` as an index and returns its manifest; ties of ids keep an order by their vectors' hash."""
    d = numbered(corpus.withColumn("_hash", F.xxhash64("v")), "id", "_hash").drop("_hash")
    d = d.withColumn("part", F.floor(F.col("place") / part).cast("long"))
    d.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    rows = corpus.sparkSession.read.parquet(f"{path}/rows").withColumn("part", F.col("part").cast("long"))
    _described(rows).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return corpus.sparkSession.read.parquet(f"{path}/manifest")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a finished index with their ``part`` and ``place``."""
    spark.read.parquet(f"{path}/manifest").select("part", "mark")
    return spark.read.parquet(f"{path}/rows").withColumn("part", F.col("part").cast("long"))


def check_index(spark: SparkSession, path: str, tolerance: float = TOLERANCE) -> DataFrame:
    """(part, issue): what differs from the manifest, of each part; no row if all is well."""
    want, got = spark.read.parquet(f"{path}/manifest"), _described(read_index(spark, path))
    d = want.alias("w").join(got.alias("g"), "part", "full")
    gone, new = F.col("g.n_rows").isNull(), F.col("w.n_rows").isNull()
    differ = lambda c: ~F.col(f"w.{c}").eqNullSafe(F.col(f"g.{c}"))
    holes = (F.col("g.last") - F.col("g.first") + 1 != F.col("g.n_rows"))
    issues = [
        (gone, "missing part"), (new, "unknown part"), (~gone & ~new & differ("n_rows"), "rows lost or added"), (~gone & holes, "positions are not dense"),
        (~gone & ~new & differ("mark"), "rows changed"), (~gone & (F.col("g.min_dim") != F.col("g.max_dim")), "dimensions differ"), (~gone & (F.col("g.norm_error") > tolerance), "norm is not 1"),
    ]
    return d.select("part", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in issues]))).alias("issue"))
