"""CSV and JSON-lines tables with declared schemas, column checks, and appending with resume."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str, line_breaks: bool = True) -> DataFrame:
    """A CSV table with a header; blank text is null; types are never guessed.

    Quoted line breaks make each file one task; without ``line_breaks`` large files are split.
    """
    df = spark.read.schema(schema).option("header", True).option("multiLine", line_breaks).option("escape", '"').csv(path)
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    return df.select(*[F.when(F.trim(F.col(f"`{c}`")) != "", F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns])


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of one JSON object a line: every line that is not blank is in one of them.

    A bad line is no JSON object or does not fit ``schema``; it comes as (file, line), ``line`` its text, so
    what was lost can be counted and read again. Both read the files once each, only as text.
    """
    shape = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rescued = StructType([*shape.fields]).add("_bad", StringType())
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file")).where(F.trim("value") != "")
    read = lines.select("value", "file", F.from_json("value", rescued, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    # null and lists parse, but are no objects
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.ltrim("value").startswith("{")
    return read.where(~bad).select(*[F.col(f"r.`{f.name}`").alias(f.name) for f in shape.fields]), read.where(bad).select("file", F.col("value").alias("line"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """Overwrites ``path`` with one object a line; null fields are written, so every row has all columns."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrites ``path``; arrays are joined by bars."""
    lists = {c for c, kind in df.dtypes if kind.startswith("array")}
    flat = df.select(*[F.array_join(c, "|").alias(c) if c in lists else F.col(f"`{c}`") for c in df.columns])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def missing_columns(df: DataFrame, required: list[str], alternatives: list[tuple[str, ...]] = ()) -> list[str]:
    """Required columns that are absent; of alternatives one is enough."""
    gone = [c for c in required if c not in df.columns]
    return gone + ["|".join(group) for group in alternatives if not set(group) & set(df.columns)]


def append_remaining(source: DataFrame, path: str, key: str, work) -> int:
    """Applies ``work`` to the rows of ``source`` whose key is not in the Parquet table ``path`` yet, and appends.

    Returns the rows appended, counted while they are written. The anti join comes before ``work``, so
    finished rows cost nothing.
    """
    spark = source.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        todo = source
    else:
        todo = source.join(done, key, "left_anti")
    written = Observation()
    work(todo).observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return written.get["n"]
