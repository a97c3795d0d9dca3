"""Work over many rows that may fail or be killed: batches committed one by one, an error column, retries.

A run is a stream over the input's files that ends when they are done. Each batch is written to a folder
of its own number, replacing what a killed attempt left there, and the checkpoint says which are done; so
after a restart no row is lost or doubled. A row whose work raises keeps its message in ``error`` and
does not stop the others; ``retry_failures`` runs those again, and the latest attempt counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def captured(rows: DataFrame, work: Callable[[dict], dict], schema: str) -> DataFrame:
    """``rows`` with the columns of ``schema`` that ``work`` gives for each row, and ``error``, null where it did not raise."""
    from pyspark.sql.types import StringType, StructType

    made = StructType.fromDDL(schema)
    names = made.fieldNames()
    whole = StructType([*rows.schema.fields, *made.fields]).add("error", StringType())

    def run(batches):
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(whole)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    result, error = work(row), None
                    result = {n: result.get(n) for n in names}
                except Exception as e:  # noqa: BLE001 - any failure of one row is its result
                    result, error = dict.fromkeys(names), f"{type(e).__name__}: {e}"
                out.append({**row, **result, "error": error})
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    return rows.mapInArrow(run, whole)


def run_batches(spark: SparkSession, source: str, target: str, checkpoint: str, work: Callable[[dict], dict], schema: str, files: int = 16) -> StreamingQuery:
    """Starts a run over the Parquet files of ``source``, ``files`` of them a batch; started again it goes on where it was."""
    rows = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files).parquet(source)

    def commit(batch: DataFrame, number: int) -> None:
        captured(batch, work, schema).withColumn("attempt", F.lit(0)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The latest attempt of each key."""
    d = spark.read.parquet(target).drop("batch")
    last = d.groupBy(key).agg(F.max("attempt").alias("attempt"))
    return d.join(last, [key, "attempt"], "left_semi")


def retry_failures(spark: SparkSession, target: str, key: str, work: Callable[[dict], dict], schema: str) -> None:
    """Runs the rows again whose latest attempt failed, as one more batch."""
    from pyspark.sql.types import StructType

    failed = results(spark, target, key).where("error is not null")
    attempt = (spark.read.parquet(target).agg(F.max("attempt")).first()[0] or 0) + 1
    again = failed.drop("error", "attempt", *StructType.fromDDL(schema).fieldNames())
    captured(again, work, schema).withColumn("attempt", F.lit(attempt)).write.mode("overwrite").parquet(f"{target}/batch=retry-{attempt}")
