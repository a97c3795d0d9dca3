"""Routing of questions as they arrive: the batch rules over a stream, resumed from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions import rules as R


def routed(turns: DataFrame) -> DataFrame:
    """User turns with their route; the same for a table and for a stream."""
    return turns.where(F.col("role") == "user").select("conv_id", "turn", R.route(F.col("text")).alias("r")).select("conv_id", "turn", "r.*")


def route_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Routes what is new in the Parquet folder ``source`` into ``target``, then stops; a later call goes on from there."""
    schema = spark.read.parquet(source).schema
    stream = routed(spark.readStream.schema(schema).parquet(source))
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
