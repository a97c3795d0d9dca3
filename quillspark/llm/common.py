"""What several operators of this subpackage share: the shared folder, checkpoints, files, CRCs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of an Arrow batch of whole texts. Spark's default is 64 MB, of which the JVM and the Python worker of each
#: running task hold one going in and one coming out.
BATCH_BYTES = "8m"
#: Words of every word-based operator: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space that ends a word.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests) a fresh local folder is used;
    on a cluster its absence is an error, as executors and driver would not see each other's files.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder once, with its lineage cut; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of the session's plans hold ``BATCH_BYTES`` at most, where it has no setting of its own.

    No result depends on it; it stays set, as plans are run after they are declared.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new, empty location of files under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """(pyarrow file system, path) of a location given as a path or as a URI of a store that executors share.

    ``s3a`` and ``s3n`` are names of ``s3``, ``abfss`` of ``abfs``. A scheme that neither side knows is an
    error, as it would else be taken for a folder of one machine.
    """
    from pyarrow import fs

    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", uri)
    if not scheme:
        return fs.LocalFileSystem(), uri
    name = scheme[1].lower()
    if name == "file":
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri, flags=re.IGNORECASE)
    name = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(name, name)
    if name not in ("s3", "gs", "hdfs", "viewfs", "abfs"):
        raise ValueError(f"no file system is known for {uri!r}; spark.checkpoint.dir must name a file, s3a, gs, hdfs or abfs location")
    return fs.FileSystem.from_uri(f"{name}{uri[len(scheme[1]):]}")


def words_of(text) -> "F.Column":
    """Array of the words of a text column, in order; null text and blank text give an empty array."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+", -1)).otherwise(
        F.array().cast("array<string>")
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and reread: lineage and partitioning are cut.

    Unlike after a checkpoint, a join deals out both sides anew, so adaptive execution can split skew.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
