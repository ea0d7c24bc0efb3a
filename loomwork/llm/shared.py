"""What every executor can reach: the folder that the cluster names in spark.checkpoint.dir, checkpoints in it, and sizes taken from the session."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of a batch for a Python worker; with its last row it still fits a chunk of 4 MB, if that row is no longer than the rest.
BATCH_BYTES = 3 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and all runs on this machine, as in tests, a new folder which the session then keeps."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            where = held.get()
        elif spark.sparkContext.master.startswith("local"):
            where = tempfile.mkdtemp(prefix="checkpoints-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder; its lineage ends there, so a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets go of what no DataFrame refers to any more: Spark deletes the shuffle files behind a checkpoint once the driver's garbage is collected, which may otherwise be long after."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Lowers what Spark sends to a Python worker at once to BATCH_BYTES, in the session, since plans are run later: buffers of a batch of Spark's default
    are larger than the chunks that Arrow's pool in the JVM keeps, and freed ones break up that memory, which then grows from task to task. No result depends on it."""
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts: one number."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]


def join_spread(rows: DataFrame, counted: DataFrame, on: list[str], by: list[str], n: str = "n") -> DataFrame:
    """rows joined with counted, which has one row a key (no nulls in it) and in `n` about how many of rows have it.

    A key with more than an even task's share of the rows is dealt by a hash of `by` to as many tasks as it has such shares. There are no more of
    these keys than tasks, so their list is broadcast, and counted's rows of them are repeated no more than twice as often as there are tasks.
    counted is worked out once and kept.
    """
    counted = kept(counted)
    share = max(1, (counted.agg(F.sum(n).alias("n")).first()["n"] or 0) // partitions(rows.sparkSession))
    hot = counted.filter(F.col(n) > share).select(*on, F.ceil(F.col(n) / share).cast("long").alias("_salts"))
    if hot.isEmpty():
        return rows.join(counted.drop(n), on)
    left = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*by), "_salts"), F.lit(0).cast("long"))).drop("_salts")
    right = counted.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1))).drop(n, "_salts")
    return left.join(right, [*on, "_salt"]).drop("_salt")
