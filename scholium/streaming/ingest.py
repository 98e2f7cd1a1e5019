"""Incremental ingest: each run takes what is new, keeps a ledger, and leaves the rest alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema, checkpoint: str, target: str, transform: Callable[[DataFrame], DataFrame], key: str, kind: str = "json") -> int:
    """Appends the transformed rows of files not yet taken to ``target``, once per key; returns how many.

    Files are taken once (the stream's checkpoint), keys once (a ledger is the
    target itself).  A batch that is run again after a failure writes its own
    directory anew, so nothing comes twice.  A second run without new files is
    no work.
    """
    written = [0]

    def step(batch: DataFrame, n: int) -> None:
        out = transform(batch).where(F.col(key).isNotNull()).dropDuplicates([key])
        done = existing(spark, target, n)
        if done is not None:
            out = out.join(done.select(key), key, "left_anti")
        out.write.mode("overwrite").parquet(f"{target}/batch={n}")
        written[0] += spark.read.parquet(f"{target}/batch={n}").count()

    stream = spark.readStream.schema(schema).format(kind).load(source)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return written[0]


def existing(spark: SparkSession, target: str, before: int) -> DataFrame | None:
    """What the batches before one wrote; None if there are none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    paths = [f"{target}/batch={n}" for n in range(before) if fs.exists(path(f"{target}/batch={n}"))]
    return spark.read.option("basePath", target).parquet(*paths) if paths else None


def changed(spark: SparkSession, fingerprint: str, path: str) -> bool:
    """Whether a stored fingerprint differs; the new one is stored by ``remember``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not fs.exists(p) or spark.read.text(path).first().value != fingerprint


def remember(spark: SparkSession, fingerprint: str, path: str) -> None:
    spark.createDataFrame([(fingerprint,)], "value string").coalesce(1).write.mode("overwrite").text(path)
