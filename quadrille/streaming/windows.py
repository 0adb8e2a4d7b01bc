"""Windowed counts of an event stream, with a watermark for what comes late."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def count_by_window(spark: SparkSession, folder: str, name: str, time: str, kind: str, size: str, late: str = "3650 days") -> DataFrame:
    """(start, kind, n): events of the files of a name in a folder, as a stream, counted by tumbling windows.

    A window is given out in full once it is over and again as it grows; the last count of each is kept.
    """
    schema = spark.read.parquet(f"{folder}/{name}").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    at = F.col(time).cast("timestamp")
    counts = events.withColumn("at", at).withWatermark("at", late).groupBy(F.window("at", size).alias("w"), F.col(kind).alias("kind")).count()
    kept = f"{checkpoint_dir(spark)}/windows-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        rows = batch.select(F.col("w.start").alias("start"), "kind", F.col("count").alias("n"), F.lit(n).alias("batch"))
        rows.write.mode("overwrite").parquet(f"{kept}/out/part={n}")

    run = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{kept}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.parquet(f"{kept}/out")
    return rows.groupBy("start", "kind").agg(F.max_by("n", "batch").alias("n")).select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n")
