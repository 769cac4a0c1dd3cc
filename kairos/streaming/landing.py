"""Incremental hourly landing (the streaming form of the S4 → G2 step).

The study pulls a new year of raw measurements at a time and re-aggregates
everything; here newly landed files are picked up by a file-source stream,
reduced to one row per (entity, hour) with a watermark bounding the state,
and appended to the panel's observation table.  The batch operators then
complete the panel from that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hourly_landing_stream(spark: SparkSession, source_dir: str, schema: T.StructType | str, entity: str, ts: str,
                          value: str, watermark: str = "2 hours", glob: str | None = None,
                          fmt: str = "parquet") -> DataFrame:
    """Streaming (entity, hour) count / mean / strict-mean table.

    The watermark lets Spark drop per-hour state once an hour can no longer
    receive rows, so state stays bounded however long the stream runs.
    """
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    src = r.load(source_dir)
    v = F.col(value)
    # watermarks need TIMESTAMP; with the session pinned to UTC the NTZ wall
    # clock round-trips exactly through the cast
    return (src.withColumn("_event_time", F.col(ts).cast("timestamp"))
               .withWatermark("_event_time", watermark)
               .groupBy(F.col(entity), F.window(F.col("_event_time"), "1 hour").alias("w"))
               .agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"),
                    F.count_if(v.isNull()).alias("n_missing"))
               .select(entity, F.col("w.start").cast("timestamp_ntz").alias("hour"), "n", "mean",
                       F.when(F.col("n_missing") > 0, F.lit(None).cast("double")).otherwise(F.col("mean"))
                        .alias("mean_strict")))


def start_landing(stream: DataFrame, sink_dir: str, checkpoint: str, trigger_seconds: int | None = None):
    """Append finished hours to Parquet; the checkpoint folder must be shared
    storage so a restarted query resumes exactly once."""
    w = (stream.writeStream.format("parquet").outputMode("append")
         .option("path", sink_dir).option("checkpointLocation", checkpoint))
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()
