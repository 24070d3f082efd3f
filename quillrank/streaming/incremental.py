"""New completions as they arrive: parsed once each, and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import completions as C


def parse_new(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, key: str = "id", raw: str = "completion", file_format: str = "json") -> None:
    """Parse what has come to source since the last call, and append it to sink (Parquet). A file is read once, and a key kept once;
    both are remembered in checkpoint, so a run that breaks off goes on where it was."""
    rows = spark.readStream.schema(schema).format(file_format).load(source).dropDuplicates([key])
    out = rows.withColumn("_p", C.parsed(F.col(raw))).select("*", "_p.*").drop("_p")
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time: str, by: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """start, by, n over a stream or a table; rows later than the watermark are left out of a stream. An extension."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
