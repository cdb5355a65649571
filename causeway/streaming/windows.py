"""Window counts and running moments of streams; the same expressions as the bounded operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str, files_a_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(folder)


def window_counts(events: DataFrame, event: str, ts: str, width: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """(start, event, n) of tumbling windows; events later than the watermark are left out."""
    timed = events.withColumn("_ts", F.col(f"`{ts}`").cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", width).alias("w"), F.col(f"`{event}`").alias("event")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event", "n")


def window_sums(events: DataFrame, columns: list[str], ts: str, width: str, late: str = "10 minutes") -> DataFrame:
    """Count, sums and sums of products of the columns in each window: what moments of any span are made of."""
    timed = events.withColumn("_ts", F.col(f"`{ts}`").cast("timestamp")).withWatermark("_ts", late)
    cols = [F.col(f"`{c}`").cast("double") for c in columns]
    sums = [F.sum(c).alias(f"s_{n}") for c, n in zip(cols, columns, strict=True)]
    products = [F.sum(a * b).alias(f"p_{columns[i]}_{columns[i + j]}") for i, a in enumerate(cols) for j, b in enumerate(cols[i:])]
    return timed.groupBy(F.window("_ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), *sums, *products).select(F.col("w.start").alias("start"), "n", *[F.col(f"s_{c}") for c in columns], *[F.col(f"p_{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]])
