"""Running statistics over a directory that reads or coverage keep arriving in.

The same expressions as the batch operators, under Structured Streaming: state is one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.operators.reads import flagstat


def read_directory(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_flagstat(reads: DataFrame) -> DataFrame:
    """The flag statistic of all reads so far; at most two rows of state."""
    return flagstat(reads)


def windowed_counts(reads: DataFrame, at: str, every: str, late: str, by: list[str]) -> DataFrame:
    """Reads per time window and key; windows are final once the watermark has passed, later rows are left out."""
    return reads.withWatermark(at, late).groupBy(F.window(at, every), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Append finished rows to Parquet until the directory is read through."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
