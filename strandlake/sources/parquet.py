"""Parquet with a metadata file beside it, and the layout partitioned by reference and position bin."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.intervals import Region, in_bins, in_regions

BIN = 1_000_000


def _meta_path(path: str) -> str:
    return path.rstrip("/") + "_meta"


def save_meta(spark: SparkSession, path: str, meta: dict) -> None:
    """Metadata as one JSON line in a folder beside the rows; a few KB, through the file system Spark uses."""
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(_meta_path(path))


def load_meta(spark: SparkSession, path: str) -> dict:
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_meta_path(path))
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        return {}
    return json.loads(spark.read.text(_meta_path(path)).first()[0])


def save(df: DataFrame, path: str, meta: dict | None = None, mode: str = "overwrite", compression: str = "zstd", row_group_bytes: int = 128 << 20) -> None:
    df.write.mode(mode).option("compression", compression).option("parquet.block.size", row_group_bytes).parquet(path)
    save_meta(df.sparkSession, path, meta or {})


def save_partitioned(df: DataFrame, path: str, meta: dict | None = None, bin_size: int = BIN, mode: str = "overwrite", compression: str = "zstd", files_per_bin_rows: int = 5_000_000) -> None:
    """Directories referenceName=/positionBin=. Rows are dealt out by bin so a directory gets few files; a bin
    with very many rows is written by several tasks, by the hash of the row's start."""
    seen = Observation()
    out = df.observe(seen, F.max(F.col("end") - F.col("start")).alias("longest")) if "end" in df.columns else df
    out = out.withColumn("positionBin", F.floor(F.col("start") / F.lit(bin_size)).cast("int"))
    spread_over = F.pmod(F.xxhash64("start"), F.lit(8)) if files_per_bin_rows else F.lit(0)
    out = out.repartition("referenceName", "positionBin", spread_over).sortWithinPartitions("referenceName", "positionBin", "start")
    w = out.write.mode(mode).option("compression", compression)
    if files_per_bin_rows:
        w = w.option("maxRecordsPerFile", files_per_bin_rows)
    w.partitionBy("referenceName", "positionBin").parquet(path)
    longest = seen.get["longest"] if "end" in df.columns else None
    save_meta(df.sparkSession, path, {**(meta or {}), "bin_size": bin_size, "longest": longest or 0})


def load_partitioned(spark: SparkSession, path: str, regions: list[tuple[str, int, int]] | None = None, lookback: int = 1) -> DataFrame:
    """Rows overlapping the regions; only directories of their bins, and `lookback` bins before, are read, or as
    many as the longest row written needs."""
    meta = load_meta(spark, path)
    size = meta.get("bin_size", BIN)
    lookback = max(lookback, -(-meta.get("longest", 0) // size))
    df = spark.read.parquet(path)
    if regions is None:
        return df.drop("positionBin")
    return df.where(in_bins("positionBin", F.col("referenceName"), regions, size, lookback)).where(in_regions(Region.of(), regions)).drop("positionBin")


