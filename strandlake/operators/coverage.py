"""Coverage of reads, and operators on coverage intervals (referenceName, start, end, count, optSampleId)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.plans.islands import collapse_adjacent, depth_runs

KEYS = ["referenceName", "optSampleId"]


def to_coverage(reads: DataFrame, collapse: bool = True) -> DataFrame:
    """Depth of the mapped reads, gaps in the CIGAR included: runs of equal depth, or one row per base.

    A null sample is a sample of its own. Runs come from a sweep over starts and ends; no base is
    exploded unless asked for.
    """
    mapped = reads.where("readMapped").select("referenceName", F.col("readGroupSampleId").alias("optSampleId"), "start", "end")
    runs = depth_runs(mapped, KEYS).select("referenceName", "start", "end", F.col("depth").cast("double").alias("count"), "optSampleId")
    return runs if collapse else flatten(runs)


def flatten(cov: DataFrame) -> DataFrame:
    """One row per base. Empty intervals have none."""
    one = F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("start")
    return cov.where(F.col("end") > F.col("start")).select("referenceName", one, "count", "optSampleId").select("referenceName", "start", (F.col("start") + 1).alias("end"), "count", "optSampleId")


def coverage(cov: DataFrame, bp_per_bin: int = 1) -> DataFrame:
    """The bases at multiples of bp_per_bin, by stepping over them rather than flattening."""
    first = F.ceil(F.col("start") / F.lit(bp_per_bin)) * bp_per_bin
    rows = cov.withColumn("first", first).where(F.col("first") < F.col("end"))
    return rows.select("referenceName", F.explode(F.sequence(F.col("first"), F.col("end") - 1, F.lit(bp_per_bin).cast("long"))).alias("start"), "count", "optSampleId").select("referenceName", "start", (F.col("start") + 1).alias("end"), "count", "optSampleId")


def aggregated_coverage(cov: DataFrame, bp_per_bin: int = 1) -> DataFrame:
    """Mean count per bin and sample over the bases covered. Intervals are cut at bin borders, not flattened."""
    lo, hi = F.floor(F.col("start") / F.lit(bp_per_bin)), F.floor((F.col("end") - 1) / F.lit(bp_per_bin))
    rows = cov.where(F.col("end") > F.col("start")).withColumn("bin", F.explode(F.sequence(lo, hi)))
    n = F.least("end", (F.col("bin") + 1) * bp_per_bin) - F.greatest("start", F.col("bin") * bp_per_bin)
    g = rows.groupBy("referenceName", "optSampleId", "bin").agg((F.sum(F.col("count") * n) / F.sum(n)).alias("count"))
    start = F.col("bin") * bp_per_bin
    return g.select("referenceName", start.alias("start"), (start + bp_per_bin).alias("end"), "count", "optSampleId")


def collapse(cov: DataFrame) -> DataFrame:
    """Abutting intervals of one sample with equal counts as one; intervals of a sample are taken to be disjoint."""
    out = collapse_adjacent(cov, KEYS, ["count"])
    return out.select("referenceName", "start", "end", "count", "optSampleId")


def to_features(cov: DataFrame) -> DataFrame:
    """Coverage as features whose score is the count."""
    return cov.select(F.concat_ws("-", "referenceName", "start", "end").alias("featureId"), F.col("optSampleId").alias("sampleId"), F.lit("coverage").alias("featureType"), "referenceName", "start", "end", F.col("count").alias("score"))


def from_features(features: DataFrame) -> DataFrame:
    """Features with a score as coverage."""
    return features.where("score is not null").select("referenceName", "start", "end", F.col("score").cast("double").alias("count"), F.col("sampleId").alias("optSampleId"))


def strand_filtered(reads: DataFrame, negative: bool | None) -> DataFrame:
    """Reads of one strand (None: of both)."""
    return reads if negative is None else reads.where(F.coalesce("readNegativeStrand", F.lit(False)) == negative)
