"""Runs of consecutive intervals with (nearly) the same value, each collapsed to one.

Canonical event of a row: whether it continues the row before it (starts where that ends, value
within the tolerance). Row number within the entity minus row number within entity and event is
constant along the continuing rows of a run, and equals the ordinal of the run's first row among
the rows that continue nothing; so it names the run.

An entity may hold a third of all rows, so numbering is done per entity and block of positions.
Disjoint intervals allow at most BLOCK rows a block. Runs that may go on beyond their block, at
most two a block, are merged once more by the same rule per entity; there are at most
2 * (largest position / BLOCK) of them, about 100,000 for a chromosome of 3e9 bases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def _merge(parts: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """One row per run of parts(s, e, first, last, n, weighted) within keys; adds `run_no`, 1 for the first of its keys."""
    w = Window.partitionBy(*keys).orderBy("s", "e")
    # 1e-9 absorbs the binary representation of decimal fractions such as 18.05 - 18.00.
    goes_on = (F.lag("e").over(w) == F.col("s")) & (F.abs(F.col("first") - F.lag("last").over(w)) <= F.lit(tolerance + 1e-9))
    marked = parts.withColumn("goes_on", F.coalesce(goes_on, F.lit(False)))
    in_entity = F.row_number().over(w)
    in_event = F.row_number().over(Window.partitionBy(*keys, "goes_on").orderBy("s", "e"))
    marked = marked.withColumn("run_no", F.when(F.col("goes_on"), in_entity - in_event).otherwise(in_event))
    return marked.groupBy(*keys, "run_no").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("first", "s").alias("first"), F.max_by("last", "s").alias("last"), F.sum("n").alias("n"), F.sum("weighted").alias("weighted")
    )


def collapse_runs(df: DataFrame, entity: list[Column], start: str, end: str, value: str, version: list[str], tolerance: float = 0.0, min_rows: int = 1, block: int = BLOCK) -> DataFrame:
    """(entity_0, entity_1, ..., run_start, run_end, mean_value, rows) of the runs of at least min_rows rows.

    Left out: rows with a null value, a null bound, or end <= start. Of rows with the same entity
    and bounds only the one greatest by `version` counts (null versions are least). Null entities
    are entities. mean_value is weighted by length, `length` is run_end - run_start. An empty
    table gives no rows. Intervals of one entity are taken to be disjoint; where they overlap, a
    row is compared with the one before it in order of start, end.
    """
    keys = [f"entity_{i}" for i in range(len(entity))]
    rows = df.where(F.col(value).isNotNull() & (F.col(end) > F.col(start))).select(
        *[c.alias(k) for c, k in zip(entity, keys)], F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), F.struct(*version, F.col(value).cast("double").alias("value")).alias("v")
    )
    rows = rows.groupBy(*keys, "s", "e").agg(F.max("v")["value"].alias("first"))
    rows = rows.withColumns({"last": F.col("first"), "n": F.lit(1).cast("long"), "weighted": F.col("first") * (F.col("e") - F.col("s")), "block": F.floor(F.col("s") / F.lit(block))})
    parts = _merge(rows, [*keys, "block"], tolerance)
    # Runs within a block are done; they stay with their block, where nothing is left to merge them
    # with, so that one pass over the parts serves both kinds.
    open_ended = (F.col("run_no") == 1) | (F.col("e") >= (F.col("block") + 1) * block)
    parts = parts.withColumn("stitch", F.when(open_ended, F.lit(None).cast("long")).otherwise(F.col("block"))).drop("block", "run_no")
    done = _merge(parts, [*keys, "stitch"], tolerance)
    return done.where(F.col("n") >= min_rows).select(
        *keys, F.col("s").alias("run_start"), F.col("e").alias("run_end"), (F.col("e") - F.col("s")).alias("length"), (F.col("weighted") / (F.col("e") - F.col("s"))).alias("mean_value"), F.col("n").alias("rows")
    )
