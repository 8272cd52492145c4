"""Percentiles per group over very many values by exact bisection, within a stated error.

Values are put on a grid of twice the error. Per group and percentile an interval of cells is kept;
each pass over the rows counts those below its midpoints (FAN - 1 of them, so one pass does log2(FAN)
halvings) and keeps the interval that holds the target rank, until it is one cell wide. Rows are counted
per group, interval and slot where they are read, so no more than groups x percentiles x FAN counters
leave a task, whatever the number of rows; counters of separate partitions and days add up.

What a day hands on is its counters of rows below, at and between the cells that its groups' percentiles
came out at: at most 2 x percentiles + 1 a group. Those of several days are added (merge_days).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.plans.runtime import cut_lineage, join_bounded

FAN = 256
LARGEST = 4e18


def to_cells(df: DataFrame, keys: list[str], value: str, error: float, day: Column | None = None) -> DataFrame:
    """(_g0, _g1, ..., cell[, day]): keys as texts that tell null from empty, and the grid cell. Null and NaN
    values are left out; infinities and what lies beyond LARGEST cells from 0 count in the outermost cells, where the error isn't held."""
    v = F.col(f"`{value}`").cast("double")
    cell = F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), v / F.lit(2 * error) + F.lit(0.5))))
    own = [F.coalesce(F.concat(F.lit("="), F.col(f"`{k}`").cast("string")), F.lit("")).alias(f"_g{i}") for i, k in enumerate(keys)]
    return df.where(v.isNotNull() & ~F.isnan(v)).select(*own, cell.alias("cell"), *([day.alias("day")] if day is not None else []))


def _named(df: DataFrame, keys: list[str], types: DataFrame) -> list[Column]:
    """The keys as they were."""
    return [F.when(F.col(f"_g{i}") != "", F.substring(f"_g{i}", 2, 2**31 - 1)).cast(types.schema[k].dataType).alias(k) for i, k in enumerate(keys)]


def _resolved(cells: DataFrame, g: list[str], at: list[float]) -> DataFrame:
    """(g, percentile, lo, n, rank) with lo the cell of the percentile."""
    span = cells.groupBy(*g).agg(F.min("cell").alias("lo"), F.max("cell").alias("hi"), F.count("*").alias("n"))
    each = F.explode(F.array(*[F.lit(float(p)) for p in at])).alias("percentile")
    state = span.select(*g, "lo", "hi", "n", F.lit(0).cast("long").alias("below"), each).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.round(F.col("percentile") * F.col("n"), 6))).cast("long"))
    state = cut_lineage(state)
    while state.where("hi > lo").limit(1).count():
        # Percentiles of one group that still share an interval are counted once; intervals of a group are disjoint.
        todo = state.where("hi > lo").withColumn("step", F.ceil((F.col("hi") - F.col("lo") + 1) / F.lit(FAN)))
        spans = todo.groupBy(*g).agg(F.collect_set(F.struct("lo", "hi", "step")).alias("_spans"))
        # One row per group, of at most as many intervals as percentiles; a group with a third of all rows is salted where it isn't sent.
        held = join_bounded(cells, spans, g, "inner", salt_of="cell")
        held = held.withColumn("_s", F.try_element_at(F.filter("_spans", lambda s: (F.col("cell") >= s["lo"]) & (F.col("cell") <= s["hi"])), F.lit(1))).where("_s is not null")
        slots = held.groupBy(*g, F.col("_s.lo").alias("lo"), F.col("_s.hi").alias("hi"), F.col("_s.step").alias("step"), F.floor((F.col("cell") - F.col("_s.lo")) / F.col("_s.step")).alias("slot")).agg(F.count("*").alias("c"))
        # A window holds the at most FAN slots of an interval.
        slots = slots.withColumn("upto", F.sum("c").over(Window.partitionBy(*g, "lo", "hi").orderBy("slot")))
        need = F.col("rank") - F.col("below")
        hit = todo.drop("step").join(slots, [*g, "lo", "hi"]).where((need <= F.col("upto")) & (need > F.col("upto") - F.col("c")))
        narrowed = hit.select(
            *g, (F.col("lo") + F.col("slot") * F.col("step")).alias("lo"), F.least("hi", F.col("lo") + (F.col("slot") + 1) * F.col("step") - 1).alias("hi"), "n", (F.col("below") + F.col("upto") - F.col("c")).alias("below"), "percentile", "rank"
        )
        state = cut_lineage(state.where("hi = lo").unionByName(narrowed))
    return state.select(*g, "percentile", "lo", "n", "rank")


def percentiles(df: DataFrame, keys: list[str], value: str, at: list[float], error: float) -> DataFrame:
    """(keys, percentile, value, n): nearest-rank percentiles, each within `error` of the exact one.

    Null keys are groups. Rank of p among n values is ceil(p * n), at least 1. Groups without values give
    no row. Passes over df: 1 + log(range in cells) / log(FAN), the same for all groups.
    """
    cells = to_cells(df, keys, value, error)
    state = _resolved(cells, [f"_g{i}" for i in range(len(keys))], at)
    return state.select(*_named(state, keys, df), "percentile", (F.col("lo") * F.lit(2 * error)).alias("value"), "n")


def day_counters(df: DataFrame, keys: list[str], value: str, at: list[float], error: float, day: Column) -> DataFrame:
    """(keys, day, segment, low, high, n): the rows of each day in the segments that the group's percentiles, over all
    of df, cut its range into: 2i + 1 is the cell of the i-th of them (low = high), 2i what lies between it and the one before. low
    and high are null at the outer ends. At most 2 * len(at) + 1 rows a group and day; segments without rows are left out."""
    cells = to_cells(df, keys, value, error, day)
    g = [f"_g{i}" for i in range(len(keys))]
    cuts = _resolved(cells.drop("day"), g, at).groupBy(*g).agg(F.sort_array(F.collect_set("lo")).alias("_cuts"))
    held = join_bounded(cells, cuts, g, "inner", salt_of="cell")
    below = F.size(F.filter("_cuts", lambda c: c < F.col("cell")))
    segment = 2 * below + F.array_contains("_cuts", F.col("cell")).cast("int")
    out = held.withColumn("segment", segment).groupBy(*g, "day", "segment", "_cuts").agg(F.count("*").alias("n"))
    edge = lambda i: F.get("_cuts", i) * F.lit(2 * error)
    at_cut = F.col("segment") % 2 == 1
    i = F.floor(F.col("segment") / 2).cast("int")
    return out.select(*_named(out, keys, df), "day", "segment", F.when(at_cut, edge(i)).otherwise(edge(i - 1)).alias("low"), edge(i).alias("high"), "n")


def merge_days(counters: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of several days put together."""
    return counters.groupBy(*keys, "segment", "low", "high").agg(F.sum("n").alias("n"))


def from_counters(counters: DataFrame, keys: list[str], at: list[float]) -> DataFrame:
    """(keys, percentile, value, n) from counters put together of all the days that the segments were made for. Of a part of
    the days, value is null where a percentile lies between two cells; low and high then hold it."""
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    # A window holds the segments of a group, 2 * percentiles + 1 at the most.
    c = counters.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("segment")))
    total = counters.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum("n").alias("total"))
    p = total.select("*", F.explode(F.array(*[F.lit(float(x)) for x in at])).alias("percentile"))
    p = p.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.round(F.col("percentile") * F.col("total"), 6))).cast("long"))
    hit = c.join(p, [*same, F.col("rank") <= F.col("upto"), F.col("rank") > F.col("upto") - F.col("n")])
    return hit.select(*keys, "percentile", F.when(F.col("segment") % 2 == 1, F.col("high")).alias("value"), "low", "high", F.col("total").alias("n"))
