"""References to records that do not exist at the time of the reference.

Parent keys are compressed to contiguous runs of integers, and a reference is matched as of: to the
last run that begins at or before it. Beyond that run's end it is an orphan. A text key is a stem and
the number it ends in, so names that are numbered through are few runs however many they are. A key
that exists is then placed on the integer axis of time in the same way: the lives of a key are merged
to disjoint runs of microseconds, and the reference is an orphan if there is no run that begins at or
before it, or if it lies beyond that run's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.plans.runtime import cut_lineage, join_bounded, micros

FOREVER = 2**63 - 1
ALWAYS = -(2**63)
KEY_BLOCK = 1 << 16


def integer_key(key: Column, kind: T.DataType) -> tuple[Column, Column]:
    """(stem, number) of a key, one to one; both null for a null key.

    An integer has the empty stem. A text has as its number the up to 18 digits it ends in, and as its stem
    what stands before and how many they are (numbers may be padded with zeros); without any, it is all stem.
    """
    if isinstance(kind, T.IntegralType):
        return F.when(key.isNotNull(), F.lit("")), key.cast("long")
    digits = F.regexp_extract(key, "([0-9]{1,18})$", 1)
    n = F.length(digits)
    return F.when(n == 0, key).otherwise(F.concat(F.left(key, F.length(key) - n), F.lit("#"), n)), F.when(n == 0, F.lit(0).cast("long")).otherwise(digits.cast("long"))


def key_runs(keys: DataFrame) -> DataFrame:
    """Contiguous runs (stem, block, lo, hi, next_lo) of the integers n of each stem.

    Repeated and null keys count once and not at all. Runs are cut at multiples of KEY_BLOCK, so
    every window holds at most KEY_BLOCK rows whatever the number of parents; (stem, block) is the
    join key of the as-of match. An empty table has no runs.
    """
    k = keys.select("stem", "n").where("n is not null").distinct().withColumn("block", F.floor(F.col("n") / F.lit(KEY_BLOCK)))
    inside = Window.partitionBy("stem", "block").orderBy("n")
    runs = k.withColumn("island", F.col("n") - F.row_number().over(inside)).groupBy("stem", "block", "island").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return runs.select("stem", "block", "lo", "hi", F.coalesce(F.lead("lo").over(Window.partitionBy("stem", "block").orderBy("lo")), F.lit(FOREVER)).alias("next_lo"))


def in_run(refs: DataFrame, stem: str, n: str, runs: DataFrame, out: str, row_id: str | None = None) -> DataFrame:
    """refs with a boolean `out`: whether the run that begins at or before (stem, n) reaches it. Runs are broadcast
    if few, else joined with keys salted by row_id, as one block may hold a third of all references."""
    r = runs.select(F.col("stem").alias(stem), F.col("block").alias("_block"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("next_lo").alias("_next"))
    placed = refs.withColumn("_block", F.floor(F.col(n) / F.lit(KEY_BLOCK)))
    matched = join_bounded(placed, r, [stem, "_block"], "left", salt_of=row_id or n, when=(F.col(n) >= F.col("_lo")) & (F.col(n) < F.col("_next")))
    return matched.withColumn(out, F.coalesce(F.col(n) <= F.col("_hi"), F.lit(False))).drop("_block", "_lo", "_hi", "_next")


def integer_runs(parents: DataFrame, key: str) -> DataFrame:
    """key_runs of the integers in `key`, without a stem."""
    return key_runs(parents.select(F.lit("").alias("stem"), F.col(key).cast("long").alias("n"))).drop("stem")


def missing_integers(refs: DataFrame, ref: str, parents: DataFrame, key: str, row_id: str | None = None) -> DataFrame:
    """Rows of refs whose integer `ref` is no parent key. Null references are no references."""
    runs = integer_runs(parents, key).withColumn("stem", F.lit(""))
    r = refs.where(F.col(ref).isNotNull()).withColumns({"_stem": F.lit(""), "_n": F.col(ref).cast("long")})
    return in_run(r, "_stem", "_n", runs, "_there", row_id).where("not _there").select(*refs.columns)


def life_runs(parents: DataFrame, key: Column, born: Column, died: Column) -> DataFrame:
    """Disjoint runs (k, run_start, run_end, next_start) of microseconds in which each key is alive.

    A life runs from born (included) to died (excluded). Null born: since ever; null died: still
    alive; died <= born: no life. Null keys are dropped, repeated rows count once, touching and
    overlapping lives become one run.
    """
    lives = (
        parents.select(key.alias("k"), F.coalesce(micros(born), F.lit(ALWAYS)).alias("s"), F.coalesce(micros(died), F.lit(FOREVER)).alias("e"))
        .where("k is not null and e > s")
        .groupBy("k", "s")
        .agg(F.max("e").alias("e"))
    )
    before = Window.partitionBy("k").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("k").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    marked = lives.withColumn("opens", F.when(F.col("s") <= F.max("e").over(before), 0).otherwise(1)).withColumn("island", F.sum("opens").over(upto))
    runs = marked.groupBy("k", "island").agg(F.min("s").alias("run_start"), F.max("e").alias("run_end"))
    following = F.lead("run_start").over(Window.partitionBy("k").orderBy("run_start"))
    return runs.select("k", "run_start", "run_end", F.coalesce(following, F.lit(FOREVER)).alias("next_start"))


def orphan_flag(refs: DataFrame, key: Column, at: Column, runs: DataFrame, out: str, row_id: str) -> DataFrame:
    """refs with a text column `out`: null where the reference holds, else why it is an orphan.

    runs: as of life_runs.
    - unknown: the key is in no run of keys, or has no life before that time at all
    - ended: the last life that began before it is over
    A null key is no reference and yields null. A null time cannot be placed: such a reference is
    judged at the beginning of time. Runs are broadcast if few, else joined with salted keys.
    """
    kind = runs.schema["k"].dataType
    stem, n = integer_key(F.col("k"), kind)
    lives = cut_lineage(runs.select(stem.alias("stem"), n.alias("n"), "run_start", "run_end", "next_start"))
    own = refs.withColumn("_k", key.cast(kind))
    stem, n = integer_key(F.col("_k"), kind)
    own = own.withColumns({"_stem": stem, "_n": n, "_t": F.coalesce(micros(at), F.lit(ALWAYS))}).drop("_k")
    placed = in_run(own, "_stem", "_n", key_runs(lives), "_there", row_id)
    # The runs of a key are disjoint, so at most one begins at or before _t with no other begun since.
    r = lives.select(F.col("stem").alias("_stem"), F.col("n").alias("_key"), F.col("run_start").alias("_run"), F.col("run_end").alias("_end"), F.col("next_start").alias("_next"))
    placed = placed.withColumn("_key", F.when(F.col("_there"), F.col("_n")))
    joined = join_bounded(placed, r, ["_stem", "_key"], "left", salt_of=row_id, when=(F.col("_t") >= F.col("_run")) & (F.col("_t") < F.col("_next")))
    why = F.when(F.col("_stem").isNull(), None).when(F.col("_end").isNull(), "unknown").when(F.col("_t") >= F.col("_end"), "ended")
    return joined.withColumn(out, why).drop("_stem", "_n", "_t", "_there", "_key", "_run", "_end", "_next")
