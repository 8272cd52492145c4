"""Duplicate marking by 5' positions.

Fragments are compared by library and by the 5' positions of their reads, left first. Of fragments
with the same both, the one with the greatest quality sum stays; where a left position has pairs,
single-ended fragments there are duplicates. Best fragments are one aggregate per key, combined
before the shuffle, and come back by a join: no group of fragments is held anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.cigar import five_prime
from strandlake.functions.phred import quality_sum
from strandlake.plans.runtime import cut_lineage


def _position(r=F.col) -> Column:
    """5' position of a read as one text; the sequence for unmapped reads. r gives a field of the read."""
    sign = F.when(F.coalesce(r("readNegativeStrand"), F.lit(False)), "-").otherwise("+")
    mapped = F.concat_ws("\t", r("referenceName"), five_prime(r("start"), r("end"), r("cigar"), r("readNegativeStrand")), sign)
    return F.struct(F.when(r("readMapped"), mapped).otherwise(F.concat(F.coalesce(r("sequence"), F.lit("")), F.lit("\t0"))).alias("at"), F.coalesce(r("readMapped") & r("readNegativeStrand"), F.lit(False)).alias("reverse"))


def _rank(r=F.col) -> Column:
    """What a read of the fragment is taken from first: primary mapped ones, then unmapped ones; null for others."""
    b = lambda c: F.coalesce(r(c), F.lit(False))
    return F.when(b("readMapped") & b("primaryAlignment"), 0).when(~b("readMapped"), 1)


def _score(r=F.col) -> Column:
    b = lambda c: F.coalesce(r(c), F.lit(False))
    return F.when(b("primaryAlignment") & ~b("supplementaryAlignment"), quality_sum(r("qualityScores"))).otherwise(F.lit(0).cast("long"))


def _ends(g: DataFrame) -> DataFrame:
    """Left and right position from those of reads 1 and 2."""
    forward = lambda c: F.col(c).isNotNull() & ~F.col(c)["reverse"]
    reverse = lambda c: F.col(c).isNotNull() & F.col(c)["reverse"]
    left = F.when(forward("r1"), F.col("r1")).when(forward("r2"), F.col("r2")).otherwise(F.col("r1"))["at"]
    right = F.when(reverse("r2"), F.col("r2")).when(reverse("r1"), F.col("r1")).otherwise(F.col("r2"))["at"]
    g = g.withColumns({"left": left, "right": right})
    # A single read is its own left; the other end is then missing, not the same again.
    return g.withColumn("right", F.when(F.col("left").eqNullSafe(F.col("right")), None).otherwise(F.col("right"))).drop("r1", "r2")


def fragment_keys(reads: DataFrame) -> DataFrame:
    """One row per (readGroupId, readName): library, left and right position, score.

    A read of the fragment is its first primary mapped one with that number in the fragment, else
    an unmapped one. Scores sum qualities of at least 15 over primary reads that aren't supplementary.
    """
    read = lambda n: F.min(F.when(_rank().isNotNull() & (F.coalesce("readInFragment", F.lit(0)) == n), F.struct(_rank().alias("rank"), _position().alias("p"))))["p"]
    g = reads.groupBy("readGroupId", "readName", "library").agg(read(0).alias("r1"), read(1).alias("r2"), F.sum(_score()).alias("score"))
    return _ends(g)


def _keys_of_fragments(own: DataFrame) -> DataFrame:
    """As fragment_keys, from the arrays of whole fragments, which go along as `_f`."""

    def read(n: int) -> Column:
        ranked = F.filter("alignments", lambda r: _rank(lambda c: r[c]).isNotNull() & (F.coalesce(r["readInFragment"], F.lit(0)) == n))
        return F.array_min(F.transform(ranked, lambda r: F.struct(_rank(lambda c: r[c]).alias("rank"), _position(lambda c: r[c]).alias("p"))))["p"]

    score = F.aggregate(F.transform("alignments", lambda r: _score(lambda c: r[c])), F.lit(0).cast("long"), lambda x, y: x + y)
    return _ends(own.select("readGroupId", F.col("name").alias("readName"), "library", score.alias("score"), read(0).alias("r1"), read(1).alias("r2"), F.struct(*[F.col(c) for c in own.columns if c != "library"]).alias("_f")))


def best_fragments(keys: DataFrame) -> DataFrame:
    """Per (library, left, right) the fragment that stays, greatest score first, then smallest name and read
    group; null where single-ended fragments stand beside pairs at the same left position."""
    k = keys.where("left is not null")
    best = k.groupBy("library", "left", "right").agg(F.min(F.struct((-F.col("score")).alias("s"), "readName", "readGroupId")).alias("best"))
    paired = best.groupBy(F.col("library").alias("_lib"), F.col("left").alias("_left")).agg(F.max(F.col("right").isNotNull()).alias("paired"))
    j = best.join(paired, F.col("library").eqNullSafe(F.col("_lib")) & (F.col("left") == F.col("_left")))
    return j.withColumn("best", F.when(F.col("right").isNotNull() | ~F.col("paired"), F.col("best")))


def mark_duplicates(reads: DataFrame, read_groups: DataFrame | None = None) -> DataFrame:
    """reads with duplicateRead set anew. read_groups (id, library) gives libraries; without it, or for read
    groups without a library, all reads share one. Ties go to the smallest read name, then read group.

    Unmapped reads are no duplicates; secondary reads of the fragment that stays are.
    """
    if read_groups is not None:
        libs = read_groups.select(F.col("id").alias("readGroupId"), "library").where("readGroupId is not null").dropDuplicates(["readGroupId"])
        reads = reads.drop("library").join(libs, "readGroupId", "left")
        extra = []
    else:
        extra = ["library"] if "library" in reads.columns else []
        reads = reads if extra else reads.withColumn("library", F.lit(None).cast("string"))
    # The keys are used three times; they are one narrow row a fragment.
    keys = cut_lineage(fragment_keys(reads))
    best = best_fragments(keys).select(F.col("library").alias("_lib"), F.col("left").alias("_l"), F.col("right").alias("_r"), "best")
    same = F.col("library").eqNullSafe(F.col("_lib")) & (F.col("left") == F.col("_l")) & F.col("right").eqNullSafe(F.col("_r"))
    stays = F.col("best").isNotNull() & F.col("best.readName").eqNullSafe(F.col("readName")) & F.col("best.readGroupId").eqNullSafe(F.col("readGroupId"))
    marked = keys.join(best, same, "left").select(F.col("readGroupId").alias("_g"), F.col("readName").alias("_n"), F.col("left").alias("_left"), stays.alias("_stays"))
    out = reads.join(marked, F.col("readGroupId").eqNullSafe(F.col("_g")) & F.col("readName").eqNullSafe(F.col("_n")), "left")
    b = lambda c: F.coalesce(F.col(c), F.lit(False))
    duplicate = b("readMapped") & F.col("_left").isNotNull() & F.when(F.col("_stays"), ~b("primaryAlignment")).otherwise(True)
    return out.withColumn("duplicateRead", F.coalesce(duplicate, F.lit(False))).drop("_g", "_n", "_left", "_stays", *([] if extra else ["library"]))


def mark_duplicates_in_fragments(fragments: DataFrame, read_groups: DataFrame | None = None) -> DataFrame:
    """fragments (name, readGroupId, alignments, ...) with duplicateRead of their alignments set anew, without regrouping
    reads: a fragment's key comes from its own array, and what is shuffled is the key."""
    libs = read_groups.select(F.col("id").alias("readGroupId"), "library").where("readGroupId is not null").dropDuplicates(["readGroupId"]) if read_groups is not None else None
    own = fragments.join(libs, "readGroupId", "left") if libs is not None else fragments.withColumn("library", F.lit(None).cast("string"))
    keys = _keys_of_fragments(own)
    best = best_fragments(keys.drop("_f")).select(F.col("library").alias("_lib"), F.col("left").alias("_l"), F.col("right").alias("_r"), "best")
    same = F.col("library").eqNullSafe(F.col("_lib")) & (F.col("left") == F.col("_l")) & F.col("right").eqNullSafe(F.col("_r"))
    stays = F.col("best").isNotNull() & F.col("best.readName").eqNullSafe(F.col("readName")) & F.col("best.readGroupId").eqNullSafe(F.col("readGroupId"))
    j = keys.join(best, same, "left").withColumn("_stays", F.coalesce(stays, F.lit(False)))
    b = lambda c: F.coalesce(c, F.lit(False))
    marked = F.transform("_f.alignments", lambda r: r.withField("duplicateRead", b(r["readMapped"]) & F.col("left").isNotNull() & F.when(F.col("_stays"), ~b(r["primaryAlignment"])).otherwise(True)))
    return j.select(*[marked.alias(c) if c == "alignments" else F.col(f"_f.{c}").alias(c) for c in fragments.columns])
