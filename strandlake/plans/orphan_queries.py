"""Problem 3: references of alignments and covariates to records that do not exist at observed_at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.orphans import life_runs, missing_integers, orphan_flag
from strandlake.plans.runtime import key_text, table


def _reference(name: str):
    """A text reference as compared: null, empty and * are none."""
    k = key_text(name)
    return F.nullif(k, F.lit("*"))


def orphans(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, ref_field, row_id, observed_at, why), one row per orphan reference."""
    seqs = life_runs(table(spark, d, "sequence_records"), key_text("seq_name"), F.col("registered_at"), F.col("deleted_at"))
    groups = table(spark, d, "read_groups")
    by_id = life_runs(groups, key_text("rg_id"), F.col("registered_at"), F.col("deleted_at"))
    by_index = life_runs(groups, F.col("rg_index").cast("long"), F.col("registered_at"), F.col("deleted_at"))

    a = table(spark, d, "alignments").select(F.col("alignment_id").alias("row_id"), "reference_name", "read_group_id", "observed_at")
    a = orphan_flag(a, _reference("reference_name"), F.col("observed_at"), seqs, "why_reference", "row_id")
    a = orphan_flag(a, _reference("read_group_id"), F.col("observed_at"), by_id, "why_group", "row_id")
    both = F.array(
        F.struct(F.lit("reference_name").alias("ref_field"), F.col("why_reference").alias("why")),
        F.struct(F.lit("read_group_id").alias("ref_field"), F.col("why_group").alias("why")),
    )
    a = a.where("why_reference is not null or why_group is not null").select(F.lit("alignments").alias("table_name"), "row_id", "observed_at", F.inline(both)).where("why is not null")

    c = table(spark, d, "covariates").select(F.col("covariate_id").alias("row_id"), "read_group_id", "observed_at")
    c = orphan_flag(c, F.col("read_group_id").cast("long"), F.col("observed_at"), by_index, "why", "row_id").where("why is not null")
    c = c.select(F.lit("covariates").alias("table_name"), "row_id", "observed_at", F.lit("read_group_id").alias("ref_field"), "why")
    return a.unionByName(c)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans(spark, d).select("table_name", "ref_field", "row_id")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, field and month of observed_at, in all and by reason."""
    o = orphans(spark, d).withColumn("month", F.date_format("observed_at", "yyyy-MM"))
    n = lambda why: F.count(F.when(F.col("why") == why, 1))
    return o.groupBy("table_name", "ref_field", "month").agg(F.count("*").alias("orphans"), n("unknown").alias("not_yet_or_never"), n("ended").alias("after_end"))


def p3_unused_indexes(spark: SparkSession, d: str) -> DataFrame:
    """Read-group indexes in covariates that no read_groups row has ever carried, with their rows."""
    c = table(spark, d, "covariates").select(F.col("read_group_id").cast("long").alias("rg"))
    return missing_integers(c, "rg", table(spark, d, "read_groups"), "rg_index").groupBy("rg").agg(F.count("*").alias("n"))


_LIVES = """
refs as (
  select 'alignments' table_name, 'reference_name' ref_field, alignment_id row_id, trim(reference_name) k, observed_at t from alignments
  union all select 'alignments', 'read_group_id', alignment_id, trim(read_group_id), observed_at from alignments
  union all select 'covariates', 'read_group_id', covariate_id, cast(read_group_id as varchar), observed_at from covariates
), lives as (
  select 'alignments' table_name, 'reference_name' ref_field, trim(seq_name) k, registered_at s, deleted_at e from sequence_records
  union all select 'alignments', 'read_group_id', trim(rg_id), registered_at, deleted_at from read_groups
  union all select 'covariates', 'read_group_id', cast(rg_index as varchar), registered_at, deleted_at from read_groups
), found as (
  select r.table_name, r.ref_field, r.row_id, r.t,
    not exists (select 1 from lives l where l.table_name = r.table_name and l.ref_field = r.ref_field and l.k = r.k and r.t >= l.s) as never
  from refs r where r.k is not null and r.k not in ('', '*') and not exists (
    select 1 from lives l where l.table_name = r.table_name and l.ref_field = r.ref_field and l.k = r.k and r.t >= l.s and (l.e is null or r.t < l.e))
)"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_unused_indexes": p3_unused_indexes}
ORACLE = {
    "p3_found": f"with {_LIVES} select table_name, ref_field, row_id from found",
    "p3_report": f"with {_LIVES} select table_name, ref_field, strftime(t, '%Y-%m') as month, count(*) as orphans, count(*) filter (where never) as not_yet_or_never, count(*) filter (where not never) as after_end from found group by all",
    "p3_unused_indexes": "select cast(read_group_id as bigint) as rg, count(*) as n from covariates where read_group_id is not null and read_group_id not in (select rg_index from read_groups where rg_index is not null) group by 1",
}
