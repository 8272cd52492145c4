"""Queries of the problems on genomic tables (1, 2, 4, 5), with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm import collapse_runs as runs
from strandlake.llm import fuse_groups as fg
from strandlake.llm import percentiles as pc
from strandlake.llm import split_items as si
from strandlake.plans.runtime import join_bounded, key_text, micros, table

# Problem 1


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return fg.keyed_fragments(table(spark, d, "fragments"), table(spark, d, "pipelines"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """By the order of trust alone, which leaves the fusion nothing to decide."""
    return fg.trusted_rows(_keyed(spark, d))


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each group, field by field; of its primary mapped reads the number."""
    out = fg.survivors(table(spark, d, "fragments"), fg.trusted_rows(_keyed(spark, d)))
    return out.withColumn("primary_mapped", F.coalesce(F.size("primary_mapped"), F.lit(-1)))


def p1_fused(spark: SparkSession, d: str) -> DataFrame:
    """The same groups by the votes alone, all sources alike at first."""
    return fg.fuse(_keyed(spark, d))[0]


def p1_sources(spark: SparkSession, d: str) -> DataFrame:
    """Estimated accuracy of each pipeline and field."""
    return fg.fuse(_keyed(spark, d))[1]


def p1_copying(spark: SparkSession, d: str) -> DataFrame:
    """Probability that one pipeline copies another, per field."""
    return fg.fuse(_keyed(spark, d))[2]


_SAID = "lower(trim({c})) not in (" + ", ".join(f"'{x}'" for x in fg.STAND_INS) + ")"
_STRAND = "case when lower(trim({c})) in (" + ", ".join(f"'{x}'" for x in fg.FORWARD) + ") then '+' when lower(trim({c})) in (" + ", ".join(f"'{x}'" for x in fg.REVERSE) + ") then '-' end"
_END = "case when " + _SAID.format(c="{r}_ref_name") + " then trim({r}_ref_name) end || chr(9) || {r}_ref_pos || chr(9) || " + _STRAND.format(c="{r}_ref_strand")
_P1 = f"""
with ranks as (select trim(pipeline_name) p, min(trust_rank) r from pipelines group by 1), ended as (
  select f.*, coalesce(r.r, 2147483647) rank, list_sort(list_filter([{_END.format(r="read1")}, {_END.format(r="read2")}], lambda x: x is not null)) ends, nullif(trim(library), '') lib
  from fragments f left join ranks r on trim(f.pipeline_name) = r.p
), grouped as (
  select *, count(*) over w members, min(fragment_id) over w group_id from ended where len(ends) > 0 window w as (partition by ends, lib)
), stated as (
  select 'insert_size' field_name, * from grouped where insert_size > 0
  union all select 'platform_unit', * from grouped where {_SAID.format(c="platform_unit")}
  union all select 'primary_mapped', * from grouped where len(primary_mapped) > 0
  union all select 'read_group_id', * from grouped where {_SAID.format(c="read_group_id")}
  union all select 'sample_id', * from grouped where {_SAID.format(c="sample_id")}
)
select group_id, field_name, fragment_id from stated where members > 1
qualify row_number() over (partition by group_id, field_name order by rank, updated_at desc nulls last, fragment_id) = 1"""

# Problem 2


def _runs(spark: SparkSession, d: str) -> DataFrame:
    entity = [F.coalesce(key_text("opt_sample_id"), F.lit("")), F.coalesce(key_text("reference_name"), F.lit(""))]
    out = runs.collapse_runs(table(spark, d, "coverage"), entity, "start_pos", "end_pos", "cov_count", ["loaded_at", "coverage_id"], tolerance=0.05, min_rows=2)
    return out.withColumnsRenamed({"entity_0": "sample_id", "entity_1": "reference_name"})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("sample_id", "reference_name", "run_start", "run_end")


def p2_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs with number of rows, length and length-weighted mean count."""
    return _runs(spark, d).withColumn("mean_value", F.round(F.col("mean_value") + 1e-10, 6))


_P2 = """
with latest as (
  select coalesce(trim(opt_sample_id), '') sample_id, coalesce(trim(reference_name), '') reference_name, start_pos s, end_pos e, cov_count v from coverage
  where cov_count is not null and end_pos > start_pos
  qualify row_number() over (partition by 1, 2, 3, 4 order by loaded_at desc nulls last, coverage_id desc) = 1
), marked as (
  select *, case when lag(e) over w = s and abs(v - lag(v) over w) <= 0.05 + 1e-9 then 0 else 1 end opens from latest window w as (partition by sample_id, reference_name order by s, e)
), numbered as (select *, sum(opens) over (partition by sample_id, reference_name order by s, e rows unbounded preceding) run from marked)
""".replace("partition by 1, 2, 3, 4", "partition by coalesce(trim(opt_sample_id), ''), coalesce(trim(reference_name), ''), start_pos, end_pos")

# Problem 4


def sized_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (name, assembly) with size, limits and the blocks of the latest build.

    Size: dna_size of the latest build if positive, else the greatest positive seq_length of the
    name and assembly, else null. Of builds of the same time the one with the greater size holds.
    """
    built = table(spark, d, "twobit_records").select(key_text("seq_name").alias("name"), F.struct(F.coalesce(micros("built_at"), F.lit(-(2**62))).alias("at"), "dna_size", "n_block_starts", "n_block_sizes", "mask_block_starts", "mask_block_sizes").alias("b")).where("name is not null")
    latest = built.groupBy("name").agg(F.max("b").alias("b")).select("name", "b.*").drop("at")
    seqs = table(spark, d, "sequence_records").select(key_text("seq_name").alias("name"), key_text("assembly").alias("assembly"), "seq_length").where("name is not null")
    seqs = seqs.groupBy("name", "assembly").agg(F.max("seq_length").alias("seq_length"))
    limits = table(spark, d, "split_limits").select(key_text("assembly").alias("assembly"), "max_bases", "overlap_bases").where("assembly is not null").groupBy("assembly").agg(F.min_by("max_bases", "max_bases").alias("max_bases"), F.min_by("overlap_bases", "max_bases").alias("overlap_bases"))
    j = join_bounded(seqs, limits, ["assembly"], "left", max_rows=10_000).join(latest, "name", "left")
    return j.withColumn("size", F.when(F.col("dna_size") > 0, F.col("dna_size").cast("long")).when(F.col("seq_length") > 0, F.col("seq_length")))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return si.split_items(sized_sequences(spark, d).where("size > max_bases"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every sequence above its assembly's limit."""
    return _pieces(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Names that the splitter cut into two or more pieces; exact check: none is within its limit."""
    return _pieces(spark, d).where("pieces > 1 and piece_no = 0").select(F.col("name").alias("seq_name")).distinct()


def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    """Split sequences, and what must not be: pieces above the limit, or that don't overlap the one before by just the
    overlap of their assembly, or sequences not covered from their start to their end."""
    s = sized_sequences(spark, d).where("size > max_bases").select(F.col("name").alias("n"), F.col("assembly").alias("a"), "size", "max_bases", "overlap_bases")
    p = _pieces(spark, d).join(s, F.col("name").eqNullSafe(F.col("n")) & F.col("assembly").eqNullSafe(F.col("a")))
    # A window holds the pieces of one sequence.
    before = F.lag("piece_end").over(Window.partitionBy("n", "a").orderBy("piece_no"))
    overlap = F.least(F.coalesce("overlap_bases", F.lit(0)), before)
    bad = F.when(before.isNotNull(), F.col("piece_start") != before - overlap).otherwise(F.col("piece_start") != 0)
    per = p.withColumn("bad", bad).groupBy("n", "a").agg(F.max("size").alias("size"), F.max("piece_end").alias("end"), F.sum(F.col("bad").cast("long")).alias("bad"), F.sum((F.col("piece_end") - F.col("piece_start") > F.col("max_bases")).cast("long")).alias("long"))
    return per.agg(F.count("*").alias("sequences"), F.sum("long").alias("too_long"), F.sum("bad").alias("misplaced"), F.count(F.when(F.col("end") != F.col("size"), 1)).alias("cut_short"))


_P4 = """
with latest as (select trim(seq_name) n, dna_size from twobit_records qualify row_number() over (partition by trim(seq_name) order by built_at desc nulls last, dna_size desc) = 1)
select distinct trim(s.seq_name) seq_name from sequence_records s join split_limits l on trim(s.assembly) = trim(l.assembly) left join latest t on t.n = trim(s.seq_name)
where case when t.dna_size > 0 then t.dna_size when s.seq_length > 0 then s.seq_length end > l.max_bases and trim(s.seq_name) <> ''"""

# Problem 5

AT = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
ERROR = 0.0005
_KEYS = ["sample_id", "reference_name"]


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "coverage").select(F.coalesce(key_text("opt_sample_id"), F.lit("")).alias("sample_id"), F.coalesce(key_text("reference_name"), F.lit("")).alias("reference_name"), "cov_count", "loaded_at")


def _day_counters(spark: SparkSession, d: str) -> DataFrame:
    return pc.day_counters(_coverage(spark, d), _KEYS, "cov_count", AT, ERROR, F.date_format("loaded_at", "yyyy-MM-dd"))


def p5_days(spark: SparkSession, d: str) -> DataFrame:
    """What each loading day hands on: its rows per sample, reference and segment between the percentiles."""
    return _day_counters(spark, d).withColumns({"low": F.round("low", 3), "high": F.round("high", 3)})


def p5_merged(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles from the counters of all loading days put together."""
    return pc.from_counters(pc.merge_days(_day_counters(spark, d), _KEYS), _KEYS, AT).select(*_KEYS, "percentile", F.round("value", 3).alias("value"), "n")


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of cov_count, within 0.0005."""
    return pc.percentiles(_coverage(spark, d), _KEYS, "cov_count", AT, ERROR).withColumn("value", F.round("value", 3))


_P5 = f"""
with cells as (select coalesce(trim(opt_sample_id), '') sample_id, coalesce(trim(reference_name), '') reference_name, cast(floor(cov_count / {2 * ERROR} + 0.5) as bigint) cell, loaded_at from coverage where cov_count is not null and not isnan(cov_count))"""
_P5_RANKED = f"""{_P5}, numbered as (select *, row_number() over w rn, count(*) over (partition by sample_id, reference_name) n from cells window w as (partition by sample_id, reference_name order by cell)),
p as (select unnest({AT}) percentile)
select sample_id, reference_name, cast(percentile as double) percentile, round(cell * cast({2 * ERROR} as double), 3) as value, n from numbered, p where rn = greatest(1, cast(ceil(round(cast(percentile as double) * n, 6)) as bigint))"""

QUERIES = {
    "p1_found": p1_found, "p1_survivors": p1_survivors, "p1_fused": p1_fused, "p1_sources": p1_sources, "p1_copying": p1_copying,
    "p2_found": p2_found, "p2_runs": p2_runs,
    "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_checks": p4_checks,
    "p5_percentiles": p5_percentiles, "p5_days": p5_days, "p5_merged": p5_merged,
}
ORACLE = {
    "p1_found": _P1,
    "p1_survivors": f"""with best as ({_P1}) select group_id, max(case when field_name = 'insert_size' then f.insert_size end) as insert_size, max(case when field_name = 'platform_unit' then trim(f.platform_unit) end) as platform_unit,
cast(coalesce(max(case when field_name = 'primary_mapped' then len(f.primary_mapped) end), -1) as int) as primary_mapped, max(case when field_name = 'read_group_id' then trim(f.read_group_id) end) as read_group_id, max(case when field_name = 'sample_id' then trim(f.sample_id) end) as sample_id
from best join fragments f using (fragment_id) group by group_id""",
    "p2_found": f"{_P2} select sample_id, reference_name, min(s) as run_start, max(e) as run_end from numbered group by sample_id, reference_name, run having count(*) > 1",
    "p2_runs": f"{_P2} select sample_id, reference_name, min(s) as run_start, max(e) as run_end, max(e) - min(s) as length, round(sum(v * (e - s)) / (max(e) - min(s)) + 1e-10, 6) as mean_value, count(*) as rows from numbered group by sample_id, reference_name, run having count(*) > 1",
    "p4_found": _P4,
    "p4_checks": "with x as (" + _P4.replace("select distinct trim(s.seq_name) seq_name from", "select distinct trim(s.seq_name) n, trim(s.assembly) a from") + ") select count(*) as sequences, 0::bigint as too_long, 0::bigint as misplaced, 0::bigint as cut_short from x",
    "p5_percentiles": _P5_RANKED,
    "p5_merged": _P5_RANKED,
    "p5_days": f"""{_P5}, numbered as (select *, row_number() over w rn, count(*) over (partition by sample_id, reference_name) n from cells window w as (partition by sample_id, reference_name order by cell)),
p as (select unnest({AT}) percentile), cuts as (select sample_id, reference_name, list_sort(list_distinct(list(cell))) cut from numbered, p where rn = greatest(1, cast(ceil(round(cast(percentile as double) * n, 6)) as bigint)) group by 1, 2),
j as (select c.*, cut, len(list_filter(cut, lambda x: x < cell)) i, list_contains(cut, cell) hit from cells c join cuts using (sample_id, reference_name))
select sample_id, reference_name, strftime(loaded_at, '%Y-%m-%d') as day, cast(2 * i + cast(hit as int) as int) as segment, round(case when hit then cut[i + 1] when i > 0 then cut[i] end * cast({2 * ERROR} as double), 3) as low, round(cut[i + 1] * cast({2 * ERROR} as double), 3) as high, count(*) as n from j group by all""",
}
