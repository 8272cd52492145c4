"""Queries of the general problems on key imbalance (6) and rows that fail to parse (7), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import heavy_pairs as hp
from strandlake.operators import parse_lines as pl
from strandlake.plans.runtime import table

# Problem 6


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hp.heavy_pairs(table(spark, d, "alignments"), table(spark, d, "sequence_records"), table(spark, d, "read_groups")).select("reference_name", "sample_id")


def p6_joined(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every pair, and those of its outer join with sequence records and read groups."""
    return hp.joined_pairs(table(spark, d, "alignments"), table(spark, d, "sequence_records"), table(spark, d, "read_groups")).select("reference_name", "sample_id", "n", "joined_rows")


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Rows, bases covered and mean mapping quality of every pair."""
    return hp.pair_results(table(spark, d, "alignments")).withColumn("mean_mapq", F.round("mean_mapq", 6))


def p6_eager_join(spark: SparkSession, d: str) -> DataFrame:
    """Alignments x sequence records x read groups, rolled up per assembly and library."""
    return hp.eager_join(table(spark, d, "alignments"), table(spark, d, "sequence_records"), table(spark, d, "read_groups"))


_P6 = """with mapped as (select nullif(trim(reference_name), '') reference_name, nullif(trim(read_group_sample_id), '') sample_id, start_pos, end_pos, mapping_quality from alignments where read_mapped
  and trim(reference_name) not in ('', '*') and trim(read_group_sample_id) not in ('', '*'))"""

# Problem 7


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pl.rejected(table(spark, d, "gtf_lines")).select("line_id", "reason")


def p7_features(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines as features."""
    f = pl.features(table(spark, d, "gtf_lines"))
    return f.select("line_id", "seqname", "source", "feature_type", "start_pos", "end_pos", "score", "strand", "frame", F.col("attributes")["gene_id"].alias("gene_id"), F.col("attributes")["transcript_id"].alias("transcript_id"))


_KEYQ = f"[^\\s;{pl.QUOTES}]+".replace("'", "''")
_ITEMQ = f'\\s*({_KEYQ}\\s+("[^"]*"|{_KEYQ})\\s*)?'
_P7 = f"""
with lines as (select line_id, regexp_replace(coalesce(raw_line, ''), '\\r$', '') l from gtf_lines),
records as (select line_id, string_split(l, chr(9)) c from lines where not regexp_full_match(l, '\\s*') and not starts_with(l, '#')),
judged as (select *, case
  when len(c) not in (8, 9) then 'column_count'
  when len(c) = 9 and not regexp_full_match(c[9], '{_ITEMQ}(;{_ITEMQ})*') then 'quoting'
  when c[1] in ('', '.') or regexp_matches(c[1], '\\s') or c[3] in ('', '.') or regexp_matches(c[3], '\\s') then 'invalid_value'
  when not regexp_full_match(c[4], '[0-9]+') or not regexp_full_match(c[5], '[0-9]+') then 'invalid_value'
  when try_cast(c[4] as hugeint) < 1 or try_cast(c[4] as hugeint) > try_cast(c[5] as hugeint) then 'invalid_value'
  when c[6] <> '.' and not regexp_full_match(c[6], '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') then 'invalid_value'
  when c[7] not in ('+', '-', '.') or c[8] not in ('.', '0', '1', '2') then 'invalid_value' end reason from records)"""

QUERIES = {"p6_found": p6_found, "p6_joined": p6_joined, "p6_pairs": p6_pairs, "p6_eager_join": p6_eager_join, "p7_found": p7_found, "p7_features": p7_features}
ORACLE = {
    "p6_found": f"{_P6} select reference_name, sample_id from mapped group by 1, 2 having count(*) >= 0.03 * (select count(*) from mapped)",
    "p6_joined": f"""{_P6}, s as (select trim(seq_name) k, count(*) c from sequence_records group by 1), g as (select trim(sample_id) k, count(*) c from read_groups group by 1)
select reference_name, sample_id, count(*) as n, cast(count(*) * coalesce(any_value(s.c), 1) * coalesce(any_value(g.c), 1) as bigint) as joined_rows from mapped left join s on s.k = reference_name left join g on g.k = sample_id group by 1, 2""",
    "p6_pairs": f"""{_P6}, state as (select reference_name, sample_id, count(*) n, round(avg(mapping_quality), 6) mean_mapq from mapped group by 1, 2),
ordered as (select *, max(end_pos) over (partition by reference_name, sample_id order by start_pos, end_pos rows between unbounded preceding and 1 preceding) prev from mapped where end_pos > start_pos),
cov as (select reference_name, sample_id, sum(greatest(0, end_pos - greatest(start_pos, coalesce(prev, start_pos)))) bases from ordered group by 1, 2)
select reference_name, sample_id, n, mean_mapq, cast(coalesce(bases, 0) as bigint) as bases_covered from state left join cov using (reference_name, sample_id)""",
    "p6_eager_join": f"""{_P6} select nullif(trim(assembly), '') as assembly, nullif(trim(library), '') as library, count(*) as pairs, cast(coalesce(sum(mapping_quality), 0) as bigint) as mapq_sum
from mapped m join sequence_records s on m.reference_name = trim(s.seq_name) join read_groups g on m.sample_id = trim(g.sample_id) group by 1, 2""",
    "p7_found": f"{_P7} select line_id, reason from judged where reason is not null",
    "p7_features": f"""{_P7} select line_id, c[1] as seqname, nullif(c[2], '.') as source, c[3] as feature_type, cast(c[4] as bigint) - 1 as start_pos, cast(c[5] as bigint) as end_pos, case when c[6] <> '.' then cast(c[6] as double) end as score, c[7] as strand, nullif(c[8], '.') as frame,
  nullif(regexp_extract(coalesce(c[9], ''), '(^|;)\\s*gene_id\\s+"?([^";]*)"?\\s*($|;)', 2), '') as gene_id, nullif(regexp_extract(coalesce(c[9], ''), '(^|;)\\s*transcript_id\\s+"?([^";]*)"?\\s*($|;)', 2), '') as transcript_id from judged where reason is null""",
}
