"""Queries for frames, regions, sorts, conversions and scalar functions, with their SQL. Every query runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.frame import GenomicFrame, Meta
from strandlake.functions import cigar as cg
from strandlake.functions import intervals as iv
from strandlake.functions import phred as ph
from strandlake.functions import text as tx
from strandlake.operators import coverage as cov
from strandlake.operators import features as ft
from strandlake.operators import joins as jn
from strandlake.operators import markdup as md
from strandlake.operators import reads as rd
from strandlake.operators import sequences as sq
from strandlake.operators import variants as va
from strandlake.plans import islands
from strandlake.plans.genomic_queries import _CUT, _MARKDUP, _OVERLAP, _READS, _VAR, _libraries, _numbers, _pairs, _reduced, coverages, event_reads, genotypes, order_features, reads, texts, variants
from strandlake.plans.runtime import table
from strandlake.sources import sinks, text

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).where("readMapped and referenceName is not null")


_MAPPED = f"with {_READS}, m as (select * from reads where mapped and ref is not null)"

# Regions

_LINE = """with x as (select l_orderkey * 10 + l_linenumber id, l_returnflag n1, case when l_linestatus = 'O' then 'R' else l_returnflag end n2, l_partkey % 50 * 10 s1, l_partkey % 50 * 10 + cast(l_quantity as bigint) e1, case when l_orderkey % 3 = 0 then '+' when l_orderkey % 3 = 1 then '-' end t1,
  l_suppkey % 50 * 10 s2, l_suppkey % 50 * 10 + 25 e2, case when l_linenumber % 3 = 0 then '+' when l_linenumber % 3 = 1 then '-' end t2 from lineitem),
y as (select *, n1 = n2 as nm, t1 is not distinct from t2 as st, s1 < e2 and e1 > s2 as near, case when s1 < e2 and e1 > s2 then 0 else greatest(s1, s2) - least(e1, e2) + 1 end as gap from x)"""


@query(
    f"""{_LINE} select id, nm and st and near as overlaps, case when nm then gap end as unstranded_distance, case when nm and st then gap end as distance, coalesce(nm and st and gap <= 20, false) as nearby, coalesce(nm and gap <= 20, false) as nearby_unstranded, nm and gap <= 7 as covers_within, st and nm and gap <= 7 as overlaps_within,
  case when nm and near then least(e1, e2) - greatest(s1, s2) end as covers_by, case when nm and st and gap <= 1 then least(s1, s2) end as merged_start, case when nm and st and gap <= 9 then greatest(e1, e2) end as merged_end, case when nm and st and near and least(e1, e2) - greatest(s1, s2) >= 5 then greatest(s1, s2) end as shared_start,
  case when nm and st and near and least(e1, e2) - greatest(s1, s2) >= 5 then least(e1, e2) end as shared_end, greatest(0, s1 - 200) as padded_start, e1 + 3 as padded_end, e1 - s1 as length, nm as same_name, st as same_strand,
  case when not (nm and near) then s1 || '-' || e1 else concat_ws(',', case when s1 < s2 then s1 || '-' || s2 end, case when e1 > e2 then e2 || '-' || e1 end) end as pieces, case when not (nm and st and near) then s1 || '-' || e1 else concat_ws(',', case when s1 < s2 then s1 || '-' || s2 end, case when e1 > e2 then e2 || '-' || e1 end) end as stranded_pieces from y"""
)
def r2_stranded_algebra(spark: SparkSession, d: str) -> DataFrame:
    """The functions on pairs of regions, with strands, and the pieces that subtraction leaves."""
    third = lambda c: F.when(F.col(c) % 3 == 0, "+").when(F.col(c) % 3 == 1, "-")
    s1, s2 = F.col("l_partkey") % 50 * 10, F.col("l_suppkey") % 50 * 10
    a = iv.Region(F.col("l_returnflag"), s1, s1 + F.col("l_quantity").cast("long"), third("l_orderkey"))
    b = iv.Region(F.when(F.col("l_linestatus") == "O", "R").otherwise(F.col("l_returnflag")), s2, s2 + 25, third("l_linenumber"))
    shared, padded = iv.intersection(a, b, 5), iv.pad(a, 200, 3)
    cut = lambda stranded: F.array_join(F.transform(iv.subtract(a, b, stranded), lambda r: F.concat_ws("-", r["start"], r["end"])), ",")
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), iv.overlaps(a, b).alias("overlaps"), iv.unstranded_distance(a, b).alias("unstranded_distance"), iv.distance(a, b).alias("distance"), iv.is_nearby(a, b, 20).alias("nearby"), iv.is_nearby(a, b, 20, stranded=False).alias("nearby_unstranded"),
        iv.covers(a, b, 7).alias("covers_within"), iv.overlaps(a, b, 7).alias("overlaps_within"), iv.covers_by(a, b).alias("covers_by"), iv.merge(a, b)["start"].alias("merged_start"), iv.merge(a, b, 9)["end"].alias("merged_end"), shared["start"].alias("shared_start"), shared["end"].alias("shared_end"),
        padded.start.alias("padded_start"), padded.end.alias("padded_end"), iv.length(a).alias("length"), iv.same_reference(a, b).alias("same_name"), iv.same_strand(iv.disorient(a), b).alias("_"), iv.same_strand(a, b).alias("same_strand"), cut(False).alias("pieces"), cut(True).alias("stranded_pieces"),
    ).drop("_")


@query("select * from (values ('chr1', 10::bigint, 20::bigint), ('chr2', 5, 9223372036854775807), ('chr3', 7, 8), ('chr4', 0, 9223372036854775807)) t(name, \"start\", \"end\")")
def r13_parsed_regions(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(iv.parse_regions("chr1:10-20,chr2:5+,chr3:7,chr4"), "name string, start long, end long")


@query(f"{_MAPPED} select id from m where ref = 'chr7' and s < 40000000 and e > 0")
def g5_overlapping_region(spark: SparkSession, d: str) -> DataFrame:
    return GenomicFrame(reads(spark, d)).filter_by_overlapping_region("chr7", 0, 40_000_000).df.select("id")


@query(f"with {_READS} select id from reads where exists (select 1 from range(300) t(i) where ref = 'chr' || (i % 20 + 1) and s < i * 400000 + 90000 and e > i * 400000)")
def g6_many_regions(spark: SparkSession, d: str) -> DataFrame:
    """More regions than become comparisons: by a join."""
    return GenomicFrame(reads(spark, d)).filter_by_overlapping_regions([(f"chr{i % 20 + 1}", i * 400_000, i * 400_000 + 90_000) for i in range(300)]).df.select("id")


_ISLANDS = """with c as (select trim(reference_name) ref, start_pos s, end_pos e from coverage where end_pos > start_pos and trim(reference_name) <> '' and coverage_id % 3 = 0),
o as (select ref, s, e, max(e) over (partition by ref order by s, e rows between unbounded preceding and 1 preceding) prev from (select distinct * from c)), k as (select *, sum(case when s <= prev then 0 else 1 end) over (partition by ref order by s, e rows unbounded preceding) n from o), i as (select ref, min(s) s, max(e) e from k group by ref, n),
q as (select coverage_id id, trim(reference_name) ref, start_pos s, end_pos e from coverage where end_pos > start_pos and trim(reference_name) <> '' and coverage_id % 3 <> 0)"""


def _island_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "coverage").where("end_pos > start_pos and trim(reference_name) <> ''").select(F.col("coverage_id").alias("id"), F.trim("reference_name").alias("referenceName"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))
    return c.where("id % 3 <> 0"), islands.merge_overlapping(c.where("id % 3 = 0"), ["referenceName"])


@query(f'{_ISLANDS} select q.id, i.s as "start", i.e as "end" from q join i on q.ref = i.ref and q.s < i.e and q.e > i.s')
def r17_regions_for(spark: SparkSession, d: str) -> DataFrame:
    """The merged regions of one third of coverage that each other interval overlaps."""
    q, i = _island_sides(spark, d)
    return islands.regions_for(q, i).select("left.id", F.col("right.start").alias("start"), F.col("right.end").alias("end"))


@query(f"{_ISLANDS}, h as (select ref, min(s) s, max(e) e from i group by 1) select id from q join h on q.ref = h.ref and q.e > h.s and q.s < h.e")
def r17_has_regions_for(spark: SparkSession, d: str) -> DataFrame:
    return islands.has_regions_for(*_island_sides(spark, d)).select("id")


# Joins against a prepared side, and of mixed widths


def _prepared(spark: SparkSession, d: str) -> tuple[jn.Prepared, DataFrame]:
    return jn.prepare(event_reads(spark, d)), order_features(spark, d)


_R = "select rid, fid from p union all select null, fid from f where fid not in (select fid from p)"
_BY_R = "select f.fid, count(p.rid) as n, cast(coalesce(sum(p.rid), 0) as bigint) as rids from f {how} join p using (fid) group by f.fid"


@query(f"with {_OVERLAP} select rid, fid from p")
def j2_against_prepared(spark: SparkSession, d: str) -> DataFrame:
    p, f = _prepared(spark, d)
    return _pairs(jn.region_join(p, f))


@query(f"with {_OVERLAP} {_R}")
def j4_right_outer_against_prepared(spark: SparkSession, d: str) -> DataFrame:
    p, f = _prepared(spark, d)
    return _pairs(jn.region_join(p, f, "right", right_id="fid"))


@query(f"with {_OVERLAP} {_BY_R.format(how='')}")
def j6_grouped_against_prepared(spark: SparkSession, d: str) -> DataFrame:
    p, f = _prepared(spark, d)
    return _numbers(jn.region_join(p, f, "inner", "right", right_id="fid", agg=_reduced("left", "rid")), "right.fid", "rids")


@query(f"with {_OVERLAP} {_BY_R.format(how='left')}")
def j8_right_outer_grouped_against_prepared(spark: SparkSession, d: str) -> DataFrame:
    p, f = _prepared(spark, d)
    return _numbers(jn.region_join(p, f, "right", "right", right_id="fid", agg=_reduced("left", "rid")), "right.fid", "rids")


@query(
    f"""{_MAPPED}, a as (select id, ref, s, e from m where e > s), c as (select coverage_id fid, trim(reference_name) ref, start_pos s, end_pos e from coverage where end_pos > start_pos union all select -row_number() over (order by ref), ref, 0, max(e) + 1000 from a group by ref)
select fid, count(*) as n, cast(sum(id) as bigint) as ids from c join a on a.ref = c.ref and a.s < c.e and a.e > c.s group by 1"""
)
def j17_mixed_widths(spark: SparkSession, d: str) -> DataFrame:
    """Narrow reads against narrow intervals of which one per reference spans all of it."""
    a = _mapped(spark, d).where("end > start").select("id", "referenceName", "start", "end")
    c = table(spark, d, "coverage").where("end_pos > start_pos").select(F.col("coverage_id").alias("fid"), F.trim("reference_name").alias("referenceName"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))
    # One row per reference.
    spans = a.groupBy("referenceName").agg(F.max("end").alias("m")).select((-F.row_number().over(Window.orderBy("referenceName"))).cast("long").alias("fid"), "referenceName", F.lit(0).cast("long").alias("start"), (F.col("m") + 1000).alias("end"))
    g = jn.shuffle_region_join(a, c.unionByName(spans)).groupBy(F.col("right.fid").alias("fid"))
    return g.agg(F.count("*").alias("n"), F.sum("left.id").alias("ids"))


# Frames


@query(f"with {_READS} select id from reads where mapped union all select id from reads where dup")
def g3_frame_union(spark: SparkSession, d: str) -> DataFrame:
    r = GenomicFrame(reads(spark, d), Meta(samples=("a",)))
    return r.transform(lambda x: x.where("readMapped")).union(r.with_meta(samples=["b"]).transform(lambda x: x.where("duplicateRead"))).df.select("id")


@query(f"{_MAPPED} select ref as \"referenceName\", s as \"start\", e as \"end\", mapq * 1.0::double as score from m where mapq is not null")
def g2_transmuted(spark: SparkSession, d: str) -> DataFrame:
    """Reads as features that score by mapping quality, cached on the way."""
    f = GenomicFrame(_mapped(spark, d)).transform(lambda x: x.where("mappingQuality is not null")).persist()
    out = f.transmute(lambda x: x.select("referenceName", "start", "end", F.col("mappingQuality").cast("double").alias("score")))
    return out.project(lambda c: c != "nothing").df


@query("select * from (values ('references', 'a:5,b:9'), ('samples', 's,t'), ('steps', 'x'), ('header_lines', '##FILTER=<ID=q,Description=\"d\">|##INFO=<ID=AF,Number=A,Type=Float,Description=\"\">|##FORMAT=<ID=PL,Number=G,Type=Integer,Description=\"\">|##INFO=<ID=R3,Number=3,Type=Integer,Description=\"\">')) t(field, value)")
def g14_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata replaced and added to, with header lines of every kind of count."""
    lines = [sinks.header_line("FILTER", "q", description="d"), sinks.header_line("INFO", "AF", "A", "Float"), sinks.header_line("FORMAT", "PL", "G", "Integer"), sinks.header_line("INFO", "R3", "3", "Integer")]
    m = GenomicFrame(spark.range(0).toDF("start")).with_meta(references=[("a", 5)], samples=["s"]).add_meta(references=[("b", 9)], samples=["t", "s"], steps=["x"], header_lines=lines).meta
    rows = [("references", ",".join(f"{n}:{k}" for n, k in m.references)), ("samples", ",".join(m.samples)), ("steps", ",".join(m.steps)), ("header_lines", "|".join(m.header_lines))]
    return spark.createDataFrame(rows, "field string, value string")


@query("select cast(doc_id as varchar) as name, length(text) as length from documents where length(text) > 0")
def g17_references(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary that slices imply."""
    return spark.createDataFrame(sq.create_references(sq.slice_by_length(texts(spark, d), 100)), "name string, length long")


# Orders: rows, and those before their predecessor. Neighbours are compared where they lie, and the ends of partitions with each other.


def inversions(ordered: DataFrame, *keys: str) -> DataFrame:
    """(rows, inversions) of a sorted table by keys without nulls. A window holds a sorted partition, the last one a row per partition."""
    k = ordered.select(F.struct(*[F.expr(x) for x in keys]).alias("k"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    per = k.withColumn("bad", (F.lag("k").over(Window.partitionBy("p").orderBy("i")) > F.col("k")).cast("long")).groupBy("p").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.min_by("k", "i").alias("first"), F.max_by("k", "i").alias("last"))
    border = per.withColumn("cross", (F.lag("last").over(Window.orderBy("p")) > F.col("first")).cast("long"))
    return border.agg(F.sum("n").alias("rows"), (F.coalesce(F.sum("bad"), F.lit(0)) + F.coalesce(F.sum("cross"), F.lit(0))).alias("inversions"))


_ROWS = "select count(*) as rows, 0::bigint as inversions from"


@query(f"with {_READS} {_ROWS} reads")
def a4_sorted_by_name(spark: SparkSession, d: str) -> DataFrame:
    return inversions(rd.sort_by_read_name(reads(spark, d)), "coalesce(readName, '')", "coalesce(readInFragment, -1)")


@query(f"with {_READS} {_ROWS} reads")
def a5_order_by_position(spark: SparkSession, d: str) -> DataFrame:
    return inversions(rd.sort_by_reference_position(reads(spark, d)), "not coalesce(readMapped, false)", "coalesce(if(readMapped, referenceName, readName), '')", "coalesce(if(readMapped, start, 0), -1)")


_BACK = [f"chr{i}" for i in (*range(22, 0, -1), "X", "Y", "M")]


@query(f"with {_READS} {_ROWS} reads")
def a6_order_by_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """By a dictionary in which chromosomes count backwards."""
    names = ",".join(f"'{x}'" for x in _BACK)
    at = f"array_position(array({names}), coalesce(referenceName, ''))"
    return inversions(rd.sort_by_index(reads(spark, d), _BACK), "not coalesce(readMapped, false)", f"if(readMapped and {at} > 0, {at}, 0)", f"if(readMapped and {at} > 0, coalesce(start, -1), 0)")


@query(f"with {_READS} {_ROWS} reads where list_contains({_BACK}, ref)")
def g7_sorted_by_dictionary(spark: SparkSession, d: str) -> DataFrame:
    names = ",".join(f"'{x}'" for x in _BACK)
    f = GenomicFrame(reads(spark, d), Meta(references=tuple((x, 1) for x in _BACK)))
    return inversions(f.sort("lenient").df, f"array_position(array({names}), referenceName)", "coalesce(start, -1)")


@query(f"with {_READS} {_ROWS} reads")
def g8_sorted_lexicographically(spark: SparkSession, d: str) -> DataFrame:
    return inversions(GenomicFrame(reads(spark, d)).sort_lexicographically().df, "referenceName is null", "coalesce(referenceName, '')", "coalesce(start, 9223372036854775807)", "coalesce(end, 9223372036854775807)")


@query(f"{_MAPPED} select count(*) as rows, true as balanced, 0::bigint as inversions from m")
def g9_even_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Eight ranges of the region order: no range holds more than three times its share, and the order goes on over their borders."""
    r = GenomicFrame(_mapped(spark, d)).evenly_repartition(8).df
    most = r.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return inversions(r, "referenceName", "start", "end").crossJoin(most.select((F.col("most") * 8 <= F.col("all") * 3).alias("balanced")))


@query(f"with {_READS} {_ROWS} reads")
def f5_sorted_features(spark: SparkSession, d: str) -> DataFrame:
    """The first five of the 18 keys, nulls last."""
    r = reads(spark, d)
    none = {c: F.lit(None).cast("string") for c in ("featureType", "name", "source", "geneId", "transcriptId", "exonId", "proteinId")} | {c: F.lit(None).cast("int") for c in ("phase", "frame")}
    f = r.select("referenceName", "start", "end", F.when(F.col("readNegativeStrand"), "REVERSE").otherwise("FORWARD").alias("strand"), F.col("id").cast("string").alias("featureId"), F.col("mappingQuality").cast("double").alias("score"), F.map_from_arrays(F.array(F.lit("exon_number")), F.array(F.col("id").cast("string"))).alias("attributes"), *[c.alias(n) for n, c in none.items()])
    return inversions(ft.sort_by_reference(f), "referenceName is null", "coalesce(referenceName, '')", "coalesce(start, 9223372036854775807)", "coalesce(end, 9223372036854775807)", "strand", "featureId")


# Reads


@query(f"with {_READS} select id, 'aligned' as kept from reads where mapped union all select id, 'paired' from reads where paired union all select id, 'unique' from reads where not coalesce(dup, false) union all select id, 'primary' from reads where prim")
def a2_filters(spark: SparkSession, d: str) -> DataFrame:
    r = reads(spark, d)
    kinds = (("aligned", rd.filter_unaligned), ("paired", rd.filter_unpaired), ("unique", rd.filter_duplicates), ("primary", rd.filter_to_primary))
    out = [f(r).select("id", F.lit(k).alias("kept")) for k, f in kinds]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


@query(f"with {_READS} select id, read_name as \"readName\", part as \"readInFragment\", ref as \"referenceName\", s as \"start\", mapq as \"mappingQuality\" from reads")
def a10_fragments_and_back(spark: SparkSession, d: str) -> DataFrame:
    return rd.to_alignments(rd.to_fragments(reads(spark, d))).select("id", "readName", "readInFragment", "referenceName", "start", "mappingQuality")


@query(f"with {_READS} select read_name as name, length(bases) as length, bases as sequence, quals as \"qualityScores\", sample as \"sampleId\", 'DNA' as alphabet from reads")
def a10_plain_reads(spark: SparkSession, d: str) -> DataFrame:
    return rd.to_reads(reads(spark, d)).select("name", "length", "sequence", "qualityScores", "sampleId", "alphabet")


@query(f"{_MARKDUP} where y.rg is not null")
def a14_duplicates_in_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates marked in fragments, read by read equal to those of the reads."""
    f = rd.to_fragments(reads(spark, d).where("readGroupId is not null"))
    return md.mark_duplicates_in_fragments(f, _libraries(spark, d)).select(F.inline("alignments")).select("id", "duplicateRead")


@query(f"with {_READS}, n as (select read_name from reads where part in (0, 1) and read_name is not null group by 1 having count(*) filter (part = 0) = 1 and count(*) filter (part = 1) = 1) select id, read_name as \"readName\", part as \"readInFragment\", true as \"properPair\" from reads where part in (0, 1) and read_name in (select read_name from n)")
def j18_pairs(spark: SparkSession, d: str) -> DataFrame:
    """First and second reads put together by name; names that occur more than once on a side are left out."""
    r = reads(spark, d).where("readName is not null")
    side = lambda i: r.where(F.col("readInFragment") == i).withColumn("readName", F.concat("readName", F.lit(f"/{i + 1}")))
    return rd.reassemble_pairs(side(0), side(1), strict=False).select("id", "readName", "readInFragment", "properPair")


@query(f"with {_READS} select id from reads where sample = 'folqua-424' and rg in ('folqua424.L1', 'folqua424.L2')")
def q10_sample_and_groups(spark: SparkSession, d: str) -> DataFrame:
    return rd.filter_to(rd.filter_to(reads(spark, d), "readGroupSampleId", "folqua-424"), "readGroupId", "folqua424.L1", "folqua424.L2").select("id")


@query(
    f"""with {_READS}, t as (select id, 'NM:i:' || coalesce(mapq, 0) || chr(9) || 'bad' || chr(9) || 'XS:Z:a:' || coalesce(sample, '') || chr(9) || 'NM:i:999' as tags, read_name || case id % 4 when 0 then '/1' when 1 then '_2' when 2 then ' 1:N:0' else '' end as raw, read_name, mapq, sample from reads where read_name is not null)
select id, cast(coalesce(mapq, 0) as varchar) as nm, 'i' as nm_type, 'a:' || coalesce(sample, '') as xs, 2 as tags, read_name as name, case id % 4 when 0 then 0 when 1 then 1 when 2 then 0 end as pair from t"""
)
def x9_tags_and_names(spark: SparkSession, d: str) -> DataFrame:
    r = reads(spark, d).where("readName is not null")
    tags = F.concat_ws("\t", F.concat(F.lit("NM:i:"), F.coalesce("mappingQuality", F.lit(0))), F.lit("bad"), F.concat(F.lit("XS:Z:a:"), F.coalesce("readGroupSampleId", F.lit(""))), F.lit("NM:i:999"))
    k = F.col("id") % 4
    raw = F.concat("readName", F.when(k == 0, "/1").when(k == 1, "_2").when(k == 2, " 1:N:0").otherwise(""))
    t = r.select("id", tx.parse_tags(tags).alias("t"), tx.tag_value(tags, "XS").alias("xs"), tx.strip_pair_suffix(raw).alias("name"), tx.pair_number(raw).alias("pair"))
    return t.select("id", F.col("t")["NM"]["value"].alias("nm"), F.col("t")["NM"]["type"].alias("nm_type"), "xs", F.size("t").alias("tags"), "name", "pair")


@query(
    f"""with {_READS}, p as (select id, mapq, coalesce(mapq, 0) * 4 % 200 p from reads), s as (select *, 1 - pow(10.0::double, -p / 10.0::double) ok from p)
select id, round(ok, 9) as success, case when p <= 0 then cast('-inf' as double) when p < 156 then round(cast(cast(ln(ok) as float) as double), 12) else round(-pow(10.0::double, -p / 10.0::double), 12) end as log_success, cast(floor(p + 0.5) as int) as back,
  case when p = 0 then 0 else cast(floor(-10 * log10(1 - ok) + 0.5) as int) end as error_back from s where p < 100"""
)
def x2_phred(spark: SparkSession, d: str) -> DataFrame:
    """Phred values as chances and logs, and back again."""
    t = reads(spark, d).select("id", (F.coalesce("mappingQuality", F.lit(0)) * 4 % 200).alias("p")).where("p < 100")
    p = F.col("p")
    ok = ph.phred_to_success(p)
    return t.select("id", F.round(ok, 9).alias("success"), F.round(ph.phred_to_log_probability(p), 12).alias("log_success"), ph.error_to_phred(ph.phred_to_error(p)).alias("back"), F.when(p == 0, 0).otherwise(ph.error_to_phred(1.0 - ok)).alias("error_back"))


@query("select l_orderkey * 10 + l_linenumber as id, case when l_discount = 0 then 3233 else cast(floor(-10 * log10(1 - exp(-l_discount)) + 0.5) as int) end as phred, case when l_tax < 1 and l_tax > 0 then cast(floor(-10 * log10(l_tax) + 0.5) as int) end as of_error from lineitem")
def x5_log_probabilities(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return t.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), ph.log_probability_to_phred(-F.col("l_discount")).alias("phred"), ph.error_to_phred(F.col("l_tax")).alias("of_error"))


@query(
    f"""with {_READS} select id, case when cigar <> '*' then regexp_full_match(cigar, '([0-9]+H)?([0-9]+S)?([0-9]+[MIDNP=X])+([0-9]+S)?([0-9]+H)?') end as good, case when cigar <> '*' then cast(len(regexp_extract_all(cigar, '[0-9]+[ID]')) as int) end as indels,
  case when cigar <> '*' then coalesce(try_cast(nullif(regexp_extract(cigar, '^([0-9]+)S', 1), '') as int), 0) end as head, case when cigar <> '*' then coalesce(try_cast(nullif(regexp_extract(cigar, '([0-9]+)S$', 1), '') as int), 0) end as tail, case when cigar <> '*' then cast(len(regexp_extract_all(cigar, '[0-9]+[A-Z=]')) as int) end as elements from reads"""
)
def x7_cigars(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("cigar")
    there = lambda x: F.when(c != "*", x)
    return reads(spark, d).select("id", cg.is_well_formed(c).alias("good"), there(cg.indels(c)).alias("indels"), there(cg.soft_clip(c)["leading"]).alias("head"), there(cg.soft_clip(c)["trailing"]).alias("tail"), there(F.size(cg.elements(c))).alias("elements"))


_IUPAC_TO, _IUPAC_FROM = "TACGYRSWMKVHDBN", "ATGCRYSWKMBDHVN"


@query(f"with {_READS}, b as (select id, translate(coalesce(bases, ''), 'G', case when id % 2 = 0 then 'R' else 'n' end) bases from reads) select id, reverse(translate(upper(bases), '{_IUPAC_FROM}', '{_IUPAC_TO}')) as iupac from b")
def q11_iupac(spark: SparkSession, d: str) -> DataFrame:
    """Reverse complements of codes that stand for several bases; exact, so that others would fail the query."""
    b = reads(spark, d).select("id", F.expr("translate(coalesce(sequence, ''), 'G', if(id % 2 = 0, 'R', 'n'))").alias("b"))
    return b.select("id", tx.reverse_complement(F.col("b"), iupac=True, exact=True).alias("iupac"))


@query(f"with {_READS} select id, '{{\"id\":' || id || case when mapq is not null then ',\"mappingQuality\":' || mapq else '' end || '}}' as json from reads")
def x13_json(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("id", F.to_json(F.struct("id", "mappingQuality")).alias("json"))


# Sequences


@query(
    """with q(name, s, e) as (values ('1', 5, 60), ('1', 300, 1000000), ('2', 0, 7), ('3', 20, 9223372036854775807), ('none', 0, 5))
select name, cast(q.s as bigint) as "start", least(q.e, length(text)) as "end", substr(text, q.s + 1, least(q.e, length(text)) - q.s) as sequence from documents join q on name = cast(doc_id as varchar) where length(text) > 0 and q.s < length(text)"""
)
def q2_slices_of_regions(spark: SparkSession, d: str) -> DataFrame:
    wanted = [("1", 5, 60), ("1", 300, 1_000_000), ("2", 0, 7), ("3", 20, iv.OPEN_END), ("none", 0, 5)]
    return sq.slice_by_regions(texts(spark, d), wanted).select("name", "start", "end", "sequence")


@query(
    "with t as (select cast(doc_id as varchar) name, text, length(text) n from documents where length(text) > 0) select name, 'read' as kind, n as length, repeat('B', n) as rest from t union all select name, 'slice', n, '0-' || n || ' 0/1' from t union all select name, 'sequence', n, text from t union all select name, 'alignment', n, text from t"
)
def q3_conversions(spark: SparkSession, d: str) -> DataFrame:
    """Sequences as reads, slices, sequences again and unmapped alignments."""
    t = texts(spark, d)
    s, r = sq.to_slices(t), sq.to_reads(t)
    one = lambda df, kind, name, n, rest: df.select(F.col(name).alias("name"), F.lit(kind).alias("kind"), n.alias("length"), rest.alias("rest"))
    a = sq.to_alignments(r).where("not readMapped")
    out = one(r, "read", "name", F.col("length"), F.col("qualityScores")).unionAll(one(s, "slice", "name", F.col("length"), F.concat("start", F.lit("-"), "end", F.lit(" "), "index", F.lit("/"), "slices")))
    return out.unionAll(one(sq.to_sequences(s), "sequence", "name", F.col("length"), F.col("sequence"))).unionAll(one(a, "alignment", "readName", F.length("sequence").cast("long"), F.col("sequence")))


@query("with k as (select unnest(list_transform(range(1, greatest(length(text) - 4 + 1, 1) + 1), lambda i: substr(text, i, 4))) kmer from documents where length(text) > 0) select kmer, count(*) as n from k group by 1")
def q4_kmers_of_sequences(spark: SparkSession, d: str) -> DataFrame:
    return sq.count_kmers(texts(spark, d), 4)


@query("select '1' as \"referenceName\", 17::bigint as \"start\", 190::bigint as \"end\", substr(text, 18, 173) as sequence from documents where doc_id = 1")
def q6_extracted(spark: SparkSession, d: str) -> DataFrame:
    return sq.extract(sq.slice_by_length(texts(spark, d), 50), "1", 17, 190)


@query(f"with {_CUT} select cast(doc_id as varchar) as \"referenceName\", 0::bigint as \"start\", length(text) as \"end\", text as sequence from documents where length(text) > 0")
def q7_whole_texts(spark: SparkSession, d: str) -> DataFrame:
    """Regions as long as their sequences, put together from all their slices."""
    t = texts(spark, d)
    regions = t.select(F.col("name").alias("referenceName"), F.lit(0).cast("long").alias("start"), F.col("length").alias("end"))
    return sq.extract_regions(sq.slice_by_length(t, 100), regions, length=100)


# Features and coverage


@query(
    """select o_orderkey as id, case when o_orderkey % 3 = 0 then 'n' || o_orderkey when o_orderkey % 3 = 1 then 'f' || o_orderkey else 't chr1:' || o_orderkey || '-' || (o_orderkey + 9) end as called, case o_orderkey % 4 when 0 then '+' when 1 then '-' when 2 then '?' else '.' end as strand, case when o_orderkey % 2 = 0 then 'db' || o_orderkey end as db,
  case when o_orderkey % 2 = 0 then 'x:y' end as accession, array_to_string(list_sort(list_filter(['ID=' || case when o_orderkey % 3 = 1 then 'f' || o_orderkey end, 'Name=' || case when o_orderkey % 3 = 0 then 'n' || o_orderkey end, 'Parent=p,' || (o_orderkey % 5), 'k=v' || o_orderkey], lambda x: x is not null)), '|') as gathered from orders"""
)
def f8_names_and_attributes(spark: SparkSession, d: str) -> DataFrame:
    """What a feature is called, its strand and cross reference as text and back, and all its attributes together."""
    k = F.col("o_orderkey")
    f = table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("n"), k)).alias("name"), F.when(k % 3 == 1, F.concat(F.lit("f"), k)).alias("featureId"), F.lit("t").alias("featureType"), F.lit("chr1").alias("referenceName"), k.alias("start"), (k + 9).alias("end"),
        F.array(F.lit("p"), (k % 5).cast("string")).alias("parentIds"), F.create_map(F.lit("k"), F.concat(F.lit("v"), k)).alias("attributes"), F.when(k % 4 == 0, "+").when(k % 4 == 1, "-").when(k % 4 == 2, "?").otherwise(".").alias("s"),
    )
    ref = ft.to_dbxref(F.concat(F.lit("db"), "id", F.when(F.col("id") % 2 == 0, ":x:y").otherwise("")))
    all_of = F.array_sort(F.transform(F.map_entries(ft.gather_attributes(f)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return f.select("id", ft.name_of(f).alias("called"), ft.strand_text(ft.to_strand(F.col("s"))).alias("strand"), ref["db"].alias("db"), ref["accession"].alias("accession"), F.array_join(all_of, "|").alias("gathered"))


@query("with c as (select trim(reference_name) ref, start_pos s, end_pos e, cov_count c, nullif(trim(opt_sample_id), '') sample from coverage where cov_count is not null and end_pos > start_pos) select nullif(ref, '') as \"referenceName\", s as \"start\", e as \"end\", c as \"count\", sample as \"optSampleId\" from c")
def f6_coverage_and_back(spark: SparkSession, d: str) -> DataFrame:
    return cov.from_features(cov.to_features(coverages(spark, d)))


# Variants


_GT = f"{_VAR}, g as (select id, ref, s, e, ra, aa, q, split, sample, id % 5 = 0 no_call, id % 40 dp, id % 11 ad, id % 7 rd, id % 3 = 0 applied, id % 6 = 0 passed from v)"


def full_genotypes(spark: SparkSession, d: str) -> DataFrame:
    g, i = genotypes(spark, d), F.col("id")
    return g.withColumns({"readDepth": i % 40, "alternateReadDepth": i % 11, "referenceReadDepth": i % 7, "variantCallingAnnotations": F.struct((i % 3 == 0).alias("filtersApplied"), (i % 6 == 0).alias("filtersPassed"))})


@query(
    f"""{_GT} select id, 'passed' as kept from g where applied and passed union all select id, 'depth' from g where dp >= 20 union all select id, 'alternate' from g where ad >= 5 union all select id, 'reference depth' from g where rd >= 3 union all select id, 'reference' from g where ref in ('chr7', 'chr9')
union all select id, 'samples' from g where sample in ('folqua-424', 'piqua-354') union all select id, 'calls' from g where not no_call"""
)
def v3_genotype_filters(spark: SparkSession, d: str) -> DataFrame:
    g = full_genotypes(spark, d)
    kept = (
        ("passed", va.genotypes_passed(g)), ("depth", va.genotypes_by(g, "readDepth", 20)), ("alternate", va.genotypes_by(g, "alternateReadDepth", 5)), ("reference depth", va.genotypes_by(g, "referenceReadDepth", 3)), ("reference", va.filter_to_reference(g, "chr7", "chr9")), ("samples", va.genotypes_to_samples(g, "folqua-424", "piqua-354")), ("calls", va.filter_no_calls(g)),
    )
    out = [x.select("id", F.lit(k).alias("kept")) for k, x in kept]
    for x in out[1:]:
        out[0] = out[0].unionAll(x)
    return out[0]


@query(
    f"""{_GT} select id, 'passed' as kept from g where applied and passed union all select id, 'depth' from g where dp >= 20 union all select id, 'reference depth' from g where rd >= 3 union all select id, 'quality' from g where not split and q >= 25 union all select id, 'reference' from g where ref = 'chr7'
union all select id, 'no snv' from g where not (length(ra) = 1 and length(aa) = 1) union all select id, 'no mnv' from g where not (length(ra) > 1 and length(ra) = length(aa)) union all select id, 'no indel' from g where length(ra) = length(aa)"""
)
def v1_variant_filters(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    v = variants(spark, d).withColumns({"filtersApplied": i % 3 == 0, "filtersPassed": i % 6 == 0, "annotation": F.struct((i % 40).alias("readDepth"), (i % 7).alias("referenceReadDepth"))})
    kept = (
        ("passed", va.filter_to_passed(v)), ("depth", va.filter_by_read_depth(v, 20)), ("reference depth", va.filter_by_reference_read_depth(v, 3)), ("quality", va.filter_by_quality(v, 25)), ("reference", va.filter_to_reference(v, "chr7")), ("no snv", va.filter_single_nucleotide(v)), ("no mnv", va.filter_multiple_nucleotide(v)), ("no indel", va.filter_indels(v)),
    )
    out = [x.select("id", F.lit(k).alias("kept")) for k, x in kept]
    for x in out[1:]:
        out[0] = out[0].unionAll(x)
    return out[0]


@query(f"{_VAR} select id, ref as \"referenceName\", s as \"start\", ra as \"referenceAllele\", aa as \"alternateAllele\", cast(e as varchar) as end_attribute, 'v' || id as other from v")
def v6_end_attribute(spark: SparkSession, d: str) -> DataFrame:
    """Variants to contexts and genotypes and back, with the end as an attribute."""
    g = genotypes(spark, d)
    old = F.struct(F.create_map(F.lit("END"), F.lit("old"), F.lit("o"), F.concat(F.lit("v"), "id")).alias("attributes"))
    g = g.withColumn("variant", F.col("variant").withField("annotation", old))
    g = va.copy_end_to_attribute(va.contexts_to_genotypes(va.to_variant_contexts(g)))
    at = F.col("variant.annotation.attributes")
    return g.select("id", "referenceName", "start", F.col("variant.referenceAllele").alias("referenceAllele"), F.col("variant.alternateAllele").alias("alternateAllele"), at["END"].alias("end_attribute"), F.concat(F.lit("v"), "id").alias("other"))


@query(f"{_VAR} select ref as \"referenceName\", s as \"start\", e as \"end\", ra as \"referenceAllele\", aa as \"alternateAllele\", count(*) as n from v group by all")
def v7_contexts_and_back(spark: SparkSession, d: str) -> DataFrame:
    v = variants(spark, d)
    return va.contexts_to_variants(va.variants_to_contexts(v)).groupBy(*va.KEY).agg(F.count("*").alias("n"))


_ANN = "aa || '|stop_gained&x' || (id % 3) || '|HIGH|G' || id || '|g1|transcript|t' || (id % 4) || '|coding|' || (id % 9) || '/9|c.1|p.1|' || (id % 50) || '-60/99|7/8|3|' || case when id % 2 = 0 then '' || id else '' end || '|w1&w2'"


@query(f"{_VAR} select id, aa as allele, 'stop_gained,x' || (id % 3) as effects, 'G' || id as gene, cast(id % 9 as int) as rank, 9 as total, cast(id % 50 as int) as cdna, 99 as cdna_length, 3 as protein, null::int as protein_length, case when id % 2 = 0 then cast(id as int) end as distance, 'w1,w2' as messages from v")
def v13_effects(spark: SparkSession, d: str) -> DataFrame:
    """Transcript effects from their text, through effects and text again, beside an entry with too few fields."""
    v = variants(spark, d).select("id", F.col("alternateAllele").alias("aa"))
    e = va.parse_effects(va.format_effects(va.parse_effects(F.concat(F.expr(_ANN), F.lit(",bad|entry")))))
    x = v.select("id", F.inline(e))
    return x.select("id", F.col("alternateAllele").alias("allele"), F.array_join("effects", ",").alias("effects"), F.col("geneName").alias("gene"), "rank", "total", F.col("cdnaPosition").alias("cdna"), F.col("cdnaLength").alias("cdna_length"), F.col("proteinPosition").alias("protein"), F.col("proteinLength").alias("protein_length"), "distance", F.array_join("messages", ",").alias("messages"))


@query("select unnest(['##FORMAT=<ID=GT,Number=1,Type=String,Description=\"Genotype\">', '##INFO=<ID=DP,Number=1,Type=Integer,Description=\"x\">', '##fileformat=VCFv4.2']) as line")
def v12_audited_header(spark: SparkSession, d: str) -> DataFrame:
    """A line that says otherwise of a supported field is replaced, one that lacks is put in."""
    lines = ["##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=2,Type=Float,Description="y">']
    known = [sinks.header_line("INFO", "DP", "1", "Integer", "x"), sinks.header_line("FORMAT", "GT", "1", "String", "Genotype")]
    return spark.createDataFrame([(x,) for x in text.audit_header(lines, known, "silent")], "line string")
