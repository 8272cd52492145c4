"""Queries that send whole tables through writers and readers of formats, and the kernels on reads.

A reader takes lines from a path or from a text column. Files lie in the application's part of the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.frame import GenomicFrame, Meta
from strandlake.functions.mdtag import mismatch_positions
from strandlake.functions.text import pair_number
from strandlake.operators import coverage as cov
from strandlake.operators import features as ft
from strandlake.operators import reads as rd
from strandlake.operators.bqsr import observe, recalibrate
from strandlake.operators.mdtags import compute_mismatching_positions, left_normalize_indels
from strandlake.operators.pipe import pipe
from strandlake.operators.realign import realign_indels
from strandlake.operators.variants import to_variant_contexts
from strandlake.plans.genomic_queries import _COV, _READS, coverages, reads
from strandlake.plans.islands import with_genome_bins
from strandlake.plans.runtime import scratch, table
from strandlake.sources import binary, load, sinks, text

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_SAM_SQL = f"""with {_READS}, x as (select *, coalesce(mapped, false) m, coalesce(paired, false) p from reads)
select read_name as "readName", bases as sequence, quals as "qualityScores", case when m then ref end as "referenceName", case when m and ref is not null then s end as "start", case when m and ref is not null then e end as "end", case when m then mapq end as "mappingQuality", case when m then cigar end as cigar,
  nullif(isize, 0) as "insertSize", mate as "mateReferenceName", case when mate is not null then mate_start end as "mateAlignmentStart", p as "readPaired", coalesce(proper, false) as "properPair", m as "readMapped", p and mate_start is not null as "mateMapped", coalesce(neg, false) as "readNegativeStrand",
  case when p and part = 1 then 1 else 0 end as "readInFragment", not (m and not coalesce(prim, true)) as "primaryAlignment", coalesce(dup, false) as "duplicateRead", rg as "readGroupId" from x"""
_SAM_COLUMNS = ["readName", "sequence", "qualityScores", "referenceName", "start", "end", "mappingQuality", "cigar", "insertSize", "mateReferenceName", "mateAlignmentStart", "readPaired", "properPair", "readMapped", "mateMapped", "readNegativeStrand", "readInFragment", "primaryAlignment", "duplicateRead", "readGroupId"]


def _sam_reads(spark: SparkSession, d: str) -> DataFrame:
    """All reads, with a start and end of their reference where they are mapped."""
    r = reads(spark, d)
    there = F.col("readMapped") & F.col("referenceName").isNotNull()
    own = {c: F.when(there, F.col(c)) for c in ("start", "end")} | {c: F.when(F.col("readMapped"), F.col(c)) for c in ("referenceName", "cigar", "mappingQuality")}
    return r.withColumns(own)


@query(_SAM_SQL)
def s5_sam_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All reads, unmapped ones too, to SAM files and back."""
    path = scratch(spark, "a.sam")
    sinks.save_sam(_sam_reads(spark, d), path)
    return load.load_alignments(spark, path).df.select(*_SAM_COLUMNS)


_FOLD = 1 << 29


@query(_SAM_SQL.replace("x as (select *,", f"x as (select * replace (s % {_FOLD} as s, s % {_FOLD} + e - s as e, mate_start % {_FOLD} as mate_start),"))
def s5_bam_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All reads to BAM files and back, in ranges of 100,000 bytes. Positions are taken modulo 2^29, as the format holds none above 2^31."""
    at = F.col("start") % _FOLD
    path, r = scratch(spark, "a.bam"), _sam_reads(spark, d).withColumns({"start": at, "end": at + F.col("end") - F.col("start"), "mateAlignmentStart": F.col("mateAlignmentStart") % _FOLD})
    names = [x[0] for x in r.selectExpr("explode(array(referenceName, mateReferenceName)) n").where("n is not null").distinct().orderBy("n").toLocalIterator()]
    binary.save_bam(r, path, [(n, 2**31 - 1) for n in names])
    return binary.read_bam(spark, path, size=100_000).select(*_SAM_COLUMNS)


@query("with q as (" + _SAM_SQL + """), y as (select *, "primaryAlignment" prim, "readMapped" m, "readPaired" p, "mateMapped" mm from q) select false as "failedQuality", count(*) as total, count(*) filter (m) as mapped, count(*) filter (p and prim) as "pairedInSequencing", count(*) filter (p and prim and "readInFragment" = 0) as read1, count(*) filter (p and prim and "readInFragment" = 1) as read2, count(*) filter (p and prim and m and not mm) as singleton, count(*) filter ("duplicateRead" and prim) as "duplicatesPrimary", count(*) filter ("duplicateRead" and not prim) as "duplicatesSecondary" from y""")
def a13_flagstat_of_sam(spark: SparkSession, d: str) -> DataFrame:
    """The flag statistic of reads that went through SAM."""
    path = scratch(spark, "a.sam")
    sinks.save_sam(_sam_reads(spark, d), path)
    return rd.flagstat(load.load_alignments(spark, path).df).select("failedQuality", "total", "mapped", "pairedInSequencing", "read1", "read2", "singleton", "duplicatesPrimary", "duplicatesSecondary")


@query(
    """with l as (select string_split(regexp_replace(raw_line, '\\r$', ''), chr(9)) c from gtf_lines where raw_line is not null and trim(raw_line) <> '' and not starts_with(raw_line, '#') and not starts_with(raw_line, '>'))
select nullif(c[1], '.') as "referenceName", nullif(c[3], '.') as "featureType", try_cast(case when regexp_full_match(c[4], '\\s*[+-]?[0-9]+\\s*') then c[4] end as bigint) - 1 as "start", try_cast(case when regexp_full_match(c[5], '\\s*[+-]?[0-9]+\\s*') then c[5] end as bigint) as "end" from l where len(c) in (8, 9)"""
)
def s14_gtf(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "gtf_lines").select(F.col("raw_line").alias("value")).where("value is not null")
    return text.read_gtf(spark, lines).select("referenceName", "featureType", "start", "end")


@query(f"with {_COV} select ref as \"referenceName\", s as \"start\", e as \"end\", c as score from cov")
def s12_bed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    f = cov.to_features(coverages(spark, d)).withColumns({"name": F.lit(None).cast("string"), "strand": F.lit(None).cast("string")})
    return text.read_bed(spark, sinks.bed_lines(f)).select("referenceName", "start", "end", "score")


@query(f"with {_READS} select '@' || read_name || case when coalesce(paired, false) then '/' || (part + 1) else '' end || chr(10) || bases || chr(10) || '+' || chr(10) || quals as value from reads where bases is not null and quals is not null and read_name is not null and (part is not null or not coalesce(paired, false))")
def k4_fastq_lines(spark: SparkSession, d: str) -> DataFrame:
    r = reads(spark, d).withColumn("originalQualityScores", F.lit(None).cast("string"))
    return sinks.fastq_lines(r.where("qualityScores is not null and readName is not null and (readInFragment is not null or not readPaired)"))


@query(f"with {_READS} select 'r' || id as name, nullif(coalesce(rg, ''), '') as description, bases as sequence, length(bases) as length from reads where bases is not null and bases <> ''")
def k7_fasta_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Bases of reads as FASTA files of lines of 20 and back, bodies and heads."""
    path = scratch(spark, "a.fa")
    r = reads(spark, d).where("sequence <> ''").select(F.concat(F.lit("r"), "id").alias("name"), F.col("readGroupId").alias("description"), "sequence")
    sinks.save_fasta(r, path, width=20)
    return load.load_sequences(spark, path).df.select("name", "description", "sequence", "length")


@query(f"with {_READS} select 'r' || id as \"readName\", bases as sequence, repeat('B', cast(length(bases) as int)) as \"qualityScores\", false as \"readMapped\" from reads where bases is not null and bases <> ''")
def q12_fasta_as_reads(spark: SparkSession, d: str) -> DataFrame:
    """FASTA files loaded as unmapped reads."""
    path = scratch(spark, "a.fa")
    sinks.save_fasta(reads(spark, d).where("sequence <> ''").select(F.concat(F.lit("r"), "id").alias("name"), F.lit(None).cast("string").alias("description"), "sequence"), path)
    return load.load_alignments(spark, path).df.select("readName", "sequence", "qualityScores", "readMapped")


@query(f"with {_READS}, c as (select 'r' || id name, bases, length(bases) total, unnest(range(0, length(bases), 16)) pos from reads where bases is not null and bases <> '') select name, pos as \"start\", least(pos + 16, total) as \"end\", substr(bases, pos + 1, 16) as sequence, total as \"totalLength\" from c")
def s20_slices_of_fasta(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "a.fa")
    sinks.save_fasta(reads(spark, d).where("sequence <> ''").select(F.concat(F.lit("r"), "id").alias("name"), F.lit(None).cast("string").alias("description"), "sequence"), path)
    return load.load_slices(spark, path, 16).df.select("name", "start", "end", "sequence", "totalLength")


_FQ = f"with {_READS}, f as (select read_name, coalesce(part, 0) part, bases, quals from reads where length(bases) > 1 and length(bases) = length(quals) and quals <> '*' and read_name is not null and part in (0, 1))"


def _fastq_reads(spark: SparkSession, d: str) -> DataFrame:
    r = reads(spark, d).where("length(sequence) > 1 and length(sequence) = length(qualityScores) and readName is not null and readInFragment in (0, 1)")
    return r.withColumns({"readPaired": F.lit(True), "originalQualityScores": F.lit(None).cast("string")})


@query(f'{_FQ} select read_name as "readName", part as "readInFragment", bases as sequence, quals as "qualityScores" from f')
def s7_fastq_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Reads to FASTQ files and back in ranges of 50,000 bytes, the number in the fragment from the name."""
    path = scratch(spark, "a.fq")
    sinks.save_fastq(_fastq_reads(spark, d), path)
    records = text._fastq_records(spark, path, size=50_000)
    return text._fastq(records, F.coalesce(pair_number(F.regexp_extract("head", r"^(\S*)", 1)), F.lit(0)), False).select("readName", "readInFragment", "sequence", "qualityScores")


_TWICE = "n as (select read_name from f group by 1 having count(*) filter (part = 0) = 1 and count(*) filter (part = 1) = 1)"


@query(f'{_FQ}, {_TWICE} select read_name as "readName", part as "readInFragment", bases as sequence, true as "readPaired" from f where read_name in (select read_name from n)')
def s7_paired_fastq_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Pairs to two files, one per end, and back."""
    r = _fastq_reads(spark, d)
    pairs = r.groupBy("readName").agg(F.count(F.when(F.col("readInFragment") == 0, 1)).alias("a"), F.count(F.when(F.col("readInFragment") == 1, 1)).alias("b")).where("a = 1 and b = 1").select("readName")
    one, two = scratch(spark, "a.fq"), scratch(spark, "b.fq")
    sinks.save_paired_fastq(r.join(pairs, "readName"), one, two)
    return load.load_alignments(spark, one, two).df.select("readName", "readInFragment", "sequence", "readPaired")


@query(f"""{_FQ}, {_TWICE} select read_name as name, max(case when part = 0 then bases end) as first, max(case when part = 1 then bases end) as second from f where read_name in (select read_name from n) group by 1""")
def s9_interleaved_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Pairs as interleaved FASTQ and back as fragments."""
    path = scratch(spark, "a.ifq")
    f = rd.to_fragments(_fastq_reads(spark, d).withColumn("readGroupId", F.lit(None).cast("string")))
    sides = F.transform("alignments", lambda a: a["readInFragment"])
    f = f.where((F.size("alignments") == 2) & (F.array_min(sides) == 0) & (F.array_max(sides) == 1))
    sinks._write(sinks.interleaved_fastq_lines(f), path, False, None, "overwrite", None)
    back = load.load_fragments(spark, path).df
    of = lambda n: F.filter("alignments", lambda a: a["readInFragment"] == n)[0]["sequence"]
    return back.select("name", of(0).alias("first"), of(1).alias("second"))


# Lines of features, one per order. The same text is an expression of Spark and of SQL.

_K = "o_orderkey"
_BED = f"'chr' || ({_K} % 5 + 1) || chr(9) || ({_K} * 37 % 432000) || chr(9) || ({_K} * 37 % 432000 + 30) || chr(9) || case when {_K} % 7 = 0 then '.' else 'n' || {_K} end || chr(9) || ({_K} % 1000) || chr(9) || case {_K} % 4 when 0 then '+' when 1 then '-' when 2 then '.' else '?' end"
_BED_SQL = f"""'chr' || ({_K} % 5 + 1) as "referenceName", {_K} * 37 % 432000 as "start", {_K} * 37 % 432000 + 30 as "end", case when {_K} % 7 <> 0 then 'n' || {_K} end as name, cast({_K} % 1000 as double) as score, case {_K} % 4 when 0 then 'FORWARD' when 1 then 'REVERSE' when 2 then 'INDEPENDENT' else 'UNKNOWN' end as strand"""
_BED_COLUMNS = ["referenceName", "start", "end", "name", "score", "strand"]


def _lines(spark: SparkSession, d: str, expression: str, head: list[str] = (), named: bool = False) -> DataFrame:
    """named: without the orders whose BED lines have no name."""
    lines = table(spark, d, "orders").where(f"not {named} or {_K} % 7 <> 0").select(F.expr(expression).alias("value"))
    return lines.unionAll(spark.createDataFrame([(x,) for x in head], "value string")) if head else lines


def _attribute(k: str):
    return F.try_element_at("attributes", F.lit(k))


@query(f"select {_BED_SQL}, '' || ({_K} + 1) as \"thickStart\", case when {_K} % 2 = 0 then '255,0,0' end as \"itemRgb\", '0,20' as \"blockStarts\" from orders")
def s12_bed_columns(spark: SparkSession, d: str) -> DataFrame:
    """All twelve columns; tracks and comments are no rows."""
    more = f" || chr(9) || ({_K} + 1) || chr(9) || ({_K} + 2) || chr(9) || case when {_K} % 2 = 0 then '255,0,0' else '.' end || chr(9) || '2' || chr(9) || '10,10' || chr(9) || '0,20'"
    f = text.read_bed(spark, _lines(spark, d, _BED + more, ["track name=x", "# c", ""]))
    return f.select(*_BED_COLUMNS, *[_attribute(k).alias(k) for k in ("thickStart", "itemRgb", "blockStarts")])


@query(f"select {_BED_SQL}, '1.5' as \"signalValue\", '' || ({_K} % 9) as \"pValue\", '3' as \"qValue\", '4' as peak from orders")
def s15_narrow_peak(spark: SparkSession, d: str) -> DataFrame:
    f = text.read_narrow_peak(spark, _lines(spark, d, f"{_BED} || chr(9) || '1.5' || chr(9) || ({_K} % 9) || chr(9) || '3' || chr(9) || '4'"))
    return f.select(*_BED_COLUMNS, *[_attribute(k).alias(k) for k in ("signalValue", "pValue", "qValue", "peak")])


@query(f"""select 'chr' || ({_K} % 5 + 1) as "referenceName", {_K} as "start", {_K} + 20 as "end", case when {_K} % 2 = 0 then 'FORWARD' else 'REVERSE' end as strand, 'n' || {_K} as name from orders""")
def s16_interval_list(spark: SparkSession, d: str) -> DataFrame:
    line = f"'chr' || ({_K} % 5 + 1) || chr(9) || ({_K} + 1) || chr(9) || ({_K} + 20) || chr(9) || case when {_K} % 2 = 0 then '+' else '-' end || chr(9) || 'n' || {_K}"
    return text.read_interval_list(spark, _lines(spark, d, line, ["@HD\tVN:1", "@SQ\tSN:chr1\tLN:9\tUR:u\tM5:m"])).select("referenceName", "start", "end", "strand", "name")


_NINE = f"'chr' || ({_K} % 5 + 1) || chr(9) || 'src' || chr(9) || case when {_K} % 3 = 0 then 'gene' when {_K} % 3 = 1 then 'transcript' else 'exon' end || chr(9) || ({_K} + 1) || chr(9) || ({_K} + 20) || chr(9) || case when {_K} % 2 = 0 then '.' else '' || ({_K} % 50) end || chr(9) || '+' || chr(9) || case when {_K} % 3 = 2 then '1' else '.' end || chr(9) || "
_NINE_SQL = f"""'chr' || ({_K} % 5 + 1) as "referenceName", 'src' as source, case when {_K} % 3 = 0 then 'gene' when {_K} % 3 = 1 then 'transcript' else 'exon' end as "featureType", {_K} as "start", {_K} + 20 as "end", case when {_K} % 2 = 1 then cast({_K} % 50 as double) end as score"""
_NINE_COLUMNS = ["referenceName", "source", "featureType", "start", "end", "score"]


@query(f"""select {_NINE_SQL}, 'f' || {_K} as "featureId", 'a,b' as aliases, case when {_K} % 2 = 0 then 'p1,p' || {_K} end as parents, case when {_K} % 3 = 2 then 1 end as phase, 'v=' || {_K} as k, 'db' as db, 'x:' || {_K} as accession, 'last' as twice from orders""")
def s13_gff3(spark: SparkSession, d: str) -> DataFrame:
    """Reserved keys as columns, the others as attributes, of which the last value holds."""
    f = text.read_gff3(spark, _lines(spark, d, f"{_NINE} 'ID=f' || {_K} || ';Alias=a,b;k=v=' || {_K} || case when {_K} % 2 = 0 then ';Parent=p1,p' || {_K} else '' end || ';Dbxref=db:x:' || {_K} || ',bad;twice=first;none;twice=last'", ["##gff-version 3", ">chr1"]))
    return f.select(*_NINE_COLUMNS, "featureId", F.array_join("aliases", ",").alias("aliases"), F.array_join("parentIds", ",").alias("parents"), "phase", _attribute("k").alias("k"), F.col("dbxrefs")[0]["db"].alias("db"), F.col("dbxrefs")[0]["accession"].alias("accession"), _attribute("twice").alias("twice"))


_GTF = f"""{_NINE} 'gene_id "g' || ({_K} % 9) || '"; transcript_id "t' || {_K} || '"; exon_id "e' || {_K} || '"; note "a;b ' || {_K} || '"; level ' || ({_K} % 4) || ';'"""
_GTF_SQL = f"""{_NINE_SQL}, case when {_K} % 3 = 0 then 'g' || ({_K} % 9) when {_K} % 3 = 1 then 't' || {_K} else 'e' || {_K} end as "featureId", 'g' || ({_K} % 9) as "geneId", 't' || {_K} as "transcriptId", case when {_K} % 3 = 1 then 'g' || ({_K} % 9) when {_K} % 3 = 2 then 't' || {_K} end as parents,
  case when {_K} % 3 = 2 then 1 end as frame, 'a;b ' || {_K} as note, '' || ({_K} % 4) as level"""


def _gtf(f: DataFrame) -> DataFrame:
    return f.select(*_NINE_COLUMNS, "featureId", "geneId", "transcriptId", F.array_join("parentIds", ",").alias("parents"), "frame", _attribute("note").alias("note"), _attribute("level").alias("level"))


@query(f"select {_GTF_SQL} from orders")
def s14_gtf_columns(spark: SparkSession, d: str) -> DataFrame:
    return _gtf(text.read_gtf(spark, _lines(spark, d, _GTF)))


@query(f"""with f as (select {_GTF_SQL} from orders) select "start", 'gene' as kept from f where "geneId" in ('g1', 'g2') union all select "start", 'transcript' from f where "transcriptId" = 't7' union all select "start", 'parent' from f where parents in ('g1', 't8') union all select "start", 'attribute' from f where level = '3' union all select "start", 'type' from f where "featureType" in ('gene', 'exon') union all select "start", 'score' from f where score >= 25""")
def f3_feature_filters(spark: SparkSession, d: str) -> DataFrame:
    f = text.read_gtf(spark, _lines(spark, d, _GTF))
    kept = (("gene", ft.filter_to_gene(f, "g1", "g2")), ("transcript", ft.filter_to_transcript(f, "t7")), ("parent", ft.filter_to_parent(f, "g1", "t8")), ("attribute", ft.filter_by_attribute(f, "level", "3")), ("type", ft.filter_to_feature_type(f, "gene", "exon")), ("score", ft.filter_by_score(f, 25.0)))
    out = [x.select("start", F.lit(k).alias("kept")) for k, x in kept]
    for x in out[1:]:
        out[0] = out[0].unionAll(x)
    return out[0]


def _through_files(spark: SparkSession, f: DataFrame, name: str) -> DataFrame:
    path = scratch(spark, name)
    sinks.save_features(f, path, [("chr1", 9)])
    return load.load_features(spark, path).df


@query(f"select {_GTF_SQL} from orders")
def k6_gtf_files(spark: SparkSession, d: str) -> DataFrame:
    """Features to GTF files and back, found by their extension."""
    return _gtf(_through_files(spark, text.read_gtf(spark, _lines(spark, d, _GTF)), "a.gtf"))


@query(f"""select {_NINE_SQL}, 'f' || {_K} as "featureId", case when {_K} % 2 = 0 then 'p1,p' || {_K} end as parents, case when {_K} % 3 = 2 then 1 end as phase, 'v' || {_K} as k from orders""")
def k6_gff3_files(spark: SparkSession, d: str) -> DataFrame:
    f = text.read_gff3(spark, _lines(spark, d, f"{_NINE} 'ID=f' || {_K} || ';k=v' || {_K} || case when {_K} % 2 = 0 then ';Parent=p1,p' || {_K} else '' end"))
    return _through_files(spark, f, "a.gff3").select(*_NINE_COLUMNS, "featureId", F.array_join("parentIds", ",").alias("parents"), "phase", _attribute("k").alias("k"))


@query(f"select {_BED_SQL} from orders where {_K} % 7 <> 0")
def k6_bed_files(spark: SparkSession, d: str) -> DataFrame:
    f = text.read_bed(spark, _lines(spark, d, _BED, named=True))
    return _through_files(spark, f, "a.bed").select(*_BED_COLUMNS)


@query(f"select {_BED_SQL}, '1.5' as \"signalValue\", '2' as \"pValue\" from orders where {_K} % 7 <> 0")
def k6_narrow_peak_files(spark: SparkSession, d: str) -> DataFrame:
    f = text.read_narrow_peak(spark, _lines(spark, d, f"{_BED} || chr(9) || '1.5' || chr(9) || '2' || chr(9) || '3' || chr(9) || '4'", named=True))
    return _through_files(spark, f, "a.narrowPeak").select(*_BED_COLUMNS, _attribute("signalValue").alias("signalValue"), _attribute("pValue").alias("pValue"))


@query(f"""select 'chr' || ({_K} % 5 + 1) as "referenceName", {_K} * 37 % 432000 as "start", {_K} * 37 % 432000 + 30 as "end", 'n' || {_K} as name, case when {_K} % 4 = 1 then 'REVERSE' else 'FORWARD' end as strand from orders where {_K} % 7 <> 0""")
def k6_interval_list_files(spark: SparkSession, d: str) -> DataFrame:
    f = text.read_bed(spark, _lines(spark, d, _BED, named=True))
    return _through_files(spark, f, "a.interval_list").select("referenceName", "start", "end", "name", "strand")


@query(f"with {_COV} select ref as \"referenceName\", s as \"start\", e as \"end\", c as \"count\" from cov where ref is not null")
def s18_coverage_files(spark: SparkSession, d: str) -> DataFrame:
    """Coverage to BED files, as features that score by their count, and back."""
    path = scratch(spark, "a.bed")
    f = cov.to_features(coverages(spark, d).where("referenceName is not null")).withColumns({"name": F.lit("x"), "strand": F.lit(None).cast("string")})
    sinks.save_features(f, path)
    return load.load_coverage(spark, path).df.select("referenceName", "start", "end", "count")


# Parquet


@query(f"with {_READS} select id, ref as \"referenceName\", s as \"start\" from reads where mapped and (ref = 'chr7' and s < 60000000 and e > 20000000 or ref = 'chr9' and e > 100000000)")
def s4_partitioned_layout(spark: SparkSession, d: str) -> DataFrame:
    """Reads written by reference and bin, and read by regions from the bins they reach."""
    path = scratch(spark, "partitioned")
    GenomicFrame(reads(spark, d).where("readMapped and referenceName is not null")).save_as_partitioned_parquet(path, bin_size=5_000_000)
    return load.load_alignments(spark, path, regions="chr7:20000000-60000000,chr9:100000000+").df.select("id", "referenceName", "start")


@query(f"with {_READS} select id, read_name as \"readName\", ref as \"referenceName\", s as \"start\", 2 as samples from reads where ref = 'chr7' and s < 60000000 and e > 20000000")
def k1_parquet_with_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Rows and metadata written, read by a region, wrapped again."""
    path = scratch(spark, "plain")
    GenomicFrame(reads(spark, d), Meta(samples=("a", "b"))).save_as_parquet(path)
    f = load.load_alignments(spark, path, regions="chr7:20000000-60000000")
    return load.wrap(f.df, metadata_path=path).df.select("id", "readName", "referenceName", "start", F.lit(len(f.meta.samples)).alias("samples"))


@query("select alignment_id, read_name, start_pos from alignments")
def s3_loaded_table(spark: SparkSession, d: str) -> DataFrame:
    """A table that has no metadata beside it."""
    return load.load_alignments(spark, f"{d}/alignments.parquet").select("alignment_id", "read_name", "start_pos").df


@query("select n_name as name, cast(n_nationkey + 7 as bigint) as length from nation")
def s22_dictionary(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "a.dict")
    lines = table(spark, d, "nation").select(F.concat(F.lit("@SQ\tSN:"), "n_name", F.lit("\tLN:"), F.col("n_nationkey") + 7, F.lit("\tM5:x")).alias("value"))
    lines.write.text(path)
    return spark.createDataFrame(load.load_dictionary(spark, path), "name string, length long")


# VCF: a line per line item, of which the last third have a <NON_REF> allele. Two samples.

_N = "(l_orderkey * 10 + l_linenumber)"
_VCF = f"""'chr' || (l_partkey % 3 + 1) || chr(9) || ({_N} + 1) || chr(9) || case when l_linenumber = 1 then '.' else 'rs' || {_N} || ';x' end || chr(9) || 'A' || chr(9) || case l_linenumber % 3 when 0 then 'C' when 1 then 'C,GT' else 'T,<NON_REF>' end || chr(9) || (l_partkey % 90) || chr(9) || case l_returnflag when 'R' then 'PASS' when 'A' then 'q10;s50' else '.' end
  || chr(9) || case when l_linenumber % 3 = 1 then 'AC=1,2;AF=0.5,0.25;AD=9,3,4;QA=5,6;QR=7,8,9' else 'AC=1;AF=0.5;AD=9,3;QA=5;QR=7,8' end || case when l_linenumber % 2 = 0 then ';DB' else '' end || ';AA=G;Z=z' || l_linenumber || chr(9) || 'GT:AD:DP:GQ:PL:FT:ZZ' || chr(9) || case l_linenumber % 3 when 0 then '0/1' when 1 then '1|2' else '0/0' end
  || ':5,' || (l_partkey % 7) || case when l_linenumber % 3 = 0 then '' else ',3' end || ':' || (l_partkey % 60) || ':30:' || case when l_linenumber % 3 = 0 then '10,0,20' else '10,0,20,30,40,50' end || ':PASS:w' || l_linenumber || chr(9) || './.:.:.:.:.:low:.'"""
_VCF_HEAD = ["##fileformat=VCFv4.2", '##INFO=<ID=QA,Number=A,Type=Integer,Description="">', '##INFO=<ID=QR,Number=R,Type=Integer,Description="">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2"]
_ALTS = f"""a as (select *, {_N} n, unnest(case l_linenumber % 3 when 0 then ['C'] when 1 then ['C', 'GT'] else ['T'] end) alt, generate_subscripts(case l_linenumber % 3 when 0 then ['C'] when 1 then ['C', 'GT'] else ['T'] end, 1) i from lineitem)"""


def _vcf_lines(spark: SparkSession, d: str, once: bool = False) -> DataFrame:
    """once: only of line items whose number no other one has."""
    items = table(spark, d, "lineitem")
    if once:
        items = items.join(items.groupBy("l_orderkey", "l_linenumber").count().where("count = 1"), ["l_orderkey", "l_linenumber"], "left_semi")
    lines = items.select(F.expr(_VCF).alias("value"))
    return lines.unionAll(spark.createDataFrame([(x,) for x in _VCF_HEAD], "value string"))


@query(
    f"""with {_ALTS} select 'chr' || (l_partkey % 3 + 1) as "referenceName", n as "start", n + 1 as "end", case when l_linenumber > 1 then 'rs' || n || ',x' end as names, alt as "alternateAllele", cast(l_partkey % 90 as double) as quality, l_linenumber % 3 = 1 as split, l_returnflag <> 'N' as applied, case l_returnflag when 'R' then true when 'A' then false end as passed, case when l_returnflag = 'A' then 'q10,s50' else '' end as failed,
  cast(i as int) as allele_count, cast(case when i = 1 then 0.5 else 0.25 end as float) as frequency, cast(case when i = 1 then 3 else 4 end as int) as depth, 9 as reference_depth, l_linenumber % 2 = 0 as db_snp, 'G' as ancestral, case when i = 1 then '5' else '6' end as qa, case when i = 1 then '8' else '9' end as qr, 'z' || l_linenumber as z from a"""
)
def v8_variants_of_vcf(spark: SparkSession, d: str) -> DataFrame:
    """Sites split by allele, with INFO columns and attributes, counts per allele taken apart by the header."""
    v = text.read_variants(spark, _vcf_lines(spark, d))
    at = lambda k: F.try_element_at("annotation.attributes", F.lit(k))
    return v.select(
        "referenceName", "start", "end", F.array_join("names", ",").alias("names"), "alternateAllele", "quality", F.col("splitFromMultiAllelic").alias("split"), F.col("filtersApplied").alias("applied"), F.col("filtersPassed").alias("passed"), F.array_join("filtersFailed", ",").alias("failed"), F.col("annotation.alleleCount").alias("allele_count"), F.col("annotation.alleleFrequency").alias("frequency"),
        F.col("annotation.readDepth").alias("depth"), F.col("annotation.referenceReadDepth").alias("reference_depth"), F.col("annotation.dbSnp").alias("db_snp"), F.col("annotation.ancestralAllele").alias("ancestral"), at("QA").alias("qa"), at("QR").alias("qr"), at("Z").alias("z"),
    )


_GENOTYPES = f"""with {_ALTS}, g as (select *, unnest(['s1', 's2']) sample from a)
select n as "start", alt as "alternateAllele", sample as "sampleId", case when sample = 's2' then 'NO_CALL,NO_CALL' when l_linenumber % 3 = 0 then 'REF,ALT' when l_linenumber % 3 = 2 then 'REF,REF' when i = 1 then 'ALT,OTHER_ALT' else 'OTHER_ALT,ALT' end as alleles, case when sample = 's1' then cast(l_partkey % 60 as int) end as "readDepth", case when sample = 's1' then 30 end as "genotypeQuality",
  case when sample = 's1' then 5 end as "referenceReadDepth", case when sample = 's1' then cast(case when i = 1 then l_partkey % 7 else 3 end as int) end as "alternateReadDepth", sample = 's1' and l_linenumber % 3 = 1 as phased, case when sample = 's2' then null when i = 1 then '10,0,20' else '10,30,50' end as likelihoods, case when sample = 's1' and l_linenumber % 3 = 2 then '10,30,50' end as non_reference"""


@query(f"{_GENOTYPES}, sample = 's1' as passed, case when sample = 's1' then 'w' || l_linenumber end as zz from g")
def v10_genotypes_of_vcf(spark: SparkSession, d: str) -> DataFrame:
    """Calls of two samples, numbers of a site with several alleles taken apart, likelihoods against <NON_REF>."""
    return _calls(text.read_genotypes(spark, _vcf_lines(spark, d))).withColumns({"passed": F.col("_a.filtersPassed"), "zz": F.try_element_at("_a.attributes", F.lit("ZZ"))}).drop("_a")


def _calls(g: DataFrame) -> DataFrame:
    phred = lambda c: F.array_join(F.transform(c, lambda x: F.floor(-x / 0.2302585092994046 + 0.5).cast("string")), ",")
    return g.select("start", F.col("variant.alternateAllele").alias("alternateAllele"), "sampleId", F.array_join("alleles", ",").alias("alleles"), "readDepth", "genotypeQuality", "referenceReadDepth", "alternateReadDepth", "phased", phred("genotypeLikelihoods").alias("likelihoods"), phred("nonReferenceLikelihoods").alias("non_reference"), F.col("variantCallingAnnotations").alias("_a"))


@query(f"{_GENOTYPES} from g where l_linenumber % 3 = 0 and n in (select {_N} from lineitem group by 1 having count(*) = 1)")
def k5_vcf_files(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of sites with one allele to VCF files, and genotypes back."""
    path = scratch(spark, "a.vcf")
    c = to_variant_contexts(text.read_genotypes(spark, _vcf_lines(spark, d, once=True)).where("not variant.splitFromMultiAllelic and start % 10 % 3 = 0"))
    sinks.save_vcf(c, path, ["s1", "s2"], single=True)
    return _calls(load.load_genotypes(spark, path).df).drop("_a")


@query(f"with {_READS} select id from reads where mapped and ref is not null")
def a5_sorted_by_position(spark: SparkSession, d: str) -> DataFrame:
    return rd.sort_by_reference_position(reads(spark, d).where("readMapped and referenceName is not null")).select("id")


@query(f"with {_READS}, r as (select ref, max(e) size from reads where mapped and ref is not null group by 1), o as (select ref, coalesce(sum(cast(ceil(size / 1000000.0) as bigint)) over (order by ref rows between unbounded preceding and 1 preceding), 0) base from r) select id, cast(base + s // 1000000 as bigint) as first_bin, cast(base + greatest(s, e - 1) // 1000000 as bigint) as last_bin from reads join o using (ref) where mapped and e > s")
def r18_genome_bins(spark: SparkSession, d: str) -> DataFrame:
    """Bins numbered through all references. The dictionary is made of the references in the reads."""
    r = reads(spark, d).where("readMapped and referenceName is not null")
    refs = r.groupBy(F.col("referenceName").alias("name")).agg(F.max("end").alias("length"))
    return with_genome_bins(r.where("end > start"), refs, 1_000_000).select("id", "first_bin", "last_bin")


@query(f"with {_COV} select ref as \"referenceName\", s as \"start\", e as \"end\", 'seen' as name, c as score from cov where ref is not null")
def g11_pipe(spark: SparkSession, d: str) -> DataFrame:
    """Coverage through an external program that renames what it reads."""
    f = cov.to_features(coverages(spark, d)).withColumns({"name": F.lit(None).cast("string"), "strand": F.lit(None).cast("string")})
    program = ["awk", "-F\t", 'BEGIN {OFS = FS} {$4 = "seen"; print}']
    return pipe(f, program, sinks.bed_lines, lambda x: text.read_bed(spark, x), bin_size=100_000).select("referenceName", "start", "end", "name", "score")


@query(f"with {_READS} select read_name as \"readName\", ref as \"referenceName\", s as \"start\", e as \"end\", cigar, bases as sequence, 60 as \"mappingQuality\" from reads where mapped and ref is not null")
def g12_pipe_sam(spark: SparkSession, d: str) -> DataFrame:
    """Mapped reads as SAM lines, below a header, through a program that sets their quality."""
    program = ["awk", "-F\t", "BEGIN {OFS = FS} /^@/ {print; next} {$5 = 60; print}"]
    out = pipe(_sam_reads(spark, d).where("start is not null"), program, sinks.sam_lines, lambda x: text.read_sam(spark, x), header=["@HD\tVN:1.6"])
    return out.select("readName", "referenceName", "start", "end", "cigar", "sequence", "mappingQuality")


@query(f"select {_GTF_SQL} from orders where {_K} % 3 = 2")
def g13_pipe_gtf(spark: SparkSession, d: str) -> DataFrame:
    """Features as GTF lines through a program that keeps exons."""
    return _gtf(pipe(text.read_gtf(spark, _lines(spark, d, _GTF)), ["grep", "exon\t"], sinks.gtf_lines, lambda x: text.read_gtf(spark, x), bin_size=10_000))


@query(f"""select {_NINE_SQL}, 'f' || {_K} as "featureId" from orders""")
def g13_pipe_gff3(spark: SparkSession, d: str) -> DataFrame:
    f = text.read_gff3(spark, _lines(spark, d, f"{_NINE} 'ID=f' || {_K}"))
    return pipe(f, "cat", sinks.gff3_lines, lambda x: text.read_gff3(spark, x), header=["##gff-version 3"], bin_size=10_000).select(*_NINE_COLUMNS, "featureId")


#: The reference of the queries on tags, by a rule: the base at a place, as an expression of Spark and of SQL.
_BASE = "substr('ACGT', cast(1 + ({p} * {p} + {p} // 7 + length({r})) % 4 as int), 1)"


def _reference(spark: SparkSession, reads_: DataFrame) -> DataFrame:
    """Slices of 64 bases under the reads."""
    blocks = reads_.select(F.col("referenceName").alias("name"), F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor((F.col("end") - 1) / 64))).alias("b")).distinct()
    base = _BASE.replace("//", "div").format(p="p", r="name")
    return blocks.select("name", (F.col("b") * 64).alias("start"), (F.col("b") * 64 + 64).alias("end"), F.expr(f"array_join(transform(sequence(b * 64, b * 64 + 63), p -> {base}), '')").alias("sequence"))


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """Mapped reads with bases, with mismatch tags against the reference of the rule."""
    r = reads(spark, d).where("readMapped and referenceName is not null and length(sequence) > 0 and end > start").withColumn("mismatchingPositions", F.lit(None).cast("string"))
    return compute_mismatching_positions(r, _reference(spark, r), row_id="id")


# One row per operator of a CIGAR with the bases before it, one per base of it, and the tag from a letter per reference base.
_OPS = f"""{_READS}, t as (select * from reads where mapped and ref is not null and length(bases) > 0 and e > s),
o0 as (select id, unnest(regexp_extract_all(cigar, '([0-9]+)[MIDNSHP=X]', 1)) n, unnest(regexp_extract_all(cigar, '[0-9]+([MIDNSHP=X])', 1)) op, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), 1) k from t where cigar <> '*'),
o as (select id, k, cast(n as bigint) n, op, coalesce(sum(case when op in ('M', 'I', 'S', '=', 'X') then cast(n as bigint) end) over w, 0) rd, coalesce(sum(case when op in ('M', 'D', 'N', '=', 'X') then cast(n as bigint) end) over w, 0) rf from o0 window w as (partition by id order by k rows between unbounded preceding and 1 preceding)),
b0 as (select o.*, unnest(range(n)) j from o where op in ('M', 'D')), b as (select b0.id, k, op, rd + j as i, s + rf + j as p, upper(substr(bases, cast(rd + j + 1 as int), 1)) have, ref from b0 join t using (id)),
c as (select *, {_BASE.format(p="p", r="ref")} want from b),
w as (select id, string_agg(case when op = 'D' then lower(want) when have = want then '=' else want end, '' order by p) letters from c group by id),
md as (select id, regexp_extract_all(letters, '=+|[acgt]+|[ACGT]') x from w),
tag as (select id, array_to_string(list_transform(range(1, len(x) + 1), lambda k: case when x[k][1] = '=' then '' || length(x[k]) else case when k = 1 or x[k - 1][1] <> '=' then '0' else '' end || case when x[k] = lower(x[k]) then '^' || upper(x[k]) else x[k] end end), '') || case when x[len(x)][1] <> '=' then '0' else '' end as md from md)"""


@query(f"with {_OPS} select t.id, tag.md as \"mismatchingPositions\" from t left join tag using (id)")
def a17_mismatch_tags(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).select("id", "mismatchingPositions")


@query(f"with {_OPS} select c.id, list_sort(list(cast(p as bigint))) as positions from c where op = 'M' and have <> want group by 1 union all select id, []::bigint[] from t where id not in (select id from c where op = 'M' and have <> want) and cigar <> '*'")
def a22_mismatch_positions(spark: SparkSession, d: str) -> DataFrame:
    """Where reads differ from the reference, from their tags."""
    r = _tagged(spark, d).where("mismatchingPositions is not null")
    return r.select("id", mismatch_positions(F.col("mismatchingPositions"), F.col("start"), F.col("cigar")).alias("positions"))


@query(
    f"""with {_OPS}, one as (select id, min(k) filter (op in ('I', 'D')) k from o group by id having count(*) filter (op in ('I', 'D')) = 1),
v as (select one.id, o.op, o.n, p.n before, o.rd, case when o.op = 'I' then substr(bases, cast(o.rd + 1 as int), cast(o.n as int)) else array_to_string(list_transform(range(o.n), lambda j: {_BASE.format(p="(s + o.rf + j)", r="ref")}), '') end var, substr(bases, cast(o.rd - p.n + 1 as int), cast(p.n as int)) pre
  from one join o on o.id = one.id and o.k = one.k join o p on p.id = one.id and p.k = one.k - 1 and p.op = 'M' join o f on f.id = one.id and f.k = one.k + 1 join t on t.id = one.id),
z as (select *, list_transform(range(before), lambda j: upper(pre[cast(before - j as int)]) = upper(var[cast(n - j % n as int)])) same from v), m as (select *, coalesce(list_position(same, false) - 1, before) shift from z),
put as (select o.id, string_agg(case when o.k = one.k - 1 then case when o.n > m.shift then (o.n - m.shift) || 'M' else '' end when o.k = one.k + 1 then case when o.op = 'M' then (o.n + m.shift) || 'M' else case when m.shift > 0 then m.shift || 'M' else '' end || o.n || o.op end else o.n || o.op end, '' order by o.k) cigar from o join one using (id) join m using (id) group by 1)
select t.id, coalesce(put.cigar, t.cigar) as cigar from t left join put using (id)"""
)
def a18_left_normalized(spark: SparkSession, d: str) -> DataFrame:
    return left_normalize_indels(_tagged(spark, d)).select("id", "cigar")


_OBSERVED = f"""{_OPS}, q0 as (select id, rg, bases, quals, coalesce(neg, false) neg, coalesce(part, 0) = 1 sec, length(bases) len from t where length(bases) = length(quals)),
q as (select id, rg, j, ascii(quals[cast(j + 1 as int)]) - 33 quality, (case when sec then -1 else 1 end) * (case when neg then len - j else j + 1 end) as "cycle", case when neg then coalesce(nullif(translate(bases[cast(j + 2 as int)], 'ACGT', 'TGCA'), ''), 'N') || translate(bases[cast(j + 1 as int)], 'ACGT', 'TGCA') else coalesce(nullif(case when j > 0 then bases[cast(j as int)] end, ''), 'N') || bases[cast(j + 1 as int)] end two from (select *, unnest(range(len)) j from q0)),
k as (select id, rg read_group, j, quality, cast("cycle" as int) "cycle", case when two like '%N%' then 'NN' else two end dinuc from q),
ob as (select read_group, quality, "cycle", dinuc, count(*) total, count(*) filter (have <> want) mismatches from k join c on c.id = k.id and c.i = k.j and c.op = 'M' join t on t.id = k.id where prim and not coalesce(dup, false) and mapq > 0 and have <> 'N' and quality > 0 group by 1, 2, 3, 4)"""


@query(f'with {_OBSERVED} select read_group, quality, "cycle", dinuc, total, mismatches from ob')
def a15_observed(spark: SparkSession, d: str) -> DataFrame:
    """Bases and mismatches per covariate key, from the tagged reads."""
    return observe(_tagged(spark, d))


@query(
    f"""with {_OBSERVED}, rates as (select *, ln((1 + sum(mismatches) over (partition by read_group, quality)) / (2 + sum(total) over (partition by read_group, quality))) q, ln((1 + sum(mismatches) over (partition by read_group, quality, "cycle")) / (2 + sum(total) over (partition by read_group, quality, "cycle"))) y,
  ln((1 + sum(mismatches) over (partition by read_group, quality, dinuc)) / (2 + sum(total) over (partition by read_group, quality, dinuc))) z from ob),
fresh as (select *, cast(floor(-10 * least(0, greatest(ln(1e-5), y + z - q)) / ln(10) + 0.5) as int) better from rates),
done as (select k.id, string_agg(chr(cast(33 + case when k.quality >= 5 then coalesce(better, k.quality) else k.quality end as int)), '' order by j) quals from k left join fresh f on f.read_group is not distinct from k.read_group and f.quality = k.quality and f."cycle" = k."cycle" and f.dinuc = k.dinuc group by 1)
select t.id, coalesce(done.quals, t.quals) as quals, t.quals as old_quals from t left join done using (id)"""
)
def a15_recalibrated(spark: SparkSession, d: str) -> DataFrame:
    """New and old qualities of the tagged reads, from the evidence of all of them."""
    return recalibrate(_tagged(spark, d), row_id="id").select("id", F.col("qualityScores").alias("quals"), F.col("originalQualityScores").alias("old_quals"))


@query()
def a16_realigned(spark: SparkSession, d: str) -> DataFrame:
    return realign_indels(_tagged(spark, d), row_id="id").select("id", "start", "cigar", "originalCigar")
