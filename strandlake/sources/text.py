"""Readers of text formats. Each is a text scan and a projection, split by the file system's blocks (FASTQ by
byte ranges); gzip is read as is. Positions become 0-based, half-open."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.cigar import reference_length
from strandlake.functions.text import pair_number, strip_pair_suffix, tag_value
from strandlake.operators.features import gff3_entries, gtf_entries, last_wins, to_dbxref, to_strand
from strandlake.operators.reads import from_flags
from strandlake.operators.variants import INFO_FLAGS, parse_effects
from strandlake.plans.runtime import join_bounded, spread
from strandlake.schemas import SCHEMAS
from strandlake.sources import ranges

#: A path, paths, or a DataFrame with a text column `value` (lines from elsewhere, such as a program's output).
Paths = str | list[str] | DataFrame

#: A column that lines may carry through a reader: the task they come from (see operators.pipe).
TASK = "_part"


def _columns(df: DataFrame, kind: str) -> DataFrame:
    """df with exactly the columns of a record kind, those it lacks as nulls."""
    want = df.sparkSession.createDataFrame([], SCHEMAS[kind]).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want], *_task(df))


def _task(df: DataFrame) -> list[str]:
    return [TASK] if TASK in df.columns else []


def _text(spark: SparkSession, path: Paths) -> DataFrame:
    return path if isinstance(path, DataFrame) else spark.read.text(path)


def _lines(spark: SparkSession, path: Paths, *skip: str) -> DataFrame:
    lines = _text(spark, path)
    lines = lines.select(F.regexp_replace("value", "\r$", "").alias("value"), *_task(lines)).where(F.trim("value") != "")
    for s in skip:
        lines = lines.where(~F.col("value").startswith(s))
    return lines.withColumn("c", F.split("value", "\t", -1))


def _at(i: int) -> Column:
    """Column i of a line; null if it isn't there or is a dot."""
    return F.nullif(F.get("c", F.lit(i)), F.lit("."))


# Reads.


def sam_header(spark: SparkSession, path: Paths) -> dict[str, list[dict[str, str]]]:
    """Header lines by record type (HD, SQ, RG, PG, CO). Headers of several files are put together."""
    lines = _text(spark, path).select("value").where(F.col("value").rlike("^@(HD|SQ|RG|PG|CO)(\t|$)")).distinct().orderBy("value").toLocalIterator()
    return parse_sam_header(r[0] for r in lines)


def parse_sam_header(lines) -> dict[str, list[dict[str, str]]]:
    out: dict[str, list[dict[str, str]]] = {}
    for line in lines:
        kind, *rest = line.rstrip("\r").split("\t")
        out.setdefault(kind[1:], []).append(dict(x.split(":", 1) for x in rest if ":" in x) if kind != "@CO" else {"text": "\t".join(rest)})
    return out


def read_sam(spark: SparkSession, path: Paths) -> DataFrame:
    """SAM records. Read groups' samples come from the header, one small driver-side map."""
    c = F.col("c")
    lines = _lines(spark, path).where(~F.col("value").rlike("^@(HD|SQ|RG|PG|CO)(\t|$)"))
    flag, none = c[1].try_cast("int"), lambda x: F.nullif(x, F.lit("*"))
    flags = from_flags(flag)
    tags = F.array_join(F.slice(c, 12, F.greatest(F.size(c) - 11, F.lit(1))), "\t")
    tags = F.when(F.size(c) > 11, tags)
    mapped = flags["readMapped"]
    start = F.when(mapped, c[3].try_cast("long") - 1)
    trimmed = lambda p: F.coalesce(F.regexp_extract(c[5], p, 1).try_cast("int"), F.lit(0))
    mate = F.when(c[6] == "=", none(c[2])).otherwise(none(c[6]))
    # Lines that another program writes are read once, so they have no header to look into first.
    header = {} if isinstance(path, DataFrame) else sam_header(spark, path)
    samples = {g["ID"]: g["SM"] for g in header.get("RG", []) if "ID" in g and "SM" in g}
    group = tag_value(tags, "RG")
    sample = F.create_map(*[F.lit(x) for kv in samples.items() for x in kv])[group] if samples else F.lit(None).cast("string")
    kept = F.filter(F.split(tags, "\t"), lambda t: ~t.rlike("^(RG|MD|OQ|OP|OC):"))
    out = lines.select(
        none(c[0]).alias("readName"), none(c[9]).alias("sequence"), none(c[10]).alias("qualityScores"), tag_value(tags, "OQ").alias("originalQualityScores"), F.when(mapped, none(c[2])).alias("referenceName"), start.alias("start"),
        (start + reference_length(c[5])).alias("end"), (tag_value(tags, "OP").try_cast("long") - 1).alias("originalStart"), none(c[5]).alias("cigar"), tag_value(tags, "OC").alias("originalCigar"), trimmed("^([0-9]+)H").alias("basesTrimmedFromStart"), trimmed("([0-9]+)H$").alias("basesTrimmedFromEnd"), F.when(mapped & (c[4] != "255"), c[4].try_cast("int")).alias("mappingQuality"),
        F.nullif(c[8].try_cast("long"), F.lit(0)).alias("insertSize"), mate.alias("mateReferenceName"), F.when(mate.isNotNull() & (c[7] != "0"), c[7].try_cast("long") - 1).alias("mateAlignmentStart"), tag_value(tags, "MD").alias("mismatchingPositions"),
        F.array_join(kept, "\t").alias("attributes"), group.alias("readGroupId"), sample.alias("readGroupSampleId"), *[x.alias(n) for n, x in flags.items()], *_task(lines),
    )
    return _columns(out, "alignment")


def _fastq_records(spark: SparkSession, path: str | list[str], numbered: bool = False, size: int = ranges.RANGE) -> DataFrame:
    """(head, sequence, qualityScores[, number]) of four-line records. A file is read in ranges, each by a task of its
    own, gzip as a whole. number counts through a file; for it the records of each range are counted first."""
    parts = ranges.byte_ranges(ranges.list_files(spark, path), size)
    read = lambda r: ranges.fastq_records(r.path, r.first, r.last, r.last - r.first == r.length)
    if not numbered:
        return ranges.map_ranges(parts, read, "head string, sequence string, qualityScores string")
    n = ranges.map_ranges(parts, lambda r: [(r.path, r.first, sum(1 for _ in read(r)))], "path string, first long, n long")
    # One row a range and file: a window over a file holds as many rows as it has ranges.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.join(n.withColumn("before", before).drop("n"), ["path", "first"])
    return ranges.map_ranges(placed.repartition(max(1, parts.rdd.getNumPartitions()), "path", "first"), lambda r: ((*t, r.before + i) for i, t in enumerate(read(r))), "head string, sequence string, qualityScores string, number long")


def _fastq(records: DataFrame, part: Column, paired: bool) -> DataFrame:
    name = F.regexp_extract("head", r"^(\S*)", 1)
    qual = F.when((F.col("qualityScores") == "*") | ((F.length("qualityScores") == 1) & (F.length("sequence") > 1)), F.repeat(F.lit("B"), F.length("sequence"))).otherwise(F.col("qualityScores"))
    no = F.lit(False)
    return _columns(records.select(strip_pair_suffix(name).alias("readName"), "sequence", qual.alias("qualityScores"), part.alias("readInFragment"), F.lit(paired).alias("readPaired"), no.alias("readMapped"), no.alias("mateMapped"), no.alias("primaryAlignment"), no.alias("properPair")), "alignment")


def read_fastq(spark: SparkSession, path: Paths, part: int | None = None) -> DataFrame:
    """Unpaired reads; part sets readInFragment, else it comes from the name's suffix, else 0."""
    return _fastq(_fastq_records(spark, path), F.lit(part) if part is not None else F.coalesce(pair_number(F.regexp_extract("head", r"^(\S*)", 1)), F.lit(0)), False)


def read_paired_fastq(spark: SparkSession, first: Paths, second: Paths) -> DataFrame:
    a, b = (_fastq(_fastq_records(spark, p), F.lit(i), True) for i, p in enumerate((first, second)))
    return a.unionByName(b)


def read_interleaved_fastq(spark: SparkSession, path: Paths) -> DataFrame:
    """First and second reads in turn."""
    r = _fastq_records(spark, path, numbered=True)
    return _fastq(r, (F.col("number") % 2).cast("int"), True)


# Sequences.


def read_fasta(spark: SparkSession, path: Paths, alphabet: str = "DNA") -> DataFrame:
    """One sequence per record, split where a line starts with '>' so that a record is a row."""
    raw = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    # Only the first record of a file still has its '>'.
    raw = raw.select(F.regexp_replace("value", "^>", "").alias("value"))
    head, body = F.regexp_extract("value", r"^([^\n]*)", 1), F.regexp_replace("value", r"^[^\n]*\n?", "")
    raw = raw.select(F.trim(F.regexp_replace(head, "\r", "")).alias("head"), F.regexp_replace(body, r"\s", "").alias("sequence"))
    name, desc = F.regexp_extract("head", r"^(\S*)", 1), F.regexp_replace("head", r"^\S*\s*", "")
    return _columns(raw.select(name.alias("name"), F.nullif(desc, F.lit("")).alias("description"), F.lit(alphabet).alias("alphabet"), "sequence", F.length("sequence").cast("long").alias("length")), "sequence")


# Features.


def read_bed(spark: SparkSession, path: Paths) -> DataFrame:
    """3 to 12 columns; those after the strand become attributes."""
    extra = ("thickStart", "thickEnd", "itemRgb", "blockCount", "blockSizes", "blockStarts")
    return _bed(spark, path, extra)


def read_narrow_peak(spark: SparkSession, path: Paths) -> DataFrame:
    return _bed(spark, path, ("signalValue", "pValue", "qValue", "peak"))


def _bed(spark: SparkSession, path: Paths, extra: tuple[str, ...]) -> DataFrame:
    lines = _lines(spark, path, "#", "track", "browser").where(F.size("c") >= 3)
    more = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), _at(6 + i).alias("value")) for i, k in enumerate(extra)]), lambda x: x["value"].isNotNull())
    return _columns(lines.select(_at(0).alias("referenceName"), _at(1).try_cast("long").alias("start"), _at(2).try_cast("long").alias("end"), _at(3).alias("name"), _at(4).try_cast("double").alias("score"), to_strand(F.get("c", F.lit(5))).alias("strand"), F.map_from_entries(more).alias("attributes"), *_task(lines)), "feature")


def _nine(spark: SparkSession, path: Paths, entries, wanted: dict[str, str]) -> DataFrame:
    """GTF or GFF3: nine columns, of which the last holds attributes; `wanted` ones become columns."""
    lines = _lines(spark, path, "#", ">").where(F.size("c").isin(8, 9)).withColumn("e", F.coalesce(entries(F.get("c", F.lit(8))), F.array().cast("array<struct<key:string,value:string>>")))
    of = lambda k: F.try_element_at(F.filter("e", lambda x: x["key"] == k), F.lit(-1))["value"]
    rest = F.filter("e", lambda x: ~x["key"].isin(*wanted.values()))
    out = lines.select(
        _at(0).alias("referenceName"), _at(1).alias("source"), _at(2).alias("featureType"), (_at(3).try_cast("long") - 1).alias("start"), _at(4).try_cast("long").alias("end"), _at(5).try_cast("double").alias("score"), to_strand(F.get("c", F.lit(6))).alias("strand"), _at(7).try_cast("int").alias("frame"),
        *[of(k).alias(c) for c, k in wanted.items()], last_wins(rest).alias("attributes"), *_task(lines),
    )
    return out


def read_gtf(spark: SparkSession, path: Paths) -> DataFrame:
    out = _nine(spark, path, gtf_entries, {"geneId": "gene_id", "transcriptId": "transcript_id", "exonId": "exon_id", "proteinId": "protein_id"})
    key = {"gene": "geneId", "transcript": "transcriptId", "exon": "exonId"}
    ident = F.coalesce(*[F.when(F.col("featureType") == t, F.col(c)) for t, c in key.items()])
    parent = F.when(F.col("featureType") == "transcript", F.col("geneId")).when(F.col("featureType") != "gene", F.col("transcriptId"))
    return _columns(out.withColumn("featureId", ident).withColumn("parentIds", F.when(parent.isNotNull(), F.array(parent))), "feature")


def read_gff3(spark: SparkSession, path: Paths) -> DataFrame:
    wanted = {"featureId": "ID", "name": "Name", "_alias": "Alias", "_parent": "Parent", "target": "Target", "gap": "Gap", "derivesFrom": "Derives_from", "_note": "Note", "_dbxref": "Dbxref", "_term": "Ontology_term", "_circular": "Is_circular", "geneId": "gene_id", "transcriptId": "transcript_id", "exonId": "exon_id", "proteinId": "protein_id"}
    out = _nine(spark, path, gff3_entries, wanted)
    many = lambda c: F.split(c, ",")
    pairs = lambda c: F.filter(F.transform(many(c), to_dbxref), lambda x: x.isNotNull())
    out = out.withColumns({"aliases": many("_alias"), "parentIds": many("_parent"), "notes": many("_note"), "dbxrefs": pairs("_dbxref"), "ontologyTerms": pairs("_term"), "circular": F.col("_circular").try_cast("boolean")})
    return _columns(out.withColumn("phase", F.col("frame")).drop("frame"), "feature")


def read_interval_list(spark: SparkSession, path: Paths) -> DataFrame:
    lines = _lines(spark, path, "@").where(F.size("c") >= 4)
    return _columns(lines.select(_at(0).alias("referenceName"), (_at(1).try_cast("long") - 1).alias("start"), _at(2).try_cast("long").alias("end"), to_strand(F.get("c", F.lit(3))).alias("strand"), _at(4).alias("name"), *_task(lines)), "feature")


# Variants.

#: INFO and FORMAT keys that are columns.
INFO_KNOWN = ("AA", "AC", "AF", "CIGAR", "AD", "ADF", "ADR", "ANN", "DP", *INFO_FLAGS.values())
FORMAT_KNOWN = ("GT", "AD", "DP", "MIN_DP", "GQ", "PL", "SB", "PS", "PQ", "FT", "FS", "MQ", "MQ0")


def _vcf_text(spark: SparkSession, path: Paths) -> DataFrame:
    """Lines with `_file`, the file they stand in (null for lines from elsewhere)."""
    return path.withColumn("_file", F.lit(None).cast("string")) if isinstance(path, DataFrame) else spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))


def vcf_header(spark: SparkSession, path: Paths) -> tuple[list[str], list[str]]:
    """(## lines, sample names) of VCF files; samples in the order of the columns, file by file."""
    t = _vcf_text(spark, path).where(F.col("value").startswith("#"))
    lines = [r[0] for r in t.where(F.col("value").startswith("##")).select("value").distinct().orderBy("value").toLocalIterator()]
    samples: dict[str, None] = {}
    for r in t.where(F.col("value").startswith("#CHROM")).groupBy("value").agg(F.min("_file").alias("f")).orderBy("f", "value").toLocalIterator():
        samples.update(dict.fromkeys(r["value"].rstrip("\r").split("\t")[9:]))
    return lines, list(samples)


def _numbers(lines: list[str]) -> dict[str, str]:
    """INFO keys with one value per alternate allele (A) or per allele (R), from the header lines."""
    found = (re.match(r"##INFO=<ID=([^,>]+),Number=([AR]),", x) for x in lines)
    return {m[1]: m[2] for m in found if m}


def _sites(spark: SparkSession, path: Paths, info: list[str] | None = None, dealt: bool = False) -> DataFrame:
    """One row per site and ALT allele, multi-allelic sites split; `alt` is the allele's number from 1, `non_ref`
    that of the <NON_REF> allele of a reference model, which gives no row beside others. info: INFO keys to read, None for all.
    dealt: lines of few splits are dealt out over the cores first."""
    t = _vcf_text(spark, path)
    lines = t.select(F.regexp_replace("value", "\r$", "").alias("value"), "_file", *_task(t)).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    lines = (spread(lines, at_least=4) if dealt else lines).withColumn("c", F.split("value", "\t", -1)).where(F.size("c") >= 8)
    every = F.split(F.col("c")[4], ",")
    alts = F.filter(every, lambda a: a != "<NON_REF>")
    alts = F.when(F.size(alts) == 0, F.array(F.lit(None).cast("string"))).otherwise(alts)
    kept = F.filter(F.split(F.col("c")[7], ";"), lambda x: (x != ".") & (x != ""))
    kv = F.transform(kept, lambda x: F.struct(F.regexp_extract(x, "^([^=]*)", 1).alias("key"), F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise("true").alias("value")))
    if info is not None:
        kv = F.filter(kv, lambda x: x["key"].isin(*info))
    out = lines.withColumn("info", last_wins(kv)).withColumns({"n_alt": F.size(alts), "n_all": F.size(every), "non_ref": F.nullif(F.array_position(every, "<NON_REF>"), F.lit(0))})
    return out.select("*", F.posexplode(alts).alias("i", "allele")).withColumn("alt", F.col("i") + 1)


def _variant(numbers: dict[str, str]) -> Column:
    return F.struct(*[x.alias(n) for n, x in _variant_fields(numbers).items()])


def _variant_fields(numbers: dict[str, str]) -> dict[str, Column]:
    c, info = F.col("c"), lambda k: F.try_element_at("info", F.lit(k))
    start = c[1].try_cast("long") - 1
    end = F.coalesce(info("END").try_cast("long"), start + F.length(c[3]))
    # Per-allele lists: A has one value per ALT, R one for the reference first.
    per_alt = lambda k: F.get(F.split(info(k), ","), F.col("i"))
    ref_of, alt_of = (lambda k: F.get(F.split(info(k), ","), F.lit(0)).try_cast("int")), (lambda k: F.get(F.split(info(k), ","), F.col("alt")).try_cast("int"))
    rest = F.map_filter("info", lambda k, v: ~k.isin(*[x for x in INFO_KNOWN if x != "DP"]))

    def of_allele(number: str, at: Column):
        keys = [k for k, n in numbers.items() if n == number]
        return lambda k, v: F.when(k.isin(*keys), F.coalesce(F.get(F.split(v, ","), at), v)).otherwise(v)

    rest = F.transform_values(F.transform_values(rest, of_allele("A", F.col("i"))), of_allele("R", F.col("alt"))) if numbers else rest
    passed = F.when(c[6] == ".", None).otherwise(c[6] == "PASS")
    annotation = F.struct(
        info("AA").alias("ancestralAllele"), *[(F.coalesce(info(k), F.lit("")) == "true").alias(n) for n, k in INFO_FLAGS.items()], per_alt("AC").try_cast("int").alias("alleleCount"), per_alt("AF").try_cast("float").alias("alleleFrequency"), per_alt("CIGAR").alias("cigar"),
        alt_of("AD").alias("readDepth"), ref_of("AD").alias("referenceReadDepth"), alt_of("ADF").alias("forwardReadDepth"), ref_of("ADF").alias("referenceForwardReadDepth"), alt_of("ADR").alias("reverseReadDepth"), ref_of("ADR").alias("referenceReverseReadDepth"),
        F.filter(parse_effects(info("ANN")), lambda e: e["alternateAllele"].eqNullSafe(F.col("allele"))).alias("transcriptEffects"), rest.alias("attributes"),
    )
    return {
        "referenceName": c[0], "start": start, "end": end, "names": F.when(c[2] != ".", F.split(c[2], ";")), "referenceAllele": c[3], "alternateAllele": F.nullif(F.col("allele"), F.lit(".")), "quality": F.when(c[5] != ".", c[5].try_cast("double")), "splitFromMultiAllelic": F.col("n_alt") > 1,
        "filtersApplied": c[6] != ".", "filtersPassed": passed, "filtersFailed": F.when((c[6] != ".") & (c[6] != "PASS"), F.split(c[6], ";")).otherwise(F.array().cast("array<string>")), "annotation": annotation,
    }


def read_variants(spark: SparkSession, path: Paths, info: list[str] | None = None) -> DataFrame:
    """info: the INFO keys to read; the others are left out."""
    s = _sites(spark, path, info)
    # Lines that another program writes are read once, so they have no header to look into first.
    numbers = {} if TASK in s.columns else _numbers(vcf_header(spark, path)[0])
    return _columns(s.select(_variant(numbers).alias("v"), *_task(s)).select("v.*", *_task(s)), "variant")


def read_genotypes(spark: SparkSession, path: Paths, info: list[str] | None = None, formats: list[str] | None = None) -> DataFrame:
    """One row per variant and sample, the samples named by the header of the file that a line stands in. PL become
    log success probabilities: genotypeLikelihoods of the reference and this allele, nonReferenceLikelihoods of the
    reference and <NON_REF>. Keys without a column are attributes. info, formats: the keys to read, None for all."""
    heads = _vcf_text(spark, path).where(F.col("value").startswith("#CHROM")).select("_file", F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("_h"))
    heads = heads.select("_file", F.slice("_h", 10, F.greatest(F.size("_h") - 9, F.lit(1))).alias("_samples")).distinct()
    if isinstance(path, DataFrame) and heads.limit(2).count() > 1:
        raise ValueError("lines under headers with other samples; give the files")
    s = _sites(spark, path, info, dealt=True).where(F.size("c") > 9)
    # A column per field, as Spark carries a struct whole through the steps below, with fields that nobody reads.
    fields = _variant_fields(_numbers(vcf_header(spark, path)[0]))
    s = s.select(F.coalesce("_file", F.lit("")).alias("_file"), "value", "c", "alt", "n_all", "non_ref", "i", *[x.alias(f"_v_{n}") for n, x in fields.items()])
    # One row of names per file.
    s = join_bounded(s, heads.withColumn("_file", F.coalesce("_file", F.lit(""))), ["_file"], "left", max_rows=50_000, salt_of="value")
    s = s.select(*[f"_v_{x}" for x in fields], "c", "alt", "n_all", "non_ref", "i", "_samples", F.posexplode(F.slice("c", 10, F.size("c") - 9)).alias("at", "call"))
    sample = F.get("_samples", F.col("at"))
    kv = F.arrays_zip(F.split(F.col("c")[8], ":").alias("key"), F.split("call", ":").alias("value"))
    wanted = lambda x: F.lit(True) if formats is None else x["key"].isin(*formats)
    f = s.withColumn("f", last_wins(F.filter(F.transform(kv, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))), lambda x: x["value"].isNotNull() & (x["value"] != ".") & wanted(x))))
    of = lambda k: F.try_element_at("f", F.lit(k))
    ints = lambda k: F.transform(F.split(of(k), ","), lambda x: x.try_cast("int"))
    allele = lambda a: F.when(a == ".", "NO_CALL").when(a == "0", "REF").when(a == F.col("alt").cast("string"), "ALT").otherwise("OTHER_ALT")
    pl = ints("PL")
    # Genotype j/k of a site has place k * (k + 1) / 2 + j: here the ones of reference and this allele.
    with_reference = lambda a: F.array(*[F.get(pl, F.floor(x).cast("int")) for x in (F.lit(0), a * (a + 1) / 2, a * (a + 1) / 2 + a)])
    mine = F.when(F.col("n_all") == 1, pl).otherwise(with_reference(F.col("alt")))
    logs = lambda p: F.transform(p, lambda x: -x.cast("double") * F.lit(0.2302585092994046))
    ft = of("FT")
    out = f.select(
        F.struct(*[F.col(f"_v_{x}").alias(x) for x in fields]).alias("variant"), F.col("_v_referenceName").alias("referenceName"), F.col("_v_start").alias("start"), F.col("_v_end").alias("end"), sample.alias("sampleId"), F.transform(F.split(F.coalesce(of("GT"), F.lit("./.")), "[/|]"), allele).alias("alleles"),
        F.get(ints("AD"), F.lit(0)).alias("referenceReadDepth"), F.get(ints("AD"), F.col("alt")).alias("alternateReadDepth"), of("DP").try_cast("int").alias("readDepth"), of("MIN_DP").try_cast("int").alias("minReadDepth"), of("GQ").try_cast("int").alias("genotypeQuality"),
        F.when(of("PL").isNotNull(), logs(mine)).alias("genotypeLikelihoods"), F.when(of("PL").isNotNull() & F.col("non_ref").isNotNull(), logs(with_reference(F.col("non_ref")))).alias("nonReferenceLikelihoods"), ints("SB").alias("strandBiasComponents"), F.coalesce(of("GT"), F.lit("")).contains("|").alias("phased"), of("PS").try_cast("int").alias("phaseSetId"), of("PQ").try_cast("int").alias("phaseQuality"),
        F.struct(ft.isNotNull().alias("filtersApplied"), (ft == "PASS").alias("filtersPassed"), F.when(ft.isNotNull() & (ft != "PASS"), F.split(ft, ";")).otherwise(F.array().cast("array<string>")).alias("filtersFailed"), of("FS").try_cast("float").alias("fisherStrandBiasPValue"), of("MQ").try_cast("float").alias("rmsMapQ"), of("MQ0").try_cast("int").alias("mapq0Reads"), F.map_filter("f", lambda k, v: ~k.isin(*FORMAT_KNOWN)).alias("attributes")).alias("variantCallingAnnotations"),
    )
    return out


# Dictionaries.


def read_dictionary(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, length) in file order from .dict (@SQ lines), or tables of name and length; a driver-side read of a small file."""
    out, tables = [], []
    for r in spark.read.text(path, wholetext=True).toLocalIterator():
        for line in r[0].splitlines():
            c = line.split("\t")
            if c[0] == "@SQ":
                tags = dict(x.split(":", 1) for x in c[1:])
                out.append((tags["SN"], int(tags["LN"])))
            elif not line.startswith(("@", "#")) and len(c) >= 2 and c[1].strip().isdigit():
                tables.append((c[0].strip(), int(c[1])))
    return out or tables


def audit_header(lines: list[str], supported: list[str], stringency: str = "strict") -> list[str]:
    """Header lines with those of the supported INFO and FORMAT fields put in. A line that says otherwise of a
    supported field (Number or Type) is an error (strict), or replaced (lenient, silent)."""
    import warnings

    ident = lambda x: re.match(r"##(INFO|FORMAT|FILTER)=<ID=([^,>]+)", x)
    says = lambda x: tuple(m.group(1) if (m := re.search(rf"[,<]{k}=([^,>]+)", x)) else None for k in ("Number", "Type"))
    known = {ident(x).groups(): x for x in supported if ident(x)}
    out = []
    for x in lines:
        want = known.get(ident(x).groups()) if ident(x) else None
        if want is None:
            out.append(x)
        elif says(x) != says(want):
            if stringency == "strict":
                raise ValueError(f"header line {x} disagrees with {want}")
            if stringency == "lenient":
                warnings.warn(f"header line {x} replaced by {want}", stacklevel=2)
    return list(dict.fromkeys([*out, *known.values()]))
