"""Writers of text formats: a projection to lines and a text sink, so Spark writes the parts.

single=True gives one part file; at scale leave it off and keep the parts. A header, where a format
has one, is written as the first line of every part by its own first row only when single, else as
a file of its own beside the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.features import gather_attributes, interpolate_score, name_of, strand_text
from strandlake.operators.reads import flags
from strandlake.operators.variants import INFO_FLAGS, format_effects
from strandlake.schemas import SCHEMAS


def _write(lines: DataFrame, path: str, single: bool, header: list[str] | None, mode: str, compression: str | None) -> None:
    lines = lines.select(F.col(lines.columns[0]).alias("value"))
    spark = lines.sparkSession
    if single:
        # Rows keep the order they come in: the header is put before the first row of the only partition.
        one = lines.coalesce(1)
        if header:
            head = "\n".join(header)

            def with_header(batches):
                import pandas as pd

                first = True
                for b in batches:
                    if first:
                        b = pd.concat([pd.DataFrame({"value": [head]}), b])
                        first = False
                    yield b
                if first:
                    yield pd.DataFrame({"value": [head]})

            one = one.mapInPandas(with_header, "value string")
        lines = one
    w = lines.write.mode(mode)
    (w.option("compression", compression) if compression else w).text(path)
    if header and not single:
        spark.createDataFrame([("\n".join(header),)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + "_header")


def _dot(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("."))


def _score(c: str = "score") -> Column:
    """A number without a needless fraction."""
    s = F.col(c)
    return F.when(s.isNull(), ".").when(s == F.floor(s), F.floor(s).cast("string")).otherwise(s.cast("string"))


# Lines of records as one text column `value`, beside the columns in `keep`.


def sam_lines(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    # Fields that the records lack are written as unset.
    want = df.sparkSession.createDataFrame([], SCHEMAS["alignment"]).schema
    df = df.select(*keep, *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])
    star = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("*"))
    same = F.when(F.col("mateReferenceName").isNull(), "*").when(F.col("mateReferenceName") == F.col("referenceName"), "=").otherwise(F.col("mateReferenceName"))
    tag = lambda t, c, kind="Z", plus=0: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{t}:{kind}:"), (F.col(c) + plus if plus else F.col(c)).cast("string")))
    tags = F.array_compact(F.array(tag("MD", "mismatchingPositions"), tag("RG", "readGroupId"), tag("OQ", "originalQualityScores"), tag("OP", "originalStart", "i", 1), tag("OC", "originalCigar"), F.nullif(F.col("attributes"), F.lit(""))))
    n = lambda c, plus, none: F.coalesce((F.col(c) + plus).cast("string"), F.lit(none))
    core = F.concat_ws("\t", star("readName"), F.col("_flags").cast("string"), star("referenceName"), n("start", 1, "0"), F.when(~F.coalesce("readMapped", F.lit(False)), "0").otherwise(n("mappingQuality", 0, "255")), star("cigar"), same, n("mateAlignmentStart", 1, "0"), n("insertSize", 0, "0"), star("sequence"), star("qualityScores"))
    return flags(df, "_flags").select(*keep, F.when(F.size(tags) > 0, F.concat(core, F.lit("\t"), F.array_join(tags, "\t"))).otherwise(core).alias("value"))


def sam_header_lines(references: list[tuple[str, int]], read_groups: list[dict], sort_order: str) -> list[str]:
    return [f"@HD\tVN:1.6\tSO:{sort_order}", *(f"@SQ\tSN:{n}\tLN:{k}" for n, k in references), *("@RG\t" + "\t".join(f"{k}:{v}" for k, v in g.items()) for g in read_groups)]


def save_sam(df: DataFrame, path: str, references: list[tuple[str, int]] = (), read_groups: list[dict] = (), sort_order: str = "unsorted", single: bool = False, mode: str = "overwrite", compression: str | None = None) -> None:
    _write(sam_lines(df), path, single, sam_header_lines(references, read_groups, sort_order), mode, compression)


def fastq_lines(df: DataFrame, name: str = "readName", original: bool = False, suffix: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per record of four lines. original: the original qualities where there are any."""
    qual = F.coalesce("originalQualityScores", "qualityScores") if original else F.col("qualityScores")
    end = F.when(F.col("readPaired"), F.concat(F.lit("/"), F.col("readInFragment") + 1)).otherwise("") if suffix and "readPaired" in df.columns else F.lit("")
    return df.where("sequence is not null").select(*keep, F.concat(F.lit("@"), name, end, F.lit("\n"), "sequence", F.lit("\n+\n"), F.coalesce(qual, F.repeat(F.lit("B"), F.length("sequence")))).alias("value"))


def interleaved_fastq_lines(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fragments with two reads as one row of eight lines, first read before second."""
    record = lambda r, n: F.concat(F.lit("@"), r["readName"], F.lit(f"/{n}\n"), r["sequence"], F.lit("\n+\n"), F.coalesce(r["qualityScores"], F.repeat(F.lit("B"), F.length(r["sequence"]))))
    a, b = _mates()
    return df.where(a.isNotNull() & b.isNotNull()).select(*keep, F.concat(record(a, 1), F.lit("\n"), record(b, 2)).alias("value"))


def _mates() -> list[Column]:
    """First and second read of a fragment, the best alignment of each."""
    return [F.try_element_at(F.filter("alignments", lambda r: F.coalesce(r["readInFragment"], F.lit(0)) == n), F.lit(1)) for n in (F.lit(0), F.lit(1))]


def tab5_lines(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fragments as name, bases, qualities[, bases, qualities of the second read]."""
    return _tab(df, keep, False)


def tab6_lines(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """As tab5_lines, with the name of the second read too."""
    return _tab(df, keep, True)


def _tab(df: DataFrame, keep: tuple[str, ...], second_name: bool) -> DataFrame:
    a, b = _mates()
    one = lambda r: F.concat_ws("\t", r["sequence"], r["qualityScores"])
    two = F.concat_ws("\t", F.concat(b["readName"], F.lit("/2")), one(b)) if second_name else one(b)
    name = F.concat(a["readName"], F.lit("/1")) if second_name else a["readName"]
    return df.where(a.isNotNull()).select(*keep, F.when(b.isNotNull(), F.concat_ws("\t", name, one(a), two)).otherwise(F.concat_ws("\t", a["readName"], one(a))).alias("value"))


def save_fastq(df: DataFrame, path: str, name: str = "readName", original: bool = False, single: bool = False, mode: str = "overwrite", compression: str | None = None) -> None:
    _write(fastq_lines(df, name, original), path, single, None, mode, compression)


def save_paired_fastq(df: DataFrame, first: str, second: str, strict: bool = True, original: bool = False, mode: str = "overwrite") -> None:
    """Reads 1 and 2 to their own files, in the order of names. strict: every name must have one of each."""
    if strict:
        bad = df.groupBy("readName").agg(F.count(F.when(F.col("readInFragment") == 0, 1)).alias("a"), F.count(F.when(F.col("readInFragment") == 1, 1)).alias("b")).where("a <> 1 or b <> 1").limit(1).collect()
        if bad:
            raise ValueError(f"no pair: {bad[0][0]}")
    for i, p in enumerate((first, second)):
        _write(fastq_lines(df.where(F.col("readInFragment") == i).orderBy("readName"), original=original), p, False, None, mode, None)


def fasta_lines(df: DataFrame, width: int = 60, keep: tuple[str, ...] = ()) -> DataFrame:
    head = F.concat(F.lit(">"), "name", F.when(F.col("description").isNotNull(), F.concat(F.lit(" "), "description")).otherwise(""))
    return df.select(*keep, F.concat(head, F.lit("\n"), F.regexp_replace(F.regexp_replace("sequence", f"(.{{{width}}})", "$1\n"), "\n$", "")).alias("value"))


def save_fasta(df: DataFrame, path: str, width: int = 60, single: bool = False, mode: str = "overwrite") -> None:
    _write(fasta_lines(df, width), path, single, None, mode, None)


def bed_lines(df: DataFrame, scores: tuple[float, float] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Six columns. scores: the range that scores are put on 0 to 1000 from."""
    score = interpolate_score(F.col("score"), *scores).cast("string") if scores else _score()
    return df.select(*keep, F.concat_ws("\t", "referenceName", "start", "end", name_of(df), score, strand_text(F.col("strand"))).alias("value"))


def narrow_peak_lines(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    a = lambda k: F.coalesce(F.try_element_at("attributes", F.lit(k)), F.lit("-1" if k != "signalValue" else "0"))
    return df.select(*keep, F.concat_ws("\t", "referenceName", "start", "end", name_of(df), _score(), strand_text(F.col("strand")), a("signalValue"), a("pValue"), a("qValue"), a("peak")).alias("value"))


def interval_list_lines(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, F.concat_ws("\t", "referenceName", F.col("start") + 1, "end", F.when(strand_text(F.col("strand")) == "-", "-").otherwise("+"), name_of(df)).alias("value"))


def _attributes(df: DataFrame, keys: dict[str, str], between: str, quote: str, join: str) -> Column:
    """Attributes as text in the order of their names; keys renames or drops (None)."""
    e = F.array_sort(F.map_entries(gather_attributes(df)))
    return F.array_join(F.transform(e, lambda x: F.concat(x["key"], F.lit(between + quote), x["value"], F.lit(quote))), join)


def gff3_lines(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, F.concat_ws("\t", "referenceName", _dot("source"), _dot("featureType"), F.col("start") + 1, "end", _score(), strand_text(F.col("strand")), _dot("phase"), _attributes(df, {}, "=", "", ";")).alias("value"))


def gtf_lines(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, F.concat_ws("\t", "referenceName", _dot("source"), _dot("featureType"), F.col("start") + 1, "end", _score(), strand_text(F.col("strand")), _dot("frame"), F.concat(_attributes(df, {}, " ", '"', "; "), F.lit(";"))).alias("value"))


_FEATURE_LINES = {".bed": bed_lines, ".narrowPeak": narrow_peak_lines, ".interval_list": interval_list_lines, ".gff3": gff3_lines, ".gtf": gtf_lines}


def save_features(df: DataFrame, path: str, references: list[tuple[str, int]] = (), single: bool = False, mode: str = "overwrite") -> None:
    """By extension: .bed, .narrowPeak, .interval_list, .gff3, .gtf, else Parquet."""
    lines = next((f for ext, f in _FEATURE_LINES.items() if path.lower().endswith(ext.lower())), None)
    if lines is None:
        df.write.mode(mode).parquet(path)
        return
    header = ["##gff-version 3.2.1"] if lines is gff3_lines else [f"@SQ\tSN:{n}\tLN:{k}" for n, k in references] if lines is interval_list_lines else None
    _write(lines(df), path, single, header, mode, None)


def vcf_lines(contexts: DataFrame, samples: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Variant contexts (variant, genotypes) as VCF lines: one line per variant, one column per sample."""
    v = "variant."
    info = lambda k, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}="), F.col(c).cast("string")))
    flag = lambda k, c: F.when(F.col(c), F.lit(k))
    a = v + "annotation."
    held = contexts.select(a + "*").columns
    rest = F.transform(F.array_sort(F.map_entries(F.coalesce(F.col(a + "attributes"), F.create_map().cast("map<string,string>")))), lambda e: F.when(e["value"] == "true", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"])))
    both = lambda k, r, x: F.when(F.col(a + r).isNotNull() & F.col(a + x).isNotNull(), F.concat(F.lit(f"{k}="), F.col(a + r), F.lit(","), F.col(a + x)))
    known = [(("ancestralAllele",), info("AA", a + "ancestralAllele")), (("alleleCount",), info("AC", a + "alleleCount")), (("alleleFrequency",), info("AF", a + "alleleFrequency")), (("cigar",), info("CIGAR", a + "cigar"))]
    known += [(x, both(k, *x)) for k, x in (("AD", ("referenceReadDepth", "readDepth")), ("ADF", ("referenceForwardReadDepth", "forwardReadDepth")), ("ADR", ("referenceReverseReadDepth", "reverseReadDepth")))]
    known += [((c,), flag(k, a + c)) for c, k in INFO_FLAGS.items()]
    if "transcriptEffects" in held:
        known.append((("transcriptEffects",), F.when(F.size(a + "transcriptEffects") > 0, F.concat(F.lit("ANN="), format_effects(F.col(a + "transcriptEffects"))))))
    known = F.array_compact(F.array(*[c for need, c in known if set(need) <= set(held)]))
    filters = F.when(~F.coalesce(F.col(v + "filtersApplied"), F.lit(False)), ".").when(F.col(v + "filtersPassed"), "PASS").otherwise(F.array_join(v + "filtersFailed", ";"))
    code = lambda x: F.when(x == "REF", "0").when(x == "ALT", "1").otherwise(".")
    dot = lambda c: F.coalesce(c.cast("string"), F.lit("."))

    def call(sample: str) -> Column:
        g = F.try_element_at(F.filter("genotypes", lambda x: x["sampleId"] == sample), F.lit(1))
        gt = F.array_join(F.transform(g["alleles"], code), "|")
        gt = F.when(F.coalesce(g["phased"], F.lit(False)), gt).otherwise(F.replace(gt, F.lit("|"), F.lit("/")))
        ad = F.when(g["referenceReadDepth"].isNull(), ".").otherwise(F.concat_ws(",", g["referenceReadDepth"], dot(g["alternateReadDepth"])))
        pl = F.array_join(F.transform(g["genotypeLikelihoods"], lambda p: F.floor(-p / 0.2302585092994046 + 0.5).cast("string")), ",")
        notes = g["variantCallingAnnotations"] if "variantCallingAnnotations" in fields else None
        ft = F.when(~F.coalesce(notes["filtersApplied"], F.lit(False)), ".").when(notes["filtersPassed"], "PASS").otherwise(F.array_join(notes["filtersFailed"], ";")) if notes is not None else F.lit(".")
        more = [dot(g[c]) if c in fields else F.lit(".") for c in ("minReadDepth", "phaseSetId", "phaseQuality")]
        return F.when(g.isNull(), "./.").otherwise(F.concat_ws(":", gt, ad, dot(g["readDepth"]), dot(g["genotypeQuality"]), dot(pl), *more, F.coalesce(ft, F.lit("."))))

    fields = contexts.schema["genotypes"].dataType.elementType.fieldNames() if samples else []

    all_info = F.array_join(F.concat(known, rest), ";")
    cols = [
        F.col(v + "referenceName"), (F.col(v + "start") + 1).cast("string"), F.coalesce(F.array_join(v + "names", ";"), F.lit(".")), F.col(v + "referenceAllele"), F.coalesce(v + "alternateAllele", F.lit(".")),
        F.when(F.col(v + "quality").isNull(), ".").otherwise(F.col(v + "quality").cast("string")), filters, F.when(all_info == "", ".").otherwise(all_info),
    ]
    if samples:
        cols += [F.lit("GT:AD:DP:GQ:PL:MIN_DP:PS:PQ:FT"), *[call(s) for s in samples]]
    return contexts.select(*keep, F.concat_ws("\t", *cols).alias("value"))


#: The header lines of the fields that are written.
VCF_LINES = (
    '##fileformat=VCFv4.2', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Read depths per allele">', '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Read depth">',
    '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype quality">', '##FORMAT=<ID=PL,Number=G,Type=Integer,Description="Phred-scaled genotype likelihoods">',
    '##FORMAT=<ID=MIN_DP,Number=1,Type=Integer,Description="Least read depth">', '##FORMAT=<ID=PS,Number=1,Type=Integer,Description="Phase set">', '##FORMAT=<ID=PQ,Number=1,Type=Integer,Description="Phase quality">', '##FORMAT=<ID=FT,Number=1,Type=String,Description="Filters of the genotype">',
)


def save_vcf(contexts: DataFrame, path: str, samples: list[str], header_lines: list[str] = (), single: bool = False, mode: str = "overwrite", compression: str | None = None) -> None:
    fixed = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"] + (["FORMAT", *samples] if samples else [])
    more = [h for h in header_lines if h not in VCF_LINES and not h.startswith("##fileformat")]
    _write(vcf_lines(contexts, samples), path, single, [*VCF_LINES, *more, "\t".join(fixed)], mode, compression)


def header_line(kind: str, ident: str, number: str = "1", type_: str = "String", description: str = "") -> str:
    """An INFO or FORMAT line (number: a count, or G genotypes, A alternate alleles, R all alleles) or a FILTER line."""
    if kind == "FILTER":
        return f'##FILTER=<ID={ident},Description="{description}">'
    if kind not in ("INFO", "FORMAT") or not (number in ("G", "A", "R", ".") or number.isdigit()):
        raise ValueError((kind, number))
    return f'##{kind}=<ID={ident},Number={number},Type={type_},Description="{description}">'
