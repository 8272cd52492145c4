"""Loading by file extension. Compression endings (.gz, .bgz) are looked through; anything unknown is Parquet."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.frame import GenomicFrame, Meta
from strandlake.functions.intervals import parse_regions
from strandlake.operators import coverage as cov
from strandlake.operators import sequences as sq
from strandlake.operators.joins import Fields
from strandlake.operators.reads import to_fragments
from strandlake.operators.sequences import slice_by_length
from strandlake.operators.variants import to_variant_contexts, variants_to_contexts
from strandlake.sources import binary, parquet, text


def extension(path: str) -> str:
    """The extension of a path or glob in lower case, without a compression ending."""
    p = re.sub(r"\.(gz|bgz|bgzf|bz2)$", "", path.lower().rstrip("/"))
    m = re.search(r"\.([a-z0-9_]+)$", p)
    return m.group(1) if m else ""


def _parquet(spark: SparkSession, path: str, regions: str | None = None) -> GenomicFrame:
    meta = parquet.load_meta(spark, path)
    if "bin_size" in meta:
        df = parquet.load_partitioned(spark, path, parse_regions(regions) if regions else None)
        regions = None
    else:
        df = spark.read.parquet(path)
    f = GenomicFrame(df, Meta.from_dict(meta))
    return f.filter_by_overlapping_regions(parse_regions(regions)) if regions else f


def _some(f: GenomicFrame, regions: str | None) -> GenomicFrame:
    return f.filter_by_overlapping_regions(parse_regions(regions)) if regions else f


def _sam_meta(h: dict[str, list[dict[str, str]]]) -> Meta:
    refs = tuple((s["SN"], int(s["LN"])) for s in h.get("SQ", []))
    groups = tuple(tuple(sorted(g.items())) for g in h.get("RG", []))
    steps = tuple(p.get("CL", p.get("PN", "")) for p in h.get("PG", []))
    return Meta(refs, tuple(dict.fromkeys(g["SM"] for g in h.get("RG", []) if "SM" in g)), groups, steps)


def load_alignments(spark: SparkSession, path: str, mates: str | None = None, regions: str | None = None) -> GenomicFrame:
    """.sam, .bam, .fq, .fastq (with mates: paired), .ifq (interleaved), .fa, .fasta (unmapped), else Parquet."""
    e = extension(path)
    if e == "sam":
        return _some(GenomicFrame(text.read_sam(spark, path), _sam_meta(text.sam_header(spark, path))), regions)
    if e == "bam":
        # Headers of several files are put together, in the order of each.
        meta = _sam_meta(text.parse_sam_header(dict.fromkeys(x for h in binary.bam_headers(spark, path) for x in h.splitlines())))
        return _some(GenomicFrame(binary.read_bam(spark, path, parse_regions(regions) if regions else None), meta), regions)
    if e in ("fq", "fastq"):
        return GenomicFrame(text.read_paired_fastq(spark, path, mates) if mates else text.read_fastq(spark, path))
    if e == "ifq":
        return GenomicFrame(text.read_interleaved_fastq(spark, path))
    if e in ("fa", "fasta"):
        return GenomicFrame(sq.to_alignments(sq.to_reads(text.read_fasta(spark, path))))
    return _parquet(spark, path, regions)


def load_fragments(spark: SparkSession, path: str, mates: str | None = None) -> GenomicFrame:
    """Fragments; the regions of one are those of its alignments."""
    f = load_alignments(spark, path, mates)
    fields = Fields(many="alignments")
    return replace(f, fields=fields) if "alignments" in f.df.columns else f.transmute(to_fragments, fields)


def load_features(spark: SparkSession, path: str, regions: str | None = None) -> GenomicFrame:
    readers = {"bed": text.read_bed, "gff3": text.read_gff3, "gtf": text.read_gtf, "gff": text.read_gtf, "narrowpeak": text.read_narrow_peak, "interval_list": text.read_interval_list}
    e = extension(path)
    if e not in readers:
        return _parquet(spark, path, regions)
    refs = tuple(text.read_dictionary(spark, path)) if e == "interval_list" else ()
    return _some(GenomicFrame(readers[e](spark, path), Meta(references=refs)), regions)


def load_coverage(spark: SparkSession, path: str, regions: str | None = None) -> GenomicFrame:
    f = load_features(spark, path, regions)
    return f if "count" in f.df.columns else f.transmute(cov.from_features)


def _vcf_meta(spark: SparkSession, path: str) -> Meta:
    lines, samples = text.vcf_header(spark, path)
    found = (re.match(r"##contig=<ID=([^,>]+)(?:.*?length=(\d+))?", x) for x in lines)
    return Meta(tuple((m[1], int(m[2] or 0)) for m in found if m), tuple(samples), header_lines=tuple(x for x in lines if not x.startswith("##contig")))


def load_variants(spark: SparkSession, path: str, regions: str | None = None, info: list[str] | None = None) -> GenomicFrame:
    """info: the INFO keys of a VCF file to read, None for all."""
    return _some(GenomicFrame(text.read_variants(spark, path, info), _vcf_meta(spark, path)), regions) if extension(path) == "vcf" else _parquet(spark, path, regions)


def load_genotypes(spark: SparkSession, path: str, regions: str | None = None, info: list[str] | None = None, formats: list[str] | None = None) -> GenomicFrame:
    """info, formats: the INFO and FORMAT keys of a VCF file to read, None for all."""
    return _some(GenomicFrame(text.read_genotypes(spark, path, info, formats), _vcf_meta(spark, path)), regions) if extension(path) == "vcf" else _parquet(spark, path, regions)


def load_variant_contexts(spark: SparkSession, path: str, regions: str | None = None) -> GenomicFrame:
    """Variants with all their genotypes, from VCF with or without samples, from genotypes or from contexts in Parquet."""
    if extension(path) == "vcf":
        meta = _vcf_meta(spark, path)
        if not meta.samples:
            return load_variants(spark, path, regions).transmute(lambda d: variants_to_contexts(d).withColumn("genotypes", F.array()))
        f = load_genotypes(spark, path, regions)
    else:
        f = _parquet(spark, path, regions)
    return f if "genotypes" in f.df.columns else f.transmute(to_variant_contexts)


def load_sequences(spark: SparkSession, path: str, alphabet: str = "DNA") -> GenomicFrame:
    return GenomicFrame(text.read_fasta(spark, path, alphabet)) if extension(path) in ("fa", "fasta") else _parquet(spark, path)


def load_slices(spark: SparkSession, path: str, most: int = 10_000) -> GenomicFrame:
    e = extension(path)
    if e in ("fa", "fasta"):
        return load_sequences(spark, path).transmute(lambda d: slice_by_length(d, most))
    return GenomicFrame(binary.read_two_bit(spark, path, most)) if e == "2bit" else _parquet(spark, path)


def load_dictionary(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    return text.read_dictionary(spark, path)


def wrap(df: DataFrame, meta: Meta | None = None, metadata_path: str | None = None) -> GenomicFrame:
    """A user's DataFrame as a frame, with metadata given or read from beside a Parquet path."""
    return GenomicFrame(df, meta or Meta.from_dict(parquet.load_meta(df.sparkSession, metadata_path) if metadata_path else {}))
