"""Command line: python -m strandlake.cli COMMAND ..., inside spark-submit or on its own."""

from __future__ import annotations

import argparse
import re

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.frame import GenomicFrame, Meta
from strandlake.functions.intervals import parse_regions
from strandlake.operators import coverage as cov
from strandlake.operators import reads as rd
from strandlake.operators import sequences as sq
from strandlake.operators import variants as va
from strandlake.operators.bqsr import recalibrate
from strandlake.operators.markdup import mark_duplicates
from strandlake.operators.mdtags import compute_mismatching_positions, left_normalize_indels
from strandlake.operators.realign import realign_indels
from strandlake.operators.reads import to_fragments
from strandlake.plans.runtime import cut_lineage
from strandlake.sources import binary, load, sinks, text


def _save_alignments(f: GenomicFrame, path: str, single: bool) -> None:
    e = load.extension(path)
    if e == "sam":
        sinks.save_sam(f.df, path, f.meta.references, [dict(g) for g in f.meta.read_groups], single=single)
    elif e == "bam":
        binary.save_bam(f.df, path, list(f.meta.references), [dict(g) for g in f.meta.read_groups], single=single)
    elif e in ("fq", "fastq"):
        sinks.save_fastq(f.df, path, single=single)
    else:
        f.save_as_parquet(path)


def _sorted(f: GenomicFrame, how: str | None) -> GenomicFrame:
    if how == "reference":
        return f.transform(rd.sort_by_reference_position) if "readName" in f.df.columns else f.sort_lexicographically()
    if how == "name":
        return f.transform(rd.sort_by_read_name)
    if how == "index":
        return f.transform(lambda d: rd.sort_by_index(d, [n for n, _ in f.meta.references])) if "readName" in f.df.columns else f.sort()
    return f


def _loaded(spark: SparkSession, a: argparse.Namespace) -> GenomicFrame:
    """The input by its extension, or as what --load says it is."""
    if a.load == "bam":
        meta = load.load_alignments(spark, a.input).meta if load.extension(a.input) == "bam" else Meta()
        f = GenomicFrame(binary.read_bam(spark, a.input, parse_regions(a.regions) if a.regions else None), meta)
        return f.filter_by_overlapping_regions(parse_regions(a.regions)) if a.regions else f
    if a.load == "sam":
        return GenomicFrame(text.read_sam(spark, a.input))
    if a.load == "fastq":
        return GenomicFrame(text.read_paired_fastq(spark, a.input, a.mates) if a.mates else text.read_fastq(spark, a.input))
    if a.load == "ifastq":
        return GenomicFrame(text.read_interleaved_fastq(spark, a.input))
    if a.load == "parquet":
        return load._parquet(spark, a.input, a.regions)
    return load.load_alignments(spark, a.input, a.mates, a.regions)


def transform_alignments(spark: SparkSession, a: argparse.Namespace) -> None:
    """Fixed order: repartition, bin qualities, mark duplicates, realign, recalibrate, normalise indels, coalesce, sort, MD tags."""
    if a.aligned_only and a.regions:
        raise ValueError("--aligned-only and --regions exclude each other")
    f = _loaded(spark, a)
    if a.limit_projection:
        f = f.project(lambda c: c not in ("attributes", "originalQualityScores"))
    if a.aligned_only:
        f = f.transform(rd.filter_unaligned)
    if a.concat:
        f = f.union(load.load_alignments(spark, a.concat))
    if a.read_group is not None:
        name = a.read_group or re.sub(r"\.[^.]*$", "", a.input.rstrip("/").rsplit("/", 1)[-1])
        f = f.transform(lambda d: d.withColumn("readGroupId", F.lit(name))).add_meta(read_groups=[(("ID", name),)])
    if a.min_mapping_quality is not None:
        f = f.transform(lambda d: rd.filter_by_mapping_quality(d, a.min_mapping_quality))
    if a.repartition:
        f = f.transform(lambda d: d.repartition(a.repartition))
    kept = (lambda g: g.persist(getattr(StorageLevel, a.storage_level))) if a.cache else (lambda g: g)
    if a.bin_quality_scores:
        f = f.transform(lambda d: rd.bin_quality_scores(d, a.bin_quality_scores))
    if a.mark_duplicates:
        groups = [dict(g) for g in f.meta.read_groups]
        libs = spark.createDataFrame([(g.get("ID"), g.get("LB")) for g in groups], "id string, library string") if groups else None
        f = kept(f).transform(lambda d: mark_duplicates(d, libs))
    if a.realign_indels:
        known = va.indel_table(load.load_variants(spark, a.known_indels).df) if a.known_indels else None
        sizes = {"max_indel": a.max_indel_size, "max_consensus": a.max_consensus_number, "lod": a.lod, "max_target": a.max_target_size, "max_reads": a.max_reads_per_target, "unclip": a.unclip_reads}
        f = kept(f).transform(lambda d: realign_indels(d, "knowns" if known is not None else "reads", known, **sizes))
    if a.recalibrate:
        sites = load.load_variants(spark, a.known_snps).df if a.known_snps else None
        f = kept(f).transform(lambda d: recalibrate(cut_lineage(d.withColumn("_row", F.monotonically_increasing_id())), sites, "_row", a.min_acceptable_quality, a.sampling_fraction, a.sampling_seed).drop("_row"))
    if a.left_normalize_indels:
        f = f.transform(left_normalize_indels)
    if a.coalesce:
        f = f.transform(lambda d: d.repartition(a.coalesce) if a.force_shuffle else d.coalesce(a.coalesce))
    f = _sorted(f, a.sort)
    if a.md_tags:
        slices = load.load_slices(spark, a.md_tags, a.md_tag_fragment_size).df
        f = f.transform(lambda d: compute_mismatching_positions(d, slices, overwrite=a.overwrite_tags, strict=a.stringency == "strict"))
    if not a.disable_steps:
        f = f.add_meta(steps=["transformAlignments " + " ".join(f"{k}={v}" for k, v in sorted(vars(a).items()) if v not in (None, False) and k != "command")])
    if a.partition_by_start:
        f.save_as_partitioned_parquet(a.output, bin_size=a.partition_bin_size)
        return
    if a.sort_fastq and load.extension(a.output) in ("fq", "fastq"):
        f = f.transform(rd.sort_by_read_name)
    _save_alignments(f, a.output, a.single)


def _generic(loader, saver):
    def run(spark: SparkSession, a: argparse.Namespace) -> None:
        f = _sorted(loader(spark, a.input), a.sort)
        f = f.transform(lambda d: d.coalesce(a.coalesce)) if a.coalesce else f
        if a.partition_by_start:
            f.save_as_partitioned_parquet(a.output)
        else:
            saver(f, a)

    return run


def _parquet(f: GenomicFrame, a: argparse.Namespace) -> None:
    f.save_as_parquet(a.output)


def _features(f: GenomicFrame, a: argparse.Namespace) -> None:
    sinks.save_features(f.df, a.output, f.meta.references, a.single)


def _vcf(contexts: DataFrame, f: GenomicFrame, a: argparse.Namespace, samples: list[str]) -> None:
    if load.extension(a.output) == "vcf":
        sinks.save_vcf(contexts, a.output, samples, list(f.meta.header_lines), a.single)
    else:
        f.save_as_parquet(a.output)


def _variants(f: GenomicFrame, a: argparse.Namespace) -> None:
    none = va.variants_to_contexts(f.df).withColumn("genotypes", F.array())
    _vcf(none, f, a, [])


def _genotypes(f: GenomicFrame, a: argparse.Namespace) -> None:
    _vcf(va.to_variant_contexts(f.df), f, a, list(f.meta.samples))


def _fasta(f: GenomicFrame, a: argparse.Namespace) -> None:
    if load.extension(a.output) in ("fa", "fasta"):
        sinks.save_fasta(f.df, a.output, single=a.single)
    else:
        f.save_as_parquet(a.output)


def count_kmers(spark: SparkSession, a: argparse.Namespace) -> None:
    counts = rd.count_kmers(load.load_alignments(spark, a.input).df, a.k)
    if a.histogram:
        counts.groupBy("n").agg(F.count("*").alias("kmers")).orderBy("n").show(100, False)
    counts.select(F.concat_ws("\t", "kmer", "n").alias("value")).write.mode("overwrite").text(a.output)


def count_slice_kmers(spark: SparkSession, a: argparse.Namespace) -> None:
    sq.count_slice_kmers(load.load_slices(spark, a.input).df, a.k).select(F.concat_ws("\t", "kmer", "n").alias("value")).write.mode("overwrite").text(a.output)


def coverage(spark: SparkSession, a: argparse.Namespace) -> None:
    r = cov.strand_filtered(load.load_alignments(spark, a.input).df, {"+": False, "-": True, None: None}[a.strand])
    c = cov.to_coverage(r, collapse=a.collapse)
    sinks.save_features(cov.to_features(c) if load.extension(a.output) else c, a.output, single=a.single)


def flagstat(spark: SparkSession, a: argparse.Namespace) -> None:
    rd.flagstat(load.load_alignments(spark, a.input).df).orderBy("failedQuality").show(vertical=True, truncate=False)


def view(spark: SparkSession, a: argparse.Namespace) -> None:
    f = load.load_alignments(spark, a.input).transform(lambda d: rd.view(d, a.f, a.F, a.g, a.G))
    if a.c:
        print(f.df.count())
    elif a.output:
        _save_alignments(f, a.output, a.single)
    else:
        sinks.sam_lines(f.df).show(a.lines, False)


def to_fastq(spark: SparkSession, a: argparse.Namespace) -> None:
    f = load.load_alignments(spark, a.input).df
    if a.second:
        sinks.save_paired_fastq(f, a.output, a.second)
    else:
        sinks.save_fastq(f, a.output)


def transform_fragments(spark: SparkSession, a: argparse.Namespace) -> None:
    f = load.load_alignments(spark, a.input, a.mates)
    if a.mark_duplicates:
        f = f.transform(mark_duplicates)
    f.transmute(to_fragments).save_as_parquet(a.output)


def print_records(spark: SparkSession, a: argparse.Namespace) -> None:
    df = spark.read.parquet(a.input)
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    lines.write.mode("overwrite").text(a.output) if a.output else lines.show(a.lines, False)


def merge_shards(spark: SparkSession, a: argparse.Namespace) -> None:
    """Part files as one, their lines in the order of the files."""
    spark.read.text(a.input).coalesce(1).write.mode("overwrite").text(a.output)


COMMANDS = {
    "countKmers": count_kmers, "countSliceKmers": count_slice_kmers, "transformAlignments": transform_alignments, "transformFeatures": _generic(load.load_features, _features), "transformGenotypes": _generic(load.load_genotypes, _genotypes),
    "transformVariants": _generic(load.load_variants, _variants), "transformSequences": _generic(load.load_sequences, _fasta), "transformSlices": _generic(load.load_slices, _parquet), "transformFragments": transform_fragments, "coverage": coverage,
    "mergeShards": merge_shards, "toFastq": to_fastq, "print": print_records, "flagstat": flagstat, "view": view,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlake")
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        s = sub.add_parser(name)
        s.add_argument("input")
        if name not in ("flagstat",):
            s.add_argument("output", nargs="?" if name in ("view", "print") else None)
        s.add_argument("--single", action="store_true", help="one output file")
        s.add_argument("--coalesce", type=int)
        s.add_argument("--sort", choices=("reference", "index", "name"))
        s.add_argument("--partition-by-start", action="store_true")
        if name in ("countKmers", "countSliceKmers"):
            s.add_argument("k", type=int)
            s.add_argument("--histogram", action="store_true")
        if name in ("transformAlignments", "transformFragments"):
            s.add_argument("--mates")
            s.add_argument("--mark-duplicates", action="store_true")
        if name == "transformAlignments":
            for flag in ("--realign-indels", "--recalibrate", "--overwrite-tags", "--limit-projection", "--aligned-only", "--unclip-reads", "--left-normalize-indels", "--force-shuffle", "--sort-fastq", "--cache", "--disable-steps"):
                s.add_argument(flag, action="store_true")
            for opt in ("--regions", "--concat", "--bin-quality-scores", "--known-snps", "--known-indels", "--md-tags", "--read-group"):
                s.add_argument(opt)
            s.add_argument("--load", choices=("sam", "bam", "fastq", "ifastq", "parquet"), help="what the input is, whatever its extension")
            s.add_argument("--stringency", choices=("strict", "lenient", "silent"), default="lenient")
            s.add_argument("--storage-level", default="MEMORY_AND_DISK")
            for opt, default in (("--min-mapping-quality", None), ("--repartition", None), ("--min-acceptable-quality", 5), ("--sampling-seed", 0), ("--max-indel-size", 500), ("--max-consensus-number", 30), ("--max-target-size", 3000), ("--max-reads-per-target", 20_000), ("--md-tag-fragment-size", 1_000_000), ("--partition-bin-size", 1_000_000)):
                s.add_argument(opt, type=int, default=default)
            s.add_argument("--sampling-fraction", type=float)
            s.add_argument("--lod", type=float, default=5.0)
        if name == "coverage":
            s.add_argument("--strand", choices=("+", "-"))
            s.add_argument("--collapse", action="store_true")
        if name == "toFastq":
            s.add_argument("--second")
        if name in ("view", "print"):
            s.add_argument("--lines", type=int, default=20)
        if name == "view":
            for flag in ("-f", "-F", "-g", "-G"):
                s.add_argument(flag, type=int, default=0)
            s.add_argument("-c", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    COMMANDS[a.command](SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
