"""Reads and fragments: filters, sorts, grouping, k-mers, quality bins, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.phred import bin_qualities
from strandlake.functions.text import kmers

# Filters. "filter X" removes X, "filter_to X" keeps X; null never passes.


def filter_by_mapping_quality(df: DataFrame, least: int) -> DataFrame:
    return df.where(F.col("mappingQuality") >= least)


def filter_unaligned(df: DataFrame) -> DataFrame:
    return df.where("readMapped")


def filter_unpaired(df: DataFrame) -> DataFrame:
    return df.where("readPaired")


def filter_duplicates(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("duplicateRead", F.lit(False)))


def filter_to_primary(df: DataFrame) -> DataFrame:
    return df.where("primaryAlignment")


def filter_to(df: DataFrame, column: str, *values: str) -> DataFrame:
    """To read groups, samples or references: rows whose column is one of the values."""
    return df.where(F.col(column).isin(*values))


# Sorts.


def sort_by_read_name(df: DataFrame) -> DataFrame:
    return df.orderBy("readName", "readInFragment")


def sort_by_reference_position(df: DataFrame) -> DataFrame:
    """By reference name and start; unmapped reads last, by read name."""
    unmapped = ~F.coalesce("readMapped", F.lit(False))
    return df.orderBy(unmapped, F.when(unmapped, F.col("readName")).otherwise(F.col("referenceName")), F.when(~unmapped, F.col("start")))


def sort_by_index(df: DataFrame, references: list[str]) -> DataFrame:
    """By the order of the dictionary and start; unmapped reads last, by read name. The dictionary is
    driver-side metadata and is joined."""
    refs = df.sparkSession.createDataFrame([(n, i) for i, n in enumerate(references)], "_name string, _at int")
    unmapped = ~F.coalesce("readMapped", F.lit(False))
    j = df.join(F.broadcast(refs), F.col("referenceName") == F.col("_name"), "left")
    return j.orderBy(unmapped, F.when(~unmapped, F.col("_at")), F.when(~unmapped, F.col("start")), "readName").select(*[F.col(f"`{c}`") for c in df.columns])


# Shapes.


def to_fragments(reads: DataFrame) -> DataFrame:
    """(name, readGroupId, insertSize, alignments) per read group and read name: primary mapped
    reads first, then secondary mapped, then unmapped; insertSize is that of the first primary read."""
    mapped, primary = F.coalesce("readMapped", F.lit(False)), F.coalesce("primaryAlignment", F.lit(False))
    rank = F.when(mapped & primary, 0).when(mapped, 1).otherwise(2)
    row = F.struct(rank.alias("rank"), F.coalesce("readInFragment", F.lit(0)).alias("part"), F.struct(*reads.columns).alias("read"))
    g = reads.groupBy("readGroupId", F.col("readName").alias("name")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    first = F.filter("r", lambda x: x["rank"] == 0)
    return g.select("name", "readGroupId", F.try_element_at(first, F.lit(1))["read"]["insertSize"].cast("int").alias("insertSize"), F.transform("r", lambda x: x["read"]).alias("alignments"))


def to_alignments(fragments: DataFrame) -> DataFrame:
    return fragments.select(F.inline("alignments"))


def to_reads(alignments: DataFrame) -> DataFrame:
    """Alignments as plain reads."""
    seq = F.col("sequence")
    return alignments.select(F.col("readName").alias("name"), F.lit(None).cast("string").alias("description"), F.lit("DNA").alias("alphabet"), seq, F.length(seq).cast("long").alias("length"), "qualityScores", F.col("readGroupSampleId").alias("sampleId"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("attributes"))


def count_kmers(df: DataFrame, k: int, sequence: str = "sequence") -> DataFrame:
    """(kmer, n). Counted within each partition before the shuffle."""
    return df.select(F.explode(kmers(F.col(sequence), k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def bin_quality_scores(df: DataFrame, bins, column: str = "qualityScores") -> DataFrame:
    return df.withColumn(column, bin_qualities(F.col(column), bins))


def reassemble_pairs(first: DataFrame, second: DataFrame, strict: bool = True) -> DataFrame:
    """First and second reads of pairs as one table, joined on the read name without its two-character suffix.

    strict: names must occur exactly once on either side, else the query fails; otherwise names
    that occur only once on each side form pairs and the others are left out.
    """
    stem = F.col("readName").substr(F.lit(1), F.length("readName") - 2)
    sides = [df.withColumn("_stem", stem).withColumn("_side", F.lit(i)) for i, df in enumerate((first, second))]
    both = sides[0].unionByName(sides[1])
    w = Window.partitionBy("_stem")
    n = [F.count(F.when(F.col("_side") == i, 1)).over(w) for i in (0, 1)]
    both = both.withColumn("_good", (n[0] == 1) & (n[1] == 1))
    if strict:
        both = both.withColumn("_good", F.when(~F.col("_good"), F.raise_error(F.concat(F.lit("no pair: "), F.col("readName"))).cast("boolean")).otherwise(True))
    out = both.where("_good").withColumns({"readName": F.col("_stem"), "readPaired": F.lit(True), "properPair": F.lit(True), "readInFragment": F.col("_side").cast("int")})
    return out.drop("_stem", "_side", "_good")


#: The bits of the SAM flag and the condition each stands for.
FLAG_BITS = {
    1: "readPaired", 2: "properPair", 4: "NOT readMapped", 8: "readPaired AND NOT mateMapped", 16: "readNegativeStrand", 32: "mateNegativeStrand",
    64: "readPaired AND readInFragment = 0", 128: "readPaired AND readInFragment = 1", 256: "readMapped AND NOT primaryAlignment",
    512: "failedVendorQualityChecks", 1024: "duplicateRead", 2048: "supplementaryAlignment",
}


def _bit(n: int) -> Column:
    return F.coalesce(F.expr(FLAG_BITS[n]), F.lit(False))


def flags(df: DataFrame, out: str = "flags") -> DataFrame:
    """The SAM flag of each read; null conditions count as false."""
    return df.withColumn(out, sum((F.when(_bit(n), n).otherwise(0) for n in FLAG_BITS), F.lit(0)))


def from_flags(flag: Column) -> dict[str, Column]:
    """The boolean columns that a SAM flag stands for. primaryAlignment goes by its own bit alone, so unmapped and
    supplementary reads have it too; counters that mean neither say so."""
    on = lambda n: flag.bitwiseAND(F.lit(n)) != 0
    return {
        "readPaired": on(1), "properPair": on(2), "readMapped": ~on(4), "mateMapped": on(1) & ~on(8), "readNegativeStrand": on(16), "mateNegativeStrand": on(32),
        "readInFragment": F.when(on(128), 1).otherwise(0), "primaryAlignment": ~on(256), "failedVendorQualityChecks": on(512), "duplicateRead": on(1024), "supplementaryAlignment": on(2048),
    }


def view(df: DataFrame, all_of: int = 0, none_of: int = 0, any_of: int = 0, not_all_of: int = 0) -> DataFrame:
    """Flag filter: all bits of all_of set and none of none_of; of any_of some bit set; of not_all_of some bit unset."""
    bits = lambda m: [_bit(n) for n in FLAG_BITS if m & n]
    cond = F.lit(True)
    for b in bits(all_of):
        cond = cond & b
    for b in bits(none_of):
        cond = cond & ~b
    for group, wanted in ((bits(any_of), True), (bits(not_all_of), False)):
        if group:
            some = F.lit(False)
            for b in group:
                some = some | (b if wanted else ~b)
            cond = cond & some
    return df.where(cond)


def flagstat(df: DataFrame) -> DataFrame:
    """One row per QC class (failed) with the counters of a flag statistic; one aggregation, no keys shuffled but two.

    Duplicates count reads, per primary and secondary: all, with both mates mapped, with only the
    read mapped, and with the mate on another reference (null is a reference of its own there).
    """
    b = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("readPaired", "properPair", "readMapped", "mateMapped", "primaryAlignment", "supplementaryAlignment", "duplicateRead", "failedVendorQualityChecks")}
    p = b["primaryAlignment"] & ~b["supplementaryAlignment"]
    paired, mapped, mate = b["readPaired"], b["readMapped"], b["mateMapped"]
    apart = paired & mapped & mate & F.coalesce(F.col("referenceName") != F.col("mateReferenceName"), F.lit(False)) & p
    c = {
        "total": F.lit(True), "mapped": mapped, "pairedInSequencing": paired & p, "read1": paired & (F.col("readInFragment") == 0) & p, "read2": paired & (F.col("readInFragment") == 1) & p,
        "properlyPaired": paired & b["properPair"] & p, "withSelfAndMateMapped": paired & mapped & mate & p, "singleton": paired & mapped & ~mate & p,
        "withMateMappedToDiffChromosome": apart, "withMateMappedToDiffChromosomeMapQ5": apart & (F.coalesce("mappingQuality", F.lit(-1)) >= 5),
    }
    for name, of in (("Primary", p), ("Secondary", ~p)):
        d = b["duplicateRead"] & of
        c |= {f"duplicates{name}": d, f"duplicates{name}BothMapped": d & mapped & mate, f"duplicates{name}OnlyReadMapped": d & mapped & ~mate, f"duplicates{name}CrossChromosome": d & ~F.col("referenceName").eqNullSafe(F.col("mateReferenceName"))}
    return df.groupBy(b["failedVendorQualityChecks"].alias("failedQuality")).agg(*[F.count(F.when(x, 1)).alias(n) for n, x in c.items()])
