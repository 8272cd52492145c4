"""Variants and genotypes: filters, grouping, conversions, transcript effects, known sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.plans.runtime import join_bounded

KEY = ["referenceName", "start", "end", "referenceAllele", "alternateAllele"]


def filter_to_passed(df: DataFrame) -> DataFrame:
    """Variants whose filters were applied and passed."""
    return df.where("filtersApplied and filtersPassed")


def filter_by_quality(df: DataFrame, least: float) -> DataFrame:
    """Without rows split from multi-allelic sites, whose quality is that of the site; null counts as not split."""
    return df.where(~F.coalesce("splitFromMultiAllelic", F.lit(False)) & (F.col("quality") >= least))


def filter_by_read_depth(df: DataFrame, least: int) -> DataFrame:
    return df.where(F.col("annotation.readDepth") >= least)


def filter_by_reference_read_depth(df: DataFrame, least: int) -> DataFrame:
    return df.where(F.col("annotation.referenceReadDepth") >= least)


def filter_to_reference(df: DataFrame, *names: str) -> DataFrame:
    return df.where(F.col("referenceName").isin(*names))


def _snv() -> Column:
    return (F.length("referenceAllele") == 1) & (F.length("alternateAllele") == 1)


def _mnv() -> Column:
    return (F.length("referenceAllele") > 1) & (F.length("referenceAllele") == F.length("alternateAllele"))


def _indel() -> Column:
    return F.length("referenceAllele") != F.length("alternateAllele")


def _keep(kind) -> tuple:
    return lambda df: df.where(kind()), lambda df: df.where(~F.coalesce(kind(), F.lit(False)))


filter_to_single_nucleotide, filter_single_nucleotide = _keep(_snv)
filter_to_multiple_nucleotide, filter_multiple_nucleotide = _keep(_mnv)
filter_to_indels, filter_indels = _keep(_indel)

# Genotypes: (variant struct, referenceName, start, end, sampleId, alleles, ...). Null never passes.


def genotypes_passed(df: DataFrame) -> DataFrame:
    return df.where("variantCallingAnnotations.filtersApplied and variantCallingAnnotations.filtersPassed")


def genotypes_by(df: DataFrame, column: str, least: int) -> DataFrame:
    """By genotypeQuality, readDepth, alternateReadDepth or referenceReadDepth."""
    return df.where(F.col(column) >= least)


def genotypes_to_samples(df: DataFrame, *samples: str) -> DataFrame:
    return df.where(F.col("sampleId").isin(*samples))


def filter_no_calls(df: DataFrame) -> DataFrame:
    """Genotypes without a no-call allele."""
    return df.where(~F.array_contains("alleles", "NO_CALL"))


def _by_variant(df: DataFrame) -> list[Column]:
    return [F.col(f"variant.{k}").alias(k) for k in KEY]


def to_variant_contexts(genotypes: DataFrame) -> DataFrame:
    """One row per variant with all its genotypes, ordered by sample. Groups by position and alleles, as maps can't be keys."""
    rest = [c for c in genotypes.columns if c != "variant"]
    g = genotypes.groupBy(*_by_variant(genotypes)).agg(F.first("variant").alias("variant"), F.collect_list(F.struct("sampleId", F.struct(*rest).alias("g"))).alias("g"))
    # A comparison of the samples alone: genotypes hold maps, which have no order.
    by_sample = F.array_sort("g", lambda a, b: F.when(a["sampleId"] < b["sampleId"], -1).when(a["sampleId"] > b["sampleId"], 1).otherwise(0))
    return g.select("referenceName", "start", "end", "variant", F.transform(by_sample, lambda x: x["g"]).alias("genotypes"))


def to_variants(genotypes: DataFrame, dedupe: bool = False) -> DataFrame:
    v = genotypes.select("variant.*")
    return v.dropDuplicates(KEY) if dedupe else v


def variants_to_contexts(variants: DataFrame) -> DataFrame:
    return variants.select("referenceName", "start", "end", F.struct(*variants.columns).alias("variant"))


def contexts_to_genotypes(contexts: DataFrame) -> DataFrame:
    return contexts.select("variant", F.explode("genotypes").alias("g")).select("variant", "g.*")


def contexts_to_variants(contexts: DataFrame) -> DataFrame:
    return contexts.select("variant.*")


def copy_end_to_attribute(genotypes: DataFrame) -> DataFrame:
    """The variant's end as attribute END of its annotation, replacing one that is there."""
    at = F.coalesce("variant.annotation.attributes", F.create_map().cast("map<string,string>"))
    end = F.create_map(F.lit("END"), F.col("variant.end").cast("string"))
    both = F.map_concat(F.map_filter(at, lambda k, v: k != "END"), end)
    return genotypes.withColumn("variant", F.col("variant").withField("annotation", F.coalesce("variant.annotation", F.from_json(F.lit("{}"), genotypes.schema["variant"].dataType["annotation"].dataType)).withField("attributes", both)))


#: INFO flags and the columns of the annotation they are held in.
INFO_FLAGS = {"dbSnp": "DB", "hapMap2": "H2", "hapMap3": "H3", "validated": "VALIDATED", "thousandGenomes": "1000G", "somatic": "SOMATIC"}

# Transcript effects (ANN).

#: The fields of an ANN entry, in order.
ANN_FIELDS = ("alternateAllele", "effects", "annotationImpact", "geneName", "geneId", "featureType", "featureId", "biotype", "rankTotal", "transcriptHgvs", "proteinHgvs", "cdna", "cds", "protein", "distance", "messages")


def parse_effects(ann: Column) -> Column:
    """ANN text as an array of effect structs: & separates values, a/b are position and total, a range keeps its start.
    Entries without exactly 16 fields are left out."""

    def one(e: Column) -> Column:
        f = {n: F.nullif(F.trim(F.split(e, "\\|", -1)[i]), F.lit("")) for i, n in enumerate(ANN_FIELDS)}
        many = lambda c: F.coalesce(F.split(c, "&"), F.array().cast("array<string>"))
        first = lambda c: F.regexp_extract(c, "^([0-9]+)", 1).try_cast("int")
        total = lambda c: F.regexp_extract(c, "/([0-9]+)$", 1).try_cast("int")
        return F.struct(
            f["alternateAllele"].alias("alternateAllele"), many(f["effects"]).alias("effects"), f["geneName"].alias("geneName"), f["geneId"].alias("geneId"), f["featureType"].alias("featureType"), f["featureId"].alias("featureId"), f["biotype"].alias("biotype"),
            first(f["rankTotal"]).alias("rank"), total(f["rankTotal"]).alias("total"), f["transcriptHgvs"].alias("transcriptHgvs"), f["proteinHgvs"].alias("proteinHgvs"),
            first(f["cdna"]).alias("cdnaPosition"), total(f["cdna"]).alias("cdnaLength"), first(f["cds"]).alias("codingSequencePosition"), total(f["cds"]).alias("codingSequenceLength"), first(f["protein"]).alias("proteinPosition"), total(f["protein"]).alias("proteinLength"),
            f["distance"].try_cast("int").alias("distance"), many(f["messages"]).alias("messages"),
        )

    return F.transform(F.filter(F.split(ann, ","), lambda e: F.size(F.split(e, "\\|", -1)) == len(ANN_FIELDS)), one)


def format_effects(effects: Column) -> Column:
    """The ANN text of effect structs."""

    def one(e: Column) -> Column:
        t = lambda n: F.coalesce(e[n].cast("string"), F.lit(""))
        frac = lambda a, b: F.concat(t(a), F.when(e[b].isNotNull(), F.concat(F.lit("/"), t(b))).otherwise(""))
        return F.concat_ws(
            "|", t("alternateAllele"), F.array_join(e["effects"], "&"), F.lit(""), t("geneName"), t("geneId"), t("featureType"), t("featureId"), t("biotype"), frac("rank", "total"), t("transcriptHgvs"), t("proteinHgvs"),
            frac("cdnaPosition", "cdnaLength"), frac("codingSequencePosition", "codingSequenceLength"), frac("proteinPosition", "proteinLength"), t("distance"), F.array_join(e["messages"], "&"),
        )

    return F.array_join(F.transform(effects, one), ",")


# Known sites.


def at_known_sites(df: DataFrame, sites: DataFrame, reference: str = "referenceName", position: str = "start", known: bool = True, row_id: str | None = None) -> DataFrame:
    """Rows at (or, known=False, not at) the sites (referenceName, start); the sites are sent only if few."""
    s = sites.select(F.col("referenceName").alias(reference), F.col("start").alias(position)).distinct()
    return join_bounded(df, s, [reference, position], "left_semi" if known else "left_anti", salt_of=row_id)


def indel_table(variants: DataFrame) -> DataFrame:
    """(referenceName, start, end, consensus): known indels as the bases they put in place of [start, end)."""
    v = filter_to_indels(variants)
    return v.select("referenceName", (F.col("start") + 1).alias("start"), (F.col("start") + F.length("referenceAllele")).alias("end"), F.expr("substring(alternateAllele, 2)").alias("consensus"))
