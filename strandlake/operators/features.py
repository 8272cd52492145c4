"""Filters, order and attribute handling of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attribute keys of GFF3 that are columns of their own.
RESERVED = ("ID", "Name", "Alias", "Parent", "Target", "Gap", "Derives_from", "Note", "Dbxref", "Ontology_term", "Is_circular")


def filter_to_feature_type(df: DataFrame, *types: str) -> DataFrame:
    return df.where(F.col("featureType").isin(*types))


def filter_to_gene(df: DataFrame, *ids: str) -> DataFrame:
    return df.where(F.col("geneId").isin(*ids))


def filter_to_transcript(df: DataFrame, *ids: str) -> DataFrame:
    return df.where(F.col("transcriptId").isin(*ids))


def filter_to_exon(df: DataFrame, *ids: str) -> DataFrame:
    return df.where(F.col("exonId").isin(*ids))


def filter_to_protein(df: DataFrame, *ids: str) -> DataFrame:
    return df.where(F.col("proteinId").isin(*ids))


def filter_by_score(df: DataFrame, least: float) -> DataFrame:
    return df.where(F.col("score") >= least)


def filter_to_parent(df: DataFrame, *ids: str) -> DataFrame:
    return df.where(F.arrays_overlap("parentIds", F.array(*[F.lit(i) for i in ids])))


def filter_by_attribute(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.try_element_at("attributes", F.lit(key)) == value)


def attribute(df_key: str) -> Column:
    return F.try_element_at("attributes", F.lit(df_key))


def sort_by_reference(df: DataFrame, ascending: bool = True) -> DataFrame:
    """By position, then ids, with exon, intron and rank numbers of the attributes as numbers; nulls last."""
    number = lambda k: attribute(k).try_cast("int")
    keys = [
        F.col("referenceName"), F.col("start"), F.col("end"), F.col("strand"), F.col("featureId"), F.col("featureType"), F.col("name"), F.col("source"), F.col("phase"), F.col("frame"), F.col("score"),
        F.col("geneId"), F.col("transcriptId"), F.col("exonId"), number("exon_number"), number("intron_number"), number("rank"), F.col("proteinId"),
    ]
    return df.orderBy(*[k.asc_nulls_last() if ascending else k.desc_nulls_last() for k in keys])


def last_wins(entries: Column) -> Column:
    """array<struct<key, value>> as a map; of a repeated key the last value holds."""
    keys = F.transform(entries, lambda x: x["key"])
    return F.map_from_entries(F.filter(entries, lambda x, i: F.array_position(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), x["key"]) == 0))


def gff3_entries(text: Column) -> Column:
    """"a=b;c=d" split at the first = of each part; parts without one are left out."""
    parts = F.filter(F.split(text, ";"), lambda p: p.contains("="))
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, "^([^=]*)=", 1)).alias("key"), F.regexp_replace(p, "^[^=]*=", "").alias("value")))


def gtf_entries(text: Column) -> Column:
    """key "value"; pairs, and key value pairs without quotes."""
    pair = F.lit(r'([^\s;"]+)\s+(?:"([^"]*)"|([^\s;"]+))')
    z = F.arrays_zip(F.regexp_extract_all(text, pair, F.lit(1)).alias("k"), F.regexp_extract_all(text, pair, F.lit(2)).alias("q"), F.regexp_extract_all(text, pair, F.lit(3)).alias("b"))
    return F.transform(z, lambda x: F.struct(x["k"].alias("key"), F.concat(x["q"], x["b"]).alias("value")))


def to_dbxref(text: Column) -> Column:
    """"db:accession" as a struct; the colon belongs to neither. null without a colon."""
    return F.when(text.contains(":"), F.struct(F.regexp_extract(text, "^([^:]*):", 1).alias("db"), F.regexp_replace(text, "^[^:]*:", "").alias("accession")))


def to_strand(text: Column) -> Column:
    """+ FORWARD, - REVERSE, . INDEPENDENT, ? UNKNOWN; null for anything else."""
    return F.when(text == "+", "FORWARD").when(text == "-", "REVERSE").when(text == ".", "INDEPENDENT").when(text == "?", "UNKNOWN")


def strand_text(strand: Column) -> Column:
    return F.when(strand == "FORWARD", "+").when(strand == "REVERSE", "-").when(strand == "UNKNOWN", "?").otherwise(".")


def name_of(df: DataFrame) -> Column:
    """What to call a feature: name, else id, else the most specific of its ids, else its type."""
    ids = [F.col(c) for c in ("name", "featureId", "exonId", "transcriptId", "geneId") if c in df.columns]
    return F.coalesce(*ids, F.concat(F.col("featureType"), F.lit(" "), F.col("referenceName"), F.lit(":"), F.col("start"), F.lit("-"), F.col("end")))


def gather_attributes(df: DataFrame) -> Column:
    """All attributes of a feature as one map again: those held in columns and the rest."""
    cols = {"ID": "featureId", "Name": "name", "Target": "target", "Gap": "gap", "Derives_from": "derivesFrom", "gene_id": "geneId", "transcript_id": "transcriptId", "exon_id": "exonId", "protein_id": "proteinId"}
    arrays = {"Alias": "aliases", "Parent": "parentIds", "Note": "notes"}
    entries = [F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in cols.items() if c in df.columns]
    entries += [F.struct(F.lit(k).alias("key"), F.array_join(c, ",").alias("value")) for k, c in arrays.items() if c in df.columns]
    own = F.filter(F.array(*entries), lambda x: x["value"].isNotNull() & (x["value"] != ""))
    rest = F.coalesce(F.map_entries("attributes"), F.array().cast("array<struct<key:string,value:string>>"))
    return last_wins(F.concat(own, rest))


def interpolate_score(score: Column, low: float, high: float, to_low: int = 0, to_high: int = 1000) -> Column:
    """A score of [low, high] on the scale [to_low, to_high], rounded half up; outside it is clamped, null is to_low."""
    x = (F.least(F.greatest(score, F.lit(low)), F.lit(high)) - low) / (high - low) * (to_high - to_low) + to_low
    return F.coalesce(F.floor(x + 0.5), F.lit(to_low)).cast("int")
