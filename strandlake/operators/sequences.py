"""Sequences and slices: cutting, merging, extraction, flanks, k-mers, conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.intervals import OPEN_END
from strandlake.functions.text import kmers
from strandlake.operators.joins import Fields, region_join

_BASE = ["name", "description", "alphabet", "sampleId", "attributes"]


def _base(df: DataFrame) -> list[str]:
    return [c for c in _BASE if c in df.columns]


def slice_by_length(sequences: DataFrame, most: int) -> DataFrame:
    """Slices [i * most, (i + 1) * most) with index and number of slices; an empty sequence has none. A sequence is cut in one
    walk: a substring by number would walk to its place anew for every slice."""
    pieces = F.regexp_extract_all("sequence", F.lit(f"(?s).{{1,{most}}}"), F.lit(0))
    cut = sequences.where(F.length("sequence") > 0).select(*_base(sequences), F.length("sequence").cast("long").alias("totalLength"), F.posexplode(pieces).alias("index", "_s"))
    n, start = F.length("_s").cast("long"), F.col("index").cast("long") * most
    return cut.select(*_base(sequences), F.col("_s").alias("sequence"), start.alias("start"), (start + n).alias("end"), n.alias("length"), "totalLength", F.col("index").cast("int").alias("index"), F.ceil(F.col("totalLength") / most).cast("int").alias("slices"), F.lit("INDEPENDENT").alias("strand"))


def slice_by_regions(sequences: DataFrame, regions: list[tuple[str, int, int]]) -> DataFrame:
    """The parts of the sequences that the regions name; ends beyond a sequence are clipped. The regions
    are driver-side arguments and become literals."""
    wanted = F.filter(F.array(*[F.struct(F.lit(n).alias("r"), F.lit(s).cast("long").alias("s"), F.lit(e).cast("long").alias("e")) for n, s, e in regions]), lambda x: (x["r"] == F.col("name")) & (x["s"] < F.length("sequence")))
    cut = sequences.select(*_base(sequences), "sequence", F.length("sequence").cast("long").alias("totalLength"), F.explode(wanted).alias("w"))
    end = F.least(F.col("w")["e"], F.col("totalLength"))
    s = F.substring(F.col("sequence"), (F.col("w")["s"] + 1).cast("int"), (end - F.col("w")["s"]).cast("int"))
    return cut.select(*_base(sequences), s.alias("sequence"), F.col("w")["s"].alias("start"), end.alias("end"), F.length(s).cast("long").alias("length"), "totalLength", F.lit(None).cast("int").alias("index"), F.lit(None).cast("int").alias("slices"), F.lit("INDEPENDENT").alias("strand"))


def merge_slices(slices: DataFrame) -> DataFrame:
    """Slices of a name joined in order of start. One sequence is one row, so it has to fit in a task anyway."""
    extra = [F.first(c, ignorenulls=True).alias(c) for c in _base(slices) if c != "name"]
    parts = F.array_sort(F.collect_list(F.struct("start", "sequence")))
    g = slices.groupBy("name").agg(F.array_join(F.transform(parts, lambda x: x["sequence"]), "").alias("sequence"), *extra)
    return g.withColumn("length", F.length("sequence").cast("long"))


def extract_regions(slices: DataFrame, regions: DataFrame, strict: bool = True, length: int | None = None) -> DataFrame:
    """(referenceName, start, end, sequence) per distinct region, put together from the slices it overlaps.

    strict: a region not fully covered by slices fails the query; otherwise it comes out as far as covered.
    length: slices begin at multiples of it, as slice_by_length makes them; they are then joined by their start,
    and only the pieces under regions are shuffled further.
    """
    r = regions.select("referenceName", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).where(F.col("end") > F.col("start")).distinct()
    s = slices.select("name", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("sequence").alias("_bases"))
    lo, hi = F.greatest("_s", "start"), F.least("_e", "end")
    piece = F.struct(lo.alias("at"), F.substring(F.col("_bases"), (lo - F.col("_s") + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))
    keys = ["referenceName", "start", "end"]
    if length:
        step = F.lit(length).cast("long")
        last = s.groupBy("name").agg(F.max("_e").alias("_last"))
        # Open-ended regions end where their sequence does.
        placed = r.join(last, F.col("referenceName") == F.col("name"), "left").drop("name").withColumn("_last", F.least("end", F.coalesce("_last", F.col("start") + 1)))
        first = F.floor(F.col("start") / step) * step
        placed = placed.withColumn("_at", F.explode(F.sequence(first, F.greatest(first, F.col("_last") - 1), step)))
        p = placed.join(s, (F.col("referenceName") == F.col("name")) & (F.col("_at") == F.col("_s")), "left").select(*keys, F.when((F.col("_s") < F.col("end")) & (F.col("_e") > F.col("start")), piece).alias("p"))
        out = p.groupBy(*keys).agg(F.array_sort(F.collect_set("p")).alias("p"))
    else:
        p = region_join(s, r, "inner", lf=Fields("name", "_s", "_e"), rf=Fields()).select(*[F.col(f"right.{c}").alias(c) for c in keys], *[F.col(f"left.{c}").alias(c) for c in ("_s", "_e", "_bases")])
        g = p.select(*keys, piece.alias("p")).groupBy(*keys).agg(F.array_sort(F.collect_set("p")).alias("p"))
        out = r.join(g, keys, "left")
    out = out.withColumn("sequence", F.coalesce(F.array_join(F.transform("p", lambda x: x["piece"]), ""), F.lit(""))).drop("p")
    if strict:
        short = (F.col("end") < OPEN_END) & (F.length("sequence") != F.col("end") - F.col("start"))
        fail = F.raise_error(F.concat(F.lit("not covered by slices: "), "referenceName", F.lit(":"), "start", F.lit("-"), "end")).cast("string")
        out = out.withColumn("sequence", F.when(short, fail).otherwise(F.col("sequence")))
    return out


def extract(slices: DataFrame, reference: str, start: int, end: int) -> DataFrame:
    """One region; only slices that overlap it are read."""
    hit = slices.where((F.col("name") == reference) & (F.col("start") < end) & (F.col("end") > start))
    region = slices.sparkSession.createDataFrame([(reference, start, end)], "referenceName string, start long, end long")
    return extract_regions(hit, region)


def _edges(slices: DataFrame, n: int, head: bool, out: str) -> DataFrame:
    """(name, _at, out): the first or last n bases of the slices by the place where they begin or end; of several there the least."""
    bases = F.left("sequence", F.lit(n)) if head else F.right("sequence", F.lit(n))
    return slices.select(F.col("name").alias("_name"), F.col("start" if head else "end").alias("_at"), bases.alias(out)).groupBy("_name", "_at").agg(F.min(out).alias(out))


def _beside(slices: DataFrame, edges: DataFrame, at: str) -> DataFrame:
    """slices with the edge that abuts them at their start or end. Joined on name and place, so a chromosome is no single key."""
    return slices.join(edges, (F.col("name") == F.col("_name")) & (F.col(at) == F.col("_at")), "left").drop("_name", "_at")


def flank_adjacent(slices: DataFrame, n: int) -> DataFrame:
    """Every slice extended by up to n bases of the slices that abut it. Half-open bounds throughout."""
    out = _beside(_beside(slices, _edges(slices, n, True, "_a"), "end"), _edges(slices, n, False, "_b"), "start")
    out = out.withColumns({"_a": F.coalesce("_a", F.lit("")), "_b": F.coalesce("_b", F.lit(""))})
    return out.withColumns({"sequence": F.concat("_b", "sequence", "_a"), "start": F.col("start") - F.length("_b"), "end": F.col("end") + F.length("_a"), "length": (F.length("sequence") + F.length("_a") + F.length("_b")).cast("long")}).drop("_a", "_b")


def count_kmers(sequences: DataFrame, k: int) -> DataFrame:
    return sequences.select(F.explode(kmers(F.col("sequence"), k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def count_slice_kmers(slices: DataFrame, k: int) -> DataFrame:
    """k-mers over slice borders counted once: every slice also sees the first k - 1 bases of the next
    one it abuts. Windows of exactly k, so a stretch shorter than k gives none. k-mers inside slices are taken where the
    slices lie; only the last and first k - 1 bases of slices are joined for those over borders."""
    texts = slices.select(F.col("sequence").alias("s"))
    if k > 1:
        # Rows of one text stay rows, so the ends aren't made distinct.
        tails = slices.select("name", "end", F.right("sequence", F.lit(k - 1)).alias("_t"))
        texts = texts.unionAll(_beside(tails, _edges(slices, k - 1, True, "_a"), "end").where("_a is not null").select(F.concat("_t", "_a")))
    return texts.where(F.length("s") >= k).select(F.explode(kmers(F.col("s"), k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def create_references(df: DataFrame) -> list[tuple[str, int]]:
    """(name, length) of the dictionary that sequences or slices imply, by name. One row per sequence."""
    n = F.coalesce("totalLength", "length") if "totalLength" in df.columns else F.col("length")
    return [(r[0], r[1]) for r in df.groupBy("name").agg(F.max(n)).orderBy("name").toLocalIterator()]


def to_reads(sequences: DataFrame) -> DataFrame:
    """Sequences as reads without known qualities."""
    return sequences.select(*_base(sequences), "sequence", "length", F.repeat(F.lit("B"), F.length("sequence")).alias("qualityScores"))


def to_slices(sequences: DataFrame) -> DataFrame:
    """Every sequence as one slice."""
    n = F.length("sequence").cast("long")
    return sequences.select(*_base(sequences), "sequence", F.lit(0).cast("long").alias("start"), n.alias("end"), n.alias("length"), n.alias("totalLength"), F.lit(0).alias("index"), F.lit(1).alias("slices"), F.lit("INDEPENDENT").alias("strand"))


def to_sequences(slices: DataFrame) -> DataFrame:
    """Every slice as a sequence of its own."""
    return slices.select(*_base(slices), "sequence", "length")


def to_alignments(reads: DataFrame) -> DataFrame:
    """Reads as unmapped alignments."""
    no = F.lit(False)
    return reads.select(F.col("name").alias("readName"), "sequence", "qualityScores", no.alias("readMapped"), no.alias("readPaired"), F.lit(0).alias("readInFragment"), *([F.col("sampleId").alias("readGroupSampleId")] if "sampleId" in reads.columns else []))
