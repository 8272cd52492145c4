"""Region algebra as Column expressions. Regions are half-open, 0-based: [start, end) on a named reference.

A Region is a bundle of four columns, never a type of its own, so predicates reach the scan.
Strand is '+', '-' or null (independent). Null inputs give null results unless said otherwise.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN_END = 2**63 - 1


@dataclass(frozen=True)
class Region:
    reference: Column
    start: Column
    end: Column
    strand: Column | None = None

    @classmethod
    def of(cls, prefix: str = "", reference: str = "referenceName", start: str = "start", end: str = "end", strand: str | None = None) -> Region:
        c = lambda n: F.col(f"{prefix}{n}")
        return cls(c(reference), c(start), c(end), c(strand) if strand else None)

    @classmethod
    def literal(cls, reference: str, start: int = 0, end: int = OPEN_END, strand: str | None = None) -> Region:
        if start < 0 or end < start:
            raise ValueError(f"no region: {reference}:{start}-{end}")
        return cls(F.lit(reference), F.lit(start).cast("long"), F.lit(end).cast("long"), F.lit(strand).cast("string") if strand else None)


def parse_regions(text: str) -> list[tuple[str, int, int]]:
    """"chr1:10-20,chr2:5+,chr3:7,chr4": start is 0-based, n+ runs to the end, a single position is one base."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"(.+?)(?::(\d+)(?:-(\d+)|(\+))?)?", part)
        name, a, b, plus = m.groups()
        start = int(a or 0)
        end = int(b) if b else OPEN_END if plus or a is None else start + 1
        if end < start:
            raise ValueError(f"no region: {part}")
        out.append((name, start, end))
    return out


def same_reference(a: Region, b: Region) -> Column:
    return a.reference == b.reference


def same_strand(a: Region, b: Region) -> Column:
    """Equal strands; independent equals independent only."""
    none = F.lit(None).cast("string")
    return (a.strand if a.strand is not None else none).eqNullSafe(b.strand if b.strand is not None else none)


def covers(a: Region, b: Region, within: int = 0) -> Column:
    """Overlap on either strand; within: or at most that distance apart."""
    near = (a.end > b.start) & (a.start < b.end)
    if within:
        near = unstranded_distance(a, b) <= within
    return same_reference(a, b) & near


def overlaps(a: Region, b: Region, within: int = 0) -> Column:
    return same_strand(a, b) & covers(a, b, within)


def contains(a: Region, b: Region) -> Column:
    return same_strand(a, b) & same_reference(a, b) & (a.start <= b.start) & (a.end >= b.end)


def unstranded_distance(a: Region, b: Region) -> Column:
    """0 if they overlap, 1 if they abut, and so on; null on different references."""
    gap = F.greatest(a.start, b.start) - F.least(a.end, b.end) + 1
    return F.when(same_reference(a, b), F.when((a.end > b.start) & (a.start < b.end), F.lit(0).cast("long")).otherwise(gap))


def distance(a: Region, b: Region) -> Column:
    """As unstranded_distance, null on different strands too."""
    return F.when(same_strand(a, b), unstranded_distance(a, b))


def is_adjacent(a: Region, b: Region) -> Column:
    return F.coalesce(distance(a, b) == 1, F.lit(False))


def is_nearby(a: Region, b: Region, within: int, stranded: bool = True) -> Column:
    return F.coalesce((distance if stranded else unstranded_distance)(a, b) <= within, F.lit(False))


def covers_by(a: Region, b: Region) -> Column:
    """Bases shared, on either strand; null if none."""
    return F.when(covers(a, b), F.least(a.end, b.end) - F.greatest(a.start, b.start))


def overlaps_by(a: Region, b: Region) -> Column:
    return F.when(overlaps(a, b), F.least(a.end, b.end) - F.greatest(a.start, b.start))


def _struct(name: Column, start: Column, end: Column, strand: Column | None) -> Column:
    return F.struct(name.alias("referenceName"), start.alias("start"), end.alias("end"), (strand if strand is not None else F.lit(None).cast("string")).alias("strand"))


def hull(a: Region, b: Region) -> Column:
    """The smallest region holding both; null on different references or strands."""
    return F.when(same_strand(a, b) & same_reference(a, b), _struct(a.reference, F.least(a.start, b.start), F.greatest(a.end, b.end), a.strand))


def merge(a: Region, b: Region, within: int = 1) -> Column:
    """The hull of regions that overlap, abut or are at most `within` apart, else null."""
    return F.when(distance(a, b) <= within, hull(a, b))


def intersection(a: Region, b: Region, min_overlap: int = 0) -> Column:
    """The shared part if the regions overlap by at least min_overlap, else null."""
    ok = overlaps(a, b) & (F.least(a.end, b.end) - F.greatest(a.start, b.start) >= min_overlap)
    return F.when(ok, _struct(a.reference, F.greatest(a.start, b.start), F.least(a.end, b.end), a.strand))


def subtract(a: Region, b: Region, stranded: bool = False) -> Column:
    """The 0 to 2 parts of a outside b, as an array; [a] if they don't overlap."""
    hit = overlaps(a, b) if stranded else covers(a, b)
    left, right = _struct(a.reference, a.start, F.least(a.end, b.start), a.strand), _struct(a.reference, F.greatest(a.start, b.end), a.end, a.strand)
    return F.when(hit, F.filter(F.array(left, right), lambda r: r["start"] < r["end"])).otherwise(F.array(_struct(a.reference, a.start, a.end, a.strand)))


def pad(a: Region, before: int, after: int | None = None) -> Region:
    """Extended to either side; the start stays at 0 or above, the end is free."""
    after = before if after is None else after
    return Region(a.reference, F.greatest(F.lit(0).cast("long"), a.start - before), a.end + after, a.strand)


def length(a: Region) -> Column:
    return a.end - a.start


def disorient(a: Region) -> Region:
    return Region(a.reference, a.start, a.end)


def in_regions(a: Region, queries: list[tuple[str, int, int]]) -> Column:
    """Whether a overlaps any of the queries: plain comparisons, which Parquet row groups are pruned by."""
    cond = F.lit(False)
    for name, s, e in queries:
        one = (a.reference == name) & (a.end > s)
        cond = cond | (one & (a.start < e) if e < OPEN_END else one)
    return cond


def in_bins(bin_column: str, reference: Column, queries: list[tuple[str, int, int]], bin_size: int, lookback: int = 1) -> Column:
    """Bounds on a positionBin partition column that hold for every row overlapping the queries,
    as long as no row is longer than `lookback` bins. Prunes directories."""
    cond = F.lit(False)
    for name, s, e in queries:
        one = (reference == name) & (F.col(bin_column) >= s // bin_size - lookback)
        cond = cond | (one & (F.col(bin_column) <= e // bin_size) if e < OPEN_END else one)
    return cond


def region_order(a: Region) -> list[Column]:
    """Keys of the order of regions: name, start, end, strand (+, -, independent)."""
    strand = a.strand if a.strand is not None else F.lit(None).cast("string")
    return [a.reference.asc_nulls_last(), a.start.asc_nulls_last(), a.end.asc_nulls_last(), F.when(strand == "+", 0).when(strand == "-", 1).otherwise(2)]


def genome_bins(a: Region, references: list[tuple[str, int]], bin_size: int) -> tuple[Column, Column]:
    """(first, last) bin of a region when the bins of all references, by name, are numbered through.
    References are driver-side metadata; null for one that isn't there."""
    offsets, n = {}, 0
    for name, size in sorted(references):
        offsets[name] = n
        n += -(-size // bin_size)
    known = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]) if offsets else F.create_map().cast("map<string,int>")
    base = F.try_element_at(known, a.reference)
    return base + F.floor(a.start / F.lit(bin_size)), base + F.floor(F.greatest(a.start, a.end - 1) / F.lit(bin_size))


def invert_bin(number: int, references: list[tuple[str, int]], bin_size: int) -> tuple[str, int, int]:
    """The region of a bin of genome_bins."""
    for name, size in sorted(references):
        n = -(-size // bin_size)
        if number < n:
            return name, number * bin_size, min(size, (number + 1) * bin_size)
        number -= n
    raise ValueError("no such bin")
