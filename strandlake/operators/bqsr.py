"""Base quality recalibration: observe covariates, estimate errors, rewrite qualities.

Observation runs in Arrow batches whose bases are laid end to end and reduced to counts per covariate
key before they leave the batch, so what is shuffled is small whatever the number of bases. The table is
sent to the executors as sorted arrays of keys and qualities, in parts of at most TABLE_ROWS keys.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.mdtag import parse_cigar, parse_md
from strandlake.operators.joins import Fields, pairs
from strandlake.plans.runtime import cut_lineage

KEY = ["read_group", "quality", "cycle", "dinuc"]
#: Table rows that are sent at once, 9 bytes each.
TABLE_ROWS = 4_000_000
#: Fixed value: the greatest quality that recalibration gives.
MAX_QUALITY = 50
#: Dinucleotides by their code: 0 at the first base or beside an N, else 1 + 4 * base before + base.
DINUCS = np.array(["NN", *(a + b for a in "ACGT" for b in "ACGT")], dtype=object)
_CODE = np.full(256, 4, "int8")
_CODE[np.frombuffer(b"ACGTacgt", "uint8")] = [0, 1, 2, 3, 0, 1, 2, 3]
_COMPLEMENT = np.array([3, 2, 1, 0, 4], "int8")


def flat_covariates(bases: np.ndarray, lengths: np.ndarray, negative: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cycle, code of the dinucleotide) of every base of reads laid end to end. Cycles count from the start of
    sequencing, below 0 for second reads; a dinucleotide is the base before and the base as sequenced."""
    ends = np.cumsum(lengths)
    read = np.repeat(np.arange(len(lengths)), lengths)
    at, neg, some = np.arange(len(bases)) - (ends - lengths)[read], negative[read], lengths > 0
    cycle = np.where(neg, lengths[read] - at, at + 1)
    code = _CODE[bases]
    left, right = np.append(np.int8(4), code[:-1])[: len(code)], np.append(code[1:], np.int8(4))[: len(code)]
    left[(ends - lengths)[some]], right[(ends - 1)[some]] = 4, 4
    before, own = np.where(neg, _COMPLEMENT[right], left), np.where(neg, _COMPLEMENT[code], code)
    return np.where(second[read], -cycle, cycle), np.where((before == 4) | (own == 4), 0, 1 + 4 * before + own)


def covariates(sequence: str, negative: bool, second: bool) -> tuple[np.ndarray, list[str]]:
    """(cycle, dinucleotide) of every base of one read."""
    cycle, code = flat_covariates(np.frombuffer(sequence.encode(), "uint8"), np.array([len(sequence)]), np.array([negative]), np.array([second]))
    return cycle, list(DINUCS[code])


@functools.lru_cache(maxsize=100_000)
def aligned_bases(cigar: str, md: str | None, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(place in the read, place from the start on the reference, mismatch) of the aligned bases of a read of n bases;
    None if its CIGAR or tag can't be read, if aligned bases have no tag, or if the CIGAR has more bases than the read."""
    try:
        ops, tag = parse_cigar(cigar), parse_md(md, 0, cigar) if md is not None else None
    except ValueError:
        return None
    read, ref, parts = 0, 0, []
    for k, op in ops:
        if op in "M=X":
            if op == "M" and tag is None:
                return None
            places = np.arange(ref, ref + k)
            wrong = np.full(k, op == "X") if op != "M" else np.isin(places, list(tag.mismatches)) if tag.mismatches else np.zeros(k, bool)
            parts.append((np.arange(read, read + k), places, wrong))
        read += k if op in "M=XIS" else 0
        ref += k if op in "M=XDN" else 0
    if read > n:
        return None
    return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, "bool" if i == 2 else "int64") for i in range(3))


class _Flat:
    """The reads of a batch that have as many qualities as bases, laid end to end."""

    def __init__(self, sequences, qualities, groups, negative, second, keep=None):
        ok = [isinstance(s, str) and isinstance(q, str) and len(s) == len(q) and s.isascii() and q.isascii() for s, q in zip(sequences, qualities)]
        self.rows = np.flatnonzero(np.array(ok, bool) if keep is None else np.array(ok, bool) & keep)
        own = [sequences[i] for i in self.rows]
        self.lengths = np.array([len(s) for s in own], "int64")
        self.first = np.cumsum(self.lengths) - self.lengths
        self.bases = np.frombuffer("".join(own).encode(), "uint8")
        self.quality = np.frombuffer("".join(qualities[i] for i in self.rows).encode(), "uint8").astype("int64") - 33
        flag = lambda c: np.array([c[i] is True or c[i] is np.True_ or c[i] == 1 for i in self.rows], bool)
        self.cycle, self.dinuc = flat_covariates(self.bases, self.lengths, flag(negative), flag(second))
        self.group = np.repeat(np.array([groups(i) for i in self.rows], "int64"), self.lengths)

    def key(self, longest: int) -> np.ndarray:
        """Group, quality, cycle and dinucleotide as one number, for cycles of at most `longest` either way."""
        return ((self.group * 256 + self.quality) * (2 * longest + 1) + self.cycle + longest) * len(DINUCS) + self.dinuc


def _counts(batch: pd.DataFrame) -> pd.DataFrame | None:
    """Counts per covariate key of the eligible bases of a batch: aligned, not N, quality above 0, not at a known site."""
    codes, names = pd.factorize(batch["readGroupId"], use_na_sentinel=True)
    held = [aligned_bases(c, md, len(s)) if isinstance(c, str) and isinstance(s, str) else None for c, md, s in zip(batch["cigar"], batch["mismatchingPositions"].where(batch["mismatchingPositions"].notna(), None), batch["sequence"])]
    keep = np.array([h is not None for h in held]) & batch["start"].notna().to_numpy()
    f = _Flat(batch["sequence"].to_list(), batch["qualityScores"].to_list(), lambda i: codes[i] + 1, batch["readNegativeStrand"].to_list(), batch["readInFragment"].to_list(), keep)
    use, wrong, start, masked = [], [], batch["start"].to_numpy(), batch["_masked"].to_list()
    for i, first in zip(f.rows, f.first):
        read, ref, bad = held[i]
        if masked[i] is not None and len(masked[i]):
            free = ~np.isin(ref + int(start[i]), np.asarray(masked[i], "int64"))
            read, bad = read[free], bad[free]
        use.append(read + first)
        wrong.append(bad)
    if not use:
        return None
    use, wrong = np.concatenate(use), np.concatenate(wrong)
    good = (f.bases[use] != ord("N")) & (f.quality[use] > 0)
    use, wrong = use[good], wrong[good]
    if not len(use):
        return None
    _, at, inverse = np.unique(f.key(int(f.lengths.max()))[use], return_index=True, return_inverse=True)
    at = use[at]
    group = np.array([None, *names], dtype=object)[f.group[at]]
    return pd.DataFrame({"read_group": group, "quality": f.quality[at], "cycle": f.cycle[at], "dinuc": DINUCS[f.dinuc[at]], "total": np.bincount(inverse), "mismatches": np.bincount(inverse, wrong).astype("int64")})


def observe(reads: DataFrame, known_sites: DataFrame | None = None, row_id: str | None = None) -> DataFrame:
    """(read_group, quality, cycle, dinuc, total, mismatches) over the eligible reads: mapped, primary, not
    duplicate, mapping quality above 0, with CIGAR, qualities and passed checks.

    known_sites (referenceName, start) mask bases; then row_id names a unique column of reads.
    Reads whose tags can't be read, or with more or fewer qualities than bases, are left out. A null read group is one of its own.
    """
    b = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    ok = b("readMapped", False) & b("primaryAlignment", False) & ~b("duplicateRead", False) & ~b("failedVendorQualityChecks", False) & (F.col("mappingQuality") > 0) & F.col("qualityScores").isNotNull() & (F.col("cigar") != "*")
    own = reads.where(ok)
    if known_sites is not None:
        sites = known_sites.select("referenceName", F.col("start").cast("long").alias("start"), (F.col("start") + 1).cast("long").alias("end")).distinct()
        hit = pairs(own.select(F.col(row_id).alias("_id"), "referenceName", "start", "end"), sites, Fields(), Fields(), left_id="_id")
        mask = hit.groupBy(F.col("left_id").alias("_id")).agg(F.collect_set(F.col("right.start")).alias("_masked"))
        own = own.join(mask, own[row_id] == mask["_id"], "left").drop("_id")
    else:
        own = own.withColumn("_masked", F.lit(None).cast("array<bigint>"))
    cols = ["readGroupId", "sequence", "qualityScores", "cigar", "mismatchingPositions", "start", "readNegativeStrand", "readInFragment", "_masked"]

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if (out := _counts(batch.reset_index(drop=True))) is not None:
                yield out

    out = own.select(*cols).mapInPandas(kernel, "read_group string, quality int, cycle int, dinuc string, total long, mismatches long")
    return out.groupBy(*KEY).agg(F.sum("total").alias("total"), F.sum("mismatches").alias("mismatches"))


def recalibration_table(observed: DataFrame) -> DataFrame:
    """observed with empirical error rates and recalibrated quality per key.

    log p = log p(group, quality) + the departures from it of (group, quality, cycle) and of (group,
    quality, dinucleotide), each estimated as (1 + mismatches) / (2 + total); bounded to [1 / 10^5, 1].
    """

    def rate(*keys: str):
        w = Window.partitionBy(*keys)
        return (1 + F.sum("mismatches").over(w)) / (2 + F.sum("total").over(w))

    q, c, d = F.log(rate("read_group", "quality")), F.log(rate("read_group", "quality", "cycle")), F.log(rate("read_group", "quality", "dinuc"))
    out = observed.withColumn("log_error", c + d - q).withColumn("empirical_error", (1 + F.col("mismatches")) / (2 + F.col("total")))
    bounded = F.least(F.lit(0.0), F.greatest(F.log(F.lit(10.0 ** (-MAX_QUALITY / 10))), F.col("log_error")))
    return out.withColumn("new_quality", F.floor(-10 * bounded / F.log(F.lit(10.0)) + 0.5).cast("int"))


class Table:
    """New qualities by key: sorted numbers of (group, quality, cycle, dinucleotide) and a byte each."""

    def __init__(self, rows: pd.DataFrame):
        names = rows["read_group"].where(rows["read_group"].notna(), None)
        self.groups = {g: i for i, g in enumerate(dict.fromkeys(names))}
        self.longest = int(rows["cycle"].abs().max()) if len(rows) else 0
        code = {d: i for i, d in enumerate(DINUCS)}
        group, dinuc = names.map(self.groups).to_numpy("int64"), rows["dinuc"].map(code).to_numpy("int64")
        key = ((group * 256 + rows["quality"].to_numpy("int64")) * (2 * self.longest + 1) + rows["cycle"].to_numpy("int64") + self.longest) * len(DINUCS) + dinuc
        order = np.argsort(key)
        self.keys, self.new = key[order], rows["new_quality"].to_numpy("int64")[order].astype("uint8")

    def rewrite(self, groups: pd.Series, sequences: pd.Series, qualities: pd.Series, negative: pd.Series, second: pd.Series, least: int) -> list[str | None]:
        """Qualities of a batch of reads; those with more or fewer qualities than bases keep theirs."""
        out = [q if isinstance(q, str) else None for q in qualities]
        if not len(self.keys):
            return out
        names = groups.where(groups.notna(), None).to_list()
        f = _Flat(sequences.to_list(), qualities.to_list(), lambda i: self.groups.get(names[i], -1), negative.to_list(), second.to_list())
        key = f.key(self.longest)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (f.group >= 0) & (np.abs(f.cycle) <= self.longest) & (f.quality >= least)
        new = (np.where(hit, self.new[at], f.quality) + 33).astype("uint8").tobytes().decode("ascii")
        for i, a, n in zip(f.rows, f.first, f.lengths):
            out[i] = new[a : a + n]
        return out


def _rewriter(sent, least_quality: int):
    """Column function of (read group, bases, qualities, strand, number in the fragment) to new qualities."""

    def kernel(g: pd.Series, s: pd.Series, q: pd.Series, neg: pd.Series, part: pd.Series) -> pd.Series:
        return pd.Series(sent.value.rewrite(g, s, q, neg, part, least_quality), dtype=object)

    return F.pandas_udf(kernel, "string")


def recalibrate(reads: DataFrame, known_sites: DataFrame | None = None, row_id: str | None = None, least_quality: int = 5, sample: float | None = None, seed: int = 0) -> DataFrame:
    """reads with recalibrated qualityScores, the old ones in originalQualityScores. Bases below
    least_quality and keys never observed keep theirs. sample: share of reads to observe.

    The table is made of counts, so its size is that of the covariates, not of the reads. Above TABLE_ROWS it
    is sent by read groups, and the reads of each part are looked up in a pass of their own.
    """
    seen = reads if sample is None else reads.sample(False, sample, seed)
    table = cut_lineage(recalibration_table(observe(seen, known_sites, row_id)).select(*KEY, "new_quality"))
    parts = max(1, -(-table.count() // TABLE_ROWS))
    part_of = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c), F.lit(""))), F.lit(parts))
    out = None
    for k in range(parts):
        rows = table if parts == 1 else table.where(part_of("read_group") == k)
        sent = reads.sparkSession.sparkContext.broadcast(Table(rows.toPandas()))

        own = reads if parts == 1 else reads.where(part_of("readGroupId") == k)
        new = _rewriter(sent, least_quality)("readGroupId", "sequence", "qualityScores", "readNegativeStrand", "readInFragment")
        one = own.withColumn("originalQualityScores", F.col("qualityScores")).withColumn("qualityScores", new)
        out = one if out is None else out.unionByName(one)
    return out
