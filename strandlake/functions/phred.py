"""Phred mathematics and quality strings as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Phred value of a log probability of 0, and from where small errors are computed by log1p.
PHRED_OF_CERTAIN = 3233
LOG1P_FROM = 156


def phred_to_error(p: Column) -> Column:
    return F.pow(F.lit(10.0), -F.least(F.greatest(p, F.lit(0)), F.lit(255)) / 10.0)


def phred_to_success(p: Column) -> Column:
    return 1.0 - phred_to_error(p)


def phred_to_log_probability(p: Column) -> Column:
    """Natural log of the success probability; single precision below LOG1P_FROM, as stored by callers."""
    # log(0) is -infinity in the reference arithmetic, null in SQL.
    small = F.when(p <= 0, F.lit(float("-inf"))).otherwise(F.log(phred_to_success(p))).cast("float").cast("double")
    return F.when(p < LOG1P_FROM, small).otherwise(F.log1p(-F.exp(-p * math.log(10.0) / 10.0)))


def _round(x: Column) -> Column:
    """Half up, also for negative numbers."""
    return F.floor(x + 0.5).cast("int")


def error_to_phred(p: Column) -> Column:
    return F.when(p > 0, _round(-10.0 * F.log10(p)))


def success_to_phred(p: Column) -> Column:
    return error_to_phred(1.0 - p)


def log_probability_to_phred(p: Column) -> Column:
    return F.when(p == 0.0, F.lit(PHRED_OF_CERTAIN)).otherwise(_round(-10.0 * F.log10(1.0 - F.exp(p))))


def qualities(q: Column) -> Column:
    """A Phred+33 string as an array of ints; null stays null, empty gives an empty array."""
    return F.transform(F.filter(F.split(q, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def quality_sum(q: Column, at_least: int = 15) -> Column:
    """Sum of the Phred values of at least `at_least`; 0 for null."""
    # Removing all characters below the limit first keeps the array short.
    return F.coalesce(F.aggregate(qualities(q), F.lit(0).cast("long"), lambda s, x: s + F.when(x >= at_least, x).otherwise(0)), F.lit(0).cast("long"))


def parse_bins(text: str) -> list[tuple[int, int, int]]:
    """"0,20,10;20,40,30" as (low, high, value): qualities in [low, high) become value."""
    bins = [tuple(int(x) for x in part.split(",")) for part in text.split(";") if part.strip()]
    for b in bins:
        if len(b) != 3 or not b[0] <= b[2] < b[1]:
            raise ValueError(f"no quality bin: {b}")
    if any(a[0] < b[1] and b[0] < a[1] for i, a in enumerate(bins) for b in bins[:i]):
        raise ValueError("quality bins overlap")
    return bins


def bin_qualities(q: Column, bins: list[tuple[int, int, int]] | str) -> Column:
    """Every quality replaced by the value of its bin; null stays null, a quality in no bin is an error."""
    bins = parse_bins(bins) if isinstance(bins, str) else bins
    known = {33 + x: 33 + v for low, high, v in bins for x in range(low, high)}
    source, target = "".join(map(chr, sorted(known))), "".join(chr(known[k]) for k in sorted(known))
    stray = F.translate(q, source, "") != ""
    return F.when(stray, F.raise_error(F.concat(F.lit("quality in no bin: "), q)).cast("string")).otherwise(F.translate(q, source, target))
