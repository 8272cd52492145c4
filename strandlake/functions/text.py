"""Sequence alphabets, read names and optional tags as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nucleotide codes and their complements.
DNA, DNA_COMPLEMENT = "ATGC", "TACG"
IUPAC, IUPAC_COMPLEMENT = "ATGCRYSWKMBDHVN", "TACGYRSWMKVHDBN"


def reverse_complement(s: Column, iupac: bool = False, exact: bool = False) -> Column:
    """Upper-case reverse complement. Unknown characters are kept, or an error if exact."""
    a, b = (IUPAC, IUPAC_COMPLEMENT) if iupac else (DNA, DNA_COMPLEMENT)
    known = F.reverse(F.translate(s, a + a.lower(), b + b))
    if not exact:
        return known
    return F.when(F.translate(F.upper(s), a, "") != "", F.raise_error(F.concat(F.lit("not of the alphabet: "), s)).cast("string")).otherwise(known)


def strip_pair_suffix(name: Column) -> Column:
    """A read name without /1, /2, _1, +2 or a blank and the mate's description."""
    return F.regexp_replace(name, r"[/ +_][12](:.*)?$", "")


def pair_number(name: Column) -> Column:
    """0 or 1 from the suffix of a read name, null without one."""
    return F.nullif(F.regexp_extract(name, r"[/ +_]([12])(?::.*)?$", 1), F.lit("")).cast("int") - 1


def parse_tags(tags: Column) -> Column:
    """"NM:i:1<tab>MD:Z:50" as map<tag, struct<type, value>>; of a repeated tag the first holds. Malformed tags are left out."""
    parts = F.filter(F.split(tags, "\t"), lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]:[AifZHB]:"))
    first = F.filter(parts, lambda t, i: F.array_position(F.transform(parts, lambda u: F.substring(u, 1, 2)), F.substring(t, 1, 2)) == i + 1)
    return F.map_from_entries(F.transform(first, lambda t: F.struct(F.substring(t, 1, 2).alias("tag"), F.struct(F.substring(t, 4, 1).alias("type"), F.regexp_replace(t, "^.....", "").alias("value")))))


def tag_value(tags: Column, tag: str) -> Column:
    """The value of one tag as text, null if it isn't there."""
    return F.nullif(F.regexp_extract(tags, rf"(?:^|\t){tag}:[AifZHB]:([^\t]*)", 1), F.lit(""))


def kmers(s: Column, k: int) -> Column:
    """All windows of k characters; a shorter text is one window of itself, an empty one none. One walk over the text
    whatever its length: a window is what can be seen ahead, from every place but the second half of a surrogate pair."""
    ahead = F.regexp_extract_all(s, F.lit(rf"(?s)(?![\uDC00-\uDFFF])(?=(.{{{k}}}))"), F.lit(1))
    n = F.length(s)
    return F.when(n > k, ahead).when(n > 0, F.array(s)).otherwise(F.array().cast("array<string>"))
