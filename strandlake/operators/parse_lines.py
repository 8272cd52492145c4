"""Rows that fail to parse: all columns as nullable text, rules as error arrays, rows split by empty arrays.

Every rule is a boolean Column; the reasons whose rules fire make the array `errors`, in the order of
the rules. A row is valid if the array is empty. The whole operator is one narrow projection: no
shuffle, no Python. Cheap tests come first and settle nearly all values; patterns are applied to what
they leave. Lines of any length are judged (patterns that repeat a group see short texts only).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """`broken` is true for rows that break the rule; null counts as not broken."""

    reason: str
    broken: Column


def with_errors(df: DataFrame, rules: list[Rule], out: str = "errors") -> DataFrame:
    """df with the array of the reasons of all rules a row breaks, in the order given, each once."""
    by: dict[str, Column] = {}
    for r in rules:
        broken = F.coalesce(r.broken, F.lit(False))
        by[r.reason] = by[r.reason] | broken if r.reason in by else broken
    return df.withColumn(out, F.array_compact(F.array(*[F.when(b, F.lit(reason)) for reason, b in by.items()])))


#: The columns of a GTF line, the signs that count as quotes, and blanks.
GTF_COLUMNS = ("seqname", "source", "feature_type", "start", "end", "score", "strand", "frame", "attributes")
QUOTES = "\"'`´“”„‟‘’‚‛«»‹›＂＇"
BLANKS = " \t\n\x0b\f\r"
#: Characters up to which column 9 is matched by one pattern; it recurses by item, so longer texts are cut into items first.
SHORT = 2000

_KEY = f"[^\\s;{QUOTES}]++"
_ITEM = f'^\\s*+({_KEY}\\s++(""|{_KEY})\\s*+)?$'
_LIST = f'^\\s*+({_KEY}\\s++("[^"]*+"|{_KEY})\\s*+)?(;\\s*+({_KEY}\\s++("[^"]*+"|{_KEY})\\s*+)?)*+$'
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _digits(c: Column) -> Column:
    """Plain digits without leading zeros, else null. Compared as (length, text): no overflow."""
    return F.when(c.rlike("^[0-9]+$"), F.regexp_replace(c, "^0+", ""))


def _ordered(start: Column, end: Column) -> Column:
    """Whether both are plain digits with 1 <= start <= end."""
    a, b = start.try_cast("long"), end.try_cast("long")
    # A number that reads the same written out again is plain digits without leading zeros.
    plain = (a.cast("string") == start) & (b.cast("string") == end)
    s, e = _digits(start), _digits(end)
    longer = (s != "") & (e != "") & ((F.length(s) < F.length(e)) | ((F.length(s) == F.length(e)) & (s <= e)))
    return F.when(F.coalesce(plain, F.lit(False)), (a >= 1) & (a <= b)).otherwise(F.coalesce(longer, F.lit(False)))


def attributes_ok(c: Column) -> Column:
    """Whether column 9 is a list of empty items or key, blanks and a quoted text or bare word.

    In long texts quoted parts are first reduced to "" so that semicolons inside them are gone; then
    every item between semicolons is matched on its own.
    """
    items = F.forall(F.split(F.regexp_replace(c, '"[^"]*+"', '""'), ";"), lambda x: x.rlike(_ITEM))
    return F.when(F.octet_length(c) <= SHORT, c.rlike(_LIST)).otherwise(items)


def _named(c: Column) -> Column:
    blank = F.lit(False)
    for x in BLANKS:
        blank = blank | c.contains(x)
    return ~((c == "") | (c == ".") | blank)


def split_gtf(df: DataFrame, raw: str = "raw_line") -> DataFrame:
    """GTF lines as nullable text columns with their error array: valid and rejected rows in one pass.

    Adds the columns of GTF_COLUMNS (prefixed gtf_), `kind` (record, comment, blank) and
    `errors` (of column_count, quoting, invalid_value; empty for valid records and for lines
    that are none). Defined cases: a null line is blank; one carriage return at the end is not
    part of the line; repeated lines are judged each; extra columns are kept, and columns of
    these names that df already has are replaced. A line without column 9 has no attributes to judge.
    """
    own = [f"gtf_{c}" for c in GTF_COLUMNS]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (*own, "kind", "errors")]
    text = F.coalesce(F.col(f"`{raw}`"), F.lit(""))
    line = F.when(F.endswith(text, F.lit("\r")), F.left(text, F.length(text) - 1)).otherwise(text)
    kind = F.when(F.btrim("_line", F.lit(BLANKS)) == "", "blank").when(F.col("_line").startswith("#"), "comment").otherwise("record")
    # Each step goes through a row of one struct, so that no later filter computes it anew for every use.
    lines = df.select(*kept, F.inline(F.array(F.struct(line.alias("_line")))))
    cut = lines.select(*kept, F.inline(F.array(F.struct(kind.alias("kind"), F.split("_line", "\t", -1).alias("_parts")))))
    part = lambda i: F.when(F.size("_parts") > i, F.col("_parts")[i]).alias(own[i])
    out = cut.select(*kept, "kind", F.inline(F.array(F.struct(F.size("_parts").alias("_n"), *[part(i) for i in range(len(own))]))))
    g = {c: F.col(f"gtf_{c}") for c in GTF_COLUMNS}
    counted, record = F.col("_n").isin(8, 9), F.col("kind") == "record"
    bad_value = (
        ~_named(g["seqname"]) | ~_named(g["feature_type"]) | ~g["strand"].isin("+", "-", ".") | ~g["frame"].isin(".", "0", "1", "2") | ~_ordered(g["start"], g["end"])
        | ((g["score"] != ".") & ~g["score"].rlike(_NUMBER))
    )
    rules = [Rule("column_count", record & ~counted), Rule("quoting", record & counted & g["attributes"].isNotNull() & ~attributes_ok(g["attributes"])), Rule("invalid_value", record & counted & bad_value)]
    return with_errors(out, rules).drop("_n")


def rejected(df: DataFrame, raw: str = "raw_line") -> DataFrame:
    """The records that are not valid, with `reason` (the first that applies) and all `errors`."""
    return split_gtf(df, raw).where(F.size("errors") > 0).withColumn("reason", F.col("errors")[0])


def features(df: DataFrame, raw: str = "raw_line") -> DataFrame:
    """The valid records, cast: start_pos 0-based, half-open; score null for '.'; attributes as a
    map in which of a repeated key the last value holds. start_text and end_text are the digits as they
    stand: positions beyond 2^63 - 1, which are valid, are null as numbers."""
    v = split_gtf(df, raw).where((F.col("kind") == "record") & (F.size("errors") == 0))
    at = F.coalesce(F.col("gtf_attributes"), F.lit(""))
    pair = '([^\\s;"]+)\\s+(?:"([^"]*)"|([^\\s;"]+))'
    keys, quoted, bare = (F.regexp_extract_all(at, F.lit(pair), F.lit(i)) for i in (1, 2, 3))
    v = v.withColumn("_e", F.arrays_zip(keys.alias("k"), quoted.alias("q"), bare.alias("b")))
    v = v.withColumn("_e", F.transform("_e", lambda x: F.struct(x["k"].alias("key"), F.concat(x["q"], x["b"]).alias("value"))))
    last = F.filter("_e", lambda x, i: F.array_position(F.transform(F.slice(F.col("_e"), i + 2, F.greatest(F.size("_e"), F.lit(1))), lambda y: y["key"]), x["key"]) == 0)
    v = v.withColumn("_attributes", F.map_from_entries(last))
    made = ("seqname", "source", "feature_type", "start_pos", "end_pos", "score", "strand", "frame", "attributes", "start_text", "end_text")
    return v.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in made and c != raw and not c.startswith("gtf_") and c not in ("kind", "errors")],
        F.col("gtf_seqname").alias("seqname"), F.nullif(F.col("gtf_source"), F.lit(".")).alias("source"), F.col("gtf_feature_type").alias("feature_type"),
        (F.col("gtf_start").try_cast("long") - 1).alias("start_pos"), F.col("gtf_end").try_cast("long").alias("end_pos"), F.when(F.col("gtf_score") != ".", F.col("gtf_score").try_cast("double")).alias("score"),
        F.col("gtf_strand").alias("strand"), F.nullif(F.col("gtf_frame"), F.lit(".")).alias("frame"), F.col("_attributes").alias("attributes"), F.col("gtf_start").alias("start_text"), F.col("gtf_end").alias("end_text"),
    )
