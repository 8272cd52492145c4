"""GenomicFrame: a DataFrame of records with the metadata of where they come from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.intervals import Region, in_regions, region_order
from strandlake.operators import joins
from strandlake.sources import parquet


@dataclass(frozen=True)
class Meta:
    """References in dictionary order, samples, read groups, processing steps and header lines; driver-side and small."""

    references: tuple[tuple[str, int], ...] = ()
    samples: tuple[str, ...] = ()
    read_groups: tuple[tuple[tuple[str, str], ...], ...] = ()
    steps: tuple[str, ...] = ()
    header_lines: tuple[str, ...] = ()

    def union(self, other: Meta) -> Meta:
        """Both, each entry once. One reference with two lengths is an error."""
        lengths = dict(self.references)
        for n, k in other.references:
            if lengths.setdefault(n, k) != k:
                raise ValueError(f"{n} has lengths {lengths[n]} and {k}")
        both = lambda a, b: tuple(dict.fromkeys([*a, *b]))
        return Meta(tuple(lengths.items()), both(self.samples, other.samples), both(self.read_groups, other.read_groups), both(self.steps, other.steps), both(self.header_lines, other.header_lines))

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Meta:
        tup = lambda x: tuple(tup(i) for i in x) if isinstance(x, list | tuple) else x
        return cls(**{k: tup(v) for k, v in d.items() if k in cls.__dataclass_fields__})


@dataclass(frozen=True)
class GenomicFrame:
    """Records of one kind. Methods give new frames; metadata goes along."""

    df: DataFrame
    meta: Meta = field(default_factory=Meta)
    fields: joins.Fields = joins.Fields()

    # Transformations

    def transform(self, f: Callable[[DataFrame], DataFrame]) -> GenomicFrame:
        return replace(self, df=f(self.df))

    def transmute(self, f: Callable[[DataFrame], DataFrame], fields: joins.Fields | None = None) -> GenomicFrame:
        """To records of another kind."""
        return replace(self, df=f(self.df), fields=fields or joins.Fields())

    def union(self, *others: GenomicFrame) -> GenomicFrame:
        """All rows, repeated ones too; columns by name."""
        out, meta = self.df, self.meta
        for o in others:
            out, meta = out.unionByName(o.df), meta.union(o.meta)
        return replace(self, df=out, meta=meta)

    def select(self, *include: str) -> GenomicFrame:
        return self.transform(lambda d: d.select(*include))

    def drop(self, *exclude: str) -> GenomicFrame:
        return self.transform(lambda d: d.drop(*exclude))

    def project(self, keep: Callable[[str], bool]) -> GenomicFrame:
        return self.transform(lambda d: d.select(*[c for c in d.columns if keep(c)]))

    def cache(self) -> GenomicFrame:
        return self.transform(DataFrame.cache)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> GenomicFrame:
        return self.transform(lambda d: d.persist(level))

    def unpersist(self) -> GenomicFrame:
        return self.transform(DataFrame.unpersist)

    # Metadata

    def with_meta(self, **changes) -> GenomicFrame:
        """References, samples, read_groups, steps or header_lines replaced."""
        return replace(self, meta=replace(self.meta, **{k: tuple(v) for k, v in changes.items()}))

    def add_meta(self, **more) -> GenomicFrame:
        return replace(self, meta=self.meta.union(Meta(**{k: tuple(v) for k, v in more.items()})))

    # Regions

    def region(self) -> Region:
        f = self.fields
        return Region(F.col(f.reference), F.col(f.start), F.col(f.end), F.col(f.strand) if f.strand else None)

    def filter_by_overlapping_region(self, reference: str, start: int, end: int) -> GenomicFrame:
        return self.filter_by_overlapping_regions([(reference, start, end)])

    def filter_by_overlapping_regions(self, queries: list[tuple[str, int, int]]) -> GenomicFrame:
        """Rows that overlap a region, on either strand. Few regions become comparisons that prune row groups, many a semi join."""
        if len(queries) <= 200:
            if f := self.fields.many:
                one = lambda r: in_regions(Region(r[self.fields.reference], r[self.fields.start], r[self.fields.end]), queries)
                return self.transform(lambda d: d.where(F.exists(f, one)))
            return self.transform(lambda d: d.where(in_regions(self.region(), queries)))
        q = self.df.sparkSession.createDataFrame(queries, "referenceName string, start long, end long")
        return self.transform(lambda d: joins.region_join(d, q, "left_semi", lf=replace(self.fields, strand=None)))

    def sort(self, stringency: str = "strict") -> GenomicFrame:
        """By the order of the dictionary, then start. Rows without a place in it: an error (strict), or left out."""
        f = self.fields

        def ordered(d: DataFrame) -> DataFrame:
            # The dictionary is joined, so a row costs the same whatever the number of references.
            refs = d.sparkSession.createDataFrame([(n, i) for i, (n, _) in enumerate(self.meta.references)], "_name string, _at int")
            j = d.join(F.broadcast(refs), F.col(f.reference) == F.col("_name"), "left" if stringency == "strict" else "inner")
            at = F.col("_at")
            if stringency == "strict":
                bad = F.raise_error(F.concat(F.lit("not in the dictionary: "), F.coalesce(F.col(f.reference), F.lit("null")))).cast("int")
                at = F.when(at.isNull(), bad).otherwise(at)
            return j.orderBy(at, f.start).select(*[F.col(f"`{c}`") for c in d.columns])

        return self.transform(ordered)

    def sort_lexicographically(self) -> GenomicFrame:
        """By reference name, start, end and strand; rows without a reference last."""
        return self.transform(lambda d: d.orderBy(*region_order(self.region())))

    def evenly_repartition(self, n: int) -> GenomicFrame:
        """n ranges of the region order of about equal size."""
        f = self.fields
        return self.transform(lambda d: d.repartitionByRange(n, f.reference, f.start, f.end).sortWithinPartitions(f.reference, f.start, f.end))

    # Joins. The left side is self; `flank` pads it.

    def _join(self, other: GenomicFrame, how: str, group: str | None, broadcast: str | None, flank: int, **kw) -> DataFrame:
        return joins.region_join(self.df, other.df, how, group, self.fields, other.fields, flank, broadcast=broadcast, **kw)

    def broadcast_region_join(self, o, flank=0, **kw):
        return self._join(o, "inner", None, "left", flank, **kw)

    def right_outer_broadcast_region_join(self, o, flank=0, **kw):
        return self._join(o, "right", None, "left", flank, **kw)

    def broadcast_region_join_and_group_by_right(self, o, flank=0, **kw):
        return self._join(o, "inner", "right", "left", flank, **kw)

    def right_outer_broadcast_region_join_and_group_by_right(self, o, flank=0, **kw):
        return self._join(o, "right", "right", "left", flank, **kw)

    def shuffle_region_join(self, o, flank=0, **kw):
        return self._join(o, "inner", None, None, flank, **kw)

    def left_outer_shuffle_region_join(self, o, flank=0, **kw):
        return self._join(o, "left", None, None, flank, **kw)

    def right_outer_shuffle_region_join(self, o, flank=0, **kw):
        return self._join(o, "right", None, None, flank, **kw)

    def full_outer_shuffle_region_join(self, o, flank=0, **kw):
        return self._join(o, "full", None, None, flank, **kw)

    def shuffle_region_join_and_group_by_left(self, o, flank=0, **kw):
        return self._join(o, "inner", "left", None, flank, **kw)

    def left_outer_shuffle_region_join_and_group_by_left(self, o, flank=0, **kw):
        return self._join(o, "left", "left", None, flank, **kw)

    def right_outer_shuffle_region_join_and_group_by_left(self, o, flank=0, **kw):
        return self._join(o, "right", "left", None, flank, **kw)

    def prepare(self, flank: int = 0) -> joins.Prepared:
        """This side made ready once for broadcast joins with many right sides."""
        return joins.prepare(self.df, self.fields, flank)

    def _against(self, prepared: joins.Prepared, how: str, group: str | None, **kw) -> DataFrame:
        return joins.region_join(prepared, self.df, how, group, rf=self.fields, **kw)

    def broadcast_region_join_against(self, prepared, **kw):
        return self._against(prepared, "inner", None, **kw)

    def right_outer_broadcast_region_join_against(self, prepared, **kw):
        return self._against(prepared, "right", None, **kw)

    def broadcast_region_join_and_group_by_right_against(self, prepared, **kw):
        return self._against(prepared, "inner", "right", **kw)

    def right_outer_broadcast_region_join_and_group_by_right_against(self, prepared, **kw):
        return self._against(prepared, "right", "right", **kw)

    # Storage

    def save_as_parquet(self, path: str, **kw) -> None:
        parquet.save(self.df, path, self.meta.to_dict(), **kw)

    def save_as_partitioned_parquet(self, path: str, bin_size: int = parquet.BIN, **kw) -> None:
        parquet.save_partitioned(self.df, path, self.meta.to_dict(), bin_size, **kw)
