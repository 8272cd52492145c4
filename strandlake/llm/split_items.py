"""Oversized items cut into pieces at natural boundaries, with an overlap between neighbours.

Recursive bisection: a stretch longer than limit minus overlap is cut at the strongest boundary
near its middle, and both halves again; then every piece but the first is extended to the left by
the overlap. Items are independent, so the kernel runs in Arrow batches without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _best(starts: np.ndarray, ends: np.ndarray, lo: int, hi: int, a: int, b: int) -> int | None:
    """The position to cut [lo, hi) at: inside the longest boundary stretch with a part in [a, b], ties to the
    nearest to the middle. None if there is none."""
    mid, a, b = lo + (hi - lo) // 2, max(a, lo + 1), min(b, hi - 1)
    if a > b:
        return None
    # Stretches reaching the ends of [lo, hi) are left over from a cut; they are no boundary again.
    i, j = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
    s, e = starts[i:j], ends[i:j]
    inside = (s > lo) & (e < hi)
    s, e = s[inside], e[inside]
    if not len(s):
        return None
    at = np.clip(mid, np.maximum(s, a), np.minimum(e, b))
    return int(at[np.lexsort((np.abs(at - mid), -(e - s)))[0]])


def cut_points(size: int, limit: int, overlap: int, boundaries: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """Sorted inner cuts of [0, size) such that no stretch is longer than limit - overlap.

    boundaries: (starts, ends) of sorted disjoint stretches, the preferred kind first. Of a kind, stretches
    in the middle half are looked at first, then those that leave at least a quarter of the limit on either
    side; with no stretch of any kind there, the cut is in the middle. So no cut makes a sliver.
    """
    room, cuts, stack = max(1, limit - overlap), [], [(0, size)]
    if size <= limit:
        return []
    while stack:
        lo, hi = stack.pop()
        # The first piece carries no overlap and may fill the limit.
        if hi - lo <= (limit if lo == 0 else room):
            continue
        quarter, least = (hi - lo) // 4, max(1, min(room // 4, (hi - lo) // 4))
        near = (_best(s, e, lo, hi, a, b) for s, e in boundaries for a, b in ((lo + quarter, hi - quarter), (lo + least, hi - least)))
        at = next((c for c in near if c is not None), lo + (hi - lo) // 2)
        cuts.append(at)
        stack += [(lo, at), (at, hi)]
    return sorted(cuts)


def _stretches(starts, sizes, size: int) -> tuple[np.ndarray, np.ndarray]:
    s = np.asarray([] if starts is None else starts, dtype="float64")
    n = np.asarray([] if sizes is None else sizes, dtype="float64")
    k = min(len(s), len(n))
    s, n = s[:k], n[:k]
    good = np.isfinite(s) & np.isfinite(n) & (s >= 0) & (n > 0) & (s + n <= size)
    s, n = s[good].astype("int64"), n[good].astype("int64")
    order = np.argsort(s, kind="stable")
    return s[order], (s + n)[order]


PIECES = "name string, assembly string, piece_no int, pieces int, piece_start long, piece_end long, cut_in_gap boolean"


def split_items(items: DataFrame) -> DataFrame:
    """Pieces (name, assembly, piece_no, pieces, piece_start, piece_end, cut_in_gap) of every item.

    items: name, assembly, size, max_bases, overlap_bases, n_block_starts, n_block_sizes,
    mask_block_starts, mask_block_sizes; other columns are ignored. Boundaries are the N blocks
    (gaps), then the masked stretches, then the middle. Items not above max_bases, with a null
    max_bases or size come out as one piece or, without a positive size, as none. A null or
    negative overlap counts as 0, one of max_bases or more, which no pieces can have, as half of it. Blocks beyond the
    size, null or without length are ignored. cut_in_gap says whether piece_end lies inside an N
    block; it is null for the last piece.
    """

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, held = [], 0
            for r in b.itertuples(index=False):
                if pd.isna(r.size_) or r.size_ <= 0:
                    continue
                size = int(r.size_)
                limit = size if pd.isna(r.max_bases) or r.max_bases < 1 else int(r.max_bases)
                overlap = 0 if pd.isna(r.overlap_bases) else max(0, int(r.overlap_bases))
                overlap = limit // 2 if overlap >= limit else overlap
                gaps = _stretches(r.n_block_starts, r.n_block_sizes, size)
                masks = _stretches(r.mask_block_starts, r.mask_block_sizes, size)
                cuts = cut_points(size, limit, overlap, [gaps, masks])
                bounds = np.array([0, *cuts, size])
                at = np.searchsorted(gaps[0], bounds[1:], "left") - 1
                inside = (at >= 0) & (bounds[1:] < (gaps[1][np.maximum(at, 0)] if len(gaps[1]) else 0) + 1) if len(gaps[1]) else np.zeros(len(bounds) - 1, bool)
                n = len(bounds) - 1
                starts = bounds[:-1].copy()
                starts[1:] = np.maximum(0, starts[1:] - overlap)
                out.append(pd.DataFrame({"name": r.name, "assembly": r.assembly, "piece_no": np.arange(n, dtype="int32"), "pieces": np.int32(n), "piece_start": starts, "piece_end": bounds[1:], "cut_in_gap": [*map(bool, inside[:-1]), None]}))
                held += n
                if held >= 50_000:
                    yield pd.concat(out, ignore_index=True)
                    out, held = [], 0
            if out:
                yield pd.concat(out, ignore_index=True)

    cols = ["name", "assembly", "size", "max_bases", "overlap_bases", "n_block_starts", "n_block_sizes", "mask_block_starts", "mask_block_sizes"]
    return items.select(*cols).withColumnRenamed("size", "size_").mapInPandas(kernel, PIECES)
