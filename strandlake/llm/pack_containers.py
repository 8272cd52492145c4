"""Texts packed into containers of a fixed number of tokens along a space-filling curve.

1. One Arrow pass over the texts: token count, and the text's hashed word vector projected to DIMS
   dimensions. Only these numbers go on.
2. The projections, standardised over all documents and put on a grid by the normal distribution,
   give a Hilbert key of DIMS * BITS bits: a cell of the curve (its upper half) and a place in the cell.
3. The curve is cut into ranges of about `range_tokens` tokens, by the tokens before each place: cells are
   summed over the whole curve, places within their cell. A place above that size (copies of one text share
   it) is cut by the hash of the id, so no range is much larger.
4. Each range is packed on its own, walking along the curve: LOOK pieces at a time, longest first, each
   into the fullest open container it fits. A container is closed when it has fallen REACH pieces behind, so
   what shares one are neighbours on the curve.
"""

from __future__ import annotations

import base64
import functools
import math
import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.plans.runtime import cut_lineage, spread

#: Half of BITS orders cells, at most 2^(DIMS * BITS / 2) = 32,768 of them, the other half places in a cell.
DIMS, BITS = 3, 10
LOOK, REACH = 128, 1024
#: Fixed value: how a byte-level BPE of this family splits a text before merging (pattern of the public GPT-2 tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a .tiktoken file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_WORD = re.compile(r"[^\W\d_]+")


@functools.lru_cache(maxsize=200_000)
def _direction(word: str) -> np.ndarray:
    """DIMS pseudo-random numbers of mean 0 and variance 1, fixed by the word."""
    import xxhash

    h = xxhash.xxh64_intdigest(word)
    # The sum of four uniform bytes, per dimension: near enough to normal, and the same everywhere.
    b = np.frombuffer(h.to_bytes(8, "little") + xxhash.xxh64_intdigest(word, 1).to_bytes(8, "little"), dtype="uint8")[: 4 * DIMS].reshape(DIMS, 4)
    return (b.sum(axis=1) - 510.0) / 147.8


def project(text: str) -> np.ndarray:
    """The hashed vector of the text's distinct words, projected to DIMS dimensions, per square root of their number."""
    w = set(_WORD.findall(text.lower()))
    return sum((_direction(x) for x in sorted(w)), np.zeros(DIMS)) / math.sqrt(len(w)) if w else np.zeros(DIMS)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (n, dims) on a grid of 2^bits a side, by Skilling's transform."""
    x = cells.astype("int64").T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            hit = (x[i] & q) != 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def measure(docs: DataFrame, doc_id: str, text: str, tokenizer: str) -> DataFrame:
    """(doc_id, tokens, x0, x1, ...). A null or empty text has 0 tokens and lies at the origin. The tokenizer's
    file is sent to the executors with the job."""
    schema = "doc_id long, tokens long, " + ", ".join(f"x{i} double" for i in range(DIMS))
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(SparkFiles.get(name))
        for b in batches:
            texts = [t or "" for t in b["t"]]
            n = [len(enc.encode_ordinary(t)) for t in texts]
            x = np.array([project(t) for t in texts]).reshape(len(texts), DIMS)
            yield pd.DataFrame({"doc_id": b["d"], "tokens": n} | {f"x{i}": x[:, i] for i in range(DIMS)})

    return spread(docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))).mapInPandas(kernel, schema)


def curve_key(measured: DataFrame) -> DataFrame:
    """measured with `curve_key`, the Hilbert key. Mean and deviation are those of all documents."""
    dims = [f"x{i}" for i in range(DIMS)]
    s = measured.agg(*[F.coalesce(F.avg(x), F.lit(0.0)).alias(f"m{x}") for x in dims], *[F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias(f"s{x}") for x in dims]).first()
    mean, dev = np.array([s[f"m{x}"] for x in dims]), np.array([s[f"s{x}"] or 1.0 for x in dims])

    def key(*cols: pd.Series) -> pd.Series:
        z = (np.stack([c.to_numpy() for c in cols], axis=1) - mean) / np.where(dev > 0, dev, 1.0)
        # Logistic approximation of the normal distribution function: equal cells for normal data.
        u = 1 / (1 + np.exp(-np.clip(1.702 * z, -50, 50)))
        return pd.Series(hilbert(np.minimum((u * (1 << BITS)).astype("int64"), (1 << BITS) - 1)))

    from pyspark.sql.functions import pandas_udf

    return measured.withColumn("curve_key", pandas_udf(key, "long")(*dims))


def pack(sizes: np.ndarray, capacity: int, look: int = LOOK, reach: int = REACH) -> np.ndarray:
    """Container number of each size (all <= capacity), in the given order `look` at a time,
    longest first, each into the fullest open container that still holds it (ties: the oldest).
    Containers begun more than `reach` pieces ago are closed."""
    out = np.empty(len(sizes), dtype="int64")
    room: list[tuple[int, int]] = []  # (free tokens, container), sorted
    begun: list[int] = []  # by container, the place of the chunk it was begun in
    for a in range(0, len(sizes), look):
        if begun and begun[0] < a - reach:
            room = [x for x in room if begun[x[1]] >= a - reach]
        chunk = np.argsort(-sizes[a : a + look], kind="stable") + a
        for i in chunk:
            s = int(sizes[i])
            k = bisect_left(room, (s, -1))
            if k < len(room):
                free, box = room.pop(k)
            else:
                free, box = capacity, len(begun)
                begun.append(a)
            out[i] = box
            if free > s:
                insort(room, (free - s, box))
    return out


PLACED = "doc_id long, piece_no int, token_start long, tokens long, curve_range long, curve_key long, container long"


def curve_ranges(m: DataFrame, range_tokens: int) -> DataFrame:
    """m (doc_id, tokens, curve_key) with curve_range: the curve cut into stretches of about range_tokens tokens."""
    half = DIMS * BITS // 2
    places = m.groupBy("curve_key").agg((F.sum("tokens") + F.count("*")).alias("weight")).withColumn("cell", F.shiftright("curve_key", half))
    # At most 2^half cells on the curve, and at most 2^half places in a cell: what a window holds is bounded by the grid.
    cells = places.groupBy("cell").agg(F.sum("weight").alias("all"))
    before = lambda w, of: F.coalesce(F.sum(of).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("cell", before(Window.orderBy("cell"), "all").alias("to_cell"))
    places = places.withColumn("in_cell", before(Window.partitionBy("cell").orderBy("curve_key"), "weight")).join(F.broadcast(cells), "cell")
    places = places.select("curve_key", (F.col("to_cell") + F.col("in_cell")).alias("before"), "weight", F.greatest(F.lit(1), F.ceil(F.col("weight") / F.lit(range_tokens))).alias("cuts"))
    # There are about as many places as texts, so both are shuffled; AQE splits a place that holds very many.
    placed = m.join(places.hint("shuffle_merge"), "curve_key").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("cuts")))
    at = F.floor((F.col("before") + F.col("salt") * (F.col("weight") / F.col("cuts"))) / F.lit(range_tokens))
    return placed.select("doc_id", "tokens", "curve_key", at.alias("curve_range"))


def pack_containers(docs: DataFrame, capacity: int = 2048, tokenizer: str = DEFAULT_TOKENIZER, range_tokens: int = 500_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece_no, token_start, tokens, container_id, curve_range, curve_key): where each text goes.

    Texts above the capacity are cut every `capacity` tokens, only their last piece may be shorter;
    no other text is cut. container_id is "<range>-<number>". A null or empty text is one piece of
    0 tokens. Repeated rows of an id are each placed. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    m = cut_lineage(curve_key(cut_lineage(measure(docs, doc_id, text, tokenizer))).select("doc_id", "tokens", "curve_key"))

    def kernel(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["curve_key", "doc_id"], kind="stable")
        n = np.maximum(1, -(-b["tokens"].to_numpy() // capacity))
        row = np.repeat(np.arange(len(b)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        size = np.minimum(capacity, b["tokens"].to_numpy()[row] - start)
        own = {c: b[c].to_numpy()[row] for c in ("doc_id", "curve_range", "curve_key")}
        return pd.DataFrame({**own, "piece_no": piece.astype("int32"), "token_start": start, "tokens": size, "container": pack(size, capacity)})[[c.split()[0] for c in PLACED.split(", ")]]

    out = curve_ranges(m, range_tokens).groupBy("curve_range").applyInPandas(kernel, PLACED)
    return out.select("doc_id", "piece_no", "token_start", "tokens", F.concat_ws("-", "curve_range", "container").alias("container_id"), "curve_range", "curve_key")
