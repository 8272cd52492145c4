"""Evaluation passages inside a corpus: one Aho-Corasick automaton over all items, one pass over the texts.

The patterns are the items' runs of `window` consecutive normalised words. Items are the small
side; their characters are summed before they are sent to the executors, and more than
MAX_ITEM_CHARS are scanned in further passes. The corpus is scanned where it lies, without a shuffle. A
document's matches are merged per item, where windows that follow each other in the text follow each
other in the item too, and mapped back to offsets in the original text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.textnorm import _WORD, _fold, plain, words, words_with_offsets
from strandlake.plans.runtime import spread

#: Characters of items that one automaton may hold, about 190 MB of nodes in a worker, as their windows overlap; more items are
#: scanned in further passes, with the same result.
MAX_ITEM_CHARS = 400_000
#: The automaton of this worker, by the broadcast it was made from.
_HELD: dict[str, ahocorasick.Automaton] = {}
LEAKS = "doc_id long, item_id long, words int, start_offset int, end_offset int"


def windows(text: str | None, window: int) -> list[str]:
    """The runs of `window` words, in order."""
    w = words(text or "")
    return [" ".join(w[i : i + window]) for i in range(len(w) - window + 1)]


def automaton(items: list[tuple[int, str]], window: int) -> ahocorasick.Automaton:
    """Maps " w1 ... wn " of every window to the items that hold it and its places in them."""
    held: dict[str, list[tuple[int, int]]] = {}
    for item, text in items:
        for i, w in enumerate(windows(text, window)):
            held.setdefault(w, []).append((item, i))
    a = ahocorasick.Automaton()
    for w, places in held.items():
        a.add_word(f" {w} ", tuple(sorted(places)))
    if held:
        a.make_automaton()
    return a


def scan(a: ahocorasick.Automaton, text: str, window: int) -> list[tuple[int, int, int, int]]:
    """(item_id, words, start, end) per item: its longest run of consecutive words in the text, of those the first."""
    stream = f" {' '.join(_WORD.findall(_fold(plain(text))))} "
    ends = [(end, places) for end, places in a.iter(stream)]
    if not ends:
        return []
    _, spans = words_with_offsets(text)
    # Positions of the blanks give word ordinals: a match ends at the blank after its last word.
    blanks, n = {}, 0
    for i, c in enumerate(stream):
        if c == " ":
            blanks[i] = n
            n += 1
    best: dict[int, tuple[int, int, int]] = {}
    # By item and distance between the places in text and item: a run goes on only at the same distance.
    open_: dict[tuple[int, int], tuple[int, int]] = {}
    for end, places in ends:
        last = blanks[end] - 1
        for item, i in places:
            first, before = open_.get((item, last - i), (last - window + 1, last - 1))
            if before != last - 1:
                first = last - window + 1
            open_[item, last - i] = (first, last)
            if last - first + 1 > best.get(item, (0, 0, 0))[0]:
                best[item] = (last - first + 1, first, last)
    return [(item, n, spans[first][0], spans[last][1]) for item, (n, first, last) in best.items()]


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", window: int = 12) -> DataFrame:
    """(doc_id, item_id, words, start_offset, end_offset), one row per document and item of which it
    holds at least `window` consecutive words; `words` is the longest such run, the offsets are its
    span in the original text.

    Null and empty texts hold nothing, items of fewer words than the window match nothing,
    repeated items are reported under each of their ids, rows that repeat a doc_id each by themselves. Texts of any
    length are scanned whole. The number of passes is the items' size over MAX_ITEM_CHARS.
    """
    held = items.select(F.col(item_id).cast("long"), F.col(item_text)).where(f"{item_text} is not null").distinct()
    size = held.agg(F.sum(F.length(item_text)).alias("n")).first()["n"] or 0
    passes = max(1, -(-size // MAX_ITEM_CHARS))
    found = None
    for k in range(passes):
        part = held if passes == 1 else held.where(F.pmod(F.xxhash64(item_id), F.lit(passes)) == k)
        own = [(r[0], r[1]) for r in part.toLocalIterator()]
        sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, own))

        def kernel(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            name, own = sent.value
            if (a := _HELD.get(name)) is None:
                _HELD.clear()
                a = _HELD[name] = automaton(own, window)
            for b in batches:
                out = []
                if len(a):
                    for d, t in zip(b["d"], b["t"]):
                        if t:
                            out += [(d, *hit) for hit in scan(a, t, window)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "words", "start_offset", "end_offset"])

        rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where("t is not null")
        one = spread(rows).mapInPandas(kernel, LEAKS)
        found = one if found is None else found.unionByName(one)
    return found
