"""Abusive, hateful or sexual content: nearest labelled examples by exact TF-IDF cosine.

Corpus (executors, one Arrow pass): every text becomes the hashes of its words, sentence by sentence, and the
words and pairs of neighbours of all documents are counted in BUCKETS buckets; their weights follow from
these counts. Hashes and sentences are written to the shared folder, so that no text is taken apart twice.

Index (driver, from at most MAX_LABELLED labelled documents): passages of clean documents are
clean examples; of an offending document the passages that set it apart from clean documents are
offending examples. Postings are kept per block of examples with the greatest weight of each
feature (block maxima), offending and clean examples in separate blocks.

Scoring (executors, one Arrow pass over the hashes): every passage of every text is bounded, first by what
its features may add to the product with any offending example, a batch at a time, then by the block maxima;
only where an offending block may reach `min_sim` are its postings and the clean ones read and the
k nearest examples found, exactly. Their votes, weighted by similarity, are the passage's score; a
document has that of its worst passage, with that passage's nearest example as evidence.
"""

from __future__ import annotations

import functools
import math
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.textnorm import _fold, plain
from strandlake.plans.runtime import scratch, spread

#: Labelled documents an index may hold, and their characters; more are thinned by the hash of their id.
MAX_LABELLED = 12_000
MAX_CHARS = 20_000_000
BLOCK = 64
#: Buckets of the counts, a power of two. Features of one bucket are counted together, so a weight is at most too small.
BUCKETS = 1 << 20
#: Least weight of a feature.
LEAST_IDF = 0.05
#: Rows that are bounded at once, so that their numbers stay in a core's cache.
ROWS = 400
#: Results of sentences that a worker keeps, as many sentences return.
CACHED = 200_000
KINDS = ("clean", "abuse", "hate", "sexual")
#: Signs written in place of letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "+": "t", "|": "l", "€": "e"})

#: Where a sentence ends: behind its sign, or at a line break. The first group is the sign.
_SENTENCE = re.compile(r"([.!?…])[\"')\]]*\s+|[\r\n]+")
_SPACED = re.compile(r"(?<!\w)(?:\w[ .\-_*]){2,}\w(?!\w)")
_GAP = re.compile(r"[ .\-_*]")
#: What every match of _SPACED ends in; few texts have it.
_MAY_BE_SPACED = re.compile(r"[ .\-_*]\w[ .\-_*]\w\b")
_MASKED = re.compile(r"^([^\W\d_])\*{2,}([^\W\d_])?$")
_PURE = re.compile(r"^[^\W\d_]+$")
_WORD = re.compile(r"[^\W_]+")
_REPEAT = re.compile(r"(.)\1+")
_CODE = re.compile(r"(?<![\w@])(?:[a-z]{3,}(?:[A-Z][a-z]{2,}\d*)+|\w*[^\W\d]_\w+|\w+(?:\.|->|::)\w+|0x\w+)(?!\w)|(?:https?|ftp)://\S+")
_NUMBER = re.compile(r"(?<!\w)\d[\d.:,]*(?!\w)")
_SIGN = re.compile("[\U0001f300-\U0001faff☀-➿]")
_EDGE = "\"'.,;:?!()[]{}<>«»“”‘’…`~#"


@functools.lru_cache(maxsize=CACHED)
def _word(t: str) -> tuple[str, ...]:
    out = [] if t.isascii() else _SIGN.findall(t)
    t = t.strip(_EDGE)
    if t[:1] == "@":
        t = t[1:]
    if not t:
        pass
    elif _PURE.match(t):
        out.append(_REPEAT.sub(r"\1", t))
    elif m := _MASKED.match(t):
        out.append(f"{m.group(1)}*{len(t)}*{m.group(2) or ''}")
    elif "_" not in t and _PURE.match(u := t.translate(LEET)):
        out.append(_REPEAT.sub(r"\1", u))
    else:
        out += ["0" if any(map(str.isdigit, w)) else _REPEAT.sub(r"\1", w) for w in _WORD.findall(t)]
    return tuple(out)


@functools.lru_cache(maxsize=CACHED)
def token(t: str) -> tuple[str, ...]:
    """The words that a blank-separated token of a plain text stands for, folded: letter-like signs
    read as letters, repeated letters as one, a masked word (w***d) as w*length*d, pictographs as
    words. Code names and addresses count as one word, numbers as another: they are no words to compare by."""
    core = t.strip(_EDGE)
    if core.isalpha() and t.isascii() and (core.isupper() or core[1:].islower() or len(core) == 1):
        # A plain word between plain signs: no pattern but that of repeated letters can match.
        return (_REPEAT.sub(r"\1", core.lower()),)
    return tuple(w for x in _fold(_NUMBER.sub("0", _CODE.sub(" idf ", t))).split() for w in _word(x))


def sentences(text: str) -> list[str]:
    """Sentences and lines of the whole plain text, spaced-out letters (w o r d) joined."""
    t = plain(text, emphasis=True)
    if _MAY_BE_SPACED.search(t):
        t = _SPACED.sub(lambda m: _GAP.sub("", m.group()), t)
    parts = _SENTENCE.split(t)
    out = [a + sign if sign else a for a, sign in zip(parts[::2], parts[1::2])]
    out.append(parts[-1])
    return out


def split(sentence: str, most: int = 40, overlap: int = 10) -> list[list[str]]:
    """A sentence as token lists: one, or windows of `most` tokens if it is longer."""
    w = list(chain.from_iterable(map(token, sentence.split())))
    if len(w) <= most:
        return [w] if w else []
    return [w[i : i + most] for i in range(0, len(w) - overlap, most - overlap)]


def passages(sentence: str, long: int = 16, size: int = 14) -> list[list[str]]:
    """What is scored of a sentence: split(), and of each part of more than `long` tokens also windows of
    `size` with half overlap, as a short insult is far from a long passage that holds it."""
    out = split(sentence)
    return out + [w[i : i + size] for w in out if len(w) > long for i in range(0, len(w) - size // 2, size // 2)]


def features(w: list[str]) -> list:
    """Words and pairs of neighbours, with the borders of the passage."""
    return [*w, *zip(["^", *w], [*w, "$"])]


# Hashes of words and pairs, the same in arrays and one at a time.

_M1, _M2, _ALL = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1
_SHIFT = 64 - (BUCKETS.bit_length() - 1)


def word_key(w: str) -> int:
    """32 bits of a word; the last one tells masked words. Two words of one key share their counts, and the bounds take either
    for the other; examples are compared by the words themselves."""
    return xxhash.xxh32_intdigest(w) & ~1 | ("*" in w)


def feature_key(f) -> int:
    """64 bits of a word or a pair."""
    return (word_key(f[0]) * _M1 + word_key(f[1])) * _M2 & _ALL if isinstance(f, tuple) else word_key(f) * _M2 & _ALL


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint64(_M1) + b) * np.uint64(_M2)


_FIRST, _LAST = np.uint64(word_key("^")), np.uint64(word_key("$"))


class _Tokens(dict):
    """Keys of the words of a token, by the token; emptied when it holds CACHED of them."""

    def __missing__(self, t: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        out = self[t] = b"".join(word_key(w).to_bytes(4, "little") for w in token.__wrapped__(t))
        return out


_TOKENS = _Tokens()


def keys_of(h: bytes) -> np.ndarray:
    return np.frombuffer(h, "uint32").astype("uint64")


#: What stands between the sentences of a plain text; it is a blank, so no word holds it.
BREAK = "\x1e"


def hashed(text: str) -> tuple[bytes, bytes, str]:
    """(keys of the words, number of words of each sentence, the sentences), empty sentences too."""
    held = [s.replace(BREAK, " ") for s in sentences(text)] if BREAK in text else sentences(text)
    of, join = _TOKENS.__getitem__, b"".join
    parts = [join(map(of, s.split())) for s in held]
    return join(parts), array("i", [len(p) // 4 for p in parts]).tobytes(), BREAK.join(held)


def _sentence_pairs(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sentences of n words laid end to end: keys of all pairs of neighbours, whether they are of one sentence, and of the first and last word with the border."""
    n = n[n > 0]
    ends = np.cumsum(n)
    inner = pair_keys(h[:-1], h[1:])
    one = np.ones(len(inner), bool)
    one[ends[:-1] - 1] = False
    return inner, one, pair_keys(np.full(len(n), _FIRST), h[ends - n]), pair_keys(h[ends - 1], np.full(len(n), _LAST))


class Weights:
    """Inverse frequencies by bucket: log of sentences over occurrences."""

    def __init__(self, counts: np.ndarray, n: int):
        self.table = np.maximum(LEAST_IDF, np.log((n + 1) / (counts + 0.5))).astype("float32")

    def of_keys(self, keys: np.ndarray) -> np.ndarray:
        return self.table[(keys >> np.uint64(_SHIFT)).astype("int64")]

    def of(self, f) -> float:
        return float(self.table[feature_key(f) >> _SHIFT])


def add_counts(counts: np.ndarray, h: np.ndarray, n: np.ndarray) -> int:
    """Adds the words and pairs of sentences to the counts; gives the number of sentences with words."""
    if not len(h):
        return 0
    inner, one, first, last = _sentence_pairs(h, n)
    for keys in (h * np.uint64(_M2), inner[one], first, last):
        counts += np.bincount((keys >> np.uint64(_SHIFT)).astype("int64"), minlength=BUCKETS)
    return int((n > 0).sum())


@functools.lru_cache(maxsize=10_000)
def windows_of(n: int, most: int = 40, overlap: int = 10, long: int = 16, size: int = 14) -> tuple[tuple[int, int], ...]:
    """(offset, length) of the passages of a sentence of n words, in the order of passages()."""
    out = [(0, n)] if n <= most else [(i, min(most, n - i)) for i in range(0, n - overlap, most - overlap)]
    return tuple(out + [(o + i, min(size, k - i)) for o, k in out if k > long for i in range(0, k - size // 2, size // 2)])


#: Least ratio of a squared weight (1 + log c)^2 to the count c, by the greatest c there may be: what repeats may take from a norm.
_REPEATS = np.minimum.accumulate([1.0] + [(1 + math.log(c)) ** 2 / c for c in range(1, 64)])


class Index:
    """Labelled passages as unit TF-IDF vectors in blocks, with postings and block maxima.

    examples: (tokens, share of raters who found offence, kind, doc_id); weights: of all features;
    strong: words of offending examples, which masked words are read as, and their
    weight; held: the clean postings, shared between indexes with the same weights.
    """

    def __init__(self, examples: list[tuple], weights: Weights, min_sim: float, k: int, strong: dict[str, float], held: dict):
        self.min_sim, self.k, self.cache, self.weights = min_sim, k, {}, weights
        self.masks: dict[str, str] = {}
        for w in sorted(strong, key=lambda x: (strong[x], x)):
            # Words are kept with doubled letters as one, so the mask may be a little longer.
            for more in (2, 1, 0) if len(w) > 2 else ():
                self.masks[f"{w[0]}*{len(w) + more}*{w[-1]}"] = w
        self.idf: dict = {}
        examples = sorted(examples, key=lambda e: (e[1] < 0.5, e[2], e[0], e[3]))
        self.label = np.array([e[1] for e in examples], dtype="float64")
        self.n_bad = int((self.label >= 0.5).sum())
        # Of the offending examples only, which are the evidence.
        self.kind = [e[2] for e in examples[: self.n_bad]]
        self.text = [" ".join(e[0]) for e in examples[: self.n_bad]]
        self.of_doc = defaultdict(list)
        for i, (_, _, _, d) in enumerate(examples[: self.n_bad]):
            self.of_doc[d].append(i)
        self.of_doc = dict(self.of_doc)
        # Per side (clean, offending) and feature: examples, weights, greatest weight. The clean side is that of `held` if it is the same.
        self.clean = clean = [tuple(e[0]) for e in examples[self.n_bad :]]
        if held.get(None, (None,))[0] != clean:
            held[None] = (clean, self.postings(clean))
        sides = (held[None][1], self.postings([tuple(e[0]) for e in examples[: self.n_bad]]))
        self.ids = {f: j for j, f in enumerate(dict.fromkeys(chain(sides[1], sides[0])))}
        self.post: tuple[list, list] = tuple([side.get(f) for f in self.ids] for side in sides)
        # Block maxima of the offending blocks, a row per feature that any of them has; gain: what a
        # feature may add to the product with any of them.
        self.n_blocks = -(-self.n_bad // BLOCK)
        own = [(f, p[0] // BLOCK, p[1]) for f, p in zip(self.ids, self.post[1]) if p]
        self.bad_row = {f: j for j, (f, _, _) in enumerate(own)}
        self.block_max = np.zeros((len(own), self.n_blocks), dtype="float32")
        for j, (_, b, x) in enumerate(own):
            np.maximum.at(self.block_max[j], b, x)
        self.gain = {f: self.weight(f) * float(x.max()) for f, _, x in own}
        self.reach = self.block_max * np.array([self.weight(f) for f in self.bad_row], dtype="float32")[:, None]
        self.idf = {f: self.weight(f) for f in self.ids}
        # The same by key, sorted: gain and row of the block maxima; the last row is that of features no block has.
        pick = lambda found: (np.array([k for k, _ in found], "uint64"), np.array([self.gain[f] for _, f in found]), np.array([self.bad_row[f] for _, f in found], "int64"))
        self.word_rows = pick(sorted((word_key(f), f) for f in self.gain if isinstance(f, str)))
        self.pair_rows = pick(sorted((feature_key(f), f) for f in self.gain if not isinstance(f, str)))
        self.reach_or_none = np.concatenate([self.reach, np.zeros((1, self.n_blocks), "float32")])
        masks = sorted((word_key(m), word_key(w)) for m, w in self.masks.items())
        self.mask_keys = (np.array([k for k, _ in masks], "uint64"), np.array([w for _, w in masks], "uint64"))

    def __getstate__(self) -> dict:
        """As it is sent: postings end to end, without what can be looked up again."""
        state = {k: v for k, v in self.__dict__.items() if k not in ("post", "idf", "cache", "clean")}
        empty = (np.zeros(0, "int32"), np.zeros(0, "float32"), 0.0)
        state["packed"] = [(np.array([len(p[0]) if p else 0 for p in side]), *(np.concatenate([(p or empty)[i] for p in side] or [empty[i]]) for i in (0, 1))) for side in self.post]
        return state

    def __setstate__(self, state: dict) -> None:
        packed = state.pop("packed")
        self.__dict__.update(state, idf={}, cache={})
        sides = []
        for sizes, rows, weights in packed:
            ends = np.cumsum(sizes).tolist()
            starts = [0, *ends[:-1]]
            most = np.zeros(len(sizes))
            if len(rows):
                most[sizes > 0] = np.maximum.reduceat(weights, np.array(starts)[sizes > 0])
            sides.append([(rows[a:b], weights[a:b], m) if b > a else None for a, b, m in zip(starts, ends, most.tolist())])
        self.post = tuple(sides)

    def postings(self, texts: list[tuple]) -> dict:
        """Feature to (numbers of the texts that have it, its weights there, the greatest one)."""
        if not texts:
            return {}
        ids: dict = {}
        of, factors, sizes = [], [], []
        for key in texts:
            fs = features(key)
            if len(set(fs)) < len(fs):
                counts = Counter(fs)
                fs = list(counts)
                factors += [1 + math.log(c) for c in counts.values()]
            else:
                factors += [1.0] * len(fs)
            of += [ids.setdefault(f, len(ids)) for f in fs]
            sizes.append(len(fs))
        of, starts = np.array(of, "int64"), np.cumsum(sizes) - sizes
        w = np.array([self.weight(f) for f in ids])[of] * np.array(factors)
        w /= np.repeat(np.sqrt(np.add.reduceat(w * w, starts)), sizes)
        order = np.argsort(of, kind="stable")
        rows, weights = np.repeat(np.arange(len(texts), dtype="int32"), sizes)[order], w[order].astype("float32")
        ends = np.cumsum(np.bincount(of, minlength=len(ids)))
        starts = [0, *ends[:-1]]
        return {f: (rows[a:b], weights[a:b], float(m)) for f, a, b, m in zip(ids, starts, ends, np.maximum.reduceat(weights, starts))}

    def weight(self, f) -> float:
        if (x := self.idf.get(f)) is None:
            x = self.idf[f] = self.weights.of(f)
            if len(self.idf) > 4 * CACHED:
                self.idf = {g: y for g, y in self.idf.items() if g in self.ids}
        return x

    def vector(self, w: list[str]) -> list[tuple]:
        fs = features(w)
        if len(set(fs)) == len(fs):
            v = [(f, self.weight(f)) for f in fs]
        else:
            v = [(f, (1 + math.log(c)) * self.weight(f)) for f, c in Counter(fs).items()]
        norm = math.sqrt(sum(x * x for _, x in v)) or 1.0
        return [(f, x / norm) for f, x in v]

    def candidates(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sentence, offset, length) of the passages of sentences of n words laid end to end that may reach min_sim with an
        offending example, in the order of passages(): by what their features may add at most, then by the block maxima."""
        start = np.cumsum(n) - n
        plain_ = np.flatnonzero((n > 0) & (n <= 16))
        more = [(s, o, k) for s in np.flatnonzero(n > 16) for o, k in windows_of(int(n[s]))]
        sent, off, size = (np.concatenate([a, np.array([m[i] for m in more], "int64")]) for i, a in enumerate((plain_, np.zeros(len(plain_), "int64"), n[plain_].astype("int64"))))
        if not len(sent) or not self.n_bad:
            return sent[:0], off[:0], size[:0]
        order = np.argsort(sent, kind="stable")
        sent, off, size = sent[order], off[order], size[order]
        if (masked := (h & np.uint64(1)).astype(bool)).any() and len(self.mask_keys[0]):
            h = h.copy()
            at = np.minimum(np.searchsorted(self.mask_keys[0], h[masked]), len(self.mask_keys[0]) - 1)
            h[masked] = np.where(self.mask_keys[0][at] == h[masked], self.mask_keys[1][at], h[masked])

        def looked_up(keys: np.ndarray, weights: np.ndarray, held: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Squared weight, gain and row of each key."""
            w, none = weights.astype("float64") ** 2, len(self.bad_row)
            if not len(held[0]) or not len(keys):
                return w, np.zeros(len(keys)), np.full(len(keys), none)
            at = np.minimum(np.searchsorted(held[0], keys), len(held[0]) - 1)
            hit = held[0][at] == keys
            return w, np.where(hit, held[1][at], 0.0), np.where(hit, held[2][at], none)

        of, upto = self.weights.of_keys, lambda x: np.concatenate([[0.0], np.cumsum(x)])
        a, b = start[sent] + off, start[sent] + off + size
        inner, first, last = pair_keys(h[:-1], h[1:]), pair_keys(np.full(len(a), _FIRST), h[a]), pair_keys(h[b - 1], np.full(len(a), _LAST))
        total = [0.0, 0.0]
        words, pairs = looked_up(h, of(h * np.uint64(_M2)), self.word_rows), looked_up(inner, of(inner), self.pair_rows)
        begin, end = looked_up(first, of(first), self.pair_rows), looked_up(last, of(last), self.pair_rows)
        for i in (0, 1):
            w, p = upto(words[i]), upto(pairs[i])
            total[i] = w[b] - w[a] + p[b - 1] - p[a] + begin[i] + end[i]
        # Repeats make a norm smaller than the sum over all occurrences, by no more than this.
        least = self.min_sim * np.sqrt(_REPEATS[np.minimum(size + 1, 63)] * total[0]) * (1 - 1e-5) - 1e-6
        may = np.flatnonzero(total[1] >= least)
        keep = []
        next_row = np.append(pairs[2], len(self.bad_row))
        for c in range(0, len(may), 4096):
            m = may[c : c + 4096]
            k = size[m]
            at = np.cumsum(k) - k
            flat = np.repeat(a[m] - at, k) + np.arange(int(k.sum()))
            after = next_row[flat]
            after[at + k - 1] = end[2][m]
            block = np.add.reduceat(self.reach_or_none[words[2][flat]] + self.reach_or_none[after], at, axis=0) + self.reach_or_none[begin[2][m]]
            keep.append(m[block.max(axis=1) >= least[m]])
        may = np.concatenate(keep) if keep else may
        return sent[may], off[may], size[may]

    def within(self, q: list[tuple[int, float]], least: float, side: int) -> tuple[np.ndarray, np.ndarray]:
        """(examples, products) of a side whose product with q is at least `least`. Features that
        together can't reach it are read only for the examples that the others leave."""
        own = [(x * p[2], x, p) for j, x in q if (p := self.post[side][j])]
        if side:
            # The offending side is small: all its postings are added up.
            total = np.zeros(self.n_bad, dtype="float32")
            for _, x, (r, v, _) in own:
                total[r] += x * v
            found = np.flatnonzero(total >= least)
            return found, total[found]
        own.sort(key=lambda y: y[0])
        safe, rest, k = least * (1 - 1e-5), 0.0, 0
        while k < len(own) and rest + own[k][0] < safe:
            rest += own[k][0]
            k += 1
        if k == len(own):
            return np.zeros(0, dtype="int64"), np.zeros(0, dtype="float32")
        total = np.zeros(len(self.label) - self.n_bad, dtype="float32")
        for _, x, (r, v, _) in own[k:]:
            total[r] += x * v
        found = np.flatnonzero(total >= safe - rest)
        total = total[found]
        for _, x, (r, v, _) in own[:k] if len(found) else ():
            at = np.minimum(np.searchsorted(r, found), len(r) - 1)
            total += np.where(r[at] == found, x * v[at], np.float32(0))
        return found[total >= least], total[total >= least]

    def nearest(self, w: list[str], skip: list[int] = (), alone: bool = False, bounded: bool = False) -> tuple[float, int, float]:
        """(score, nearest offending example or -1, its similarity). skip: offending examples that
        don't count. alone: a passage near to no example at all scores 1 instead of 0. bounded: it is one of candidates()."""
        none = (0.0, -1, 0.0)
        if not self.n_bad:
            return none
        fs = features([self.masks.get(t, t) if "*" in t else t for t in w])
        if not alone and not bounded:
            # Each occurrence counted in full in the product, each feature once in the norm: above the
            # cosine, first of all blocks together, then of each.
            least = self.min_sim * math.sqrt(sum(self.weight(f) ** 2 for f in set(fs)))
            if sum(map(self.gain.get, fs, repeat(0.0))) < least:
                return none
            if self.reach.take([self.bad_row[f] for f in fs if f in self.bad_row], axis=0).sum(axis=0).max() < least * (1 - 1e-5):
                return none
        q = [(f, self.weight(f) * (1 + math.log(c) if c > 1 else 1)) for f, c in Counter(fs).items()]
        norm = math.sqrt(sum(x * x for _, x in q))
        q = [(self.ids[f], x) for f, x in q if f in self.ids]
        bad, sims = self.within(q, self.min_sim * norm, 1)
        if len(skip):
            bad, sims = bad[m := ~np.isin(bad, skip)], sims[m]
        if not alone and not len(bad):
            return none
        clean, more = self.within(q, self.min_sim * norm, 0)
        near, sims = np.concatenate([bad, clean + self.n_bad]), np.concatenate([sims, more]) / norm
        if not len(near):
            return 1.0, -1, 0.0
        # Of equals the first.
        top = np.argsort(-sims, kind="stable")[: self.k]
        v = sims[top].astype("float64") ** 2
        best = int(sims[: len(bad)].argmax()) if len(bad) else 0
        return float((v * self.label[near[top]]).sum() / v.sum()), int(near[best]), float(sims[best])


def majority(labels: dict[str, int]) -> tuple[float, str]:
    """(share of raters who found offence, their most frequent label)."""
    bad = {x: n for x, n in labels.items() if x != "clean" and n}
    return sum(bad.values()) / max(1, sum(labels.values())), min(bad, key=lambda x: (-bad[x], x)) if bad else "clean"


def fit(labelled: list[tuple[int, str | list[str], dict[str, int]]], min_sim: float = 0.35, k: int = 12, weights: Weights | None = None) -> Index:
    """The index of labelled (doc_id, text or its sentences, count of each label). weights: those of the corpus; without, those of
    the labelled documents.

    A passage's evidence is the sum of the log odds, between offending and clean documents, of its
    words, and of its pairs of words that three offending documents have. Of an offending document
    the passages with at least half of the evidence of its greatest one become offending examples;
    the others are left out, as the label doesn't speak of them. The examples are then edited: one
    whose nearest examples from other documents are mostly clean was taken for a wrong label, or
    beside the point, and is dropped, as is one near to none whose words are all known from clean
    documents.
    """
    if weights is None:
        counts, n = np.zeros(BUCKETS, "int64"), 0
        for _, t, _ in labelled:
            h, m, _ = hashed(t)
            n += add_counts(counts, keys_of(h), np.frombuffer(m, "int32"))
        weights = Weights(counts, n)
    docs = [(d, *majority(ls), [p for s in (sentences(t) if isinstance(t, str) else t) for p in split(s)]) for d, t, ls in labelled]
    bad, clean = Counter(), Counter()
    n_bad = sum(share >= 0.5 for _, share, _, _ in docs)
    for _, share, _, ps in docs:
        seen: set = set()
        for p in ps:
            seen |= set(features(p))
        (bad if share >= 0.5 else clean).update(seen)
    n_clean = len(docs) - n_bad
    odds = {f: math.log((c + 0.3) / (n_bad + 0.6)) - math.log((clean[f] + 0.3) / (n_clean + 0.6)) for f, c in bad.items()}

    def evidence(p: list[str]) -> float:
        telling = {f: odds[f] for f in set(features(p)) if odds.get(f, 0) > 1 and (isinstance(f, str) or bad[f] > 2)}
        if len(telling) < 2 and not any(isinstance(f, str) for f in telling):
            return 0.0
        return sum(sorted(telling.values(), reverse=True)[:8])

    chosen, calm = [], set()
    for d, share, kind, ps in docs:
        if share < 0.5:
            calm.update(map(tuple, ps))
            continue
        e = [evidence(p) for p in ps]
        most = max(e, default=0)
        chosen += [(p, share, kind, d) for p, x in zip(ps, e) if x > 2 and x >= most / 2]
    quiet, held = [(list(p), 0.0, "clean", 0) for p in calm], {}

    def build(rows: list[tuple]) -> Index:
        return Index(rows + quiet, weights, min_sim, k, {w: odds[w] for p, *_ in rows for w in p if odds.get(w, 0) > 1}, held)

    first = build(chosen)
    kept = []
    for row in chosen:
        score, near, _ = first.nearest(row[0], first.of_doc[row[3]], alone=True)
        if score >= 0.5 and (near >= 0 or any(not clean[w] for w in row[0] if w.isalpha())):
            kept.append(row)
    return build(kept)


def worst(ix: Index, text: str | list[str], skip: list[int] | None = None) -> tuple[float, str, float, str, str]:
    """(score, kind, similarity, passage, nearest example) of the passage that scores highest, of equals the first. text: or its sentences."""
    top = (0.0, "clean", 0.0, "", "")
    for s in sentences(text) if isinstance(text, str) else text:
        for p in passages(s):
            key = tuple(p)
            hit = ix.cache.get(key) if skip is None else None
            if hit is None:
                score, i, sim = ix.nearest(p, skip or ())
                hit = (score, ix.kind[i], sim, " ".join(p), ix.text[i]) if score else (0.0,)
                if skip is None:
                    if len(ix.cache) >= CACHED:
                        ix.cache.clear()
                    ix.cache[key] = hit
            if hit[0] > top[0]:
                top = hit
    return top


def worst_of_rows(ix: Index, said: list[str], h: list[bytes], n: list[bytes]) -> list[tuple[float, str, float, str, str]]:
    """worst() of each text, from its hashes and sentences; only sentences with a candidate are looked at themselves."""
    out = [(0.0, "clean", 0.0, "", "")] * len(said)
    counts = np.frombuffer(b"".join(n), "int32")
    per = np.array([len(x) // 4 for x in n], "int64")
    first, row = np.cumsum(per) - per, np.repeat(np.arange(len(said)), per)
    sent, off, size = ix.candidates(keys_of(b"".join(h)), counts)
    at, held, no = -1, [], -1
    for s, o, k in zip(sent.tolist(), off.tolist(), size.tolist()):
        r = int(row[s])
        if r != at:
            at, held = r, said[r].split(BREAK)
        if s != no:
            no, w = s, list(chain.from_iterable(map(token, held[s - int(first[r])].split())))
        key = tuple(w[o : o + k])
        if (hit := ix.cache.get(key)) is None:
            score, i, sim = ix.nearest(list(key), bounded=True)
            hit = (score, ix.kind[i], sim, " ".join(key), ix.text[i]) if score else (0.0,)
            if len(ix.cache) >= CACHED:
                ix.cache.clear()
            ix.cache[key] = hit
        if hit[0] > out[r][0]:
            out[r] = hit
    return out


def calibrate(scores: list[float], truth: list[bool], rounds: int = 50) -> tuple[float, float]:
    """(a, b) such that 1 / (1 + exp(-a - b * score)) is the chance of offence, by penalised maximum likelihood."""
    y, t = np.array(truth, dtype=float), np.zeros(2)
    x = np.stack([np.ones(len(scores)), np.array(scores)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        t = t + np.linalg.solve(h, x.T @ (y - p) - 0.1 * t)
    return float(t[0]), float(t[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str = "text") -> list[tuple[int, str, dict[str, int]]]:
    """At most MAX_LABELLED labelled documents with text and label counts, those of the least hash of their id."""
    docs = docs.select("doc_id", F.col(text).alias("text"))
    l = labels.select("doc_id", F.lower(F.trim("label")).alias("label")).where(F.col("label").isin(*KINDS))
    l = l.groupBy("doc_id").agg(*[F.count(F.when(F.col("label") == k, 1)).alias(k) for k in KINDS])
    l = l.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(l), "doc_id")
    # In the order of the hash, a text that doesn't fit what is left of MAX_CHARS is left out, no other
    # one for it. Ids may repeat, texts tell them apart.
    sizes = rows.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.sum(F.length("text")).alias("chars"))
    left, out = MAX_CHARS, []
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "h").toLocalIterator():
        if r["chars"] <= left:
            left -= r["chars"]
        else:
            out.append((r["doc_id"], r["h"]))
    if out:
        leave = docs.sparkSession.createDataFrame(out, sizes.drop("chars").schema)
        rows = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(leave), ["doc_id", "h"], "left_anti")
    rows = rows.select("doc_id", "text", *KINDS)
    return [(r[0], r[1], dict(zip(KINDS, r[2:]))) for r in rows.toLocalIterator()]


SCORES = "doc_id long, source string, raw_score double, score double, kind string, similarity double, passage string, example string"


HASHED = "doc_id long, source string, said string, h binary, n binary, block int, c array<bigint>"
#: Buckets that are counted in one row.
ROW = 64


def hash_corpus(docs: DataFrame) -> tuple[DataFrame, Weights]:
    """(doc_id, source, said, h, n) of every row of docs, what hashed() gives, written to the shared folder, and the weights from the counts of all of
    them. A task adds its counts up; tasks' counts are summed by block of buckets, so what comes to the driver is the
    table of BUCKETS numbers, whatever the corpus."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(BUCKETS, "int64"), 0
        for b in batches:
            rows = [hashed(t) if t else (b"", b"", "") for t in b.column("text").to_pylist()]
            total += add_counts(counts, keys_of(b"".join(r[0] for r in rows)), np.frombuffer(b"".join(r[1] for r in rows), "int32"))
            h, n, said = (pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.binary(), pa.binary(), pa.string())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), said, h, n, pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.list_(pa.int64()))], names)
        blocks = counts.reshape(-1, ROW)
        some = np.flatnonzero(blocks.any(axis=1))
        c = pa.array([[total], *blocks[some].tolist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(c), k) for k in (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())), pa.array([-1, *some.tolist()], pa.int32()), c], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    path = scratch(docs.sparkSession, "hashed")
    names = [c.split()[0] for c in HASHED.split(", ")]
    spread(rows).mapInArrow(kernel, HASHED).write.option("compression", "zstd").parquet(path)
    held = docs.sparkSession.read.schema(HASHED).parquet(path)
    sums = held.where("block is not null").groupBy("block").agg(*[F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(ROW)])
    counts, n = np.zeros((BUCKETS // ROW, ROW), "int64"), 0
    for r in sums.toLocalIterator():
        if r["block"] < 0:
            n = r["c0"]
        else:
            counts[r["block"]] = r[1:]
    return held.where("block is null").select("doc_id", "source", "said", "h", "n"), Weights(counts.reshape(-1), n)


def score_offence(docs: DataFrame, labels: DataFrame, min_sim: float = 0.35, k: int = 12, held_out: int = 5) -> DataFrame:
    """(doc_id, source, raw_score, score, kind, similarity, passage, example), one row per row of docs.

    score is the calibrated chance of offence: raw_score is the share of votes for the worst passage,
    the calibration is fitted on every held_out-th labelled document, scored without its own examples
    (with fewer than 50 of them, or of one kind only, score is raw_score). Null and empty texts
    score as texts without offence. Without labels every raw_score is 0. Labels that are null or
    none of KINDS are ignored; a document counts as offending if at least half of its labels say so.
    """
    rows, weights = hash_corpus(docs)
    sample = sorted(labelled_sample(rows, labels, "said"), key=lambda r: (r[0], r[1]))
    sample = [(d, t.split(BREAK), n) for d, t, n in sample]
    ix = fit(sample, min_sim, k, weights)
    a = b = None
    test = sample[::held_out]
    truth = [majority(r[2])[0] >= 0.5 for r in test]
    if len(test) >= 50 and len(set(truth)) == 2:
        a, b = calibrate([worst(ix, r[1], ix.of_doc.get(r[0], []))[0] for r in test], truth)
    sent = docs.sparkSession.sparkContext.broadcast((ix, a, b))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix, a, b = sent.value
        for batch in batches:
            cols = [batch[c].to_list() for c in ("said", "h", "n")]
            rows = [x for i in range(0, len(batch), ROWS) for x in worst_of_rows(ix, *(c[i : i + ROWS] for c in cols))]
            raw = np.array([r[0] for r in rows], dtype=float)
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "source": batch["source"], "raw_score": raw, "score": raw if a is None else 1 / (1 + np.exp(-a - b * raw))}
                | {c: [r[i] for r in rows] for i, c in enumerate(("kind", "similarity", "passage", "example"), 1)}
            )

    return spread(rows).mapInPandas(kernel, SCORES)


def rates(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(source, documents, offending, rate, mean_score) per source; blanks trimmed, no source is null."""
    src = F.nullif(F.trim("source"), F.lit(""))
    return scored.groupBy(src.alias("source")).agg(F.count("*").alias("documents"), F.count(F.when(F.col("score") >= threshold, 1)).alias("offending"), F.avg((F.col("score") >= threshold).cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
