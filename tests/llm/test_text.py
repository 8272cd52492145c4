"""Problems 8, 9 and 10 on small fixtures."""

import pickle
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import leaks as lk
from strandlake.llm import offence as of
from strandlake.llm import pack_containers as pk
from strandlake.llm.textnorm import words, words_with_offsets

# Normalisation


def test_words_see_through_dress():
    want = ["the", "old", "miller", "counts", "twenty", "bells"]
    for dressed in (
        "The OLD miller, counts: twenty bells!", "the&nbsp;old&#x20;mill&#101;r &amp;#99;ounts twenty bells", "The <b>old</b> mil<i>ler</i><br>counts twenty bells", "The o​ld mil­ler co⁠unts twenty bells", "The old mil-\nler counts twen-\r\n> ty bells", "> The old miller\n> counts\n> twenty bells",
        "Тhе оld millеr соunts twеntу bеlls", "Ｔｈｅ ｏｌｄ ｍｉｌｌｅｒ counts twenty bells", "[The old](http://x.example/a/b) miller counts twenty bells", "**The** old _miller_ co**unts** twenty ~~bells~~", "The\\u0020old\\nmiller counts%20twenty bells", "Thé öld millèr counts twenty bells",
    ):
        assert words(dressed) == want, dressed


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=list("ab -\n>*&<b>/;#x65nspбеé​­&lt;._`%20\\n"), max_size=60))
def test_offsets_agree_with_words(text):
    found, spans = words_with_offsets(text)
    assert found == words(text)
    assert all(0 <= a < b <= len(text) for a, b in spans)
    assert all(p[0] <= q[0] for p, q in zip(spans, spans[1:]))


def test_offsets_are_those_of_the_original():
    text = "x &amp; <b>F​oo</b> ba-\n> r"
    found, spans = words_with_offsets(text)
    assert [(w, text[a:b]) for w, (a, b) in zip(found, spans)] == [("x", "x"), ("foo", "F​oo"), ("bar", "ba-\n> r")]


# Problem 9

WORDS = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]


def brute(text, item, window):
    a, b = words(text or ""), words(item or "")
    runs = {tuple(b[i : i + window]) for i in range(len(b) - window + 1)}
    return any(tuple(a[i : i + window]) in runs for i in range(len(a) - window + 1))


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice((3, 5, 9, 20))))) for i in range(30)] + [(90, None), (91, ""), (92, "w"), (93, " ".join(WORDS[:9])), (94, " ".join(WORDS[:9]))]
    docs = []
    for d in range(150):
        body = [rng.choice(WORDS) for _ in range(rng.randint(0, 40))]
        src = words(rng.choice(items)[1] or "")
        cut = src[rng.randint(0, 3) : rng.randint(3, 20)]
        at = rng.randint(0, len(body))
        docs.append((d, ", ".join([*body[:at], *(w.upper() for w in cut), *body[at:]]), "clash"))
    docs += [(900, None, ""), (901, "", ""), (902, " ".join(WORDS) * 3000, ""), (93, " ".join(WORDS[:9]), "repeated id")]
    df, it = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, item_text string")
    want = {(d, i) for d, t, _ in docs for i, x in items if brute(t, x, 5)}
    got = lk.find_leaks(df, it, window=5).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 50
    by = {d: t for d, t, _ in docs}
    for r in (x for x in got[:200] if x.doc_id != 93):
        piece = words(by[r.doc_id][r.start_offset : r.end_offset])
        assert len(piece) == r.words >= 5 and " ".join(piece) in " ".join(words(dict(items)[r.item_id]))
    monkeypatch.setattr(lk, "MAX_ITEM_CHARS", 200)
    assert {(r.doc_id, r.item_id) for r in lk.find_leaks(df, it, window=5).collect()} == want
    assert lk.find_leaks(df.limit(0), it, window=5).count() == 0 and lk.find_leaks(df, it.limit(0), window=5).count() == 0


def test_a_run_follows_the_item():
    """Windows that follow each other in the text but not in the item are no longer run."""
    item = "a b c d e x a b c d y b c d e"
    a = lk.automaton([(1, item)], 4)
    assert lk.scan(a, "a b c d e", 4) == [(1, 5, 0, 9)]
    assert [h[:2] for h in lk.scan(a, "x a b c d e", 4)] == [(1, 5)]


# Problem 8


def test_hilbert_visits_neighbours():
    n = 8
    grid = np.array([(x, y, z) for x in range(n) for y in range(n) for z in range(n)])
    key = pk.hilbert(grid, 3)
    assert sorted(key) == list(range(n**3))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=200), st.integers(1, 40))
def test_pack_holds_the_capacity(sizes, look):
    s = np.array(sizes, dtype="int64")
    box = pk.pack(s, 50, look)
    assert len(box) == len(s)
    if len(s):
        load = np.bincount(box, s)
        assert load.max() <= 50 and set(box) == set(range(box.max() + 1))


def test_containers_close_behind():
    rng = random.Random(5)
    box = pk.pack(np.array([rng.randint(1, 40) for _ in range(3000)]), 50, 10, 40)
    for b in range(box.max() + 1):
        at = np.flatnonzero(box == b)
        assert at[-1] - at[0] <= 60


def test_neighbours_share_containers(spark):
    """Texts of two kinds of words, in any order: containers hold one kind, but for those at borders."""
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(WORDS[:6] if i % 2 else WORDS[40:46]) for _ in range(30))) for i in range(400)]
    out = pk.pack_containers(spark.createDataFrame(docs, "doc_id long, text string"), 1024, range_tokens=4000).collect()
    kinds = {}
    for r in out:
        kinds.setdefault(r.container_id, []).append(r.doc_id % 2)
    mixed = sum(1 for v in kinds.values() if 0.2 < sum(v) / len(v) < 0.8)
    assert mixed <= len(kinds) * 0.4 and len(kinds) < 60


def test_packing_places_every_token_once(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice((1, 20, 80, 400)))), "clash") for i in range(300)]
    docs += [(1000 + i, "the same text again", "") for i in range(300)] + [(2000, None, ""), (2001, "", ""), (2002, "word " * 30000, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, tokens string")
    out = pk.pack_containers(df, 256, range_tokens=2000).collect()
    enc = pk.encoder(pk.DEFAULT_TOKENIZER)
    size = {d: len(enc.encode_ordinary(t or "")) for d, t, _ in docs}
    pieces, load = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append((r.piece_no, r.token_start, r.tokens))
        load[r.container_id] = load.get(r.container_id, 0) + r.tokens
    assert set(pieces) == set(size) and max(load.values()) <= 256
    for d, ps in pieces.items():
        ps.sort()
        assert [p[0] for p in ps] == list(range(len(ps))) and sum(p[2] for p in ps) == size[d]
        assert [p[1] for p in ps] == [256 * i for i in range(len(ps))] and (len(ps) == 1) == (size[d] <= 256)
    total = sum(size.values())
    assert len([c for c, n in load.items() if n]) <= total / 256 * 1.1 + len({r.curve_range for r in out})
    # Copies of one text share a cell of the curve and are still cut into ranges.
    assert sorted(map(tuple, out)) == sorted(map(tuple, pk.pack_containers(df, 256, range_tokens=2000).collect()))
    assert pk.pack_containers(df.limit(0), 256).count() == 0


# Problem 10

THINGS = ["parser", "socket", "buffer", "widget", "router", "kernel", "plugin", "cursor", "mapper", "linker"]
DOES = ["drops", "copies", "sorts", "locks", "merges", "splits", "renames"]
RUDE = ["You are a {} fool, go away.", "Nobody wants a {} clown like you here.", "Shut your mouth, you {} pig."]
HOW = ["filthy", "rotten", "stupid", "worthless", "brainless"]


def corpus(n, seed):
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        s = [f"The {rng.choice(THINGS)} {rng.choice(DOES)} the {rng.choice(THINGS)} after the {rng.choice(THINGS)} restarts." for _ in range(rng.randint(2, 6))]
        if rng.random() < 0.3:
            s.append(f"That {rng.choice(THINGS)} is rotten, throw it away.")
        rude = rng.random() < 0.3
        if rude:
            s.insert(rng.randint(0, len(s)), rng.choice(RUDE).format(rng.choice(HOW)))
        docs.append((i, " ".join(s), f" src{i % 3}"))
        for _ in range(rng.choice((1, 1, 2))):
            said = rude != (rng.random() < 0.04)
            labels.append((i, "abuse" if said else "clean", rude))
    return docs, labels, {l[0]: l[2] for l in labels}


def test_offence_on_held_out_texts_and_spellings(spark):
    docs, labels, truth = corpus(600, 5)
    held = set(range(300, 600))
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    lab = spark.createDataFrame([l[:2] for l in labels if l[0] not in held] + [(1, None), (2, "nonsense"), (99999, "abuse")], "doc_id long, label string")
    dressed = ["You are a f i l t h y fool, go away.", "YOU ARE A F​ILTHY FOOL, GO AWAY", "You are a r0tt3n f00l, go away.", "Nobody wants a s****d clown like you here", "You are a filthyyyy fooool, go away!!!"]
    calm = ["The rotten parser drops the plugin.", "", None, "x" * 100000, "The parser drops the buffer. " * 3000]
    more = spark.createDataFrame([(5000 + i, t, None) for i, t in enumerate(dressed)] + [(6000 + i, t, "s") for i, t in enumerate(calm)], d.schema)
    out = {r.doc_id: r for r in of.score_offence(d.unionByName(more), lab).collect()}
    assert len(out) == len(docs) + len(dressed) + len(calm)
    wrong = [i for i in held if (out[i].score >= 0.5) != truth[i]]
    assert len(wrong) <= 6, wrong
    assert all(out[5000 + i].score >= 0.5 for i in range(len(dressed))), [(i, out[5000 + i].raw_score) for i in range(len(dressed))]
    assert all(out[6000 + i].score < 0.5 for i in range(len(calm)))
    assert out[5000].kind == "abuse" and out[5000].example and out[6001].example == ""
    r = {x.source: (x.documents, x.offending) for x in of.rates(spark.createDataFrame(list(out.values()))).collect()}
    assert sum(n for n, _ in r.values()) == len(out) and {"src0", "src1", "src2", "s", None} == set(r)


def test_offence_sample_holds_all_labelled(spark):
    d = spark.range(6000).selectExpr("id as doc_id", "concat('Text no. ', id) as text", "'s' as source")
    lab = d.selectExpr("doc_id", "if(doc_id % 4 = 0, 'abuse', 'clean') as label")
    assert len(of.labelled_sample(d, lab)) == 6000


def test_offence_long_text_drops_no_other(spark, monkeypatch):
    monkeypatch.setattr(of, "MAX_CHARS", 1000)
    lab = spark.range(40).selectExpr("id as doc_id", "'clean' as label")
    first = lab.selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h").first().doc_id
    d = lab.selectExpr("doc_id", f"if(doc_id = {first}, repeat('x', 1001), 'Text') as text", "'s' as source")
    assert {r[0] for r in of.labelled_sample(d, lab)} == set(range(40)) - {first}


def test_offence_in_long_sentences():
    """A short insult in a long sentence without full stops, wherever it stands."""
    docs, labels, truth = corpus(400, 5)
    ix = of.fit([(i, t, {"clean": int(not truth[i]), "abuse": int(truth[i])}) for i, t, _ in docs])
    filler = "the parser drops the buffer after the socket restarts the router locks the cursor after the mapper restarts the kernel sorts the widget after the linker restarts the plugin merges".split()
    for at in range(0, len(filler) + 1, 3):
        text = " ".join([*filler[:at], "you are a filthy fool", *filler[at:]])
        assert of.worst(ix, text)[0] >= 0.5, at
    assert of.worst(ix, " ".join(filler))[0] == 0


def test_offence_without_labels_or_texts(spark):
    d = spark.createDataFrame([(1, "You fool", "s"), (2, None, None)], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, label string")
    assert [r.raw_score for r in of.score_offence(d, none).collect()] == [0.0, 0.0]
    assert of.score_offence(d.limit(0), none).count() == 0


def test_rows_by_hashes_equal_texts_one_by_one():
    """Long and empty sentences, repeats, masked words, signs that break lines: the bounds over whole batches lose nothing."""
    docs, labels, truth = corpus(300, 12)
    ix = of.fit([(i, t, {"clean": int(not truth[i]), "abuse": int(truth[i])}) for i, t, _ in docs])
    rng = random.Random(4)
    words = "you are a filthy fool go away shut your mouth rotten clown pig nobody wants parser drops the f****y buffer after restarts".split()
    odd = [" ".join(rng.choice(words) for _ in range(rng.choice((1, 3, 12, 15, 17, 39, 41, 90)))) + rng.choice((".", "\n\n", "! ", "\x1e You pig")) for _ in range(300)]
    texts = [t for _, t, _ in corpus(150, 13)[0]] + odd + ["", "fool " * 60, "you " * 15 + "are a filthy fool", "\n.\n. !"] + [" ".join(odd[i : i + 5]) for i in range(0, 300, 5)]
    h = [of.hashed(t) for t in texts]
    got = of.worst_of_rows(ix, [x[2] for x in h], [x[0] for x in h], [x[1] for x in h])
    want = [of.worst(ix, t) for t in texts]
    assert got == want and sum(w[0] >= 0.5 for w in want) > 50
    # The same after it is sent.
    sent = pickle.loads(pickle.dumps(ix))
    assert of.worst_of_rows(sent, [x[2] for x in h], [x[0] for x in h], [x[1] for x in h]) == want
    some = [a + b + c for a in "bcdfg" for b in "hjklm" for c in "npqrs"]
    for n in (1, 16, 17, 40, 41, 100):
        assert of.windows_of(n) == tuple((some.index(p[0]), len(p)) for p in of.passages(" ".join(some[:n])))


def test_counts_cover_the_corpus(spark):
    """The weights are those of all documents: equal to counts made in one piece, whatever the partitions."""
    docs, _, _ = corpus(200, 2)
    d = spark.createDataFrame(docs + [(9999, None, None), (9998, "", "s")], "doc_id long, text string, source string")
    rows, w = of.hash_corpus(d.repartition(3))
    counts, n = np.zeros(of.BUCKETS, "int64"), 0
    for _, t, _ in docs:
        h, m, _ = of.hashed(t)
        n += of.add_counts(counts, of.keys_of(h), np.frombuffer(m, "int32"))
    assert rows.count() == 202 and np.array_equal(w.table, of.Weights(counts, n).table)
    assert w.of("parser") == w.of_keys(np.array([of.feature_key("parser")], "uint64"))[0] and w.of(("the", "parser")) > w.of("the")


def test_bounds_lose_no_neighbour():
    """Pruned scores equal those of plain cosines over all examples."""
    docs, labels, _ = corpus(200, 9)
    count = {}
    for i, l, _ in labels:
        count.setdefault(i, {"clean": 0, "abuse": 0})[l] += 1
    ix = of.fit([(i, t, count[i]) for i, t, _ in docs])
    vectors = [dict(ix.vector(t)) for t in [*map(str.split, ix.text), *map(list, ix.clean)]]
    tried = 0
    for _, t, _ in corpus(60, 11)[0]:
        for s in of.sentences(t):
            for p in of.split(s):
                q = dict(ix.vector(p))
                sims = np.array([sum(x * v.get(f, 0) for f, x in q.items()) for v in vectors])
                score, near, sim = ix.nearest(p)
                best = sims[: ix.n_bad].max()
                assert (near >= 0) == (best >= ix.min_sim) or abs(best - ix.min_sim) < 1e-5
                if near >= 0:
                    tried += 1
                    assert abs(sim - best) < 1e-5
                    top = np.sort(sims)[-ix.k]
                    clear = sims[sims > top + 1e-5]
                    if len(clear) < ix.k:
                        continue
    assert tried > 10
