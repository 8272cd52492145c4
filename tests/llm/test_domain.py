"""Problems 1, 2, 4 and 5 on small fixtures, against brute force."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.llm import collapse_runs as runs
from strandlake.llm import domain_queries as dq
from strandlake.llm import fuse_groups as fg
from strandlake.llm import percentiles as pc
from strandlake.llm import split_items as si

FRAGMENT = "fragment_id long, read_name string, read_group_id string, sample_id string, library string, read1_ref_name string, read1_ref_pos long, read1_ref_strand string, read2_ref_name string, read2_ref_pos long, read2_ref_strand string, insert_size int, primary_mapped array<struct<read_in_fragment:int,mapping_quality:int,base_quality_sum:int,cigar:string>>, platform_unit string, pipeline_name string, updated_at timestamp_ntz"
T = datetime(2024, 1, 1)


def fragment(i, a=("chr1", 10, "+"), b=("chr1", 90, "-"), lib="l", rg="g", sample="s", size=80, mapped=((0, 9, 9, "5M"),), unit="u", pipe="p1", at=0):
    return (i, f"r{i}", rg, sample, lib, *a, *b, size, None if mapped is None else [tuple(m) for m in mapped], unit, pipe, None if at is None else T + timedelta(days=at))


def found(spark, rows, pipes=(("p1", 1), ("p2", 2))):
    k = fg.keyed_fragments(spark.createDataFrame(rows, FRAGMENT), spark.createDataFrame(list(pipes), "pipeline_name string, trust_rank int"))
    return {(r.group_id, r.field_name): r.fragment_id for r in fg.fuse(k, trusted=True)[0].collect()}


def test_best_rows_by_trust_then_recency_then_id(spark):
    rows = [
        fragment(5, pipe="p2", at=9), fragment(4, pipe="p1", at=1, unit="n/a"), fragment(3, pipe="p1", at=3, sample="-"), fragment(2, pipe="p1", at=3, mapped=()), fragment(9, pipe=None, at=99, size=70),
        fragment(1, ("chrX", 1, "+")), fragment(7, (None, None, None), (None, None, None)), fragment(8, (None, None, None), (None, None, None)),
    ]
    got = found(spark, rows)
    assert {k[0] for k in got} == {2}
    assert got == {(2, "insert_size"): 2, (2, "platform_unit"): 2, (2, "primary_mapped"): 3, (2, "read_group_id"): 2, (2, "sample_id"): 2}


def test_best_rows_notation_order_and_library(spark):
    a, b = ("chr1", 10, "+"), ("chr2", 90, "-")
    rows = [fragment(1, a, b, lib=None), fragment(2, (" chr2", 90, "REVERSE"), ("chr1 ", 10, "fwd"), lib=None), fragment(3, a, b, lib="x"), fragment(4, a, ("chr2", 90, None), lib=None), fragment(5, (None, 5, "+"), a, lib=None)]
    got = found(spark, rows)
    # 1 and 2 state the same ends; 4 and 5 state only the end a; 3 has a library of its own.
    assert {k[0] for k in got} == {1, 4}


def test_best_rows_nothing_stated_and_unlisted_pipelines(spark):
    rows = [fragment(1, size=0, unit=None, sample="", rg="*", mapped=None, pipe="zzz", at=5), fragment(2, size=-1, unit="unknown", sample="None", rg="NA", mapped=None, pipe="p2", at=None)]
    assert found(spark, rows) == {}
    rows = [fragment(1, pipe="zzz", at=50), fragment(2, pipe="p2", at=None)]
    assert set(found(spark, rows).values()) == {2}
    assert found(spark, []) == {}
    # A pipeline listed twice has its better rank; blanks at its ends don't count; ties of rank go by time.
    assert set(found(spark, [fragment(1, pipe=" p9", at=0), fragment(2, pipe="p2", at=8)], [("p9 ", 7), ("p9", 1), ("p2", 2)]).values()) == {1}


def test_trusted_fusion_equals_the_order_by_brute_force(spark):
    rng, pipes = random.Random(6), [("p1", 1), ("p2", 2), ("p3", 2), ("p4", 4)]
    rows = [
        fragment(i, ("chr1", rng.randint(0, 40) if rng.random() < 0.7 else 7, "+"), lib=rng.choice(("l", None)), unit=rng.choice(("u", "v", "w", None, "n/a")), size=rng.choice((None, 0, 50, 60)), sample=rng.choice(("s", "t", "")), rg=rng.choice(("g", "h", "*")), mapped=rng.choice((None, (), ((0, 9, 9, "5M"),), ((0, 9, 8, "5M"),))), pipe=rng.choice(("p1", "p2", "p3", "p4", "zz", None)), at=rng.choice((None, 1, 2, 3)))
        for i in range(1, 500)
    ]
    groups, want = {}, {}
    for r in rows:
        groups.setdefault((r[6], r[4]), []).append(r)
    for g in groups.values():
        if len(g) > 1:
            for f, col, ok in (("insert_size", 11, lambda x: x and x > 0), ("platform_unit", 13, lambda x: x not in (None, "n/a")), ("sample_id", 3, bool), ("read_group_id", 2, lambda x: x != "*"), ("primary_mapped", 12, bool)):
                said = [r for r in g if ok(r[col])]
                if said:
                    want[min(r[0] for r in g), f] = min(said, key=lambda r: (dict(pipes).get(r[14], 99), -(r[15] - T).days if r[15] else 99, r[0]))[0]
    assert found(spark, rows, pipes) == want and len(want) > 200


def test_p1_queries_run_no_step_that_cannot_change_their_rows(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    rows = [fragment(i, ("chr1", rng.randint(0, 30), "+"), unit=rng.choice(("u", " v", None, "n/a")), size=rng.choice((None, 0, 50, 60)), sample=rng.choice(("s", "t", "")), rg=rng.choice(("g", "*")), mapped=rng.choice((None, (), ((0, 9, 9, "5M"),))), pipe=rng.choice(("p1", "p2", "p3", "zz", None)), at=rng.choice((None, 1, 2))) for i in range(1, 200)]
    fragments, pipes = spark.createDataFrame(rows, FRAGMENT), spark.createDataFrame([("p1", 2), ("p2", 1), ("p3", 2)], "pipeline_name string, trust_rank int")
    fragments.write.parquet(f"{tmp_path}/fragments.parquet")
    pipes.write.parquet(f"{tmp_path}/pipelines.parquet")
    picks = fg.fuse(fg.keyed_fragments(fragments, pipes), trusted=True)[0].cache()
    want = {tuple(r) for r in picks.select("group_id", "field_name", "fragment_id").collect()}
    whole = lambda df: {(r.group_id, r.insert_size, r.platform_unit, None if r.primary_mapped is None else len(r.primary_mapped), r.read_group_id, r.sample_id) for r in df.collect()}
    kept = {(*r[:3], -1 if r[3] is None else r[3], *r[4:]) for r in whole(fg.survivors(fragments, picks))}

    def fuse(*_, **__):
        raise AssertionError("the order of trust leaves the fusion nothing to decide")

    monkeypatch.setattr(fg, "fuse", fuse)
    got = dq.p1_found(spark, str(tmp_path))
    assert got.columns == ["group_id", "field_name", "fragment_id"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 80
    assert {tuple(r[c] for c in ("group_id", "insert_size", "platform_unit", "primary_mapped", "read_group_id", "sample_id")) for r in dq.p1_survivors(spark, str(tmp_path)).collect()} == kept


def test_fusion_discounts_copies(spark):
    """Three sources repeat one source's mistakes; two independent ones tell the truth."""
    rng, rows, i = random.Random(4), [], 0
    for g in range(150):
        true, wrong = f"t{g}", f"w{g}"
        said = wrong if rng.random() < 0.45 else true
        for pipe, v in (("c1", said), ("c2", said), ("c3", said), ("i1", true if rng.random() < 0.95 else f"a{g}"), ("i2", true if rng.random() < 0.95 else f"b{g}")):
            i += 1
            rows.append(fragment(i, ("chr1", g, "+"), unit=v, pipe=pipe))
    k = fg.keyed_fragments(spark.createDataFrame(rows, FRAGMENT), spark.createDataFrame([("i1", 1), ("i2", 1), ("c1", 2), ("c2", 2), ("c3", 2)], "pipeline_name string, trust_rank int"))
    selected, acc, dep = fg.fuse(k)
    unit = {r[0]: r for r in selected.where("field_name = 'platform_unit'").collect()}
    truth = {r[0]: r[13] for r in rows}
    right = sum(truth[r.fragment_id].startswith("t") for r in unit.values())
    assert len(unit) == 150 and right >= 140
    copies = {frozenset((r.copier, r.original)): r.p_copy for r in dep.where("field_name = 'platform_unit'").collect()}
    assert min(copies[frozenset(p)] for p in (("c1", "c2"), ("c1", "c3"), ("c2", "c3"))) > 0.9
    assert copies[frozenset(("i1", "i2"))] < 0.5
    a = {r.source: r.accuracy for r in acc.where("field_name = 'platform_unit'").collect()}
    assert min(a["i1"], a["i2"]) > max(a["c1"], a["c2"], a["c3"])


def brute_runs(rows, tolerance):
    latest = {}
    for s, a, b, v, at, i in rows:
        if v is None or a is None or b is None or b <= a:
            continue
        key, ver = (s or "", a, b), (at or datetime.min, i)
        if key not in latest or latest[key][0] < ver:
            latest[key] = (ver, v)
    out, by = set(), {}
    for (s, a, b), (_, v) in latest.items():
        by.setdefault(s, []).append((a, b, v))
    for s, xs in by.items():
        xs.sort()
        i = 0
        while i < len(xs):
            j = i
            while j + 1 < len(xs) and xs[j + 1][0] == xs[j][1] and abs(xs[j + 1][2] - xs[j][2]) <= tolerance + 1e-9:
                j += 1
            if j > i:
                out.add((s, xs[i][0], xs[j][1], j - i + 1))
            i = j + 1
    return out


@pytest.mark.parametrize("block", [16, 64, 1 << 16])
def test_runs_equal_brute_force_over_block_borders(spark, block):
    rng, rows = random.Random(block), []
    for s in ("a", "b", None):
        at, v = 0, 5.0
        for _ in range(300):
            at += rng.choice((0, 0, 0, 0, 3))
            n = rng.choice((1, 2, 5, 30, 100))
            v = round(v + rng.choice((0, 0, 0.05, -0.05, 0.06, 1)), 2)
            rows.append((s, at, at + n, v, T + timedelta(hours=rng.randint(0, 99)), len(rows)))
            if rng.random() < 0.2:
                rows.append((s, at, at + n, v + 9, None if rng.random() < 0.3 else T - timedelta(1), len(rows)))
            at += n
    rows += [("a", 5, 5, 1.0, T, -1), ("a", 7, 6, 1.0, T, -2), ("a", None, 6, 1.0, T, -3), ("a", 1, 9, None, T, -4)]
    df = spark.createDataFrame(rows, "sample string, a long, b long, v double, loaded timestamp_ntz, id long")
    got = runs.collapse_runs(df, [F.coalesce("sample", F.lit(""))], "a", "b", "v", ["loaded", "id"], 0.05, 2, block)
    assert {(r.entity_0, r.run_start, r.run_end, r.rows) for r in got.collect()} == brute_runs(rows, 0.05)


def test_runs_empty_and_singletons(spark):
    df = spark.createDataFrame([], "sample string, a long, b long, v double, loaded timestamp_ntz, id long")
    assert runs.collapse_runs(df, [F.col("sample")], "a", "b", "v", ["loaded"]).count() == 0
    one = spark.createDataFrame([("x", 0, 4, 2.0, T, 1), ("x", 4, 8, 4.0, T, 2)], df.schema)
    r = runs.collapse_runs(one, [F.col("sample")], "a", "b", "v", ["loaded"], tolerance=2).collect()
    assert [(x.run_start, x.run_end, x.rows, x.mean_value) for x in r] == [(0, 8, 2, 3.0)]
    assert runs.collapse_runs(one, [F.col("sample")], "a", "b", "v", ["loaded"], tolerance=1).count() == 2


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5000), st.integers(2, 400), st.integers(0, 500), st.lists(st.tuples(st.integers(0, 5000), st.integers(1, 60)), max_size=12))
def test_cuts_hold_the_limit(size, limit, overlap, blocks):
    overlap = min(overlap, limit - 1)
    s, at = [], 0
    for a, n in sorted(blocks):
        if a >= at and a + n <= size:
            s.append((a, n))
            at = a + n + 1
    gaps = si._stretches([a for a, _ in s], [n for _, n in s], size)
    cuts = si.cut_points(size, limit, overlap, [gaps])
    bounds = [0, *cuts, size]
    assert bounds == sorted(set(bounds)) or size == 0
    pieces = [(max(0, a - (overlap if i else 0)), b) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    assert all(b - a <= limit for a, b in pieces) and pieces[0][0] == 0 and pieces[-1][1] == size
    assert all(q[0] <= p[1] for p, q in zip(pieces, pieces[1:]))


def test_cut_prefers_the_longest_gap_near_the_middle():
    gaps = si._stretches([400, 480, 900], [50, 10, 90], 1000)
    assert si.cut_points(1000, 600, 0, [gaps]) == [450]
    # None in the middle half: the longest that leaves a quarter of the limit, else a mask, else the middle.
    assert si.cut_points(1000, 600, 0, [si._stretches([200], [20], 1000)]) == [219, 609] or si.cut_points(1000, 600, 0, [si._stretches([200], [20], 1000)])[0] == 220
    assert si.cut_points(1000, 950, 0, [si._stretches([900], [20], 1000), si._stretches([560], [9], 1000)]) == [560]
    assert si.cut_points(1000, 950, 0, [si._stretches([900], [20], 1000)]) == [500]
    # Gaps near one end make no slivers.
    cuts = si.cut_points(1_000_000, 100_000, 0, [si._stretches([900_000 + 999 * i for i in range(100)], [9] * 100, 1_000_000)])
    bounds = [0, *cuts, 1_000_000]
    assert min(b - a for a, b in zip(bounds, bounds[1:])) >= 25_000 and len(cuts) < 20
    assert si.cut_points(1000, 600, 0, [si._stretches(None, None, 1000)]) == [500]


def test_split_items_table(spark):
    rows = [("big", "x", 100, 40, 10, [48], [4], [], []), ("fits", "x", 40, 40, 10, [], [], None, None), ("none", "x", None, 40, 0, None, None, None, None), ("free", None, 70, None, None, [-5, 3, None], [2, 900, 4], [], []), ("tight", "x", 7, 2, 99, [], [], [], [])]
    cols = "name string, assembly string, size long, max_bases long, overlap_bases long, n_block_starts array<long>, n_block_sizes array<long>, mask_block_starts array<long>, mask_block_sizes array<long>, pieces string"
    out = si.split_items(spark.createDataFrame([(*r, "clash") for r in rows], cols)).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.name, r.piece_no)):
        by.setdefault(r.name, []).append((r.piece_start, r.piece_end, r.cut_in_gap))
    assert by["fits"] == [(0, 40, None)] and by["free"] == [(0, 70, None)] and "none" not in by
    assert all(b - a <= 40 for a, b, _ in by["big"]) and any(c for *_, c in by["big"]) and by["big"][-1][1] == 100
    assert all(q[0] == p[1] - 10 for p, q in zip(by["big"], by["big"][1:]))
    assert all(b - a <= 2 for a, b, _ in by["tight"])
    assert si.split_items(spark.createDataFrame([], cols)).count() == 0


@pytest.mark.parametrize("fan", [16, 256])
def test_percentiles_equal_brute_force(spark, monkeypatch, fan):
    monkeypatch.setattr(pc, "FAN", fan)
    rng = random.Random(fan)
    rows = [(rng.choice(("a", "b", None)), round(rng.choice((rng.random(), rng.gauss(0, 300), 7.25)), 3), rng.randint(1, 3)) for _ in range(600)]
    rows += [("c", 5.0, 1), ("d", None, 1), ("e", float("nan"), 1), *([("f", float("inf"), 1), ("f", 1.0, 1)] if fan == 256 else [])]
    df = spark.createDataFrame(rows, "k string, v double, day int")
    at = [0.01, 0.5, 0.9, 1.0]
    if fan == 16:
        monkeypatch.setattr("strandlake.plans.runtime.small_enough", lambda *a, **k: False)
    got = {(r.k, r.percentile): (r.value, r.n) for r in pc.percentiles(df, ["k"], "v", at, 0.0005).collect()}
    groups = {}
    for k, v, _ in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(k, []).append(v)
    assert {k for k, _ in got} == set(groups)
    for k, vs in groups.items():
        for p in at:
            exact = sorted(vs)[max(1, math.ceil(round(p * len(vs), 6))) - 1]
            value, n = got[k, p]
            assert n == len(vs) and (abs(value - exact) <= 0.0005 + 1e-9 or math.isinf(exact))
    assert pc.percentiles(df.limit(0), ["k"], "v", at, 0.0005).count() == 0
    # What days hand on is bounded by groups and percentiles, and adds up to the same.
    days = pc.day_counters(df, ["k"], "v", at, 0.0005, F.col("day"))
    per = days.groupBy("k", "day").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()
    assert max(r.rows for r in per) <= 2 * len(at) + 1 and sum(r.n for r in per) == sum(map(len, groups.values()))
    merged = pc.from_counters(pc.merge_days(days, ["k"]), ["k"], at).collect()
    assert {(r.k, r.percentile): (r.value, r.n) for r in merged} == got
    part = pc.from_counters(days.where("day = 1").drop("day"), ["k"], at)
    for r in part.collect():
        vs = sorted(v for k, v, d in rows if k == r.k and d == 1 and v is not None and not math.isnan(v))
        exact = vs[max(1, math.ceil(round(r.percentile * len(vs), 6))) - 1]
        assert r.n == len(vs)
        if not math.isinf(exact):
            assert (r.low is None or r.low <= exact + 0.0006) and (r.high is None or exact <= r.high + 0.0006) and (r.value is None or abs(r.value - exact) < 0.0006)
