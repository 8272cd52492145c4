import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import intervals as iv
from strandlake.operators import joins as jn
from strandlake.plans.islands import collapse_adjacent, depth_runs, merge_overlapping

R = "n1 string, s1 long, e1 long, t1 string, n2 string, s2 long, e2 long, t2 string"


def one(spark, expr, a, b):
    x, y = (iv.Region(*(F.col(f"{c}{i}") for c in "nset")) for i in (1, 2))
    return spark.createDataFrame([(*a, *b)], R).select(expr(x, y).alias("v")).collect()[0].v


@pytest.mark.parametrize(
    ("f", "a", "b", "want"),
    [
        (iv.distance, ("c", 0, 10, None), ("c", 10, 20, None), 1), (iv.distance, ("c", 0, 10, None), ("c", 5, 20, None), 0), (iv.distance, ("c", 0, 10, None), ("d", 5, 20, None), None), (iv.distance, ("c", 0, 10, "+"), ("c", 5, 20, "-"), None), (iv.unstranded_distance, ("c", 30, 40, "+"), ("c", 5, 20, "-"), 11),
        (iv.overlaps, ("c", 0, 10, None), ("c", 10, 20, None), False), (iv.covers, ("c", 0, 10, "+"), ("c", 9, 20, "-"), True), (iv.overlaps, ("c", 0, 10, "+"), ("c", 9, 20, "-"), False), (iv.contains, ("c", 0, 10, None), ("c", 0, 10, None), True), (iv.is_adjacent, ("c", 0, 10, None), ("c", 10, 20, None), True),
        (iv.overlaps_by, ("c", 0, 10, None), ("c", 7, 20, None), 3), (iv.overlaps_by, ("c", 0, 10, None), ("c", 17, 20, None), None),
    ],
)
def test_algebra(spark, f, a, b, want):
    assert one(spark, f, a, b) == want


def test_algebra_of_structs(spark):
    a, b = ("c", 0, 10, None), ("c", 4, 6, None)
    assert [(r.start, r.end) for r in one(spark, iv.subtract, a, b)] == [(0, 4), (6, 10)]
    assert one(spark, iv.subtract, b, a) == []
    assert one(spark, iv.merge, ("c", 0, 10, None), ("c", 12, 20, None)) is None
    assert one(spark, lambda x, y: iv.merge(x, y, 3), ("c", 0, 10, None), ("c", 12, 20, None)).end == 20
    assert one(spark, iv.intersection, a, b).end == 6
    assert one(spark, lambda x, y: iv.pad(x, 5, 2).start, ("c", 3, 10, None), b) == 0
    assert iv.parse_regions("chr1:10-20,chr2:5+,chr3:7,chr4") == [("chr1", 10, 20), ("chr2", 5, iv.OPEN_END), ("chr3", 7, 8), ("chr4", 0, iv.OPEN_END)]
    with pytest.raises(ValueError):
        iv.parse_regions("c:9-3")


def rows(rng, n, long_share=0.05):
    out = []
    for i in range(n):
        s = rng.randint(0, 3000)
        size = rng.randint(500, 2500) if rng.random() < long_share else rng.choice((0, 1, 5, 30))
        out.append((i, rng.choice(("a", "b", None)), s, None if rng.random() < 0.03 else s + size))
    return out


SIDE = "{0} long, referenceName string, start long, end long"


@pytest.mark.parametrize("flank", [0, 40])
@pytest.mark.parametrize("broadcast", ["left", "right", None])
def test_joins_equal_the_plain_condition(spark, flank, broadcast):
    rng = random.Random(flank)
    a, b = rows(rng, 120), rows(rng, 90, 0.2)
    l, r = spark.createDataFrame(a, SIDE.format("i")), spark.createDataFrame(b, SIDE.format("j"))
    want = {(i, j) for i, n, s, e in a for j, m, t, u in b if n and n == m and e is not None and u is not None and max(0, s - flank) < u and e + flank > t}
    assert len(want) > 100
    inner = jn.pairs(l, r, flank=flank, grid=jn.choose_grid(l, r, jn.Fields(), jn.Fields(), flank), broadcast=broadcast)
    got = [(x.left.i, x.right.j) for x in inner.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    kw = {"flank": flank, "broadcast": broadcast, "left_id": "i", "right_id": "j"}
    hit_l, hit_r = {i for i, _ in want}, {j for _, j in want}
    key = lambda p: tuple(-1 if x is None else x for x in p)
    full = jn.region_join(l, r, "full", **kw).select(F.col("left.i").alias("i"), F.col("right.j").alias("j")).collect()
    lone_l, lone_r = [(i, None) for i, *_ in a if i not in hit_l], [(None, j) for j, *_ in b if j not in hit_r]
    assert sorted(map(key, map(tuple, full))) == sorted(map(key, [*want, *lone_l, *lone_r]))
    assert {x.i for x in jn.region_join(l, r, "left_semi", **kw).collect()} == hit_l
    assert {x.i for x in jn.region_join(l, r, "left_anti", **kw).collect()} == {i for i, *_ in a} - hit_l
    by = {x.left.i: sorted(y.j for y in x.right) for x in jn.region_join(l, r, "left", "left", **kw).collect()}
    assert by == {i: sorted(j for k, j in want if k == i) for i, *_ in a}
    odd = [(x.left and x.left.i, len(x.right)) for x in jn.region_join(l, r, "right", "left", **kw).collect()]
    assert sorted(k for k, _ in odd if k is not None) == [i for i, *_ in a] and sum(1 for k, n in odd if k is None and n == 1) == len(lone_r)
    by_r = {x.right.j: len(x.left) for x in jn.region_join(l, r, "right", "right", **kw).collect()}
    assert by_r == {j: sum(k == j for _, k in want) for j, *_ in b}


def test_joins_without_ids_and_with_strands(spark):
    l = spark.createDataFrame([("c", 0, 9, "+"), ("c", 0, 9, "+"), ("c", 50, 60, "-")], "referenceName string, start long, end long, strand string")
    r = spark.createDataFrame([("c", 5, 6, "+"), ("c", 55, 56, "+")], l.schema)
    f = jn.Fields(strand="strand")
    assert jn.region_join(l, r, lf=f, rf=f).count() == 2
    assert jn.region_join(l, r, "left", lf=f, rf=f).count() == 3
    assert jn.region_join(l, r, "inner", "right", lf=f, rf=f).select(F.size("left").alias("n")).collect()[0].n == 2
    assert jn.region_join(l, r.limit(0), "full").count() == 3 and jn.region_join(l.limit(0), r).count() == 0


@pytest.mark.parametrize("broadcast", ["left", None])
def test_wide_regions_on_either_side(spark, monkeypatch, broadcast):
    """Many levels, on both sides, with and without knowing the coarse bins that hold a wide row."""
    rng = random.Random(9)
    size = lambda: 0 if rng.random() < 0.05 else int(2 ** rng.uniform(0, 24 if rng.random() < 0.04 else 6))
    make = lambda n: [(i, "c", s, s + size()) for i, s in enumerate(rng.randint(0, 1 << 22) >> rng.choice((0, 8)) for _ in range(n))]
    a, b = make(300), make(250)
    l, r = spark.createDataFrame(a, SIDE.format("i")), spark.createDataFrame(b, SIDE.format("j"))
    want = {(i, j) for i, _, s, e in a for j, _, t, u in b if s < u and e > t}
    grid = jn.choose_grid(l, r, jn.Fields(), jn.Fields(), 0)
    assert grid.top > 3 and grid.wide_left and grid.wide_right
    for rows in (jn.BROADCAST_ROWS, 200):
        monkeypatch.setattr(jn, "BROADCAST_ROWS", rows)
        got = [(x.left.i, x.right.j) for x in jn.pairs(l, r, broadcast=broadcast).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        p = jn.prepare(l)
        assert p.small == (rows > 2000) and {(x.left.i, x.right.j) for x in jn.pairs(p, r).collect()} == want
    p = jn.prepare(l)
    hit = {j for _, j in want}
    assert jn.region_join(p, r, "right").count() == len(want) + len(b) - len(hit)
    assert {x.right.j: len(x.left) for x in jn.region_join(p, r, "inner", "right").collect()} == {j: sum(k == j for _, k in want) for j in hit}
    assert jn.region_join(p, r, "right", "right", right_id="j").count() == len(b) and jn.pairs(jn.prepare(l.limit(0)), r).count() == 0
    with pytest.raises(ValueError):
        jn.region_join(p, r, "left")


def test_grouped_joins_reduce_partners_before_the_shuffle(spark):
    """Aggregates in place of the array: same numbers, and no pair is gathered."""
    rng = random.Random(4)
    make = lambda n: [(i, rng.choice("ab"), s, s + rng.choice((0, 5, 40, 900))) for i, s in enumerate(rng.randint(0, 2000) for _ in range(n))]
    a, b = make(60), make(50) + [(99, "c", 0, 5)]
    l, r = spark.createDataFrame(a, SIDE.format("i")), spark.createDataFrame(b, SIDE.format("j"))
    want = [(i, j) for i, m, s, e in a for j, n, t, u in b if m == n and s < u and e > t]
    ids = {"left_id": "i", "right_id": "j"}
    key = lambda p: tuple(-1 if x is None else x for x in p)
    total = lambda k, at: (sum(p[at] == k for p in want), sum(p[1 - at] for p in want if p[at] == k))
    by_left, by_right = [F.count("*").alias("n"), F.sum("right.j").alias("ids")], [F.count("*").alias("n"), F.sum("left.i").alias("ids")]
    for how in ("inner", "left", "right", "full"):
        kept = [i for i, *_ in a if how != "inner" or total(i, 0)[0]]
        lone = [(None, 1, j) for j, *_ in b if how in ("right", "full") and not total(j, 1)[0]]
        g = jn.region_join(l, r, how, "left", agg=by_left, broadcast=None, **ids)
        assert "collect_list" not in g._jdf.queryExecution().executedPlan().toString()
        assert sorted((key((x[0], x[1] or 0, x[2] or 0)) for x in g.select("left.i", "n", "ids").collect())) == sorted(map(key, [*((i, *total(i, 0)) for i in kept), *lone]))
    for how in ("inner", "right"):
        want_r = sorted((j, *total(j, 1)) for j, *_ in b if how != "inner" or total(j, 1)[0])
        for side in (l, jn.prepare(l)):
            assert sorted((x[0], x[1] or 0, x[2] or 0) for x in jn.region_join(side, r, how, "right", right_id="j", agg=by_right).select("right.j", "n", "ids").collect()) == want_r
    with pytest.raises(ValueError):
        jn.region_join(l, r, agg=by_left)


def test_prepared_side_is_sent_only_within_the_bounds(spark, monkeypatch):
    """No copies are written, and Spark's estimate, which doesn't know of them, doesn't decide."""
    monkeypatch.setattr(jn, "BROADCAST_ROWS", 80)
    l = spark.range(100).select(F.col("id").alias("i"), F.lit("c").alias("referenceName"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 10).alias("end"))
    r = l.withColumnRenamed("i", "j")
    p = jn.prepare(l)
    assert not p.small and p.rows.count() == 100
    g = jn.pairs(p, r)
    assert "BroadcastHashJoin" not in g._jdf.queryExecution().executedPlan().toString() and g.count() == 100


def test_right_outer_against_a_prepared_side_beyond_the_bounds(spark, monkeypatch):
    monkeypatch.setattr(jn, "BROADCAST_ROWS", 80)
    l = spark.range(100).select(F.col("id").alias("i"), F.lit("c").alias("referenceName"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 10).alias("end"))
    g = jn.region_join(jn.prepare(l), l.withColumn("start", F.col("start") + 500).withColumn("end", F.col("end") + 500), "right", right_id="i")
    assert "SortMergeJoin" in g._jdf.queryExecution().executedPlan().toString()
    assert g.count() == 100 and g.where("left is null").count() == 50


def test_one_wide_region_costs_only_its_overlaps(spark):
    """Narrow rows don't meet at the level of a wide one: the candidates of the join are those of the narrow bins and of the wide region."""
    l = spark.range(20_000).select(F.col("id").alias("i"), F.lit("c").alias("referenceName"), (F.col("id") * 50).alias("start"), (F.col("id") * 50 + 10).alias("end"))
    wide = spark.range(1).select(F.col("id").alias("i"), F.lit("c").alias("referenceName"), F.lit(0).cast("long").alias("start"), F.lit(100_000_000).cast("long").alias("end"))
    r = l.unionByName(wide)
    grid = jn.choose_grid(l, r, jn.Fields(), jn.Fields(), 0)
    a, b = jn._binned(l, jn.Fields(), 0, grid, "left", None), jn._binned(r, jn.Fields(), 0, grid, "right", None)
    n, m = (x.groupBy(f"{s}_slot", f"{s}_bin").count().toDF("slot", "bin", f"n_{s}") for x, s in ((a, "left"), (b, "right")))
    assert n.join(m, ["slot", "bin"]).agg(F.sum(F.col("n_left") * F.col("n_right"))).first()[0] < 80_000
    assert jn.pairs(l, r, broadcast=None).count() == 40_000


@pytest.mark.parametrize("block", [8, 64, 1 << 16])
def test_islands_equal_brute_force(spark, block):
    rng = random.Random(block)
    data = [(rng.choice(("x", "y")), s, s + rng.choice((0, 1, 3, 9, 150))) for s in (rng.randint(0, 900) for _ in range(150))]
    df = spark.createDataFrame(data, "k string, start long, end long")
    depth = {}
    for k, s, e in data:
        for p in range(s, e):
            depth[k, p] = depth.get((k, p), 0) + 1

    def spans(value):
        out = []
        for k in ("x", "y"):
            p = 0
            while p < 1200:
                v = value(depth.get((k, p), 0))
                q = p
                while q < 1200 and value(depth.get((k, q), 0)) == v:
                    q += 1
                if v:
                    out.append((k, p, q, v))
                p = q
        return sorted(out)

    assert sorted(map(tuple, depth_runs(df, ["k"], block=block).collect())) == spans(lambda d: d)
    assert sorted((*r, True) for r in map(tuple, merge_overlapping(df, ["k"], block=block).select("k", "start", "end").collect())) == spans(bool)
    runs = depth_runs(df, ["k"], block=block).withColumn("odd", F.col("depth") % 2)
    got = sorted((r.k, r.start, r.end, r.odd) for r in collapse_adjacent(runs, ["k"], ["odd"], block=block).collect())
    assert [g for g in got if g[3]] == spans(lambda d: d % 2 if d else 0)
    assert merge_overlapping(df.limit(0), ["k"]).count() == 0
