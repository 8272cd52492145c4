import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strandlake.operators import orphans as op

T = datetime(2024, 1, 1)


def test_numbered_names_are_runs(spark):
    names = [f"sc_{i:04d}" for i in range(1, 900) if i != 500] + ["chr1", "chr2", "chrX", "7", "x" + "9" * 30, "sc#3", "sc_#4"]
    df = spark.createDataFrame([(n,) for n in names], "k string")
    stem, n = op.integer_key(F.col("k"), df.schema["k"].dataType)
    placed = df.select("k", stem.alias("stem"), n.alias("n"))
    assert placed.select("stem", "n").distinct().count() == len(names) and op.key_runs(placed).count() == 8


def test_integer_runs_and_missing(spark):
    rng = random.Random(1)
    keys = [rng.randint(-300, 200_000) for _ in range(300)] + list(range(65_000, 66_000)) + [None, 7, 7]
    refs = [(i, rng.choice((None, rng.randint(-400, 200_500), rng.randint(64_900, 66_100))), "x") for i in range(3000)]
    p, r = spark.createDataFrame([(k,) for k in keys], "k long"), spark.createDataFrame(refs, "id long, ref long, lo string")
    want = {i for i, v, _ in refs if v is not None and v not in set(keys)}
    got = op.missing_integers(r, "ref", p, "k")
    assert {x.id for x in got.collect()} == want and got.columns == r.columns
    runs = [(x.lo, x.hi) for x in op.integer_runs(p, "k").collect()]
    assert sum(b - a + 1 for a, b in runs) == len({k for k in keys if k is not None})
    assert op.missing_integers(r, "ref", p.limit(0), "k").count() == sum(v is not None for _, v, _ in refs)
    assert op.missing_integers(r.limit(0), "ref", p, "k").count() == 0


@pytest.mark.parametrize("bound", [None, 0])
def test_orphans_equal_brute_force_broadcast_and_salted(spark, bound, monkeypatch):
    rng = random.Random(2)
    at = lambda: T + timedelta(hours=rng.randint(0, 200))
    name = {"a": "sc_08", "b": "sc_09", "c": "sc_010", "d": "sc_10", "e": "e", "z": "sc_9", None: None}
    lives = [(rng.choice(("a", "b", "c", None)), rng.choice((None, at(), at())), rng.choice((None, at(), at(), at()))) for _ in range(25)] + [("d", T, T), ("e", T, None), ("e", T, None)]
    lives = [(name[k], s, e) for k, s, e in lives]
    refs = [(i, rng.choice(("a", "b", "c", "d", "e", "z", None)), rng.choice((at(), at(), at(), None)), "clash") for i in range(800)]
    refs = [(i, name[k], t, c) for i, k, t, c in refs]
    p = spark.createDataFrame(lives, "k string, s timestamp_ntz, e timestamp_ntz")
    r = spark.createDataFrame(refs, "id long, key string, t timestamp_ntz, k string")
    runs = op.life_runs(p, F.col("k"), F.col("s"), F.col("e"))
    if bound is not None:
        monkeypatch.setattr("strandlake.operators.orphans.join_bounded", lambda b, s, on, how, **kw: __import__("strandlake.plans.runtime", fromlist=["x"]).join_bounded(b, s, on, how, max_rows=0, **kw))
    got = {x.id: x.why for x in op.orphan_flag(r, F.col("key"), F.col("t"), runs, "why", "id").collect()}
    assert len(got) == len(refs)
    alive = lambda k, t: any(x == k and (s is None or (t is not None and s <= t)) and (e is None or t is None or t < e) and (e is None or s is None or s < e) for x, s, e in lives)
    for i, k, t, _ in refs:
        assert (got[i] is not None) == (k is not None and not alive(k, t)), (i, k, t, got[i])
    assert {got[i] for i, k, _, _ in refs if k == "sc_9"} == {"unknown"}
    assert op.orphan_flag(r.limit(0), F.col("key"), F.col("t"), runs, "why", "id").count() == 0
    none = op.life_runs(p.limit(0), F.col("k"), F.col("s"), F.col("e"))
    assert op.orphan_flag(r, F.col("key"), F.col("t"), none, "why", "id").where("why is not null").count() == sum(k is not None for _, k, _, _ in refs)
