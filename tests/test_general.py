"""Problems 6 and 7 on small fixtures, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import heavy_pairs as hp
from strandlake.operators import parse_lines as pl

ALIGNMENT = "reference_name string, read_group_sample_id string, read_mapped boolean, start_pos long, end_pos long, mapping_quality int, n string"


def test_pairs_equal_brute_force(spark):
    rng, rows = random.Random(1), []
    for _ in range(800):
        a = rng.randint(0, 400)
        rows.append((rng.choice(("c1", " c1", "c2", "*", "", None)), rng.choice(("s", "s ", "t", None)), rng.random() < 0.9, None if rng.random() < 0.05 else a, a + rng.choice((0, 1, 9, 60, -3, 500)), rng.choice((None, 0, 60)), "clash"))
    df = spark.createDataFrame(rows, ALIGNMENT)
    want = {}
    for r, s, m, a, b, q, _ in rows:
        key = ((r or "").strip(), (s or "").strip())
        if m and key[0] not in ("", "*") and key[1]:
            x = want.setdefault(key, [0, [], set()])
            x[0] += 1
            x[1] += [] if q is None else [q]
            x[2] |= set(range(a, b)) if a is not None and b > a else set()
    full = hp.pair_results(df).collect()
    assert {(r.reference_name, r.sample_id): (r.n, r.bases_covered) for r in full} == {k: (n, len(c)) for k, (n, _, c) in want.items()}
    assert all(abs(r.mean_mapq - np.mean(want[r.reference_name, r.sample_id][1])) < 1e-9 for r in full)
    assert sorted((r.reference_name, r.sample_id, r.bases_covered) for r in hp.bases_covered(df, 16).collect()) == sorted((r.reference_name, r.sample_id, r.bases_covered) for r in full)
    seqs, groups = spark.createDataFrame([("c1",), ("c1 ",), ("*",), (None,)], "seq_name string"), spark.createDataFrame([("s",), (" s",), ("s",)], "sample_id string")
    joined = {(r.reference_name, r.sample_id): (r.n, r.joined_rows) for r in hp.joined_pairs(df, seqs, groups).collect()}
    assert joined == {k: (n, n * (2 if k[0] == "c1" else 1) * (3 if k[1] == "s" else 1)) for k, (n, _, _) in want.items()}
    total = sum(n for n, _, _ in want.values())
    assert {(r.reference_name, r.sample_id) for r in hp.heavy_pairs(df, seqs, groups, 0.3).collect()} == {k for k, (n, _, _) in want.items() if n >= 0.3 * total}
    assert hp.pair_results(df.limit(0)).count() == 0 and hp.heavy_pairs(df.limit(0), seqs, groups).count() == 0


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        ('c\ts\tg\t1\t9\t.\t+\t0\ta "x"; b "y;z"; c 5', None), ("c\ts\tg\t1\t9\t.\t+\t0", None), ("c\ts\tg\t1\t9\t.\t+\t0\t", None), ('c\ts\tg\t1\t9\t1e-05\t-\t.\t;; a "" ;\r', None), ("", "skip"), (" \t \r", "skip"), (None, "skip"), ("#x\ty", "skip"),
        ("c\ts\tg\t1\t9\t.\t+", "column_count"), ("c s g 1 9 . + 0", "column_count"), (" # x", "column_count"), ('c\ts\tg\t1\t9\t.\t+\t0\ta "x"\tz', "column_count"),
        ('c\ts\tg\t1\t9\t.\t+\t0\ta "x""', "quoting"), ("c\ts\tg\t1\t9\t.\t+\t0\ta 'x'", "quoting"), ("c\ts\tg\t1\t9\t.\t+\t0\ta “x”", "quoting"), ("c\ts\tg\t1\t9\t.\t+\t0\ta", "quoting"), ("c\ts\tg\t1\t9\t.\t+\t0\ta x y", "quoting"), ('c\ts\tg\tNA\t9\t.\t+\t0\ta "x', "quoting"), ('c\ts\tg\t1\t9\t.\t+\t0\ta "x"b "y"', "quoting"), ('c\ts\tg\t1\t9\t.\t+\t0\ta"x"', "quoting"),
        (".\ts\tg\t1\t9\t.\t+\t0", "invalid_value"), ("a b\ts\tg\t1\t9\t.\t+\t0", "invalid_value"), ("c\ts\t\t1\t9\t.\t+\t0", "invalid_value"), ("c\ts\tg\t0\t9\t.\t+\t0", "invalid_value"), ("c\ts\tg\t10\t9\t.\t+\t0", "invalid_value"), ("c\ts\tg\t1,0\t90\t.\t+\t0", "invalid_value"), ("c\ts\tg\t99999999999999999999\t100000000000000000000\t.\t+\t0", None),
        ("c\ts\tg\t1\t9\tx\t+\t0", "invalid_value"), ("c\ts\tg\t1\t9\t1,5\t+\t0", "invalid_value"), ("c\ts\tg\t1\t9\t.\t+-\t0", "invalid_value"), ("c\ts\tg\t1\t9\t.\t+\t3", "invalid_value"), ("c\ts\tg\t1\t9\t.\t+\t", "invalid_value"),
        ("c\ts\tg\t1\t9\t.\t+\t0\t" + ";".join(f'k{i} "v;{i}"' for i in range(20000)), None), ("c\ts\tg\t1\t9\t.\t+\t0\t" + 'k "' + "x" * 200000, "quoting"),
    ],
)
def test_gtf_lines(spark, line, reason):
    df = spark.createDataFrame([(1, line, "clash")], "line_id long, raw_line string, errors string")
    got = pl.rejected(df).collect()
    assert [r.reason for r in got] == ([] if reason in (None, "skip") else [reason])
    f = pl.split_gtf(df).collect()[0]
    assert (f.kind != "record") == (reason == "skip")


def test_gtf_features_and_empty(spark):
    df = spark.createDataFrame([(1, 'c\t.\tg\t1\t9\t2.5\t+\t.\tgene_id "a b"; n 5; gene_id "last"')], "line_id long, raw_line string")
    r = pl.features(df).collect()[0]
    assert (r.start_pos, r.end_pos, r.score, r.source, r.frame, r.attributes) == (0, 9, 2.5, None, None, {"n": "5", "gene_id": "last"})
    assert pl.features(df.limit(0)).count() == 0 and pl.rejected(df.limit(0)).count() == 0


def test_all_errors_are_kept(spark):
    df = spark.createDataFrame([(1, '.\ts\tg\tx\t9\t.\t+\t0\ta "x')], "line_id long, raw_line string")
    assert pl.rejected(df).collect()[0].errors == ["quoting", "invalid_value"]


def test_gtf_positions_of_any_length_are_kept(spark):
    n = "9" * 18 + "7"
    df = spark.createDataFrame([(1, f"c\ts\tg\t{n[:19]}\t{n}\t.\t+\t0"), (2, f"c\ts\tg\t007\t{'9' * 60}\t.\t+\t0")], "line_id long, raw_line string")
    r = {x.line_id: x for x in pl.features(df).collect()}
    assert (r[1].start_pos, r[1].end_pos) == (None, None) if int(n) >= 2**63 else (int(n) - 1, int(n))
    assert (r[2].start_pos, r[2].end_pos, r[2].start_text, r[2].end_text) == (6, None, "007", "9" * 60)
    big = spark.createDataFrame([(1, "c\ts\tg\t1234567890123456789\t1234567890123456790\t.\t+\t0")], "line_id long, raw_line string")
    assert pl.features(big).first().start_pos == 1234567890123456788


@pytest.mark.parametrize("short", [0, 2000])
def test_both_ways_to_judge_attributes_agree(spark, monkeypatch, short):
    monkeypatch.setattr(pl, "SHORT", short)
    rng = random.Random(8)
    texts = ["".join(rng.choice(['a', ' ', ';', '"', 'b "c"', "; ", '""', "'", "k v", '"x;y"']) for _ in range(rng.randint(0, 7))) for _ in range(400)]
    item = re.compile(r"""\s*([^\s;"']+\s+("[^"]*"|[^\s;"']+)\s*)?""")

    def fits(t):
        at = 0
        while True:
            ends = [m for m in (item.fullmatch(t, at, k) for k in range(at, len(t) + 1)) if m and (m.end() == len(t) or t[m.end()] == ";")]
            if not ends:
                return False
            at = ends[-1].end() + 1
            if at > len(t):
                return True

    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for r in df.select("t", pl.attributes_ok(F.col("t")).alias("ok")).collect():
        assert r.ok == fits(r.t), r.t
