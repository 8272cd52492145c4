"""Read, coverage, sequence, feature and variant operators on small inline records."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import cigar as cg
from strandlake.functions import intervals as iv
from strandlake.functions import mdtag as mt
from strandlake.functions import phred as ph
from strandlake.functions import text as tx
from strandlake.operators import coverage as cov
from strandlake.operators import features as ft
from strandlake.operators import reads as rd
from strandlake.operators import sequences as sq
from strandlake.operators import variants as va
from strandlake.operators.bqsr import covariates, observe, recalibrate, recalibration_table
from strandlake.operators.markdup import mark_duplicates
from strandlake.operators.mdtags import compute_mismatching_positions, left_normalize_indels
from strandlake.operators.realign import left_out, place, realign_indels, sweep
from strandlake.schemas import SCHEMAS

COV = "referenceName string, start long, end long, count double, optSampleId string"


def read(i, **kw):
    r = {
        "readName": f"r{i}", "referenceName": "1", "start": 10, "end": 20, "cigar": "10M", "readMapped": True, "primaryAlignment": True, "supplementaryAlignment": False, "readInFragment": 0, "readGroupId": "g", "sequence": "ACGTACGTAC", "qualityScores": "IIIIIIIIII",
        "readNegativeStrand": False, "mappingQuality": 60, "readPaired": False, "mateMapped": False, "duplicateRead": False, "failedVendorQualityChecks": False, "mismatchingPositions": "10", "properPair": False, "insertSize": 100,
    }
    return {**r, **kw}


def frame(spark, rows):
    empty = spark.createDataFrame([], SCHEMAS["alignment"])
    names = empty.columns
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMAS["alignment"])


def value(spark, expr, *cols):
    return spark.createDataFrame([(1,)], "x int").select(expr(*[F.lit(c) for c in cols]).alias("v")).collect()[0].v


def test_coverage_examples(spark):
    c = spark.createDataFrame([("chr1", 1, 5, 1.0, None), ("chr1", 5, 7, 3.0, None), ("chr1", 7, 20, 4.0, None)], COV)
    assert sorted(r.start for r in cov.coverage(c, 4).collect()) == [4, 8, 12, 16]
    agg = {r.start: r["count"] for r in cov.aggregated_coverage(c, 4).collect()}
    assert len(agg) == 5 and agg[4] == 2.75 and agg[8] == 4.0
    assert cov.flatten(c).count() == 19 and cov.flatten(c.limit(0)).count() == 0
    assert cov.collapse(cov.flatten(c)).count() == 3
    assert cov.from_features(cov.to_features(c)).count() == 3


def test_flagstat_and_view(spark):
    df = frame(spark, [read(1), read(2, readPaired=True, mateMapped=True, mateReferenceName="2", mappingQuality=4), read(3, readMapped=False, failedVendorQualityChecks=True), read(4, duplicateRead=True, readNegativeStrand=True)])
    s = {r.failedQuality: r for r in rd.flagstat(df).collect()}
    assert s[False].total == 3 and s[True].total == 1 and s[False].withMateMappedToDiffChromosome == 1 and s[False].withMateMappedToDiffChromosomeMapQ5 == 0 and s[False].duplicatesPrimary == 1
    assert {r.readName: r.flags for r in rd.flags(df).collect()} == {"r1": 0, "r2": 65, "r3": 516, "r4": 1040}
    assert [r.readName for r in rd.view(df, all_of=16).collect()] == ["r4"] and rd.view(df, none_of=4 | 1024).count() == 2 and rd.view(df, any_of=4 | 16).count() == 2


def dups(spark, rows):
    return {r.readName for r in mark_duplicates(frame(spark, rows)).where("duplicateRead").collect()}


def test_mark_duplicates_scenarios(spark):
    low = "#" * 5 + "I" * 5
    assert dups(spark, [read(1), read(2, qualityScores=low)]) == {"r2"}
    assert dups(spark, [read(1), read(2, start=11, end=21)]) == set()
    # The clipped base counts for the 5' position; reverse reads go by their end.
    assert dups(spark, [read(1), read(2, start=12, cigar="2S8M", qualityScores=low)]) == {"r2"}
    assert dups(spark, [read(1, readNegativeStrand=True), read(2, start=5, cigar="15M", readNegativeStrand=True, qualityScores=low)]) == {"r2"}
    # Ties by name; unmapped reads never; secondary reads of the fragment that stays.
    assert dups(spark, [read(2), read(1)]) == {"r2"} and dups(spark, [read(1, readMapped=False), read(2, readMapped=False)]) == set()
    assert dups(spark, [read(1), read(1, primaryAlignment=False, start=99, end=109)]) == {"r1"}
    # A pair beside a single read at the same left position: the single one is the duplicate.
    pair = [read(1, readPaired=True), read(1, readPaired=True, readInFragment=1, start=50, end=60, readNegativeStrand=True)]
    assert dups(spark, [*pair, read(2, qualityScores="J" * 10)]) == {"r2"}
    assert dups(spark, [*pair, *({**p, "readName": "r9"} for p in pair)]) == {"r9"}
    assert dups(spark, [*pair, *({**p, "readName": "r9", "start": p["start"] + (p["readInFragment"]), "end": p["end"] + p["readInFragment"]} for p in pair)]) == set()
    libs = spark.createDataFrame([("g", "x"), ("h", "y")], "id string, library string")
    out = mark_duplicates(frame(spark, [read(1), read(2, readGroupId="h"), read(3)]), libs).where("duplicateRead").collect()
    assert [r.readName for r in out] == ["r3"] and mark_duplicates(frame(spark, [])).count() == 0


def test_fragments_pairs_and_kmers(spark):
    df = frame(spark, [read(1, readInFragment=1, primaryAlignment=False), read(1, insertSize=7), read(1, readMapped=False), read(1, readGroupId=None)])
    f = {r.readGroupId: r for r in rd.to_fragments(df).collect()}
    assert f["g"].insertSize == 7 and [a.readMapped for a in f["g"].alignments] == [True, True, False] and f["g"].alignments[0].primaryAlignment and len(f) == 2
    assert rd.to_alignments(rd.to_fragments(df)).count() == 4
    a, b = frame(spark, [read(1, readName="x/1")]), frame(spark, [read(1, readName="x/2")])
    assert [(r.readName, r.readInFragment) for r in rd.reassemble_pairs(a, b).orderBy("readInFragment").collect()] == [("x", 0), ("x", 1)]
    with pytest.raises(Exception, match="no pair"):
        rd.reassemble_pairs(a, b.unionByName(b)).collect()
    assert rd.reassemble_pairs(a, b.unionByName(b), strict=False).count() == 0
    k = spark.createDataFrame([("ACGTA",), ("AC",), ("",), (None,)], "sequence string")
    assert {r.kmer: r.n for r in rd.count_kmers(k, 3).collect()} == {"ACG": 1, "CGT": 1, "GTA": 1, "AC": 1}
    # Line breaks, signs of the pattern language, characters of two and four bytes; a text of a million is walked once.
    for t in ("a\nb.c\n", "éx😀y😀😀z", "(((", "A" * 1_000_000):
        got = {r.kmer: r.n for r in rd.count_kmers(spark.createDataFrame([(t,)], "sequence string"), 3).collect()}
        assert got == Counter(t[i : i + 3] for i in range(len(t) - 2)), t[:9]


def test_scalars(spark):
    assert value(spark, ph.error_to_phred, 0.001) == 30 and value(spark, ph.phred_to_error, 300) == pytest.approx(10**-25.5) and value(spark, ph.log_probability_to_phred, 0.0) == 3233
    assert value(spark, ph.qualities, "!I") == [0, 40] and value(spark, ph.qualities, "") == [] and value(spark, ph.quality_sum, "I+") == 40
    assert value(spark, lambda q: ph.bin_qualities(q, "0,20,10;20,42,30"), "!I5") == "+??"
    with pytest.raises(Exception, match="no bin"):
        value(spark, lambda q: ph.bin_qualities(q, "0,20,10"), "I")
    for bad in ("0,20,10;10,30,20", "5,3,4"):
        with pytest.raises(ValueError):
            ph.parse_bins(bad)
    c = "2H3S10M2I5D4M1S"
    assert value(spark, cg.reference_length, c) == 19 and value(spark, cg.read_length, c) == 20 and value(spark, cg.leading_clip, c) == 5 and value(spark, cg.trailing_clip, c) == 1 and value(spark, cg.is_well_formed, c) and not value(spark, cg.is_well_formed, "3M2S1M")
    assert value(spark, tx.reverse_complement, "ACgN") == "NCGT" and value(spark, tx.strip_pair_suffix, "a/1") == "a" and value(spark, tx.strip_pair_suffix, "a 2:N:0") == "a" and value(spark, tx.pair_number, "a_2") == 1
    t = value(spark, tx.parse_tags, "NM:i:3\tXX:Z:a:b\tbad\tNM:i:9")
    assert {k: (v.type, v.value) for k, v in t.items()} == {"NM": ("i", "3"), "XX": ("Z", "a:b")} and value(spark, lambda x: tx.tag_value(x, "XX"), "NM:i:3\tXX:Z:a:b") == "a:b"


def plain_alignment(x, y, match=1.0, gap=-0.333):
    """Cell by cell."""
    score, move = {}, {}
    for i in range(len(x) + 1):
        for j in range(len(y) + 1):
            if not (i and j):
                score[i, j], move[i, j] = 0.0, ""
                continue
            d, u, l = score[i - 1, j - 1] + (match if x[i - 1] == y[j - 1] else gap), score[i - 1, j] + gap, score[i, j - 1] + gap
            score[i, j], move[i, j] = (d, "M") if d >= max(u, l) and d > 0 else (u, "I") if u >= l and u > 0 else (l, "D") if l > 0 else (0.0, "")
    i, j = max(score, key=lambda k: (score[k], k))
    end, ops = (i, j), []
    while move[i, j]:
        ops.append(move[i, j])
        i, j = i - (ops[-1] != "D"), j - (ops[-1] != "I")
    cut = lambda a, o, b: mt.format_cigar([(a, "S"), *((1, k) for k in o), (b, "S")])
    o = ops[::-1]
    return cut(i, o, len(x) - end[0]), cut(j, [{"I": "D", "D": "I"}.get(k, k) for k in o], len(y) - end[1]), i, j


def test_md_tags_and_alignment():
    md = mt.compute_md("ACGTTT", "3M1I2M", 5, "ACCTT", 5)
    assert md == "2C2" and mt.reference_of("ACGTTT", "3M1I2M", md, 5) == "ACCTT"
    assert str(mt.parse_md("3A2^CG0T1", 0)) == "3A2^CG0T1" and mt.parse_md("2^AC2", 10).deletions == {12: "A", 13: "C"}
    assert mt.compute_md("ACGT", "2M2D2M", 0, "ACTTGT", 0) == "2^TT2" and not mt.parse_md("0A3", 4).is_match(4)
    assert mt.left_normalize("ACAAAG", "3M1I2M", None, 0) == "2M1I3M" and mt.left_normalize("ACGT", "4M", None, 0) == "4M"
    assert mt.left_normalize("CCAAG", "3M1D2M", "3^A2", 0) == "2M1D3M"
    assert mt.smith_waterman("ACGT", "TTACGTTT") == ("4M", "2S4M2S", 0, 2)
    assert mt.smith_waterman("ACGTACGT", "ACGTTACGT")[0] in ("4M1D4M", "3M1D5M", "5M1D3M")
    # An indel doesn't move over a mismatch: the bases before it are those of the read.
    assert mt.left_normalize("GGTAACACC", "7M1D2M", "5A1^A2", 0) == "6M1D3M"
    assert mt.smith_waterman("AACC", "AAGCC") == ("2M1D2M", "2M1I2M", 0, 0) and mt.smith_waterman("AC", "ACTAC")[1] == "3S2M"
    rng = random.Random(5)
    for _ in range(60):
        x, y = ("".join(rng.choice("ACG") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert mt.smith_waterman(x, y) == plain_alignment(x, y), (x, y)
    assert mt.move_alignment("ACGTTT", "3M1I2M", "2C2", 5, "1S2M1I2M", 6) == "1C2"
    c = mt.consensus_of("ACGGT", 10, "2M2I1M")
    assert (c.bases, c.start, c.end) == ("GG", 12, 12) and c.insert_into("AACCC", 10) == "AAGGCCC" and mt.consensus_of("AC", 0, "2M") is None
    for bad in ("3?", "10X^"):
        with pytest.raises(ValueError):
            mt.parse_md(bad, 0)


def test_mismatch_tags_from_slices(spark):
    slices = spark.createDataFrame([("1", 0, 15, "A" * 15), ("1", 15, 40, "A" * 25)], "name string, start long, end long, sequence string")
    df = frame(spark, [read(1, sequence="AAAAACAAAA", mismatchingPositions=None), read(2, sequence="AAAAACAAAA", mismatchingPositions="10"), read(3, start=38, end=48, mismatchingPositions=None)])
    assert {r.readName: r.mismatchingPositions for r in compute_mismatching_positions(df, slices).collect()} == {"r1": "5A4", "r2": "10", "r3": None}
    assert {r.mismatchingPositions for r in compute_mismatching_positions(df, slices, overwrite=True, row_id="readName").collect()} == {"5A4", None}
    with pytest.raises(Exception, match="differs"):
        compute_mismatching_positions(df, slices, strict=True).collect()
    n = left_normalize_indels(frame(spark, [read(1, sequence="ACAAAG", cigar="3M1I2M"), read(2, cigar=None)])).collect()
    assert {r.readName: r.cigar for r in n} == {"r1": "2M1I3M", "r2": None}


def test_recalibration(spark):
    assert covariates("ACGN", False, False)[1] == ["NN", "AC", "CG", "NN"] and list(covariates("ACG", True, True)[0]) == [-3, -2, -1] and covariates("ACG", True, False)[1] == ["GT", "CG", "NN"]
    rows = [read(i, mismatchingPositions="4A5" if i % 4 == 0 else "10") for i in range(40)] + [read(99, duplicateRead=True), read(98, mismatchingPositions="bad!"), read(97, mappingQuality=0)]
    df = frame(spark, rows)
    o = observe(df)
    assert o.agg(F.sum("total"), F.sum("mismatches")).collect()[0][:] == (400, 10)
    sites = spark.createDataFrame([("1", 14)], "referenceName string, start long")
    assert observe(df, sites, "readName").agg(F.sum("total"), F.sum("mismatches")).collect()[0][:] == (360, 0)
    t = {(r.cycle, r.dinuc): r.new_quality for r in recalibration_table(o).collect()}
    assert t[(5, "TA")] < min(v for k, v in t.items() if k[0] != 5 and k[1] != "TA")
    out = {r.readName: r for r in recalibrate(df).collect()}
    assert len(out) == len(rows) and out["r1"].originalQualityScores == "I" * 10 and ord(out["r1"].qualityScores[4]) - 33 == t[(5, "TA")]
    assert recalibrate(frame(spark, [])).count() == 0


def test_recalibrated_table_by_brute_force(spark):
    from strandlake.plans import format_queries as fq

    d, total, wrong, bases = "/root/testdata/sf0.001", Counter(), Counter(), {}
    reads = fq._tagged(spark, d).collect()
    for r in reads:
        s, q = r.sequence, r.qualityScores
        if q is None or len(q) != len(s):
            continue
        if r.readNegativeStrand:
            s = s.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]
        pairs = ["NN" if "N" in p else p for p in map("".join, zip("N" + s, s))]
        keys = [(r.readGroupId, (-1 if r.readInFragment == 1 else 1) * (i + 1), p) for i, p in enumerate(pairs)]
        keys = bases[r.id] = [(g, ord(x) - 33, c, p) for (g, c, p), x in zip(keys[::-1] if r.readNegativeStrand else keys, q)]
        if not (r.readMapped and r.primaryAlignment and (r.mappingQuality or 0) > 0 and r.mismatchingPositions) or r.duplicateRead or r.failedVendorQualityChecks or r.cigar == "*":
            continue
        # A letter per aligned base of the tag: same or not; deletions take up no base of the read.
        same = "".join("=" * int(n) if n else "x" if x else "" for n, _, x in re.findall(r"(\d+)|(\^[A-Z]+)|([A-Z])", r.mismatchingPositions))
        i = j = 0
        for n, op in re.findall(r"(\d+)(.)", r.cigar):
            for _ in range(int(n) if op in "M=XIS" else 0):
                if op in "M=X":
                    if r.sequence[i] != "N" and q[i] > "!":
                        total[keys[i]] += 1
                        wrong[keys[i]] += same[j] == "x"
                    j += 1
                i += 1
    sums = [Counter() for _ in range(6)]
    for k, n in total.items():
        for t, part in enumerate((k[:2], k[:3], (*k[:2], k[3]))):
            sums[t][part] += n
            sums[t + 3][part] += wrong[k]
    rate = lambda t, k: math.log((1 + sums[t + 3][k]) / (2 + sums[t][k]))
    new = {k: math.floor(-10 * min(0, max(math.log(1e-5), rate(1, k[:3]) + rate(2, (*k[:2], k[3])) - rate(0, k[:2]))) / math.log(10) + 0.5) for k in total}
    out = {r.id: r for r in fq.QUERIES["a15_recalibrated"](spark, d).collect()}
    assert len(out) == len(reads) and sum(wrong.values()) > 0
    for r in reads:
        assert out[r.id].old_quals == r.qualityScores
        if r.id in bases:
            assert out[r.id].quals == "".join(x if k[1] < 5 else chr(33 + new.get(k, k[1])) for x, k in zip(r.qualityScores, bases[r.id]))


def test_realignment(spark):
    ref = "ACGTTGCAAGCTTCGATTACGGATCCAGTCATGCAATGCC"
    assert sweep("TTC", np.array([9, 9, 9]), ref, 0) == (0, 11) and sweep("TTT", np.array([9, 9, 9]), ref, 5) == (5, -1)
    # The sample lacks ref[18:22]; reads at the border of the deletion are aligned with mismatches.
    hap = ref[:18] + ref[22:]
    good = [read(i, sequence=hap[8:28], cigar="10M4D10M", start=8, end=32, mismatchingPositions=f"10^{ref[18:22]}10", qualityScores="I" * 20) for i in range(3)]
    seq = hap[3:23]
    bad = [read(10 + i, sequence=seq, cigar="20M", start=3, end=23, mismatchingPositions=mt.compute_md(seq, "20M", 3, ref, 0), qualityScores="I" * 20) for i in range(4)]
    far = [read(50, start=500, end=510), read(51, readMapped=False, referenceName=None, start=None, end=None, cigar=None)]
    out = {r.readName: r for r in realign_indels(frame(spark, good + bad + far)).collect()}
    assert len(out) == 9 and out["r10"].cigar == "15M4D5M" and out["r10"].start == 3 and out["r10"].mismatchingPositions == f"15^{ref[18:22]}5"
    assert out["r10"].originalCigar == "20M" and out["r10"].mappingQuality == 70 and out["r50"].cigar == "10M" and out["r51"].cigar is None
    # Soft-clipped bases are aligned too where asked for; targets with too many reads are told of.
    clipped = [read(20, sequence=hap[8:28], cigar="10M10S", start=8, end=18, mismatchingPositions="10", qualityScores="I" * 20)]
    asked = {r.readName: r.cigar for r in realign_indels(frame(spark, good + bad + clipped), unclip=True).collect()}
    assert asked["r20"] == "10M4D10M" and {r.readName: r.cigar for r in realign_indels(frame(spark, good + bad + clipped)).collect()}["r20"].endswith("10S")
    few = left_out(frame(spark, good + bad), max_reads=5).collect()
    assert [(r.start, r.end, r.reads, r.why) for r in few] == [(8, 32, 7, "reads")] and left_out(frame(spark, good + bad)).count() == 0
    assert place(2, 6, mt.Consensus("GG", 14, 14), 10) == (12, 16, "2M2I2M") and place(5, 4, mt.Consensus("GG", 14, 14), 10) == (14, 17, "1S3M")


def test_sequences(spark):
    s = spark.createDataFrame([("a", "ACGTACGTAC"), ("b", ""), ("c", "AC")], "name string, sequence string").withColumn("length", F.length("sequence").cast("long"))
    sl = sq.slice_by_length(s, 4)
    assert sorted((r.name, r.start, r.end, r.sequence, r["index"], r.slices) for r in sl.collect()) == [("a", 0, 4, "ACGT", 0, 3), ("a", 4, 8, "ACGT", 1, 3), ("a", 8, 10, "AC", 2, 3), ("c", 0, 2, "AC", 0, 1)]
    assert {r.name: r.sequence for r in sq.merge_slices(sl).collect()} == {"a": "ACGTACGTAC", "c": "AC"}
    assert [r.sequence for r in sq.extract(sl, "a", 2, 9).collect()] == ["GTACGTA"]
    wanted = spark.createDataFrame([("a", 2, 9), ("a", 0, 10), ("a", 3, iv.OPEN_END), ("c", 1, 2), ("c", 1, 9), ("none", 0, 3)], "referenceName string, start long, end long")
    both = [{(r.referenceName, r.start, r.end): r.sequence for r in sq.extract_regions(sl, wanted, strict=False, length=n).collect()} for n in (None, 4)]
    assert both[0] == both[1] == {("a", 2, 9): "GTACGTA", ("a", 0, 10): "ACGTACGTAC", ("a", 3, iv.OPEN_END): "TACGTAC", ("c", 1, 2): "C", ("c", 1, 9): "C", ("none", 0, 3): ""}
    for n in (None, 4):
        with pytest.raises(Exception, match="not covered"):
            sq.extract_regions(sl, wanted, length=n).collect()
    with pytest.raises(Exception, match="not covered"):
        sq.extract(sl, "a", 8, 12).collect()
    assert {(r.start, r.sequence, r.end) for r in sq.flank_adjacent(sl, 2).where("name = 'a'").collect()} == {(0, "ACGTAC", 6), (2, "GTACGTAC", 10), (6, "GTAC", 10)}
    assert {r.kmer: r.n for r in sq.count_slice_kmers(sl, 3).collect()} == {"ACG": 2, "CGT": 2, "GTA": 2, "TAC": 2}
    assert sorted((r.name, r.sequence) for r in sq.slice_by_regions(s, [("a", 1, 3), ("a", 8, 99), ("z", 0, 1)]).collect()) == [("a", "AC"), ("a", "CG")]
    assert sq.create_references(sl) == [("a", 10), ("c", 2)] and sq.to_alignments(sq.to_reads(s)).count() == 3 and sq.to_sequences(sq.to_slices(s)).count() == 3


def test_features(spark):
    f = spark.createDataFrame([("1", 5, 9, 2.0, "gene", {"exon_number": "10"}, ["p"]), ("1", 5, 9, 2.0, "exon", {"exon_number": "9"}, None)], "referenceName string, start long, end long, score double, featureType string, attributes map<string,string>, parentIds array<string>")
    assert ft.filter_to_parent(f, "p", "q").count() == 1 and ft.filter_by_attribute(f, "exon_number", "9").count() == 1 and ft.filter_by_score(f, 2.5).count() == 0
    assert value(spark, ft.to_dbxref, "db:acc:1") == ("db", "acc:1") and value(spark, ft.to_dbxref, "none") is None
    assert value(spark, lambda s: ft.interpolate_score(s, 0.0, 10.0), 2.5) == 250 and value(spark, lambda s: ft.last_wins(ft.gff3_entries(s)), "a=1;b=x=y;a=2;zz") == {"b": "x=y", "a": "2"}


def test_effects_round_trip(spark):
    ann = "T|missense&splice|MODERATE|G|gid|transcript|tid|coding|2/5|c.1A>T|p.K|10/90|4/60|2-3/20|7|w1&w2,bad|x"
    e = value(spark, va.parse_effects, ann)
    assert len(e) == 1 and e[0].effects == ["missense", "splice"] and (e[0].rank, e[0].total, e[0].proteinPosition, e[0].proteinLength, e[0].distance) == (2, 5, 2, 20, 7)
    back = value(spark, lambda a: va.format_effects(va.parse_effects(a)), ann)
    assert back == "T|missense&splice||G|gid|transcript|tid|coding|2/5|c.1A>T|p.K|10/90|4/60|2/20|7|w1&w2"
