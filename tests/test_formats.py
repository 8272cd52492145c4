"""Readers, writers, Parquet layout, frames, pipes, the command line and streaming."""

import gzip
import struct
import sys

import pytest
from pyspark.sql import functions as F

from strandlake import cli
from strandlake.frame import GenomicFrame, Meta
from strandlake.functions import intervals as iv
from strandlake.operators.pipe import pipe
from strandlake.operators.reads import flags, flagstat
from strandlake.operators.variants import to_variant_contexts
from strandlake.sources import binary, load, parquet, sinks, text
from strandlake.streaming import live

SAM = """@HD\tVN:1.6\tSO:unsorted
@SQ\tSN:1\tLN:1000
@RG\tID:g\tSM:s\tLB:l
r1\t99\t1\t11\t60\t2S8M\t=\t101\t190\tACGTACGTAC\tIIIIIIIIII\tMD:Z:8\tRG:Z:g\tNM:i:0
r1\t147\t1\t101\t60\t10M\t=\t11\t-190\tACGTACGTAC\tIIIIIIIIII\tRG:Z:g
r2\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*
"""


def put(path, content):
    path.write_text(content)
    return str(path)


def lines(spark, path):
    return [r.value for r in spark.read.text(str(path)).collect()]


def test_sam_round_trip(spark, tmp_path):
    f = load.load_alignments(spark, put(tmp_path / "a.sam", SAM))
    assert f.meta.references == (("1", 1000),) and f.meta.samples == ("s",)
    r = {(x.readName, x.readInFragment): x for x in f.df.collect()}
    a = r["r1", 0]
    assert (a.start, a.end, a.referenceName, a.mateReferenceName, a.mateAlignmentStart, a.mismatchingPositions, a.attributes, a.readGroupId, a.readGroupSampleId, a.insertSize) == (10, 18, "1", "1", 100, "8", "NM:i:0", "g", "s", 190)
    assert a.properPair and not a.readNegativeStrand and r["r1", 1].readNegativeStrand and not r["r2", 0].readMapped and r["r2", 0].qualityScores is None
    assert a.primaryAlignment and r["r2", 0].primaryAlignment
    pairs = "u1\t77\t*\t0\t0\t*\t*\t0\t0\tAC\tII\nu1\t141\t*\t0\t0\t*\t*\t0\t0\tAC\tII\nh1\t73\t1\t5\t60\t2M\t*\t0\t0\tAC\tII\nh1\t133\t*\t0\t0\t*\t*\t0\t0\tAC\tII\ns1\t2048\t1\t5\t60\t3H2M\t*\t0\t0\tAC\tII\n"
    u = load.load_alignments(spark, put(tmp_path / "u.sam", pairs)).df
    stat = flagstat(u).collect()[0]
    assert (stat.total, stat.pairedInSequencing, stat.read1, stat.read2, stat.singleton) == (5, 4, 2, 2, 1)
    assert {x.basesTrimmedFromStart for x in u.where("supplementaryAlignment").collect()} == {3} and sorted(x.flags for x in flags(u).collect()) == [73, 77, 133, 141, 2048]
    sinks.save_sam(f.df, str(tmp_path / "b.sam"), f.meta.references, [dict(g) for g in f.meta.read_groups], single=True)
    g = load.load_alignments(spark, str(tmp_path / "b.sam"))
    assert sorted(map(str, g.df.collect())) == sorted(map(str, f.df.collect())) and g.meta.references == f.meta.references
    assert load.load_alignments(spark, str(tmp_path / "a.sam"), regions="1:0-50").df.count() == 1


def bam(path):
    """A BAM file of one member, written by hand."""
    text_ = b"@HD\tVN:1.6\n@SQ\tSN:1\tLN:1000\n@RG\tID:g\tSM:s\n"
    out = b"BAM\1" + struct.pack("<i", len(text_)) + text_ + struct.pack("<i", 1) + struct.pack("<i", 2) + b"1\0" + struct.pack("<i", 1000)
    for name, flag, ref, pos, cigar, seq in ((b"r1\0", 16, 0, 10, [(3, 0), (1, 1), (1, 0)], "ACGTN"), (b"r2\0", 4, -1, -1, [], "AC")):
        packed = [binary.BAM_BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
        tags = b"RGZg\0" + b"NMC\5" + b"XBBs" + struct.pack("<i2h", 2, -1, 7) + b"XAAq"
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), 60, 0, len(cigar), flag, len(seq), -1, -1, 0) + name + b"".join(struct.pack("<I", n << 4 | o) for n, o in cigar)
        body += bytes(a << 4 | b for a, b in zip(packed[::2], packed[1::2])) + bytes([30] * len(seq)) + tags
        out += struct.pack("<i", len(body)) + body
    path.write_bytes(gzip.compress(out[:70]) + gzip.compress(out[70:]) + gzip.compress(b""))
    return str(path)


def test_bam(spark, tmp_path):
    r = {x.readName: x for x in load.load_alignments(spark, bam(tmp_path / "a.bam")).df.collect()}
    assert (r["r1"].start, r["r1"].end, r["r1"].cigar, r["r1"].sequence, r["r1"].qualityScores, r["r1"].readGroupId, r["r1"].readGroupSampleId, r["r1"].attributes) == (10, 14, "3M1I1M", "ACGTN", "?????", "g", "s", "NM:i:5\tXB:B:s,-1,7\tXA:A:q")
    assert r["r1"].readNegativeStrand and not r["r2"].readMapped and r["r2"].start is None


def reads_for_bam(spark, n=3000):
    """Reads of several lengths, unmapped ones, ones with tags, in the order of their position."""
    i = F.col("id")
    bases = F.expr("substring(repeat(concat(substring('ACGTN', 1 + cast(id % 5 as int), 1), 'GATTACA'), 9), 1, cast(20 + id % 41 as int))")
    mapped = i % 7 != 0
    df = spark.range(n).select(
        i, F.concat(F.lit("read:"), i).alias("readName"), bases.alias("sequence"), F.when(i % 11 != 0, F.repeat(F.lit("F"), F.length(bases))).alias("qualityScores"), F.when(mapped, F.when(i < n // 2, "1").otherwise("2")).alias("referenceName"), F.when(mapped, i * 40).alias("start"),
        F.when(mapped, i * 40 + F.length(bases)).alias("end"), F.when(mapped, F.concat(F.length(bases), F.lit("M"))).alias("cigar"), F.when(mapped, (i % 60).cast("int")).alias("mappingQuality"), F.lit("g").alias("readGroupId"), F.lit("s").alias("readGroupSampleId"), F.lit(True).alias("readPaired"),
        mapped.alias("readMapped"), (i % 3 == 0).alias("mateMapped"), (i % 2).cast("int").alias("readInFragment"), F.lit(True).alias("primaryAlignment"), (i % 5 == 0).alias("duplicateRead"), F.lit(False).alias("supplementaryAlignment"), F.concat(F.lit("NM:i:"), i, F.lit("\tXF:f:1.5\tXB:B:s,-1,7\tXA:A:q")).alias("attributes"),
    )
    return text._columns(df.coalesce(1).orderBy("id"), "alignment")


def test_bam_is_cut_into_ranges(spark, tmp_path):
    """A file of many blocks, in ranges far smaller than a block and larger: every record once, whatever the cuts."""
    df, refs, groups = reads_for_bam(spark), [("1", 10**6), ("2", 10**6)], [{"ID": "g", "SM": "s"}]
    p = str(tmp_path / "a.bam")
    binary.save_bam(df, p, refs, groups, single=True)
    part = next(tmp_path.glob("a.bam/part-*"))
    assert part.read_bytes().endswith(binary.BGZF_END) and part.stat().st_size > 60_000
    f = load.load_alignments(spark, p)
    assert f.meta.references == tuple(refs) and f.meta.samples == ("s",)
    lossy = ["mateNegativeStrand", "readNegativeStrand", "properPair", "failedVendorQualityChecks", "basesTrimmedFromStart", "basesTrimmedFromEnd"]
    want = sorted(map(str, df.drop(*lossy).collect()))
    for size in (1 << 26, 20_000, 3_000):
        assert sorted(map(str, binary.read_bam(spark, p, size=size).drop(*lossy).collect())) == want, size
    binary.save_bam(df.repartition(3), str(tmp_path / "b.bam"), refs, groups)
    assert sorted(map(str, load.load_alignments(spark, str(tmp_path / "b.bam")).df.drop(*lossy).collect())) == want


def index_of(path):
    """The index of a BAM file, made the slow way."""
    h, bins, linear = binary.bam_header(str(path)), {}, {}
    with open(path, "rb") as f:
        s = binary.Inflated(f, h.first >> 16)
        s.take(h.first & 0xFFFF)
        while len(head := (at := s.place(), s.take(4))[1]) == 4:
            r = s.take(struct.unpack("<i", head)[0])
            ref, pos, _, _, number = struct.unpack_from("<iiBBH", r)
            if ref >= 0:
                bins.setdefault(ref, {}).setdefault(number, []).append((at, s.place()))
                for w in (pos >> 14, pos + 60 >> 14):
                    linear.setdefault(ref, {}).setdefault(w, at)
    out = b"BAI\1" + struct.pack("<i", len(h.names))
    for ref in range(len(h.names)):
        out += struct.pack("<i", len(bins.get(ref, {})))
        for number, chunks in bins.get(ref, {}).items():
            out += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        last = max(linear.get(ref, {-1: 0}))
        out += struct.pack("<i", last + 1) + b"".join(struct.pack("<Q", linear[ref].get(w, 0)) for w in range(last + 1))
    return out


def test_bam_by_its_index(spark, tmp_path):
    p = tmp_path / "a.bam"
    binary.save_bam(reads_for_bam(spark), str(tmp_path / "parts"), [("1", 10**6), ("2", 10**6)], single=True)
    p.write_bytes(next(tmp_path.glob("parts/part-*")).read_bytes())
    whole = {r.readName for r in load.load_alignments(spark, str(p), regions="1:20000-23000,2:90000+").df.collect()}
    (tmp_path / "a.bam.bai").write_bytes(index_of(p))
    f = load.load_alignments(spark, str(p), regions="1:20000-23000,2:90000+")
    assert len(whole) > 500 and {r.readName for r in f.df.collect()} == whole
    few = binary.read_bam(spark, str(p), [("1", 20_000, 23_000)])
    assert few.where("start < 23000 and end > 20000").count() > 50 and few.count() < 1500 and binary.read_bam(spark, str(p), [("none", 0, 9)]).count() == 0


def test_fastq_is_cut_into_ranges(spark, tmp_path):
    """Quality lines that begin with @ and +, blank lines, carriage returns: every record once, whatever the cuts."""
    import random

    rng, out, want = random.Random(3), "", []
    for i in range(120):
        n = rng.choice((0, 1, 7, 30))
        seq, qual = "".join(rng.choice("ACGTN") for _ in range(n)), "".join(rng.choice("@+I") for _ in range(n))
        end = rng.choice(("\n", "\r\n"))
        out += end.join((f"@r{i} x", seq, "+", qual, "")) + ("\n" if n and i % 10 == 0 else "")
        want.append((f"r{i} x", seq, qual))
    p = put(tmp_path / "a.fq", out)
    for size in (1 << 26, 200, 37, 5):
        got = text._fastq_records(spark, p, size=size).collect()
        assert sorted(map(tuple, got)) == sorted(want), size
    n = {r["head"]: r.number for r in text._fastq_records(spark, p, numbered=True, size=150).collect()}
    assert n == {f"r{i} x": i for i in range(120)}
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(out[:900].encode()) + gzip.compress(out[900:].encode()))
    assert text._fastq_records(spark, str(tmp_path / "b.fq.gz"), size=50).count() == 120


def two_bit(path, seq="ACGTNNACGTTTacgTA"):
    code = "".join(f"{'TCAG'.index(c.upper() if c.upper() != 'N' else 'T'):02b}" for c in seq).ljust(-(-len(seq) // 4) * 8, "0")
    body = struct.pack("<II", len(seq), 1) + struct.pack("<II", 4, 2) + struct.pack("<I", 1) + struct.pack("<II", 12, 3) + struct.pack("<I", 0) + int(code, 2).to_bytes(len(code) // 8, "big")
    path.write_bytes(struct.pack("<4I", 0x1A412743, 0, 1, 0) + b"\1q" + struct.pack("<I", 22) + body)
    return str(path)


def test_two_bit(spark, tmp_path):
    p = two_bit(tmp_path / "a.2bit")
    with open(p, "rb") as f:
        order, index = binary.two_bit_index(f)
        assert binary.two_bit_sequence(f, order, index["q"], mask=True) == "ACGTNNACGTTTacgTA"
        assert binary.two_bit_sequence(f, order, 22, 3, 9) == "TNNACG"
    s = load.load_slices(spark, p, 6).df.orderBy("start").collect()
    assert [x.sequence for x in s] == ["ACGTNN", "ACGTTT", "ACGTA"] and s[2].totalLength == 17


def test_fastq_and_fasta(spark, tmp_path):
    a = put(tmp_path / "a.fq", "@x/1\nACGT\n+\n@III\n@y/1\nAC\n+y/1\nII\n")
    b = put(tmp_path / "b.fq", "@x/2\nAAAA\n+\nIIII\n@y/2\nCC\n+\nII\n")
    one = load.load_alignments(spark, a).df.orderBy("readName").collect()
    assert [(r.readName, r.sequence, r.qualityScores, r.readInFragment, r.readMapped) for r in one] == [("x", "ACGT", "@III", 0, False), ("y", "AC", "II", 0, False)]
    pair = load.load_alignments(spark, a, b)
    assert pair.df.count() == 4 and load.load_fragments(spark, a, b).df.select(F.size("alignments").alias("n")).distinct().collect()[0].n == 2
    sinks.save_paired_fastq(pair.df, str(tmp_path / "o1"), str(tmp_path / "o2"))
    assert sorted(lines(spark, tmp_path / "o1"))[:2] == sorted(["@x/1", "ACGT", "+", "@III", "@y/1", "AC", "+", "II"])[:2]
    with pytest.raises(ValueError, match="no pair"):
        sinks.save_paired_fastq(load.load_alignments(spark, a).df, str(tmp_path / "o3"), str(tmp_path / "o4"))
    i = load.load_alignments(spark, put(tmp_path / "c.ifq", "@x/1\nA\n+\nI\n@x/2\nC\n+\nI\n")).df
    assert {(r.sequence, r.readInFragment) for r in i.collect()} == {("A", 0), ("C", 1)}
    with pytest.raises(Exception, match="no FASTQ record"):
        load.load_alignments(spark, put(tmp_path / "d.fq", "@x\nAC\n+\nI\n")).df.collect()
    odd = load.load_sequences(spark, put(tmp_path / "o.fa", ">s1 variant A>G of x\r\nAC\r\nGT\r\n>s2 >> y\nTT\n"))
    assert {r.name: (r.description, r.sequence) for r in odd.df.collect()} == {"s1": ("variant A>G of x", "ACGT"), "s2": (">> y", "TT")}
    un = load.load_alignments(spark, str(tmp_path / "o.fa")).df.collect()
    assert {(r.readName, r.sequence, r.readMapped) for r in un} == {("s1", "ACGT", False), ("s2", "TT", False)}
    fa = load.load_sequences(spark, put(tmp_path / "a.fa", ">s1 some words\nACGT\nAC\n>s2\n\n>s3\nTTTT\n"))
    assert {r.name: (r.description, r.sequence) for r in fa.df.collect()} == {"s1": ("some words", "ACGTAC"), "s2": (None, ""), "s3": (None, "TTTT")}
    sinks.save_fasta(fa.df, str(tmp_path / "b.fa"), width=4)
    assert {r.name: r.sequence for r in load.load_sequences(spark, str(tmp_path / "b.fa")).df.collect()} == {"s1": "ACGTAC", "s2": "", "s3": "TTTT"}


def test_feature_formats(spark, tmp_path):
    gtf = put(tmp_path / "a.gtf", '#c\nchr1\tsrc\ttranscript\t11\t20\t.\t+\t.\tgene_id "g"; transcript_id "t"; tag "x;y";\nchr1\tsrc\texon\t11\t20\t5.5\t-\t0\tgene_id "g"; transcript_id "t"; exon_id "e"\n')
    f = {r.featureType: r for r in load.load_features(spark, gtf).df.collect()}
    assert (f["transcript"].start, f["transcript"].end, f["transcript"].featureId, f["transcript"].parentIds, f["transcript"].attributes) == (10, 20, "t", ["g"], {"tag": "x;y"})
    assert (f["exon"].featureId, f["exon"].parentIds, f["exon"].score, f["exon"].strand) == ("e", ["t"], 5.5, "REVERSE")
    gff = put(tmp_path / "a.gff3", "##gff-version 3\nchr1\t.\tgene\t1\t9\t.\t+\t.\tID=i;Name=n;Alias=a,b;Parent=p;Note=x;Dbxref=db:1,bad;k=v=w\n>fasta\n")
    g = load.load_features(spark, gff).df.collect()
    assert len(g) == 1 and (g[0].featureId, g[0].aliases, g[0].dbxrefs[0].accession, g[0].attributes) == ("i", ["a", "b"], "1", {"k": "v=w"})
    bed = put(tmp_path / "a.bed", "chr1\t1\t5\tn\t7\t+\t1\t5\nchr2\t3\t9\n")
    b = {r.referenceName: r for r in load.load_features(spark, bed).df.collect()}
    assert b["chr1"].score == 7 and b["chr1"].attributes == {"thickStart": "1", "thickEnd": "5"} and b["chr2"].name is None
    peak = put(tmp_path / "a.narrowPeak", "chr1\t1\t5\tn\t7\t.\t1.5\t2\t3\t4\n")
    assert load.load_features(spark, peak).df.collect()[0].attributes["signalValue"] == "1.5"
    lst = put(tmp_path / "a.interval_list", "@HD\tVN:1\n@SQ\tSN:chr1\tLN:100\tUR:u\tM5:m\nchr1\t11\t20\t-\tn\n")
    li = load.load_features(spark, lst)
    assert li.meta.references == (("chr1", 100),) and li.df.collect()[0].start == 10
    assert load.load_coverage(spark, bed).df.collect()[0]["count"] == 7.0
    for name, src in (("b.gtf", gtf), ("b.gff3", gff), ("b.bed", bed), ("b.narrowPeak", peak), ("b.interval_list", lst)):
        f = load.load_features(spark, src)
        sinks.save_features(f.df, str(tmp_path / name), f.meta.references, single=True)
        back = load.load_features(spark, str(tmp_path / name)).df
        cols = ["referenceName", "start", "end"]
        assert sorted(map(tuple, back.select(*cols).collect())) == sorted(map(tuple, f.df.select(*cols).collect())), name
    back = {r.featureType: r for r in load.load_features(spark, str(tmp_path / "b.gtf")).df.collect()}
    assert back["exon"].exonId == "e" and back["exon"].score == 5.5 and back["transcript"].attributes["tag"] == "x;y"


VCF = """##fileformat=VCFv4.2
##contig=<ID=1,length=1000>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
1\t11\trs1;rs2\tA\tC,G\t50\tPASS\tAC=1,2;AF=0.1,0.2;DB;AD=9,3,4;XX=y\tGT:AD:DP:GQ:PL\t0/1:5,3,0:8:30:10,0,20,30,40,50\t1|2:0,2,2:4:20:9,8,7,6,5,4
1\t20\t.\tAT\tA\t.\tq10;s50\t.\tGT\t./.\t1/1
1\t30\t.\tA\t.\t7\t.\tEND=40\tGT\t0/0\t0/0
"""


def test_vcf(spark, tmp_path):
    p = put(tmp_path / "a.vcf", VCF)
    v = load.load_variants(spark, p)
    assert v.meta.samples == ("s1", "s2") and v.meta.references == (("1", 1000),)
    r = {(x.start, x.alternateAllele): x for x in v.df.collect()}
    assert set(r) == {(10, "C"), (10, "G"), (19, "A"), (29, None)}
    g = r[10, "G"]
    assert g.splitFromMultiAllelic and g.names == ["rs1", "rs2"] and (g.annotation.alleleCount, g.annotation.readDepth, g.annotation.referenceReadDepth, g.annotation.dbSnp, g.annotation.attributes) == (2, 4, 9, True, {"XX": "y"})
    assert r[19, "A"].filtersFailed == ["q10", "s50"] and not r[19, "A"].filtersPassed and r[29, None].end == 40 and r[10, "C"].filtersPassed
    gt = {(x.start, x.variant.alternateAllele, x.sampleId): x for x in load.load_genotypes(spark, p).df.collect()}
    assert len(gt) == 8 and gt[10, "C", "s1"].alleles == ["REF", "ALT"] and gt[10, "G", "s1"].alleles == ["REF", "OTHER_ALT"] and gt[10, "G", "s2"].phased and gt[19, "A", "s1"].alleles == ["NO_CALL", "NO_CALL"]
    assert gt[10, "G", "s1"].genotypeLikelihoods == pytest.approx([-x * 0.2302585 for x in (10, 30, 50)], abs=1e-5) and gt[10, "C", "s1"].alternateReadDepth == 3
    c = to_variant_contexts(load.load_genotypes(spark, p).df)
    sinks.save_vcf(c, str(tmp_path / "b.vcf"), ["s1", "s2"], single=True)
    again = load.load_genotypes(spark, str(tmp_path / "b.vcf")).df
    note = again.where("sampleId = 's1' and variant.alternateAllele = 'G'").first().variant.annotation
    assert (note.readDepth, note.referenceReadDepth, note.dbSnp, note.attributes) == (4, 9, True, {"XX": "y"})
    assert again.count() == 8 and {x.start for x in again.collect()} == {10, 19, 29}
    assert again.where("sampleId = 's1' and variant.alternateAllele = 'C'").collect()[0].alleles == ["REF", "ALT"]


def test_vcf_files_with_other_samples(spark, tmp_path):
    """Names come from each file's own header, also where the same samples stand in another order."""
    head = "##fileformat=VCFv4.2\n##INFO=<ID=QA,Number=A,Type=Integer,Description=\"\">\n##INFO=<ID=QR,Number=R,Type=Integer,Description=\"\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{}\n"
    put(tmp_path / "a.vcf", head.format("A\tB") + "1\t11\t.\tA\tC,G\t.\t.\tQA=5,6;QR=1,2,3;Z=7,8\tGT:DP\t0/1:1\t1/1:2\n")
    put(tmp_path / "b.vcf", head.format("C\tD") + "1\t12\t.\tA\tC\t.\t.\t.\tGT:DP\t0/1:3\t1/1:4\n")
    put(tmp_path / "c.vcf", head.format("B\tA") + "1\t13\t.\tA\tC,<NON_REF>\t.\t.\t.\tGT:DP:PL\t0/1:5:0,1,2,3,4,5\t1/1:6:9,8,7,6,5,4\n")
    f = load.load_genotypes(spark, str(tmp_path / "*.vcf"))
    got = {(r.start, r.variant.alternateAllele, r.sampleId): r for r in f.df.collect()}
    assert f.meta.samples == ("A", "B", "C", "D") and len(got) == 8
    assert {k[::2]: r.readDepth for k, r in got.items()} == {(10, "A"): 1, (10, "B"): 2, (11, "C"): 3, (11, "D"): 4, (12, "B"): 5, (12, "A"): 6}
    assert got[10, "G", "A"].variant.annotation.attributes == {"QA": "6", "QR": "3", "Z": "7,8"}
    q = got[12, "C", "B"]
    assert [round(-x / 0.2302585) for x in q.genotypeLikelihoods] == [0, 1, 2] and [round(-x / 0.2302585) for x in q.nonReferenceLikelihoods] == [0, 3, 5] and got[11, "C", "C"].nonReferenceLikelihoods is None
    some = load.load_genotypes(spark, str(tmp_path / "a.vcf"), info=["QA"], formats=["GT"]).df.first()
    assert some.readDepth is None and set(some.variant.annotation.attributes) == {"QA"}
    c = load.load_variant_contexts(spark, str(tmp_path / "b.vcf")).df.collect()
    assert len(c) == 1 and [g.sampleId for g in c[0].genotypes] == ["C", "D"]
    bare = put(tmp_path / "d.vcf", "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n1\t5\t.\tA\tC\t.\t.\t.\n")
    assert load.load_variant_contexts(spark, bare).df.first().genotypes == []


def test_fragments_have_several_regions(spark, tmp_path):
    """A fragment takes part in filters and joins by each of its alignments; an unmapped one has no region."""
    f = load.load_fragments(spark, put(tmp_path / "a.sam", SAM))
    assert f.filter_by_overlapping_region("1", 100, 105).df.count() == 1 and f.filter_by_overlapping_region("1", 30, 90).df.count() == 0
    g = GenomicFrame(spark.createDataFrame([("1", 15, 16, "a"), ("1", 105, 106, "b"), ("1", 50, 60, "c"), ("1", 0, 500, "d")], "referenceName string, start long, end long, i string"))
    pairs = [(r.left.name, r.right.i) for r in f.shuffle_region_join(g).collect()]
    assert sorted(pairs) == [("r1", "a"), ("r1", "b"), ("r1", "d"), ("r1", "d")] and g.broadcast_region_join(f).count() == 4
    lone = f.left_outer_shuffle_region_join(g).where("right is null").collect()
    assert [r.left.name for r in lone] == ["r2"]


def test_many_regions_mean_the_same_as_few(spark):
    from strandlake.operators.joins import Fields

    df = spark.createDataFrame([("1", 5, 20, "+"), ("1", 30, 60, "-"), ("2", 5, 9, "+")], "referenceName string, start long, end long, strand string")
    f = GenomicFrame(df, fields=Fields(strand="strand"))
    for n in (200, 201):
        assert f.filter_by_overlapping_regions([("1", 0, 100)] + [("9", i, i + 1) for i in range(n - 1)]).df.count() == 2
        assert f.filter_by_overlapping_regions([("1", 10, iv.OPEN_END)] + [("9", i, i + 1) for i in range(n - 1)]).df.count() == 2
    p = f.prepare(flank=1)
    g = GenomicFrame(df.drop("strand").where("start = 30"))
    assert f.broadcast_region_join_against(p).count() == 3 and g.right_outer_broadcast_region_join_against(GenomicFrame(df.drop("strand")).prepare()).count() == 1


def features(spark, n=60):
    return spark.range(n).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("referenceName"), (F.col("id") * 100_000).alias("start"), (F.col("id") * 100_000 + 50).alias("end"))


def test_partitioned_layout_prunes(spark, tmp_path):
    p = str(tmp_path / "p")
    GenomicFrame(features(spark), Meta(references=(("a", 10), ("b", 20)))).save_as_partitioned_parquet(p)
    f = load.load_features(spark, p, "a:1000000-2100000")
    assert f.meta.references == (("a", 10), ("b", 20)) and sorted(r.start for r in f.df.collect()) == list(range(1_000_000, 2_100_001 - 1, 200_000))
    plan = f.df._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "positionBin" in plan.split("PartitionFilters")[1]
    # A row of many bins is found from its far end.
    long_ = features(spark).unionByName(spark.createDataFrame([("a", 100, 9_000_000)], "referenceName string, start long, end long"))
    GenomicFrame(long_).save_as_partitioned_parquet(p)
    assert parquet.load_meta(spark, p)["longest"] == 8_999_900 and load.load_features(spark, p, "a:8500000-8500001").df.where("start = 100").count() == 1
    q = str(tmp_path / "q")
    GenomicFrame(features(spark)).save_as_parquet(q)
    assert load.load_features(spark, q, "b").df.count() == 30 and parquet.load_meta(spark, str(tmp_path / "none")) == {}


def test_frame(spark):
    f = GenomicFrame(features(spark), Meta(references=(("b", 9), ("a", 9)), samples=("x",)))
    g = f.union(f.with_meta(samples=["y"]))
    assert g.df.count() == 120 and g.meta.samples == ("x", "y") and f.add_meta(samples=["z"]).meta.samples == ("x", "z")
    assert [r.referenceName for r in f.sort().df.limit(1).collect()] == ["b"] and f.sort_lexicographically().df.first().referenceName == "a"
    with pytest.raises(Exception, match="not in the dictionary"):
        f.with_meta(references=[("b", 9)]).sort().df.collect()
    assert f.with_meta(references=[("b", 9)]).sort("lenient").df.count() == 30
    assert f.filter_by_overlapping_region("a", 0, 1).df.count() == 1 and f.filter_by_overlapping_regions([("a", i, i + 1) for i in range(300)]).df.count() == 1
    assert f.shuffle_region_join(f).count() == 60 and f.evenly_repartition(4).df.count() == 60 and f.select("start").df.columns == ["start"] and f.drop("start").project(lambda c: c != "end").df.columns == ["referenceName"]
    with pytest.raises(ValueError):
        f.union(GenomicFrame(f.df, Meta(references=(("a", 1),))))


def parse_bed(df):
    c = F.split("value", "\t")
    return df.select(c[0].alias("referenceName"), c[1].cast("long").alias("start"), c[2].cast("long").alias("end"), *[x for x in df.columns if x != "value"])


def test_pipe(spark, tmp_path):
    df = features(spark).withColumns({"name": F.lit("n"), "score": F.lit(1.0), "strand": F.lit(None).cast("string"), "featureId": F.lit(None).cast("string"), "featureType": F.lit("t")})
    df = df.unionByName(df.where("start = 0").withColumn("start", F.lit(999_990).cast("long")).withColumn("end", F.lit(1_000_010).cast("long")))
    out = pipe(df, "cat", sinks.bed_lines, parse_bed, flank=100)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.select("referenceName", "start", "end").collect()))
    assert pipe(df, "cat", sinks.bed_lines, parse_bed, flank=100, out_fields=None).count() > df.count()
    script = put(tmp_path / "s.py", "import sys\nfor x in sys.stdin:\n    if not x.startswith('#'): print(x, end='')\n")
    assert pipe(df, [sys.executable, "$0"], sinks.bed_lines, parse_bed, header=["#h"], files=[script]).count() == df.count()
    with pytest.raises(Exception, match="ended with 3"):
        pipe(df, [sys.executable, "-c", "import sys; sys.exit(3)"], sinks.bed_lines, parse_bed).collect()
    with pytest.raises(Exception, match="took more than"):
        pipe(df, ["sleep", "30"], sinks.bed_lines, parse_bed, timeout=0.5).collect()


def test_pipe_with_readers_as_parsers(spark, tmp_path):
    reads = load.load_alignments(spark, put(tmp_path / "a.sam", SAM)).df
    out = pipe(reads, "cat", sinks.sam_lines, lambda d: text.read_sam(spark, d))
    assert sorted(r.start for r in out.collect()) == [10, 100] and "_part" not in out.columns
    bed = load.load_features(spark, put(tmp_path / "a.bed", "chr1\t1\t5\tn\t7\t+\n")).df
    assert [r.name for r in pipe(bed, "cat", sinks.bed_lines, lambda d: text.read_bed(spark, d)).collect()] == ["n"]


def test_fragment_lines_and_headers(spark, tmp_path):
    f = load.load_fragments(spark, put(tmp_path / "a.sam", SAM)).df
    assert {r.value for r in sinks.tab5_lines(f).collect()} == {"r1\tACGTACGTAC\tIIIIIIIIII\tACGTACGTAC\tIIIIIIIIII", "r2\tACGT"}
    assert {r.value.split("\t")[3] for r in sinks.tab6_lines(f).collect() if "/1" in r.value} == {"r1/2"} and sinks.interleaved_fastq_lines(f).count() == 1
    line = sinks.header_line("INFO", "AC", "A", "Integer", "count")
    assert text.audit_header(["##x"], [line]) == ["##x", line] and text.audit_header([line.replace("Integer", "Float")], [line], "silent") == [line]
    with pytest.raises(ValueError):
        text.audit_header([line.replace("Number=A", "Number=1")], [line])
    with pytest.raises(ValueError):
        sinks.header_line("INFO", "AC", "Z")


def test_genome_bins(spark):
    refs = [("b", 25), ("a", 11)]
    df = spark.createDataFrame([("a", 0, 10), ("a", 9, 11), ("b", 0, 30), ("z", 0, 1)], "referenceName string, start long, end long")
    first, last = iv.genome_bins(iv.Region.of(), refs, 10)
    assert [tuple(r) for r in df.select(first, last).collect()] == [(0, 0), (0, 1), (2, 4), (None, None)]
    assert iv.invert_bin(4, refs, 10) == ("b", 20, 25)


def test_command_line(spark, tmp_path, capsys):
    sam, out = put(tmp_path / "a.sam", SAM), lambda n: str(tmp_path / n)
    cli.main(["transformAlignments", sam, out("x"), "--mark-duplicates", "--sort", "reference", "--bin-quality-scores", "0,60,20"])
    assert load.load_alignments(spark, out("x")).df.where("qualityScores is not null").select("qualityScores").distinct().collect()[0][0] == "5" * 10
    more = ["--recalibrate", "--realign-indels", "--unclip-reads", "--left-normalize-indels", "--limit-projection", "--aligned-only", "--cache", "--read-group", "g2", "--sampling-fraction", "1.0", "--coalesce", "2", "--force-shuffle", "--sort", "name"]
    cli.main(["transformAlignments", sam, out("y"), *more])
    y = load.load_alignments(spark, out("y"))
    assert y.df.count() == 2 and {r.readGroupId for r in y.df.collect()} == {"g2"} and "attributes" not in y.df.columns and y.meta.steps[-1].startswith("transformAlignments")
    cli.main(["transformAlignments", sam, out("z.bam"), "--single", "--disable-steps", "--md-tag-fragment-size", "9"])
    cli.main(["transformAlignments", out("z.bam"), out("p"), "--load", "bam", "--partition-by-start", "--partition-bin-size", "50"])
    assert spark.read.parquet(out("p")).where("referenceName = '1'").select("positionBin").distinct().count() == 2
    with pytest.raises(ValueError, match="exclude"):
        cli.main(["transformAlignments", sam, out("q"), "--aligned-only", "--regions", "1:0-5"])
    cli.main(["countKmers", sam, out("k"), "4"])
    assert "ACGT\t5" in lines(spark, out("k"))
    cli.main(["coverage", sam, out("c"), "--collapse"])
    assert spark.read.parquet(out("c")).count() == 2
    cli.main(["flagstat", sam])
    cli.main(["view", sam, "-f", "16", "-c"])
    assert capsys.readouterr().out.strip().endswith("1")
    cli.main(["transformVariants", put(tmp_path / "a.vcf", VCF), out("v.vcf"), "--single"])
    assert load.load_variants(spark, out("v.vcf")).df.count() == 4
    cli.main(["toFastq", sam, out("f")])
    cli.main(["transformFragments", sam, out("fr")])
    cli.main(["print", out("fr"), out("j")])
    assert spark.read.parquet(out("fr")).count() == 2 and len(lines(spark, out("j"))) == 2
    cli.main(["transformSlices", put(tmp_path / "a.fa", ">s\nACGTACGT\n"), out("sl")])
    cli.main(["countSliceKmers", out("sl"), out("sk"), "3"])
    assert "ACG\t2" in lines(spark, out("sk"))


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("at"), (F.col("id") % 2).cast("string").alias("k"))
    df.repartition(5).write.parquet(src)
    s = live.windowed_counts(live.read_directory(spark, src, df.schema), "at", "10 minutes", "1 day", ["k"])
    q = s.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("counts").agg(F.sum("n")).collect()[0][0] == 100 and spark.table("counts").count() == 20


def test_genotypes_compute_only_what_is_read(spark):
    """Fields of the variant that nobody reads are pruned, and lines of few splits are dealt out over the cores."""
    lines = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2", "c\t5\t.\tA\tC,G\t.\t.\tAC=1,2\tGT\t0/1\t1|2"]
    g = text.read_genotypes(spark, spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1))
    few = g.select("start", "sampleId", "variant.alternateAllele")
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "referenceAllele" not in plan and "Repartition" in plan
    assert sorted(map(tuple, few.collect())) == [(4, s, a) for s, a in (("s1", "C"), ("s1", "G"), ("s2", "C"), ("s2", "G"))]
    assert sorted(g.select("variant.annotation.alleleCount", "phased").distinct().collect()) == [(n, p) for n in (1, 2) for p in (False, True)]
