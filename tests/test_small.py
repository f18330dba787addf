"""Small fixtures with known answers and brute-force comparisons."""

import datetime
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from genospan.functions import locus as L
from genospan.functions import variants as V
from genospan.operators import annotation as A
from genospan.operators import basemods as B
from genospan.operators import copynumber as C
from genospan.operators import intervals as I
from genospan.operators import packing as P
from genospan.operators import reads as O
from genospan.operators import sampling as S
from genospan.operators import signal as SG
from genospan.operators import variants as OV
from genospan.scale import islands, order_statistics
from genospan.sources import annotations as AN
from genospan.sources import detect, samples, sequences, sinks, tables
from genospan.sources.sam import parse_sam, with_parts
from genospan.sources.variants import parse_vcf, read_vcf


def first_fit(rows, max_rows):
    """Rows of sorted intervals by trying every row from the lowest."""
    ends, out = [], []
    for s, e in rows:
        for r, busy in enumerate(ends[:max_rows]):
            if s >= busy:
                break
        else:
            r = min(len(ends), max_rows)
        if r < len(ends):
            ends[r] = e
        else:
            ends.append(e)
        out.append(r)
    return out


@pytest.mark.parametrize("max_rows,same_start", [(1000, False), (4, False), (6, True)])
def test_packing_equals_sequential_first_fit(spark, max_rows, same_start):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        s = 50 if same_start and i % 3 == 0 else rng.randrange(2000)
        rows.append(("c1" if i % 10 else "c2", s, s + rng.randrange(1, 60), i))
    df = spark.createDataFrame(rows, "chr string, start long, end long, id long")
    got = {r["id"]: r["row"] for r in P.pack_rows(df, ["chr"], tie=["id"], max_rows=max_rows, rows_per_block=40).collect()}
    for c in ("c1", "c2"):
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[3]))
        want = first_fit([(r[1], r[2]) for r in mine], max_rows)
        assert [got[r[3]] for r in mine] == want


@pytest.mark.parametrize("max_rows", [None, 4])
def test_packing_hands_states_on_and_makes_its_input_once(spark, max_rows):
    """Many blocks without a gap, some with one, a long feature over several, groups that end inside a block."""
    rng = random.Random(5)
    rows = [("a", s := rng.randrange(3000) + (4000 if k % 3 == 0 else 0), s + rng.randrange(1, 90), k) for k in range(1200)]
    rows += [("a", 500, 2900, 2000), ("b", 7, 9, 2001)] + [("c", 10 * k, 10 * k + rng.randrange(30), 3000 + k) for k in range(150)]
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, schema := "chr string, start long, end long, id long").mapInArrow(counted, schema)
    got = {r["id"]: r["row"] for r in P.pack_rows(df, ["chr"], tie=["id"], max_rows=max_rows, gap=2, rows_per_block=50).collect()}
    assert made.value == len(rows)
    for c in "abc":
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[3]))
        assert [got[r[3]] for r in mine] == first_fit([(r[1], r[2] + 2) for r in mine], max_rows or 10_000)
    assert P.pack_rows(df.where("false"), ["chr"], tie=["id"]).collect() == []


def test_reads_of_a_row_keep_their_distance(spark):
    rng = random.Random(3)
    rows = [("c", s := rng.randrange(3000), s + 50, 50, i) for i in range(400)]
    df = spark.createDataFrame(rows, "chr string, start long, end long, length_on_ref long, id long")
    packed = P.pack_reads(df, ["chr"], tie=["id"]).collect()
    assert len(packed) == 400
    by_row = {}
    for r in packed:
        by_row.setdefault(r["row"], []).append(r["start"])
    for starts in by_row.values():
        starts.sort()
        assert all(b > a + 50 + 2 for a, b in zip(starts, starts[1:]))


def test_overlap_join_any_layout(spark):
    rng = random.Random(5)
    make = lambda n, top: [("c", s := rng.randrange(100_000), s + rng.choice([0, 5, 200, top]), i) for i in range(n)]
    fs, rs = make(300, 70_000), make(60, 30_000)
    f = spark.createDataFrame(fs, "chr string, start long, end long, id long")
    r = spark.createDataFrame(rs, "chr string, start long, end long, id long")
    for mode, test in I.PREDICATES.items():
        want = {(a[3], b[3]) for a in fs for b in rs if test(a[1], a[2], b[1], b[2])}
        for layout in (None, I.JoinLayout(64), I.JoinLayout(64, 1, 2), I.JoinLayout(100_000)):
            got = [(x["id"], x["region_id"]) for x in I.overlap_join(f, r, mode, layout=layout).collect()]
            assert len(got) == len(set(got)) and set(got) == want, (mode, layout)


def test_scan_blocks_do_not_matter(spark):
    rng = random.Random(1)
    rows = [("c", s := rng.randrange(5000), s + rng.randrange(1, 40)) for _ in range(400)]
    df = spark.createDataFrame(rows, "chr string, start long, end long")
    fine = islands(df, ["chr"], block_bp=16).orderBy("start").collect()
    assert fine == islands(df, ["chr"], block_bp=1 << 20).orderBy("start").collect()
    depth = I.coverage_depth(df, block_bp=16).collect()
    per_base = [0] * 6000
    for _, s, e in rows:
        for p in range(s, e):
            per_base[p] += 1
    for r in depth:
        assert all(per_base[p] == r["depth"] for p in range(r["start"], r["end"]))
    assert sum(r["end"] - r["start"] for r in depth) == sum(d > 0 for d in per_base)


def test_order_statistics_with_ties_and_groups(spark):
    rng = random.Random(2)
    rows = [(i % 3, float(rng.choice([0, 1, 1, 1, 7, rng.random() * 1e6]))) for i in range(700)]
    df = spark.createDataFrame(rows, "g int, v double")
    n = F.col("n").cast("double")
    got = order_statistics(df, "v", {"a": F.floor(n * 0.1), "b": F.floor(n * 0.995), "none": F.col("n")}, ["g"])
    for r in got.collect():
        v = sorted(x for g, x in rows if g == r["g"])
        assert (r["a"], r["b"], r["none"]) == (v[int(len(v) * 0.1)], v[int(len(v) * 0.995)], None)


def sequential_summary(rows, size):
    out, cur = [], None
    for s, e, v in rows:
        sb, eb = s // size, e // size
        if cur and sb == cur[0]:
            cur[1].append(v)
            sb += 1
        if not cur or eb > cur[0]:
            if cur:
                out.append([cur[0] * size, (cur[0] + 1) * size, sum(cur[1]) / len(cur[1])])
            if eb > sb:
                out.append([s, eb * size, v])
            cur = (eb, [v])
    out.append([cur[0] * size, (cur[0] + 1) * size, sum(cur[1]) / len(cur[1])])
    merged = [out[0]]
    for x in out[1:]:
        if x[2] == merged[-1][2] and x[0] <= merged[-1][1]:
            merged[-1][1] = x[1]
        else:
            merged.append(x)
    return [tuple(map(float, x)) for x in merged]


def test_summary_equals_sequential_fold(spark):
    rng = random.Random(11)
    rows, at = [], 0
    for _ in range(300):
        at += rng.choice([0, 0, 3, 40])
        end = at + rng.choice([1, 4, 9, 35])
        rows.append((at, end, float(rng.randrange(3))))
        at = end
    df = spark.createDataFrame([("c", *r) for r in rows], "chr string, start long, end long, value double")
    got = SG.bin_summarize(df, 10, "mean", block_bp=64).orderBy("start", "end").collect()
    assert sorted((r["start"], r["end"], r["value"]) for r in got) == sorted(sequential_summary(rows, 10))


def test_variant_types_and_extents(spark, tmp_path):
    text = (
        "##fileformat=VCFv4.2\n##INFO=<ID=AF,Number=A,Type=Float,Description=\"Allele, frequency\">\n"
        "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tNA1\n"
        "20\t14370\trs1\tG\tA\t29\tPASS\tAF=0.5;DB\tGT:DP\t0|1:8\n"
        "20\t1234567\tm\tGTC\tG,GTCT\t50\tPASS\t.\tGT:DP\t./.:4\n"
        "20\t1234581\ti\tA\tATG\t50\tq10\t.\tGT:DP\t1/1:4\n"
        "20\t100\tsv\tN\t<TRA>\t.\t.\tSVTYPE=TRA;CHR2=21;END=500\tGT:DP\t0/1:4\n"
        "20\t7\tbroken\n"
    )
    (tmp_path / "a.vcf").write_text(text)
    v = OV.with_coordinates(read_vcf(spark, str(tmp_path / "a.vcf")))
    got = {r["names"]: r for r in v.collect()}
    assert {k: r["type"] for k, r in got.items()} == {"rs1": "SNP", "m": "MIXED", "i": "INSERTION", "sv": "SV"}
    assert (got["i"]["start"], got["i"]["end"]) == (1234580.5, 1234581.5)
    assert (got["m"]["start"], got["m"]["end"]) == (1234567.0, 1234569.0)
    assert (got["sv"]["start"], got["sv"]["end"]) == (99.0, 100.0)
    assert got["rs1"]["info"] == {"AF": "0.5", "DB": None} and got["rs1"]["calls"][0]["genotype"] == ["0", "1"]
    mates = OV.sv_breakends(v).where("is_mate").collect()
    assert [(m["chr"], m["start"], m["end"]) for m in mates] == [("21", 499.0, 500.0)]
    assert v.where(V.is_large_sv()).count() == 1


def test_base_modifications_by_hand(spark):
    head = "\t".join(["r1", "0", "c", "101", "60", "8M", "*", "0", "0", "ACGCTCAC", "IIIIIIII", "MM:Z:C+mh?,1,0;", "ML:B:C,10,200,255,0"])
    back = "\t".join(["r2", "16", "c", "101", "60", "8M", "*", "0", "0", "ACGCTCAG", "IIIIIIII", "MM:Z:C+m.,1;", "ML:B:C,90"])
    lines = spark.createDataFrame([(head,), (back,)], "value string")
    reads = with_parts(parse_sam(lines))
    mods = {(r["read_id"], r["mod"], r["read_idx"]): r["likelihood"] for r in B.parse_base_mods(reads).collect()}
    # r1 has C at 1, 3, 5, 7; one is skipped, then two are called.  r2 runs backwards over the G at 7 and 2.
    assert mods == {
        ("r1", "m", 3): 10, ("r1", "h", 3): 200, ("r1", "m", 5): 255, ("r1", "h", 5): 0,
        ("r2", "m", 7): 0, ("r2", "m", 2): 90,
    }
    calls = {(r["read_id"], r["pos"]): (r["mod"], r["likelihood"], r["no_mod_likelihood"]) for r in B.base_mod_calls(reads).collect()}
    assert calls[("r1", 103)] == ("h", 200, 45) and calls[("r2", 102)] == ("m", 90, 165)
    two = B.base_mod_counts(B.base_mod_calls(reads), include_no_mods=True).where("pos = 102").collect()
    assert [(r["mod"], r["count"]) for r in two] == [("NONE_C", 1)]
    assert {r["mod"] for r in B.simplex_mods(B.parse_base_mods(reads)).collect()} == {"m", "h", "NONE_C"}


def test_cigar_parts(spark):
    line = "\t".join(["r", "0", "c", "11", "60", "3S10M2D5M1I4M100N6M", "=", "200", "0", "A" * 29, "*", "RG:Z:a:b"])
    r = with_parts(parse_sam(spark.createDataFrame([(line,)], "value string"))).first()
    assert [(p["op"], p["pos"], p["off"], p["len"]) for p in r["parts"]] == [
        ("S", 7, 0, 3), ("M", 10, 3, 10), ("D", 20, 13, 2), ("M", 22, 13, 5), ("I", 27, 18, 1), ("M", 27, 19, 4), ("N", 31, 23, 100), ("M", 131, 23, 6),
    ]
    assert r["end"] == 137 and r["mate_chr"] == "c" and r["mate_pos"] == 199 and r["tags"]["RG"] == "a:b"


def test_files_in_order(spark, tmp_path):
    (tmp_path / "a.wig").write_text(
        "track type=wiggle_0\nfixedStep chrom=c1 start=101 step=10 span=5\n1\nNA\n3\nvariableStep chrom=c2 span=2\n7 4.5\n"
    )
    wig = sorted(tuple(r) for r in AN.read_wig(spark, str(tmp_path / "a.wig")).collect())
    assert wig == [("c1", 100, 105, 1.0), ("c1", 120, 125, 3.0), ("c2", 6, 8, 4.5)]
    (tmp_path / "a.fa").write_text(">c1 x\nACGT\nAC\n>c2:101-106 @len=900\nGGG\nTTT\n")
    fa = sequences.read_fasta(spark, str(tmp_path / "a.fa"))
    assert sorted((r["chr"], r["offset"], r["seq"]) for r in fa.collect()) == [("c1", 0, "ACGT"), ("c1", 4, "AC"), ("c2", 100, "GGG"), ("c2", 103, "TTT")]
    assert {r["chr"]: r["length"] for r in sequences.fasta_lengths(fa).collect()} == {"c1": 6, "c2": 900}
    (tmp_path / "s.txt").write_text("#sampleTable\nid\tage now\tkind\na\t7\tx\nb\t\ty\n#sampleMapping\nt1\ta\n")
    info = samples.read_sample_info(spark, str(tmp_path / "s.txt"))
    att = {(r["sample"], r["attribute"]): (r["str_value"], r["num_value"]) for r in info["attributes"].collect()}
    assert att == {("a", "age-now"): (None, 7.0), ("a", "kind"): ("x", None), ("b", "age-now"): ("-", None), ("b", "kind"): ("y", None)}
    assert [tuple(r) for r in info["mapping"].collect()] == [("t1", "a")]
    (tmp_path / "x.aed").write_text(
        'bio:sequence(aed:String)\tbio:start(aed:Integer)\tbio:end(aed:Integer)\taed:name(aed:String)\nchr1\t10\t20\t"two\nlines ""q"""\n'
    )
    aed = sequences.read_aed(spark, str(tmp_path / "x.aed")).collect()
    assert len(aed) == 1 and aed[0]["attributes"]["aed:name"] == 'two\nlines "q"'


def test_writers_and_shards(spark, tmp_path):
    rows = [(f"c{i % 3}", i * 10, i * 10 + 5, f"n{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "chr string, start long, end long, name string")
    sinks.write_intervals(df, str(tmp_path / "p"), partitions=4)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert I.range_query(back, "c1", 100, 200).count() == sum(r[0] == "c1" and r[1] <= 200 and r[2] >= 100 for r in rows)
    plan = I.range_query(back, "c1", 100, 200)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chr" in plan and "LessThanOrEqual(start,200)" in plan
    sinks.write_bed(df, str(tmp_path / "b"))
    assert detect.read_any(spark, str(tmp_path / "b"), "bed").select("chr", "start", "end", "name").exceptAll(df).count() == 0
    sinks.write_features(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 60
    for c in ("c0", "c1"):
        (tmp_path / f"{c}.bed").write_text(f"{c}\t1\t2\n")
    got = tables.read_sharded(spark, str(tmp_path / "$CHR.bed"), ["c0", "c1", "missing"], AN.read_bed, only=["c1"])
    assert [r["chr"] for r in got.collect()] == ["c1"]


def test_formats_by_name():
    cases = {"a.vcf.gz": "vcf", "x/refGene.txt.gz": "refgene", "q.bedpe.txt": "bedpe", "s.fa": "fasta", "b.bw": "bigwig", "t.narrowPeak": "narrowpeak", "n.xyz": None}
    assert {k: detect.detect_format(k) for k in cases} == cases
    assert detect.track_type("maf") == "mut" and detect.track_type("gff3") == "annotation" and detect.track_type(None) is None


def test_transcript_with_parts_only(spark):
    text = "c\ts\t{}\t{}\t{}\t.\t-\t{}\t{}"
    gtf = 'gene_id "g"; transcript_id "t";'
    lines = [
        text.format("exon", 101, 200, ".", gtf), text.format("CDS", 151, 200, "0", gtf), text.format("five_prime_UTR", 301, 350, ".", gtf),
        text.format("CDS", 251, 300, "1", gtf),
    ]
    rows = AN.parse_gff(spark.createDataFrame([(x,) for x in lines], "value string"), "gtf")
    t = A.assemble_transcripts(rows, "gtf").collect()
    assert len(t) == 1 and (t[0]["start"], t[0]["end"], t[0]["cds_start"], t[0]["cds_end"]) == (100, 350, 150, 300)
    exons = [(e["start"], e["end"], e["cds_start"], e["cds_end"], e["number"], e["made"]) for e in t[0]["exons"]]
    assert exons == [(100, 200, 150, 200, 2, False), (250, 350, 250, 300, 1, True)]


def test_hgvs_forms(spark):
    terms = ["NC_1.1:g.123_?del", "NM_1.2(GENE):c.25+3A>G", "NM_1:c.-4-10", "NM_1:c.*7_*9del", "NR_1:n.-5", "NP_1:p.Val600Glu", "chr1:5-9", "x"]
    got = spark.createDataFrame([(t,) for t in terms], "t string").select("t", L.hgvs_parse(F.col("t")).alias("h")).collect()
    h = {r["t"]: r["h"] and tuple(r["h"]) for r in got}
    assert h["NC_1.1:g.123_?del"] == ("NC_1.1", "g", None, 123, 123, 0, 0)
    assert h["NM_1.2(GENE):c.25+3A>G"] == ("NM_1.2", "c", None, 25, 25, 3, 3)
    assert h["NM_1:c.-4-10"] == ("NM_1", "c", "5", 4, 4, -10, -10)
    assert h["NM_1:c.*7_*9del"] == ("NM_1", "c", "3", 7, 9, 0, 0)
    assert h["NR_1:n.-5"][3] == -5 and h["chr1:5-9"] is None and h["x"] is None


def test_downsampling_keeps_whole_names(spark):
    rows = [(f"r{i // 2}", "c", 1000 + (i // 2) % 3 * 100 + i % 2 * 500) for i in range(400)]
    df = spark.createDataFrame(rows, "read_name string, chr string, start long")
    kept = S.downsample_reads(df, depth=10)
    counts = kept.groupBy("read_name").count().collect()
    assert len(counts) == 30 and all(r["count"] == 2 for r in counts)
    assert kept.exceptAll(S.downsample_reads(df, depth=10)).count() == 0


def test_copy_number_dip_is_found(spark):
    rng = random.Random(4)
    rows = [("c1", i * 10_000, 100.0 * (0.5 if 200 <= i < 300 else 1.0) + rng.gauss(0, 3)) for i in range(600)]
    bins = spark.createDataFrame(rows, "chr string, start long, score double").withColumn("score", F.col("score") * 60)
    stats = spark.createDataFrame([(6000.0, 250.0)], "mean double, sd double")
    levels = C.meanshift_segments(bins, stats, 10_000)
    calls = C.cnv_calls(levels, stats, 10_000).collect()
    assert [r["kind"] for r in calls] == ["deletion"]
    assert abs(calls[0]["start"] - 2_000_000) <= 50_000 and abs(calls[0]["end"] - 3_000_000) <= 50_000


def test_bell_curve_fit():
    import numpy as np

    x = np.arange(0, 400, 4.0)
    y = 9000 * np.exp(-((x - 150) ** 2) / (2 * 20**2)) / (np.sqrt(2 * np.pi) * 20)
    area, mean, sd = C._fit_normal(x, y)
    assert abs(mean - 150) < 1e-3 and abs(sd - 20) < 1e-3 and abs(area - 9000) < 1


def test_pair_and_sort(spark):
    cols = ["60", "10M", "=", "500", "100", "ACGTACGTAC", "IIIIIIIIII"]
    lines = ["\t".join(["p", "99", "c", "101", *cols]), "\t".join(["p", "147", "c", "301", *cols]), "\t".join(["q", "0", "c", "105", "10", "10M", "*", "0", "0", "T" * 10, "*"])]
    reads = with_parts(parse_sam(spark.createDataFrame([(x,) for x in lines], "value string")))
    p = O.pair_mates(reads).collect()
    assert [(r["read_name"], r["start"], r["end"]) for r in p] == [("p", 100, 310)]
    order = [r["read_name"] for r in O.sort_reads_at(reads, "c", 106, "BASE", ref="G").collect()]
    assert order[0] == "q" and len(order) == 3


def test_hgvs_ends_and_unreadable_terms(spark):
    terms = ["NM_1:c.10+2_12-3del", "NM_1:n.5_9+2del", "NM_1:c.10_*5del", "NC_1:g.(4_9)del", "NM_1:x.4", "NM_1:c.del", ":c.4", "NM_1():c.4", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(terms)], "k int, t string").select("k", L.hgvs_parse(F.col("t")).alias("h"), L.hgvs_valid(F.col("t")).alias("ok")).orderBy("k").collect()
    ends = [r["h"] and (r["h"]["pos1"], r["h"]["pos2"], r["h"]["offset1"], r["h"]["offset2"]) for r in got]
    assert ends[:4] == [(10, 12, 2, -3), (5, 9, 0, 2), (10, 10, 0, 0), (4, 9, 0, 0)]
    assert [r["ok"] for r in got] == [True] * 4 + [False] * 5


def test_bed_rows_keep_many_blocks(spark):
    n = 1200
    row = "\t".join(["chr1", "0", str(n * 10), "a", "0", "+", "0", str(n * 10), "0", str(n), "5," * n, ",".join(str(10 * k) for k in range(n))])
    got = AN.parse_bed(spark.createDataFrame([(row,)], "value string")).select(F.size("exons").alias("n")).first()
    assert got["n"] == n


@pytest.mark.parametrize("mode", ["closed", "mixed", "signal", "half"])
def test_overlap_totals_without_pairs(spark, mode):
    """Counts and sums as by brute force, with empty and reversed rows, ties and repeated ids; and no join of pairs."""
    rng = random.Random(5)
    span = lambda most: (lambda s: (s, s + rng.choice([0, 1, 2, most, -2])))(rng.randrange(60))
    features = [(rng.choice("ab"), *span(7), rng.choice([None, *range(9)])) for _ in range(150)] + [(None, 1, 5, 1), ("a", None, 5, 1), ("b", 3, None, 1)]
    regions = [(rng.choice("abc"), *span(20), k % 25) for k in range(40)]
    f = spark.createDataFrame(features, "chr string, start long, end long, w long")
    r = spark.createDataFrame(regions, "chr string, start long, end long, region_id long")
    got = {x["region_id"]: (x["n"], x["w"]) for x in I.overlap_totals(f, r, mode, sums=["w"]).collect()}
    meets = {"closed": lambda s, e, a, b: s <= b and e >= a, "mixed": lambda s, e, a, b: s <= b and e > a,
             "signal": lambda s, e, a, b: s < b and e >= a, "half": lambda s, e, a, b: s < b and e > a}[mode]
    want = {}
    for c, a, b, k in regions:
        for d, s, e, w in features:
            if d == c and None not in (s, e) and meets(s, e, a, b):
                n, t = want.get(k, (0, None))
                want[k] = (n + 1, t if w is None else (t or 0) + w)
    assert got == want
    plain = I.overlap_totals(f.where("start <= end"), r.where("start < end"), mode)
    assert "__bin" not in plain._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("hot", [3, 10**6])
@pytest.mark.parametrize("kind", ["seg", "mut", "sum"])
def test_region_scores_finished_in_one_bin(spark, kind, hot):
    """As by brute force: long and reversed rows, null values and samples, ids that come twice; no pair is shuffled."""
    rng = random.Random(11)
    span = lambda lengths: (lambda s: (s, s + rng.choice(lengths)))(rng.randrange(3000))
    features = [(rng.choice("ab"), *span([0, 3, 9, -4, 2000]), rng.choice(["x", "y", "z", None]), rng.choice([1, 5, -2, None])) for _ in range(150)]
    regions = [(rng.choice("abc"), *span([0, 5, 40, 900, -3]), k if k > 3 else None if k > 1 else 1) for k in range(40)]
    f = spark.createDataFrame(features, "chr string, start long, end long, sample string, value long")
    r = spark.createDataFrame(regions, "chr string, start long, end long, region_id long")
    layout = I.JoinLayout(8, 0, 1)
    got = {(x["region_id"], x["sample"]): x["score"] for x in I.region_scores(f, r, kind, layout=layout, hot_bin_rows=hot).collect()}
    want, size = {}, {}
    for c, a, b, k in regions:
        for d, s, e, who, v in features:
            if c == d and s <= b and e >= a:
                term = 1 if kind == "mut" else None if v is None else v * (min(b, e) - max(a, s)) if kind == "seg" else v
                old = want.get((k, who))
                want[k, who] = old if term is None else (old or 0) + term
                size[k, who] = max(size.get((k, who), b - a + 1), b - a + 1)
    if kind == "seg":
        want = {key: None if v is None or not size[key] else v / size[key] for key, v in want.items()}
    assert got == want
    single = I.region_scores(f, r.where("region_id > 3"), kind, layout=layout)
    plan = single._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Aggregate" not in plan.split("FlatMapGroupsInArrow")[0]


def test_transcript_at_without_pairs(spark):
    """The first transcript at every point as by brute force, with ties, nested and reversed ones, and no join of pairs."""
    rng = random.Random(3)
    tx = [(rng.choice("ab"), s, s + rng.choice([0, 2, 9, 9, 40, -3]), f"t{rng.randrange(60)}") for s in [rng.randrange(80) for _ in range(70)]]
    points = [(k % 150, rng.choice(["a", "b", "c", None]), rng.choice([*range(130), None])) for k in range(200)]
    p = spark.createDataFrame(points, "point_id long, chr string, pos long")
    t = spark.createDataFrame(tx, "chr string, start long, end long, id string")
    found = A.transcript_at(p, t)
    got = sorted((r["point_id"], str(r["chr"]), str(r["pos"]), str(r["transcript_id"]), str(r["tx_end"])) for r in found.collect())
    want = []
    for k, c, at in points:
        met = sorted((s, i, e) for d, s, e, i in tx if d == c and at is not None and s <= at <= e)
        want.append((k, c, at, *((met[0][1], met[0][2]) if met else (None, None))))
    assert got == sorted((k, *map(str, rest)) for k, *rest in want)
    assert "__bin" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_mod_kinds_hand_on_each_kind_once(spark):
    """Simplex keys from the kinds of each batch equal those from all calls, and so few rows are handed on."""
    mms = ["C+m,0;", "C+m,0;A+a,0;", "G-h,0;", "A-a,0;", "T+x,9;", "C+mh,0;"]
    rows = [(f"r{k}", "1", "ACGTACGT", 0, {"MM": mms[k % len(mms)]}) for k in range(60)]
    reads = spark.createDataFrame(rows, "read_name string, chr string, seq string, flags int, tags map<string,string>").coalesce(1)
    kinds, mods = B.mod_kinds(reads), B.parse_base_mods(reads)
    assert sorted(kinds.collect()) == sorted(mods.select("base", "strand", "mod").distinct().collect())
    got = sorted(r["mod"] for r in B.simplex_mods(kinds).collect())
    assert got == sorted(r["mod"] for r in B.simplex_mods(mods).collect()) == ["NONE_C", "m"]
    plan = B.simplex_mods(mods)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_sam_tags_with_and_without_repeats(spark):
    """Of a repeated tag the last stays; a value keeps its colons; malformed tags are dropped."""
    head = "r\t0\t1\t5\t9\t3M\t*\t0\t0\tACG\tIII"
    lines = [f"{head}\tAA:Z:x:y\tBB:i:1", f"{head}\tAA:Z:1\tBB:i:2\tAA:Z:3", head, f"{head}\tbad\tCC:Z:"]
    got = [r["tags"] for r in parse_sam(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)).collect()]
    assert got == [{"AA": "x:y", "BB": "1"}, {"BB": "2", "AA": "3"}, {}, {"CC": ""}]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_table_is_dealt_by_size(spark):
    """More parts than cores once a part would be larger than what Spark advises."""
    from genospan.plans.views import spread

    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        dealt = spread(spark.range(400_000), "id")
        assert dealt.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_sam_line_is_split_once(spark):
    line = "r1\t16\tc\t11\t 7x\t3S4M2D5M5M\t=\t-4\t-12.5\tACG\t*\tRG:Z:a:b\tbad\t:Z:x\tNM:i:"
    lines = spark.createDataFrame([(line,)], "value string")
    reads = O.read_filter(with_parts(parse_sam(lines)))
    got = reads.first()
    assert (got.flags, got.start, got.mq, got.mate_pos, got.tlen) == (16, 10, 7, -5, -12)
    assert got.tags == {"RG": "a:b", "NM": ""}
    assert [(p.op, p.len, p.pos, p.off) for p in got.parts] == [("S", 3, 7, 0), ("M", 4, 10, 3), ("D", 2, 14, 7), ("M", 10, 16, 7)]
    assert plan_of(reads.where("size(parts) > 0")).count("split(value") == 1


def test_variant_extent_is_computed_once(spark):
    line = "c\t10\tv\tGTC\tG,GTCT\t.\t.\tAC=1;F;AC=2=x\tGT\t0/1"
    rows = OV.with_coordinates(parse_vcf(spark.createDataFrame([(line,)], "value string"), ["S"]))
    got = rows.first()
    assert (got.start, got.end, got.info) == (10.0, 12.0, {"AC": "2", "F": None})
    near = rows.where("start <= 20 and end >= 5")
    assert near.count() == 1
    assert plan_of(near).count("array_position") == plan_of(rows.select("start")).count("array_position") <= 4


def test_attributes_are_cut_once(spark):
    text = "a=1;b = x=y ; =2;c=;a=3"
    rows = AN.parse_bed(spark.createDataFrame([(f"c\t1\t2\t{text.replace(' ', '')};",)], "value string")).select("attributes")
    assert rows.first().attributes == {"b": "x=y", "a": "3"}
    assert plan_of(rows).count(", ;, -1)") == 1
    gff = AN.parse_gff(spark.createDataFrame([("c\ts\tmRNA\t1\t9\t.\t+\t.\tID=t%3B1; Parent = g ;ID=t%252",)], "value string")).first()
    assert (gff.id, gff.parent, gff.attributes) == ("t%2", "g", {"Parent": "g", "ID": "t%2"})


def test_base_modifications_of_a_batch_at_once():
    """Reads of one text, of both strands, with and without likelihoods, are counted together."""
    reads = [
        ("r1", "c", "ACCGC", False, "C+m?,1,0;", "C,10,20", [100], [0], [5]),
        ("r2", "c", "GCGGT", True, "C+m?,1,0;", "C,30,40", [200], [1], [4]),
        ("r3", "c", "CCA", False, "C+mh.,0;N+a,2;", None, [300], [0], [3]),
        ("r4", "c", "CC", False, "C+m?,1,0;", "C,7", [400], [0], [9]),
        ("r5", "c", "", False, ";C+m;", "C", [500], [0], [1]),
    ]
    lists = pa.list_(pa.int64())
    types = [pa.string()] * 3 + [pa.bool_()] + [pa.string()] * 2 + [lists] * 3
    names = ["read_id", "chr", "seq", "reverse", "mm", "ml", "pos", "off", "len"]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*reads), types, strict=True)], names=names)
    (read, set_no, kind, at, likelihood), kinds, _, _ = B._mods(batch)
    got = sorted((reads[r][0], int(s), kinds[k][2], int(a), int(x)) for r, s, k, a, x in zip(read, set_no, kind, at, likelihood))
    want = [("r1", 0, "m", 2, 10), ("r1", 0, "m", 4, 20), ("r2", 0, "m", 0, 40), ("r2", 0, "m", 2, 30)]
    want += [("r3", 0, "m", 0, 255), ("r3", 0, "m", 1, 0), ("r3", 1, "h", 0, 255), ("r3", 1, "h", 1, 0), ("r3", 2, "a", 2, 255)]
    assert got == sorted([*want, ("r4", 0, "m", 1, 7)])


def test_full_packing_takes_tied_reads_by_id(spark, tmp_path):
    """Reads of one order and line number share start, name and flags; their rows follow fid, however the table is laid."""
    import __spark_entry__ as entry

    day = datetime.datetime(1996, 9, 13)
    lines = [(7 + k % 2, 12 * 41 * 53 * 59 * 61 * (k + 1) + 1, 1, 1, 20.0, 1.0, 0.0, 0.0, "A", "F", day) for k in range(60)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    names += ", l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    random.Random(2).shuffle(lines)
    spark.createDataFrame(lines, names).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = entry.queries()["pack_full"](spark, str(tmp_path)).collect()
    fids = [((x[0] * 8 + 1) * 1_000_000 + x[1]) * 10_000 + 70 for x in sorted(lines)]
    assert sorted((x["row"], x["fid"], x["chr"]) for x in got) == [(n, fid, "AF") for n, fid in enumerate(fids)]
