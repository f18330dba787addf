"""Readers over several files whose headers differ, and awkward lines."""

import pytest
from pyspark.sql import functions as F

from genospan.sources import tables as T
from genospan.sources.sam import parse_sam
from genospan.sources.sequences import genbank_features, read_genbank
from genospan.sources.variants import read_vcf


@pytest.fixture()
def folder(tmp_path, spark):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))

    def write(name, **files):
        (tmp_path / name).mkdir()
        for k, lines in files.items():
            (tmp_path / name / f"{k}.txt").write_text("\n".join(lines) + "\n")
        return str(tmp_path / name)

    return write


def tab(*cells):
    return "\t".join(map(str, cells))


def test_vcf_samples_per_file(spark, folder):
    head = "##fileformat=VCFv4.2"
    fixed = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
    path = folder(
        "vcf",
        two=[head, tab(*fixed, "FORMAT", "ann", "bob"), tab("1", 10, ".", "A", "C", ".", "PASS", "DP=3", "GT:DP", "0/1:4", "1/1:5")],
        one=[head, tab(*fixed, "FORMAT", "cat"), tab("1", 20, ".", "G", "T", ".", "PASS", ".", "GT", "0|1"), tab("1", 21, "x", "G", "T", ".", ".", ".", "GT", "0|0")],
        none=[head, tab(*fixed), tab("2", 30, ".", "G", "T", ".", "PASS", "AF=0.1")],
        short=[head, tab(*fixed, "FORMAT", "dan"), tab("2", 40, ".", "G", "T", ".", "PASS", ".")],
    )
    got = {r["pos"]: [(c["sample"], c["genotype"]) for c in r["calls"]] for r in read_vcf(spark, path).collect()}
    assert got == {10: [("ann", ["0", "1"]), ("bob", ["1", "1"])], 20: [("cat", ["0", "1"])], 21: [("cat", ["0", "0"])], 30: []}


def test_segments_per_file(spark, folder):
    path = folder(
        "seg",
        short=[tab("ID", "chrom", "start", "end", "mean"), tab("s1", "1", 11, 20, 0.5)],
        wide=["# made by hand", tab("ID", "chrom", "start", "end", "probes", "note", "mean"), tab("s2", "2", 31, 40, 7, "n", -1.5), tab("s3", "2", 51, 60, 8, "m", 2)],
    )
    rows = {r["sample"]: r for r in T.read_segments(spark, path).collect()}
    assert {k: (r["chr"], r["start"], r["end"], r["value"]) for k, r in rows.items()} == {
        "s1": ("1", 10, 20, 0.5), "s2": ("2", 30, 40, -1.5), "s3": ("2", 50, 60, 2.0)
    }
    assert rows["s1"]["attributes"] is None
    assert rows["s3"]["attributes"] == {"probes": "8", "note": "m", "mean": "2"}


def test_mutations_per_file(spark, folder):
    path = folder(
        "mut",
        a=[tab("chr", "start", "end", "sample", "type"), tab("1", 1, 2, "s1", "Silent")],
        b=[tab("chr", "start", "end", "sample", "type", "ref"), tab("1", 5, 6, "s2", "Missense", "A")],
    )
    rows = {r["sample"]: r for r in T.read_segments(spark, path, "mut").collect()}
    assert rows["s1"]["value"] == "Silent" and rows["s1"]["attributes"] is None
    assert rows["s2"]["value"] == "Missense" and rows["s2"]["attributes"] == {"type": "Missense", "ref": "A"}


def test_gwas_columns_per_file(spark, folder):
    path = folder(
        "gwas",
        a=[tab("CHR", "BP", "SNP", "P"), tab("1", 100, "rs1", "1e-5"), tab("1", "7;8", "rs2", "0.1")],
        b=[tab("SNP", "PVALUE", "POS", "CHROMOSOME", "NOTE"), tab("rs3", "1e-400", 200, "2", "n")],
    )
    rows = {r["attributes"]["SNP"]: (r["chr"], r["start"], r["value"]) for r in T.read_gwas(spark, path).collect()}
    assert rows == {"rs1": ("1", 99, 1e-5), "rs3": ("2", 199, T.SMALLEST_DOUBLE)}
    given = T.read_gwas(spark, path, {"chromosome": 1, "position": 2, "value": 4}).where("start = 99").collect()
    assert [(r["chr"], r["value"]) for r in given] == [("1", 1e-5)]


def test_qtl_columns_per_file(spark, folder):
    path = folder(
        "qtl",
        a=[tab("CHR", "SNP", "BP", "P", "Phenotype"), tab("1", "rs1", 100, "0.5", "g1")],
        b=[tab("gene_id", "variant", "pval", "position", "chrom"), tab("g2", "rs2", "0.25", 300, "3")],
    )
    rows = sorted(tuple(r) for r in T.read_qtl(spark, path).drop("attributes").collect())
    assert rows == [("1", 99, 100, 0.5, "rs1", "g1"), ("3", 299, 300, 0.25, "rs2", "g2")]


def test_bedpe_headers_per_file(spark, folder):
    pair = ("1", 10, 20, "1", 30, 40)
    path = folder(
        "bedpe",
        donut=[tab("#chr1", "x1", "x2", "chr2", "y1", "y2", "color", "fdrDonut"), tab(*pair, "0,255,255", "0.01")],
        plain=[tab("2", 10, 20, "2", 30, 40, "n1", "5", "+", "-")],
        scored=[tab("3", 10, 20, "4", 30, 40, "17")],
        extra=[tab("chr1", "s1", "e1", "chr2", "s2", "e2", "name", "score", "st1", "st2", "depth"), tab("5", 1, 2, "5", 3, 4, "n2", ".", "+", "-", "99")],
    )
    rows = {(r["chr"], r["dup"]): r for r in T.read_bedpe(spark, path).collect()}
    assert set(rows) == {("1", False), ("2", False), ("3", False), ("4", True), ("5", False)}
    assert rows["1", False]["extras"] == {"color": "0,255,255", "fdrDonut": "0.01"} and rows["1", False]["name"] is None
    assert (rows["2", False]["name"], rows["2", False]["score"], rows["2", False]["strand2"]) == ("n1", 5.0, "-")
    assert (rows["4", True]["name"], rows["4", True]["score"]) == (None, 17.0)
    assert rows["5", False]["extras"] == {"depth": "99"} and rows["5", False]["name"] == "n2"


def test_matrix_samples_per_file(spark, folder):
    path = folder(
        "matrix",
        a=[tab("chr", "start", "end", "A", "B"), tab("1", 0, 10, 1, 2), tab("1", 10, 20, 1)],
        b=[tab("#CHR", "start", "end", "C"), tab("2", 0, 10, 3.5)],
    )
    rows = sorted(tuple(r) for r in T.melt_matrix(T.read_matrix(spark, path)).collect())
    assert rows == [("1", 0, 10, "A", 1.0), ("1", 0, 10, "B", 2.0), ("2", 0, 10, "C", 3.5)]


def test_large_header_tables_are_joined_by_shuffle(spark, folder, monkeypatch):
    from genospan.sources import lines

    monkeypatch.setattr(lines, "MOST_SENT_BYTES", 0)
    path = folder("seg2", a=[tab("ID", "c", "s", "e", "v"), tab("s1", "1", 1, 2, 3)], b=[tab("ID", "c", "s", "e", "x", "v"), tab("s2", "1", 1, 2, 3, 4)])
    assert sorted((r["sample"], r["value"]) for r in T.read_segments(spark, path).collect()) == [("s1", 3.0), ("s2", 4.0)]


def test_repeated_tag_keeps_the_last(spark):
    line = tab("r", 0, "1", 5, 60, "4M", "*", 0, 0, "ACGT", "IIII", "NM:i:1", "XA:Z:a:b", "NM:i:2")
    tags = parse_sam(spark.createDataFrame([(line,)], "value string")).first()["tags"]
    assert tags == {"NM": "2", "XA": "a:b"}


def test_long_genbank_qualifier(spark, folder):
    note = "word " * 9_000
    record = [
        "LOCUS       X 20 bp DNA", "FEATURES             Location/Qualifiers", "     gene            1..10",
        '                     /gene="abc"', f'                     /note="{note}with ""quotes"""', "ORIGIN", "        1 acgtacgtac gtacgtacgt", "//",
    ]
    features = genbank_features(read_genbank(spark, folder("gb", a=record))).collect()
    assert len(features) == 1
    assert features[0].asDict(recursive=True)
    text = str(features[0])
    assert len(text) > 40_000 and "abc" in text


def test_complement_pairs(spark):
    from genospan.functions.sequence import IUPAC, complement

    row = spark.createDataFrame([(IUPAC + "NacgtwsX",)], "s string").select(complement(F.col("s")), complement(complement(F.col("s")))).first()
    assert row[0] == "TGCARYWSMKHDVBNtgcawsX"
    assert row[1] == IUPAC + "NacgtwsX"


def test_pileup_of_awkward_reads(spark, monkeypatch):
    """Counts against a plain loop: missing bases and qualities, gaps, insertions, clips, lower case, a deep place."""
    from collections import Counter

    from genospan.operators import reads as O
    from genospan.sources.sam import with_parts

    monkeypatch.setattr(O, "EVENTS_AT_ONCE", 11)
    rows = [
        ("a", 0, 5, "4M", "ACGT", "IIII"), ("b", 16, 5, "2M1D2M", "acgt", "!!##"), ("c", 0, 6, "2S2M1I3M", "TTACGNNR", "*"),
        ("d", 16, 9, "3M", "*", "*"), ("e", 0, 7, "1M2N2M", "CC", "5"), ("f", 0, 7, "2=1X", "GGG", "AB"),
    ] + [(f"g{k}", 16 * (k % 2), 8, "3M", "ACT", "III") for k in range(50)]
    lines = [tab(n, f, "1", p, 60, c, "*", 0, 0, s, q) for n, f, p, c, s, q in rows]
    got = O.pileup(with_parts(parse_sam(spark.createDataFrame([(x,) for x in lines], "value string")))).collect()
    want: dict = {}
    import re

    for _, flags, pos, cigar, seq, qual in rows:
        at, off = pos - 1, 0
        for n, op in re.findall(r"(\d+)(\D)", cigar):
            for k in range(int(n)):
                here = want.setdefault(at + (0 if op == "I" else k), Counter()) if op in "M=XD" or (op == "I" and k == 0) else None
                if op in "M=X":
                    base = "N" if seq == "*" or off + k >= len(seq) else seq[off + k].upper()
                    q = 30 if qual == "*" or off + k >= len(qual) else ord(qual[off + k]) - 33
                    here["total"] += 1
                    here["qual"] += q
                    if base in "ACGTN":
                        here[("neg" if flags & 16 else "pos") + base] += 1
                        here["qual" + base] += q
                elif op == "D":
                    here["del"] += 1
                elif op == "I" and k == 0:
                    here["ins"] += 1
            at += int(n) if op in "M=XDN" else 0
            off += int(n) if op in "M=XIS" else 0
    have = {r["pos"]: {c: r[c] for c in O.COUNTERS if r[c]} for r in got}
    assert have == {p: {c: n for c, n in counts.items() if n} for p, counts in want.items()}
