"""File name to format, format to track type, and the reader for a format."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from genospan.sources import annotations as A
from genospan.sources import sam, samples, sequences, tables, variants
from genospan.sources.lines import ordered_lines, read_lines


def _from_lines(parse: Callable[[DataFrame], DataFrame]):
    return lambda spark, path: parse(read_lines(spark, path))


def _from_ordered(parse: Callable[[DataFrame], DataFrame]):
    return lambda spark, path: parse(ordered_lines(spark, path))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bed": A.read_bed,
    "broadpeak": A.read_peaks,
    "narrowpeak": A.read_peaks,
    "regionpeak": A.read_peaks,
    "peaks": A.read_peaks,
    "gappedpeak": _from_lines(A.parse_gapped_peak),
    "bedmethyl": A.read_bedmethyl,
    "bedgraph": A.read_bedgraph,
    "bg": A.read_bedgraph,
    "wig": A.read_wig,
    "genepred": A.read_genepred,
    "genepredext": partial(A.read_genepred, kind="genePredExt"),
    "refgene": partial(A.read_genepred, kind="refGene"),
    "ensgene": partial(A.read_genepred, kind="ensGene"),
    "refflat": partial(A.read_genepred, kind="refFlat"),
    "psl": A.read_psl,
    "rmsk": A.read_rmsk,
    "snp": A.read_snp,
    "gff": A.read_gff,
    "gff3": A.read_gff,
    "gtf": partial(A.read_gff, kind="gtf"),
    "vcf": variants.read_vcf,
    "sam": sam.read_sam,
    "seg": tables.read_segments,
    "mut": partial(tables.read_segments, kind="mut"),
    "maf": partial(tables.read_segments, kind="maf"),
    "bedpe": tables.read_bedpe,
    "hiccups": tables.read_bedpe,
    "bedpe-domain": _from_lines(tables.parse_bedpe_domain),
    "interact": _from_lines(tables.parse_interact),
    "longrange": _from_lines(tables.parse_longrange),
    "gwas": tables.read_gwas,
    "qtl": tables.read_qtl,
    "gtexgwas": _from_lines(tables.parse_gtex_gwas),
    "gcnv": tables.read_matrix,
    "shoebox": tables.read_matrix,
    "fusionjuncspan": _from_lines(tables.parse_fusion),
    "bp": _from_ordered(tables.parse_bp),
    "fasta": sequences.read_fasta,
    "gbk": sequences.read_genbank,
    "aed": sequences.read_aed,
    "fam": samples.read_plink_fam,
}

# Display class of a format; everything else is an annotation.
TRACK_TYPES = {
    "wig": ["wig", "bigwig", "bw", "bedgraph", "tdf"],
    "variant": ["vcf", "vcftabix", "vcf.list"],
    "seg": ["seg"],
    "mut": ["mut", "maf"],
    "alignment": ["bam", "cram"],
    "interact": ["hiccups", "bedpe", "bedpe-loop", "biginteract", "longrange", "hic"],
    "arc": ["bp"],
    "gwas": ["gwas"],
    "bedtype": ["bed", "bigbed", "bb", "biggenepred", "bignarrowpeak"],
    "sequence": ["fasta"],
    "cnvpytor": ["pytor"],
    "qtl": ["qtl"],
}
COMPRESSED = (".gz", ".bgz")
WRAPPERS = (".txt", ".tab", ".tsv")
SYNONYMS = {"bw": "bigwig", "bb": "bigbed", "fa": "fasta", "fna": "fasta"}


def detect_format(path: str) -> str | None:
    """Format named by a file name, ignoring compression and text suffixes."""
    name = path.rsplit("/", 1)[-1].lower()
    for end in COMPRESSED:
        name = name.removesuffix(end)
    if name.endswith(("refgene.txt", "refgene.sorted.txt")):
        return "refgene"
    for end in WRAPPERS:
        if name.endswith(end):
            name = name.removesuffix(end)
            break
    ext = name.rsplit(".", 1)[-1]
    ext = SYNONYMS.get(ext, ext)
    known = set(READERS) | {f for group in TRACK_TYPES.values() for f in group}
    return ext if ext in known else None


def track_type(fmt: str | None) -> str | None:
    if not fmt:
        return None
    return next((kind for kind, group in TRACK_TYPES.items() if fmt.lower() in group), "annotation")


def read_any(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    fmt = fmt or detect_format(path)
    if fmt in tables.READERS:
        return tables.READERS[fmt](spark, path)
    if fmt not in READERS:
        raise ValueError(f"no reader for {path!r}")
    return READERS[fmt](spark, path)
