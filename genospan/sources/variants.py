"""VCF text to variant rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genospan.sources.annotations import last_of_key
from genospan.sources.lines import as_long, field, long_field, once, read_lines, with_file_headers

META_LINE = re.compile(r"^##(INFO|FILTER|FORMAT)=<(.*)>\s*$")
META_PAIR = re.compile(r'(\w+)=("[^"]*"|[^,]*)')


def read_vcf_header(spark: SparkSession, path) -> dict:
    """Version, INFO / FILTER / FORMAT definitions and sample names.

    Only header lines come to the driver; the scan filters on the leading ``#``.
    """
    lines = read_lines(spark, path)
    head = [r["value"] for r in lines.where(F.col("value").startswith("#")).dropDuplicates().collect()]
    versions = [h[len("##fileformat") + 1 :] for h in head if h.startswith("##fileformat")]
    if not versions:
        raise ValueError("missing ##fileformat line")
    header = {"version": versions[0], "INFO": {}, "FILTER": {}, "FORMAT": {}, "samples": []}
    for h in head:
        meta = META_LINE.match(h)
        if meta:
            values = {k: v.strip('"') for k, v in META_PAIR.findall(meta.group(2))}
            name = values.pop("ID", None)
            if name:
                header[meta.group(1)][name] = values
        elif h.startswith("#CHROM"):
            header["samples"] = h.rstrip("\n").split("\t")[9:]
    return header


def read_vcf(spark: SparkSession, path) -> DataFrame:
    """Variant rows of any number of files, each with the samples of its own ``#CHROM`` line; a file without one has none."""
    lines, header = with_file_headers(spark, path, F.col("value").startswith("#CHROM"))
    samples = F.slice(header.names, 10, F.greatest(header.size - 9, F.lit(0)))
    named = lines.withColumn("samples", F.coalesce(samples, F.array().cast("array<string>")))
    return _variants(named, F.col("samples"), F.size("samples"), True)


def parse_vcf(lines: DataFrame, samples: list[str]) -> DataFrame:
    """Variant rows; rows whose column count does not fit the header are dropped.

    ``info`` is a map (flags have a NULL value), ``calls`` an array with sample,
    genotype alleles and the other FORMAT fields.
    """
    return _variants(lines, F.array(*[F.lit(s) for s in samples]), F.lit(len(samples)), bool(samples))


def _variants(lines: DataFrame, names: Column, n: Column, with_calls: bool) -> DataFrame:
    expected = F.lit(8) + F.when(n > 0, n + 1).otherwise(F.lit(0))
    t = (
        lines.where((F.col("value") != "") & ~F.col("value").startswith("#"))
        .withColumn("t", once(F.split(F.trim("value"), "\t")))
        .where(F.size("t") == expected)
    )
    info = F.when((field(7) != ".") & (field(7) != ""), F.map_from_entries(last_of_key(_info_entries(field(7)))))
    cols = [
        field(0).alias("chr"),
        long_field(1).alias("pos"),
        field(2).alias("names"),
        field(3).alias("ref"),
        field(4).alias("alt"),
        field(5).alias("qual"),
        field(6).alias("filter"),
        info.alias("info"),
    ]
    if with_calls:
        keys = F.split(field(8), ":")

        def call(token, i):
            values = F.split(token, ":")
            pairs = F.filter(
                F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v"))),
                lambda p: p["k"].isNotNull() & p["v"].isNotNull(),
            )
            gt = F.get(F.filter(pairs, lambda p: p["k"] == "GT"), F.lit(0))["v"]
            return F.struct(
                F.get(names, i).alias("sample"),
                F.when(gt.isNotNull(), F.split(gt, r"[\|/]")).alias("genotype"),
                F.map_from_entries(F.filter(pairs, lambda p: p["k"] != "GT")).alias("fields"),
            )

        # Never null, so that asking for it costs nothing.
        none = F.array().cast("array<struct<sample:string,genotype:array<string>,fields:map<string,string>>>")
        cols.append(F.coalesce(F.transform(F.slice("t", 10, n), call), none).alias("calls"))
    return t.select(*cols)


def _info_entries(info):
    """Keys and values of an INFO text; a flag has no value, and a value ends at a second '='."""
    cut = F.transform(F.split(info, ";"), lambda x: F.split(x, "=", 3))
    return F.transform(cut, lambda p: F.struct(F.get(p, F.lit(0)).alias("col1"), F.get(p, F.lit(1)).alias("col2")))


def end_of(info_end):
    return as_long(info_end)
