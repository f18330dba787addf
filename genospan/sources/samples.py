"""Sample attribute files: sections, typing, mapping and pedigree tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genospan.sources.lines import field, fill_directives, ordered_lines, read_lines

SECTIONS = ("#sampleTable", "#sampleMapping", "#colors")


def typed(value) -> list:
    """``str_value`` and ``num_value``: a numeric text becomes a number, else it stays text."""
    number = F.trim(value).try_cast("double")
    return [F.when(number.isNull(), value).alias("str_value"), number.alias("num_value")]


def long_attributes(wide: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Wide attribute columns to (sample, attribute, str_value, num_value); empty text reads ``-``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("v")) for c in columns])
    rows = wide.select(F.col(key).alias("sample"), F.inline(pairs))
    v = F.when(F.col("v") == "", "-").otherwise(F.col("v"))
    return rows.where(F.col("v").isNotNull()).select("sample", "attribute", *typed(v))


def read_sample_info(spark: SparkSession, path) -> dict[str, DataFrame]:
    return parse_sample_info(ordered_lines(spark, path))


def parse_sample_info(lines: DataFrame) -> dict[str, DataFrame]:
    """Attribute, mapping and colour tables of a sectioned sample file.

    A section line holds for the lines below it; without any section line the file
    is one sample table.  The first line of the sample table names the attributes,
    with blanks turned into ``-``.
    """
    mark = F.when(F.trim("value").isin(*SECTIONS), F.trim("value"))
    body = fill_directives(lines, mark, "section").where(mark.isNull() & (F.trim("value") != ""))
    body = body.withColumn("section", F.coalesce("section", F.lit(SECTIONS[0]))).withColumn("t", F.split("value", "\t"))
    table = body.where(F.col("section") == SECTIONS[0])
    head = table.groupBy("file").agg(F.min_by(F.struct("t", "part", "line"), F.struct("part", "line")).alias("h"))
    joined = table.join(head, "file").where(F.struct("part", "line") != F.struct("h.part", "h.line"))
    names = F.filter(F.col("h.t"), lambda x: x != "")
    cells = joined.select(field(0).alias("sample"), names.alias("names"), F.posexplode(F.slice("t", 2, F.size("t"))).alias("i", "raw"))
    label = F.replace(F.get("names", F.col("i") + 1), F.lit(" "), F.lit("-"))
    raw = F.when(F.col("raw") == "", "-").otherwise(F.col("raw"))
    attributes = cells.where(F.get("names", F.col("i") + 1).isNotNull()).select("sample", label.alias("attribute"), *typed(raw))
    mapping = body.where(F.col("section") == SECTIONS[1]).select(field(0).alias("name"), field(1).alias("sample"))
    colors = body.where(F.col("section") == SECTIONS[2]).select(field(0).alias("attribute"), field(1).alias("value"), field(2).alias("color"))
    return {"attributes": attributes, "mapping": mapping, "colors": colors}


def read_plink_fam(spark: SparkSession, path) -> DataFrame:
    return parse_plink_fam(read_lines(spark, path))


def parse_plink_fam(lines: DataFrame) -> DataFrame:
    t = lines.where(F.trim("value") != "").select(F.split("value", " ").alias("t"))
    names = ["family_id", "sample", "father_id", "mother_id", "sex", "phenotype"]
    return t.select(*[field(i).alias(n) for i, n in enumerate(names)])
