"""The genome dimension: lengths, offsets, whole-genome axis and name aliases.

A genome has one row per contig.  These tables are small by nature, yet nothing
below assumes a broadcast: Spark decides by size.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genospan.session import local_table


def genome_offsets(chromosomes: DataFrame) -> DataFrame:
    """Add the cumulative ``offset`` of every chromosome in ``ord`` order."""
    before = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return chromosomes.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def genome_length(chromosomes: DataFrame) -> DataFrame:
    return chromosomes.agg(F.sum("length").cast("long").alias("genome_length"))


def wg_chromosomes(chromosomes: DataFrame) -> DataFrame:
    """Chromosomes of the whole-genome view.

    Walking in ``ord`` order, a chromosome shorter than a hundredth of the mean
    length kept so far is left out.  The walk folds over the contig list only.
    """
    walk = F.aggregate(
        F.array_sort(F.collect_list(F.struct("ord", "chr", "length"))),
        F.struct(
            F.lit(0.0).alias("mean"),
            F.lit(0).alias("n"),
            F.array().cast("array<struct<ord:bigint,chr:string,length:bigint>>").alias("kept"),
        ),
        lambda acc, c: F.when((acc["n"] > 0) & (c["length"] < acc["mean"] / 100), acc).otherwise(
            F.struct(
                ((acc["n"] * acc["mean"] + c["length"]) / (acc["n"] + 1)).alias("mean"),
                (acc["n"] + 1).alias("n"),
                F.concat(
                    acc["kept"],
                    F.array(
                        F.struct(
                            c["ord"].cast("long").alias("ord"), c["chr"].alias("chr"), c["length"].cast("long").alias("length")
                        )
                    ),
                ).alias("kept"),
            )
        ),
        lambda acc: acc["kept"],
    )
    return chromosomes.agg(walk.alias("kept")).select(F.inline("kept"))


def to_genome_coordinate(df: DataFrame, offsets: DataFrame, position: str, out: str) -> DataFrame:
    """Position on the single whole-genome axis; NULL outside the listed chromosomes."""
    dim = offsets.select("chr", F.col("offset").alias("__off"))
    return df.join(dim, "chr", "left").withColumn(out, F.col("__off") + F.col(position)).drop("__off")


def from_genome_coordinate(df: DataFrame, offsets: DataFrame, coordinate: str) -> DataFrame:
    """Chromosome and position for a coordinate of the whole-genome axis.

    Coordinates past the last chromosome's start stay in the last chromosome.
    The contig list is turned into one sorted array and looked up per row.
    """
    spans = offsets.agg(
        F.array_sort(F.collect_list(F.struct(F.col("offset"), F.col("chr")))).alias("a")
    ).scalar()
    hit = F.element_at(F.filter("__spans", lambda s: s["offset"] <= F.col(coordinate)), -1)
    return (
        df.withColumn("__spans", spans)
        .withColumn("__hit", hit)
        .withColumn("chr", F.col("__hit.chr"))
        .withColumn("position", F.col(coordinate) - F.col("__hit.offset"))
        .drop("__hit", "__spans")
    )


# Sex chromosomes that some assemblies number instead of naming.
SEX_CHROMOSOME_NUMBERS = {"human": {"X": "23", "Y": "24"}, "mouse": {"X": "21", "Y": "22"}}


def _species(genome_id: str) -> str | None:
    if genome_id.startswith(("hg", "GRCh")) or genome_id in ("1kg_ref", "b37"):
        return "human"
    if genome_id.startswith(("mm", "GRCm", "rheMac")):
        return "mouse"
    return None


def default_aliases(genome_id: str, names: Iterable[str]) -> list[tuple[str, str]]:
    """(alias, canonical chr) pairs implied by the naming habits of public assemblies."""
    numbers = SEX_CHROMOSOME_NUMBERS.get(_species(genome_id) or "", {})
    letters = {v: k for k, v in numbers.items()}
    pairs: dict[str, str] = {}
    for name in names:
        if name in pairs:
            continue
        also = {name}
        bare = name[3:] if name.lower().startswith("chr") else name
        if name.startswith("gi|"):
            also.add(name.split("|")[-1] or name)
        elif name in ("chrM", "MT"):
            also.add({"chrM": "MT", "MT": "chrM"}[name])
        elif bare.isdigit():
            also.add(bare if bare != name else "chr" + name)
        if bare in numbers and name in (bare, "chr" + bare):
            also |= {numbers[bare], bare, "chr" + bare}
        elif name in letters:
            also |= {letters[name], "chr" + letters[name]}
        also |= case_aliases(name)
        for alias in also:
            pairs[alias] = name
    return list(pairs.items())


def case_aliases(name: str) -> set[str]:
    flipped = name[3:] if name.startswith("chr") else "chr" + name
    return {name.upper(), name.lower(), name[:1].upper() + name[1:], flipped}


def alias_table(spark: SparkSession, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    listed = list(pairs)
    schema = pa.schema([("alias", pa.string()), ("canonical", pa.string())])
    return local_table(spark, {"alias": [a for a, _ in listed], "canonical": [c for _, c in listed]}, schema)


def alias_table_from_records(records: DataFrame, chromosomes: DataFrame | None = None) -> DataFrame:
    """Alias pairs from a table with an array column ``names`` (one row per contig).

    The canonical name is the first name known to ``chromosomes``, else the first
    name of the row.  Case and ``chr`` prefix variants of it are added.
    """
    # A record is known by its own names, so the key is the same on every evaluation.
    rows = records.select(F.concat_ws("\t", "names").alias("__r"), F.posexplode("names").alias("__i", "alias"))
    if chromosomes is not None:
        known = chromosomes.select(F.col("chr").alias("alias"), F.lit(True).alias("__known"))
        rows = rows.join(known, "alias", "left")
    else:
        rows = rows.withColumn("__known", F.lit(None).cast("boolean"))
    rank = F.struct(F.when(F.col("__known"), 0).otherwise(1), F.col("__i"))
    canonical = rows.groupBy("__r").agg(
        F.min_by("alias", rank).alias("canonical"), F.collect_list("alias").alias("names")
    )
    name = F.col("canonical")
    variants = F.array(
        name,
        F.upper(name),
        F.lower(name),
        F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, F.length(name))),
        F.when(name.startswith("chr"), F.substring(name, 4, F.length(name))).otherwise(F.concat(F.lit("chr"), name)),
    )
    pairs = canonical.select(name, F.explode(F.array_distinct(F.concat("names", variants))).alias("alias"))
    return pairs.groupBy("alias").agg(F.min("canonical").alias("canonical"))


def canonical_chr(df: DataFrame, aliases: DataFrame, column: str = "chr") -> DataFrame:
    """Replace chromosome names by their canonical form; unknown names stay."""
    dim = aliases.select(F.col("alias").alias("__alias"), F.col("canonical").alias("__name"))
    joined = df.join(dim, F.col(column) == F.col("__alias"), "left")
    return joined.withColumn(column, F.coalesce("__name", column)).drop("__alias", "__name")
