"""Column expressions on variants and genotype calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from genospan.sources.lines import bound

LARGE_SV = 1_000_000


def info(key: str) -> Column:
    """An INFO value; empty text counts as absent."""
    return F.nullif(F.try_element_at("info", F.lit(key)), F.lit(""))


def known_bases(allele: Column) -> Column:
    return allele.rlike("^[ACGT]*$")


def is_pass() -> Column:
    return F.col("filter").isin(".", "PASS")


def attribute(key: str) -> Column:
    """REF, ALT, QUAL, FILTER or an INFO field."""
    return F.col(key.lower()) if key in ("REF", "ALT", "QUAL", "FILTER") else info(key)


def allele_frequency() -> Column:
    return info("AF")


def sequence_type() -> Column:
    """SNP, INSERTION, DELETION, NONVARIANT, OTHER, MIXED from the alleles alone."""
    n = F.length("ref")

    def one(a: Column) -> Column:
        return (
            F.when((n == 1) & (F.length(a) == 1), "SNP")
            .when(a == "<NON_REF>", "NONVARIANT")
            .when((F.length(a) > n) & known_bases(a), "INSERTION")
            .when((F.length(a) < n) & known_bases(a), "DELETION")
            .otherwise("OTHER")
        )

    kinds = F.array_distinct(F.transform(F.split("alt", ","), one))
    none = (F.trim("alt") == "") | F.col("alt").isin("<NON_REF>", "<*>", ".")
    return (
        F.when(F.col("alt").isNull(), "UNKNOWN")
        .when(none, "NONVARIANT")
        .otherwise(bound(kinds, lambda k: F.when(F.size(k) == 1, F.get(k, F.lit(0))).otherwise("MIXED")))
    )


def variant_type() -> Column:
    """The sequence type unless INFO names another: VT as it is, SVTYPE as SV, PERIOD as STR."""
    return (
        F.when(info("VT").isNotNull(), info("VT"))
        .when(info("SVTYPE").isNotNull(), "SV")
        .when(info("PERIOD").isNotNull(), "STR")
        .otherwise(sequence_type())
    )


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix of two texts, in one pass over their characters."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    shorter = F.least(F.length(a), F.length(b))
    whole = bound(F.array_position(same, False), lambda first: F.when(first == 0, shorter).otherwise(first - 1))
    return F.when((shorter == 0) | (F.substring(a, 1, 1) != F.substring(b, 1, 1)), 0).otherwise(whole)


def variant_extent(type_column: str = "type") -> Column:
    """Struct ``(start, end)`` of the changed bases, 0-based, as doubles.

    Bases shared by both alleles are trimmed, first from the left, then from the
    right.  An insertion has no extent of its own and spans half a base to both
    sides.  INFO END wins; with CHR2 on another chromosome only one base is kept.
    """
    pos, ref = F.col("pos"), F.col("ref")

    def one(alt: Column) -> Column:
        def cut(p: Column) -> Column:
            rest = F.least(F.length(ref), F.length(alt)) - p
            q = F.least(rest, _common(F.reverse(ref), F.reverse(alt)))
            start = (pos + p - 1).cast("double")
            return F.struct(start.alias("start"), (start + F.length(ref) - p - q).alias("end"))

        return bound(_common(ref, alt), cut)

    kind = F.col(type_column)
    alts = F.filter(F.split("alt", ","), lambda a: (F.length(a) > 0) & known_bases(a) & (kind != "SV"))
    spans = F.transform(alts, one)
    at = (pos - 1).cast("double")
    far = info("CHR2").isNotNull() & (info("CHR2") != F.col("chr"))

    def whole(spans: Column) -> Column:
        lo = F.coalesce(F.array_min(F.transform(spans, lambda s: s["start"])), at)
        hi = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), pos.cast("double"))
        return F.struct(lo.alias("start"), hi.alias("end"))

    def widened(x: Column) -> Column:
        half = F.when(x["start"] == x["end"], F.lit(0.5)).otherwise(F.lit(0.0))
        return F.struct((x["start"] - half).alias("start"), (x["end"] + half).alias("end"))

    stated = F.when(far, at + 1).otherwise(info("END").try_cast("double"))
    return (
        F.when(info("END").isNotNull(), F.struct(at.alias("start"), stated.alias("end")))
        .when(kind == "NONVARIANT", F.struct(at.alias("start"), (at + F.length(ref)).alias("end")))
        .otherwise(bound(bound(spans, whole), widened))
    )


def genotype(gt: Column) -> Column:
    return F.split(gt, r"[\|/]")


def zygosity(alleles: Column) -> Column:
    """nocall, homref, homvar, hetvar; unknown without a genotype."""
    return (
        F.when(alleles.isNull(), "unknown")
        .when(F.exists(alleles, lambda a: a == "."), "nocall")
        .when(F.forall(alleles, lambda a: a == "0"), "homref")
        .when(F.forall(alleles, lambda a: a != "0"), "homvar")
        .otherwise("hetvar")
    )


def zygosity_score(alleles: Column) -> Column:
    z = zygosity(alleles)
    return F.when(z == "homvar", 4).when(z == "hetvar", 3).when(z == "homref", 2).when(z == "nocall", 1).otherwise(0)


def expand_genotype(alleles: Column) -> Column:
    """Alleles as bases, ``" | "`` between them; ``No Call`` for a site without alternates."""
    alts = F.split("alt", ",")

    def one(a: Column) -> Column:
        return F.when(a == ".", ".").when(a == "0", F.col("ref")).otherwise(F.get(alts, a.try_cast("int") - 1))

    return F.when(
        alleles.isNotNull(),
        F.when(F.col("alt") == ".", "No Call").otherwise(F.array_join(F.transform(alleles, one), " | ")),
    )


def is_large_sv() -> Column:
    """Breakpoint on another chromosome, or more than a million bases away."""
    end = info("END").try_cast("long")
    other = info("CHR2") != F.col("chr")
    return F.coalesce(info("CHR2").isNotNull() & end.isNotNull() & (other | (F.abs(end - F.col("pos")) > LARGE_SV)), F.lit(False))


def minus_log10(p: Column) -> Column:
    """-log10 of a p value; zero is taken as the smallest double so that it stays finite."""
    return -F.log10(F.when(p == 0, F.lit(4.9e-324)).otherwise(p))
