"""QTL search, association axes, contacts and interactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospan.functions.locus import search_key
from genospan.functions.variants import minus_log10
from genospan.scale import order_statistics

MIN_AXIS = 10.0
DIAGONAL = 5
PERCENTILE = 80
MIN_CONTACTS = 1_000


def qtl_match(qtls: DataFrame, term: str, min_log_p: float = 0.0) -> DataFrame:
    """Rows whose SNP or phenotype equals the term, ignoring case, above a significance."""
    t = term.strip().upper()
    hit = (F.upper("phenotype") == t) | (F.upper("snp") == t)
    return qtls.where(F.coalesce(hit, F.lit(False)) & (minus_log10(F.col("p_value")) > min_log_p))


def expand_qtl_region(hits: DataFrame, names: DataFrame, flank: float = 0.1) -> DataFrame:
    """Extent per chromosome of the hits and of the genes they point to, with flanks.

    ``names`` is a name index ``(key, chr, start, end)``; genes on other
    chromosomes are ignored.
    """
    own = hits.select("chr", "start", "end")
    genes = (
        hits.select("chr", search_key(F.col("phenotype")).alias("key")).distinct()
        .join(names.select("key", F.col("chr").alias("g_chr"), "start", "end"), "key")
        .where(F.col("g_chr") == F.col("chr"))
        .select("chr", "start", "end")
    )
    span = own.unionByName(genes).groupBy("chr").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    pad = F.floor((F.col("e") - F.col("s")) * F.lit(flank))
    return span.select("chr", F.greatest(F.lit(0), F.col("s") - pad).alias("start"), (F.col("e") + pad).alias("end"))


def qtl_axis_max(qtls: DataFrame, percentile: float, by: Sequence[str] = ()) -> DataFrame:
    """Axis maximum: the value at sorted position floor(n * percentile / 100), at least 10."""
    v = qtls.withColumn("__l", minus_log10(F.col("p_value")))
    k = F.floor(F.col("n").cast("double") * (percentile / 100))
    got = order_statistics(v, "__l", {"v": k}, by)
    return got.select(*by, F.greatest("v", F.lit(MIN_AXIS)).alias("axis_max"))


def normalize_contacts(contacts: DataFrame, vectors: DataFrame) -> DataFrame:
    """``value`` = counts / (nv[bin1] * nv[bin2]); rows with a zero or NaN product are dropped.

    ``vectors`` has ``chr, bin, nv``.
    """
    side = lambda k: vectors.select("chr", F.col("bin").alias(f"bin{k}"), F.col("nv").alias(f"nv{k}"))
    product = F.col("nv1") * F.col("nv2")
    joined = contacts.join(side(1), ["chr", "bin1"]).join(side(2), ["chr", "bin2"])
    good = joined.where((product != 0) & ~F.isnan(product))
    return good.withColumn("value", F.try_divide(F.col("counts"), product)).drop("nv1", "nv2")


def off_diagonal(contacts: DataFrame, distance: int = DIAGONAL) -> DataFrame:
    return contacts.where(F.abs(F.col("bin1") - F.col("bin2")) > distance)


def contact_percentiles(contacts: DataFrame, by: Sequence[str] = (), percentile: float = PERCENTILE, keep: int | None = None, min_values: int = MIN_CONTACTS) -> DataFrame:
    """Threshold and score bounds per group from the values off the diagonal.

    The threshold lies at position ``floor(n * p / 100)``, or at ``n - keep`` if that
    is higher and the caller asks for at most ``keep`` contacts; the bounds
    are the 5 % and 95 % positions of what is above it.  With fewer than
    ``min_values`` values the threshold is 0 and there are no bounds; no value is dropped by it.
    """
    n = F.col("n").cast("double")
    k = F.floor(n * (percentile / 100))
    if keep is not None:
        k = F.greatest(k, F.col("n") - keep)
    i = k + F.floor((F.col("n") - k) * F.lit(5 / 100))
    j = k + F.floor((F.col("n") - k) * F.lit(95 / 100))
    stats = order_statistics(contacts, "value", {"t": k, "lo": i, "hi": j}, by)
    enough = F.col("n") >= min_values
    return stats.select(
        *by,
        F.when(enough, F.col("t")).otherwise(F.lit(0.0)).alias("threshold"),
        F.when(enough, F.col("lo")).alias("low"),
        F.when(enough, F.col("hi")).alias("high"),
    )


def contact_filter(contacts: DataFrame, bin_size: int, by: Sequence[str] = ("chr",), distance: int = DIAGONAL, **limits) -> DataFrame:
    """Contacts off the diagonal at or above the threshold, as interactions with a 200 to 800 score."""
    by = list(by)
    far = off_diagonal(contacts, distance)
    bounds = contact_percentiles(far, by, **limits)
    kept = far.join(bounds, by).where(F.col("value") >= F.col("threshold"))
    share = F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low"))
    score = F.when(F.col("low").isNull(), F.lit(None)).when(
        F.col("high") > F.col("low"), F.floor(200 + F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 600 + 0.5)
    ).otherwise(800)
    at = lambda k: F.col(f"bin{k}") * bin_size
    return kept.select(
        *by, "bin1", "bin2",
        F.least(at(1), at(2)).alias("start"), (F.greatest(at(1), at(2)) + bin_size).alias("end"),
        "value", score.cast("int").alias("score"),
    )


def midpoints() -> list[Column]:
    """Lower and upper anchor midpoint."""
    m1 = (F.col("start1") + F.col("end1")) / 2
    m2 = (F.col("start2") + F.col("end2")) / 2
    return [F.least(m1, m2), F.greatest(m1, m2)]


def interaction_filter(pairs: DataFrame, low: float, high: float, mode: str = "proportional", start: float | None = None, end: float | None = None) -> DataFrame:
    """Interactions whose value lies in [low, high].

    ``inView`` also wants both midpoints inside the window, ``partialInView`` at
    least one.
    """
    kept = pairs.where((F.col("value") >= low) & (F.col("value") <= high))
    if mode == "proportional":
        return kept
    m1, m2 = midpoints()
    both = (m1 >= start) & (m2 <= end)
    if mode == "inView":
        return kept.where(both)
    one = ((m1 >= start) & (m1 <= end)) | ((m2 >= start) & (m2 <= end))
    return kept.where(both | one)


def splice_junction_filter(
    junctions: DataFrame,
    *,
    hide_annotated: bool = False,
    hide_unannotated: bool = False,
    hide_motifs: Sequence[str] = (),
    hide_strand: str | None = None,
    min_ends_visible: int = 0,
    window: tuple[int, int] | None = None,
    min_unique: int = 0,
    min_total: int = 0,
    max_multi_fraction: float = 1.0,
    min_overhang: int = 0,
    min_samples: int = 0,
    max_samples: int = 0,
    min_percent: float = 0,
    max_percent: float = 100,
) -> DataFrame:
    """Splice junctions by annotation, motif, strand, visibility, read support and sample counts.

    Values come from the ``attributes`` map.  A junction without the value a test
    needs passes that test.
    """
    a = lambda k: F.try_element_at("attributes", F.lit(k))
    num = lambda k: a(k).try_cast("double")
    drop = []
    if hide_annotated:
        drop.append(a("annotated_junction") == "true")
    if hide_unannotated:
        drop.append(a("annotated_junction") == "false")
    if hide_motifs:
        drop.append(a("motif").isin(list(hide_motifs)))
    if hide_strand:
        drop.append(F.col("strand") == hide_strand)
    if min_ends_visible and window:
        seen = F.col("start").between(*window).cast("int") + F.col("end").between(*window).cast("int")
        drop.append(seen < min_ends_visible)
    unique, multi = num("uniquely_mapped"), num("multi_mapped")
    total = unique + multi
    drop += [unique < min_unique, total < min_total, F.try_divide(multi, total) > max_multi_fraction]
    drop.append(unique.isNotNull() & (num("maximum_spliced_alignment_overhang") < min_overhang))
    count = num("num_samples_with_this_junction")
    if min_samples:
        drop.append(count < min_samples)
    if max_samples:
        drop.append(count > max_samples)
    if min_percent:
        percent = F.try_divide(100 * count, num("num_samples_total"))
        drop.append((percent < min_percent) | (percent > max_percent))
    kept = junctions
    for test in drop:
        kept = kept.where(~F.coalesce(test, F.lit(False)))
    return kept
