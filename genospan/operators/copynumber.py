"""Copy number from variant read depths: bins, allele fractions, correction, segments.

Work per variant is Spark aggregation.  What is handed to a pandas function is
bounded by the genome, not by the input: histograms of about a thousand rows, or
the bins of one chromosome of one sample (25,000 at 10 kb).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospan.session import ship_by_value

ship_by_value(__name__)

RAW_BIN = 10_000
GRID = 100
READ_LENGTH = 150
# Window widths of the mean-shift partition, in bins.
BANDS = [2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 28, 32, 40, 48, 56, 64, 80, 96, 112, 128]
GENOME_SIZE = 2_871_000_000
CALL_GENOME_SIZE = 3e9


def snp_depth_bins(snps: DataFrame, bin_size: int = RAW_BIN, by: Sequence[str] = ()) -> DataFrame:
    """Depth and heterozygous counts per bin; ``score`` = mean depth x bin size / 150.

    ``snps`` has ``chr, start, dp, is_het, ref_depth, alt_depth``.
    """
    b = F.floor(F.greatest(F.col("start"), F.lit(0)) / bin_size)
    grouped = snps.groupBy(*by, "chr", (b * bin_size).alias("start")).agg(
        F.sum(F.when(F.col("dp") > 0, F.col("dp"))).alias("dp_sum"),
        F.count(F.when(F.col("dp") > 0, 1)).alias("dp_count"),
        F.count(F.when(F.col("is_het"), 1)).alias("het_count"),
    )
    score = F.when(F.col("dp_count") > 0, F.col("dp_sum") / F.col("dp_count") * F.lit(bin_size / READ_LENGTH))
    return grouped.withColumn("end", F.col("start") + bin_size).withColumn("score", score)


def rebin(bins: DataFrame, bin_size: int, by: Sequence[str] = ()) -> DataFrame:
    """Coarser bins from finer ones (the new size must be a multiple)."""
    out = bins.groupBy(*by, "chr", (F.floor(F.col("start") / bin_size) * bin_size).alias("start")).agg(
        F.sum("dp_sum").alias("dp_sum"), F.sum("dp_count").alias("dp_count"), F.sum("het_count").alias("het_count")
    )
    score = F.when(F.col("dp_count") > 0, F.col("dp_sum") / F.col("dp_count") * F.lit(bin_size / READ_LENGTH))
    return out.withColumn("end", F.col("start") + bin_size).withColumn("score", score)


def _log_beta(a: Column, b: Column, p: Column) -> Column:
    """ln(p^a (1-p)^b + p^b (1-p)^a), computed without leaving the log scale."""
    lp, lq = F.ln(p), F.ln(1 - p)
    x, y = a * lp + b * lq, b * lp + a * lq
    inner = F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))
    edge = F.when((a == 0) & (b == 0), F.lit(math.log(2))).when((a == 0) | (b == 0), F.lit(0.0)).otherwise(F.lit(float("-inf")))
    return F.when((p > 0) & (p < 1), inner).otherwise(edge)


def baf_likelihood(snps: DataFrame, bin_size: int = RAW_BIN, by: Sequence[str] = ()) -> DataFrame:
    """Log likelihood of the allele fraction on a grid of 100 points, per bin: ``ix, p, ll``.

    Equal depth pairs of a bin are counted first, so the grid multiplies the
    number of distinct pairs and not the number of variants.
    """
    b = F.floor(F.greatest(F.col("start"), F.lit(0)) / bin_size) * bin_size
    pairs = (
        snps.where(F.col("is_het"))
        .groupBy(*by, "chr", b.alias("start"), "ref_depth", "alt_depth")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ix = F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("ix")
    grid = pairs.select("*", ix).withColumn("p", F.col("ix") / F.lit(float(GRID - 1)))
    term = F.col("n") * _log_beta(F.col("ref_depth").cast("double"), F.col("alt_depth").cast("double"), F.col("p"))
    return grid.groupBy(*by, "chr", "start", "ix", "p").agg(F.sum(term).alias("ll"))


def baf_levels(likelihood: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The most likely allele fraction of a bin, mirrored to lie at or above one half.

    The fraction is the grid index divided by 100; the first of equal maxima counts.
    """
    best = F.max_by("ix", F.struct(F.round("ll", 9), -F.col("ix")))
    top = likelihood.groupBy(*by, "chr", "start").agg(best.alias("ix"))
    at = F.col("ix") / GRID
    return top.select(*by, "chr", "start", F.greatest(at, 1 - at).alias("baf"), F.least(at, 1 - at).alias("baf_min"))


def _fit_normal(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Least-squares area, mean and spread of a bell curve through (x, y)."""
    total = y[1:-1].sum()
    if len(x) < 2 or total == 0:
        return (0.0, 0.0, 0.0)
    mean = (x * y).sum() / total
    p = np.array([(x[1] - x[0]) * total, mean, max(math.sqrt((y * (x - mean) ** 2).sum() / total), 1e-9)])

    def curve(q):
        e = np.exp(-((x - q[1]) ** 2) / (2 * q[2] ** 2)) / (math.sqrt(2 * math.pi) * q[2])
        return q[0] * e, e

    damping = 1e-2
    f, e = curve(p)
    cost = ((y - f) ** 2).sum()
    for _ in range(200):
        jac = np.stack([e, f * (x - p[1]) / p[2] ** 2, f * (((x - p[1]) ** 2) / p[2] ** 3 - 1 / p[2])], axis=1)
        hess, grad = jac.T @ jac, jac.T @ (y - f)
        try:
            step = np.linalg.solve(hess + damping * np.diag(np.diag(hess) + 1e-300), grad)
        except np.linalg.LinAlgError:
            break
        trial = p + step
        if trial[2] == 0 or not np.isfinite(trial).all():
            damping *= 10
            continue
        f2, e2 = curve(trial)
        cost2 = ((y - f2) ** 2).sum()
        if cost2 < cost:
            done = cost - cost2 <= 1e-12 * cost
            p, f, e, cost, damping = trial, f2, e2, cost2, damping / 10
            if done:
                break
        else:
            damping *= 10
            if damping > 1e12:
                break
    return float(p[0]), float(p[1]), float(abs(p[2]))


def score_histogram(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Histogram of positive scores, a thousandth of the maximum wide: ``x, y, width``.

    The last class is open and stays uncounted.
    """
    by = list(by)
    rows = bins.where(F.col("score") > 0)
    tops = rows.groupBy(*by).agg(F.max("score").alias("top"))
    width = F.greatest(F.floor(F.col("top") / 1000), F.lit(1))
    met = rows.join(tops, by) if by else rows.withColumn("top", tops.scalar())
    placed = met.withColumn("width", width).withColumn("k", F.floor(F.col("score") / F.col("width")))
    return (
        placed.groupBy(*by, "width", F.floor(F.col("top") / F.col("width")).alias("last"), "k")
        .agg(F.count(F.lit(1)).cast("double").alias("y"), F.sum("score").alias("s"))
        .withColumn("x", F.col("k") * F.col("width"))
    )


def rd_histogram_fit(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and spread of the depth distribution from a bell curve fit; one row per group."""
    by = list(by)
    hist = score_histogram(bins, by).withColumn("__one", F.lit(1))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        last, width = int(pdf["last"].iloc[0]), float(pdf["width"].iloc[0])
        y = np.zeros(last + 1)
        y[pdf["k"].to_numpy(dtype=int)] = pdf["y"].to_numpy()
        n = y.sum()
        y[last] = 0.0
        _, mean, sd = _fit_normal(np.arange(last + 1) * width, y)
        row = {c: [pdf[c].iloc[0]] for c in by}
        return pd.DataFrame({**row, "mean": [mean], "sd": [sd], "n": [int(n)], "plain_mean": [pdf["s"].sum() / n]})

    keys = "".join(f"`{c}` {hist.schema[c].dataType.simpleString()}, " for c in by)
    return hist.groupBy("__one", *by).applyInPandas(fit, keys + "mean double, sd double, n long, plain_mean double")


def attach_gc(bins: DataFrame, gc: DataFrame, bin_size: int) -> DataFrame:
    """GC percentage of every bin from the base counts of its sub-bins."""
    sums = gc.groupBy("chr", (F.floor(F.col("start") / bin_size) * bin_size).alias("start")).agg(
        F.sum("gc_count").alias("g"), F.sum("at_count").alias("a")
    )
    percent = F.floor(F.try_divide(F.col("g") * 100, F.col("g") + F.col("a")) + 0.5).cast("int")
    return bins.join(sums, ["chr", "start"], "left").withColumn("gc", percent).drop("g", "a")


def gc_correct(bins: DataFrame, global_mean: DataFrame) -> DataFrame:
    """Scale scores so that every GC class has the global mean; rounded.

    A class mean is the fitted one, or the plain mean with fewer than four bins.
    At most 101 classes come back, so their table is small by construction.
    """
    per_class = rd_histogram_fit(bins.where(F.col("gc").isNotNull()), ["gc"])
    mean = F.when(F.col("n") < 4, F.col("plain_mean")).otherwise(F.col("mean"))
    total = global_mean.select("mean").scalar()
    factors = per_class.select("gc", mean.alias("class_mean"))
    out = bins.join(F.broadcast(factors), "gc", "left").withColumn("global_mean", total)
    corrected = F.floor(F.try_divide(F.col("score") * F.col("global_mean"), F.col("class_mean")) + 0.5)
    return out.withColumn("corrected", corrected).drop("class_mean", "global_mean")


def _t_tail(t: float, df: float) -> float:
    """P(T > t) of Student's distribution, by numeric integration of the density."""
    if not np.isfinite(t) or df <= 0:
        return float("nan")
    # Substituting tan for the variable makes the range finite.
    a = np.arctan(abs(t) / math.sqrt(df))
    grid = np.linspace(a, math.pi / 2, 2001)
    f = np.cos(grid) ** (df - 1)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    h = grid[1] - grid[0]
    area = h / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())
    return float(c * area)


def _two_sample_p(a: np.ndarray, b: np.ndarray) -> float:
    s1, s2 = a.std() or 1.0, b.std() or 1.0
    v1, v2 = s1**2 / len(a), s2**2 / len(b)
    df = (v1 + v2) ** 2 * (len(a) - 1) * (len(b) - 1) / (v1**2 * (len(b) - 1) + v2**2 * (len(a) - 1))
    return _t_tail((a.mean() - b.mean()) / math.sqrt(v1 + v2), int(df + 0.5))


def _shift_once(x: np.ndarray, band: int, mean: float, sd: float, walls: np.ndarray) -> np.ndarray:
    """Average the signal between the points where its mean-shift gradient turns upward."""
    n = len(x)
    inv = np.where(x > mean / 4, mean / (sd**2 * np.where(x == 0, 1, x)), 4 / sd**2)
    grad = np.zeros(n)
    for d in range(-3 * band, 3 * band + 2):
        if d == 0 or abs(d) >= n:
            continue
        i = np.arange(max(0, -d), min(n, n - d))
        grad[i] += d * math.exp(-0.5 * d * d / band**2) * np.exp(-0.5 * (x[i] - x[i + d]) ** 2 * inv[i])
    turns = np.flatnonzero((grad[:-1] < 0) & (grad[1:] >= 0)) + 1
    cuts = np.unique(np.concatenate([[0], turns, walls, [n]]))
    lengths = np.diff(cuts)
    sums = np.add.reduceat(x, cuts[:-1])
    return np.repeat(sums / lengths, lengths)


def _meanshift(score: np.ndarray, mean: float, sd: float, bin_size: int, repeats: int = 3) -> np.ndarray:
    """Levels of a depth signal: mean shift at growing widths, significant segments frozen."""
    levels = score.astype(float).copy()
    frozen = np.zeros(len(levels), dtype=bool)
    for band in BANDS:
        open_at = np.flatnonzero(~frozen)
        if len(open_at) < 2:
            break
        x = levels[open_at]
        walls = np.flatnonzero(np.diff(open_at) > 1) + 1
        for _ in range(repeats):
            x = _shift_once(x, band, mean, sd, walls)
        levels[open_at] = x
        cuts = np.concatenate([[0], np.flatnonzero(np.abs(np.diff(levels)) > 0.01) + 1, [len(levels)]])
        frozen = np.zeros(len(levels), dtype=bool)
        for k in range(1, len(cuts) - 2):
            lo, hi = cuts[k], cuts[k + 1]
            left, right = slice(cuts[k - 1], lo), slice(hi, cuts[k + 2])
            n, nl, nr = hi - lo, lo - cuts[k - 1], cuts[k + 2] - hi
            if n <= 1:
                continue
            here = score[lo:hi]
            if min(n, nl, nr) <= 15:
                near = [s for s in (left, right) if abs(levels[s.start] - levels[lo]) < 1.8 * math.sqrt(max(levels[s.start], 0) / mean) * sd]
                if near:
                    continue
            else:
                limit = 0.01 / GENOME_SIZE * bin_size
                if _two_sample_p(here, score[left]) > limit * (n + nl) or _two_sample_p(here, score[right]) > limit * (n + nr):
                    continue
            spread = here.std() or 1.0
            if _t_tail((mean - here.mean()) / spread * math.sqrt(n), n - 1) > 0.05:
                continue
            frozen[lo:hi] = True
            levels[lo:hi] = here.mean()
    return levels


def _schema_of(df: DataFrame, columns: Sequence[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def _dense(pdf: pd.DataFrame, bin_size: int, column: str) -> tuple[np.ndarray, np.ndarray]:
    at = (pdf["start"].to_numpy() // bin_size).astype(int)
    out = np.zeros(at.max() + 1)
    out[at] = np.nan_to_num(pdf[column].to_numpy(dtype=float))
    return at, out


def meanshift_segments(bins: DataFrame, stats: DataFrame, bin_size: int, column: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Depth level of every bin.  ``stats`` is the one-row fit with ``mean`` and ``sd``.

    One task handles the bins of one chromosome of one sample; their number is
    bounded by chromosome length / bin size.
    """
    by = list(by)
    fit = stats.select(F.struct("mean", "sd")).scalar()
    rows = bins.withColumn("__fit", fit).select(
        *by, "chr", "start", F.col(column).alias("v"), F.col("__fit.mean").alias("m"), F.col("__fit.sd").alias("sd")
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, x = _dense(pdf, bin_size, "v")
        mean, sd = float(pdf["m"].iloc[0]), float(pdf["sd"].iloc[0])
        level = _meanshift(x, mean, sd, bin_size) if mean > 0 and sd > 0 else x
        return pdf[[*by, "chr", "start"]].assign(level=np.trunc(level[at]))

    return rows.groupBy(*by, "chr").applyInPandas(run, _schema_of(rows, [*by, "chr", "start"]) + "level double")


def _overlap(m1, s1, l1, m2, s2, l2) -> float:
    spread = s1**2 + s2**2
    near = math.exp(-((m1 - m2) ** 2) / spread) if spread else float(m1 == m2)
    return near * float(np.minimum(l1, l2).sum())


def _joined(a, b):
    (m1, s1, l1, x1), (m2, s2, l2, x2) = a, b
    both = s1**2 + s2**2
    m = (m1 * s2**2 + m2 * s1**2) / both if both else (m1 + m2) / 2
    s = math.sqrt(s1**2 * s2**2 / both) if both else 0.0
    lh = l1 * l2
    total = lh.sum()
    return m, s, (lh / total if total > 0 else lh), sorted(x1 + x2)


def _merge_neighbours(segs: list, least: float) -> list:
    """Merge the pair of neighbours with the largest overlap until none reaches ``least``."""
    nxt = list(range(1, len(segs))) + [None]
    prv = [None] + list(range(len(segs) - 1))
    age = [0] * len(segs)
    score = lambda i, j: _overlap(*segs[i][:3], *segs[j][:3])
    heap = [(-score(i, i + 1), i, i + 1, 0, 0) for i in range(len(segs) - 1)]
    heapq.heapify(heap)
    while heap:
        neg, i, j, ai, aj = heapq.heappop(heap)
        if -neg < least:
            break
        if segs[i] is None or segs[j] is None or age[i] != ai or age[j] != aj:
            continue
        segs[i], segs[j] = _joined(segs[i], segs[j]), None
        age[i] += 1
        nxt[i] = nxt[j]
        if nxt[i] is not None:
            prv[nxt[i]] = i
            heapq.heappush(heap, (-score(i, nxt[i]), i, nxt[i], age[i], age[nxt[i]]))
        if prv[i] is not None:
            heapq.heappush(heap, (-score(prv[i], i), prv[i], i, age[prv[i]], age[i]))
    return [s for s in segs if s is not None]


def _merge_within(segs: list, least: float, reach: float) -> list:
    """Merge segments that lie close for their size, best overlap first."""
    while len(segs) > 1:
        best, pair = least, None
        for i in range(len(segs)):
            for j in range(i + 1, len(segs)):
                if segs[j][3][0] - segs[i][3][-1] >= reach * (len(segs[i][3]) + len(segs[j][3])):
                    continue
                v = _overlap(*segs[i][:3], *segs[j][:3])
                if v >= best:
                    best, pair = v, (i, j)
        if pair is None:
            break
        i, j = pair
        segs[i] = _joined(segs[i], segs[j])
        del segs[j]
    return segs


def combined_segments(
    bins: DataFrame, likelihood: DataFrame, stats: DataFrame, bin_size: int, column: str = "score", by: Sequence[str] = (), max_distance: float = 0.1
) -> DataFrame:
    """Segments from depth and allele fraction together: ``level`` per bin, NULL outside segments.

    Bins need more than four heterozygous sites and enough depth counts.
    Neighbours merge while depth overlap x likelihood overlap stays above
    0.05 x bin size / 3e9, then segments at a distance.
    """
    by = list(by)
    keys = [*by, "chr", "start"]
    rel = likelihood.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ix", "ll"))).alias("a"))
    rel = rel.select(*keys, F.transform("a", lambda x: x["ll"]).alias("ll"))
    fit = stats.select(F.struct("mean", "sd")).scalar()
    rows = (
        bins.join(rel, keys, "left").withColumn("__fit", fit)
        .select(*keys, "het_count", "dp_count", F.col(column).alias("v"), "ll", F.col("__fit.sd").alias("sd"))
    )
    least, need = 0.05 * bin_size / CALL_GENOME_SIZE, bin_size // RAW_BIN

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start").reset_index(drop=True)
        ok = (pdf["het_count"] > 4) & (pdf["dp_count"] > need) & (pdf["v"] > 0) & pdf["ll"].notna()
        use = np.flatnonzero(ok.to_numpy())
        level = np.full(len(pdf), np.nan)
        if len(use):
            x = pdf["v"].to_numpy(dtype=float)[use]
            sd = float(pdf["sd"].iloc[0])
            step = np.abs(np.diff(x))
            flank = np.zeros(len(x))
            flank[1:-1] = np.minimum(step[:-1], step[1:])
            err = np.sqrt(x + sd**2 + (flank / 2) ** 2)
            slot = (pdf["start"].to_numpy() // bin_size).astype(int)
            segs = []
            for k, i in enumerate(use):
                ll = np.asarray(pdf["ll"].iloc[i], dtype=float)
                lh = np.exp(ll - ll.max()) if np.isfinite(ll.max()) else np.ones(len(ll))
                segs.append((x[k], err[k], lh / lh.sum(), [int(slot[i])]))
            segs = _merge_within(_merge_neighbours(segs, least), least, max_distance)
            row_of = {int(slot[i]): i for i in use}
            for m, _, _, members in segs:
                if len(members) > 1:
                    level[[row_of[b] for b in members]] = m
        return pdf[keys].assign(level=level)

    out = rows.groupBy(*by, "chr").applyInPandas(run, _schema_of(rows, keys) + "level double")
    return out.withColumn("level", F.nanvl("level", F.lit(None).cast("double")))


def copy_number_tracks(bins: DataFrame, stats: DataFrame, column: str = "score") -> DataFrame:
    """Copy number = score / global mean x 2."""
    return bins.withColumn("__m", stats.select("mean").scalar()).withColumn("value", F.try_divide(F.col(column), F.col("__m")) * 2).drop("__m")


def baf_tracks(levels: DataFrame, factor: float = -1.0) -> DataFrame:
    """Two mirrored allele fraction tracks; the second only where the fraction is not one half."""
    first = F.struct(F.lit("baf1").alias("track"), (F.lit(factor) * F.col("baf")).alias("value"))
    second = F.struct(F.lit("baf2").alias("track"), (F.lit(factor) * (1 - F.col("baf"))).alias("value"))
    both = F.when(F.col("baf") != 0.5, F.array(first, second)).otherwise(F.array(first))
    return levels.select(*[c for c in levels.columns if c not in ("baf", "baf_min")], F.inline(both))


def cnv_calls(levels: DataFrame, stats: DataFrame, bin_size: int, delta: float = 0.25, by: Sequence[str] = ()) -> DataFrame:
    """Runs of neighbouring bins whose level is a quarter below or above the global mean.

    These are our semantics: the call is made on the level alone.
    """
    from genospan.scale import islands

    classed = levels.withColumn("__m", stats.select("mean").scalar())
    kind = F.when(F.col("level") < F.col("__m") * (1 - delta), "deletion").when(F.col("level") > F.col("__m") * (1 + delta), "duplication")
    hits = classed.withColumn("kind", kind).where(F.col("kind").isNotNull())
    spans = hits.withColumn("end", F.col("start") + bin_size)
    runs = islands(spans, [*by, "chr", "kind"])
    return runs.select(*by, "chr", "kind", "start", "end", F.col("n").alias("bins"))
