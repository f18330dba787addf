"""Quality by hierarchical empirical Bayes: a document classifier and the record of its site.

A logistic regression on features of the text gives each document its own
evidence.  Expected numbers of good documents are added up by path and by host.  A
path's share of good documents is drawn toward its host's, a host's toward the
share of all, the more so the fewer documents it has; the strengths come from the spread between
groups beyond chance (method of moments).  The posterior log odds of a document are its own
evidence and the log odds of its path without that document, relative to the share of all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospan.llm.runtime import cut
from genospan.llm.toxicity import training_row
from genospan.session import ship_by_value

ship_by_value(__name__)

SAMPLE = 40_000
KEEP_AT = 0.5
MOST_STRENGTH = 1e4
CLIP = 6.0  # a classifier's log odds count up to this size
_SYMBOLS = re.compile(r"[^\w\s.,;:'\"()?-]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTER = re.compile(r"[^\W\d_]")


def text_features(text: str) -> list[float]:
    """Shares that tell running prose from lists, shouting, symbols and repetition; all 0 for empty texts."""
    words = text.split()
    if not words:
        return [0.0] * 10
    n, chars = len(words), len(text)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(1, len(_LETTER.findall(text)))
    return [
        float(np.log1p(n)),
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(_SYMBOLS.findall(text)) / chars,
        len(_UPPER.findall(text)) / letters,
        text.count("|") / n,
        text.count("!") / n,
        1 - len(set(lines)) / max(1, len(lines)),
        chars / n / 10,
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list[float]] = []
        for lo in range(0, batch.num_rows, 256):
            rows += [text_features(t or "") for t in batch.column(1).slice(lo, 256).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["row", "x"])


def host_of(url: Column) -> Column:
    """The host of a URL in lower case."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """The first folder of a URL's path."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def _strength(groups: DataFrame, prior: Column) -> float:
    """Pseudo-documents of the prior: mean * (1 - mean) over the variance between groups, less 1."""
    share = F.col("good") / F.col("n")
    spread = (share - prior) * (share - prior)
    chance = prior * (1 - prior) / F.col("n")
    got = groups.where("n > 0").agg(
        F.sum(F.col("n") * (spread - chance)).alias("between"), F.sum("n").alias("n"), F.sum(F.col("n") * prior * (1 - prior)).alias("inside")
    ).first()
    if not got["n"] or got["between"] is None or got["between"] <= 0:
        return MOST_STRENGTH
    return float(min(MOST_STRENGTH, max(1.0, got["inside"] / got["between"] - 1)))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: Column | str = "source",
    path: Column | str = "lang",
    label: str = "quality",
    *,
    sample: int = SAMPLE,
    keep_at: float = KEEP_AT,
) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``evidence`` (the classifier's log odds), ``host_share``,
    ``path_share`` (posterior shares of good documents, this one left out), ``score``, ``kept``.

    The classifier is fitted on at most ``sample`` labelled rows that are not held out;
    shares cover all documents.  Null texts count as empty, null hosts and paths are groups of
    their own, rows without an id are scored and never learnt from; without labels of both kinds the evidence is 0 everywhere.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = docs.select(
        F.struct(F.col(doc_id).cast("long").alias("id"), as_column(host).cast("string").alias("host"), as_column(path).cast("string").alias("path")).alias("row"),
        F.col(text).alias("text"),
    )
    described = rows.mapInArrow(_features, "row struct<id:long,host:string,path:string>, x array<double>")
    described = cut(described.select("row.*", "x"))
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & training_row(F.col(doc_id)))
    chosen = known.groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = cut(chosen.orderBy(F.xxhash64("id"), "id").limit(sample))
    learnt = cut(described.join(F.broadcast(chosen), "id").select(F.col("label").cast("double").alias("label"), "x"))
    kinds = {r["label"] for r in learnt.select("label").distinct().collect()}
    evidence: Column = F.lit(0.0)
    if kinds == {0.0, 1.0}:
        fitted = LogisticRegression(labelCol="label", featuresCol="v", maxIter=50, regParam=1e-4).fit(learnt.select("label", array_to_vector("x").alias("v")))
        weights = F.array(*[F.lit(float(w)) for w in fitted.coefficients.toArray()])
        products = F.zip_with("x", weights, lambda a, b: a * b)
        evidence = F.aggregate(products, F.lit(float(fitted.intercept)), lambda a, b: a + b)
    judged = described.select("id", "host", "path", F.greatest(F.least(evidence, F.lit(CLIP)), F.lit(-CLIP)).alias("evidence"))
    judged = judged.withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))

    paths = cut(judged.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("good")))
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = min(max((total["good"] + 0.5) / (total["n"] + 1), 1e-3), 1 - 1e-3) if total["n"] else 0.5
    k_host = _strength(hosts, F.lit(overall))
    shares = hosts.select("host", F.col("n").alias("n_host"), F.col("good").alias("good_host"))
    grouped = paths.join(shares, paths["host"].eqNullSafe(shares["host"])).drop(shares["host"])
    drawn = (F.col("good_host") + k_host * overall) / (F.col("n_host") + k_host)
    k_path = _strength(grouped, drawn)
    grouped = grouped.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "good", "n_host", "good_host")
    met = judged.join(grouped, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    # The document itself is left out of the record of its site.
    host_share = (F.col("good_host") - F.col("p") + k_host * overall) / (F.col("n_host") - 1 + k_host)
    path_share = (F.col("good") - F.col("p") + k_path * F.col("host_share")) / (F.col("n") - 1 + k_path)
    log_odds = lambda s: F.log(s / (1 - s))
    bounded = F.greatest(F.least(F.col("path_share"), F.lit(1 - 1e-6)), F.lit(1e-6))
    site = log_odds(bounded) - float(np.log(overall / (1 - overall)))
    scored = met.withColumn("host_share", host_share).withColumn("path_share", path_share)
    scored = scored.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + site))))
    return scored.select(
        F.col("id").alias("doc_id"),
        (~training_row(F.col("id"))).alias("held_out"),
        "evidence",
        "host_share",
        "path_share",
        "score",
        (F.col("score") >= keep_at).alias("kept"),
    )
