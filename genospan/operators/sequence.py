"""Reference sequence as fixed-size chunks, and bases attached to intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 14


def to_chunks(sequence: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows ``(chr, offset, seq)`` of any length to aligned chunks ``(chr, chunk, seq)``.

    A chunk gathers at most ``size`` bases.  Missing stretches inside a chunk, and
    before a slice starts, are filled with ``*``.
    """
    n = F.length("seq")
    pieces = sequence.where(n > 0).select(
        "chr",
        F.col("offset").cast("long").alias("offset"),
        "seq",
        F.explode(
            F.sequence(F.floor(F.col("offset") / size), F.floor((F.col("offset") + n - 1) / size))
        ).alias("chunk"),
    )
    base = F.col("chunk") * size
    lo = F.greatest("offset", base)
    hi = F.least(F.col("offset") + n, base + size)
    cut = pieces.select(
        "chr",
        "chunk",
        (lo - base).cast("int").alias("at"),
        F.substring("seq", (lo - F.col("offset")).cast("int") + 1, (hi - lo).cast("int")).alias("seq"),
    )
    gathered = cut.groupBy("chr", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "seq"))).alias("p"))
    joined = F.aggregate(
        "p", F.lit(""), lambda acc, x: F.concat(F.rpad(acc, x["at"], "*"), x["seq"])
    )
    return gathered.select("chr", "chunk", joined.alias("seq"))


def attach_base(df: DataFrame, chunks: DataFrame, size: int, position: str, out: str) -> DataFrame:
    """The reference base at a position; NULL where the sequence is unknown."""
    dim = chunks.select("chr", F.col("chunk").alias("__chunk"), F.col("seq").alias("__seq"))
    keyed = df.withColumn("__chunk", F.floor(F.col(position) / size))
    at = (F.col(position) - F.col("__chunk") * size).cast("int") + 1
    base = F.substring("__seq", at, F.lit(1))
    return (
        keyed.join(dim, ["chr", "__chunk"], "left")
        .withColumn(out, F.when(F.length(base) > 0, base))
        .select(*df.columns, out)
    )


def attach_sequence(intervals: DataFrame, chunks: DataFrame, size: int, key: str, out: str = "sequence") -> DataFrame:
    """The reference bases of ``[start, end)`` for every interval.

    The interval meets only the chunks it touches; the pieces of one interval are
    put together again by ``key``.  Unknown stretches read ``*``.
    """
    spans = intervals.where(F.col("end") > F.col("start")).select(
        key, "chr", "start", "end",
        F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("chunk"),
    )
    base = F.col("chunk") * size
    lo, hi = F.greatest("start", base), F.least("end", base + size)
    met = spans.join(chunks.select("chr", "chunk", "seq"), ["chr", "chunk"], "left")
    n = (hi - lo).cast("int")
    piece = F.rpad(F.substring(F.coalesce("seq", F.lit("")), (lo - base).cast("int") + 1, n), n, "*")
    whole = (
        met.select(key, F.struct("chunk", piece.alias("s")).alias("p"))
        .groupBy(key)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["s"]), "").alias(out))
    )
    return intervals.join(whole, key, "left")
