"""Exact top-k by inner product: norm-sorted blocks, rotated partial sums, Cauchy-Schwarz bounds.

All vectors are rotated by the singular vectors of the table, so that leading
coordinates carry most of every product.  The longest vectors of all give each
query a first lower bound of its k-th score.  The table is cut into ranges of length, and those into blocks; a
query is sent only to the ranges where its length times the longest vector's reaches its bound.  Inside a block
vectors come by descending length: a query leaves it when its length times
the next vector's length stays below its bound, and a pair is scored only when the leading
coordinates' product plus the product of the remaining lengths reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genospan.llm.runtime import cut
from genospan.session import ship_by_value

ship_by_value(__name__)

BLOCK = 16_384
MOST_BANDS = 64
QUERIES_PER_PART = 65_536
HEAD = 1_024
CHUNK = 2_048
LEADING = 16
SCALE = 256.0


def _ints(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(len(flat), -1)


def _lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64))


def _exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All integer products; by doubles where these are exact."""
    if float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1] < 2**52:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


class Block:
    """Vectors by descending length, with leading rotated coordinates and the length of the rest."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, leading: int) -> None:
        length = _lengths(vectors)
        order = np.lexsort((ids, -length))
        self.ids, self.vectors, self.length = ids[order], vectors[order], length[order]
        self.leading = leading
        self.lead, self.rest = self.rotated(self.vectors, rotation)

    def rotated(self, vectors: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = vectors.astype(np.float64) @ rotation
        return turned[:, : self.leading], np.sqrt(np.einsum("ij,ij->i", turned[:, self.leading :], turned[:, self.leading :]))

    def best(self, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, rotation: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(query index, id, score) of the k best of this block that reach the floor of their query, ties to smaller ids."""
        lead, rest = self.rotated(queries, rotation)
        length = _lengths(queries)
        # Rounding of the bounds is far below this share of the largest product.
        slack = 1e-9 * (length * (self.length[0] if len(self.length) else 0.0) + 1.0)
        floors = floors.astype(np.float64).copy()
        which, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
        active = np.arange(len(queries))
        for lo in range(0, len(self.ids), CHUNK):
            hi = min(lo + CHUNK, len(self.ids))
            active = active[length[active] * self.length[lo] + slack[active] >= floors[active]]
            if not len(active):
                break
            bound = lead[active] @ self.lead[lo:hi].T + np.outer(rest[active], self.rest[lo:hi])
            q, c = np.nonzero(bound + slack[active][:, None] >= floors[active][:, None])
            q = active[q]
            if len(q) > 0.2 * len(active) * (hi - lo):
                every = _exact_scores(queries[active], self.vectors[lo:hi])
                place = np.full(len(queries), -1)
                place[active] = np.arange(len(active))
                found = every[place[q], c]
            else:
                found = np.einsum("ij,ij->i", queries[q], self.vectors[lo + c])
            good = (found >= floors[q]) & (self.ids[lo + c] != query_ids[q])
            which, ids, scores = (
                np.concatenate([which, q[good]]),
                np.concatenate([ids, self.ids[lo + c[good]]]),
                np.concatenate([scores, found[good]]),
            )
            order = np.lexsort((ids, -scores, which))
            which, ids, scores = which[order], ids[order], scores[order]
            first = np.searchsorted(which, which)
            nth = np.arange(len(which)) - first
            full = nth == k - 1
            floors[which[full]] = np.maximum(floors[which[full]], scores[full])
            which, ids, scores = which[nth < k], ids[nth < k], scores[nth < k]
        return which, ids, scores


def _rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of the table, from the sums of products of coordinates over all rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            v = _ints(batch.column(0)).astype(np.float64)
            total += v.T @ v if len(v) else 0.0
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    sums = rows.select("vec").mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    gram = np.zeros((width, width))
    for r in sums.collect():  # width squared numbers, whatever the number of rows
        gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["v"]
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


def integer_vector(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of every component, in double precision."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))


def top_inner_products(
    rows: DataFrame,
    is_query: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    *,
    k: int = 5,
    scale: float = SCALE,
    block: int = BLOCK,
    leading: int = LEADING,
    head: int = HEAD,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k best other rows of each query row.

    Components become floor(scale * x); a score is the integer inner product; ties go to the smaller
    id.  Vectors that are null or hold null or non-finite components, and rows without
    an id, take no part; an id that repeats counts once, with its smallest vector; vectors of
    different widths have no product.
    """
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = rows.where(F.col(vec_id).isNotNull() & F.coalesce(finite, F.lit(False)))
    base = usable.select(F.col(vec_id).cast("long").alias("id"), is_query.alias("asks"), integer_vector(v, scale).alias("vec"))
    base = cut(base.groupBy("id").agg(F.max("asks").alias("asks"), F.min("vec").alias("vec")))
    widths = [(r["w"], r["n"], r["q"]) for r in base.groupBy(F.size("vec").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("long")).alias("q")).collect()]
    parts = [_of_width(base.where(F.size("vec") == w), w, n, q, k, block, leading, head) for w, n, q in sorted(widths) if w and q]
    schema = "query_id long, vec_id long, score long"
    found = parts[0] if parts else rows.sparkSession.createDataFrame([], schema)
    for p in parts[1:]:
        found = found.union(p)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@dataclass(frozen=True)
class Bands:
    """Ranges of squared length, the longest first, each cut into blocks of bounded size by hash."""

    cuts: list[float]  # a row lies in the band that counts the cuts above its squared length
    longest: list[float]  # the largest squared length of each band
    sizes: list[int]  # blocks of each band

    def block(self, square: Column, hashed: Column) -> Column:
        band = F.size(F.filter(F.array(*map(F.lit, self.cuts)), lambda c: square < c)) if self.cuts else F.lit(0)
        first, size = self._of(band)
        return (first + F.pmod(hashed, size)).cast("int")

    def blocks(self, band: Column) -> Column:
        first, size = self._of(band)
        return F.sequence(first, first + size - 1)

    def _of(self, band: Column) -> tuple[Column, Column]:
        first = [sum(self.sizes[:k]) for k in range(len(self.sizes))]
        return F.get(F.array(*map(F.lit, first)), band), F.get(F.array(*map(F.lit, self.sizes)), band)

    def reached(self, square: Column, floor: Column) -> Column:
        """The bands that may hold a product of ``floor`` or more: none above the product of the lengths (Cauchy-Schwarz)."""
        longest = F.array(*map(F.lit, self.longest))
        bound = lambda k: F.sqrt(square) * F.sqrt(F.get(longest, k)) * (1 + 1e-9)
        return F.filter(F.sequence(F.lit(0), F.lit(len(self.sizes) - 1)), lambda k: bound(k) >= floor)


def length_bands(squares: DataFrame, n: int, block: int) -> Bands:
    """At most ``MOST_BANDS`` bands with about equally many rows each; rows of one length stay in one band."""
    want = min(MOST_BANDS, -(-n // block))
    shares = [k / want for k in range(want - 1, 0, -1)]
    cuts = sorted(set(squares.agg(F.percentile_approx("square", shares, 10_000)).first()[0]), reverse=True) if shares else []
    band = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("square") < c)) if cuts else F.lit(0)
    found = {r["band"]: r for r in squares.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("longest")).collect()}
    longest = [found[k]["longest"] if k in found else 0.0 for k in range(len(cuts) + 1)]
    return Bands(cuts, longest, [-(-found[k]["n"] // block) if k in found else 1 for k in range(len(cuts) + 1)])


def _of_width(rows: DataFrame, width: int, n: int, n_queries: int, k: int, block: int, leading: int, head: int) -> DataFrame:
    rotation = _rotation(rows, width)
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest = rows.orderBy(square.desc(), "id").limit(head).select("id", "vec").toArrow()
    first = Block(longest["id"].to_numpy(), _ints(longest["vec"]), rotation, leading)

    def with_floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            lowest = np.full(len(ids), np.iinfo(np.int64).min)
            which, _, scores = first.best(ids, _ints(batch.column(1)), lowest, rotation, k)
            nth = np.arange(len(which)) - np.searchsorted(which, which)
            lowest[which[nth == k - 1]] = scores[nth == k - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lowest)], names=["id", "vec", "floor"])

    query_parts = -(-n_queries // QUERIES_PER_PART)
    bands = length_bands(rows.select(square.alias("square")), n, block)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    own_part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_parts)).cast("int")
    asked = rows.where("asks").select("id", "vec").mapInArrow(with_floor, "id long, vec array<long>, floor long")
    reached = F.flatten(F.transform(bands.reached(square, F.col("floor")), bands.blocks))
    queries = asked.select(F.explode(reached).alias("block"), own_part.alias("part"), F.lit(1).alias("kind"), "id", "vec", "floor")
    own_block = bands.block(square, F.xxhash64("id"))
    others = rows.select(own_block.alias("block"), every(query_parts).alias("part"), F.lit(0).alias("kind"), "id", "vec", F.lit(0).cast("long").alias("floor"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block: first its vectors, then queries, a batch at a time."""
        key, held, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            b, p, kind = (batch.column(i).to_numpy() for i in range(3))
            change = np.flatnonzero((np.diff(b) != 0) | (np.diff(p) != 0) | (np.diff(kind) != 0)) + 1
            edges = [0, *change.tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                piece = batch.slice(lo, hi - lo)
                if (b[lo], p[lo]) != key:
                    key, held, ready = (b[lo], p[lo]), [], None
                if kind[lo] == 0:
                    held.append((piece.column(3).to_numpy(), _ints(piece.column(4))))
                    continue
                if ready is None:
                    if not held:
                        continue
                    ready = Block(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), rotation, leading)
                    held = []
                for at in range(0, piece.num_rows, 512):
                    some = piece.slice(at, 512)
                    ids = some.column(3).to_numpy()
                    which, vec, score = ready.best(ids, _ints(some.column(4)), some.column(5).to_numpy(), rotation, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[which]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

    met = others.union(queries).repartition("block", "part").sortWithinPartitions("block", "part", "kind")
    return met.mapInArrow(search, "query_id long, vec_id long, score long")
