"""Near-duplicate vectors with a forest of random-projection trees.

Every tree splits the space again and again by a random direction at the median
of a bounded sample; rows near a split go to both sides.  Vectors are compared
within leaves only, pairs found are verified in double precision, and links are
united over all trees.  Vectors that are equal bit for bit are one class from the start.

Trees are fitted on at most ``sample`` vectors, every vector is indexed.  Below the depth that the
sample supports, a leaf group is split further by the same rule inside its task,
on its own median.

A split through a dense group of near copies would lose its links, so a node is not divided any more where
many of its pairs are links; it is compared whole.  Groups that are dense and large already in the sample
never enter the forest: around pivots of the sample, all rows within the similarity form a cell, and every
neighbour of a cell's rows lies within twice that angle of the pivot.  A cell is compared with all of these
in chunks spread over tasks, exactly, and gives counts and a spanning set of links instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genospan.llm.components import connected_components
from genospan.llm.runtime import binary_rows, cut, runs
from genospan.session import ship_by_value

ship_by_value(__name__)

TREES = 16
SAMPLE = 20_000
LEAF = 512
LEAST_SAMPLE_PER_NODE = 24
OVERLAP = 0.05  # share of a node's rows beside the split, on either side, that go both ways
SIMILARITY = 0.93
DENSE = 0.1  # share of a node's pairs that are links from which the node is not divided
DENSE_ROWS = 256  # rows of a node on which that share is measured
LEAST_SEEN = 8  # sample rows near a pivot
CHUNK = 4096  # rows of a cell that one task compares


class Tree:
    """Nodes as arrays: direction, threshold, margin; children of node k are 2k+1 and 2k+2."""

    def __init__(self, sample: np.ndarray, rows: float, leaf: int, seed: int, similarity: float) -> None:
        self.similarity = similarity
        self.rng = np.random.default_rng(seed)
        self.nodes: dict[int, tuple[np.ndarray, float, float, float]] = {}
        self._grow(0, sample, rows, leaf)

    def _grow(self, node: int, sample: np.ndarray, rows: float, leaf: int) -> None:
        if rows <= leaf or len(sample) < 2 * LEAST_SAMPLE_PER_NODE or node > 1 << 58:
            return
        if self._dense(sample):
            return
        direction = self.rng.standard_normal(sample.shape[1])
        at = sample @ direction
        low, middle, high = np.quantile(at, [0.5 - OVERLAP, 0.5, 0.5 + OVERLAP])
        if not at.min() < middle < at.max():
            return
        self.nodes[node] = (direction, middle, low, high)
        for child, side in ((2 * node + 1, at <= high), (2 * node + 2, at >= low)):
            self._grow(child, sample[side], rows * side.mean(), leaf)

    def _dense(self, sample: np.ndarray) -> bool:
        few = sample[:: -(-len(sample) // DENSE_ROWS)]
        links = np.count_nonzero(few @ few.T >= self.similarity) - len(few)
        return links >= DENSE * len(few) * (len(few) - 1)

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every place of every vector, overlaps included."""
        rows, found = [], []
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, which = todo.pop()
            if node not in self.nodes:
                rows.append(which), found.append(np.full(len(which), node))
                continue
            direction, _, low, high = self.nodes[node]
            at = vectors[which] @ direction
            todo += [(2 * node + 1, which[at <= high]), (2 * node + 2, which[at >= low])]
        return np.concatenate(rows), np.concatenate(found)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(flat), -1)


def close_pairs(vectors: np.ndarray, similarity: float, leaf: int, seed: int, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine >= similarity inside one leaf group, split further where it is large.

    A group that no direction divides any more, or where many pairs are links, is compared in blocks, whole.
    """
    tree = Tree(vectors, len(vectors), leaf, seed, similarity)
    rows, found = tree.leaves(vectors)
    order = np.argsort(found, kind="stable")
    for which in np.split(rows[order], np.flatnonzero(np.diff(found[order])) + 1):
        for a in range(0, len(which), block):
            left = vectors[which[a : a + block]]
            for b in range(a, len(which), block):
                right = vectors[which[b : b + block]]
                i, j = np.nonzero(left @ right.T >= similarity - 1e-9)
                if a == b:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                exact = np.einsum("ij,ij->i", left[i], right[j])
                keep = exact >= similarity
                yield which[a : a + block][i[keep]], which[b : b + block][j[keep]]


def dense_pivots(points: np.ndarray, labels: np.ndarray, scale: float, leaf: int, similarity: float) -> list[int]:
    """Sample rows with so many near ones of their label that their cell has at least two leaves of rows, ``scale`` for each in the sample."""
    least = max(LEAST_SEEN, 2 * leaf / scale)
    _, code = np.unique(labels, return_inverse=True)
    order = np.argsort(code, kind="stable")
    pivots = []
    for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        if len(at) < least:
            continue
        own = points[at].astype(np.float32)
        seen = np.concatenate([np.count_nonzero(own[k : k + 256] @ own.T >= similarity, axis=1) for k in range(0, len(at), 256)])
        free = np.ones(len(at), dtype=bool)
        for k in np.argsort(-seen, kind="stable"):
            if seen[k] < least:
                break
            if not free[k]:
                continue
            near = own @ own[k] >= similarity
            if np.count_nonzero(near & free) >= least:
                pivots.append(int(at[k]))
                free &= ~near
    return pivots


class Cells:
    """Pivots by vector length and label; a row belongs to the first pivot it is near to."""

    def __init__(self, similarity: float) -> None:
        self.similarity = similarity
        # Neighbours of a row near a pivot are at most twice the angle away from the pivot.
        self.reach = 2 * similarity * similarity - 1 - 1e-6 if similarity > 0 else -2.0
        self.pivots: dict[tuple[int, str], list[tuple[int, np.ndarray]]] = {}
        self.chunks: list[int] = []
        self.parts: list[int] = []

    def add(self, points: np.ndarray, labels: np.ndarray, scale: float, leaf: int) -> None:
        for k in dense_pivots(points, labels, scale, leaf, self.similarity):
            self.pivots.setdefault((points.shape[1], labels[k]), []).append((len(self.chunks), points[k]))
            at = points[labels == labels[k]] @ points[k]
            self.chunks.append(1 + int(scale * np.count_nonzero(at >= self.similarity)) // CHUNK)
            self.parts.append(1 + int(scale * np.count_nonzero(at >= self.reach)) // CHUNK)

    def near(self, vectors: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """The cell of each row (-1: none), and (cell, rows in its reach)."""
        cell, reached = np.full(len(vectors), -1), []
        for label in np.unique(labels) if self.pivots else ():
            own = self.pivots.get((vectors.shape[1], label), ())
            which = np.flatnonzero(labels == label) if own else None
            for number, pivot in own:
                at = vectors[which] @ pivot
                mine = which[at >= self.similarity]
                cell[mine[cell[mine] < 0]] = number
                reached.append((number, which[at >= self.reach]))
        return cell, reached


class CellCount:
    """Rows of one chunk of a cell: their links so far, and which of them are connected."""

    def __init__(self, keys: np.ndarray, copies: np.ndarray, vectors: np.ndarray, similarity: float) -> None:
        self.keys, self.copies, self.vectors, self.similarity = keys, copies.astype(np.float64), vectors, similarity
        self.index = {k: i for i, k in enumerate(keys)}
        self.links = np.zeros(len(keys))
        self.group = np.arange(len(keys))

    def meet(self, keys: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(others with a link, one of the rows each is linked to, links of each)."""
        at = self.vectors @ vectors.T
        linked = at >= self.similarity - 1e-9
        i, j = np.nonzero(linked & (at < self.similarity + 1e-9))
        linked[i, j] = np.einsum("ij,ij->i", self.vectors[i], vectors[j]) >= self.similarity
        for j, k in enumerate(keys):
            if k in self.index:
                linked[self.index[k], j] = False
        self.links += linked @ copies.astype(np.float64)
        none = len(self.keys)
        while True:
            low = np.where(linked, self.group[:, None], none).min(axis=0)
            new = np.minimum(self.group, np.where(linked, low[None, :], none).min(axis=1))
            if (new == self.group).all():
                break
            least = np.arange(none)
            np.minimum.at(least, self.group, new)
            self.group = least[self.group]
        met = np.flatnonzero(low < none)
        return met, linked[:, met].argmax(axis=0), (self.copies @ linked)[met]


def _rows(a: list, b: list, n: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "n"])


def _by_width(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    widths = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(widths):
        yield batch.take(pa.array(np.flatnonzero(widths == d)))


def cell_counts(same: DataFrame, cells: Cells) -> DataFrame:
    """(a, b, n): without ``b`` the links ``n`` of a row; with it a link, enough of them to connect all that are linked."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_width(whole, 3) if whole.num_rows else ():
                vectors = _unit(_matrix(batch.column(3)))
                cell, reached = cells.near(vectors, np.array(batch.column(0).to_pylist(), dtype=object))
                if not reached:
                    continue
                spots = binary_rows(batch.column(1), np.uint32)
                offsets = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
                unit = pa.ListArray.from_arrays(offsets, vectors.ravel())

                def rows(number: int, chunk: np.ndarray, part: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
                    take = pa.array(which)
                    return pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(which), number)), pa.array(chunk), pa.array(part), pa.array(cell[which] >= 0),
                         batch.column(1).take(take), batch.column(2).take(take), unit.take(take)],
                        names=["cell", "chunk", "part", "dense", "key", "copies", "vec"],
                    )

                for number, which in reached:
                    own = np.flatnonzero(cell == number)
                    yield rows(number, spots[own, 0].astype(np.int64) % cells.chunks[number], np.zeros(len(own), dtype=np.int64), own)
                    part = 1 + spots[which, 1].astype(np.int64) % cells.parts[number]
                    for chunk in range(cells.chunks[number]):
                        yield rows(number, np.full(len(which), chunk), part, which)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, where = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if held is not None:
                yield _rows(held.keys.tolist(), [None] * len(held.keys), held.links.astype(np.int64).tolist())
                far = np.flatnonzero(held.group != np.arange(len(held.keys)))
                yield _rows(held.keys[far].tolist(), held.keys[held.group[far]].tolist(), [0] * len(far))

        for group in runs(batches, ["cell", "chunk", "part"]):
            spot, part = (group["cell"][0].as_py(), group["chunk"][0].as_py()), group["part"][0].as_py()
            keys, copies, vectors = np.array(group["key"].to_pylist(), dtype=object), group["copies"].to_numpy(), _matrix(group["vec"])
            if not part:
                yield from done()
                held, where = CellCount(keys, copies, vectors, cells.similarity), spot
                continue
            if where != spot:
                continue
            dense = np.array(group["dense"].to_pylist(), dtype=bool)
            for k in range(0, len(keys), 512):
                met, to, n = held.meet(keys[k : k + 512], copies[k : k + 512], vectors[k : k + 512])
                yield _rows(keys[k + met].tolist(), held.keys[to].tolist(), [0] * len(met))
                # A row in a cell counts all its links there.
                loose = ~dense[k + met]
                yield _rows(keys[k + met[loose]].tolist(), [None] * int(loose.sum()), n[loose].astype(np.int64).tolist())
        yield from done()

    dealt = same.select(F.col("label").cast("string").alias("label"), "key", "copies", "vec").mapInArrow(
        spread, "cell long, chunk long, part long, dense boolean, key binary, copies long, vec array<double>"
    )
    sorted_ = dealt.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "part")
    return sorted_.mapInArrow(count, "a binary, b binary, n long")


def near_vectors(
    rows: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    *,
    similarity: float = SIMILARITY,
    trees: int = TREES,
    leaf: int = LEAF,
    sample: int = SAMPLE,
    seed: int = 11,
) -> DataFrame:
    """Per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors of equal length and equal, non-null label are linked at cosine >= ``similarity``.  Vectors that are null, zero,
    or that hold null or non-finite components, and vectors without a label or an id, link with nothing.
    ``n_links`` counts other rows, equal copies included.
    """
    base = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    zero = F.forall("vec", lambda x: x == 0)
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite & ~zero
    usable = base.where(F.coalesce(fit, F.lit(False)))
    keyed = usable.withColumn("key", F.unhex(F.md5(F.concat_ws(",", F.col("label").cast("string"), F.array_join(F.col("vec").cast("array<string>"), ",")).cast("binary"))))
    classes = cut(
        keyed.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    )
    n = classes.count()
    if not n:
        return base.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    widths = {r["d"]: r["count"] for r in classes.groupBy(F.size("vec").alias("d")).count().collect()}
    # A bounded sample by hash order: the same rows again, whatever the partitions.
    drawn = classes.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.5 * sample / n)))
    fitted = drawn.orderBy(F.xxhash64("key")).limit(sample).select(F.col("label").cast("string").alias("label"), "vec").toArrow().combine_chunks()
    forests: dict[int, list[Tree]] = {}
    cells = Cells(similarity)
    for batch in fitted.to_batches():
        for part in _by_width(batch, 1):
            points, labels = _unit(_matrix(part.column(1))), np.array(part.column(0).to_pylist(), dtype=object)
            rows_of = widths[points.shape[1]]
            cells.add(points, labels, rows_of / len(points), leaf)
            loose = cells.near(points, labels)[0] < 0
            forests[points.shape[1]] = [
                Tree(points[loose], rows_of * loose.mean(), leaf, seed * 1000 + t, similarity) for t in range(trees)
            ]
    # A length that the sample does not hold has few rows: one leaf, divided inside its task.
    unseen = [Tree(np.empty((0, 1)), 0, leaf, seed * 1000 + t, similarity) for t in range(trees)]
    schema = pa.schema(
        [("width", pa.int64()), ("tree", pa.int64()), ("leaf", pa.int64()), ("label", pa.string()), ("key", pa.binary()), ("vec", pa.list_(pa.float64()))]
    )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_width(whole, 2) if whole.num_rows else ():
                vectors = _unit(_matrix(batch.column(2)))
                loose = np.flatnonzero(cells.near(vectors, np.array(batch.column(0).to_pylist(), dtype=object))[0] < 0)
                batch, vectors = batch.take(pa.array(loose)), vectors[loose]
                width = vectors.shape[1]
                # The label counts as given, the vector as scaled to length one.
                offsets = np.arange(len(vectors) + 1, dtype=np.int32) * width
                unit = pa.ListArray.from_arrays(offsets, vectors.ravel())
                for t, tree in enumerate(forests.get(width, unseen)):
                    which, found = tree.leaves(vectors)
                    take = pa.array(which)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(which), width)), pa.array(np.full(len(which), t)), pa.array(found.astype(np.int64)),
                         batch.column(0).take(take), batch.column(1).take(take), unit.take(take)],
                        schema=schema,
                    )

    placed = classes.select(F.col("label").cast("string").alias("label"), "key", "vec").mapInArrow(
        route, "width long, tree long, leaf long, label string, key binary, vec array<double>"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["width", "tree", "leaf", "label"]):
            if group.num_rows < 2:
                continue
            keys = np.array(group["key"].to_pylist(), dtype=object)
            for i, j in close_pairs(_matrix(group["vec"]), similarity, leaf, 1 + group["tree"][0].as_py()):
                swap = keys[i] > keys[j]
                a, b = np.where(swap, keys[j], keys[i]), np.where(swap, keys[i], keys[j])
                yield pa.RecordBatch.from_arrays([pa.array(a.tolist(), pa.binary()), pa.array(b.tolist(), pa.binary())], names=["a", "b"])

    together = placed.repartition("width", "tree", "leaf", "label").sortWithinPartitions("width", "tree", "leaf", "label")
    links = cut(together.mapInArrow(compare, "a binary, b binary").distinct())
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("key").alias("b"), "copies")
    counted = both.join(sizes, "b").select(F.col("a").alias("key"), "copies")
    if cells.pivots:
        dense = cut(cell_counts(classes, cells))
        counted = counted.union(dense.where("b is null").select("a", "n"))
        links = links.union(dense.where("b is not null").select("a", "b"))
    degree = counted.groupBy("key").agg(F.sum("copies").alias("others"))
    component = connected_components(links, "a", "b").withColumnsRenamed({"node": "key"})
    named = classes.select("key", "rep", "copies").join(component, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = (
        named.join(least, "component")
        .join(degree, "key", "left")
        .select("key", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    )
    linked = keyed.select("id", "key").join(by_class, "key").select("id", "n_links", "component_id")
    alone = base.where(~F.coalesce(fit, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
