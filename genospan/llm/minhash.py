"""MinHash near-duplicates with circulant permutations.

A text becomes the set of its word shingles.  A first permutation places every
shingle on a ring; one second permutation of the ring, shifted by k places,
gives coordinate k of the signature, so that all coordinates are an element-wise
minimum of contiguous slices of one table.  Bands of coordinates propose pairs, whole
signatures discard the hopeless ones, and full sets confirm the links.

Equal sets are one class from the start.  Inside a band bucket members are first
compared with one leader.  Where members of a bucket then still belong to several components, those outside the largest
meet all members, in blocks of bounded size: signatures say which rows of a block look alike across components,
full sets of these rows confirm the links inside the block, and only links that join two of its components leave it.
So a block hands on fewer rows than it has, and no link between different components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospan.llm.components import connected_components
from genospan.llm.runtime import binary_rows, cut, runs, worker_state
from genospan.llm.words import Words, mixed, scan_words, window_hashes
from genospan.session import ship_by_value

ship_by_value(__name__)

RING = 1 << 20
BANDS, BAND_WIDTH = 32, 5
SIMILARITY = 80  # per cent
SLACK = 5.0  # standard deviations that a signature may fall short of the similarity
OUTLIER_BLOCK, MEMBER_BLOCK = 256, 2048  # rows of a block at most
OUTLIER_SHINGLES, MEMBER_SHINGLES = 1 << 18, 1 << 20  # and shingles of all its rows, on average


def ring_windows(coordinates: int) -> np.ndarray:
    """Row i: the second permutation at i, i-1, ..., that is shifted by 0, 1, ... places."""

    def make() -> np.ndarray:
        second = np.random.default_rng(7919).permutation(RING).astype(np.uint32)
        wrapped = np.concatenate([second[RING - coordinates + 1 :], second])
        return np.lib.stride_tricks.sliding_window_view(wrapped, coordinates)

    return worker_state(f"ring_{coordinates}", make)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """All coordinates of one set of shingle hashes; the first permutation is a bijective mix."""
    table = ring_windows(coordinates)
    place = (mixed(shingles) >> np.uint64(44)).astype(np.int64)
    out = np.full(coordinates, RING, dtype=np.uint32)
    for lo in range(0, len(place), 1024):
        np.minimum(out, table[place[lo : lo + 1024]].min(axis=0), out=out)
    return out


def shingle_sets(part: Words, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document; shorter texts are one shingle, empty ones none."""
    rolled = window_hashes(part.hashes, width)
    for lo, hi in zip(part.ptr[:-1].tolist(), part.ptr[1:].tolist(), strict=True):
        if hi - lo >= width:
            yield np.unique(rolled[lo : hi - width + 1])
        elif hi > lo:
            yield window_hashes(part.hashes[lo:hi], hi - lo, seed=hi - lo)
        else:
            yield rolled[:0]


def _fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signatures(width: int, coordinates: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for part in scan_words(batch.column(1), lower=True):
                n, fp, sig = [], [], []
                for s in shingle_sets(part, width):
                    n.append(len(s))
                    fp.append(_fingerprint(s) if len(s) else None)
                    sig.append(signature(s, coordinates).astype(np.uint16).tobytes() if len(s) else None)
                own = ids.slice(part.first, len(n))
                yield pa.RecordBatch.from_arrays([own, pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], schema=schema)

    return run


def _sets(width: int):
    """(fp, shingles): the sorted shingle hashes of each text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in scan_words(batch.column(0), lower=True):
                sets = list(shingle_sets(part, width))
                columns = [pa.array([_fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["fp", "shingles"])

    return run


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in at least ``least`` of the coordinates."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = binary_rows(batch.column(2), np.uint16), binary_rows(batch.column(3), np.uint16)
        yield batch.filter(pa.array((a == b).mean(axis=1) >= least)).select([0, 1])


def _close(similarity: int):
    """Pairs (a, b, xa, xb) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= similarity * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return np.unique(np.array(column.to_pylist(), dtype=object), return_inverse=True)[1]


def _lookalikes(least: float, band_width: int):
    """In each block of a bucket: the rows that look like a row of the other side in another component.

    A pair that shares several buckets is left to the first band of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ["band", "ob", "mb"]):
            side = block["outlier"].to_numpy()
            if side.all() or not side.any():
                continue
            sig, comp, own_band = binary_rows(block["sig"], np.uint16), _codes(block["comp"]), block["k"][0].as_py()
            members, outliers = np.flatnonzero(~side), np.flatnonzero(side)
            wanted = np.zeros(len(side), bool)
            for o in outliers.tolist():
                other = members[comp[members] != comp[o]]
                same = sig[other] == sig[o]
                earlier = same[:, : own_band * band_width].reshape(len(other), own_band, band_width).all(axis=2).any(axis=1)
                near = other[(same.mean(axis=1) >= least) & ~earlier]
                wanted[near] = True
                wanted[o] |= len(near) > 0
            if wanted.any():
                yield from block.filter(pa.array(wanted)).select(["band", "ob", "mb", "outlier", "fp", "comp"]).to_batches()

    return run


class Forest:
    """Union-find over numbers from 0."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _spanning_links(similarity: int):
    """In each block: confirmed links between outliers and members that join two components of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ["band", "ob", "mb"]):
            side = block["outlier"].to_numpy()
            if side.all() or not side.any():
                continue
            fp, comp = block["fp"].to_pylist(), _codes(block["comp"])
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in block["shingles"].combine_chunks()]
            size = np.array([len(x) for x in sets])
            # Shingles as small numbers, so that one table marks an outlier's and a sum counts each member's share.
            number = np.unique(np.concatenate(sets), return_inverse=True)[1]
            edge = np.concatenate([[0], np.cumsum(size)])
            members = np.flatnonzero(~side)
            inside = np.concatenate([number[edge[m] : edge[m + 1]] for m in members.tolist()])
            at = np.concatenate([[0], np.cumsum(size[members])])[:-1]
            mark, forest = np.zeros(int(number.max()) + 1, np.int32), Forest(int(comp.max()) + 1)
            a, b = [], []
            for o in np.flatnonzero(side).tolist():
                own = number[edge[o] : edge[o + 1]]
                mark[own] = 1
                common = np.add.reduceat(mark[inside], at)
                mark[own] = 0
                linked = members[100 * common >= similarity * (size[members] + size[o] - common)]
                for m in linked.tolist():
                    if forest.join(int(comp[o]), int(comp[m])):
                        a.append(fp[o]), b.append(fp[m])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    *,
    shingle_words: int = 5,
    similarity: int = SIMILARITY,
    bands: int = BANDS,
    band_width: int = BAND_WIDTH,
) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when 100 * intersection >= similarity * union of
    their shingle sets (A-Z lower-cased); a component carries its smallest id.
    A text with fewer words than a shingle is one shingle; null and
    blank texts have none and are linked with nothing.  A row without
    an id is linked with nothing, has no component and is kept.  Repeated rows
    stay; rows that share an id but not a text are linked by their texts only.  With 32 bands of 5 a pair at
    similarity 0.8 shares no band with probability 3e-6.
    """
    coordinates = bands * band_width
    exact = similarity / 100
    least = max(0.0, exact - SLACK * float(np.sqrt(exact * (1 - exact) / coordinates)))
    ids = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = cut(ids.mapInArrow(_signatures(shingle_words, coordinates), "id long, n long, fp binary, sig binary"))
    nodes = signed.where("id is not null and n > 0")
    classes = cut(nodes.groupBy("fp").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.max("n").alias("n")))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("k")
    slice_ = F.substring("sig", F.col("k") * 2 * band_width + 1, F.lit(2 * band_width))
    placed = classes.select("fp", "sig", "n", numbers).select("fp", "n", "k", F.xxhash64("k", slice_).alias("band"))
    shared = placed.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("fp").alias("leader")).where("size > 1")
    members = cut(placed.join(shared, "band"))

    sigs = classes.select("fp", "sig")
    star = members.where("fp <> leader").select(F.col("leader").alias("a"), F.col("fp").alias("b")).distinct()

    def paired(pairs: DataFrame, held: DataFrame, column: str) -> DataFrame:
        half = pairs.join(held.select(F.col("fp").alias("a"), F.col(column).alias("xa")), "a")
        return half.join(held.select(F.col("fp").alias("b"), F.col(column).alias("xb")), "b").select("a", "b", "xa", "xb")

    tested = cut(paired(star, sigs, "sig").mapInArrow(lambda it: _alike(it, least), "a binary, b binary"))

    def full_sets(wanted: DataFrame) -> DataFrame:
        """(fp, shingles) of the classes ``wanted``, from one text of each."""
        reps = wanted.distinct().join(classes.select("fp", "rep"), "fp").select(F.col("rep").alias("id")).distinct()
        texts = ids.join(reps, "id", "left_semi").select("text")
        sets = texts.mapInArrow(_sets(shingle_words), "fp binary, shingles binary")
        return sets.groupBy("fp").agg(F.first("shingles").alias("shingles"))

    sets = cut(full_sets(tested.select(F.explode(F.array("a", "b")).alias("fp"))))
    links = cut(paired(tested, sets, "shingles").mapInArrow(_close(similarity), "a binary, b binary"))
    component = cut(connected_components(links, "a", "b"))
    contacts = cut(_open_contacts(members, component, sigs, least, band_width))
    if not contacts.isEmpty():
        more = full_sets(contacts.select("fp"))
        key = ["band", "ob", "mb"]
        blocks = contacts.join(more, "fp").repartition(*key).sortWithinPartitions(*key)
        joined = blocks.mapInArrow(_spanning_links(similarity), "a binary, b binary")
        component = cut(connected_components(cut(links.union(joined)), "a", "b"))

    named = classes.select("fp", "rep").join(component.withColumnsRenamed({"node": "fp"}), "fp", "left")
    named = named.withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = named.join(smallest, "component").select("fp", "component_id")
    out = signed.join(by_class, "fp", "left")
    component_id = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component_id.cast("long").alias("component_id"),
        F.coalesce(F.col("id") == component_id, F.lit(True)).alias("kept"),
    )


def _open_contacts(members: DataFrame, component: DataFrame, sigs: DataFrame, least: float, band_width: int) -> DataFrame:
    """(band, ob, mb, outlier, fp, comp): rows of blocks that look alike with a row of another component.

    Buckets of two were settled by their leader.  In larger ones every member
    outside the largest component meets all members.
    """
    of = component.withColumnsRenamed({"node": "fp", "component": "comp"})
    placed = members.where("size > 2").select("band", "k", "fp", "n").join(of, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    parts = placed.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    split = parts.groupBy("band").agg(
        F.max(F.struct("rows", "comp"))["comp"].alias("main"),
        (F.sum("rows") - F.max("rows")).alias("out_rows"),
        (F.sum("shingles") - F.max(F.struct("rows", "comp", "shingles"))["shingles"]).alias("out_shingles"),
        F.sum("rows").alias("all_rows"),
        F.sum("shingles").alias("all_shingles"),
        F.count(F.lit(1)).alias("n_comp"),
    )
    blocks_of = lambda side, rows, shingles: F.greatest(
        F.ceil(F.col(f"{side}_rows") / rows), F.ceil(F.col(f"{side}_shingles") / shingles)
    ).cast("int")
    split = split.where("n_comp > 1").select(
        "band", "main", blocks_of("out", OUTLIER_BLOCK, OUTLIER_SHINGLES).alias("n_ob"), blocks_of("all", MEMBER_BLOCK, MEMBER_SHINGLES).alias("n_mb")
    )
    # Signatures meet a class once, not once a bucket; a class lies in one bucket a band at most.
    rows = placed.join(split, "band").groupBy("fp", "comp").agg(F.collect_list(F.struct("band", "k", "main", "n_ob", "n_mb")).alias("places"))
    rows = cut(rows.join(sigs, "fp"))

    def own(n: Column, *salt: Column) -> Column:
        return F.pmod(F.xxhash64("fp", *salt), n).cast("int")

    def every(n: Column) -> Column:
        return F.sequence(F.lit(0), n - 1)

    def at(p: Column, ob: Column, mb: Column) -> Column:
        return F.struct(p["band"].alias("band"), p["k"].alias("k"), ob.alias("ob"), mb.alias("mb"))

    outside = F.filter("places", lambda p: p["main"] != F.col("comp"))
    outlier_blocks = F.transform(outside, lambda p: F.transform(every(p["n_mb"]), lambda mb: at(p, own(p["n_ob"]), mb)))
    member_blocks = F.transform("places", lambda p: F.transform(every(p["n_ob"]), lambda ob: at(p, ob, own(p["n_mb"], F.lit(1)))))
    dealt = [
        rows.select("fp", "comp", "sig", F.explode(F.flatten(where)).alias("at")).select(
            "at.band", "at.ob", "at.mb", "at.k", F.lit(outlier).alias("outlier"), "fp", "comp", "sig"
        )
        for outlier, where in ((True, outlier_blocks), (False, member_blocks))
    ]
    key = ["band", "ob", "mb"]
    blocks = dealt[0].union(dealt[1]).repartition(*key).sortWithinPartitions(*key)
    schema = "band long, ob int, mb int, outlier boolean, fp binary, comp binary"
    return blocks.mapInArrow(_lookalikes(least, band_width), schema)
