"""Ranked lexical search by sequential impact-sorted reads without random access (NRA).

One pass over the texts keeps, for each document, its length and its counts of the items' terms; sums over that
table give the collection's statistics.  Tasks then turn their documents, a bounded block at a time, into lists
of postings sorted by impact.  For each item the lists are read from the top in steps: what a document
has shown so far is its lower bound, and the next unread impact of every list where it was not met yet adds up to its
upper bound.  Reading ends when no unread document can reach the last place, and every document that can has one
score left.  The best of earlier blocks of a task are a floor for the next.  A task hands on the
best documents of each item only, and those of all tasks are merged in two salted steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genospan.llm.runtime import cut, int64_column
from genospan.llm.words import scan_words
from genospan.scale import top_k_per_group
from genospan.session import ship_by_value

ship_by_value(__name__)

TOP = 50
ITEMS_AT_ONCE = 2048  # items whose terms are searched for in one pass
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1 << 20
FIRST_STEP = 64  # postings of each list in the first read; every further read doubles
_N, _L = -1, -2  # rows of the statistics that hold N and L

_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def in_term(part: np.ndarray) -> np.ndarray:
    """ASCII letters and digits, and every byte of other characters."""
    return _TERM[part]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, hash, size) of the distinct terms of each row."""
    for batch in batches:
        for part in scan_words(batch.column(1), lower=True, inside=in_term):
            row = part.first + np.repeat(np.arange(len(part.ptr) - 1), np.diff(part.ptr))
            size = (part.ends - part.starts).astype(np.int64)
            found = np.unique(np.stack([row, part.hashes.astype(np.int64), size]), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(found[0])), pa.array(found[1]), pa.array(found[2])], names=["key", "hash", "size"]
            )


def _indexer(hashes: np.ndarray, sizes: np.ndarray):
    """Per document: its number of terms, and numbers and counts of the terms searched for."""
    order = np.argsort(hashes)
    by_hash = hashes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, counts = [], [], []
            for part in scan_words(batch.column(1), lower=True, inside=in_term):
                length = np.diff(part.ptr)
                n.append(length)
                doc = np.repeat(np.arange(len(length)), length)
                at = np.minimum(np.searchsorted(by_hash, part.hashes), max(len(by_hash) - 1, 0))
                term = order[at] if len(by_hash) else at
                hit = (by_hash[at] == part.hashes) & (sizes[term] == part.ends - part.starts) if len(by_hash) else np.zeros(len(at), bool)
                found, count = np.unique(doc[hit] * (len(hashes) + 1) + term[hit], return_counts=True)
                edge = np.searchsorted(found, np.arange(len(length) + 1) * (len(hashes) + 1))
                number, count = (found % (len(hashes) + 1)).astype(np.int32), count.astype(np.int32)
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    terms.append(number[a:b].tobytes()), counts.append(count[a:b].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(np.concatenate(n) if n else [], pa.int64()),
                    pa.array(terms, pa.binary()),
                    pa.array(counts, pa.binary()),
                ],
                names=["id", "n", "terms", "counts"],
            )

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of all rows, and how many each row has."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.int32), np.fromiter((len(v) // 4 for v in values), np.int64, len(values))


def _statistics(terms: int):
    """(term, n): in how many documents each term occurs; N and L under negative numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(_flat(batch.column(1))[0], minlength=terms)
            length = batch.column(0).to_numpy(zero_copy_only=False)
            n, total = n + int(np.count_nonzero(length)), total + int(length.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([_N, _L, *at.tolist()], pa.int32()), pa.array([n, total, *df[at].tolist()], pa.int64())], names=["term", "n"])

    return run


class Best:
    """The best documents of one item so far."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self, others: np.ndarray) -> int:
        """The least score that may still reach a place; ``others`` are lower bounds of further documents."""
        scores = np.concatenate([self.scores, others])
        return max(1, int(np.partition(scores, -self.top)[-self.top])) if len(scores) >= self.top else 1

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.top]
        self.ids, self.scores = ids[order], scores[order]


class Block:
    """The postings of some documents, one list a term, each sorted by descending impact."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int) -> None:
        order = np.lexsort((-impact, term))
        self.ids, self.doc, self.impact = ids, doc[order], impact[order]
        self.edge = np.searchsorted(term[order], np.arange(terms + 1))

    def search(self, terms: np.ndarray, best: Best) -> None:
        """Bring ``best`` up to date with the documents of this block."""
        ends = self.edge[terms + 1]
        at = self.edge[terms].copy()
        at, ends = at[at < ends], ends[at < ends]
        lists = np.arange(len(at))
        lower = np.zeros(len(self.ids), np.int64)
        seen = np.zeros((len(self.ids), len(at)), bool)
        step, reading = FIRST_STEP, np.ones(len(at), bool)
        while True:
            upto = np.where(reading, np.minimum(at + step, ends), at)
            rows = np.concatenate([np.arange(a, b) for a, b in zip(at.tolist(), upto.tolist(), strict=True)] or [lists])
            docs = self.doc[rows]
            lower += np.bincount(docs, self.impact[rows], len(lower)).astype(np.int64)
            seen[docs, np.repeat(lists, upto - at)] = True
            at, step = upto, 2 * step
            open_ = at < ends
            # What an unread posting of each list can add at most: the next one of the list.
            next_ = np.where(open_, self.impact[np.minimum(at, len(self.impact) - 1)], 0) if len(self.impact) else np.zeros(0, np.int64)
            floor = best.floor(lower[lower > 0])
            rest = int(next_.sum())
            able = np.flatnonzero((lower > 0) & (lower + rest >= floor))
            missing = rest - seen[able] @ next_
            able, missing = able[lower[able] + missing >= floor], missing[lower[able] + missing >= floor]
            unresolved = able[missing > 0]
            if rest < floor and not len(unresolved):
                best.add(self.ids[able], lower[able])
                return
            # Where unread documents are out already, only lists that an unresolved document was not met in are read on.
            reading = open_ if rest >= floor else open_ & ~seen[unresolved].all(axis=0)


def _searcher(queries: list[np.ndarray], weights: np.ndarray, n: int, total: int, top: int):
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in queries]
        held: list[tuple[np.ndarray, ...]] = []
        docs = postings = 0

        def search() -> None:
            if not held:
                return
            ids, m, number, term, tf = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            doc = np.repeat(np.arange(len(ids)), number)
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            block = Block(ids, doc, term, impact, len(weights))
            for terms, b in zip(queries, best, strict=True):
                block.search(terms, b)

        for batch in batches:
            ids, valid = int64_column(batch.column(0))
            length = batch.column(1).to_numpy(zero_copy_only=False)
            edge = 0
            terms, number = _flat(batch.column(2))
            counts = _flat(batch.column(3))[0].astype(np.int64)
            ends = np.cumsum(number)
            while edge < len(ids):
                # As many documents as the block has room for, one at least.
                room = int(np.searchsorted(ends, (ends[edge - 1] if edge else 0) + BLOCK_POSTINGS - postings, side="right"))
                upto = min(max(edge + 1, room), edge + max(1, BLOCK_DOCS - docs), len(ids))
                lo, hi = (int(ends[edge - 1]) if edge else 0), int(ends[upto - 1])
                own = slice(edge, upto)
                named = np.repeat(valid[own], number[own])
                m = 50 + (50 * length[own] * n) // total
                held.append((ids[own][valid[own]], m[valid[own]], number[own][valid[own]], terms[lo:hi][named], counts[lo:hi][named]))
                docs, postings, edge = docs + upto - edge, postings + hi - lo, upto
                if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    search()
                    docs = postings = 0
        search()
        item = np.repeat(np.arange(len(best), dtype=np.int32), [len(b.ids) for b in best])
        if len(item):
            columns = [pa.array(item), pa.array(np.concatenate([b.ids for b in best])), pa.array(np.concatenate([b.scores for b in best]))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    *,
    top: int = TOP,
    items_at_once: int = ITEMS_AT_ONCE,
) -> DataFrame:
    """Per item its ``top`` documents with a score above 0: ``item_id``, ``rank``, ``doc_id``, ``score``.

    Terms are runs of ASCII letters, digits and non-ASCII characters of the whole text, A-Z lower-cased.  A document's
    score sums, over the distinct terms of the item, w * ((10^9 tf) div (1000 tf + 20 m)) with w = floor(1000 ln((2N + 2) /
    (2 df + 1))) and m = 50 + (50 n N) div L; equal scores are ranked by the smaller id.  Null texts have no terms.  A row
    without an id counts in N, L and df but is never returned.  Rows that repeat an item's id are one item with the
    terms of all; a null item id is an item too.  Repeated documents are ranked each.  Empty tables and
    items without known terms give no rows.
    Items are searched for ``items_at_once`` at a time (dealt by hash): one pass over the documents each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    named = items.select(F.struct(F.col(item_id).alias("id")).alias("key"), F.col(item_text).alias("text"))
    key_type = named.schema["key"].dataType.simpleString()
    terms = cut(named.mapInArrow(_item_terms, f"key {key_type}, hash long, size long").distinct())
    distinct = terms.select("key").distinct().count()
    groups = -(-distinct // items_at_once)
    out = None
    for g in range(groups):
        own = terms.where(F.pmod(F.xxhash64("key"), F.lit(groups)) == g)
        found = _rank_group(rows, own, top, item_id, key_type)
        out = found if out is None else out.union(found)
    if out is None:
        kind = items.schema[item_id].dataType.simpleString()
        return spark.createDataFrame([], f"`{item_id}` {kind}, rank int, doc_id long, score long")
    return out


def _rank_group(docs: DataFrame, terms: DataFrame, top: int, item_id: str, key_type: str) -> DataFrame:
    """``rank_documents`` for the items of ``terms``, few enough for every task to hold."""
    spark = docs.sparkSession
    listed = terms.orderBy("key", "hash", "size").collect()
    keys = list(dict.fromkeys(r["key"] for r in listed))
    known = {t: k for k, t in enumerate(sorted({(r["hash"], r["size"]) for r in listed}))}
    queries: dict = {k: [] for k in keys}
    for r in listed:
        queries[r["key"]].append(known[r["hash"], r["size"]])
    hashes, sizes = np.array([t[0] for t in known], np.int64).astype(np.uint64), np.array([t[1] for t in known], np.int64)
    indexed = cut(docs.mapInArrow(_indexer(hashes, sizes), "id long, n long, terms binary, counts binary"))
    counted = indexed.select("n", "terms").mapInArrow(_statistics(len(known)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = {r["term"]: r["n"] for r in counted.collect()}  # one row for each term searched for
    n, total = df.get(_N, 0), df.get(_L, 0)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(known))], np.int64)
    run = _searcher([np.array(queries[k], np.int64) for k in keys], weights, n, max(total, 1), top)
    found = indexed.mapInArrow(run, "item int, doc_id long, score long")
    order = [F.desc("score"), F.asc("doc_id")]
    best = top_k_per_group(found, ["item"], order, top, ["doc_id"])
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    names = spark.createDataFrame([(k, tuple(key)) for k, key in enumerate(keys)], f"item int, key {key_type}")
    # One row an item of this group.
    return best.join(F.broadcast(names), "item").select(F.col("key")["id"].alias(item_id), "rank", "doc_id", "score")
