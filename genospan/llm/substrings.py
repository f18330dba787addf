"""Removal of repeated word windows with difference-cover anchors.

Positions whose number modulo the period lies in a difference cover are anchors.
Any two positions can be moved forward by the same number of words, less than
the period, so that both become anchors.  Two equal windows of ``window`` words
therefore share an equal anchor hash of ``window - period + 1`` words at the same distance from
their starts.  Anchor hashes that occur in two documents mark candidate
windows; these are extended to their full width by a hash of 96 bits, and the
smallest document of each decides.

Documents are dealt to groups by the hash of their id; a group reports every hash once,
so a passage that a third of all documents share arrives once a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genospan.llm.runtime import int64_column, runs, shuffle_partitions
from genospan.llm.words import Words, scan_words, window_hashes
from genospan.session import ship_by_value

ship_by_value(__name__)

WINDOW = 13
# A difference cover: every residue modulo the period is a difference of two members.
PERIOD, COVER = 7, (0, 1, 3)
GROUP_BYTES = 4 << 20  # text of a group of documents, on average
BUCKET_BYTES = 32 << 20  # text whose anchors or windows make up a bucket, on average
BUCKETS_PER_PARTITION = 4  # at least
SECOND_SEED = 0xA0761D6478BD642F


def _joined(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def _per_word(part: Words, values: np.ndarray) -> np.ndarray:
    """A value per document, repeated for its words."""
    return np.repeat(values, np.diff(part.ptr))


def _room(part: Words) -> np.ndarray:
    """Words from each word to the end of its document."""
    return _per_word(part, part.ptr[1:]) - np.arange(len(part.hashes))


def _anchors(part: Words, window: int, period: int, cover: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions of a chunk and their hashes; positions count from the start of each document."""
    width = window - period + 1
    rolled = window_hashes(part.hashes, width)
    place = np.arange(len(rolled)) - _per_word(part, part.ptr[:-1])[: len(rolled)]
    member = np.zeros(period, dtype=bool)
    member[list(cover)] = True
    at = np.flatnonzero(member[place % period] & (_room(part)[: len(rolled)] >= width))
    return at, rolled[at]


def _bucketed(bucket_of: np.ndarray, columns: list[np.ndarray], group: int, buckets: int, schema: pa.Schema) -> pa.Table:
    """The entries of a group as one row a bucket, each column as the bytes of its values."""
    bucket = (bucket_of >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    pieces = np.split(order, cuts) if len(order) else []
    made = [[int(bucket[p[0]]) for p in pieces], [group] * len(pieces)]
    made += [[c[p].tobytes() for p in pieces] for c in columns]
    return pa.table([pa.array(c, type=t) for c, t in zip(made, schema.types, strict=True)], schema=schema)


def _smallest_and_largest(keys: list[np.ndarray], docs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    order = np.lexsort((docs, *keys[::-1]))
    keys, docs = [k[order] for k in keys], docs[order]
    new = np.ones(len(docs), dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return [k[at] for k in keys], docs[at], docs[np.append(at[1:], len(docs)) - 1] if len(at) else docs[:0]


def _report_anchors(window: int, period: int, cover: Sequence[int], buckets: int, schema: pa.Schema):
    def run(rows: pa.Table) -> pa.Table:
        ids, valid = int64_column(rows["id"])
        hashes, docs = [], []
        for part in scan_words(rows["text"]):
            k = len(part.ptr) - 1
            own, ok = ids[part.first : part.first + k], valid[part.first : part.first + k]
            at, h = _anchors(part, window, period, cover)
            doc, known = _per_word(part, own)[at], _per_word(part, ok)[at]
            hashes.append(h[known]), docs.append(doc[known])
        keys, first, last = _smallest_and_largest([np.concatenate([*hashes, np.zeros(0, np.uint64)])], np.concatenate([*docs, np.zeros(0, np.int64)]))
        return _bucketed(keys[0], [keys[0], (first < last).astype(np.uint8)], rows["g"][0].as_py(), buckets, schema)

    return run


def _equal_runs(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal keys together, and where each run of them begins."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(new)


def _answers(group: np.ndarray, values: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """One row a group with the bytes of its values."""
    back = np.argsort(group, kind="stable")
    g = group[back]
    cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)] if len(g) else [0]
    columns = [pa.array(g[cuts[:-1]], pa.int64())]
    for v in values:
        v = v[back]
        columns.append(pa.array([v[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, names=["g", *names])


def _senders(rows: pa.Table) -> np.ndarray:
    """The group of every entry of a bucket."""
    return np.repeat(rows["g"].to_numpy(), [len(x) // 8 for x in rows["h1"].to_pylist()])


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket, tell every group which of its hashes occur in two documents."""
    for rows in runs(batches, ["bucket"]):
        h1, several = _joined(rows["h1"], np.uint64), _joined(rows["several"], np.uint8)
        order, at = _equal_runs([h1])
        size = np.diff(np.append(at, len(order)))
        told = np.repeat((size > 1) | (np.maximum.reduceat(several[order], at) > 0), size)
        pick = order[told]
        yield _answers(_senders(rows)[pick], [h1[pick]], ["h1"])


def _first_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket, tell every group that has a later document the first document of a window."""
    for rows in runs(batches, ["bucket"]):
        keys = [_joined(rows["h1"], np.uint64), _joined(rows["h2"], np.uint32)]
        first, last = _joined(rows["first"], np.int64), _joined(rows["last"], np.int64)
        order, at = _equal_runs(keys)
        low = np.repeat(np.minimum.reduceat(first[order], at), np.diff(np.append(at, len(order))))
        told = last[order] > low
        pick = order[told]
        yield _answers(_senders(rows)[pick], [*(k[pick] for k in keys), low[told]], ["h1", "h2", "first"])


def _second_half(words: np.ndarray, window: int) -> np.ndarray:
    """32 more bits that tell windows apart."""
    return (window_hashes(words, window, seed=SECOND_SEED) >> np.uint64(32)).astype(np.uint32)


def _member(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted keys, -1 where it is absent."""
    if not len(sorted_keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == values, at, -1)


def _report_windows(window: int, period: int, cover: Sequence[int], buckets: int, schema: pa.Schema):
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        keys: list[list[np.ndarray]] = [[], []]
        docs: list[np.ndarray] = []
        shared = np.unique(_joined(told["h1"], np.uint64))
        ids, valid = int64_column(rows["id"])
        for part in scan_words(rows["text"]) if len(shared) else ():
            k = len(part.ptr) - 1
            own, ok = ids[part.first : part.first + k], valid[part.first : part.first + k]
            at, h = _anchors(part, window, period, cover)
            hits = np.zeros(len(part.hashes) + 1, dtype=np.int64)
            hits[at[_member(shared, h) >= 0] + 1] = 1
            before = np.cumsum(hits)
            n = len(part.hashes) - window + 1
            if n <= 0:
                continue
            candidate = before[period : period + n] > before[:n]
            candidate &= (_room(part)[:n] >= window) & _per_word(part, ok)[:n]
            start = np.flatnonzero(candidate)
            if not len(start):
                continue
            keys[0].append(window_hashes(part.hashes, window)[start])
            keys[1].append(_second_half(part.hashes, window)[start])
            docs.append(_per_word(part, own)[start])
        both = [np.concatenate([*x, np.zeros(0, t)]) for x, t in zip(keys, (np.uint64, np.uint32), strict=True)]
        both, first, last = _smallest_and_largest(both, np.concatenate([*docs, np.zeros(0, np.int64)]))
        group = rows["g"][0].as_py() if rows.num_rows else 0
        return _bucketed(both[0], [*both, first, last], group, buckets, schema)

    return run


def _without_repeats(window: int, schema: pa.Schema):
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        h1, h2, low = (_joined(told[n], t) for n, t in (("h1", np.uint64), ("h2", np.uint32), ("first", np.int64)))
        order = np.lexsort((h2, h1))
        h1, h2, low = h1[order], h2[order], low[order]
        ids, valid = int64_column(rows["id"])
        counts, removed, kept_text = [], [], []
        for part in scan_words(rows["text"]):
            k = len(part.ptr) - 1
            own = _per_word(part, ids[part.first : part.first + k])
            ok = _per_word(part, valid[part.first : part.first + k])
            n = len(part.hashes) - window + 1
            drop = np.zeros(len(part.hashes), dtype=bool)
            if n > 0 and len(h1):
                first_half = window_hashes(part.hashes, window)
                start = np.flatnonzero((_member(h1, first_half) >= 0) & (_room(part)[:n] >= window) & ok[:n])
                second = _second_half(part.hashes, window)[start]
                lo = np.searchsorted(h1, first_half[start], side="left")
                hi = np.searchsorted(h1, first_half[start], side="right")
                repeated = np.zeros(len(start), dtype=bool)
                for step in range(int((hi - lo).max(initial=0))):
                    at = np.minimum(lo + step, len(h1) - 1)
                    repeated |= (lo + step < hi) & (h2[at] == second) & (low[at] < own[start])
                edge = np.zeros(len(part.hashes) + 1, dtype=np.int64)
                np.add.at(edge, start[repeated], 1)
                np.add.at(edge, start[repeated] + window, -1)
                drop = np.cumsum(edge[:-1]) > 0
            raw = part.data.tobytes()
            gone = np.concatenate([[0], np.cumsum(drop)])
            for lo_w, hi_w in zip(part.ptr[:-1].tolist(), part.ptr[1:].tolist(), strict=True):
                lost = int(gone[hi_w] - gone[lo_w])
                counts.append(hi_w - lo_w), removed.append(lost)
                if hi_w == lo_w:
                    kept_text.append("")
                    continue
                tokens = raw[int(part.starts[lo_w]) : int(part.ends[hi_w - 1])].split()
                if lost:
                    tokens = [t for t, d in zip(tokens, drop[lo_w:hi_w].tolist(), strict=True) if not d]
                kept_text.append(b" ".join(tokens).decode())
        return pa.table([rows["id"].cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept_text, pa.string())], schema=schema)

    return run


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    *,
    window: int = WINDOW,
    period: int = PERIOD,
    cover: Sequence[int] = COVER,
    group_bytes: int = GROUP_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_removed``, ``kept_text``.

    A word goes when it lies in a run of ``window`` words that also starts in a
    document with a smaller id; runs are judged on the input.  The words that stay are joined
    by one space.  Null and blank texts have no words and give an empty text; a row
    without an id keeps all its words and takes none from others; rows that repeat
    an id count as one document.  Windows never span two rows.  Groups of documents and buckets of anchors are as
    many as the measured size of all texts asks for, so that both stay bounded however large the table.
    """
    if window < period:
        raise ValueError("the window must be as long as the period at least")
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("the cover lacks a difference of the period")
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long") + 8), F.lit(0))).first()[0]
    groups = max(1, -(-size // group_bytes))
    buckets = max(BUCKETS_PER_PARTITION * shuffle_partitions(spark), -(-size // bucket_bytes))
    own = F.col(doc_id).cast("long")
    # Rows without an id are spread by their text.
    spread = F.when(own.isNull(), F.xxhash64(F.col(text))).otherwise(F.xxhash64(own))
    rows = docs.select(own.alias("id"), F.col(text).alias("text"), F.pmod(spread, F.lit(groups)).alias("g"))
    grouped = rows.groupBy("g")

    def sent(fields: str) -> pa.Schema:
        return pa.schema([("bucket", pa.int64()), ("g", pa.int64()), *((n, pa.binary()) for n in fields.split())])

    def dealt(reports: DataFrame) -> DataFrame:
        return reports.repartition("bucket").sortWithinPartitions("bucket")

    anchors = grouped.applyInArrow(
        _report_anchors(window, period, cover, buckets, sent("h1 several")), "bucket long, g long, h1 binary, several binary"
    )
    shared = dealt(anchors).mapInArrow(_shared_anchors, "g long, h1 binary")
    windows = grouped.cogroup(shared.groupBy("g")).applyInArrow(
        _report_windows(window, period, cover, buckets, sent("h1 h2 first last")),
        "bucket long, g long, h1 binary, h2 binary, first binary, last binary",
    )
    repeated = dealt(windows).mapInArrow(_first_documents, "g long, h1 binary, h2 binary, first binary")
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
    return grouped.cogroup(repeated.groupBy("g")).applyInArrow(
        _without_repeats(window, out), "doc_id long, n_words long, n_removed long, kept_text string"
    )
