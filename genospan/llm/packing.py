"""Vector bin packing of token sequences by the dot-product heuristic.

A document becomes pieces of at most one sequence.  Pieces have three sizes:
tokens, segments (one each) and loss-bearing tokens; a sequence has a limit for each.  The open
sequence takes, again and again, the waiting piece with the largest dot product of
its sizes and the room left, each size measured in its limit and weighted by the
waiting pieces' mean.  When no piece fits, the sequence is filled up with the head of one.

Every partition packs its own documents from a waiting list of bounded length; nothing is
shuffled, and a lost task is repeated from its input with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genospan.llm.runtime import int64_column
from genospan.llm.tokens import END_ID, encoder, vocabulary_path
from genospan.session import ship_by_value

ship_by_value(__name__)

SEQUENCE_TOKENS = 2048
MOST_SEGMENTS = 64
WAITING = 1024
SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("loss_tokens", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
DDL = "doc_id long, start long, length long, loss_tokens long, ids binary, doc_tokens long, sequence_id long, offset long"


@dataclass
class Piece:
    """Tokens ``start .. start + length`` of a document; ``loss`` of them bear loss, those without come last."""

    doc: int | None
    start: int
    ids: bytes
    loss: int
    doc_tokens: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def cut(self, tokens: int) -> tuple[Piece, Piece]:
        """The first ``tokens`` tokens and the rest."""
        head = min(self.loss, tokens)
        return (
            Piece(self.doc, self.start, self.ids[: 4 * tokens], head, self.doc_tokens),
            Piece(self.doc, self.start + tokens, self.ids[4 * tokens :], self.loss - head, self.doc_tokens),
        )


class Packer:
    """Packs pieces as they come; holds at most ``waiting`` of them and one open sequence."""

    def __init__(self, tokens: int, segments: int, loss: int, waiting: int, first_id: int) -> None:
        self.limit = np.array([tokens, segments, loss], dtype=np.float64)
        self.most_waiting, self.next_id = waiting, first_id
        self.pieces: list[Piece] = []
        self.sizes = np.zeros((0, 3))
        self.rows: list[tuple] = []

    def add(self, piece: Piece) -> None:
        """Queue a document's tokens; whole sequences of one document leave at once."""
        whole = int(self.limit[0])
        while piece.length >= whole and self.limit[2] >= whole:
            head, piece = piece.cut(whole)
            self._emit([head])
        while piece.length > min(self.limit[0], self.limit[2]):
            head, piece = piece.cut(int(min(self.limit[0], self.limit[2])))
            self._queue(head)
        if piece.length:
            self._queue(piece)

    def _queue(self, piece: Piece) -> None:
        self.pieces.append(piece)
        if len(self.pieces) >= self.most_waiting:
            self._pack(self.most_waiting // 2)

    def _emit(self, chosen: list[Piece]) -> None:
        offset = 0
        for p in chosen:
            self.rows.append((p.doc, p.start, p.length, p.loss, p.ids, p.doc_tokens, self.next_id, offset))
            offset += p.length
        self.next_id += 1

    def _pack(self, leave: int) -> None:
        """Close sequences until at most ``leave`` pieces wait."""
        pieces = self.pieces
        sizes = np.array([(p.length, 1, p.loss) for p in pieces], dtype=np.float64).reshape(len(pieces), 3) / self.limit
        open_ = np.ones(len(pieces), dtype=bool)
        tokens = float(sizes[:, 0].sum())
        while open_.sum() > leave and (leave or tokens >= 1 - 1e-9):
            weight = sizes[open_].mean(axis=0)
            room, chosen = np.ones(3), []
            while room[0] * self.limit[0] > 0.5 and room[1] * self.limit[1] > 0.5:
                last = room[1] * self.limit[1] < 1.5
                fits = open_ & (sizes <= room + 1e-9).all(axis=1)
                if last:
                    # The last segment must close the sequence: only a piece of just that length, else a cut.
                    fits &= np.abs(sizes[:, 0] - room[0]) < 1e-9
                if fits.any():
                    score = np.where(fits, sizes @ (weight * room), -1.0)
                    k = int(np.argmax(score))
                    chosen.append(pieces[k])
                    room -= sizes[k]
                    tokens -= sizes[k, 0]
                    open_[k] = False
                    continue
                k = self._to_cut(pieces, sizes, open_, room)
                if k < 0:
                    break
                head, pieces[k] = pieces[k].cut(int(round(room[0] * self.limit[0])))
                chosen.append(head)
                sizes[k] = np.array([pieces[k].length, 1, pieces[k].loss]) / self.limit
                tokens -= head.length / self.limit[0]
                room -= np.array([head.length, 1, head.loss]) / self.limit
            if not chosen:
                break
            self._emit(chosen)
        self.pieces = [p for p, o in zip(pieces, open_.tolist(), strict=True) if o]

    def _to_cut(self, pieces: list[Piece], sizes: np.ndarray, open_: np.ndarray, room: np.ndarray) -> int:
        """The longest waiting piece whose head fills the sequence within the limit on loss, or -1."""
        want = int(round(room[0] * self.limit[0]))
        loss = np.minimum(sizes[:, 2] * self.limit[2], want)
        able = open_ & (sizes[:, 0] > room[0] + 1e-9) & (loss <= room[2] * self.limit[2] + 1e-6)
        return int(np.argmax(np.where(able, sizes[:, 0], -1.0))) if able.any() else -1

    def finish(self) -> None:
        """Pack what waits; the tokens that fill no sequence go to sequences of a power of two each."""
        self._pack(0)
        rest, self.pieces = self.pieces, []
        while rest:
            room = [int(x) for x in self.limit]
            fit, total = [], 0
            for p in rest:
                if len(fit) < room[1] and total + p.length <= room[0] and sum(x.loss for x in fit) + p.loss <= room[2]:
                    fit.append(p)
                    total += p.length
            gone = {id(p) for p in fit}
            others = [p for p in rest if id(p) not in gone]
            size = 1 << (total.bit_length() - 1)
            chosen, left = [], size
            for p in fit:
                if left >= p.length:
                    chosen.append(p)
                    left -= p.length
                elif left:
                    head, tail = p.cut(left)
                    chosen.append(head)
                    others.append(tail)
                    left = 0
                else:
                    others.append(p)
            self._emit(chosen)
            rest = others

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = zip(*rows, strict=True) if rows else [[]] * len(SCHEMA)
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, SCHEMA.types, strict=True)], schema=SCHEMA)


def pack_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    *,
    path: str | None = None,
    end_id: int = END_ID,
    sequence_tokens: int = SEQUENCE_TOKENS,
    most_segments: int = MOST_SEGMENTS,
    most_loss: int | None = None,
    waiting: int = WAITING,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``loss_tokens``, ``ids`` (little-endian unsigned
    32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.

    A document is its ids and ``end_id``, which bears no loss.  Sequences hold at most ``sequence_tokens``
    tokens, ``most_segments`` pieces and ``most_loss`` loss-bearing tokens (all of them where None).
    Null and empty texts are the end id alone; rows without an id are packed too; repeated rows are packed each.
    ``sequence_id`` is unique, and the same again for the same partitions of the input.
    """
    vocabulary = path or vocabulary_path()
    loss_limit = sequence_tokens if most_loss is None else most_loss
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer = Packer(sequence_tokens, most_segments, loss_limit, waiting, part << 36)
        encode = encoder(vocabulary).encode
        for batch in batches:
            ids, valid = int64_column(batch.column(0))
            k = 0
            for tokens, edge in encode(batch.column(1)):
                raw = tokens.astype("<u4").tobytes()
                for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    packer.add(Piece(int(ids[k]) if valid[k] else None, 0, raw[4 * lo : 4 * hi] + end, hi - lo, hi - lo + 1))
                    k += 1
                    if len(packer.rows) >= 2000:
                        yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, DDL)
