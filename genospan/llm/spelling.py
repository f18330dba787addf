"""Spelling variants by finite-state composition.

Words are counted over whole texts.  Two words one edit apart agree outside the place of the edit, so words that
agree outside a window of positions meet in one group: the sub-acceptor entered at one initial state.
Each group's minimised acceptor is composed with a one-edit transducer and with itself again: up to the edit both
readers stand in one state, from there on they follow equal symbols, and the pairs that both accept are
enumerated.  A window is half of a word at first; groups with too many words are halved again, down
to a single position, where an alphabet bounds them.  So no pair is lost and no group grows with the corpus.

The form of a word is its most frequent neighbour, if that is at least twice as frequent.  Frequencies double
along forms, so following them to the last takes few rounds of pointer doubling.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospan.llm.runtime import cut, int64_column
from genospan.llm.words import gathered, scan_words
from genospan.session import ship_by_value

ship_by_value(__name__)

LEAST_LETTERS, LEAST_COUNT = 5, 3
FORM_RATIO = 2
DROP_EVERY = 97
MOST_IN_GROUP = 20_000
_LONG_RUN = 64  # bytes from which a checksum is taken run by run

_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[[*range(65, 91), *range(97, 123)]] = True
_LEAD = 0xC3  # first of the two bytes of U+00C0 to U+00FF


def in_run(part: np.ndarray) -> np.ndarray:
    """The bytes of A-Z, a-z and U+00C0 to U+00FF."""
    out = _ALPHA[part] | (part == _LEAD)
    out[1:] |= part[:-1] == _LEAD
    return out


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each run, carried on from the checksum ``before`` it; all runs at once, a byte at a time."""
    table, size = _crc_table(), ends - starts
    out = before.astype(np.uint32)
    for k in np.flatnonzero(size > _LONG_RUN).tolist():
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(before[k]))
    order = np.argsort(np.where(size > _LONG_RUN, 0, -size), kind="stable")
    short = np.where(size > _LONG_RUN, 0, size)[order]
    at, state = starts[order], ~out[order]
    for k in range(int(short[0]) if len(short) else 0):
        m = int(np.searchsorted(-short, -k, side="left"))
        state[:m] = table[(state[:m] ^ data[at[:m] + k]) & 0xFF] ^ (state[:m] >> np.uint32(8))
    m = int(np.count_nonzero(short))
    out[order[:m]] = ~state[:m]
    return out


def _count(least_letters: int, drop_every: int):
    """(word, n) of each batch: runs after the seeded deletion, with enough letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, named = int64_column(batch.column(0))
            cut_short: Counter[str] = Counter()
            whole: list[pa.LargeBinaryArray] = []
            for part in scan_words(batch.column(1), lower=True, inside=in_run, hashed=False):
                docs = len(part.ptr) - 1
                own, known = ids[part.first : part.first + docs], named[part.first : part.first + docs]
                head = np.fromiter((zlib.crc32(b"%d:" % i) for i in own.tolist()), np.uint32, docs)
                doc = np.repeat(np.arange(docs), np.diff(part.ptr))
                h = checksums(part.data, part.starts, part.ends, head[doc])
                drop = (h % np.uint32(drop_every) == 0) & known[doc]
                for k in np.flatnonzero(drop).tolist():
                    word = part.data[part.starts[k] : part.ends[k]].tobytes().decode()
                    at = int(h[k]) % len(word)
                    if len(word) > least_letters:
                        cut_short[word[:at] + word[at + 1 :]] += 1
                size = part.ends - part.starts
                leads = np.concatenate([[0], np.cumsum(part.data == _LEAD)])
                keep = ~drop & (size - (leads[part.ends] - leads[part.starts]) >= least_letters)
                whole.append(gathered(part.data, part.starts[keep], part.ends[keep]))
            counts = pc.value_counts(pa.chunked_array(whole, pa.large_binary()))
            words, n = counts.field("values").cast(pa.large_string()).cast(pa.string()), counts.field("counts")
            yield pa.RecordBatch.from_arrays([words, n.cast(pa.int64())], names=["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(list(cut_short), pa.string()), pa.array(list(cut_short.values()), pa.int64())], names=["word", "n"])

    return run


class Acceptor:
    """The smallest deterministic acceptor of a sorted list of distinct strings; a state is a number."""

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        # The states of the last word that may still get arcs: (symbol that led here, arcs, final).
        path: list[list] = [["", {}, False]]

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                symbol, arcs, final = path.pop()
                state = known.setdefault((final, *arcs.items()), len(self.arcs))
                if state == len(self.arcs):
                    self.arcs.append(arcs), self.final.append(final)
                path[-1][1][symbol] = state

        last = ""
        for word in words:
            shared = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                shared += 1
            close(shared)
            path += [[c, {}, False] for c in word[shared:]]
            path[-1][2] = True
            last = word
        close(0)
        self.start = len(self.arcs)
        self.arcs.append(path[0][1]), self.final.append(path[0][2])

    def common(self, p: int, q: int) -> Iterator[str]:
        """The strings that are accepted from both states."""
        stack = [(p, q, "")]
        while stack:
            p, q, read = stack.pop()
            if self.final[p] and self.final[q]:
                yield read
            other = self.arcs[q]
            stack += [(t, other[c], read + c) for c, t in self.arcs[p].items() if c in other]

    def one_edit(self, to_end: bool) -> Iterator[tuple[str, str]]:
        """Pairs that differ by one replaced symbol (each once, the smaller first) or by one inserted in the second.

        The edit is the first place where the two differ.  Without ``to_end`` no pair differs by the last symbol
        of the second alone.
        """
        edits: dict[int, list[tuple[str, str]]] = {}
        stack = [(self.start, "")]
        while stack:
            p, read = stack.pop()
            arcs = self.arcs[p]
            if p not in edits:
                found = edits[p] = []
                if len(arcs) + self.final[p] > 1:
                    symbols = list(arcs.items())
                    for k, (a, s) in enumerate(symbols):
                        found += [(a + r, b + r) for b, t in symbols[k + 1 :] for r in self.common(s, t)]
                        found += [(r, a + r) for r in self.common(p, s) if (r[0] != a if r else to_end)]
            for x, y in edits[p]:
                yield read + x, read + y
            stack += [(t, read + c) for c, t in arcs.items()]


def _group_pairs(to_end: bool, rows: list[tuple[str, bool, str, int]]) -> Iterator[tuple[str, str, int, int]]:
    """Words one edit apart in a group of (residue, whether it is the longer kind, word, n)."""
    of = {r[0]: r for r in rows}
    for x, y in Acceptor(sorted(of)).one_edit(to_end):
        (_, long_x, u, n), (_, long_y, v, m) = of[x], of[y]
        # Two of the longer kind meet in the groups where they are the base.
        if not (long_x and long_y):
            yield u, v, n, m


def _enumerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v, n_u, n_v) of the groups of a partition, which come one after the other."""
    key, rows, out = None, [], []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["u", "v", "n_u", "n_v"])

    def end() -> None:
        if len(rows) > 1 and not all(r[1] for r in rows):
            out.extend(_group_pairs(key[1], rows))
        rows.clear()

    for batch in batches:
        for group, to_end, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key is None or group != key[0]:
                end()
                key = (group, to_end)
            rows.append(tuple(row))
        if len(out) >= 10_000:
            yield flush()
    end()
    yield flush()


def _placed(rows: DataFrame) -> DataFrame:
    """(key, to_end, residue, longer, word, n) beside base, lo, hi: what a word shares with its group and what not."""
    longer = F.col("longer").cast("int")
    head = F.substring("word", F.lit(1), F.col("lo"))
    tail = F.substring("word", F.col("hi") + longer + 1, F.lit(2**31 - 1))
    residue = F.substring("word", F.col("lo") + 1, F.col("hi") - F.col("lo") + longer)
    key = F.concat_ws(" ", F.col("base"), F.col("lo"), F.col("hi"), head, tail)
    return rows.select(key.alias("key"), (F.col("hi") > F.col("base")).alias("to_end"), residue.alias("residue"), "longer", "word", "n", "base", "lo", "hi")


def _halves(rows: DataFrame) -> DataFrame:
    """Each row with its window cut in two."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    both = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    cut_up = rows.select("word", "n", "longer", "base", F.explode(both).alias("w"))
    return cut_up.select("word", "n", "longer", "base", "w.lo", "w.hi")


def near_words(words: DataFrame, most_in_group: int = MOST_IN_GROUP) -> DataFrame:
    """(u, v, n_u, n_v): all pairs of ``words`` (distinct, not empty, with their ``n``) one edit apart, each once."""
    length = F.char_length("word")
    roles = F.array(F.struct(length.alias("base"), F.lit(False).alias("longer")), F.struct((length - 1).alias("base"), F.lit(True).alias("longer")))
    based = words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.longer", "r.base")
    rows = _halves(based.select("*", F.lit(0).alias("lo"), (F.col("base") + 1).alias("hi")))
    pairs = None
    while True:
        placed = cut(_placed(rows))
        sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
        # Groups of one position are bounded by the alphabet.
        large = cut(sizes.where(F.col("size") > most_in_group))
        again = placed.join(large, "key", "left_semi").where("hi - lo > 1")
        done = placed.join(large, "key", "left_anti").union(placed.join(large, "key", "left_semi").where("hi - lo <= 1"))
        groups = done.select("key", "to_end", "residue", "longer", "word", "n").repartition("key").sortWithinPartitions("key")
        found = groups.mapInArrow(_enumerate, "u string, v string, n_u long, n_v long")
        pairs = found if pairs is None else pairs.union(found)
        if large.isEmpty():
            return pairs
        rows = _halves(again)


def _followed(forms: DataFrame, rounds: int) -> DataFrame:
    """(word, root): ``forms`` (word, form) followed to the last, each round twice as far."""
    reached = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = cut(reached.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return reached


def spelling_forms(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    *,
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    ratio: int = FORM_RATIO,
    drop_every: int = DROP_EVERY,
    most_in_group: int = MOST_IN_GROUP,
) -> DataFrame:
    """Per word ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are the longest runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased, with at least
    ``least_letters`` letters and ``least_count`` occurrences.  Where ``drop_every`` divides the CRC-32 of
    "<doc_id>:<run>" the run loses the letter at that number modulo its length; rows without an id lose none.
    ``form`` is the neighbour (one letter inserted, deleted or replaced) with the largest n, the smallest
    by code point among equals, if that n is at least ``ratio`` (2 at least) times the word's; else null.  ``root`` follows the
    forms to the last, ``n_near`` counts the neighbours.  Null and empty texts have no words, repeated
    rows count each, an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(_count(least_letters, drop_every), "word string, n long")
    words = cut(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))
    pairs = near_words(words, most_in_group)

    def side(a: str, b: str) -> Column:
        return F.struct(F.col(a).alias("word"), F.col(f"n_{b}").alias("m"), F.col(b).alias("other"))

    both = pairs.select(F.explode(F.array(side("u", "v"), side("v", "u"))).alias("s")).select("s.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("m"), F.col("other"))).alias("best"))
    near = words.join(best, "word", "left")
    has_form = -F.col("best.col1") >= ratio * F.col("n")
    formed = cut(
        near.select(
            "word",
            F.when(has_form, F.col("best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(has_form, -F.col("best.col1")).alias("form_n"),
        )
    )
    most = words.agg(F.max("n")).first()[0] or 1
    steps = max(1.0, math.log(max(1.0, most / least_count)) / math.log(max(2, ratio)))
    roots = _followed(formed.where("form is not null"), math.ceil(math.log2(steps + 1)))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
