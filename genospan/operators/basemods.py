"""Base modifications: tag parsing, per-position calls, counts and fractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospan.functions import reads as R
from genospan.functions.sequence import IUPAC, IUPAC_COMPLEMENT, complement
from genospan.operators.reads import _ramps, base_count
from genospan.session import ship_by_value
from genospan.sources.lines import once

ship_by_value(__name__)

MODS_SCHEMA = "read_id string, chr string, set_no int, base string, strand string, mod string, read_idx int, likelihood int"
CALLS_SCHEMA = (
    "read_id string, chr string, pos long, base string, strand string, mod string, likelihood int, "
    "canonical string, no_mod_likelihood int"
)
_PAIR = {**dict(zip(IUPAC, IUPAC_COMPLEMENT)), **dict(zip(IUPAC.lower(), IUPAC_COMPLEMENT.lower()))}
_FLIP = bytes(ord(_PAIR.get(chr(i), chr(i))) for i in range(256))


def _split_codes(codes: str) -> list[str]:
    """A number is one ChEBI code; otherwise every letter is a modification."""
    return [codes] if codes.isdigit() or len(codes) <= 1 else list(codes)


def _items(mm: str):
    """What an MM text lists: base, strand, modification codes, whether skipped bases count as unmodified, and the
    0-based number of each modified base among its like."""
    out = []
    for item in mm.split(";"):
        head, *skips = item.split(",")
        if skips:
            nth = np.cumsum(np.array([int(s) for s in skips], dtype=np.int64) + 1) - 1
            out.append((head[0], head[1], _split_codes(head[2:].rstrip(".?")), head.endswith("."), nth))
    return out


def _oriented(seq: pa.Array, reverse: np.ndarray):
    """All sequences of a batch as one array, along the original molecules, with the first index and length of each."""
    seq = seq.cast(pa.large_string())
    _, offsets, data = seq.buffers()
    edge = np.frombuffer(offsets, np.int64)[seq.offset : seq.offset + len(seq) + 1]
    length = np.diff(edge)
    first = np.cumsum(length) - length
    owner, inside = np.repeat(np.arange(len(seq)), length), _ramps(length)
    if not len(owner):
        return np.zeros(0, np.uint8), first, length
    back = reverse[owner]
    raw = np.frombuffer(data, np.uint8)[edge[:-1][owner] + np.where(back, length[owner] - 1 - inside, inside)]
    return np.where(back, np.frombuffer(_FLIP, np.uint8)[raw], raw), first, length


def _likelihoods(ml: pa.Array):
    """All ML values of a batch as one array, with the first index and number of each read's; -1 without a tag."""
    lists = pc.split_pattern(pc.fill_null(ml, ""), ",")
    edge = lists.offsets.to_numpy()
    words = lists.flatten()
    keep = np.ones(len(words), bool)
    keep[edge[:-1] - edge[0]] = False  # the type of the values
    values = pc.utf8_trim_whitespace(words.filter(pa.array(keep))).cast(pa.int64()).to_numpy(zero_copy_only=False)
    number = np.diff(edge) - 1
    return values, np.cumsum(number) - number, np.where(ml.is_null().to_numpy(zero_copy_only=False), -1, number)


def _mods(batch: pa.RecordBatch):
    """Modified bases of a batch of reads as flat arrays, and their kinds ``(base, strand, mod)``.

    The arrays are ``read, set_no, kind, at, likelihood``.  MM counts, per listed base, how many of that base to skip
    before each modified one; ML holds one likelihood per modified base and code, in the same order.  On the reverse
    strand counting runs along the original molecule.  Reads of one MM text are handled together.
    """
    column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
    reverse = column["reverse"].to_numpy(zero_copy_only=False).astype(bool)
    raw, first, length = _oriented(column["seq"], reverse)
    ml, ml_first, ml_number = _likelihoods(column["ml"])
    used = np.zeros(batch.num_rows, np.int64)
    kinds: dict[tuple, int] = {}
    found: dict[str, tuple] = {}
    out = [[np.zeros(0, np.int64)] for _ in range(5)]

    def sites_of(base: str):
        if base not in found:
            sites = np.arange(len(raw)) if base == "N" else np.flatnonzero(raw == ord(base))
            begin = np.searchsorted(sites, first)
            found[base] = sites, begin, np.searchsorted(sites, first + length) - begin
        return found[base]

    texts = column["mm"].dictionary_encode()
    code = texts.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else []
    for rows in groups:
        set_no = 0
        for base, strand, codes, implicit, nth in _items(texts.dictionary[int(code[rows[0]])].as_py()):
            sites, begin, count = sites_of(base)
            which, k = np.nonzero(nth < count[rows][:, None])
            read = rows[which]
            local = sites[begin[read] + nth[k]] - first[read]
            tagged = ml_number[read] >= 0
            slot = used[read] + k * len(codes)
            used[rows] += np.bincount(which, minlength=len(rows)) * len(codes)
            if np.any((ml_number[rows] >= 0) & (used[rows] > ml_number[rows])):
                raise ValueError("an ML tag has fewer values than its MM tag")
            if implicit:
                other, ordinal = np.repeat(rows, count[rows]), _ramps(count[rows])
                left = ~np.isin(ordinal, nth)
                other, ordinal = other[left], ordinal[left]
                local = np.concatenate([local, sites[begin[other] + ordinal] - first[other]])
            else:
                other = rows[:0]
            every = np.concatenate([read, other])
            at = np.where(reverse[every], length[every] - 1 - local, local)
            for j, mod in enumerate(codes):
                values = np.full(len(read), 255)
                values[tagged] = ml[(ml_first[read] + slot + j)[tagged]]
                kind = kinds.setdefault((base, strand, mod), len(kinds))
                n = len(every)
                piece = every, np.full(n, set_no), np.full(n, kind), at, np.concatenate([values, np.zeros(len(other), np.int64)])
                for parts, x in zip(out, piece, strict=True):
                    parts.append(x)
                set_no += 1
    return [np.concatenate(parts) for parts in out], list(kinds), first, length


def _named(kinds, which: np.ndarray, part) -> pa.Array:
    return pa.array([part(k) for k in kinds], pa.string()).take(pa.array(which))


def _read_columns(alignments: DataFrame, read_id: str, blocks: bool) -> DataFrame:
    tag = lambda a, b: F.coalesce(F.try_element_at("tags", F.lit(a)), F.try_element_at("tags", F.lit(b)))
    cols = [
        F.col(read_id).cast("string").alias("read_id"), "chr", "seq", R.has_flag("reverse").alias("reverse"),
        once(F.struct(tag("MM", "Mm").alias("mm"), tag("ML", "Ml").alias("ml"))).alias("tagged"),
    ]
    if blocks:
        m = R.aligned_blocks()
        cols += [_field(m, k).alias(k) for k in ("pos", "off", "len")]
    rows = alignments.select(*cols)
    rows = rows.select("read_id", "chr", "seq", "reverse", "tagged.*", *rows.columns[5:])
    return rows.where(F.col("mm").isNotNull() & (F.col("mm") != "") & F.col("seq").isNotNull())


def _field(array: Column, name: str) -> Column:
    return F.transform(array, lambda b: b[name])


def parse_base_mods(alignments: DataFrame, read_id: str = "read_name") -> DataFrame:
    """One row per read, modification and read position, with its likelihood (0 to 255).

    Without an ML tag the likelihood is 255.  A trailing ``.`` in the MM code gives
    likelihood 0 to the bases that were skipped.
    """

    def run(batches):
        for batch in batches:
            (read, set_no, kind, at, likelihood), kinds, _, _ = _mods(batch)
            rows = pa.array(read)
            yield pa.RecordBatch.from_pydict(
                {
                    "read_id": batch.column(0).take(rows),
                    "chr": batch.column(1).take(rows),
                    "set_no": pa.array(set_no.astype(np.int32)),
                    **{name: _named(kinds, kind, lambda k, i=i: k[i]) for i, name in enumerate(("base", "strand", "mod"))},
                    "read_idx": pa.array(at.astype(np.int32)),
                    "likelihood": pa.array(likelihood.astype(np.int32)),
                }
            )

    return _read_columns(alignments, read_id, blocks=False).mapInArrow(run, MODS_SCHEMA)


def base_mod_calls(alignments: DataFrame, read_id: str = "read_name") -> DataFrame:
    """The most likely modification of every aligned read base that has any.

    Also the likelihood that the base is not modified, 255 minus the sum of all.
    The choice is made inside the read, so nothing is shuffled by read.  Needs
    ``parts``; soft clips are ignored.
    """

    def run(batches):
        for batch in batches:
            (read, set_no, kind, at, likelihood), kinds, first, length = _mods(batch)
            lists = batch.column(batch.schema.get_field_index("pos"))
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            pos, off, size = (
                batch.column(batch.schema.get_field_index(n)).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for n in ("pos", "off", "len")
            )
            size = np.clip(size, 0, np.maximum(length[owner] - off, 0))
            ref = np.full(int(length.sum()), -1)
            ref[np.repeat(first[owner] + off, size) + _ramps(size)] = np.repeat(pos, size) + _ramps(size)
            # The largest likelihood of a base comes first, of equal ones the first listed.
            place = first[read] + at
            order = np.lexsort((set_no, -likelihood, place))
            where, head, which = np.unique(place[order], return_index=True, return_inverse=True)
            total = np.bincount(which, likelihood[order], len(where)).astype(np.int64)
            on_ref = ref[where] >= 0
            best = order[head[on_ref]]
            rows = pa.array(read[best])
            pick = lambda part: _named(kinds, kind[best], part)
            arrays = {
                "read_id": batch.column(0).take(rows),
                "chr": batch.column(1).take(rows),
                "pos": pa.array(ref[where[on_ref]].astype(np.int64)),
                "base": pick(lambda k: k[0]),
                "strand": pick(lambda k: k[1]),
                "mod": pick(lambda k: k[2]),
                "likelihood": pa.array(likelihood[best].astype(np.int32)),
                "canonical": pick(lambda k: k[0] if k[1] == "+" else _PAIR.get(k[0], k[0])),
                "no_mod_likelihood": pa.array((255 - total[on_ref]).astype(np.int32)),
            }
            yield pa.RecordBatch.from_pydict(arrays)

    return _read_columns(alignments, read_id, blocks=True).mapInArrow(run, CALLS_SCHEMA)


def base_mod_counts(calls: DataFrame, threshold: float = 0.5, include_no_mods: bool = False) -> DataFrame:
    """Counts per position and modification key, and likelihood sums at or above the threshold.

    With ``include_no_mods`` a base whose unmodified likelihood is larger counts
    under ``NONE_x`` of its canonical base instead.
    """
    none = F.col("no_mod_likelihood") > F.col("likelihood")
    rows = calls
    if include_no_mods:
        rows = calls.select(
            "chr",
            "pos",
            F.when(none, F.col("canonical")).otherwise(F.col("base")).alias("base"),
            F.when(none, "+").otherwise(F.col("strand")).alias("strand"),
            F.when(none, F.concat(F.lit("NONE_"), "canonical")).otherwise(F.col("mod")).alias("mod"),
            F.when(none, F.col("no_mod_likelihood")).otherwise(F.col("likelihood")).alias("likelihood"),
        )
    over = F.col("likelihood") >= F.lit(threshold * 255)
    counted = rows.groupBy("chr", "pos", "base", "strand", "mod").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(over, 1).otherwise(0)).alias("count"),
        F.sum(F.when(over, F.col("likelihood")).otherwise(0)).alias("likelihood_sum"),
    )
    average = F.try_divide(F.col("likelihood_sum"), F.col("count")) * 100 / 255
    return counted.withColumn("average_percent", F.when(F.col("count") > 0, average))


def mod_kinds(alignments: DataFrame, read_id: str = "read_name") -> DataFrame:
    """The distinct ``base, strand, mod`` that ``parse_base_mods`` finds, each batch of reads handing on its own once."""

    def run(batches):
        for batch in batches:
            (_, _, kind, _, _), known, _, _ = _mods(batch)
            kinds = sorted(known[i] for i in np.unique(kind))
            columns = list(zip(*kinds)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["base", "strand", "mod"])

    return _read_columns(alignments, read_id, blocks=False).mapInArrow(run, "base string, strand string, mod string").distinct()


def simplex_mods(mods: DataFrame) -> DataFrame:
    """Modifications read on one strand only, and the unmodified keys of their canonical bases."""
    plus = F.collect_set(F.when(F.col("strand") == "+", F.col("base"))).alias("bases")
    kinds = mods.select("base", "strand", "mod").distinct().groupBy("mod").agg(plus, F.max(F.col("strand") == "-").alias("minus"))
    only = kinds.where(~F.col("minus") & (F.size("bases") > 0))
    keys = F.concat(F.array("mod"), F.transform("bases", lambda b: F.concat(F.lit("NONE_"), b)))
    return only.select(F.explode(keys).alias("mod")).distinct()


def mod_fraction(counts: DataFrame, pile: DataFrame, simplex: DataFrame) -> DataFrame:
    """Share of a position that carries a modification.

    (modifiable / total) x (count / detectable): modifiable reads show the base or
    its partner, and for one-strand modifications only half of them can be judged.
    """
    p = pile.withColumnRenamed("pos", "position")
    j = counts.withColumnRenamed("pos", "position").join(p, ["chr", "position"])
    j = j.join(simplex.withColumn("is_simplex", F.lit(True)), "mod", "left")
    partner = complement(F.col("base"))

    def of(col: Column, strand: str) -> Column:
        out = F.lit(0)
        for b in ("A", "C", "G", "T"):
            out = F.when(col == b, base_count(b, strand)).otherwise(out)
        return out

    modifiable = of(F.col("base"), "both") + of(partner, "both")
    detectable = F.when(F.col("is_simplex"), of(F.col("base"), "pos") + of(partner, "neg")).otherwise(modifiable)
    value = F.try_divide(modifiable, F.col("total")) * F.try_divide(F.col("count"), detectable)
    return (
        j.where((detectable > 0) & (F.col("total") > 0) & (F.col("count") > 0))
        .select("chr", F.col("position").alias("pos"), "base", "strand", "mod", "count", value.alias("fraction"))
    )
