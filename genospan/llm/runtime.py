"""Small helpers shared by the operators: checkpoints, per-worker state, runs in sorted batches."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from genospan.session import ensure_checkpoint_dir, ship_by_value

ship_by_value(__name__)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so a lost executor costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def worker_state(name: str, make: Callable[[], object]) -> object:
    """An object built once per Python worker process and kept between its tasks."""
    holder = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def int64_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values (nulls as 0) and a mask of the valid ones."""
    valid = np.asarray(pc.is_valid(column).to_numpy(zero_copy_only=False), dtype=bool)
    values = pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
    return values, valid


def binary_rows(column: pa.Array | pa.ChunkedArray, dtype: type) -> np.ndarray:
    """A binary column whose values have one length, as a matrix of ``dtype``."""
    values = column.to_pylist()
    width = len(values[0]) // np.dtype(dtype).itemsize if values else 0
    return np.frombuffer(b"".join(values), dtype=dtype).reshape(len(values), width)


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal ``keys``; the rows of a partition come sorted by them.

    One run is held in memory at a time, whatever the batch size.
    """
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.table(batch)
        change = np.zeros(table.num_rows, dtype=bool)
        for k in keys:
            v = table[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        at = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        first = tuple(table[k][0].as_py() for k in keys)
        if last is not None and first != last:
            yield pa.concat_tables(held)
            held = []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if lo:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(lo, hi - lo))
        last = tuple(table[k][table.num_rows - 1].as_py() for k in keys)
    if held:
        yield pa.concat_tables(held)
