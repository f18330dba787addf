"""Document boundaries and token counts of flat token streams without an index.

A stream is a run of fixed-size blocks of token ids.  Each block is searched for the
end-of-document id with one vectorised comparison; it reports where the ids
stand, and how many tokens follow the last one.  A document that spans blocks is stitched
by a scan over the blocks: tokens open at the start of a block are those after the last
end id of all blocks before.  The scan runs over groups of blocks first, so a stream of any length is spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genospan.llm.runtime import cut
from genospan.llm.tokens import encoder, vocabulary_path
from genospan.session import ship_by_value

ship_by_value(__name__)

# The end-of-text id of the default vocabulary, which no ordinary text gives.
END_OF_DOCUMENT = 49_407
BLOCK_TOKENS = 1 << 16
BLOCKS_PER_GROUP = 1 << 12


def read_token_file(spark: SparkSession, path: str, token_bytes: int = 4, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(stream, block, tokens) of a flat file or a folder of them, one stream a file in order of their paths.

    Spark reads each file in splits of fixed-length records, which are the blocks; a
    file whose length is no whole number of blocks is refused.
    """
    size = token_bytes * block_tokens
    files = sorted((r["path"], r["length"]) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect())
    if odd := [name for name, length in files if length % size]:
        raise ValueError(f"not a whole number of blocks of {size} bytes: {odd[:3]}")
    out = spark.createDataFrame([], "stream long, block long, tokens binary")
    for k, (name, _) in enumerate(files):
        records = spark.sparkContext.binaryRecords(name, size).zipWithIndex()
        out = out.union(spark.createDataFrame(records.map(lambda x, k=k: (k, x[1], bytes(x[0]))), out.schema))
    return out


def token_stream(docs: DataFrame, text: str = "text", *, path: str | None = None, end_id: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(stream, block, tokens): each partition's texts as one flat stream of ids, cut into blocks with no regard to documents.

    Ids are little-endian unsigned 32-bit; every text is followed by ``end_id``, and
    strings of special tokens in a text count as ordinary text.  Null and empty texts are the end id alone.
    """
    vocabulary = path or vocabulary_path()
    end, size = int(end_id).to_bytes(4, "little"), 4 * block_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, block, held = TaskContext.get().partitionId(), 0, bytearray()
        encode = encoder(vocabulary, specials_as_text=True).encode

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal block
            while len(held) >= least and held:
                yield pa.RecordBatch.from_arrays([pa.array([stream]), pa.array([block]), pa.array([bytes(held[:size])], pa.binary())], names=["stream", "block", "tokens"])
                del held[:size]
                block += 1

        for batch in batches:
            for tokens, edge in encode(batch.column(0)):
                raw = tokens.astype("<u4").tobytes()
                for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    held += raw[4 * lo : 4 * hi]
                    held += end
                    if len(held) >= 16 * size:
                        yield from flush(size)
                yield from flush(size)
        yield from flush(1)

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "stream long, block long, tokens binary")


def _search(end_id: int, dtype: str):
    schema = pa.schema([("stream", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("ends", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends = [], []
            for value in batch.column(2):
                ids = np.frombuffer(value.as_buffer() or b"", dtype=dtype)
                n.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], schema=schema)

    return run


def count_documents(blocks: DataFrame, *, end_id: int = END_OF_DOCUMENT, dtype: str = "<u4", group: int = BLOCKS_PER_GROUP) -> DataFrame:
    """One row per document of (stream, block, tokens): ``stream``, ``doc_no`` (from 0), ``start``, ``n_tokens``
    (the end id included), ``closed``.

    Tokens after the last end id of a stream are one more document that is not closed.  Blocks
    may differ in length, null and empty ones hold no token; streams without tokens give no row.
    """
    found = blocks.where("stream is not null and block is not null").select("stream", "block", "tokens").mapInArrow(
        _search(end_id, dtype), "stream long, block long, n long, ends array<long>"
    )
    # Per block: tokens, documents ended, position of the last end id.  Scan inside groups of blocks, then over groups.
    found = cut(found).withColumn("part", F.floor(F.col("block") / group).cast("long"))
    last_end = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    inside = Window.partitionBy("stream", "part").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = found.withColumn("n0", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("d0", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
    local = local.withColumn("e0", F.max(F.col("n0") + last_end).over(before))
    parts = local.groupBy("stream", "part").agg(
        F.max(F.col("n0") + F.col("n")).alias("pn"), F.max(F.col("d0") + F.size("ends")).alias("pd"), F.max(F.col("n0") + last_end).alias("pe")
    )
    earlier = Window.partitionBy("stream").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("n1", F.coalesce(F.sum("pn").over(earlier), F.lit(0))).withColumn("d1", F.coalesce(F.sum("pd").over(earlier), F.lit(0)))
    carried = parts.select("stream", "part", "n1", "d1", F.max(F.col("n1") + F.col("pe")).over(earlier).alias("e1"), (F.col("n1") + F.col("pn")).alias("upto"))
    met = local.join(carried, ["stream", "part"])
    base, docs_before = F.col("n1") + F.col("n0"), F.col("d1") + F.col("d0")
    # The first token of the document that is open where the block begins.
    opened = F.coalesce(F.col("n1") + F.col("e0"), F.col("e1"), F.lit(-1)) + 1
    closed = met.select("stream", base.alias("base"), docs_before.alias("before"), opened.alias("opened"), "ends", F.posexplode("ends").alias("i", "at"))
    start = F.when(F.col("i") == 0, F.col("opened")).otherwise(F.col("base") + F.element_at("ends", F.greatest(F.col("i"), F.lit(1))) + 1)
    done = closed.select("stream", (F.col("before") + F.col("i")).alias("doc_no"), start.alias("start"), (F.col("base") + F.col("at") + 1 - start).alias("n_tokens"), F.lit(True).alias("closed"))
    total = Window.partitionBy("stream").orderBy(F.col("part").desc())
    tails = parts.select("stream", "part", "d1", "pd", "n1", "pn", "pe", F.max(F.col("n1") + F.col("pe")).over(Window.partitionBy("stream")).alias("e"), F.row_number().over(total).alias("r")).where("r = 1")
    first_open = F.coalesce(F.col("e"), F.lit(-1)) + 1
    length = F.col("n1") + F.col("pn") - first_open
    rest = tails.select("stream", (F.col("d1") + F.col("pd")).alias("doc_no"), first_open.alias("start"), length.alias("n_tokens"), F.lit(False).alias("closed")).where("n_tokens > 0")
    return done.union(rest)
