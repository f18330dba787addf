"""Text lines, optionally in file order, and directive lines that apply to the lines below."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field as data_field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genospan.scale import cut_lineage, ordered_scan

# Columns of an ordered line table: ``file`` and the order key inside a file.
ORDER = ["part", "line"]
LINES_PER_BLOCK_BITS = 17
# Tables with one row a file are sent to every executor up to this many bytes; larger ones are joined by shuffle.
MOST_SENT_BYTES = 64 << 20


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines as ``value``; for formats in which every line stands alone."""
    return spark.read.text(path if isinstance(path, str) else list(path))


def ordered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines with ``file, part, line``: (part, line) increases along each file.

    ``part`` is the byte offset of the file split and ``line`` grows inside it.
    The split size is pinned, so that re-reading after the loss of an executor,
    or with another number of executors, numbers the lines in the same way.
    """
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    df = read_lines(spark, path)
    return df.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )


@dataclass(frozen=True)
class Header:
    """What a header line says, as columns: of one given list, or of the file that a line comes from."""

    line: Column
    names: Column
    size: Column
    at: Mapping[str, Column] = data_field(default_factory=dict)


# Names that a wanted column may have (lower case), and its place where none of them occurs.
Wanted = Mapping[str, tuple[Sequence[str], int | None]]


def listed_header(names: Sequence[str], wanted: Wanted | None = None) -> Header:
    """The header that the caller gives."""
    lower = [n.strip().lower() for n in names]

    def place(known: Sequence[str], default: int | None) -> Column:
        hits = [i for i, n in enumerate(lower) if n in known]
        return F.lit(hits[-1] if hits else default).cast("int")

    at = {k: place(*w) for k, w in (wanted or {}).items()}
    return Header(F.lit("\t".join(names)), F.array(*[F.lit(n) for n in names]), F.lit(len(names)), at)


def lines_of_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines with the ``file`` they come from."""
    return read_lines(spark, path).select(F.col("_metadata.file_path").alias("file"), "value")


def join_by_file(rows: DataFrame, of_file: DataFrame) -> DataFrame:
    """``rows`` beside the one row that ``of_file`` has for their file (nulls where it has none).

    A file may hold any share of the rows, so they stay where they are as long as the other table is small;
    its size is measured.
    """
    of_file = cut_lineage(of_file)
    text = F.to_json(F.struct(*of_file.columns))
    size = of_file.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return rows.join(F.broadcast(of_file) if size <= MOST_SENT_BYTES else of_file, "file", "left")


def with_file_headers(spark: SparkSession, path: str | Sequence[str], is_header: Column, wanted: Wanted | None = None) -> tuple[DataFrame, Header]:
    """Lines with ``file``, and the header of each line's own file: its first line for which ``is_header`` holds.

    Places of wanted columns are found once per file.
    """
    first = F.min(F.struct("part", "line", "value"))["value"]
    heads = ordered_lines(spark, path).where(is_header).groupBy("file").agg(first.alias("head_line"))
    heads = heads.withColumn("head_names", F.split(F.regexp_replace("head_line", "^#+", ""), "\t"))

    def place(known: Sequence[str], default: int | None) -> Column:
        hit = F.transform("head_names", lambda n, i: F.when(F.lower(F.trim(n)).isin(*known), i))
        return F.coalesce(F.array_max(hit), F.lit(default).cast("int"))

    heads = heads.select("file", "head_line", "head_names", *[place(*w).alias(f"head_at_{k}") for k, w in (wanted or {}).items()])
    lines = join_by_file(lines_of_files(spark, path), heads)
    at = {k: F.col(f"head_at_{k}") for k in wanted or {}}
    return lines, Header(F.col("head_line"), F.col("head_names"), F.size("head_names"), at)


def named_fields(header: Header, but: Sequence[Column] = (), tokens: str = "t", first: int = 0) -> Column:
    """The fields from ``first`` on as a map by header name, without those at ``but``; of a repeated name the last stays."""
    entries = F.transform(F.slice(header.names, first + 1, F.greatest(header.size - first, F.lit(0))), lambda n, i: F.struct(n.alias("k"), (i + first).alias("i")))
    if but:
        entries = F.filter(entries, lambda e: ~F.array_contains(F.array(*but), e["i"]))
    last = F.filter(entries, lambda e: ~F.exists(entries, lambda x: (x["k"] == e["k"]) & (x["i"] > e["i"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], F.get(F.col(tokens), e["i"]))))


def line_block() -> Column:
    return F.struct("part", F.shiftright("line", LINES_PER_BLOCK_BITS).alias("chunk"))


def fill_directives(lines: DataFrame, directive: Column, name: str = "directive") -> DataFrame:
    """Carry the latest non-null ``directive`` down to the lines below it, per file."""
    return ordered_scan(lines, ["file"], ORDER, line_block(), **{name: ("last", directive)})


def number_within(lines: DataFrame, by: Sequence[str], counted: Column, name: str) -> DataFrame:
    """Running count of ``counted`` rows inside ``by``, in file order, current row included."""
    return ordered_scan(lines, by, ORDER, line_block(), **{name: ("sum", counted.cast("long"))})


def once(col: Column) -> Column:
    """A column that is computed once a row: filters on it stay above the one-element explode."""
    return F.explode(F.array(col))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs in it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fields(pattern: str = "\t") -> Column:
    return F.split(F.col("value"), pattern)


def blank_fields() -> Column:
    """Fields separated by any white space."""
    return F.split(F.trim("value"), r"\s+")


def field(i: int | Column, tokens: str = "t") -> Column:
    """Field ``i`` (0-based) or NULL when the line is shorter."""
    return F.get(F.col(tokens), F.lit(i) if isinstance(i, int) else i)


def as_long(col: Column) -> Column:
    """Leading integer of a text, as lenient number parsers do."""
    # Most texts are plain numbers, which need no pattern.
    plain = ((col >= "0") & (col < ":")) | ((col >= "-0") & (col < "-:"))
    return F.coalesce(F.when(plain, col.try_cast("long")), F.regexp_extract(col, r"^\s*([+-]?\d+)", 1).try_cast("long"))


def as_double(col: Column) -> Column:
    return F.trim(col).try_cast("double")


def long_field(i: int | Column, tokens: str = "t") -> Column:
    return as_long(field(i, tokens))


def double_field(i: int | Column, tokens: str = "t") -> Column:
    return as_double(field(i, tokens))


def dot_null(col: Column) -> Column:
    """``.`` means missing."""
    return F.when(col != ".", col)


def content(lines: DataFrame) -> DataFrame:
    """Lines that are not empty, comments or browser directives."""
    v = F.trim("value")
    return lines.where((v != "") & ~v.startswith("#") & ~v.startswith("browser") & ~v.startswith("track"))


def without(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)
