"""Shared pieces: table access, shared-folder tables, columns by exact name, bounded Arrow slices, word rules."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from authscope.session import new_path

#: ASCII white space that ends a word; bytes.split() without arguments uses the same six characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: Unicode White_Space, the class that public BPE split patterns call \s.
UNICODE_SPACE = "\t-\r \x85\xa0  -     　"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str, *done: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: one computation, cut lineage, survives lost executors.

    `done` are tables written like this that nothing needs any more: they go, and so do shuffle files of finished work,
    which stay on the executors' disks until the driver's collector finds that no plan refers to them.
    """
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    for table in done:
        release(table)
    if done:
        sweep(df.sparkSession)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._shared_path = path
    return back


def sweep(spark: SparkSession) -> None:
    """Ask the driver's collector to find finished plans now, so that their shuffle files go."""
    spark.sparkContext._jvm.System.gc()


def release(df: DataFrame) -> None:
    """Delete a table that materialize() wrote; its data must no longer be needed."""
    path = getattr(df, "_shared_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def position(df: DataFrame, name: str) -> int:
    """Place of a column: by its exact name, else by the only one that differs in case alone."""
    if name in df.columns:
        return df.columns.index(name)
    found = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"no column {name} among {df.columns}")
    return found[0]


def numbered(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ... by place: no name of the caller's can clash with one of ours, or hold a dot."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def picked(df: DataFrame, **names: str | Column) -> DataFrame:
    """The columns asked for under the names given; all others, whatever they are called, go."""
    made = {n: c for n, c in names.items() if isinstance(c, Column)}
    rows = df.select("*", *made.values()).toDF(*[f"c{i}" for i in range(len(df.columns))], *made)
    return rows.select(*[n if n in made else F.col(f"c{position(df, c)}").alias(n) for n, c in names.items()])


#: Bounds of an Arrow batch, for sessions that set none of their own: long texts mustn't fill a Python worker.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "4096"}


def in_arrow(rows: DataFrame, run, schema) -> DataFrame:
    """rows.mapInArrow(run, schema) in batches of bounded size, the same for every operator; what the session says counts first."""
    said = rows.sparkSession.conf.getAll
    for name, value in BATCH.items():
        if name not in said:
            rows.sparkSession.conf.set(name, value)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return rows.mapInArrow(tidy, schema)


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task stands beside the tasks of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], text: int, limit: int = 1 << 21, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about `limit` bytes of column number `text`, one row at least, so that what is
    unpacked in Python at once is bounded whatever size the batches have."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        for i, j in by_size(lengths.tolist(), limit, rows):
            yield batch.slice(i, j - i)


def by_size(sizes: Iterable[int], limit: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of consecutive items of about `limit` in all, one item at least and `rows` at most."""
    start = held = n = 0
    for n, size in enumerate(sizes, 1):
        held += size
        if held >= limit or n - start >= rows:
            yield start, n
            start, held = n, 0
    if start < n:
        yield start, n


def by_bytes(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """by_size() of texts by their UTF-8 bytes."""
    ends = np.cumsum(pc.binary_length(pa.array(texts, pa.string())).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = held = 0
    while start < len(ends):
        after = min(len(ends), int(np.searchsorted(ends, held + limit)) + 1)
        yield start, after
        start, held = after, int(ends[after - 1])


_BOUNDARY = re.compile(f"(?<=[^{UNICODE_SPACE}])(?=[{UNICODE_SPACE}])|(?<=[A-Za-z])(?=[0-9])")


def safe_blocks(text: str, limit: int = 1 << 20, boundary: re.Pattern = _BOUNDARY) -> Iterator[str]:
    """Pieces of a text of about `limit` characters, cut only where white space follows a character that isn't any, or an
    ASCII digit an ASCII letter, if no other boundary is given.

    Public BPE split patterns never let one pre-token run over such a place, so tokens of the pieces are the tokens of
    the text. A text that has no such place is one piece: the vocabulary's own pre-token may be as long.
    """
    start = 0
    while len(text) - start > limit:
        found = boundary.search(text, start + limit)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def n_words(text) -> F.Column:
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


#: Row identity: hash of the file's path (64 bits, for files only, of which there are never billions) and place in it.
ROW_ID = ("_file", "_row_index")
#: Rows of row identities and a few numbers that are broadcast at most; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000


def _plain_scan(df: DataFrame) -> bool:
    """Whether df is a scan of files with nothing on it that could repeat or join rows."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().head()
    return plan.nodeName() in ("LogicalRelation", "RelationV2", "DataSourceV2Relation")


def with_row_id(df: DataFrame, tag: str = "rows") -> DataFrame:
    """numbered(df) and a row identity, the same in every later scan of the same files. What isn't a plain scan of files is
    written first."""
    if _plain_scan(df):
        try:
            found = df.select("*", F.xxhash64(F.col("_metadata.file_path")), F.col("_metadata.row_index"))
            found = found.toDF(*[f"c{i}" for i in range(len(df.columns))], *ROW_ID)
            found.schema  # noqa: B018  resolves the names
            return found
        except AnalysisException:  # a source without places, or a column of the caller's called _metadata
            pass
    return with_row_id(materialize(numbered(df), tag), tag)


def by_row(rows: DataFrame, written: DataFrame, how: str) -> DataFrame:
    """rows joined with a written table by row identity; the table is broadcast if it is small, so that texts stay where they are."""
    return rows.join(F.broadcast(written) if written.count() <= BROADCAST_ROWS else written, list(ROW_ID), how)
