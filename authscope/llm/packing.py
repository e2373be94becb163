"""Packing documents into fixed-size windows by Karmarkar-Karp multiway differencing.

Every document (its ids, then one end id) is cut into whole windows, blocks of a quarter window and one tail.
Whole windows stand alone. Blocks and tails are dealt into groups of bounded size; in each group
the differencing method merges the two partial partitions with the largest imbalance, the fullest window of
one with the emptiest of the other, until one partition with near-equal windows is left. If its fullest
window exceeds the capacity, the number of windows rises by one and the group is partitioned anew.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from authscope.llm.common import in_arrow, materialize, picked, slices
from authscope.llm.tokens import packer

CAPACITY, BLOCK, END, GROUP = 2048, 512, 1, 1024


def differencing(sizes: list[int], m: int) -> list[list[int]]:
    """m windows of item numbers with near-equal sums, by Karmarkar-Karp; ties go to the earlier partition."""
    heap = [(-s, i, [s], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, sa, wa = heapq.heappop(heap)
        _, _, sb, wb = heapq.heappop(heap)
        # both hold their windows from the fullest down; what is missing up to m is empty
        free = m - len(sb)
        sums = sa[:free] + [x + y for x, y in zip(sa[free:], reversed(sb), strict=False)]
        windows = wa[:free] + [x + y for x, y in zip(wa[free:], reversed(wb), strict=False)]
        met = max(0, len(sa) - free)
        sums += sb[: len(sb) - met]
        windows += wb[: len(wb) - met]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, windows = [sums[i] for i in order], [windows[i] for i in order]
        heapq.heappush(heap, (-(sums[0] - (sums[-1] if len(sums) == m else 0)), made, sums, windows))
        made += 1
    return heap[0][3] if heap else []


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows that all hold `capacity` at most; every size must."""
    if not sizes:
        return []
    m = math.ceil(sum(sizes) / capacity)
    while True:
        found = differencing(sizes, m)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return found
        m += 1


def cuts(n: int, capacity: int = CAPACITY, block: int = BLOCK) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole windows, then blocks, then the tail."""
    at = 0
    while n - at >= capacity:
        yield at, capacity
        at += capacity
    while at < n:
        yield at, min(block, n - at)
        at += block


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_key, start, length, ids_crc32, doc_tokens and, if asked for, ids (little-endian binary).

    Null and empty texts are one piece with the end id. Rows that repeat a key, or have none, are documents of their
    own. Long texts are encoded block by block; the ids of one document are in memory at once, 4 bytes each. Columns
    other than key and text are ignored, whatever they are called.
    """
    rows = picked(docs, body=text, doc_key=key)
    names = ["doc_key", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    kinds = [rows.schema["doc_key"].dataType, *[T.LongType()] * 4, *[T.BinaryType()] * with_ids]
    end = END.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = packer(path)
        for batch in slices(batches, 0):
            out, which = [], []
            for k, ids in enumerate(pack(batch.column(0).to_pylist())):
                data = memoryview(ids + end)
                total = len(data) // 4
                for start, n in cuts(total, capacity, block):
                    part = data[4 * start : 4 * (start + n)]
                    out.append((start, n, zlib.crc32(part), total, *[bytes(part)] * with_ids))
                    which.append(k)
            arrays = [pa.array(x, pa.int64() if c < 4 else pa.binary()) for c, x in enumerate(zip(*out, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(which, pa.int64())), *arrays], names=names)

    return in_arrow(rows, run, T.StructType([T.StructField(n, t) for n, t in zip(names, kinds, strict=True)]))


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, block: int = BLOCK, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """pieces(), under the key's own name, with sequence_id and offset: each sequence holds `capacity` ids at most, gapless from 0.

    Sequences hold pieces of one group only; groups have about `group` pieces, however many rows share a key. Edge rows
    are treated as in pieces(). Empty table: empty result.
    """
    cut = materialize(pieces(docs, path, key, text, capacity, block, with_ids).withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    columns = [c for c in cut.columns if c != "_piece"]
    partial = cut.filter(F.col("length") < capacity)
    groups = max(1, math.ceil(partial.count() / group))
    dealt = partial.withColumn("_group", F.pmod(F.xxhash64("_piece"), F.lit(groups)))
    schema = cut.select(*columns).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "_piece"], ascending=[False, True], ignore_index=True)
        sizes, first = frame["length"].tolist(), int(frame["_group"].iloc[0]) << 20
        sequence, offset = [0] * len(sizes), [0] * len(sizes)
        for w, items in enumerate(windows(sizes, capacity)):
            at = 0
            for i in items:
                sequence[i], offset[i] = 2 * (first + w), at
                at += sizes[i]
        return frame.assign(sequence_id=sequence, offset=offset)[[*columns, "sequence_id", "offset"]]

    shared = dealt.groupBy("_group").applyInPandas(place, schema)
    whole = cut.filter(F.col("length") >= capacity).select(*columns, (2 * F.col("_piece") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(whole).toDF(key, *columns[1:], "sequence_id", "offset")
