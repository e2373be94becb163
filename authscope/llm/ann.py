"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample and shipped to every task; every row is indexed under its leaf in each
tree. A query descends all trees at once through one shared priority queue ordered by the sum of the squared
margins to the hyperplanes it crossed, until the leaves it took hold enough rows. Queries then meet the rows of their leaves
by an equality join on (bundle, block, part): blocks are slices of bounded size of a bundle of leaves, parts are slices
of bounded size of the queries, so that neither copies which fill one leaf nor many queries fill one task. Each pair of
slices keeps its exact best k distinct ids per query, and the winners are merged: candidates are reranked by the
exact distance of the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authscope.llm.common import in_arrow, picked


@dataclass(frozen=True)
class Forest:
    """trees; fit_rows: rows of the sample that hyperplanes are fitted on (expected number); leaf_rows: sample rows
    of a leaf at most; share: rows of the leaves that a query takes, as a part of all rows (one that several trees
    offer counts several times: at 1.2 a query meets about 0.7 of the distinct rows); block_rows, query_rows: rows and
    queries that meet in one task."""

    trees: int = 8
    fit_rows: int = 16_384
    leaf_rows: int = 4
    share: float = 1.2
    block_rows: int = 8192
    query_rows: int = 8192
    seed: int = 7


class Tree:
    """Nodes in arrays: children >= 0 are nodes, children < 0 are leaves -(leaf + 1)."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, rng: np.random.Generator):
        self.normals, self.offsets, self.children, self.leaves = [], [], [], 0
        self.root = self._grow(sample, leaf_rows, rng)
        self.normals = np.array(self.normals, dtype=np.float64).reshape(-1, sample.shape[1])
        self.offsets = np.array(self.offsets, dtype=np.float64)
        self.children = np.array(self.children, dtype=np.int64).reshape(-1, 2)

    def _grow(self, sample: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> int:
        if len(sample) > leaf_rows:
            for _ in range(3):
                a, b = sample[rng.integers(len(sample), size=2)]
                normal = a - b
                length = float(np.linalg.norm(normal))
                if not length > 0:
                    normal = rng.standard_normal(sample.shape[1])
                    length = float(np.linalg.norm(normal))
                normal = normal / length
                side = sample @ normal
                offset = float(np.median(side))
                right = side > offset
                if 0 < right.sum() < len(sample):
                    node = len(self.normals)
                    self.normals.append(normal)
                    self.offsets.append(offset)
                    self.children.append((0, 0))
                    self.children[node] = (self._grow(sample[~right], leaf_rows, rng), self._grow(sample[right], leaf_rows, rng))
                    return node
        self.leaves += 1
        return -self.leaves

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of every row of x."""
        at = np.full(len(x), self.root)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            right = np.einsum("ij,ij->i", x[open_], self.normals[node]) > self.offsets[node]
            at[open_] = self.children[node, right.astype(int)]
        return -at - 1


def grow(sample: np.ndarray, p: Forest) -> list[Tree]:
    return [Tree(sample, p.leaf_rows, np.random.default_rng([p.seed, t])) for t in range(p.trees)]


def search(trees: list[Tree], counts: list[np.ndarray], rows: list[np.ndarray], q: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """(tree, leaf) of leaves with rows, in the order of the shared queue, until `counts` of them add up to `enough`."""
    sides = [t.normals @ q - t.offsets for t in trees]
    queue = [(0.0, n, t.root) for n, t in enumerate(trees)]
    found, held = [], 0
    while queue and held < enough:
        margin, n, node = heapq.heappop(queue)
        side, children = sides[n], trees[n].children
        while node >= 0:
            s = float(side[node])
            heapq.heappush(queue, (margin + s * s, n, int(children[node, 0 if s > 0 else 1])))
            node = int(children[node, 1 if s > 0 else 0])
        if rows[n][-node - 1]:
            found.append((n, -node - 1))
            held += int(counts[n][-node - 1])
    return found


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vector as array<double>) of the rows whose vector has finite components that aren't all zero."""
    v = F.col("vector").cast("array<double>")
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return picked(vectors, vec_id=key, vector=vector).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~odd & F.exists("vector", lambda x: x != 0))


def bundles(counts: list[np.ndarray], block_rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each tree: the bundle of every leaf, and the blocks of that bundle. Neighbouring leaves share a bundle
    up to block_rows; a larger leaf has a bundle of its own that is cut into blocks."""
    out, number = [], 0
    for n in counts:
        bundle, blocks, held = np.zeros(len(n), np.int64), np.ones(len(n), np.int64), block_rows
        for leaf, rows in enumerate(n.tolist()):
            if held + rows > block_rows:
                number, held = number + 1, 0
            bundle[leaf], blocks[leaf], held = number, max(1, -(-rows // block_rows)), held + rows
        out.append((bundle, blocks))
    return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest_ids(ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest distinct ids, each at its nearest row, by distance and then id; rows repeat ids freely."""
    rows = k
    while True:
        near = np.flatnonzero(d <= np.partition(d, rows - 1)[rows - 1]) if rows < len(d) else np.arange(len(d))
        near = near[np.lexsort((ids[near], d[near]))]
        first = np.sort(np.unique(ids[near], return_index=True)[1])
        if len(first) >= k or len(near) == len(d):
            return near[first[:k]]
        rows *= 4


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", p: Forest = Forest()) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found rows, by Euclidean distance, ties to smaller vec_id.

    vectors is searched, queries has the same columns; a query never finds rows of its own vec_id. Vectors that are
    null, zero, of another size than most, or hold null or non-finite components take no part, nor do rows without
    id. Rows that repeat an id count once, by their nearest vector; queries that repeat one have one answer, by whichever
    of their vectors is nearer. Empty tables: empty result. Other columns of both are ignored.
    """
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(vectors, key, vector)
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return none
    dim, total = sizes[0]["dim"], sizes[0]["count"]
    rows = rows.filter(F.size("vector") == dim)
    asked = usable(queries, key, vector).filter(F.size("vector") == dim)
    asked_rows = asked.count()
    parts = max(1, -(-asked_rows // p.query_rows))
    place = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(10**9))  # by row, so that one id's rows aren't drawn as one
    part = min(1.0, p.fit_rows / total)
    sample = rows.filter(place < int(part * 10**9)).select(place.alias("place"), "vec_id", "vector").toArrow().sort_by([("place", "ascending"), ("vec_id", "ascending")])
    if not sample.num_rows:
        sample = rows.limit(1).select("vector").toArrow()
    forest = spark.sparkContext.broadcast(grow(matrix(sample["vector"].combine_chunks(), dim), p))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), dim)
            for n, tree in enumerate(forest.value):
                found, times = np.unique(tree.leaf(x), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), n)), pa.array(found), pa.array(times)], names=["tree", "leaf", "n"])

    def count(some: DataFrame) -> list[np.ndarray]:
        out = [np.zeros(t.leaves, np.int64) for t in forest.value]
        for r in in_arrow(some.select("vector"), leaves, "tree long, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():
            out[r["tree"]][r["leaf"]] = r["n"]
        return out

    held, ids = count(rows), rows.select("vec_id").distinct().count()
    # a query takes leaves by the ids in them, so that one id's many rows aren't taken for many neighbours
    counts = held if ids == total else count(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")))
    plan = spark.sparkContext.broadcast((counts, bundles(held, p.block_rows), held))
    enough = max(p.share * ids, p.trees * (k + 1))  # leaves of one tree share no row: of so many, k are other ids

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            x = matrix(batch.column(1), dim)
            turn = np.arange(seen, seen + len(x))  # by place, not id or vector: either may fill a leaf
            seen += len(x)
            for tree, (bundle, blocks) in zip(forest.value, plan.value[1], strict=True):
                leaf = tree.leaf(x)
                yield pa.RecordBatch.from_arrays([pa.array(bundle[leaf]), pa.array(turn % blocks[leaf]), pa.array(leaf), batch.column(0), batch.column(1)], names=["bundle", "block", "leaf", "vec_id", "vector"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, out = matrix(batch.column(1), dim), []
            for i, q in enumerate(x):
                taken: dict[int, list[int]] = {}
                blocks_of: dict[int, int] = {}
                for n, leaf in search(forest.value, plan.value[0], plan.value[2], q, enough):
                    bundle, blocks = plan.value[1][n]
                    taken.setdefault(int(bundle[leaf]), []).append(leaf)
                    blocks_of[int(bundle[leaf])] = int(blocks[leaf])
                out += [(i, b, block, found) for b, found in taken.items() for block in range(blocks_of[b])]
            if out:
                which, b, block, found = zip(*out, strict=True)
                some = pa.array(which, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(block, pa.int64()), pa.array(found, pa.list_(pa.int64())), batch.column(0).take(some), batch.column(1).take(some)], names=["bundle", "block", "leaves", "query_id", "vector"])

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values("leaf", kind="stable")
            x, ids, leaf = np.stack(left["vector"].to_numpy()).astype(np.float64), left["vec_id"].to_numpy(), left["leaf"].to_numpy()
            for query, q, taken in zip(right["query_id"], right["vector"], right["leaves"], strict=True):
                some = np.flatnonzero(np.isin(leaf, taken) & (ids != query))
                if some.size:
                    d = x[some] - np.asarray(q, dtype=np.float64)
                    d = np.sqrt(np.einsum("ij,ij->i", d, d))
                    order = nearest_ids(ids[some], d, k)
                    out += [(query, ids[some[o]], d[o]) for o in order]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    indexed = in_arrow(rows, index, "bundle long, block long, leaf long, vec_id long, vector array<double>")
    indexed = indexed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    routed = in_arrow(asked, route, "bundle long, block long, leaves array<long>, query_id long, vector array<double>")
    routed = routed.withColumn("part", F.pmod(F.xxhash64("query_id", "vector"), F.lit(parts)).cast("int"))
    keys = ["bundle", "block", "part"]
    won = indexed.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double")
    merged = won.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return merged.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
