"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits. Two that differ in at most k bits agree, up to one bit, on at least one of
floor(k / 2) + 1 segments. Each segment is therefore indexed under all of its one-wildcard variants (the
segment with one bit deleted); an equality join on (segment, wildcard, rest) meets every such pair and the
join condition verifies the whole distance. A pair is kept only at its first segment and wildcard, so it
comes out once without a distinct. Only distinct fingerprints are indexed: exact copies never meet in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from authscope.llm.common import ROW_ID, by_row, in_arrow, materialize, picked, position, release, slices, with_row_id

SEED = 42


#: Jaccard similarity of two texts' sets of shingles from which they are near copies, as a fraction.
SIMILAR = (4, 5)
#: Rows (expected) that frequent shingles are counted on, shingles taken for frequent at most, and rows that make one frequent.
SAMPLE_ROWS, FREQUENT, FREQUENT_FROM = 1 << 16, 1 << 19, 3
#: Orders of the sets, by a hash each, whose first set is a pivot wherever a shingle is shared.
PIVOTS = 4
#: Longs of a parity sketch.
SKETCH = 16


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of the text's word shingles, repeats included; of all words if they are fewer; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined, n = b" ".join(words), len(words)
    if n < width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[i:j], SEED) for i, j in zip(starts[: n - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: list[int]) -> np.ndarray:
    """Fingerprint, one long: a bit is set if it is in over half the hashes."""
    counts, total = np.zeros(64, np.int64), len(hashes)
    for at in range(0, total, 1 << 14):  # bounded memory for very long texts
        part = np.array(hashes[at : at + (1 << 14)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > total, bitorder="little").view("<i8")


def fingerprint(text: str | None, width: int = 4) -> int:
    """Majority fingerprint of the text's word shingles, unsigned; 0 without words."""
    return int(majority(shingle_hashes(text, width)).view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4) -> DataFrame:
    """Every row's other columns with `fp` (64 bits as a signed long), in place of a column of that name.

    Null text has fingerprint 0.
    """
    keep = [c for c in docs.columns if c not in (text, "fp")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fp", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            found = [int(majority(shingle_hashes(x.as_py(), width))[0]) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.int64())], names=[*keep, "fp"])

    return in_arrow(docs.select(text, *keep), run, schema)


def segments(bits: int) -> list[tuple[int, int]]:
    """(first bit, length) of the floor(bits / 2) + 1 segments of 64 bits."""
    n = bits // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _long(value: int) -> F.Column:
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def links(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints `fp` that differ in at most `bits` bits, each once.

    The index is never broadcast: planners don't know that it has 64 rows for each of a small table's.
    """
    cut = segments(bits)
    masks = [((1 << n) - 1) << at for at, n in cut]
    variants = [
        F.struct(F.lit(64 * s + j).alias("place"), F.col("fp").bitwiseAND(_long(mask & ~(1 << (at + j)))).alias("rest"))
        for s, ((at, n), mask) in enumerate(zip(cut, masks, strict=True))
        for j in range(n)
    ]
    index = distinct.select("fp", F.inline(F.array(*variants)).alias("place", "rest"))
    a, b = index.hint("merge").alias("a"), index.hint("merge").alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    near = [F.bit_count(differ.bitwiseAND(_long(m))) for m in masks]
    # first segment with at most one differing bit; a segment without any counts at its first wildcard
    here = F.lit(False)
    for s in reversed(range(len(cut))):
        mine = (F.col("a.place") >= 64 * s) & (F.col("a.place") < 64 * s + 64) & ((near[s] == 1) | (F.col("a.place") == 64 * s))
        here = F.when(near[s] <= 1, mine).otherwise(here)
    return a.join(
        b,
        (F.col("a.place") == F.col("b.place")) & (F.col("a.rest") == F.col("b.rest")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(differ) <= bits) & here,
    ).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _stars(edges: DataFrame) -> DataFrame:
    """The edges after a large-star and a small-star round."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _smallest(both).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    low = _smallest(large)
    return large.join(low, "u").select("v", "m").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the smallest node that is reachable.

    Alternates large-star and small-star until the edges no longer change; both are an aggregate and an
    equality join, so no neighbourhood is ever gathered in one row or on the driver.
    """
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        after = materialize(_stars(edges), "cc")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(edges)
        edges = after
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 4, width: int = 4) -> DataFrame:
    """One row per row of docs: key, fp, component_id (the smallest key that is reachable over links).

    Null or empty text: fingerprint 0, linked like any other. Rows repeated exactly: each keeps its row.
    Null key: the row is fingerprinted and linked; its component is null only if no key in it is known.
    Empty table: empty result. Columns of docs other than key and text are ignored.
    """
    fps = materialize(fingerprints(picked(docs, doc_key=key, body=text), "body", width), "fp")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_key").alias("least")), "fpclass")
    # nodes are fingerprints; the smallest document of a component is found afterwards
    tree = components(links(classes, bits).select(F.col("a").alias("u"), F.col("b").alias("v")))
    root = classes.join(tree, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    root = materialize(root, "fproot")
    lowest = root.groupBy("root").agg(F.min("least").alias("component_id"))
    named = root.join(lowest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_key", "fp", "component_id").toDF(key, "fp", "component_id")


def _distinct(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes, dtype="<u8"))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """64 * SKETCH bits, each the parity of the shingles that fall on it. A shingle that only one of two sets has flips one
    bit, so the sets differ in at least as many shingles as their sketches in bits."""
    bits = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH)
    return np.packbits((bits & 1).astype(np.uint8), bitorder="little").view("<i8")


def prefix(shingles: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, in one order for all texts, such that two similar sets share one of theirs.

    Shingles that aren't frequent come first, by hash, then frequent ones (sorted hashes), by rank.
    """
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        place = np.where(frequent[at] == shingles, rank[at] + 1, 0)
        shingles = shingles[np.argsort(place, kind="stable")]
    num, den = SIMILAR
    return shingles[: len(shingles) + (-num * len(shingles)) // den + 1]


def shingle_sets(rows: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """(key, shingles): every row's distinct shingles."""
    schema = T.StructType([rows.schema[key], T.StructField("shingles", T.ArrayType(T.LongType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            sets = [_distinct(shingle_hashes(x.as_py(), width)).view("<i8") for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sets, pa.list_(pa.int64()))], names=[key, "shingles"])

    return in_arrow(rows.select(text, key), run, schema)


def frequent_shingles(rows: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted; rank of each, rarest first) of shingles that a bounded sample repeats. Only speed depends on them."""
    part = min(1.0, SAMPLE_ROWS / max(1, rows.count()))
    some = rows.filter(F.pmod(F.xxhash64(*ROW_ID), F.lit(10**9)) < int(part * 10**9)).select(F.lit(0).alias("one"), text)
    counts = shingle_sets(some, text, "one", width).select(F.explode("shingles").alias("s")).groupBy("s").count().filter(F.col("count") >= FREQUENT_FROM)
    counted = materialize(counts, "counted", some)  # so that the shuffle of the sample's shingles goes
    top = counted.orderBy(F.desc("count"), "s").limit(FREQUENT).select("s").toArrow()["s"].to_numpy().astype("<i8")
    release(counted)
    hashes = top.view("<u8")
    order = np.argsort(hashes)
    return hashes[order], (len(top) - np.arange(len(top), dtype=np.int32))[order]


def signatures(rows: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Every row's identity and doc_key with fp, set_id (hash of the set of shingles), its size n, sketch and prefix."""
    keep = rows.select(*ROW_ID, F.col(key).alias("doc_key"), F.col(text).alias("body"))
    frequent = rows.sparkSession.sparkContext.broadcast(frequent_shingles(keep, "body", width))
    names = [*ROW_ID, "doc_key"]
    more = [T.StructField(c, T.LongType(), False) for c in ("fp", "set_id", "n")]
    longs = T.ArrayType(T.LongType(), False)
    schema = T.StructType([*[keep.schema[c] for c in names], *more, T.StructField("sketch", longs, False), T.StructField("prefix", longs, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            fps, ids, sizes, sketches, first = [], [], [], [], []
            for x in batch.column(0):
                hashes = shingle_hashes(x.as_py(), width)
                own = _distinct(hashes)
                fps.append(int(majority(hashes)[0]))
                ids.append(xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63))
                sizes.append(len(own))
                sketches.append(sketch(own))
                first.append(prefix(own, *frequent.value).view("<i8"))
            arrays = [*(pa.array(x, pa.int64()) for x in (fps, ids, sizes)), *(pa.array(x, pa.list_(pa.int64())) for x in (sketches, first))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *arrays], names=schema.names)

    return in_arrow(keep.select("body", *names), run, schema)


def apart(sketches: list[tuple[F.Column, F.Column]]) -> F.Column:
    """Bits in which two sketches differ, over the longs of them that are given."""
    return reduce(lambda x, y: x + y, (F.bit_count(a.bitwiseXOR(b)) for a, b in sketches))


def repeated(index: DataFrame) -> DataFrame:
    """Rows of an index whose shingle others have too. Such shingles are never broadcast: planners take the rows that an
    array unfolds to for one, and there may be hundreds."""
    shared = index.groupBy("shingle").agg(F.count("*").alias("times")).filter("times > 1").select("shingle")
    return index.join(shared.hint("merge"), "shingle")


def early(a: str, b: str) -> F.Column:
    """Whether a and b (n, pos) share a shingle so early that their sets may be similar: in one order for all, two similar
    sets share one that has at least as many behind it, itself included, in either set as they must have in common."""
    num, den = SIMILAR
    both = F.col(f"{a}.n") + F.col(f"{b}.n")
    return ((F.col(f"{a}.n") - F.col(f"{a}.pos")) * (num + den) >= both * num) & ((F.col(f"{b}.n") - F.col(f"{b}.pos")) * (num + den) >= both * num)


def possible(shared: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs (u, v) of set ids, each once, of rows that say where a and b (set_id, n, pos) share a shingle early().

    Up to the last such place they share as many shingles as there are rows; behind it at most all that are left.
    Pairs that can't be similar even so go; if a pair's rows are not all there, it may go too.
    """
    num, den = SIMILAR
    pairs = shared.groupBy(F.col(f"{a}.set_id").alias("u"), F.col(f"{b}.set_id").alias("v"), F.col(f"{a}.n").alias("n"), F.col(f"{b}.n").alias("m")).agg(F.count("*").alias("both"), F.max(f"{a}.pos").alias("i"), F.max(f"{b}.pos").alias("j"))
    most = F.col("both") + F.least(F.expr("n - i - 1"), F.expr("m - j - 1"))
    return pairs.filter(most * (num + den) >= F.expr("n + m") * num).select("u", "v")


def screened(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) but for those whose sketches differ in more bits than similar sets may in shingles."""
    num, den = SIMILAR
    of = lambda x: nodes.select(F.col("set_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    differ = apart([(F.col("sketch_u")[i], F.col("sketch_v")[i]) for i in range(SKETCH)])
    return pairs.join(of("u"), "u").join(of("v"), "v").filter(differ * (num + den) <= (F.col("n_u") + F.col("n_v")) * (den - num)).select("u", "v")


def similar_pairs(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, text: str, width: int) -> DataFrame:
    """The pairs (u, v) of set ids whose sets are similar, as a written table.

    Texts of the sets in question, one row each, are read again; no other set is made or moved.
    """
    num, den = SIMILAR
    wanted = pairs.select(F.col("u").alias("set_id")).union(pairs.select("v")).distinct()
    where = materialize(nodes.join(wanted, "set_id", "left_semi").select("set_id", *ROW_ID), "where")
    sets = materialize(shingle_sets(by_row(rows.select(*ROW_ID, F.col(text).alias("body")), where, "inner"), "body", "set_id", width), "shingles", where)
    a, b = (sets.select(F.col("set_id").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "uv")
    both = F.size(F.array_intersect("of_u", "of_v"))
    near = pairs.join(a, "u").join(b, "v").filter(both * (num + den) >= num * (F.size("of_u") + F.size("of_v"))).select("u", "v")
    return materialize(near, "near", sets, pairs)


def _grouped(rows: DataFrame, key: str, text: str, bits: int, width: int) -> DataFrame:
    """Row identity, doc_key and root (one set id of the group) of every row of a table with row identities.

    Links are pairs of similar sets, by their exact Jaccard similarity; groups are their connected components.
    Candidates come in two steps. First each set meets one close fingerprint and, for each shingle of its prefix,
    the PIVOTS sets that come first among those that have it there: a few pairs a set, however dense a group is. Then
    sets that share a shingle of their prefixes meet unless they are in one group already, so no similar pair is missed.
    """
    fps = materialize(signatures(rows, key, text, width), "fp")
    nodes = fps.groupBy("set_id").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), F.count("*").alias("times"), F.min(F.struct(*ROW_ID)).alias("row"), F.first("sketch").alias("sketch"))
    nodes = materialize(nodes.select("set_id", "fp", "n", "times", "row.*", "sketch"), "sets")  # a set by one of its rows
    classes = materialize(nodes.groupBy("fp").agg(F.min("set_id").alias("least")), "fpclass")
    close = links(classes.select("fp"), bits).groupBy("b").agg(F.min("a").alias("a"))
    least = lambda x: classes.select(F.col("fp").alias(x), F.col("least").alias(f"least_{x}"))
    close = close.join(least("a"), "a").join(least("b"), "b").select(F.col("least_a").alias("u"), F.col("least_b").alias("v"))
    equal = nodes.select("fp", "set_id").join(classes, "fp").filter("set_id <> least").select(F.col("least").alias("u"), F.col("set_id").alias("v"))
    ordered = lambda df: df.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    close = materialize(ordered(close.union(equal)), "close", classes)
    # copies beyond a set's first row index nothing
    extra = fps.select(*ROW_ID, "set_id").join(nodes.filter("times > 1").select("set_id", F.struct(*ROW_ID).alias("row")), "set_id").filter(~F.struct(*ROW_ID).eqNullSafe(F.col("row")))
    extra = materialize(extra.select(*ROW_ID), "extra")
    index = by_row(fps.select(*ROW_ID, "set_id", "n", "prefix"), extra, "left_anti")
    index = index.select("set_id", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "shingle"))
    index = materialize(repeated(index), "prefixes", extra)
    members = materialize(fps.select(*ROW_ID, "doc_key", "set_id"), "members", fps)
    leaders = [F.min(F.struct(F.xxhash64(F.lit(i), F.col("set_id")).alias("turn"), "set_id", "n", "pos")).alias(f"pivot_{i}") for i in range(PIVOTS)]
    met = index.join(index.groupBy("shingle").agg(*leaders), "shingle").select(F.struct("set_id", "n", "pos").alias("own"), F.explode(F.array_distinct(F.array(*[f"pivot_{i}" for i in range(PIVOTS)]))).alias("pivot"))
    pivots = possible(met.filter("pivot.set_id <> own.set_id").filter(early("pivot", "own")), "pivot", "own")
    first = materialize(screened(ordered(pivots.union(close)), nodes), "pairs", close)
    near = similar_pairs(first, nodes, rows, text, width)
    tree = components(near)
    # the sketch goes along: it tells sets apart before a pair is made
    whole = [f"bits_{i}" for i in range(SKETCH)]
    own = Window.partitionBy("set_id").orderBy("pos")
    before = F.array_compact(F.array(*[F.lag("shingle", k).over(own) for k in range(1, 5)]))
    rooted = index.withColumn("before", before).join(nodes.select("set_id", *[F.col("sketch")[i].alias(b) for i, b in enumerate(whole)]), "set_id").join(tree, F.col("set_id") == F.col("node"), "left")
    rooted = materialize(rooted.select("shingle", "before", "set_id", "n", "pos", *whole, F.coalesce("root", "set_id").alias("root")), "prefixes", index, first)
    a, b = rooted.hint("merge").alias("a"), rooted.hint("merge").alias("b")  # wide rows in small files
    num, den = SIMILAR
    near_enough = apart([(F.col(f"a.{x}"), F.col(f"b.{x}")) for x in whole]) * (num + den) <= (F.col("a.n") + F.col("b.n")) * (den - num)
    # the first shingle that two sets share has no shared one among the last before it, and before it only such as one set has
    begins = ~F.arrays_overlap("a.before", "b.before") & ((F.col("a.pos") + F.col("b.pos")) * (num + den) <= (F.col("a.n") + F.col("b.n")) * (den - num))
    rest = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.set_id") < F.col("b.set_id")) & (F.col("a.root") != F.col("b.root")) & early("a", "b") & near_enough & begins)
    rest = rest.select(F.col("a.set_id").alias("u"), F.col("b.set_id").alias("v")).distinct()
    rest = materialize(screened(rest, nodes), "pairs", rooted)
    tree = components(near.union(similar_pairs(rest, nodes, rows, text, width)))
    return members.join(tree, F.col("set_id") == F.col("node"), "left").select(*ROW_ID, "doc_key", F.coalesce("root", "set_id").alias("root"))


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 4, width: int = 5) -> DataFrame:
    """One row per row of docs: key, component_id (the smallest key of its group of near copies).

    Groups hold texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, in chains.
    Rows are treated as by near_duplicates().
    """
    found = materialize(_grouped(with_row_id(docs, "dedup"), f"c{position(docs, key)}", f"c{position(docs, text)}", bits, width), "groups")
    lowest = found.groupBy("root").agg(F.min("doc_key").alias("component_id"))
    return found.join(lowest, "root").select("doc_key", "component_id").toDF(key, "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 4, width: int = 5) -> DataFrame:
    """docs without all but one row of each group of near copies; the columns stay as they are.

    The row with the smallest key stays, of rows that share that key the first by file and place in it; a key that
    several rows share decides nothing about rows of other groups.
    Rows with a null key have no identity to drop by: all of them stay. Empty table: empty result.
    """
    rows, key = with_row_id(docs, "dedup"), f"c{position(docs, key)}"
    own = [c for c in rows.columns if c not in ROW_ID]
    found = materialize(_grouped(rows, key, f"c{position(docs, text)}", bits, width).filter("doc_key is not null"), "groups")
    stays = found.groupBy("root").agg(F.min(F.struct("doc_key", *ROW_ID)).alias("row"))
    goes = found.join(stays, "root").filter(F.struct("doc_key", *ROW_ID) != F.col("row")).select(*ROW_ID)
    return by_row(rows, materialize(goes, "goes", found), "left_anti").select(*own).toDF(*docs.columns)
