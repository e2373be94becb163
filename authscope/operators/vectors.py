"""Behaviour vectors, nearest neighbours (exact in blocks, or by an index of cells), anomaly scores and retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authscope.functions import expressions as X
from authscope.operators.rollup import DAY
from authscope.session import cut, new_path

# The vocabularies whose shares are vector dimensions, in order; all else is "other".
AUTH_TYPES = ["Kerberos", "Negotiate", "NTLM", "MICROSOFT"]
LOGON_TYPES = ["Network", "Service", "Unlock", "Interactive", "Batch", "NewCredentials", "NetworkCleartext"]
ORIENTATIONS = ["LogOn", "LogOff", "TGS", "TGT", "AuthMap", "ScreenLock", "ScreenUnlock"]
VOCABULARIES = {"auth_type": AUTH_TYPES, "logon_type": LOGON_TYPES, "auth_orientation": ORIENTATIONS}
COUNTS = ("auth_count", "failure_count", "distinct_dst", "distinct_src", "new_dst")


def feature_names() -> list[str]:
    names = [f"log_{c}" for c in COUNTS] + ["failure_ratio"] + [f"hour_{h:02d}_share" for h in range(24)]
    for column, words in VOCABULARIES.items():
        names += [f"{column.removeprefix('auth_') if column == 'auth_orientation' else column}_{w.lower()}_share" for w in [*words, "other"]]
    return [*names, "is_machine"]


def features(events: DataFrame, daily: DataFrame) -> DataFrame:
    """One row per identity-day: log counts, failure ratio, shares of hours and of prefixes of categories, machine flag."""
    hours = [F.count_if(F.col("hour_of_day") == h) for h in range(24)]
    shares = list(hours)
    for column, words in VOCABULARIES.items():
        value = F.coalesce(F.col(column), F.lit(""))
        shares += [F.count_if(value.startswith(w)) for w in words] + [F.count_if(~X.starts_with_any(value, words))]
    names = feature_names()
    made = events.filter("src_user is not null").groupBy(*DAY).agg(
        F.count("*").alias("auth_count"), F.count_if(F.coalesce("is_failure", F.lit(False))).alias("failure_count"), F.countDistinct("dst_computer").alias("distinct_dst"),
        F.countDistinct("src_computer").alias("distinct_src"), F.bool_or("src_is_machine").alias("machine"), *[s.alias(n) for s, n in zip(shares, names[6:-1], strict=True)],
    )
    made = made.join(daily.select(*DAY, F.col("new_dst_computers").alias("new_dst")), DAY, "left").fillna(0, ["new_dst"])
    counts = [F.log1p(F.col(c)).alias(f"log_{c}") for c in COUNTS]
    whole = F.col("auth_count")
    return made.select(*DAY, *counts, (F.col("failure_count") / whole).alias("failure_ratio"), *[(F.col(n) / whole).alias(n) for n in names[6:-1]], F.col("machine").cast("int").cast("double").alias("is_machine"))


def vectors(made: DataFrame) -> DataFrame:
    """Standardised by the population's mean and deviation, then of unit length; without spread the deviation is 1."""
    names = feature_names()
    flat = made.select(F.posexplode(F.array(*names)).alias("at", "x")).groupBy("at").agg(F.mean("x").alias("mean"), F.stddev_pop("x").alias("deviation"))
    stats = {r["at"]: (r["mean"], r["deviation"] or 1.0) for r in flat.collect()}  # a row per dimension
    z = made.select(*DAY, *[((F.col(n) - F.lit(stats.get(i, (0.0, 1.0))[0])) / F.lit(stats.get(i, (0.0, 1.0))[1])).alias(n) for i, n in enumerate(names)])
    norm = F.sqrt(sum((F.col(n) * F.col(n) for n in names[1:]), F.col(names[0]) * F.col(names[0])))
    z = z.withColumn("_norm", norm)
    length = F.when(F.col("_norm") > 0, F.col("_norm")).otherwise(1.0)
    return z.select(*DAY, F.array(*[(F.col(n) / length).cast("float") for n in names]).alias("vector"))


@dataclass(frozen=True)
class Index:
    """Cells of an approximate index: centroids are fitted on fit_rows rows at most (expected), about `cells` of them for
    each sqrt(rows) up to max_cells; a query looks into the `probes` nearest cells. block_rows: rows of a cell, or queries
    to it, that meet in one task."""

    cells: float = 0.5
    max_cells: int = 4096
    probes: int = 8
    fit_rows: int = 65_536
    rounds: int = 8
    block_rows: int = 8192
    seed: int = 5


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _near_cells(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of every row, nearest first."""
    d = (centroids**2).sum(axis=1)[None, :] - 2.0 * (x @ centroids.T)
    n = min(n, d.shape[1])
    some = np.argpartition(d, n - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, axis=1), axis=1, kind="stable"), axis=1)


def fit_centroids(rows: DataFrame, total: int, p: Index) -> np.ndarray:
    """Centroids by Lloyd's rounds over a bounded sample, drawn by hash of id."""
    place = F.pmod(F.xxhash64("id"), F.lit(10**9))
    part = min(1.0, p.fit_rows / max(1, total))
    drawn = rows.filter(place < int(part * 10**9)).select(place.alias("place"), "vector").toArrow().sort_by("place")
    x = _matrix(drawn["vector"].combine_chunks())
    k = int(max(1, min(p.max_cells, len(x), p.cells * total**0.5)))
    centroids = x[np.sort(np.random.default_rng(p.seed).choice(len(x), k, replace=False))] if len(x) else np.zeros((1, 1))
    for _ in range(p.rounds if k > 1 else 0):
        cell = np.concatenate([_near_cells(x[i : i + 8192], centroids, 1)[:, 0] for i in range(0, len(x), 8192)])
        held = np.bincount(cell, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        centroids = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centroids)
    return centroids


def _in_cells(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """(cell, turn, off, id, vector): every row in each of its `probes` nearest cells, the nearest at turn 0; off is its
    distance from the cell's centroid."""
    shipped = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            near = _near_cells(x, shipped.value, probes)
            off = np.stack([np.sqrt(((x - shipped.value[cells]) ** 2).sum(axis=1)) for cells in near.T], axis=1)
            which = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
            turn = np.tile(np.arange(near.shape[1]), batch.num_rows)
            made = [pa.array(near.ravel().astype(np.int64)), pa.array(turn.astype(np.int32)), pa.array(off.ravel())]
            yield pa.RecordBatch.from_arrays([*made, batch.column(0).take(which), batch.column(1).take(which)], names=["cell", "turn", "off", "id", "vector"])

    return rows.mapInArrow(run, f"cell long, turn int, off double, id {rows.schema['id'].dataType.simpleString()}, vector {rows.schema['vector'].dataType.simpleString()}")


def _best(k: int):
    """Of a block of rows and one of queries (with a bound on the distance), the k best rows of every query. A product of
    matrices finds all pairs that may be among them; their distances are then taken from the differences."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": right["id"][:0], "id": left["id"][:0], "distance": np.zeros(0)})]
        if len(left) and len(right):
            x, ids = np.stack(left["vector"].to_numpy()).astype(np.float64), left["id"].to_numpy()
            asked, bound, vectors = right["id"].to_numpy(), right["bound"].to_numpy(), right["vector"].to_numpy()
            size, code, places = (x * x).sum(axis=1), np.unique(ids, return_inverse=True)[1], {}
            for i, name in enumerate(ids):
                places.setdefault(name, []).append(i)
            least, step = min(k, len(x)) - 1, max(1, (1 << 19) // len(x))
            for at in range(0, len(asked), step):
                q, most = np.stack(vectors[at : at + step]).astype(np.float64), bound[at : at + step]
                weight = (q * q).sum(axis=1)
                rough = size[None, :] - 2.0 * (q @ x.T) + weight[:, None]
                for i, name in enumerate(asked[at : at + step]):
                    if name in places:
                        rough[i, places[name]] = np.inf
                cap, free = most.copy(), np.isinf(most)
                if free.any():
                    cap[free] = np.partition(rough[free], least, axis=1)[:, least]
                cap += 1e-9 * (size.max() + weight) + 1e-11  # rounding of the product and of the distances
                r, c = np.nonzero((rough <= cap[:, None]) & np.isfinite(rough))
                d = np.empty(len(r))
                for i in range(0, len(r), 1 << 16):
                    apart = x[c[i : i + (1 << 16)]] - q[r[i : i + (1 << 16)]]
                    d[i : i + (1 << 16)] = np.round(np.einsum("ij,ij->i", apart, apart), 12)
                order = np.lexsort((code[c], d, r))
                order = order[d[order] <= most[r[order]]]
                place = np.arange(len(order)) - np.searchsorted(r[order], r[order])
                order = order[place < k]
                out.append(pd.DataFrame({"query": asked[at + r[order]], "id": ids[c[order]], "distance": d[order]}))
        return pd.concat(out) if len(out) > 1 else out[0]

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int, id_type: str = "long", index: Index | None = None, block_rows: int = 8192) -> DataFrame:
    """(query, rank, id, distance): k nearest by squared Euclidean distance; a query's own id is left out.

    rows and queries have (id, vector). Without an index every query meets all rows, and the result is exact; with one
    it meets the rows of its nearest cells only. Cells, and the queries that look into one, are dealt into blocks of
    bounded size: every pair of blocks is a task's work of its own, keeps its best k per query, and the winners are merged.

    With an index the nearest cell comes first. Its k-th distance bounds what other cells may add: those too far off for
    any such row are left out, and of the others only rows within the bound are kept. The result stays the same.
    """
    rows, queries = rows.select("id", "vector").filter("id is not null and vector is not null"), queries.select("id", "vector").filter("id is not null and vector is not null")
    total = rows.count()
    size = index.block_rows if index else block_rows
    keys = ["cell", "row_blocks", "query_blocks"]
    dealt = lambda own, other: [
        "cell", F.pmod(F.xxhash64("id"), F.col(own)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other), "id", "vector",
    ]

    def meet(placed: DataFrame, asked: DataFrame) -> DataFrame:
        left, right = placed.select(*dealt("row_blocks", "query_blocks")), asked.select(*dealt("query_blocks", "row_blocks"), "bound")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_best(k), f"query {id_type}, id {id_type}, distance double")

    def ranked(won: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
        return won.select("query", "id", "distance").withColumn("rank", rank).filter(F.col("rank") <= k)

    endless = F.lit(float("inf"))
    if not (index and total):
        whole = {"cell": F.lit(0).cast("long"), "row_blocks": F.lit(max(1, -(-total // size))).cast("long"), "query_blocks": F.lit(max(1, -(-queries.count() // size))).cast("long")}
        return ranked(meet(rows.withColumns(whole), queries.withColumns(whole).withColumn("bound", endless)))

    centroids = fit_centroids(rows, total, index)
    placed, asked = _in_cells(rows, centroids, 1), _in_cells(queries, centroids, index.probes)
    blocks = lambda name: F.ceil(F.count("*") / size).cast("long").alias(name)
    cells = cut(placed.groupBy("cell").agg(blocks("row_blocks"), F.max("off").alias("radius")))  # a row for each cell

    def probed(asked: DataFrame) -> DataFrame:
        asked = asked.join(cells.select("cell", "row_blocks"), "cell")
        plan = cut(asked.groupBy("cell").agg(blocks("query_blocks")).join(cells.select("cell", "row_blocks"), "cell"))
        return meet(placed.join(plan, "cell"), asked.drop("row_blocks").join(plan, "cell"))

    spark, path = rows.sparkSession, new_path(rows.sparkSession, "nearest")
    ranked(probed(asked.filter("turn = 0").withColumn("bound", endless))).write.parquet(path)
    first = spark.read.parquet(path)
    bounds = first.filter(F.col("rank") == k).select(F.col("query").alias("id"), F.col("distance").alias("bound"))
    rest = asked.filter("turn > 0").join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", endless)).join(cells.select("cell", "radius"), "cell")
    gap = F.greatest(F.lit(0.0), F.col("off") - F.col("radius") - (F.col("off") + F.col("radius")) * 1e-9)
    rest = rest.filter(gap * gap <= F.col("bound") + 1e-11).drop("radius")
    return ranked(first.select("query", "id", "distance").unionByName(probed(rest)))


def anomaly_scores(rows: DataFrame, k: int = 20, id_type: str = "long", index: Index | None = None) -> DataFrame:
    """(id, anomaly_score): mean distance to the k nearest others, exact or by an index."""
    found = nearest(rows, rows, k, id_type, index)
    return found.groupBy(F.col("query").alias("id")).agg(F.avg("distance").alias("anomaly_score"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """How much of an exact result of nearest() another one has: queries, neighbours, found, recall."""
    both = exact.select("query", "id").join(found.select("query", "id").withColumn("_hit", F.lit(1)), ["query", "id"], "left")
    out = both.agg(F.countDistinct("query").alias("queries"), F.count("*").alias("neighbours"), F.count("_hit").alias("found"))
    return out.withColumn("recall", F.try_divide(F.col("found"), F.col("neighbours")))


def labelled(made: DataFrame, daily: DataFrame) -> DataFrame:
    """Vectors with the answer key, for scoring only: id (user|date), its parts, vector, is_attack. Unknown days are no attack."""
    days = daily.select(*DAY, "is_redteam_day")
    return made.join(days, DAY, "left").select(
        F.concat_ws("|", F.col("src_user"), F.col("event_date").cast("string")).alias("id"), *DAY, "vector", F.coalesce("is_redteam_day", F.lit(False)).alias("is_attack")
    )


def payload(rows: DataFrame, scores: DataFrame, keep_one_in: int = 64) -> DataFrame:
    """Vectors with their anomaly score: every attack, and a stable sample of the others."""
    sampled = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long") % keep_one_in == 0
    return rows.filter(F.col("is_attack") | sampled).join(scores, "id")


def at_budgets(scores: DataFrame, budgets: DataFrame, parts: int = 64) -> DataFrame:
    """A ranking scored at the alerts that other detectors spent. scores: (id, anomaly_score, is_attack), budgets:
    (detector, alerts), a handful; a budget that covers all rows is no budget and is skipped.

    Ranks are places inside range partitions plus the rows of the partitions before, so no task orders the whole table.
    """
    ordered = scores.select(F.round("anomaly_score", 9).alias("score"), "id", F.col("is_attack").cast("int").alias("attack"))
    ordered = cut(ordered.repartitionByRange(parts, F.desc("score"), F.asc("id")).withColumn("part", F.spark_partition_id()))
    sums = ordered.groupBy("part").agg(F.count("*").alias("rows"), F.sum("attack").alias("attacks"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sums = sums.withColumn("rows_before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    ranked = ordered.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("score"), "id")))
    ranked = ranked.filter("attack = 1").join(F.broadcast(sums.select("part", "rows_before")), "part").select((F.col("rows_before") + F.col("place")).alias("rank"))
    totals = sums.agg(F.sum("rows").alias("n"), F.sum("attacks").alias("attacks"))
    spent = budgets.crossJoin(F.broadcast(totals)).filter("alerts < n")
    hits = ranked.join(F.broadcast(spent), F.col("rank") <= F.col("alerts")).groupBy("detector").agg(F.count("*").alias("caught"))
    hits = spent.join(hits, "detector", "left").fillna(0, ["caught"])
    return hits.select(
        "detector", "alerts", "caught", (F.col("attacks") - F.col("caught")).alias("missed"), F.round(100.0 * F.col("caught") / F.nullif("attacks", F.lit(0)), 1).alias("recall_pct"),
        F.round(100.0 * F.col("caught") / F.col("alerts"), 3).alias("precision_pct"),
    )


def retrieval(rows: DataFrame, k: int = 10, id_type: str = "long", index: Index | None = None) -> DataFrame:
    """Leave-one-out retrieval: of each attack row's k nearest others, how many are attacks too. rows: (id, vector, is_attack)."""
    attacks = rows.filter("is_attack")
    found = nearest(rows, attacks, k, id_type, index).join(rows.select("id", "is_attack"), "id")
    hits = found.groupBy("query").agg(F.count_if("is_attack").alias("hits"))
    base = rows.agg(F.avg(F.col("is_attack").cast("int")).alias("base"))
    return hits.agg(F.count("*").alias("queries"), F.avg("hits").alias("mean_hits"), F.count_if(F.col("hits") > 0).alias("with_a_hit"), F.count_if(F.col("hits") == 0).alias("without")).crossJoin(F.broadcast(base)).select(
        "queries", F.round("mean_hits", 2).alias("mean_hits"), F.round(100 * F.col("mean_hits") / k, 2).alias("precision_at_k_pct"), "with_a_hit", "without",
        F.round(100 * F.col("base"), 4).alias("base_rate_pct"), F.round(F.try_divide(F.col("mean_hits") / k, F.col("base")), 1).alias("lift_over_random"),
    )


def lookalikes(rows: DataFrame, probe: int, k: int = 10) -> DataFrame:
    """The k rows with the largest cosine to one row, itself left out."""
    one = rows.filter(F.col("id") == probe).limit(1).select(F.col("vector").alias("_probe"))
    return rows.filter(F.col("id") != probe).crossJoin(F.broadcast(one)).select("id", X.cosine(F.col("vector"), F.col("_probe")).alias("similarity")).orderBy(F.desc(F.round("similarity", 9)), "id").limit(k)

