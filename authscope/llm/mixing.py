"""Mixing sources to target weights along a time-varying curriculum.

Sources get shares of the token demand by weight, filled up to a ceiling of repeats. Each source has a weight
schedule over training time, linear between knots. Its integral, scaled to the source's target, is the
source's cumulative demand; inverting it at a document's place in the source's stream gives the time at which
training meets the document, and documents are range-sorted by that time. Places are prefix sums in hash
order, taken in two levels: over hash buckets of bounded size, then inside each, so that a source with a third
of all rows is spread over as many tasks as it has buckets. Equal rows share a hash; a bucket that they fill is
split once more by row identity. Sources are a table like any other: none is listed on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authscope.llm.common import ROW_ID, by_row, materialize, n_words, position, with_row_id

WEIGHTS = (5.0, 2.0, 1.0)
#: Training time, and for each place in WEIGHTS the schedule there: steady, rising, falling.
KNOTS = (0.0, 0.5, 1.0)
SCHEDULES = ((1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (1.5, 1.0, 0.5))
#: Rows of a bucket that is ordered in one task (expected; twice as many at most), and rows of a table that is broadcast.
BUCKET_ROWS, BROADCAST_ROWS = 4096, 50_000


def fill(sources: DataFrame, share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """sources (source_size, weight) with `target`: share of the sum of sizes by weight; what exceeds ceiling times a
    size goes to the others by weight, until none is above.

    Sources reach their ceiling in the order of ceiling * size / weight. Those up to the last one whose ratio is not
    above the level that is left for the rest are full; the others get weight times that level.
    """
    every, order = Window.partitionBy(), Window.orderBy("_ratio", "source_index")  # a row for each source
    most = F.lit(float(ceiling)) * F.col("source_size")
    out = sources.withColumn("_ratio", most / F.col("weight")).withColumns({
        "_demand": share * F.sum("source_size").over(every), "_rank": F.row_number().over(order),
        "_full": F.sum(most).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_open": F.sum("weight").over(order.rowsBetween(1, Window.unboundedFollowing)),
    })
    level = F.try_divide(F.col("_demand") - F.col("_full") + most, F.coalesce("_open", F.lit(0.0)) + F.col("weight"))  # if this one and those behind it were open
    first_open = F.min(F.when(level < F.col("_ratio"), F.col("_rank"))).over(every)
    out = out.withColumns({"_level": level, "_first": first_open})
    shared = F.max(F.when(F.col("_rank") == F.col("_first"), F.col("_level"))).over(every)
    target = F.when(F.col("_first").isNull() | (F.col("_rank") < F.col("_first")), most).otherwise(F.col("weight") * shared)
    return out.withColumn("target", target).drop("_ratio", "_demand", "_rank", "_full", "_open", "_level", "_first")


def _time(demand: Column) -> Column:
    """Training time at which a schedule (columns w0, w1, ...) has met `demand`, a share of its integral."""
    steps = [b - a for a, b in zip(KNOTS, KNOTS[1:], strict=False)]
    areas = [F.lit(h / 2) * (F.col(f"w{k}") + F.col(f"w{k + 1}")) for k, h in enumerate(steps)]
    total = sum(areas[1:], areas[0])
    out, before = None, total
    for k in reversed(range(len(steps))):
        before = before - areas[k]
        rest = F.greatest(demand * total - before, F.lit(0.0))
        w, slope = F.col(f"w{k}"), (F.col(f"w{k + 1}") - F.col(f"w{k}")) / steps[k]
        here = F.lit(KNOTS[k]) + F.coalesce(F.try_divide(2 * rest, w + F.sqrt(F.greatest(w * w + 2 * slope * rest, F.lit(0.0)))), F.lit(0.0))
        out = here if out is None else F.when(demand * total < before + areas[k], here).otherwise(out)
    return F.least(out, F.lit(KNOTS[-1]))


def _high(hashed: Column) -> Column:
    """The upper 31 bits, unsigned: what buckets are cut by."""
    return F.shiftrightunsigned(hashed, 33)


def _bucket(hashed: Column, buckets: Column) -> Column:
    return F.shiftright(_high(hashed) * buckets, 31)


def _sized(rows: DataFrame, row_id: tuple[str, ...]) -> DataFrame:
    """What decides about a row of (key, source, body): size, hash of key and text, a tie-break for equal rows."""
    hashed = F.xxhash64("key", F.coalesce("body", F.lit("")))
    return rows.select("key", "source", n_words(F.col("body")).alias("size"), hashed.alias("hash"), F.xxhash64(*row_id).alias("tie"), *row_id)


def _small(table: DataFrame) -> DataFrame:
    """A written table, broadcast if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _sources(sized: DataFrame, share: float, ceiling: float, schedules: dict[str, tuple[float, ...]] | None) -> DataFrame:
    """One row per source with its target, schedule and number of buckets."""
    spark = sized.sparkSession
    totals = sized.groupBy(F.col("source").alias("name")).agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    index = (F.row_number().over(Window.orderBy(F.col("name").asc_nulls_last())) - 1).cast("long")  # strings order by code point
    turn = F.pmod(F.col("source_index"), F.lit(len(WEIGHTS))).cast("int")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), turn)
    table = totals.withColumn("source_index", index).withColumn("weight", pick(WEIGHTS))
    knots = [f"w{k}" for k in range(len(KNOTS))]
    usual = {w: pick([s[k] for s in SCHEDULES]) for k, w in enumerate(knots)}
    own = spark.createDataFrame([(n, *map(float, s)) for n, s in (schedules or {}).items()], f"_own string, {', '.join(f'_{w} double' for w in knots)}")
    table = fill(table, share, ceiling).join(F.broadcast(own), F.col("name").cast("string") == F.col("_own"), "left")  # a caller's few
    table = table.withColumns({w: F.coalesce(F.col(f"_{w}"), c) for w, c in usual.items()}).drop("_own", *[f"_{w}" for w in knots])
    # of the stream that repeats the source, target words are taken: whole rounds, then a part of one more
    rounds = F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    table = table.withColumn("rounds", rounds).withColumn("extra", F.round("target").cast("long") - F.col("rounds") * F.col("source_size"))
    return materialize(table.withColumn("buckets", F.ceil(F.col("rows") / BUCKET_ROWS).cast("long")).drop("rows", "weight"), "sources")


def _placed(sized: DataFrame, share: float, ceiling: float, schedules: dict[str, tuple[float, ...]] | None) -> DataFrame:
    """sized with its source's row and `place`: the words of the source that come before the row."""
    named = sized.join(_small(_sources(sized, share, ceiling, schedules)), F.col("source").eqNullSafe(F.col("name")))
    named = named.withColumn("bucket", _bucket(F.col("hash"), F.col("buckets")))
    # a bucket that equal rows fill has several parts; all other buckets have one
    crowded = named.groupBy("source_index", "bucket").agg(F.ceil(F.count("*") / (2 * BUCKET_ROWS)).cast("long").alias("parts")).filter("parts > 1")
    crowded = _small(materialize(crowded, "crowded"))
    named = named.join(crowded, ["source_index", "bucket"], "left").withColumn("part", F.coalesce(F.pmod("tie", "parts"), F.lit(0)))
    sums = named.groupBy("source_index", "bucket", "part").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source_index").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    sums = materialize(sums.select("source_index", "bucket", "part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("before")), "before")
    inside = Window.partitionBy("source_index", "bucket", "part").orderBy("hash", "key", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return named.join(_small(sums), ["source_index", "bucket", "part"]).withColumn("place", place)


def _demand(place: Column) -> Column:
    return F.least(F.coalesce(F.try_divide(place, F.col("target")), F.lit(0.0)), F.lit(1.0))


def plan(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", share: float = 1.5, ceiling: float = 2.0, schedules: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """Per row of docs: key, size, source_size, target, copies, taken, position.

    taken: words that the mix takes; a source's last copy ends inside a document, where its target is met.
    position: training time of the first copy (null if none); a later copy is met when the stream comes round.
    schedules: weights at KNOTS of sources that don't follow the usual ones, by name.
    Null text: size 0. Null source: one source, ordered last. Null or repeated keys: rows of their own; equal rows
    may change places with each other. Empty table: empty result. Other columns are ignored, whatever they are called.
    """
    rows = with_row_id(docs, "mix")
    c = lambda name: F.col(f"c{position(docs, name)}")
    sized = materialize(_sized(rows.select(c(key).alias("key"), c(source).alias("source"), c(text).alias("body"), *ROW_ID), ROW_ID).drop(*ROW_ID), "sizes")
    placed = _placed(sized, share, ceiling, schedules)
    part = F.greatest(F.least(F.col("extra") - F.col("place"), F.col("size")), F.lit(0))
    copies = F.col("rounds").cast("int") + F.when(part > 0, 1).otherwise(0)
    return placed.select(
        "key", "size", "source_size", "target", copies.alias("copies"), (F.col("rounds") * F.col("size") + part).cast("long").alias("taken"),
        F.when(copies > 0, _time(_demand(F.col("place")))).alias("position"),
    ).toDF(key, "size", "source_size", "target", "copies", "taken", "position")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", share: float = 1.5, ceiling: float = 2.0, schedules: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """The training stream: docs' columns, each document as often as the mix takes it, range-sorted by training time.

    Places and times are those of plan(), met again by row identity. Documents are never cut: a source's last copy is
    whole if more than half of it is wanted. Edge rows are treated as in plan().
    """
    rows = with_row_id(docs, "mix")
    c = lambda name: F.col(f"c{position(docs, name)}")
    sized = materialize(_sized(rows.select(c(key).alias("key"), c(source).alias("source"), c(text).alias("body"), *ROW_ID), ROW_ID), "sizes")
    placed = _placed(sized, share, ceiling, schedules)
    wanted = F.col("size") > 2 * (F.col("place") + F.col("size") - F.col("extra"))
    copies = F.col("rounds").cast("int") + F.when(wanted, 1).otherwise(0)
    turns = placed.withColumn("copies", copies).filter("copies > 0").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    time = _time(_demand(F.col("place") + (F.col("turn") - 1) * F.col("source_size")))
    times = turns.select(*ROW_ID, F.struct(time.alias("time"), "hash", "turn", "tie").alias("at")).groupBy(*ROW_ID).agg(F.collect_list("at").alias("times"))
    own = [x for x in rows.columns if x not in ROW_ID]
    found = by_row(rows, materialize(times, "times", sized), "inner").select(*own, F.explode("times").alias("at"))
    return found.orderBy("at.time", "at.hash", "at.turn", "at.tie").select(*own).toDF(*docs.columns)
