"""Writers: partitioned Parquet, extracts, CSV and JSON results."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_date(df: DataFrame, path: str, files: int | None = None) -> int:
    """Overwrite a date-partitioned table; its rows as they are counted on disk. Dates are dealt to `files` tasks, or by
    default rebalanced by their measured size, so that a large date is split and small ones share a task."""
    (df.repartition(files, "event_date") if files else df.hint("rebalance", "event_date")).write.mode("overwrite").partitionBy("event_date").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def write_plain(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def run_only(df: DataFrame) -> None:
    """Run the whole plan and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def write_extract(df: DataFrame, path: str, columns: list[str], rows_per_file: int = 100_000) -> None:
    """Chosen columns, doubles as floats, zstd."""
    slim = df.select(*[F.col(c).cast("float").alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in columns])
    slim.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_csv(df: DataFrame, path: str, max_rows: int = 100) -> None:
    df.limit(max_rows).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def json_text(**metrics) -> str:
    return json.dumps(metrics, indent=2, default=str, sort_keys=True)


def replay(events: DataFrame, limit: int) -> Iterator[tuple[str, str]]:
    """(user, JSON message) in order of time; the driver holds one partition at a time."""
    ordered = events.filter("src_user is not null").orderBy("time").limit(limit)
    for row in ordered.select("src_user", F.to_json(F.struct("*")).alias("message")).toLocalIterator():
        yield row["src_user"], row["message"]


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], path: str) -> None:
    """Rows of new take the place of old rows with the same keys; equal inputs leave equal tables."""
    rest = new if old is None else new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))
    rest.dropDuplicates(keys).write.mode("overwrite").parquet(path)
