"""The stored warehouse: lake, labels, daily mart and dimensions as Parquet, built once and queried often."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authscope.operators import rollup, star, vectors
from authscope.sources import log, sinks

#: Tables of the warehouse; those with a date are partitioned by it.
BY_DATE, WHOLE = ("lake", "daily", "mart", "vectors"), ("labels", "who", "hosts", "days")


@dataclass(frozen=True)
class Warehouse:
    """Stored tables. Planners know their sizes from the files, so that small sides are broadcast by measure."""

    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        return log.read_lake(self.spark, f"{self.folder}/{name}") if name in BY_DATE else self.spark.read.parquet(f"{self.folder}/{name}")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BY_DATE or name in WHOLE:
            return self.read(name)
        raise AttributeError(name)

    def register(self) -> None:
        """Every table as a temporary view for ad-hoc SQL."""
        log.register(self.spark, **{name: self.read(name) for name in (*BY_DATE, *WHOLE)})


def build(spark: SparkSession, events: DataFrame, labels: DataFrame, folder: str, band: list[int] | None = None) -> Warehouse:
    """Write every table under folder, each from stored ones before it; equal inputs overwrite with equal tables.

    events and labels are derived ones. Rows are dealt by date at write time; the engine splits large dates and joins small ones.
    """
    stored = Warehouse(spark, folder)
    sinks.write_by_date(events, f"{folder}/lake")
    sinks.write_plain(labels, f"{folder}/labels")
    sinks.write_by_date(rollup.rollup(stored.lake, stored.labels, band), f"{folder}/daily")
    sinks.write_by_date(rollup.baselines(stored.daily), f"{folder}/mart")
    for name, made in (("who", star.dim_identity), ("hosts", star.dim_computer), ("days", star.dim_time)):
        sinks.write_plain(made(stored.lake, stored.labels), f"{folder}/{name}")
    sinks.write_by_date(vectors.vectors(vectors.features(stored.lake, stored.daily)), f"{folder}/vectors")
    return stored


def attack_days(stored: Warehouse) -> DataFrame:
    """Identity-days with their vector and answer key, for scoring."""
    return vectors.labelled(stored.vectors.withColumn("event_date", F.col("event_date").cast("date")), stored.daily)
