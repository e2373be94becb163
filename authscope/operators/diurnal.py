"""Hour histogram and the off-hours band that it supports."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How near the quietest hour an hour must be, and the least ratio of busiest to quietest.
NEAR_MINIMUM, LEAST_RATIO = 0.15, 1.5


def hour_histogram(events: DataFrame) -> DataFrame:
    machine = F.coalesce("src_is_machine", F.lit(False))
    return events.groupBy("hour_of_day").agg(
        F.count("*").alias("events"), F.count_if(~machine).alias("human_events"), F.count_if(machine).alias("machine_events"),
        F.count_if(F.coalesce("is_failure", F.lit(False))).alias("failures"), F.countDistinct("src_user").alias("identities"),
    )


def off_hours_band(counts: dict[int, int], near: float = NEAR_MINIMUM) -> list[int]:
    """Hours of the longest quiet run around the clock; none without a diurnal cycle, ties go to the first start."""
    volume = [counts.get(h, 0) for h in range(24)]
    low, high = min(volume), max(volume)
    if not high or high < LEAST_RATIO * low:
        return []
    quiet = [v <= low * (1 + near) for v in volume]
    if all(quiet):
        return list(range(24))
    first = quiet.index(False)  # a noisy hour: no run goes round this end
    runs = [[h % 24 for h in hours] for is_quiet, hours in groupby(range(first, first + 24), key=lambda h: quiet[h % 24]) if is_quiet]
    longest = max(map(len, runs), default=0)
    return sorted(min((r for r in runs if len(r) == longest), key=lambda r: r[0], default=[]))


def band_of(events: DataFrame, column: str = "human_events") -> list[int]:
    """The band of events; the driver gets 24 rows."""
    return off_hours_band({r["hour_of_day"]: r[column] for r in hour_histogram(events).select("hour_of_day", column).collect()})
