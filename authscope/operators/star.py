"""Star schema: staging, the fact view, dimensions and data checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authscope.functions import expressions as X
from authscope.sources.log import DEFAULT_BAND

ROLES = ("destination_only", "source_only", "server_like", "workstation_like")


def staged(events: DataFrame) -> DataFrame:
    return events.filter("src_user is not null")


def staged_labels(labels: DataFrame) -> DataFrame:
    identity = F.concat_ws("|", *[F.col(c).cast("string") for c in ("time", "user", "src_computer", "dst_computer")])
    return labels.withColumnRenamed("user", "src_user").withColumn("redteam_event_key", F.md5(identity))


def fact(events: DataFrame, labels: DataFrame, band: list[int] | None = None) -> DataFrame:
    """One row per event, natural keys, additive measures. Labels match on time, user, source and destination."""
    keys = ["time", "src_user", "src_computer", "dst_computer"]
    marked = labels.select("time", F.col("user").alias("src_user"), "src_computer", "dst_computer").distinct().withColumn("_hit", F.lit(True))
    rows = staged(events).join(marked, keys, "left")
    flag = lambda c: F.when(F.col(c), 1).otherwise(0)
    return rows.select(
        *keys, "event_date", "hour_of_day", "event_ts", "auth_type", "logon_type", "auth_orientation", F.lit(1).alias("event_count"),
        flag("is_success").alias("success_count"), flag("is_failure").alias("failure_count"),
        X.in_band(F.col("hour_of_day"), DEFAULT_BAND if band is None else band).alias("is_off_hours"), F.col("_hit").isNotNull().alias("is_redteam_event"),
    )


def dim_identity(events: DataFrame, labels: DataFrame) -> DataFrame:
    flag = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    made = staged(events).groupBy(F.col("src_user").alias("identity_name")).agg(
        F.min("src_user_name").alias("user_name"), F.min("src_domain").alias("domain"), F.bool_or("src_is_machine").alias("is_machine_account"),
        F.count("*").alias("total_auth_events"), flag("is_success").alias("total_success"), flag("is_failure").alias("total_failure"),
        F.countDistinct("dst_computer").alias("lifetime_distinct_destinations"), F.countDistinct("src_computer").alias("lifetime_distinct_sources"),
        F.countDistinct("event_date").alias("active_days"), F.min("event_date").alias("first_seen_date"), F.max("event_date").alias("last_seen_date"),
    )
    compromised = labels.select(F.col("user").alias("_who")).distinct()
    out = made.join(compromised, F.col("identity_name") == F.col("_who"), "left")
    return out.withColumns({
        "identity_key": X.key(F.col("identity_name")), "lifetime_failure_ratio": X.ratio(F.col("total_failure"), F.col("total_auth_events")),
        "is_compromised": F.col("_who").isNotNull(),
    }).drop("_who")


def dim_computer(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Both sides of every event in one pass: hosts are unpivoted, then aggregated once."""
    side = staged(events).select("src_user", F.explode(F.array(*[F.struct(F.col(c).alias("computer_name"), F.lit(s).alias("side")) for c, s in (("src_computer", "from"), ("dst_computer", "to"))])).alias("h"))
    made = side.select("src_user", "h.*").filter("computer_name is not null").groupBy("computer_name").agg(
        F.count_if(F.col("side") == "from").alias("events_as_source"), F.count_if(F.col("side") == "to").alias("events_as_destination"),
        F.countDistinct(F.when(F.col("side") == "from", F.col("src_user"))).alias("distinct_identities_from"),
        F.countDistinct(F.when(F.col("side") == "to", F.col("src_user"))).alias("distinct_identities_to"),
    )
    as_source, as_target = F.col("events_as_source"), F.col("events_as_destination")
    role = F.when(as_source == 0, ROLES[0]).when(as_target == 0, ROLES[1]).when(as_target > 10 * as_source, ROLES[2]).otherwise(ROLES[3])
    pivots, targets = (labels.select(F.col(c).alias(n)).filter(F.col(n).isNotNull()).distinct() for c, n in (("src_computer", "_pivot"), ("dst_computer", "_target")))
    out = made.join(pivots, F.col("computer_name") == F.col("_pivot"), "left").join(targets, F.col("computer_name") == F.col("_target"), "left")
    return out.withColumns({
        "computer_key": X.key(F.col("computer_name")), "total_events": as_source + as_target, "host_role": role,
        "is_redteam_pivot": F.col("_pivot").isNotNull(), "is_redteam_target": F.col("_target").isNotNull(),
    }).drop("_pivot", "_target")


def dim_time(events: DataFrame, labels: DataFrame, week_mode: str = "round") -> DataFrame:
    made = staged(events).groupBy("event_date", "day_index").agg(
        F.count("*").alias("auth_events"), F.countDistinct("src_user").alias("active_identities"), F.sum(F.when(F.col("is_failure"), 1).otherwise(0)).alias("failures")
    )
    days = labels.select(F.col("event_date").alias("_day")).distinct()
    out = made.join(days, F.col("event_date") == F.col("_day"), "left")
    return out.select(
        X.key(F.col("event_date")).alias("time_key"), F.col("event_date").alias("calendar_date"), "day_index", X.week_of(F.col("day_index"), week_mode).alias("week_index"),
        "auth_events", "active_identities", "failures", F.col("_day").isNotNull().alias("has_redteam_activity"),
    )


def streaming_mart(windows: DataFrame) -> DataFrame:
    """The stream sink, conformed to the star."""
    window_text = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")
    return windows.select(
        F.md5(F.concat_ws("|", "src_user", window_text)).alias("window_key"), X.key(F.col("src_user")).alias("identity_key"), X.key(F.col("event_date")).alias("time_key"),
        "src_user", "window_start", "window_end", "event_date", "auth_count", "success_count", "failure_count", X.ratio(F.col("failure_count"), F.col("auth_count")).alias("failure_ratio"),
        F.col("distinct_dst_computers").alias("distinct_dst_computers_approx"), F.col("distinct_src_computers").alias("distinct_src_computers_approx"),
    )


# data checks: each gives (check, violations); several over one table share its scan


def not_null(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = ", ".join(f"'not_null {table}.{c}', `{c}`" for c in columns)
    return counted.selectExpr(f"stack({len(columns)}, {rows}) as (check, violations)")


def unique(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    twice = df.groupBy(*keys).count().filter("count > 1")
    return twice.agg(F.count("*").alias("violations")).select(F.lit(f"unique {table}.{'+'.join(keys)}").alias("check"), "violations")


def references(child: DataFrame, column: str, parent: DataFrame, key: str, name: str) -> DataFrame:
    orphans = child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_anti")
    return orphans.agg(F.count("*").alias("violations")).select(F.lit(f"relationship {name}").alias("check"), "violations")


def accepted(df: DataFrame, table: str, column: str, values: list[str]) -> DataFrame:
    odd = df.filter(F.col(column).isNotNull() & ~F.col(column).isin(values))
    return odd.agg(F.count("*").alias("violations")).select(F.lit(f"accepted {table}.{column}").alias("check"), "violations")


def reconciled(facts: DataFrame, daily: DataFrame) -> DataFrame:
    """Days on which the fact's events and the rollup's differ; both sides keep days the other lacks."""
    a = facts.groupBy("event_date").agg(F.sum("event_count").alias("fact_events"))
    b = daily.groupBy("event_date").agg(F.sum("auth_count").alias("rollup_events"))
    both = a.join(b, "event_date", "full")
    return both.filter(~F.col("fact_events").eqNullSafe(F.col("rollup_events"))).withColumn("difference", F.col("fact_events") - F.col("rollup_events"))


def checks(events: DataFrame, labels: DataFrame, mart: DataFrame) -> DataFrame:
    """Every check of the star; a clean build has no violations."""
    facts, who, hosts, days = fact(events, labels), dim_identity(events, labels), dim_computer(events, labels), dim_time(events, labels)
    found = [
        not_null(facts, "fact", ["event_date", "src_user", "event_count", "success_count", "failure_count", "is_off_hours", "is_redteam_event"]),
        not_null(who, "dim_identity", ["identity_key", "identity_name", "is_machine_account", "is_compromised", "total_auth_events"]),
        not_null(hosts, "dim_computer", ["computer_key", "computer_name", "host_role", "is_redteam_pivot", "is_redteam_target"]),
        not_null(days, "dim_time", ["time_key", "calendar_date", "day_index", "week_index", "has_redteam_activity"]),
        not_null(mart, "mart", ["identity_key", "time_key", "event_date", "auth_count", "is_redteam_day", "distinct_dst_computers"]),
        unique(who, "dim_identity", ["identity_key"]), unique(hosts, "dim_computer", ["computer_key"]), unique(days, "dim_time", ["time_key"]),
        unique(who, "dim_identity", ["identity_name"]), unique(hosts, "dim_computer", ["computer_name"]), unique(days, "dim_time", ["calendar_date"]),
        unique(days, "dim_time", ["day_index"]), unique(mart, "mart", ["identity_key", "event_date"]),
        references(mart, "identity_key", who, "identity_key", "mart.identity_key"), references(mart, "time_key", days, "time_key", "mart.time_key"),
        references(facts, "src_user", who, "identity_name", "fact.src_user"), references(facts, "dst_computer", hosts, "computer_name", "fact.dst_computer"),
        references(facts, "src_computer", hosts, "computer_name", "fact.src_computer"), references(facts, "event_date", days, "calendar_date", "fact.event_date"),
        accepted(events, "staging", "outcome", ["Success", "Fail"]), accepted(hosts, "dim_computer", "host_role", list(ROLES)),
        reconciled(facts, mart).agg(F.count("*").alias("violations")).select(F.lit("rollup reconciles with fact").alias("check"), "violations"),
    ]
    return reduce(DataFrame.unionByName, found)
