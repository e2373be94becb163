"""Detector queries over the daily mart, their evaluation, and ad-hoc SQL."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from authscope.sources.sinks import json_text, write_csv


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the published detectors; every query takes its own. `digits` rounds z-scores before they are
    compared, so that engines agree at a boundary; None compares them as they are."""

    z: float = 3.0
    failures: int = 5
    volume: int = 10
    history: int = 3
    usual: float = 0.05
    unusual: float = 0.25
    new_paths: int = 5
    top: int = 25
    peaks: int = 20
    digits: int | None = None

    def score(self, name: str) -> Column:
        return F.col(name) if self.digits is None else F.round(name, self.digits)


def _human(mart: DataFrame, who: DataFrame) -> DataFrame:
    return mart.join(who.filter(~F.col("is_machine_account")).select("identity_key"), "identity_key")


def weekly_fanout(mart: DataFrame, who: DataFrame, days: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Q1: human identities whose peak daily fan-out grew most since the previous week they were present."""
    weekly = _human(mart, who).join(days.select("time_key", "week_index"), "time_key").groupBy("identity_key", F.col("src_user").alias("identity"), "week_index").agg(
        F.max("distinct_dst_computers").alias("peak_daily_fanout"), F.sum("new_dst_computers").alias("new_destinations"),
        F.sum("auth_count").alias("auth_events"), F.bool_or("is_redteam_day").alias("had_redteam_activity"),
    )
    before = F.lag("peak_daily_fanout").over(Window.partitionBy("identity_key").orderBy("week_index"))
    grown = weekly.withColumn("prev_week_peak_fanout", before).filter("prev_week_peak_fanout > 0 and peak_daily_fanout > prev_week_peak_fanout")
    out = grown.withColumns({
        "fanout_delta": F.col("peak_daily_fanout") - F.col("prev_week_peak_fanout"),
        "fanout_multiple": F.round(F.col("peak_daily_fanout") / F.nullif(F.col("prev_week_peak_fanout"), F.lit(0)), 2),
    }).drop("identity_key")
    return out.orderBy(F.desc("fanout_delta"), F.desc("fanout_multiple"), "identity", "week_index").limit(t.top)


def _off_hours(t: Thresholds) -> Column:
    return (
        (F.col("baseline_days_available") >= t.history) & (F.col("off_hours_share_baseline_mean") < t.usual)
        & (F.col("off_hours_share") > t.unusual) & (F.col("auth_count") >= t.volume)
    )


def off_hours(mart: DataFrame, who: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Q2: human identities that work in the measured quiet band today and hardly ever did."""
    today, usual = F.col("off_hours_share"), F.col("off_hours_share_baseline_mean")
    found = _human(mart, who).filter(_off_hours(t) & (today > 0)).select(
        F.col("src_user").alias("identity"), "event_date", "auth_count", "off_hours_events", F.round(today, 4).alias("off_hours_share_today"),
        F.round(F.round(usual, 9), 4).alias("off_hours_share_baseline"), F.round(F.round(today - usual, 9), 4).alias("excess_over_own_baseline"), "baseline_days_available", "is_redteam_day",
    )
    return found.orderBy(F.desc("excess_over_own_baseline"), F.desc("off_hours_events"), "identity", "event_date").limit(t.top)


def new_paths(mart: DataFrame, who: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Q3: first-time edges per day over the network, and the human identities with most of them in a day."""
    attack = F.col("is_redteam_day").cast("int")
    network = mart.groupBy("event_date").agg(
        F.sum("new_dst_computers").alias("new_edges"), F.sum("distinct_dst_computers").alias("total_edges_touched"),
        F.countDistinct("identity_key").alias("active_identities"), F.sum(attack).alias("redteam_identities_active"),
    )
    peaks = _human(mart, who).filter("new_dst_computers > 0").orderBy(F.desc("new_dst_computers"), "src_user", "event_date").limit(t.peaks)
    columns = ["new_edges", "total_edges_touched", "active_identities", "redteam_identities_active"]
    one = peaks.select(
        F.lit("IDENTITY").alias("scope"), F.col("event_date").cast("string").alias("event_date"), F.col("src_user").alias("identity"), F.col("new_dst_computers").alias("new_edges"),
        F.col("distinct_dst_computers").alias("total_edges_touched"), F.lit(1).cast("long").alias("active_identities"), attack.cast("long").alias("redteam_identities_active"),
    )
    every = network.select(F.lit("NETWORK").alias("scope"), F.col("event_date").cast("string").alias("event_date"), F.lit(None).cast("string").alias("identity"), *columns)
    return every.unionByName(one).orderBy("scope", F.desc("new_edges"), "event_date", "identity")


def failure_spikes(mart: DataFrame, who: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Q4: failure ratios far above the identity's own history, machine accounts included."""
    z = t.score("failure_ratio_zscore")
    found = mart.join(who.select("identity_key", "is_machine_account"), "identity_key").filter((z > t.z) & (F.col("failure_count") >= t.failures))
    return found.orderBy(z.desc(), F.desc("failure_count"), "src_user", "event_date").limit(t.top).select(
        F.col("src_user").alias("identity"), "event_date", "auth_count", "failure_count", F.round("failure_ratio", 4).alias("failure_ratio_today"),
        F.round("failure_ratio_baseline_mean", 4).alias("failure_ratio_baseline"), F.round("failure_ratio_baseline_stddev", 4).alias("baseline_stddev"),
        F.round("failure_ratio_zscore", 2).alias("failure_zscore"), "baseline_days_available", "distinct_dst_computers", "is_redteam_day", "is_machine_account",
    )


#: Names of the evaluation's rows, in order of the flags below.
DETECTORS = (
    "Q1 fan-out spike (z>3 vs own baseline)", "Q2 off-hours vs own baseline", "Q3 new access paths (>=5 new hosts/day)",
    "Q4 failure-ratio spike (z>3)", "ANY of Q1-Q4", "TWO OR MORE of Q1-Q4",
)


def evaluation(mart: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Q5: recall, precision, alerts and lift of every detector: one aggregate over one scan, then unpivoted."""
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    flags = [
        yes(t.score("fanout_zscore") > t.z), yes(_off_hours(t)), yes(F.col("new_dst_computers") >= t.new_paths),
        yes((t.score("failure_ratio_zscore") > t.z) & (F.col("failure_count") >= t.failures)),
    ]
    scored = mart.select(F.col("is_redteam_day").cast("int").alias("attack"), *[f.alias(f"f{i}") for i, f in enumerate(flags)])
    raised = sum((F.col(f"f{i}") for i in range(1, 4)), F.col("f0"))
    scored = scored.withColumns({"f4": (raised >= 1).cast("int"), "f5": (raised >= 2).cast("int")})
    sums = [F.sum(f"f{i}").alias(f"a{i}") for i in range(6)] + [F.sum(F.col(f"f{i}") * F.col("attack")).alias(f"t{i}") for i in range(6)]
    one = scored.agg(F.count("*").alias("days"), F.sum("attack").alias("attacks"), *sums)
    branches = ", ".join(f"'{name}', a{i}, t{i}" for i, name in enumerate(DETECTORS))
    long = one.selectExpr("days", "attacks", f"stack(6, {branches}) as (detector, alerts, hits)")
    hits, alerts, attacks, days = F.col("hits"), F.nullif(F.col("alerts"), F.lit(0)), F.nullif(F.col("attacks"), F.lit(0)), F.nullif(F.col("days"), F.lit(0))
    return long.select(
        "detector", F.col("attacks").alias("redteam_days_total"), hits.alias("redteam_days_caught"), (F.col("attacks") - hits).alias("redteam_days_missed"),
        F.round(F.lit(100.0) * hits / attacks, 1).alias("recall_pct"), F.col("alerts").alias("alerts_raised"), F.round(F.lit(100.0) * hits / alerts, 3).alias("precision_pct"),
        F.col("days").alias("identity_days_scanned"), F.round((hits / alerts) / (F.col("attacks") / days), 1).alias("lift_over_random"),
    ).orderBy(F.desc_nulls_last("recall_pct"), F.desc_nulls_last("precision_pct"), "detector")


_PLACE = re.compile(r"\{\{\s*(\w+)\s*\}\}")


def render(sql: str, **tables: DataFrame) -> tuple[str, dict[str, DataFrame]]:
    """A query with {{NAME}} placeholders as SQL with frame references; a name without a table is a KeyError."""
    used: dict[str, DataFrame] = {}

    def put(found: re.Match) -> str:
        used[found[1].lower()] = {k.lower(): v for k, v in tables.items()}[found[1].lower()]
        return "{" + found[1].lower() + "}"

    return _PLACE.sub(put, sql), used


def title(sql: str) -> str:
    """The query's leading comment."""
    first = sql.lstrip().splitlines()[0] if sql.strip() else ""
    return first.removeprefix("--").strip() if first.startswith("--") else ""


def ad_hoc(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    text, used = render(sql, **tables)
    return spark.sql(text, **used)


def run_queries(spark: SparkSession, queries: dict[str, str], folder: str, max_rows: int = 100, **tables: DataFrame) -> str:
    """Run SQL queries, write each result as CSV, and return a JSON summary with titles, rows and seconds."""
    summary = []
    for name, sql in queries.items():
        began = time.monotonic()
        result = ad_hoc(spark, sql, **tables)
        write_csv(result, f"{folder}/{name}", max_rows)
        summary.append({"query": name, "title": title(sql), "rows": spark.read.option("header", True).csv(f"{folder}/{name}").count(), "seconds": round(time.monotonic() - began, 3)})
    return json_text(queries=summary)


#: Fixed values of the published presets, and lower ones that fire on small tables. `digits` rounds z-scores, see Thresholds.
PRESET_VALUES = {"volume": 10, "history": 3, "usual": 0.05, "unusual": 0.25, "z": 3, "failures": 5, "new_paths": 5, "top": 25, "digits": 9}
LOW_PRESET_VALUES = PRESET_VALUES | {"volume": 2, "usual": 0.2, "z": 2, "failures": 1}

#: Exploration presets: SQL templates over the mart and dimensions as they are published; [name] stands for a value.
PRESET_TEMPLATES = {
    "preset_fanout": """-- Growth of the weekly peak fan-out
with peaks as (
  select m.src_user as identity, d.week_index, max(m.distinct_dst_computers) as peak_fanout, cast(sum(m.new_dst_computers) as bigint) as new_destinations,
    bool_or(m.is_redteam_day) as had_redteam
  from {{mart}} m join {{days}} d on m.event_date = d.calendar_date join {{who}} w on m.src_user = w.identity_name
  where not w.is_machine_account group by m.src_user, d.week_index),
moved as (select *, lag(peak_fanout) over (partition by identity order by week_index) as prev_week from peaks)
select identity, week_index, prev_week, peak_fanout, peak_fanout - prev_week as delta, new_destinations, had_redteam
from moved where peak_fanout > prev_week order by delta desc, identity, week_index limit [top]""",
    "preset_off_hours": """-- Off-hours share against the own baseline
select m.src_user as identity, m.event_date, m.auth_count, m.off_hours_events, round(m.off_hours_share, 4) as off_hours_today,
  round(round(m.off_hours_share_baseline_mean, [digits]), 4) as their_baseline,
  round(round(m.off_hours_share - m.off_hours_share_baseline_mean, [digits]), 4) as excess, m.is_redteam_day
from {{mart}} m join {{who}} w on m.src_user = w.identity_name
where not w.is_machine_account and m.auth_count >= [volume] and m.baseline_days_available >= [history]
  and m.off_hours_share_baseline_mean < [usual] and m.off_hours_share > [unusual]
order by excess desc, identity, event_date limit [top]""",
    "preset_new_paths": """-- First-time edges per day
select event_date, cast(sum(new_dst_computers) as bigint) as new_edges, count(distinct src_user) as active_identities,
  cast(sum(case when is_redteam_day then 1 else 0 end) as bigint) as redteam_identities_active
from {{mart}} group by event_date order by event_date""",
    "preset_failures": """-- Failure spikes against the own history
select src_user as identity, event_date, auth_count, failure_count, round(failure_ratio, 4) as failure_ratio_today,
  round(failure_ratio_zscore, 2) as z_score, baseline_days_available, is_redteam_day
from {{mart}} where round(failure_ratio_zscore, [digits]) > [z] and failure_count >= [failures]
order by round(failure_ratio_zscore, [digits]) desc, identity, event_date limit [top]""",
    "preset_detectors": """-- The four signals and any of them, scored against the answer key
with signals as (
  select case when is_redteam_day then 1 else 0 end as attack,
    case when round(fanout_zscore, [digits]) > [z] then 1 else 0 end as fanout,
    case when baseline_days_available >= [history] and off_hours_share_baseline_mean < [usual] and off_hours_share > [unusual]
      and auth_count >= [volume] then 1 else 0 end as off_hours,
    case when new_dst_computers >= [new_paths] then 1 else 0 end as paths,
    case when round(failure_ratio_zscore, [digits]) > [z] and failure_count >= [failures] then 1 else 0 end as failures
  from {{mart}}),
totals as (
  select cast(count(*) as double) as days, sum(attack) as attacks,
    sum(fanout) as a1, sum(fanout * attack) as c1, sum(off_hours) as a2, sum(off_hours * attack) as c2, sum(paths) as a3, sum(paths * attack) as c3,
    sum(failures) as a4, sum(failures * attack) as c4, sum(greatest(fanout, off_hours, paths, failures)) as a5,
    sum(greatest(fanout, off_hours, paths, failures) * attack) as c5
  from signals),
scored as (
  select 'Q1 fan-out spike' as detector, a1 as alerts, c1 as caught, attacks, days from totals
  union all select 'Q2 off-hours', a2, c2, attacks, days from totals
  union all select 'Q3 new access paths', a3, c3, attacks, days from totals
  union all select 'Q4 failure spike', a4, c4, attacks, days from totals
  union all select 'ANY of Q1-Q4', a5, c5, attacks, days from totals)
select detector, cast(attacks as bigint) as redteam_days, cast(caught as bigint) as caught, cast(attacks - caught as bigint) as missed,
  round(cast(100.0 as double) * caught / nullif(attacks, 0), 1) as recall_pct, cast(alerts as bigint) as alerts_to_triage,
  round(cast(100.0 as double) * caught / nullif(alerts, 0), 3) as precision_pct,
  round(cast(caught as double) / nullif(alerts, 0) / nullif(attacks / days, 0), 1) as lift_over_random
from scored order by recall_pct desc nulls last, detector""",
}


def _filled(template: str, values: dict) -> str:
    return re.sub(r"\[(\w+)\]", lambda m: str(values[m[1]]), template)


PRESETS = {name: _filled(t, PRESET_VALUES) for name, t in PRESET_TEMPLATES.items()}
#: The presets with thresholds, with low ones.
LOW_PRESETS = {f"{name}_low": _filled(PRESET_TEMPLATES[name], LOW_PRESET_VALUES) for name in ("preset_off_hours", "preset_failures", "preset_detectors")}


def weekly_suppliers(orders: DataFrame, lineitem: DataFrame, top: int = 25) -> DataFrame:
    """The weekly fan-out query on orders and line items: customers by distinct suppliers a week."""
    joined = orders.join(lineitem.select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    week = F.floor(F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) / F.lit(7)).cast("long")
    weekly = joined.groupBy("o_custkey", week.alias("week_index")).agg(F.countDistinct("l_suppkey").alias("suppliers"))
    before = F.lag("suppliers").over(Window.partitionBy("o_custkey").orderBy("week_index"))
    grown = weekly.withColumn("prev_suppliers", before).filter("suppliers > prev_suppliers").withColumn("delta", F.col("suppliers") - F.col("prev_suppliers"))
    return grown.orderBy(F.desc("delta"), "o_custkey", "week_index").limit(top)


def extract_sample(mart: DataFrame, keep_one_in: int = 64) -> DataFrame:
    """All labelled identity-days and a stable sample of the others."""
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("src_user"), F.col("event_date").cast("string"))), 1, 8), 16, 10).cast("long")
    return mart.filter((hashed % keep_one_in == 0) | F.col("is_redteam_day"))


def one_in(lines: DataFrame, n: int, seed: int = 0, column: str = "value") -> DataFrame:
    """A stable 1-in-n sample of lines."""
    return lines.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(n)) == 0)


