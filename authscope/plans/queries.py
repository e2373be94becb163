"""Registered queries over the driver's tables, with the same results as SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authscope.operators import diurnal, graph, rollup, sessions, star, vectors
from authscope.plans import detectors, warehouse
from authscope.session import new_path, shared_dir
from authscope.sources import log
from authscope.streaming import windows

#: Thresholds as published, with z rounded so that engines agree, and low ones that fire on small tables.
PUBLISHED = detectors.Thresholds(digits=9)
LOW = replace(PUBLISHED, z=2.0, failures=1, volume=2, usual=0.2)
BAND = log.DEFAULT_BAND
#: The synthetic embeddings have no clusters to speak of, so a query looks into most cells.
EMBEDDED_INDEX = vectors.Index(probes=24)


_STORED: dict[str, dict[str, warehouse.Warehouse]] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """The star over the driver's events, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        raw = log.adapted(_read(spark, sf_dir, "events"))
        self.events = log.derive(raw)
        self.labels = log.derive_labels(log.labels_of(raw))

    @property
    def daily(self) -> DataFrame:
        return rollup.rollup(self.events, self.labels, BAND)

    @property
    def mart(self) -> DataFrame:
        return rollup.baselines(self.daily)

    @property
    def who(self) -> DataFrame:
        return star.dim_identity(self.events, self.labels)

    @property
    def days(self) -> DataFrame:
        return star.dim_time(self.events, self.labels)

    @property
    def stored(self) -> warehouse.Warehouse:
        """The warehouse over the same events, built once in a session and kept in the shared folder."""
        known = _STORED.setdefault(self.spark.sparkContext.applicationId, {})
        if self.sf_dir not in known:
            known[self.sf_dir] = warehouse.build(self.spark, self.events, self.labels, f"{shared_dir(self.spark)}/warehouse-{self.spark.sparkContext.applicationId}-{len(known)}", BAND)
        return known[self.sf_dir]

    @property
    def graph(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return graph.build(self.events, self.labels)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _embedded(t: Tables) -> DataFrame:
    return _read(t.spark, t.sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("label") == 3).alias("is_attack"))


def _pairs(t: Tables) -> DataFrame:
    """The six users with most labelled edges, each with those that follow among the first fourteen."""
    users, _, edges = t.graph
    names = [r["name"] for r in graph.top_attackers(users, edges, 14).collect()]
    return t.spark.createDataFrame(graph.path_pairs(names[:6], names[6:], 100), "src string, dst string")


def _starts(t: Tables) -> DataFrame:
    """Eight users with most labelled edges, and a control group."""
    users, _, edges = t.graph
    return graph.top_attackers(users, edges, 8).select("name").unionByName(graph.control_group(users, edges, skip=5).select("name"))


def _anomalies(t: Tables) -> DataFrame:
    scores = vectors.anomaly_scores(_embedded(t).select("id", "vector"), 20)
    return scores.select("id", F.round("anomaly_score", 5).alias("anomaly_score"))


def _budgets(t: Tables) -> DataFrame:
    rows = _embedded(t)
    scores = vectors.anomaly_scores(rows.select("id", "vector"), 20).join(rows.select("id", "is_attack"), "id")
    return vectors.at_budgets(scores, t.spark.createDataFrame([("a", 20), ("b", 100), ("all", 10**9)], "detector string, alerts long"))


def _stream(t: Tables) -> DataFrame:
    """The stream over all events, replayed from files of the shared folder, read back from its sink."""
    spark, path = t.spark, new_path(t.spark, "stream")
    t.events.select("time", "event_ts", *log.STRINGS, F.lit(0).cast("long").alias("produce_ts_ms")).filter("src_user is not null").write.parquet(f"{path}/in")
    stored = spark.read.parquet(f"{path}/in")
    query = windows.start(windows.windowed(spark.readStream.schema(stored.schema).parquet(f"{path}/in")), f"{path}/sink", f"{path}/lag", f"{path}/state")
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return windows.read_sink(spark, f"{path}/sink")


def _checks(t: Tables) -> DataFrame:
    return star.checks(t.events, t.labels, t.mart)


def _strategies(t: Tables) -> DataFrame:
    made = [rollup.fingerprint(rollup.rollup(t.events, t.labels, BAND, s, b)).withColumn("variant", F.lit(f"{s}, broadcast {b}")) for s in ("shared_grain", "naive") for b in (True, False)]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    same = out.agg((F.min("fingerprint") == F.max("fingerprint")).alias("agrees"))
    return out.select("variant", "rows").crossJoin(F.broadcast(same))  # one row


def _preset(name: str, t: Tables) -> DataFrame:
    return detectors.ad_hoc(t.spark, (detectors.PRESETS | detectors.LOW_PRESETS)[name], mart=t.mart, who=t.who, days=t.days)


def _paths(t: Tables) -> DataFrame:
    """Shortest paths with nodes and weights as text."""
    found = graph.shortest_paths(t.graph[2], _pairs(t))
    return found.withColumns({"path": F.array_join("path", ">"), "weights": F.array_join(F.transform("weights", lambda w: w.cast("string")), ">")})


def _unit(made: DataFrame) -> DataFrame:
    """Unit vectors with a column for each dimension."""
    wide = [(F.round(F.get("vector", F.lit(i)).cast("double"), 5) + 0.0).alias(n) for i, n in enumerate(vectors.feature_names())]
    return made.select("src_user", "event_date", *wide)


def _stored_budgets(t: Tables) -> DataFrame:
    """The vector chain over the stored warehouse: scores by the index, at the alerts of the stored detectors."""
    days = warehouse.attack_days(t.stored)
    scores = vectors.anomaly_scores(days, 20, "string", vectors.Index()).join(days.select("id", "is_attack"), "id")
    spent = detectors.evaluation(t.stored.mart, PUBLISHED).select("detector", F.col("alerts_raised").alias("alerts")).filter("alerts > 0")
    return vectors.at_budgets(scores, spent)


def _index_recall(t: Tables) -> DataFrame:
    """Recall of the index against all rows, for every row whose id is divisible by 20."""
    rows = _embedded(t).select("id", "vector")
    asked = rows.filter("id % 20 = 0")
    return vectors.recall(vectors.nearest(rows, asked, 20, index=EMBEDDED_INDEX), vectors.nearest(rows, asked, 20))


def _payload(t: Tables) -> DataFrame:
    rows = _embedded(t)
    return vectors.payload(rows, vectors.anomaly_scores(rows, 20)).select("id", "is_attack", F.round("anomaly_score", 5).alias("anomaly_score"))


_MART_COLUMNS = (
    "src_user, event_date, auth_count, success_count, failure_count, off_hours_events, distinct_dst_computers, distinct_src_computers, "
    "new_dst_computers, is_redteam_day, failure_ratio, off_hours_share"
).split(", ")

RECIPES: dict[str, Callable[[Tables], DataFrame]] = {
    "lake": lambda t: t.events,
    "labels_lake": lambda t: t.labels,
    "sessions": lambda t: sessions.sessions(t.events, 6 * 3600),
    "session_stats": lambda t: _rounded(sessions.session_stats(sessions.sessions(t.events, 6 * 3600))),
    "session_windows": lambda t: sessions.session_windows(t.events.filter("src_user is not null"), 6 * 3600),
    "hour_histogram": lambda t: diurnal.hour_histogram(t.events),
    "rollup": lambda t: _rounded(t.daily.select(*_MART_COLUMNS)),
    "rollup_naive": lambda t: _rounded(rollup.rollup(t.events, t.labels, BAND, "naive").select(*_MART_COLUMNS)),
    "rollup_window": lambda t: _rounded(rollup.rollup(t.events, t.labels, BAND, max_day=7).select(*_MART_COLUMNS)),
    "rollup_stats": lambda t: rollup.rollup_stats(t.daily),
    "daily_mart": lambda t: _rounded(t.mart),
    "fact": lambda t: star.fact(t.events, t.labels, BAND),
    "dim_identity": lambda t: _rounded(t.who),
    "dim_computer": lambda t: star.dim_computer(t.events, t.labels),
    "dim_time": lambda t: t.days,
    "data_checks": _checks,
    "strategy_fingerprints": _strategies,
    "q1_weekly_fanout": lambda t: detectors.weekly_fanout(t.mart, t.who, t.days, PUBLISHED),
    "q2_off_hours": lambda t: detectors.off_hours(t.mart, t.who, PUBLISHED),
    "q2_off_hours_low": lambda t: detectors.off_hours(t.mart, t.who, LOW),
    "q3_new_paths": lambda t: detectors.new_paths(t.mart, t.who, PUBLISHED),
    "q4_failure_spikes": lambda t: detectors.failure_spikes(t.mart, t.who, PUBLISHED),
    "q4_failure_spikes_low": lambda t: detectors.failure_spikes(t.mart, t.who, LOW),
    "q5_evaluation": lambda t: detectors.evaluation(t.mart, PUBLISHED),
    "q5_evaluation_low": lambda t: detectors.evaluation(t.mart, LOW),
    **{name: partial(_preset, name) for name in (*detectors.PRESETS, *detectors.LOW_PRESETS)},
    "stored_mart": lambda t: _rounded(t.stored.mart.select(*t.mart.columns)),
    "stored_q1_weekly_fanout": lambda t: detectors.weekly_fanout(t.stored.mart, t.stored.who, t.stored.days, PUBLISHED),
    "stored_q2_off_hours": lambda t: detectors.off_hours(t.stored.mart, t.stored.who, LOW),
    "stored_q3_new_paths": lambda t: detectors.new_paths(t.stored.mart, t.stored.who, PUBLISHED),
    "stored_q4_failure_spikes": lambda t: detectors.failure_spikes(t.stored.mart, t.stored.who, LOW),
    "stored_q5_evaluation": lambda t: detectors.evaluation(t.stored.mart, LOW),
    "stored_vector_labels": lambda t: warehouse.attack_days(t.stored).select("id", "src_user", "event_date", "is_attack", F.size("vector").alias("dimensions")),
    "stored_vector_budgets": _stored_budgets,
    "graph_users": lambda t: t.graph[0],
    "graph_computers": lambda t: t.graph[1],
    "graph_edges": lambda t: t.graph[2],
    "graph_window_edges": lambda t: graph.build(t.events, t.labels, 2, 9)[2],
    "graph_window_computers": lambda t: graph.build(t.events, t.labels, 2, 9)[1],
    "graph_subgraph_json": lambda t: graph.subgraph_json(*t.graph).select("part", "name"),
    "graph_counts": lambda t: graph.counts(*t.graph),
    "graph_shortest_paths": _paths,
    "graph_hop_histogram": lambda t: graph.hop_histogram(graph.shortest_paths(t.graph[2], _pairs(t))),
    "graph_blast_radius": lambda t: graph.blast_radius(t.graph[2], _starts(t)).withColumn("hop1_sample", F.array_join("hop1_sample", ",")),
    "graph_movement": lambda t: graph.movement(t.graph[0], t.graph[2]),
    "graph_attacker_footprint": lambda t: graph.attacker_footprint(t.graph[0], t.graph[2]),
    "graph_choke_points": lambda t: graph.choke_points(t.graph[1], t.graph[2]),
    "graph_top_attackers": lambda t: graph.top_attackers(t.graph[0], t.graph[2]),
    "graph_control_group": lambda t: graph.control_group(t.graph[0], t.graph[2], skip=5),
    "graph_attack_subgraph": lambda t: graph.attack_subgraph(t.graph[1], t.graph[2]),
    "vector_features": lambda t: _rounded(vectors.features(t.events, t.daily)),
    "vector_unit": lambda t: _unit(vectors.vectors(vectors.features(t.events, t.daily))),
    "vector_index_recall": _index_recall,
    "vector_payload": _payload,
    "vector_anomalies": _anomalies,
    "vector_budgets": _budgets,
    "vector_retrieval": lambda t: vectors.retrieval(_embedded(t), 10),
    "vector_lookalikes": lambda t: _rounded(vectors.lookalikes(_embedded(t), 0), 5),
    "extract_sample": lambda t: detectors.extract_sample(t.mart).select("src_user", "event_date", "is_redteam_day"),
    "streaming_windows": _stream,
    "streaming_mart": lambda t: star.streaming_mart(_stream(t)),
    "weekly_suppliers": lambda t: detectors.weekly_suppliers(_read(t.spark, t.sf_dir, "orders"), _read(t.spark, t.sf_dir, "lineitem")),
}

#: Columns that both engines give as text, so that results compare by value.
TIMES = {
    "event_date": "lake labels_lake sessions rollup rollup_naive rollup_window daily_mart stored_mart stored_vector_labels stored_q2_off_hours stored_q4_failure_spikes extract_sample streaming_mart preset_off_hours_low preset_failures_low fact q2_off_hours q2_off_hours_low q4_failure_spikes q4_failure_spikes_low vector_features preset_off_hours preset_new_paths preset_failures vector_unit streaming_windows",
    "event_ts": "lake fact",
    "first_date": "rollup_stats",
    "last_date": "rollup_stats",
    "first_seen_date": "dim_identity",
    "last_seen_date": "dim_identity",
    "calendar_date": "dim_time",
    "window_start": "streaming_windows streaming_mart",
    "window_end": "streaming_windows streaming_mart",
}


def _texts(name: str) -> list[str]:
    return [column for column, names in TIMES.items() if name in names.split()]


def _query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    made = RECIPES[name](Tables(spark, sf_dir))
    texts = _texts(name)
    return made.withColumns({c: F.col(c).cast("string") for c in texts}) if texts else made


QUERIES = {name: partial(_query, name) for name in RECIPES}


# The same in SQL, for an engine of its own.

_NULLED = ", ".join(f"nullif({c}, '?') as {c}" for c in log.STRINGS)
_CTES = {
    "raw": log.ADAPTER.format(secs="cast(floor(epoch(ts)) as bigint)", events="events"),
    "clean": f"select event_id, time, is_labelled, {_NULLED} from raw",
    "auth": """select *, cast(floor(time / 86400) as int) as day_index, cast(floor((time % 86400) / 3600) as int) as hour_of_day,
  date '2015-01-01' + cast(floor(time / 86400) as int) as event_date, timestamp '2015-01-01' + to_seconds(time) as event_ts,
  outcome = 'Success' as is_success, outcome = 'Fail' as is_failure, split_part(src_user, '@', 1) as src_user_name,
  split_part(src_user, '@', 2) as src_domain, regexp_matches(src_user, '\\$@') as src_is_machine from clean""".replace("\\\\", "\\"),
    "marks": "select time, src_user as \"user\", src_computer, dst_computer, day_index, event_date, hour_of_day from auth where is_labelled",
    "firsts": "select src_user, dst_computer, min(event_date) as event_date from auth where dst_computer is not null group by 1, 2",
    "fresh": "select src_user, event_date, count(*) as n from firsts group by 1, 2",
    "bare": """select src_user, event_date, count(*) as auth_count, sum(is_success::int)::bigint as success_count, sum(is_failure::int)::bigint as failure_count,
  sum((hour_of_day in (0, 1, 2, 3, 4, 5))::int)::bigint as off_hours_events, count(distinct dst_computer) as distinct_dst_computers,
  count(distinct src_computer) as distinct_src_computers from auth where src_user is not null group by 1, 2""",
    "daily": """select b.*, coalesce(f.n, 0) as new_dst_computers, exists (select 1 from marks m where m."user" = b.src_user and m.event_date = b.event_date) as is_redteam_day,
  failure_count::double / auth_count as failure_ratio, off_hours_events::double / auth_count as off_hours_share
  from bare b left join fresh f on b.src_user = f.src_user and b.event_date = f.event_date""",
    "base": """select *, avg(distinct_dst_computers) over w as fanout_baseline_mean, stddev_samp(distinct_dst_computers) over w as fanout_baseline_stddev,
  avg(failure_ratio) over w as failure_ratio_baseline_mean, stddev_samp(failure_ratio) over w as failure_ratio_baseline_stddev,
  avg(off_hours_share) over w as off_hours_share_baseline_mean, count(*) over w as baseline_days_available from daily
  window w as (partition by src_user order by event_date rows between 30 preceding and 1 preceding)""",
    "mart": """select *, md5(src_user) as identity_key, md5(cast(event_date as varchar)) as time_key,
  case when baseline_days_available >= 3 and fanout_baseline_stddev > 0 then (distinct_dst_computers - fanout_baseline_mean) / fanout_baseline_stddev end as fanout_zscore,
  case when baseline_days_available >= 3 and failure_ratio_baseline_stddev > 0 then (failure_ratio - failure_ratio_baseline_mean) / failure_ratio_baseline_stddev end as failure_ratio_zscore
  from base""",
    "who": """select md5(src_user) as identity_key, src_user as identity_name, min(src_user_name) as user_name, min(src_domain) as domain, bool_or(src_is_machine) as is_machine_account,
  count(*) as total_auth_events, sum((outcome = 'Success' and outcome is not null)::int)::bigint as total_success, sum((outcome = 'Fail' and outcome is not null)::int)::bigint as total_failure,
  count(distinct dst_computer) as lifetime_distinct_destinations, count(distinct src_computer) as lifetime_distinct_sources, count(distinct event_date) as active_days,
  min(event_date) as first_seen_date, max(event_date) as last_seen_date, round(sum(coalesce(is_failure, false)::int)::double / count(*), 6) as lifetime_failure_ratio,
  src_user in (select "user" from marks) as is_compromised from auth where src_user is not null group by src_user""",
    "days": """select md5(cast(event_date as varchar)) as time_key, event_date as calendar_date, day_index, cast(round(day_index / 7.0) as int) as week_index, count(*) as auth_events,
  count(distinct src_user) as active_identities, sum(coalesce(is_failure, false)::int)::bigint as failures, event_date in (select event_date from marks) as has_redteam_activity
  from auth where src_user is not null group by event_date, day_index""",
    "edges": """select src_user as "user", dst_computer as computer, count(*) as "count", min(time) as first_seen, max(time) as last_seen,
  round(sum(coalesce(is_success, false)::int)::double / count(*), 4) as success_ratio,
  exists (select 1 from marks m where m."user" = a.src_user and m.dst_computer = a.dst_computer) as is_redteam from auth a
  where src_user is not null and dst_computer is not null group by src_user, dst_computer""",
    "users": """select "user" as name, "user" in (select "user" from marks) as is_compromised, regexp_matches("user", '\\$@') as is_machine from (select distinct "user" from edges)""".replace("\\\\", "\\"),
    "hosts": """select computer as name, computer in (select src_computer from marks) as is_redteam_pivot, computer in (select dst_computer from marks) as is_redteam_target
  from (select distinct computer from edges)""",
    "top14": """select "user" as name, row_number() over (order by count(*) desc, "user") as r from edges where is_redteam group by 1 order by 2 limit 14""",
    "human": "select m.* from mart m join who w on m.identity_key = w.identity_key where not w.is_machine_account",
}


def _sql(body: str) -> str:
    return "with recursive " + ",\n".join(f"{name} as ({text})" for name, text in _CTES.items()) + "\n" + body


def _q2(t: detectors.Thresholds, order: str = "excess_over_own_baseline desc, off_hours_events desc") -> str:
    return f"""select src_user as identity, event_date, auth_count, off_hours_events, round(off_hours_share, 4) as off_hours_share_today,
  round(round(off_hours_share_baseline_mean, 9), 4) as off_hours_share_baseline, round(round(off_hours_share - off_hours_share_baseline_mean, 9), 4) as excess_over_own_baseline, baseline_days_available, is_redteam_day
  from human where auth_count >= {t.volume} and baseline_days_available >= {t.history} and off_hours_share > 0 and off_hours_share_baseline_mean < {t.usual} and off_hours_share > {t.unusual}
  order by {order}, identity, event_date limit {t.top}"""


def _q4(t: detectors.Thresholds, order: str = "round(failure_ratio_zscore, 9) desc, failure_count desc") -> str:
    return f"""select m.src_user as identity, event_date, auth_count, failure_count, round(failure_ratio, 4) as failure_ratio_today, round(failure_ratio_baseline_mean, 4) as failure_ratio_baseline,
  round(failure_ratio_baseline_stddev, 4) as baseline_stddev, round(failure_ratio_zscore, 2) as failure_zscore, baseline_days_available, distinct_dst_computers, is_redteam_day, is_machine_account
  from mart m join who w on m.identity_key = w.identity_key where round(failure_ratio_zscore, 9) > {t.z} and failure_count >= {t.failures}
  order by {order}, m.src_user, event_date limit {t.top}"""


def _q5(t: detectors.Thresholds) -> str:
    names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(detectors.DETECTORS))
    return f"""select n.name as detector, attacks as redteam_days_total, hits as redteam_days_caught, attacks - hits as redteam_days_missed, round(100.0::double * hits / nullif(attacks, 0), 1) as recall_pct,
  alerts as alerts_raised, round(100.0::double * hits / nullif(alerts, 0), 3) as precision_pct, days as identity_days_scanned,
  round((hits::double / nullif(alerts, 0)) / (nullif(attacks, 0)::double / days), 1) as lift_over_random
  from (select i, count(*) as days, sum(a)::bigint as attacks, sum(f)::bigint as alerts, sum(f * a)::bigint as hits from (
    select a, unnest([d1, d2, d3, d4, (d1 + d2 + d3 + d4 >= 1)::int, (d1 + d2 + d3 + d4 >= 2)::int]) as f, unnest([0, 1, 2, 3, 4, 5]) as i from (
      select is_redteam_day::int as a, coalesce(round(fanout_zscore, 9) > {t.z}, false)::int as d1,
        coalesce(baseline_days_available >= {t.history} and off_hours_share_baseline_mean < {t.usual} and off_hours_share > {t.unusual} and auth_count >= {t.volume}, false)::int as d2,
        (new_dst_computers >= {t.new_paths})::int as d3, coalesce(round(failure_ratio_zscore, 9) > {t.z} and failure_count >= {t.failures}, false)::int as d4 from mart)) group by i) s
  join (values {names}) n(i, name) on s.i = n.i"""


def _preset_sql(name: str) -> str:
    text = detectors.PRESETS[name].split("\n", 1)[1]
    for place in ("mart", "who", "days"):
        text = text.replace("{{" + place + "}}", place)
    return _sql(f"select * from ({text})")


_MART_ROUNDED = "failure_ratio off_hours_share fanout_baseline_mean fanout_baseline_stddev failure_ratio_baseline_mean failure_ratio_baseline_stddev off_hours_share_baseline_mean fanout_zscore failure_ratio_zscore".split()
_DAILY_SQL = f"select {', '.join(c if c not in _MART_ROUNDED else f'round({c}, 6) as {c}' for c in _MART_COLUMNS)} from daily"
_SESSION_SQL = """(select src_user, src_computer, s, min(time) as session_start, max(time) as session_end, count(*) as event_count, count(distinct dst_computer) as distinct_destinations,
  sum(is_success::int)::bigint as success_count, min(event_date) as event_date from (
    select *, sum(n) over (partition by src_user, src_computer order by time rows unbounded preceding) as s from (
      select *, coalesce((time - lag(time) over (partition by src_user, src_computer order by time) > 21600)::int, 1) as n from auth where src_user is not null)) group by 1, 2, 3)"""
_COSINE = "list_dot_product(a.embedding, b.embedding)"
_DISTANCE = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double)))"
_NEAREST = f"select a.vec_id as q, b.vec_id as id, b.label = 3 as hit, {_DISTANCE} as d, row_number() over (partition by a.vec_id order by round({_DISTANCE}, 12), b.vec_id) as r from embeddings a join embeddings b on a.vec_id <> b.vec_id"

_SQL = {
    "lake": _sql("select * from auth"),
    "labels_lake": _sql("select * from marks"),
    "sessions": _sql(f"""select src_user, src_computer, session_start, session_end, event_count, distinct_destinations, success_count, event_date, session_end - session_start as duration_seconds,
  substr(sha256(concat_ws('|', src_user, src_computer, cast(s as varchar))), 1, 16) as session_id from {_SESSION_SQL}"""),
    "session_stats": _sql(f"select count(*) as sessions, round(avg(event_count), 6) as avg_events, round(avg(session_end - session_start), 6) as avg_duration, max(event_count) as max_events, quantile_disc(session_end - session_start, 0.5) as median_duration from {_SESSION_SQL}"),
    "session_windows": _sql(f"select src_user, src_computer, session_start, session_end, event_count, session_end - session_start as duration_seconds from {_SESSION_SQL}"),
    "hour_histogram": _sql("""select hour_of_day, count(*) as events, count(*) filter (not coalesce(src_is_machine, false)) as human_events, count(*) filter (src_is_machine) as machine_events,
  count(*) filter (is_failure) as failures, count(distinct src_user) as identities from auth group by 1"""),
    "rollup": _sql(_DAILY_SQL),
    "rollup_naive": _sql(_DAILY_SQL),
    "rollup_window": _sql(_DAILY_SQL + " where event_date < date '2015-01-08'"),
    "rollup_stats": _sql('select count(*) as "rows", count(distinct src_user) as identities, sum(is_redteam_day::int)::bigint as redteam_days, max(distinct_dst_computers) as max_fanout, min(event_date) as first_date, max(event_date) as last_date from daily'),
    "daily_mart": _sql(f"select * replace ({', '.join(f'case when round({c}, 6) = 0 then 0::double else round({c}, 6) end as {c}' for c in _MART_ROUNDED)}) from mart"),
    "fact": _sql("""select time, src_user, src_computer, dst_computer, event_date, hour_of_day, event_ts, auth_type, logon_type, auth_orientation, 1 as event_count, coalesce(is_success, false)::int as success_count,
  coalesce(is_failure, false)::int as failure_count, hour_of_day in (0, 1, 2, 3, 4, 5) as is_off_hours,
  exists (select 1 from marks m where m.time = a.time and m."user" = a.src_user and m.src_computer = a.src_computer and m.dst_computer = a.dst_computer) as is_redteam_event from auth a where src_user is not null"""),
    "dim_identity": _sql("select * from who"),
    "dim_computer": _sql("""select md5(c) as computer_key, c as computer_name, s as events_as_source, d as events_as_destination, us as distinct_identities_from, ud as distinct_identities_to, s + d as total_events,
  case when s = 0 then 'destination_only' when d = 0 then 'source_only' when d > 10 * s then 'server_like' else 'workstation_like' end as host_role,
  c in (select src_computer from marks) as is_redteam_pivot, c in (select dst_computer from marks) as is_redteam_target from (
    select c, count(*) filter (k = 's') as s, count(*) filter (k = 'd') as d, count(distinct src_user) filter (k = 's') as us, count(distinct src_user) filter (k = 'd') as ud from (
      select src_computer as c, 's' as k, src_user from auth union all select dst_computer, 'd', src_user from auth) where c is not null and src_user is not null group by c)"""),
    "dim_time": _sql("select * from days"),
    "strategy_fingerprints": _sql("select v as variant, (select count(*) from daily) as \"rows\", true as agrees from (values ('shared_grain, broadcast True'), ('shared_grain, broadcast False'), ('naive, broadcast True'), ('naive, broadcast False')) x(v)"),
    "q1_weekly_fanout": _sql("""select identity, week_index, peak_daily_fanout, new_destinations, auth_events, had_redteam_activity, prev as prev_week_peak_fanout, peak_daily_fanout - prev as fanout_delta,
  round(peak_daily_fanout::double / nullif(prev, 0), 2) as fanout_multiple from (
    select *, lag(peak_daily_fanout) over (partition by identity order by week_index) as prev from (
      select src_user as identity, week_index, max(distinct_dst_computers) as peak_daily_fanout, sum(new_dst_computers)::bigint as new_destinations, sum(auth_count)::bigint as auth_events, bool_or(is_redteam_day) as had_redteam_activity
      from human h join days d on h.time_key = d.time_key group by 1, 2))
  where prev > 0 and peak_daily_fanout > prev order by fanout_delta desc, fanout_multiple desc, identity, week_index limit 25"""),
    "q2_off_hours": _sql(_q2(PUBLISHED)),
    "q2_off_hours_low": _sql(_q2(LOW)),
    "q3_new_paths": _sql("""select 'NETWORK' as scope, cast(event_date as varchar) as event_date, null::varchar as identity, sum(new_dst_computers)::bigint as new_edges, sum(distinct_dst_computers)::bigint as total_edges_touched,
  count(distinct identity_key) as active_identities, sum(is_redteam_day::int)::bigint as redteam_identities_active from mart group by event_date
  union all select * from (select 'IDENTITY', cast(event_date as varchar), src_user, new_dst_computers, distinct_dst_computers, 1::bigint, is_redteam_day::bigint from human where new_dst_computers > 0
  order by new_dst_computers desc, src_user, event_date limit 20)"""),
    "q4_failure_spikes": _sql(_q4(PUBLISHED)),
    "q4_failure_spikes_low": _sql(_q4(LOW)),
    "q5_evaluation": _sql(_q5(PUBLISHED)),
    "q5_evaluation_low": _sql(_q5(LOW)),
    **{name: _preset_sql(name) for name in ("preset_fanout", "preset_new_paths")},
    **{f"preset_off_hours{x}": _sql(f"select identity, event_date, auth_count, off_hours_events, off_hours_share_today as off_hours_today, off_hours_share_baseline as their_baseline, excess_over_own_baseline as excess, is_redteam_day from ({_q2(t, 'excess_over_own_baseline desc')})") for x, t in (("", PUBLISHED), ("_low", LOW))},
    **{f"preset_failures{x}": _sql(f"select identity, event_date, auth_count, failure_count, failure_ratio_today, failure_zscore as z_score, baseline_days_available, is_redteam_day from ({_q4(t, 'round(failure_ratio_zscore, 9) desc')})") for x, t in (("", PUBLISHED), ("_low", LOW))},
    **{f"preset_detectors{x}": _sql(f"select case left(detector, 2) when 'Q1' then 'Q1 fan-out spike' when 'Q2' then 'Q2 off-hours' when 'Q3' then 'Q3 new access paths' when 'Q4' then 'Q4 failure spike' else detector end as detector, redteam_days_total as redteam_days, redteam_days_caught as caught, redteam_days_missed as missed, recall_pct, alerts_raised as alerts_to_triage, precision_pct, lift_over_random from ({_q5(t)}) where detector not like 'TWO%'") for x, t in (("", PUBLISHED), ("_low", LOW))},
    "stored_q2_off_hours": _sql(_q2(LOW)),
    "stored_q4_failure_spikes": _sql(_q4(LOW)),
    "stored_q5_evaluation": _sql(_q5(LOW)),
    "stored_vector_labels": _sql("""select concat_ws('|', src_user, cast(event_date as varchar)) as id, src_user, event_date, is_redteam_day as is_attack, 52 as dimensions from daily"""),
    "graph_window_edges": _sql("""select src_user as "user", dst_computer as computer, count(*) as "count", min(time) as first_seen, max(time) as last_seen, round(sum(coalesce(is_success, false)::int)::double / count(*), 4) as success_ratio,
  exists (select 1 from marks m where m."user" = a.src_user and m.dst_computer = a.dst_computer and m.day_index >= 2 and m.day_index < 9) as is_redteam from auth a
  where src_user is not null and dst_computer is not null and day_index >= 2 and day_index < 9 group by src_user, dst_computer"""),
    "graph_window_computers": _sql("""select dst_computer as name, dst_computer in (select src_computer from marks where day_index between 2 and 8) as is_redteam_pivot,
  dst_computer in (select dst_computer from marks where day_index between 2 and 8) as is_redteam_target from (select distinct dst_computer from auth where src_user is not null and dst_computer is not null and day_index between 2 and 8)"""),
    "graph_subgraph_json": _sql("""select distinct 'node' as part, unnest([e."user", e.computer]) as name from edges e join hosts h on e.computer = h.name where is_redteam or is_redteam_pivot or is_redteam_target
  union all select 'edge', e."user" || '>' || e.computer from edges e join hosts h on e.computer = h.name where is_redteam or is_redteam_pivot or is_redteam_target"""),
    "graph_users": _sql("select * from users"),
    "graph_computers": _sql("select * from hosts"),
    "graph_edges": _sql("select * from edges"),
    "graph_counts": _sql("select (select count(*) from users) as users, (select count(*) from hosts) as computers, count(*) as edges, count(*) filter (is_redteam) as redteam_edges from edges"),
    "graph_blast_radius": _sql("""select s.name as start, count(distinct e1.computer) as hop1_hosts, count(distinct e2."user") as hop2_peers, count(distinct e3.computer) as hop3_hosts,
  array_to_string(list_slice(list_sort(list_distinct(list(e1.computer))), 1, 25), ',') as hop1_sample
  from (select name from top14 where r <= 8 union all select * from (select "user" as name from edges join users on "user" = name where not is_compromised and not is_machine group by 1 order by count(*) desc, 1 limit 8 offset 5)) s
  join edges e1 on e1."user" = s.name left join edges e2 on e2.computer = e1.computer and e2."user" <> s.name
  left join edges e3 on e3."user" = e2."user" and e3.computer <> e1.computer group by 1"""),
    "graph_movement": _sql("""select "user" as attacker_identity, computer as compromised_host, "count" as auth_events_on_edge, success_ratio, first_seen as first_seen_seconds from edges where is_redteam"""),
    "graph_attacker_footprint": _sql("""select "user" as identity, count(*) filter (is_redteam) as hosts_via_redteam_edges, count(*) as hosts_total_footprint, round(100.0::double * count(*) filter (is_redteam) / count(*), 1) as pct_of_footprint_that_was_attack
  from edges where "user" in (select name from users where is_compromised) group by 1 order by 2 desc, 1 limit 25"""),
    "graph_choke_points": _sql("""select computer as host, count(*) as identities_authenticating_here, bool_or(is_redteam_pivot) as was_redteam_pivot, bool_or(is_redteam_target) as was_redteam_target
  from edges e join hosts h on e.computer = h.name group by 1 having count(*) > 1 order by 2 desc, 1 limit 25"""),
    "graph_top_attackers": _sql('select "user" as name, count(*) as redteam_edges from edges where is_redteam group by 1 order by 2 desc, 1 limit 8'),
    "graph_control_group": _sql('select "user" as name, count(*) as degree from edges join users on "user" = name where not is_compromised and not is_machine group by 1 order by 2 desc, 1 limit 8 offset 5'),
    "graph_attack_subgraph": _sql("select e.* from edges e join hosts h on e.computer = h.name where is_redteam or is_redteam_pivot or is_redteam_target"),
    "vector_anomalies": f"select q as id, round(avg(d), 5) as anomaly_score from ({_NEAREST}) where r <= 20 group by 1",
    "vector_retrieval": f"""select count(*) as queries, round(avg(h), 2) as mean_hits, round(100 * avg(h) / 10, 2) as precision_at_k_pct, count(*) filter (h > 0) as with_a_hit, count(*) filter (h = 0) as without,
  round(100 * any_value(b), 4) as base_rate_pct, round(avg(h) / 10 / any_value(b), 1) as lift_over_random
  from (select q, count(*) filter (hit) as h from ({_NEAREST.replace('on a.vec_id <> b.vec_id', 'on a.vec_id <> b.vec_id and a.label = 3')}) where r <= 10 group by q), (select avg((label = 3)::int) as b from embeddings)""",
    "vector_lookalikes": """select id, round(s, 5) as similarity from (select b.vec_id as id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s from embeddings a join embeddings b on b.vec_id <> a.vec_id where a.vec_id = 0)
  order by round(s, 9) desc, id limit 10""",
    "streaming_windows": _sql("""select * from (select date_trunc('minute', event_ts) as window_start, date_trunc('minute', event_ts) + interval 1 minute as window_end, src_user, count(*) as auth_count,
  sum(coalesce(is_failure, false)::int)::bigint as failure_count, sum(coalesce(is_success, false)::int)::bigint as success_count, cast(date_trunc('minute', event_ts) as date) as event_date,
  count(distinct dst_computer) as distinct_dst_computers, count(distinct src_computer) as distinct_src_computers, 0::bigint as max_produce_ts_ms
  from auth where src_user is not null group by 1, 2, 3) where window_end <= (select max(event_ts) - interval 2 minute from auth)"""),
    "weekly_suppliers": """select *, suppliers - prev_suppliers as delta from (select *, lag(suppliers) over (partition by o_custkey order by week_index) as prev_suppliers from (
  select o_custkey, cast(floor(date_diff('day', date '1992-01-01', cast(o_orderdate as date)) / 7.0) as bigint) as week_index, count(distinct l_suppkey) as suppliers
  from orders join lineitem on o_orderkey = l_orderkey group by 1, 2)) where suppliers > prev_suppliers order by delta desc, o_custkey, week_index limit 25""",
}


def _share_sql(digits: int | None = 6) -> str:
    """Shares of the behaviour vector, by the same vocabularies."""
    names, parts = vectors.feature_names()[6:-1], [f"hour_of_day = {h}" for h in range(24)]
    for column, words in vectors.VOCABULARIES.items():
        known = [f"starts_with(coalesce({column}, ''), '{w}')" for w in words]
        parts += [*known, f"not ({' or '.join(known)})"]
    whole = lambda p: f"count(*) filter ({p})::double / count(*)"
    return ", ".join(f"{f'round({whole(p)}, {digits})' if digits else whole(p)} as {n}" for p, n in zip(parts, names, strict=True))


def _features_sql(digits: int | None = 6) -> str:
    counts = {"auth_count": "count(*)", "failure_count": "count(*) filter (is_failure)", "distinct_dst": "count(distinct dst_computer)", "distinct_src": "count(distinct src_computer)", "new_dst": "coalesce(any_value(f.n), 0)"}
    logs = [(f"ln(1 + {c})", f"log_{n}") for n, c in counts.items()] + [("count(*) filter (is_failure)::double / count(*)", "failure_ratio")]
    return f"""select a.src_user, a.event_date, {", ".join(f"{f'round({x}, {digits})' if digits else x} as {n}" for x, n in logs)}, {_share_sql(digits)}, bool_or(src_is_machine)::int::double as is_machine
  from auth a left join fresh f on a.src_user = f.src_user and a.event_date = f.event_date where a.src_user is not null group by 1, 2"""


def _unit_sql() -> str:
    """Every dimension standardised by its mean and deviation over all rows, then divided by the row's length."""
    names = vectors.feature_names()
    stats = ", ".join(f"avg({n}) as m_{n}, case when stddev_pop({n}) > 0 then stddev_pop({n}) else 1 end as s_{n}" for n in names)
    z = ", ".join(f"({n} - m_{n}) / s_{n} as {n}" for n in names)
    length = " + ".join(f"{n} * {n}" for n in names)
    unit = ", ".join(f"round(({n} / (case when len > 0 then len else 1 end))::float::double, 5) + 0.0::double as {n}" for n in names)
    return _sql(f"""select src_user, event_date, {unit} from (select *, sqrt({length}) as len from (
  select f.src_user, f.event_date, {z} from ({_features_sql(None)}) f, (select {stats} from ({_features_sql(None)})) s))""")


_PATHS = """,
step as (select "user" as f, computer as t, "count" as w, is_redteam as r from edges union all select computer, "user", "count", is_redteam from edges),
walk as (select name as src, name as node, 0 as hop, {'p': [name], 'w': []::bigint[], 'r': false} as best from top14 where r <= 6
  union all select src, t, hop + 1, min({'p': list_append(best.p, t), 'w': list_append(best.w, w::bigint), 'r': best.r or step.r}) from walk join step on node = f where hop < 6 group by src, t, hop),
shortest as (select a.src, b.dst, min(hop)::int as hops, arg_min(best, hop) as best from walk a join top14 x on x.name = a.src
  join (select name as dst, r from top14) b on a.node = b.dst where x.r < b.r group by 1, 2)
"""


def _paths_sql(body: str) -> str:
    return _sql(body).replace("\n" + body, _PATHS + body)


def _checks_sql() -> str:
    """Violations of every check, counted from the tables themselves."""
    nulls = {
        "fact": ("auth_fact", "event_date src_user event_count success_count failure_count is_off_hours is_redteam_event"),
        "dim_identity": ("who", "identity_key identity_name is_machine_account is_compromised total_auth_events"),
        "dim_computer": ("dim_hosts", "computer_key computer_name host_role is_redteam_pivot is_redteam_target"),
        "dim_time": ("days", "time_key calendar_date day_index week_index has_redteam_activity"),
        "mart": ("mart", "identity_key time_key event_date auth_count is_redteam_day distinct_dst_computers"),
    }
    rows = [f"select 'not_null {name}.{c}' as \"check\", count(*) filter ({c} is null) as violations from {table}" for name, (table, columns) in nulls.items() for c in columns.split()]
    for table, name, keys in (("who", "dim_identity", "identity_key"), ("dim_hosts", "dim_computer", "computer_key"), ("days", "dim_time", "time_key"), ("who", "dim_identity", "identity_name"),
                              ("dim_hosts", "dim_computer", "computer_name"), ("days", "dim_time", "calendar_date"), ("days", "dim_time", "day_index"), ("mart", "mart", "identity_key, event_date")):
        rows.append(f"select 'unique {name}.{keys.replace(', ', '+')}', count(*) from (select 1 from {table} group by {keys} having count(*) > 1)")
    for child, column, parent, key, name in (("mart", "identity_key", "who", "identity_key", "mart"), ("mart", "time_key", "days", "time_key", "mart"), ("auth_fact", "src_user", "who", "identity_name", "fact"),
                                             ("auth_fact", "dst_computer", "dim_hosts", "computer_name", "fact"), ("auth_fact", "src_computer", "dim_hosts", "computer_name", "fact"), ("auth_fact", "event_date", "days", "calendar_date", "fact")):
        rows.append(f"select 'relationship {name}.{column}', count(*) from {child} where {column} is not null and {column} not in (select {key} from {parent})")
    rows.append("select 'accepted staging.outcome', count(*) from auth where outcome not in ('Success', 'Fail')")
    rows.append("select 'accepted dim_computer.host_role', count(*) from dim_hosts where host_role not in ('destination_only', 'source_only', 'server_like', 'workstation_like')")
    rows.append("""select 'rollup reconciles with fact', count(*) from (select event_date, sum(event_count) as n from auth_fact group by 1) a
  full join (select event_date, sum(auth_count) as n from mart group by 1) b on a.event_date = b.event_date where a.n is distinct from b.n""")
    tables = f",\nauth_fact as ({_bare('fact')}),\ndim_hosts as ({_bare('dim_computer')})\n"
    body = "\nunion all ".join(rows)
    return _sql(body).replace("\n" + body, tables + body)


def _bare(name: str) -> str:
    """The last part of a registered statement, for use as a table beside the others."""
    return _SQL[name][len(_sql("")) :]


_SQL |= {
    "vector_features": _sql(_features_sql()),
    "vector_unit": _unit_sql(),
    "graph_shortest_paths": _paths_sql("select src, dst, hops, array_to_string(best.p, '>') as path, array_to_string(best.w, '>') as weights, best.r as any_redteam from shortest"),
    "graph_hop_histogram": _paths_sql("select hops, count(*) as paths from shortest group by hops"),
    "data_checks": _checks_sql(),
    "vector_budgets": f"""with s as (select q as id, avg(d) as score from ({_NEAREST}) where r <= 20 group by q),
r as (select row_number() over (order by round(score, 9) desc, id) as place, label = 3 as hit from s join embeddings e on e.vec_id = s.id)
select detector, alerts, count(*) filter (hit and place <= alerts) as caught, count(*) filter (hit and place > alerts) as missed,
  round(100.0::double * count(*) filter (hit and place <= alerts) / nullif(count(*) filter (hit), 0), 1) as recall_pct, round(100.0::double * count(*) filter (hit and place <= alerts) / alerts, 3) as precision_pct
from r, (values ('a', 20::bigint), ('b', 100), ('all', 1000000000)) b(detector, alerts) where alerts < (select count(*) from r) group by 1, 2""",
    "vector_payload": f"""select id, hit as is_attack, round(score, 5) as anomaly_score from (select q as id, avg(d) as score from ({_NEAREST}) where r <= 20 group by q)
  join (select vec_id, label = 3 as hit from embeddings) on vec_id = id where hit or ('0x' || substr(md5(cast(id as varchar)), 1, 8))::bigint % 64 = 0""",
    "extract_sample": _sql("""select src_user, event_date, is_redteam_day from mart where is_redteam_day or ('0x' || substr(md5(concat_ws('|', src_user, cast(event_date as varchar))), 1, 8))::bigint % 64 = 0"""),
    "streaming_mart": "select md5(concat_ws('|', src_user, strftime(window_start, '%Y-%m-%d %H:%M:%S'))) as window_key, md5(src_user) as identity_key, md5(cast(event_date as varchar)) as time_key, src_user, window_start, window_end, event_date, auth_count, success_count, failure_count, "
    f"failure_count::double / auth_count as failure_ratio, distinct_dst_computers as distinct_dst_computers_approx, distinct_src_computers as distinct_src_computers_approx from ({_SQL['streaming_windows']})",
    "stored_mart": _SQL["daily_mart"],
    "stored_q1_weekly_fanout": _SQL["q1_weekly_fanout"],
    "stored_q3_new_paths": _SQL["q3_new_paths"],
}


def _as_text(name: str, sql: str) -> str:
    texts = ", ".join(f"cast({c} as varchar) as {c}" for c in _texts(name))
    return f"select * replace ({texts}) from ({sql})" if texts else sql


ORACLE_SQL = {name: _as_text(name, sql) for name, sql in _SQL.items()}
