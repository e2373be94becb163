"""Log, sessions, rollup, baselines and star on rows that can be checked by hand."""

from __future__ import annotations

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from authscope.functions import expressions as X
from authscope.operators import diurnal, graph, rollup, sessions, star
from authscope.plans import detectors, warehouse
from authscope.sources import log, sinks

DAY = 86400


def raw(spark, rows):
    """(time, user, source, destination, outcome) with the other fields filled in."""
    return spark.createDataFrame([(t, u, u, s, d, "Kerberos", "Network", "LogOn", o) for t, u, s, d, o in rows], log.AUTH_SCHEMA.replace(" not null", ""))


def labels(spark, rows):
    return log.derive_labels(spark.createDataFrame(rows, log.LABEL_SCHEMA.replace(" not null", "")))


def test_derived_columns_and_missing_values(spark):
    rows = [(0, "U1@D", "U1@D", "C1", "C2", "Kerberos", "Network", "LogOn", "Success"), (90000, "C5$@DOM1", "?", "?", "C2", "?", "?", "?", "?"), (5, "?", "?", "?", "?", "?", "?", "?", "?"), (6, "U7", "x", "C1", "C2", "a", "b", "c", "Fail"), (7, "U78@?", "x", "C1", "C2", "a", "b", "c", "Fail")]
    found = {r["time"]: r for r in log.derive(spark.createDataFrame(rows, log.AUTH_SCHEMA)).collect()}
    assert (found[0]["day_index"], found[0]["hour_of_day"], str(found[0]["event_date"]), found[0]["is_success"], found[0]["src_is_machine"]) == (0, 0, "2015-01-01", True, False)
    machine = found[90000]
    assert (machine["day_index"], machine["hour_of_day"], str(machine["event_date"])) == (1, 1, "2015-01-02")
    assert machine["auth_type"] is None and machine["is_success"] is None and machine["is_failure"] is None and machine["src_is_machine"]
    assert all(found[5][c] is None for c in log.STRINGS)
    assert found[6]["src_domain"] is None and found[6]["src_user_name"] == "U7"
    assert found[7]["src_domain"] == "?"
    assert str(found[90000]["event_ts"]) == "2015-01-02 01:00:00"


def test_readers(spark, tmp_path):
    lines = "1,U1@D,U1@D,C1,C2,?,Network,LogOn,Success\nbroken\n2,U2@D,U2@D,C1,C3,NTLM,Network,LogOn,Fail\n"
    (tmp_path / "auth.txt.gz").write_bytes(gzip.compress(lines.encode()))
    (tmp_path / "sample.csv").write_text("time,src_user,dst_user,src_computer,dst_computer,auth_type,logon_type,auth_orientation,outcome\n" + lines)
    (tmp_path / "red.txt").write_text("5,U1@D,C1,C9\n")
    assert sorted(r["time"] for r in log.read_auth(spark, str(tmp_path / "auth.txt.gz")).collect()) == [1, 2]
    assert len(log.read_auth(spark, str(tmp_path / "sample.csv")).collect()) == 2
    log.read_labels(spark, str(tmp_path / "red.txt")).write.parquet(str(tmp_path / "red"))
    assert [tuple(r) for r in log.read_labels(spark, str(tmp_path / "red")).collect()] == [(5, "U1@D", "C1", "C9")]
    profile = log.profile(log.read_lines(spark, str(tmp_path / "auth.txt.gz"))).first()
    assert (profile["rows"], profile["unparseable"], profile["min_time"], profile["max_time"]) == (3, 1, 1, 2)
    assert log.read_band(spark, str(tmp_path / "none.json")) == [0, 1, 2, 3, 4, 5]
    (tmp_path / "band.json").write_text('{"band": []}')
    assert log.read_band(spark, str(tmp_path / "band.json")) == []
    (tmp_path / "q5.csv").write_text("detector,alerts_raised\na,12.0\nb,0\nc,\n")
    assert [tuple(r) for r in log.read_budgets(spark, str(tmp_path / "q5.csv")).collect()] == [("a", 12)]


def test_lake_write_reads_back_and_prunes(spark, tmp_path):
    events = log.derive(raw(spark, [(0, "U1@D", "C1", "C2", "Success"), (DAY, "U1@D", "C1", "C2", "Fail"), (DAY, "U1@D", "C1", "C2", "Fail")]))
    assert sinks.write_by_date(events, str(tmp_path / "lake"), 2) == 3
    lake = log.read_lake(spark, str(tmp_path / "lake"))
    plan = rollup.rollup(lake, labels(spark, []), max_day=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    sinks.write_extract(rollup.rollup(lake, labels(spark, [])), str(tmp_path / "extract"), ["src_user", "failure_ratio"])
    assert dict(spark.read.parquet(str(tmp_path / "extract")).dtypes) == {"src_user": "string", "failure_ratio": "float"}
    assert [u for u, _ in sinks.replay(lake, 2)] == ["U1@D", "U1@D"]


@pytest.mark.parametrize("times, expected", [([100, 160, 7360], [(2, 60), (1, 0)]), ([100, 1900], [(2, 1800)]), ([100, 1901], [(1, 0), (1, 0)])])
def test_sessions(spark, times, expected):
    events = log.derive(raw(spark, [(t, "U1@D", "C1", "C2", "Success") for t in times]))
    made = sessions.sessions(events).orderBy("session_start").collect()
    assert [(r["event_count"], r["duration_seconds"]) for r in made] == expected
    assert all(len(r["session_id"]) == 16 for r in made)
    assert [(r["event_count"], r["duration_seconds"]) for r in sessions.session_windows(events).orderBy("session_start").collect()] == expected


def test_sessions_keep_a_null_host_apart_and_start_their_date(spark):
    events = log.derive(raw(spark, [(DAY - 10, "U1@D", "?", "C2", "?"), (DAY + 10, "U1@D", "?", "C2", "?"), (DAY, "U1@D", "C1", "C2", "Fail"), (0, "?", "C1", "C2", "Fail")]))
    made = {r["src_computer"]: r for r in sessions.sessions(events).collect()}
    assert set(made) == {None, "C1"} and made[None]["event_count"] == 2 and str(made[None]["event_date"]) == "2015-01-01" and made[None]["success_count"] is None


TOY = [(100, "U1@D", "C1", "C2", "Success"), (200, "U1@D", "C1", "C2", "Success"), (50000, "U1@D", "C1", "C3", "Fail"), (60000, "U1@D", "C4", "C3", "Success"),
       (DAY + 10, "U1@D", "C1", "C2", "Success"), (DAY + 20, "U1@D", "C1", "C5", "Success"), (300, "U2@D", "C1", "C2", "Success"),
       (DAY + 30, "U2@D", "C1", "?", "?")]


@pytest.mark.parametrize("strategy", ["shared_grain", "naive"])
@pytest.mark.parametrize("broadcast", [True, False, None])
def test_toy_rollup(spark, strategy, broadcast):
    marked = labels(spark, [(DAY + 10, "U1@D", "C1", "C2"), (DAY + 15, "U1@D", "C1", "C5")])
    made = rollup.rollup(log.derive(raw(spark, TOY)), marked, [0, 1, 2, 3], strategy, broadcast).collect()
    found = {(r["src_user"], str(r["event_date"])[-2:]): r for r in made}
    assert len(made) == 4
    one = found["U1@D", "01"]
    assert [one[c] for c in ("auth_count", "success_count", "failure_count", "distinct_dst_computers", "distinct_src_computers", "new_dst_computers", "off_hours_events", "failure_ratio", "is_redteam_day")] == [4, 3, 1, 2, 2, 2, 2, 0.25, False]
    two = found["U1@D", "02"]
    assert [two[c] for c in ("auth_count", "distinct_dst_computers", "new_dst_computers", "is_redteam_day")] == [2, 2, 1, True]
    assert found["U2@D", "01"]["new_dst_computers"] == 1 and not found["U2@D", "01"]["is_redteam_day"]
    silent = found["U2@D", "02"]  # no outcome that day
    assert silent["success_count"] is None and silent["failure_ratio"] is None and silent["new_dst_computers"] == 0


def test_fingerprint_ignores_order_and_notices_change(spark):
    a = spark.createDataFrame([(1, 0.5, None), (2, 0.1, "x")], "a int, b double, c string")
    same = rollup.fingerprint(a.orderBy(F.desc("a"))).first()
    assert rollup.fingerprint(a).first() == same != rollup.fingerprint(a.withColumn("a", F.col("a") + 1)).first()


def test_baselines_count_active_rows_and_leave_today_out(spark):
    rows = [("U", d, n, 0.0, 0.0) for d, n in ((0, 1), (10, 2), (40, 3), (50, 10), (51, 2))]
    daily = spark.createDataFrame(rows, "src_user string, day int, distinct_dst_computers long, failure_ratio double, off_hours_share double").withColumn("event_date", X.date_of(F.col("day")))
    made = {r["day"]: r for r in rollup.baselines(daily).collect()}
    assert [made[d]["baseline_days_available"] for d in (0, 10, 40, 50, 51)] == [0, 1, 2, 3, 4]
    assert made[40]["fanout_zscore"] is None and made[50]["fanout_zscore"] == pytest.approx(8.0)
    assert made[50]["failure_ratio_zscore"] is None  # no spread


def curve(quiet, low=100, high=400):
    return {h: low if h in quiet else high for h in range(24)}


def test_off_hours_band():
    assert diurnal.off_hours_band(curve({22, 23, 0, 1, 2, 3, 4, 5})) == [0, 1, 2, 3, 4, 5, 22, 23]
    assert diurnal.off_hours_band(dict.fromkeys(range(24), 100)) == []
    assert diurnal.off_hours_band(curve({23, 0, 1})) == [0, 1, 23]
    assert diurnal.off_hours_band(curve({3, 4, 10, 11})) == [3, 4]
    assert diurnal.off_hours_band({}) == []


def test_week_index_rounds(spark):
    row = spark.range(1).select(X.week_of(F.lit(4)).alias("r"), X.week_of(F.lit(34)).alias("s"), X.week_of(F.lit(34), "floor").alias("f")).first()
    assert tuple(row) == (1, 5, 4)


def test_fact_labels_need_all_four_keys(spark):
    marked = labels(spark, [(100, "U1@D", "C1", "C2"), (100, "U1@D", "C1", "C2")])
    rows = star.fact(log.derive(raw(spark, [*TOY, (100, "U1@D", "C9", "C2", "Fail")])), marked).collect()
    assert len(rows) == 9 and sum(r["is_redteam_event"] for r in rows) == 1
    assert sum(r["failure_count"] for r in rows) == 2


def test_host_roles(spark):
    events = log.derive(raw(spark, [(i, "U1@D", "A", "B", "Success") for i in range(11)] + [(20, "U2@D", "B", "S", "Success"), (21, "U2@D", "S", "A", "Success")] + [(30 + i, "U2@D", "A", "S", "Success") for i in range(10)]))
    roles = {r["computer_name"]: r["host_role"] for r in star.dim_computer(events, labels(spark, [(0, "U1@D", "A", "B")])).collect()}
    assert roles == {"A": "workstation_like", "B": "server_like", "S": "server_like"}


def test_checks_are_clean_and_notice_faults(spark):
    events, marked = log.derive(raw(spark, TOY)), labels(spark, [(100, "U1@D", "C1", "C2")])
    mart = rollup.baselines(rollup.rollup(events, marked))
    assert {r["violations"] for r in star.checks(events, marked, mart).collect()} == {0}
    twice = mart.unionByName(mart.filter("src_user = 'U2@D'"))
    bad = {r["check"]: r["violations"] for r in star.checks(events, marked, twice).collect()}
    assert bad["unique mart.identity_key+event_date"] == 2 and bad["rollup reconciles with fact"] == 2
    assert star.reconciled(star.fact(events, marked), mart.filter("src_user = 'U1@D' and auth_count = 4")).count() == 2


def test_detectors_fire_and_score(spark):
    events = [(d * DAY + 40000 + i, "U1@D", "C1", f"C{i % (12 if d == 6 else 1 + d % 2)}", "Fail" if d == 6 and i < 10 else "Success" if i or d % 2 else "Fail") for d in range(7) for i in range(12)]
    events, marked = log.derive(raw(spark, events)), labels(spark, [(6 * DAY + 1, "U1@D", "C1", "C2")])
    mart, who, days = rollup.baselines(rollup.rollup(events, marked)), star.dim_identity(events, marked), star.dim_time(events, marked)
    found = {r["detector"]: r for r in detectors.evaluation(mart).collect()}
    assert found["Q1 fan-out spike (z>3 vs own baseline)"]["redteam_days_caught"] == 1
    assert found["TWO OR MORE of Q1-Q4"]["recall_pct"] == 100.0 and found["Q2 off-hours vs own baseline"]["precision_pct"] is None
    assert detectors.weekly_fanout(mart, who, days).first()["fanout_delta"] == 10
    assert detectors.failure_spikes(mart, who).count() == 1
    assert {r["scope"] for r in detectors.new_paths(mart, who).collect()} == {"NETWORK", "IDENTITY"}


def test_query_runner(spark, tmp_path):
    table = spark.range(5)
    with pytest.raises(KeyError):
        detectors.ad_hoc(spark, "select * from {{missing}}", numbers=table)
    out = detectors.run_queries(spark, {"q": "-- Count\nselect count(*) as n from {{NUMBERS}}"}, str(tmp_path), numbers=table)
    assert '"title": "Count"' in out and '"rows": 1' in out


def test_upsert_is_idempotent(spark, tmp_path):
    new = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int")
    sinks.upsert(None, new, ["name"], str(tmp_path / "1"))
    old = spark.read.parquet(str(tmp_path / "1"))
    sinks.upsert(old, spark.createDataFrame([("b", 3)], "name string, n int"), ["name"], str(tmp_path / "2"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "2")).collect()} == {("a", 1), ("b", 3)}


def test_day_bounds_leave_the_last_day_out(spark):
    events, marked = log.derive(raw(spark, [(d * DAY + 5, "U1@D", "C1", f"C{d}", "Success") for d in range(4)])), labels(spark, [(3 * DAY, "U1@D", "C1", "C3")])
    assert sorted(str(r["event_date"]) for r in rollup.rollup(events, marked, max_day=2).collect()) == ["2015-01-01", "2015-01-02"]
    assert rollup.rollup(events, marked, max_day=0).count() == 0
    users, hosts, edges = graph.build(events, labels(spark, [(3 * DAY, "U1@D", "C1", "C1")]), 0, 2)
    assert {(r["computer"], r["is_redteam"]) for r in edges.collect()} == {("C0", False), ("C1", False)}  # the label is of day 3
    assert not users.first()["is_compromised"] and not any(r["is_redteam_target"] for r in hosts.collect())


def test_session_ids_hash_the_number_of_the_session(spark):
    events = log.derive(raw(spark, [(100, "U1@D", "C1", "C2", "Success"), (90000, "U1@D", "C1", "C2", "Success")]))
    made = [r["session_id"] for r in sessions.sessions(events).orderBy("session_start").collect()]
    assert made == [hashlib.sha256(f"U1@D|C1|{n}".encode()).hexdigest()[:16] for n in (1, 2)]


def test_warehouse_is_stored_and_its_views_answer_sql(spark, tmp_path):
    events, marked = log.derive(raw(spark, TOY)), labels(spark, [(100, "U1@D", "C1", "C2")])
    stored = warehouse.build(spark, events, marked, str(tmp_path / "w"), [0, 1])
    want = rollup.baselines(rollup.rollup(events, marked, [0, 1]))
    assert rollup.fingerprint(stored.mart.select(*want.columns)).first() == rollup.fingerprint(want).first()
    again = warehouse.build(spark, events, marked, str(tmp_path / "w"), [0, 1])
    assert rollup.fingerprint(again.mart.select(*want.columns)).first() == rollup.fingerprint(want).first()
    stored.register()
    assert spark.sql("select count(*) from mart m join who w on m.src_user = w.identity_name").first()[0] == 4
    plan = detectors.weekly_fanout(stored.mart.filter("event_date = date'2015-01-02'"), stored.who, stored.days)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    days = warehouse.attack_days(stored).collect()
    assert len(days) == 4 and [r["id"] for r in days if r["is_attack"]] == ["U1@D|2015-01-01"]
    with pytest.raises(AttributeError):
        stored.nothing  # noqa: B018


def test_plain_sinks(spark, tmp_path):
    table = spark.createDataFrame([("a", 1)], "name string, n int")
    sinks.run_only(table)
    sinks.write_plain(table, str(tmp_path / "plain"))
    sinks.write_json(table, str(tmp_path / "json"))
    log.register(spark, stored=str(tmp_path / "plain"), made=table)
    assert spark.sql("select count(*) from stored join made using (name, n)").first()[0] == 1
    assert spark.read.json(str(tmp_path / "json")).first()["name"] == "a"
    assert detectors.one_in(spark.range(100).selectExpr("cast(id as string) as value"), 1).count() == 100


def test_a_shared_folder_is_demanded_on_a_cluster(spark):
    from types import SimpleNamespace as Fake

    from authscope.session import shared_dir

    assert shared_dir(spark).startswith("file://")
    conf = Fake(get=lambda *a: None)
    with pytest.raises(RuntimeError):
        shared_dir(Fake(sparkContext=Fake(master="yarn", getConf=lambda: conf), conf=conf))
    assert shared_dir(Fake(sparkContext=Fake(master="local[2]", getConf=lambda: conf), conf=conf))
