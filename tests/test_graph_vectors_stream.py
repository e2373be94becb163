"""Graph, vectors and streaming contracts."""

from __future__ import annotations

import datetime
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from authscope.operators import graph, star, vectors
from authscope.plans import queries
from authscope.sources import log
from authscope.streaming import windows


def edges(spark, *pairs):
    return spark.createDataFrame([(u, c, 1, 0, 0, 1.0, False) for u, c in pairs], "user string, computer string, count long, first_seen int, last_seen int, success_ratio double, is_redteam boolean")


TOY = [("U1", "C1"), ("U2", "C1"), ("U2", "C2"), ("U3", "C2"), ("U1", "C9")]


def test_shortest_paths(spark):
    pairs = spark.createDataFrame([("U1", "U2"), ("U1", "U3"), ("U1", "U1"), ("U1", "U5")], "src string, dst string")
    found = {(r["src"], r["dst"]): r for r in graph.shortest_paths(edges(spark, *TOY, ("U5", "C7")), pairs).collect()}
    assert {k: r["hops"] for k, r in found.items()} == {("U1", "U2"): 2, ("U1", "U3"): 4, ("U1", "U1"): 0}
    assert found["U1", "U3"]["path"] == ["U1", "C1", "U2", "C2", "U3"] and found["U1", "U3"]["weights"] == [1, 1, 1, 1]
    assert graph.shortest_paths(edges(spark, *TOY), pairs.filter("dst = 'U3'"), max_hops=3).count() == 0


def test_blast_radius_walks_no_edge_twice(spark):
    one = graph.blast_radius(edges(spark, *TOY), spark.createDataFrame([("U1",), ("U9",)], "name string")).orderBy("start").collect()
    assert [tuple(r)[1:2] + tuple(r)[3:] for r in one] == [(2, 1, 1), (0, 0, 0)] and one[0]["hop1_sample"] == ["C1", "C9"]
    two = graph.blast_radius(edges(spark, ("U1", "C1"), ("U1", "C3"), ("U2", "C1"), ("U2", "C3"), ("U2", "C2")), spark.createDataFrame([("U1",)], "name string")).first()
    assert two["hop3_hosts"] == 3  # a direct host counts if another shared host leads to it


def test_graph_build_is_one_edge_a_pair(spark):
    rows = [(t, u, u, s, d, "K", "N", "L", o) for t, u, s, d, o in ((5, "U1@D", "C8", "C1", "Success"), (9, "U1@D", "C8", "C1", "Fail"), (1, "M$@D", "C8", "C2", "?"), (1, "?", "C8", "C2", "Success"), (2, "U1@D", "C8", "?", "Success"))]
    events = log.derive(spark.createDataFrame(rows, log.AUTH_SCHEMA))
    marked = log.derive_labels(spark.createDataFrame([(5, "U1@D", "C8", "C1"), (6, "U4@D", "C8", "C7")], log.LABEL_SCHEMA))
    users, computers, made = graph.build(events, marked)
    assert {tuple(r) for r in made.collect()} == {("U1@D", "C1", 2, 5, 9, 0.5, True), ("M$@D", "C2", 1, 1, 1, 0.0, False)}
    assert {tuple(r) for r in users.collect()} == {("U1@D", True, False), ("M$@D", False, True)}
    assert {tuple(r) for r in computers.collect()} == {("C1", False, True), ("C2", False, False)}  # no source-only pivot
    assert graph.counts(users, computers, made).first().asDict() == {"users": 2, "computers": 2, "edges": 2, "redteam_edges": 1}
    assert graph.path_pairs(["a", "b"], ["c", "a"]) == [("a", "b"), ("a", "c"), ("b", "c"), ("b", "a")]
    assert graph.saturation([30], [10], 100)["discriminates"] and not graph.saturation([95], [10], 100)["discriminates"]


def test_vector_names_and_shares(spark):
    names = vectors.feature_names()
    assert len(names) == len(set(names)) == 52 and not any("redteam" in n or "attack" in n for n in names)
    t = queries.Tables(spark, "/root/testdata/sf0.001")
    made = vectors.features(t.events, t.daily)
    for part in ("hour_", "auth_type_", "logon_type_", "orientation_"):
        total = sum((F.col(n) for n in names if n.startswith(part)), F.lit(0.0))
        if part == "logon_type_":  # a prefix match: Network counts NetworkCleartext too
            total = total - F.col("logon_type_networkcleartext_share")
        assert made.filter(F.abs(total - 1) > 1e-9).count() == 0
    unit = np.array([r["vector"] for r in vectors.vectors(made).select("vector").collect()])
    assert np.isfinite(unit).all() and np.allclose(np.linalg.norm(unit, axis=1), 1, atol=1e-5)


def planted(spark, labels=()):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.eye(8)[0] + 0.01 * rng.standard_normal((500, 8)), rng.standard_normal((10, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, v.tolist(), i in labels) for i, v in enumerate(x)], "id long, vector array<double>, is_attack boolean"), x


def test_anomalies_find_planted_outliers(spark):
    rows, x = planted(spark)
    top = vectors.anomaly_scores(rows.select("id", "vector"), 20).orderBy(F.desc("anomaly_score")).limit(10).collect()
    assert sum(r["id"] >= 500 for r in top) >= 8
    found = {(r["query"], r["rank"]): r["id"] for r in vectors.nearest(rows.select("id", "vector"), rows.filter("id < 3").select("id", "vector"), 5, block_rows=100).collect()}
    for q in range(3):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        assert [found[q, r] for r in range(1, 6)] == np.argsort(d, kind="stable")[:5].tolist()


def test_retrieval_leaves_the_query_out(spark):
    rng = np.random.default_rng(2)
    rows, _ = planted(spark, set(rng.choice(500, 10, replace=False).tolist()))
    assert vectors.retrieval(rows, 5).first()["mean_hits"] < 1.0


def test_budgets_of_everything_are_skipped(spark):
    scores = spark.createDataFrame([(i, float(i), i >= 8) for i in range(10)], "id long, anomaly_score double, is_attack boolean")
    made = vectors.at_budgets(scores, spark.createDataFrame([("few", 1), ("some", 4), ("all", 10)], "detector string, alerts long")).collect()
    assert {r["detector"]: (r["caught"], r["recall_pct"]) for r in made} == {"few": (1, 50.0), "some": (2, 100.0)}


def message(t, user="U1@D", outcome="Success"):
    at = datetime.datetime(2015, 1, 1) + datetime.timedelta(seconds=t)
    return json.dumps({"time": t, "event_ts": at.isoformat(), "src_user": user, "dst_computer": "C1", "src_computer": "C2", "outcome": outcome, "produce_ts_ms": 1000})


def run(spark, folder, batches):
    (folder / "in").mkdir(exist_ok=True)
    for i, batch in enumerate(batches):
        (folder / "in" / f"{i}.json").write_text("\n".join(batch) + "\n")
        os.utime(folder / "in" / f"{i}.json", (1_000_000 + i, 1_000_000 + i))  # files arrive in order
    query = windows.start(windows.windowed(log.stream_files(spark, f"{folder}/in")), f"{folder}/sink", f"{folder}/lag", f"{folder}/state")
    query.awaitTermination()
    assert query.exception() is None
    made = windows.read_sink(spark, f"{folder}/sink").collect()
    return {(r["src_user"], r["window_start"].strftime("%H:%M")): (r["auth_count"], r["failure_count"]) for r in made}, len(made)


def test_windows_and_failures(spark, tmp_path):
    made, _ = run(spark, tmp_path, [[message(t, outcome="Fail" if t == 10 else "Success") for t in (0, 10, 20, 70, 80)], [message(600, "U2@D")]])
    assert made["U1@D", "00:00"] == (3, 1) and made["U1@D", "00:01"] == (2, 0)
    found = windows.summary(spark, f"{tmp_path}/sink", f"{tmp_path}/lag")
    assert found["windows"] == 2 and found["events_aggregated"] == 5


def test_late_within_the_watermark_counts(spark, tmp_path):
    made, _ = run(spark, tmp_path, [[message(180), message(190)], [message(150), message(900)]])
    assert made["U1@D", "00:02"][0] == 1


def test_too_late_is_dropped(spark, tmp_path):
    run(spark, tmp_path, [[message(600), message(610)], [message(900)]])
    # the engine drops by the watermark of the batch before, so the late row comes one batch later
    made, _ = run(spark, tmp_path, [[message(600), message(610)], [message(900)], [message(30), message(1500)]])
    assert ("U1@D", "00:00") not in made


def test_distinct_hosts_are_exact(spark, tmp_path):
    hosts = [message(i % 60).replace('"C1"', f'"C{i}"') for i in range(300)]
    run(spark, tmp_path, [[*hosts, message(0).replace('"C2"', "null"), message(61, "U2@D").replace('"C2"', "null")], [message(600)]])
    made = windows.read_sink(spark, f"{tmp_path}/sink").select("src_user", "distinct_dst_computers", "distinct_src_computers").collect()
    assert sorted(map(tuple, made)) == [("U1@D", 300, 1), ("U2@D", 1, 0)]
    assert dict(windows.read_sink(spark, f"{tmp_path}/sink").dtypes)["distinct_dst_computers"] == "bigint"


def test_the_stream_mart_keeps_exact_hosts(spark):
    rows = spark.range(300).selectExpr("timestamp'2015-01-01 00:00:10' as event_ts", "'U1@D' as src_user", "concat('C', id) as dst_computer", "concat('S', id % 200) as src_computer", "'Fail' as outcome", "0L as produce_ts_ms")
    made = star.streaming_mart(windows.windowed(rows)).first()
    assert (made["distinct_dst_computers_approx"], made["distinct_src_computers_approx"], made["failure_ratio"]) == (300, 200, 1.0)


def test_restart_writes_nothing_twice(spark, tmp_path):
    batches = [[message(0), message(10)], [message(600)]]
    first = run(spark, tmp_path, batches)
    assert first == run(spark, tmp_path, batches) and first[1] == 1


def test_an_empty_run_is_an_error(spark, tmp_path):
    (tmp_path / "lag").mkdir()
    spark.createDataFrame([], "window_end timestamp, window_start timestamp, auth_count long").write.parquet(f"{tmp_path}/sink")
    spark.createDataFrame([], "committed_ms long, max_lag_ms long, min_lag_ms long").write.mode("overwrite").parquet(f"{tmp_path}/lag")
    with pytest.raises(RuntimeError):
        windows.summary(spark, f"{tmp_path}/sink", f"{tmp_path}/lag")


def test_nearest_rank():
    assert windows.nearest_rank([5, 1, 3], 50) == 3 and windows.nearest_rank([], 50) is None and windows.nearest_rank([1, 2], 100) == 2


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    import duckdb

    folder, db = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("events", "embeddings", "orders", "lineitem"):
        db.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    ours, theirs = queries.QUERIES[name](spark, folder), db.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in theirs.description]
    text = lambda v: "" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v)
    assert sorted(ours.columns) == sorted(columns)
    assert sorted(tuple(text(r[c]) for c in columns) for r in ours.collect()) == sorted(tuple(map(text, r)) for r in theirs.fetchall())


def test_the_grid_of_blocks_is_exact_and_the_index_finds_most(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 8)) * 6
    x = np.concatenate([centres[i % 20] + rng.standard_normal(8) for i in range(1200)]).reshape(-1, 8)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    asked = rows.filter("id < 40")
    exact = vectors.nearest(rows, asked, 5, block_rows=150)
    found = {(r["query"], r["rank"]): r["id"] for r in exact.collect()}
    for q in range(40):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        assert [found[q, r] for r in range(1, 6)] == np.argsort(d, kind="stable")[:5].tolist()
    by_index = vectors.nearest(rows, asked, 5, index=vectors.Index(probes=4, block_rows=50))
    assert vectors.recall(by_index, exact).first()["recall"] >= 0.9
    empty = rows.limit(0)
    assert vectors.nearest(empty, asked, 5).count() == 0 and vectors.nearest(rows, empty, 5, index=vectors.Index()).count() == 0


def test_budget_ranks_over_many_parts(spark):
    scores = spark.createDataFrame([(i, float(i % 50), i % 7 == 0) for i in range(500)], "id long, anomaly_score double, is_attack boolean")
    ranked = sorted(((-(i % 50), i) for i in range(500)))
    made = vectors.at_budgets(scores, spark.createDataFrame([("a", 37), ("b", 400)], "detector string, alerts long"), parts=9).collect()
    assert {r["detector"]: r["caught"] for r in made} == {n: sum(i % 7 == 0 for _, i in ranked[:k]) for n, k in (("a", 37), ("b", 400))}


def test_exports_and_payload(spark):
    pairs = spark.createDataFrame([("U1", "U3")], "src string, dst string")
    (one,) = graph.paths_json(graph.shortest_paths(edges(spark, *TOY), pairs)).collect()
    told = json.loads(one["json"])
    assert [n["kind"] for n in told["nodes"]] == ["user", "computer", "user", "computer", "user"] and told["edges"][0] == {"from": "U1", "to": "C1", "count": 1}
    rows = spark.createDataFrame([(i, [0.0, float(i)], i == 3) for i in range(200)], "id long, vector array<double>, is_attack boolean")
    kept = vectors.payload(rows, vectors.anomaly_scores(rows, 3)).collect()
    assert 3 in {r["id"] for r in kept} and len(kept) < 40 and all(r["anomaly_score"] > 0 for r in kept)


def test_lag_over_a_run_and_pruned_sink(spark, tmp_path):
    run(spark, tmp_path, [[message(t) for t in (0, 70, 130)], [message(600)], [message(1200)]])
    late = spark.read.parquet(f"{tmp_path}/lag")
    assert windows.lag_percentiles(late).first()["windows"] == late.count() == windows.read_sink(spark, f"{tmp_path}/sink").count()
    plan = windows.read_sink(spark, f"{tmp_path}/sink").filter("event_date = date'2015-01-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_replay_and_its_failures(spark, tmp_path):
    sent = [("U1@D", message(t)) for t in range(0, 1200, 30)]
    found = windows.replay_run(spark, sent, str(tmp_path / "ok"), rate=1000, per_file=10)
    assert found["windows"] >= 16 and found["produced"] == 40 and found["p50_ms"] >= 0 and found["batches"] >= 1

    def broken():
        yield from sent
        raise OSError("gone")

    with pytest.raises(RuntimeError, match="producer died"):
        windows.replay_run(spark, broken(), str(tmp_path / "dead"), rate=1000, per_file=10)
    with pytest.raises(RuntimeError, match="no window"):
        windows.replay_run(spark, sent[:1], str(tmp_path / "none"), rate=1000, per_file=10)


def test_plain_file_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(message(t) for t in (0, 900)) + "\n")
    query = windows.start_files(windows.windowed(log.stream_files(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_a_block_gives_the_best_within_the_bound():
    import pandas as pd

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)).round(1)
    x[100:140] = x[7]  # ties
    ids = np.array([f"r{i:03d}" for i in rng.permutation(300)], dtype=object)
    asked = list(range(0, 300, 3)) + [7]
    bound = np.array([np.inf if i % 2 else 4.0 for i in range(len(asked))])
    found = vectors._best(5)(pd.DataFrame({"id": ids, "vector": list(x)}), pd.DataFrame({"id": ids[asked], "vector": list(x[asked]), "bound": bound}))
    want = []
    for i, most in zip(asked, bound, strict=True):
        d = np.round(((x - x[i]) ** 2).sum(axis=1), 12)
        want += [(ids[i], n, o) for o, n in sorted((o, n) for o, n in zip(d, ids, strict=True) if n != ids[i] and o <= most)[:5]]
    assert [(q, n, round(o, 9)) for q, n, o in found.itertuples(index=False)] == [(q, n, round(o, 9)) for q, n, o in want]


def test_the_index_gives_the_best_of_all_probed_cells(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(400, 4)) + 3 * rng.integers(0, 3, size=(400, 1))).round(2)
    x[50:90] = x[3]
    index = vectors.Index(probes=4, cells=1.0, block_rows=16)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").localCheckpoint()
    centroids = vectors.fit_centroids(rows, 400, index)
    cell, probed = vectors._near_cells(x, centroids, 1)[:, 0], vectors._near_cells(x, centroids, 4)
    want = set()
    for i in range(400):
        d = np.round(((x - x[i]) ** 2).sum(axis=1), 12)
        best = sorted((d[j], j) for j in range(400) if j != i and cell[j] in probed[i])[:30]  # more than a cell has
        want |= {(i, r, j) for r, (_, j) in enumerate(best, 1)}
    assert {(r["query"], r["rank"], r["id"]) for r in vectors.nearest(rows, rows, 30, index=index).collect()} == want
