"""Bipartite access graph: users authenticate on computers; one edge per pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authscope.functions import expressions as X
from authscope.session import cut

MAX_HOPS, SAMPLE = 6, 25


def build(events: DataFrame, labels: DataFrame, start_day: int | None = None, end_day: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, computers, edges) of the days from start_day up to end_day, the latter left out. Labels of those days
    mark edges and nodes, they never add any; computers are destinations only."""
    known = events.filter("src_user is not null and dst_computer is not null")
    for bound, day in ((F.col("event_date") >= X.date_of(F.lit(start_day)), start_day), (F.col("event_date") < X.date_of(F.lit(end_day)), end_day)):
        known, labels = (known, labels) if day is None else (known.filter(bound), labels.filter(bound))
    attack = labels.select(F.col("user").alias("_u"), F.col("src_computer").alias("_s"), F.col("dst_computer").alias("_d"))
    edges = known.groupBy(F.col("src_user").alias("user"), F.col("dst_computer").alias("computer")).agg(
        F.count("*").alias("count"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen"), F.sum(F.when(F.col("is_success"), 1).otherwise(0)).alias("_ok")
    )
    pairs = attack.select("_u", "_d").distinct().withColumn("_hit", F.lit(True))
    edges = edges.join(pairs, (F.col("user") == F.col("_u")) & (F.col("computer") == F.col("_d")), "left").select(
        "user", "computer", "count", "first_seen", "last_seen", F.round(F.col("_ok") / F.col("count"), 4).alias("success_ratio"), F.col("_hit").isNotNull().alias("is_redteam")
    )
    users = edges.select(F.col("user").alias("name")).distinct().withColumn("is_machine", X.is_machine(F.col("name")))
    users = users.join(attack.select(F.col("_u").alias("name")).distinct().withColumn("_hit", F.lit(True)), "name", "left").select("name", F.col("_hit").isNotNull().alias("is_compromised"), "is_machine")
    computers = edges.select(F.col("computer").alias("name")).distinct()
    for column, flag in (("_s", "is_redteam_pivot"), ("_d", "is_redteam_target")):
        marked = attack.select(F.col(column).alias("name")).distinct().withColumn(flag, F.lit(True))
        computers = computers.join(marked, "name", "left").fillna(False, [flag])
    return users, computers, edges


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(src, dst, hops, path, weights, any_redteam) for user pairs that are connected within max_hops, undirected.

    One breadth-first search for every source, a join a hop; of equally short paths the smallest by name is taken.
    What a source has visited is left out, and a source whose pairs are all found rests.
    """
    step = edges.select(F.col("user").alias("_from"), F.col("computer").alias("_to"), "count", "is_redteam")
    step = step.unionByName(edges.select(F.col("computer").alias("_from"), F.col("user").alias("_to"), "count", "is_redteam"))
    step = cut(step)
    pairs = pairs.select("src", "dst").distinct()
    front = pairs.select("src").distinct().withColumns({"node": F.col("src"), "path": F.array("src"), "weights": F.array().cast("array<bigint>"), "any_redteam": F.lit(False)})
    seen = front.select("src", "node")
    found = front.join(pairs.filter("src = dst"), "src").withColumn("hops", F.lit(0))
    left = pairs.filter("src <> dst")
    for hop in range(1, max_hops + 1):
        moved = front.join(left.select("src").distinct(), "src", "left_semi").join(step, F.col("node") == F.col("_from")).select(
            "src", F.col("_to").alias("node"), F.concat("path", F.array("_to")).alias("path"), F.concat("weights", F.array("count")).alias("weights"),
            (F.col("any_redteam") | F.col("is_redteam")).alias("any_redteam"),
        )
        moved = moved.join(seen, ["src", "node"], "left_anti")
        front = cut(moved.groupBy("src", "node").agg(F.min(F.struct("path", "weights", "any_redteam")).alias("b")).select("src", "node", "b.*"))
        arrived = front.join(left.withColumnRenamed("dst", "node"), ["src", "node"]).withColumns({"dst": F.col("node"), "hops": F.lit(hop)})
        found = found.unionByName(arrived.select(*found.columns))
        left = cut(left.join(arrived.select("src", "dst"), ["src", "dst"], "left_anti"))
        if left.isEmpty() or front.isEmpty():
            break
        seen = seen.unionByName(front.select("src", "node"))
    return found.select("src", "dst", "hops", "path", "weights", "any_redteam")


def hop_histogram(paths: DataFrame) -> DataFrame:
    return paths.groupBy("hops").agg(F.count("*").alias("paths"))


def blast_radius(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Hosts at one hop, peers that share a host, hosts at three hops, for all starts at once.

    No edge is walked twice: a host counts at the third hop if it is reached over a shared host other than itself.
    With two shared hosts every host of the peer qualifies, with one every host but that one.
    """
    links = edges.select("user", "computer")
    first = starts.select(F.col("name").alias("start")).distinct().join(links, F.col("start") == F.col("user")).select("start", F.col("computer").alias("c1"))
    rank = F.row_number().over(Window.partitionBy("start").orderBy("c1"))
    hop1 = first.withColumn("_n", rank).groupBy("start").agg(F.count("*").alias("hop1_hosts"), F.sort_array(F.collect_list(F.when(F.col("_n") <= SAMPLE, F.col("c1")))).alias("hop1_sample"))
    shared = first.join(links, (F.col("c1") == F.col("computer")) & (F.col("start") != F.col("user"))).groupBy("start", F.col("user").alias("peer")).agg(F.count("*").alias("_shared"), F.min("c1").alias("_only"))
    hop2 = shared.groupBy("start").agg(F.count("*").alias("hop2_peers"))
    third = shared.join(links, F.col("peer") == F.col("user")).filter((F.col("_shared") > 1) | (F.col("computer") != F.col("_only")))
    hop3 = third.groupBy("start").agg(F.countDistinct("computer").alias("hop3_hosts"))
    out = starts.select(F.col("name").alias("start")).distinct().join(hop1, "start", "left").join(hop2, "start", "left").join(hop3, "start", "left")
    return out.fillna(0, ["hop1_hosts", "hop2_peers", "hop3_hosts"])


def movement(users: DataFrame, edges: DataFrame) -> DataFrame:
    """Labelled edges of compromised users, in order of time."""
    hit = edges.filter("is_redteam").join(users.filter("is_compromised").select(F.col("name").alias("user")), "user")
    return hit.select(F.col("user").alias("attacker_identity"), F.col("computer").alias("compromised_host"), F.col("count").alias("auth_events_on_edge"), "success_ratio", F.col("first_seen").alias("first_seen_seconds")).orderBy(
        "first_seen_seconds", "attacker_identity", "compromised_host"
    )


def attacker_footprint(users: DataFrame, edges: DataFrame, top: int = 25) -> DataFrame:
    """Hosts over labelled edges against all hosts of every compromised user, in one pass."""
    own = edges.join(users.filter("is_compromised").select(F.col("name").alias("user")), "user").groupBy(F.col("user").alias("identity")).agg(
        F.count_if("is_redteam").alias("hosts_via_redteam_edges"), F.count("*").alias("hosts_total_footprint")
    )
    share = F.round(F.lit(100.0) * F.col("hosts_via_redteam_edges") / F.col("hosts_total_footprint"), 1)
    return own.withColumn("pct_of_footprint_that_was_attack", share).orderBy(F.desc("hosts_via_redteam_edges"), "identity").limit(top)


def choke_points(computers: DataFrame, edges: DataFrame, top: int = 25) -> DataFrame:
    """Hosts on which most identities meet."""
    shared = edges.groupBy(F.col("computer").alias("name")).agg(F.count("*").alias("identities_authenticating_here")).filter("identities_authenticating_here > 1")
    out = shared.join(computers, "name").select(F.col("name").alias("host"), "identities_authenticating_here", F.col("is_redteam_pivot").alias("was_redteam_pivot"), F.col("is_redteam_target").alias("was_redteam_target"))
    return out.orderBy(F.desc("identities_authenticating_here"), "host").limit(top)


def counts(users: DataFrame, computers: DataFrame, edges: DataFrame) -> DataFrame:
    both = edges.agg(F.count("*").alias("edges"), F.count_if("is_redteam").alias("redteam_edges"))
    return users.agg(F.count("*").alias("users")).crossJoin(computers.agg(F.count("*").alias("computers"))).crossJoin(both)


def top_attackers(users: DataFrame, edges: DataFrame, n: int = 8) -> DataFrame:
    hit = edges.filter("is_redteam").join(users.filter("is_compromised").select(F.col("name").alias("user")), "user")
    return hit.groupBy(F.col("user").alias("name")).agg(F.count("*").alias("redteam_edges")).orderBy(F.desc("redteam_edges"), "name").limit(n)


def control_group(users: DataFrame, edges: DataFrame, skip: int = 50, n: int = 8) -> DataFrame:
    """Ordinary people of high degree, below the very busiest."""
    ordinary = users.filter("not is_compromised and not is_machine").select(F.col("name").alias("user"))
    degree = edges.join(ordinary, "user").groupBy(F.col("user").alias("name")).agg(F.count("*").alias("degree"))
    return degree.orderBy(F.desc("degree"), "name").offset(skip).limit(n)


def path_pairs(attackers: list[str], targets: list[str], limit: int = 40) -> list[tuple[str, str]]:
    """Each attacker with the later attackers, then with the targets."""
    out = [(a, b) for i, a in enumerate(attackers) for b in [*attackers[i + 1 :], *targets] if a != b]
    return list(dict.fromkeys(out))[:limit]


def attack_subgraph(computers: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that are labelled, or land on a pivot or target."""
    marked = computers.filter("is_redteam_pivot or is_redteam_target").select(F.col("name").alias("computer"), F.lit(True).alias("_marked"))
    return edges.join(marked, "computer", "left").filter(F.col("is_redteam") | F.col("_marked")).drop("_marked")


def paths_json(paths: DataFrame) -> DataFrame:
    """One JSON text per found path, for export: its nodes with their kind, and its edges with weight."""
    kind = lambda x, i: F.struct(x.alias("name"), F.when(i % 2 == 0, "user").otherwise("computer").alias("kind"))
    steps = F.zip_with(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))), F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("from"), b.alias("to")))
    edges = F.zip_with(steps, "weights", lambda s, w: F.struct(s["from"].alias("from"), s["to"].alias("to"), w.alias("count")))
    return paths.select("src", "dst", F.to_json(F.struct("src", "dst", "hops", F.transform("path", kind).alias("nodes"), edges.alias("edges"), "any_redteam")).alias("json"))


def subgraph_json(users: DataFrame, computers: DataFrame, edges: DataFrame) -> DataFrame:
    """The attack subgraph for export: one JSON text per edge, and per node that is on one."""
    chosen = attack_subgraph(computers, edges)
    nodes = users.join(chosen.select(F.col("user").alias("name")).distinct(), "name").select("name", F.to_json(F.struct("name", F.lit("user").alias("kind"), "is_compromised", "is_machine")).alias("json"))
    hosts = computers.join(chosen.select(F.col("computer").alias("name")).distinct(), "name").select("name", F.to_json(F.struct("name", F.lit("computer").alias("kind"), "is_redteam_pivot", "is_redteam_target")).alias("json"))
    lines = chosen.select(F.concat_ws(">", "user", "computer").alias("name"), F.to_json(F.struct("user", "computer", "count", "success_ratio", "is_redteam")).alias("json"))
    part = lambda df, what: df.select(F.lit(what).alias("part"), "name", "json")
    return part(nodes, "node").unionByName(part(hosts, "node")).unionByName(part(lines, "edge"))


def saturation(compromised: list[int], control: list[int], hosts: int, least_ratio: float = 1.5, coverage: float = 0.9) -> dict:
    """Whether reach tells attackers from others: their mean must be larger by a ratio, and must not cover the graph."""
    mean = lambda x: sum(x) / len(x) if x else 0.0
    a, b = mean(compromised), mean(control)
    ratio = a / b if b else None
    return {"ratio": ratio, "coverage": a / hosts if hosts else None, "discriminates": bool(ratio and ratio >= least_ratio and hosts and a / hosts < coverage)}
