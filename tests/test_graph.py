import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcorder.operators import components, generators, graph, ranking, regions, score, search, stability, storage
from arcorder.plans import queries
from arcorder.sources import edges as sources

TINY = [(0, 1, 5), (0, 2, 3), (1, 2, 2), (2, 0, 4), (3, 1, 1), (2, 3, 6)]


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame(TINY, "src long, tgt long, weight long")


def positions(spark, values):
    return spark.createDataFrame([(i, float(p)) for i, p in enumerate(values)], "node long, pos double")


def test_known_score_and_its_complement(spark, tiny):
    one = score.score_from_positions(tiny, positions(spark, [0, 1, 2, 3])).first()
    assert (one["score"], one["total_weight"], one["feedback_weight"]) == (16, 21, 5)
    assert one["pct"] == pytest.approx(76.190476, abs=1e-6)
    order = score.node_ranks(positions(spark, [0, 1, 2, 3]))
    assert score.score_from_order(tiny, score.reverse_order(order)).first()["score"] == 5


def test_ties_nan_and_missing_positions(spark, tiny):
    edge = spark.createDataFrame([(0, 1, 10)], "src long, tgt long, weight long")
    assert score.score_from_positions(edge, positions(spark, [1, 1])).first()["score"] == 0
    assert score.score_from_positions(edge, positions(spark, [0, 1])).first()["score"] == 10
    assert score.score_from_positions(edge, positions(spark, [0, math.nan])).first()["score"] == 0
    with pytest.raises(Exception, match="without a position"):
        score.score_from_positions(tiny, positions(spark, [0, 1])).collect()


def test_unit_weights_sum_exactly(spark):
    edges = spark.range(3_000_001).select(F.lit(0).alias("src"), F.lit(1).alias("tgt"), F.lit(1.0).cast("float").alias("weight"))
    assert score.score_from_positions(edges, positions(spark, [0, 1])).first()["score"] == 3_000_001


def test_order_and_ranks_differ(spark):
    p = positions(spark, [2, 0, 3, 1])
    assert [r["node"] for r in score.order_nodes(p).orderBy("rank").collect()] == [1, 3, 0, 2]
    assert [r["rank"] for r in score.node_ranks(p).orderBy("node").collect()] == [2, 0, 3, 1]


def test_global_rank_and_running_total(spark):
    rows = [(random.Random(1).randint(0, 50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, i long").repartition(7)
    got = [(r["k"], r["i"]) for r in ranking.global_rank(df, "k", "i").orderBy("rank").collect()]
    assert got == sorted(rows)
    total = ranking.running_total(df.withColumn("g", F.col("i") % 3), ["g"], "i", "k", block=16)
    by = {}
    for k, i in sorted(rows, key=lambda r: r[1]):
        by[i] = by.get(("s", i % 3), 0)
        by["s", i % 3] = by[i] + k
    assert all(r["before"] == by[r["i"]] for r in total.collect())


def test_remap_is_dense_and_goes_back(spark):
    rng = random.Random(5)
    ids = rng.sample(range(10**17), 60)
    rows = [(rng.choice(ids), rng.choice(ids), rng.randint(1, 9)) for _ in range(300)]
    raw = spark.createDataFrame(rows, "src long, tgt long, weight long")
    edges, nodes = graph.remap_node_ids(raw)
    place = {v: i for i, v in enumerate(sorted({x for r in rows for x in r[:2]}))}
    assert sorted(map(tuple, edges.select("src", "tgt", "weight").collect())) == sorted((place[a], place[b], w) for a, b, w in rows)
    assert sorted(map(tuple, graph.restore_node_ids(edges, nodes).select("src", "tgt", "weight").collect())) == sorted(rows)


def strong(edges):
    reach = {}
    nodes = {x for e in edges for x in e[:2]}
    for s in nodes:
        seen, todo = {s}, [s]
        while todo:
            u = todo.pop()
            for a, b, *_ in edges:
                if a == u and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[s] = seen
    return {u: frozenset(v for v in reach[u] if u in reach[v]) for u in nodes}


def test_strong_components_against_reachability(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(18), rng.randrange(18), 1) for _ in range(26)]
    got = {}
    for r in components.strongly_connected_components(spark.createDataFrame(rows, "src long, tgt long, weight long")).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert {frozenset(v) for v in got.values()} == set(strong(rows).values())


def greedy(rows, use_abs):
    nodes = sorted({x for r in rows for x in r[:2]})
    active, rank, front, back = set(nodes), {}, 0, len(nodes) - 1
    while active:
        diff = {u: sum(w for a, b, w in rows if a == u and b in active) - sum(w for a, b, w in rows if b == u and a in active) for u in sorted(active)}
        u = max(sorted(active), key=lambda x: abs(diff[x]) if use_abs else diff[x])
        if use_abs and diff[u] <= 0:
            rank[u], back = back, back - 1
        else:
            rank[u], front = front, front + 1
        active.remove(u)
    return rank


@pytest.mark.parametrize("use_abs", [False, True])
def test_greedy_places_by_the_plain_rule(spark, use_abs):
    rng = random.Random(9)
    rows = [(a, b, rng.randint(1, 20)) for a in range(9) for b in range(9) if a != b and rng.random() < 0.5]
    df = spark.createDataFrame([("g", *r) for r in rows], "graph_id string, src long, tgt long, weight long")
    assert {r["node"]: r["rank"] for r in search.order_greedy(df, use_abs).collect()} == greedy(rows, use_abs)


def test_searches_return_permutations_and_never_lose(spark):
    rng = random.Random(2)
    rows = [(a, b, rng.randint(1, 20)) for a in range(20) for b in range(20) if a != b and rng.random() < 0.3]
    edges = spark.createDataFrame(rows, "src long, tgt long, weight long")
    total = sum(r[2] for r in rows)
    start = search.order_simple(edges)
    first = score.score_from_order(edges, start).first()["score"]
    assert first * 2 >= total
    for order in (search.order_peeled(edges), search.local_search(edges, start, rounds=3)):
        assert sorted(r["rank"] for r in order.collect()) == list(range(20))
    assert score.score_from_order(edges, search.local_search(edges, start, rounds=3)).first()["score"] >= first
    best, history = search.run_ordering(edges, search.Config(epochs=6, cycles=1, log_interval=2))
    pct = [r["best_pct"] for r in history.orderBy("iter").collect()]
    assert pct == sorted(pct) and score.score_runs(edges, best).first()["pct"] == pytest.approx(pct[-1])


@pytest.mark.parametrize("small", [200_000, 40])
def test_peeling_places_deep_graphs_whole(spark, small):
    """A path, a tree and a ladder deeper than any fixed number of rounds are acyclic: all weight points forward."""
    ids = random.Random(3).sample(range(10_000), 800)
    path = [(ids[i], ids[i + 1], 1) for i in range(399)]
    ladder = [(ids[400 + i], ids[400 + i + k], 2) for i in range(200) for k in (1, 2)] if small > 40 else []
    tree = [(ids[600 + i // 2], ids[601 + i], 3) for i in range(100)]
    edges = spark.createDataFrame(path + ladder + tree, "src long, tgt long, weight long")
    order = search.order_peeled(edges, small=small)
    nodes = {x for e in path + ladder + tree for x in e[:2]}
    assert {r["node"] for r in order.collect()} == nodes and sorted(r["rank"] for r in order.collect()) == list(range(len(nodes)))
    assert score.score_from_order(edges, order).first()["pct"] == 100


def test_peeling_in_one_task_and_in_rounds_score_alike(spark):
    rng = random.Random(8)
    cyclic = [(a, b, rng.randint(1, 9)) for a in range(60) for b in rng.sample(range(60), 4)] + [(100 + i, 101 + i, 1) for i in range(90)] + [(190, 0, 5)]
    edges = spark.createDataFrame(cyclic, "src long, tgt long, weight long")
    pct = []
    for small in (200_000, 0):
        order = search.order_peeled(edges, small=small)
        assert sorted(r["rank"] for r in order.collect()) == list(range(151))
        pct.append(score.score_from_order(edges, order).first()["pct"])
    assert min(pct) > 60 and abs(pct[0] - pct[1]) < 5


def test_beta_schedule_and_learning_rate():
    betas = search.cyclic_betas(20_000, 5)
    assert len(betas) == 20_000 and min(betas) == pytest.approx(0.05) and max(betas) == pytest.approx(1.05)
    cfg = search.Config(epochs=100)
    assert search.learning_rate(cfg, 0) == cfg.lr and search.learning_rate(cfg, 100) == pytest.approx(cfg.lr * cfg.lr_end_factor)


def test_registered_searches_are_whole(spark, monkeypatch):
    """Each registered search runs all epochs on a graph that grows with the tables, and no two schedules of f13 are alike."""
    seen = []

    def caught(edges, runs, time_limit=None):
        seen.append((edges, runs))
        raise InterruptedError

    monkeypatch.setattr(search, "search", caught)
    for name in ("f9_run_ordering", "f11_multi_start", "f12_init_ablation", "f13_beta_ablation"):
        with pytest.raises(InterruptedError):
            queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    for edges, runs in seen:
        assert edges.count() > 625 and all((c.epochs, c.cycles) == (search.Config().epochs, search.Config().cycles) for _, c in runs.values())
    betas = {v: tuple(round(b, 6) for b in c.betas(c.epochs)) for v, (_, c) in seen[-1][1].items()}
    assert len(set(betas.values())) == len(search.BETA_VARIANTS) and min(betas["cyclic_fast"]) < 0.1
    falls = [b < a for a, b in zip(betas["cyclic_fast"], betas["cyclic_fast"][1:])]
    assert sum(a != b for a, b in zip(falls, falls[1:])) == 19


def test_kendall_and_spearman_extremes(spark):
    rows = [("a", i, float(i)) for i in range(40)] + [("b", i, float(-i)) for i in range(40)] + [("c", i, float(i)) for i in range(40)]
    p = spark.createDataFrame(rows, "run string, node long, pos double")
    tau = {(r["run1"], r["run2"]): (r["discordant"], r["tau"]) for r in stability.kendall_pairs(p).collect()}
    assert tau["a", "b"] == (780, pytest.approx(-1)) and tau["a", "c"] == (0, pytest.approx(1))
    rho = {(r["run1"], r["run2"]): r["rho"] for r in stability.spearman_pairs(p).collect()}
    assert rho["a", "b"] == pytest.approx(-1) and rho["a", "c"] == pytest.approx(1)


def test_density_threshold_keeps_ties(spark):
    e = spark.createDataFrame([(0, 1, 5.0), (1, 0, 3.0), (0, 2, 3.0), (2, 0, 1.0)], "src long, tgt long, weight double")
    assert regions.threshold_to_density(e, 3, 0.34).count() == 3  # k = 2, and the second weight is tied
    assert regions.threshold_to_density(e, 3, 1.0).count() == 4


def test_sources_and_sinks_round_trip(spark, tmp_path, tiny):
    (tmp_path / "g.txt").write_text("1\t2\t0.5\n\n  3   1  1.5")
    assert sorted(map(tuple, sources.read_edges_tsv(spark, str(tmp_path / "g.txt")).collect())) == [(1, 2, 0.5), (3, 1, 1.5)]
    (tmp_path / "g.csv").write_text("Source Node  ID,Target Node ID,Edge Weight\n720575940,5,7\n5,720575940,2\n")
    assert sorted(map(tuple, sources.read_edges_csv(spark, str(tmp_path / "g.csv")).collect())) == [(5, 720575940, 2), (720575940, 5, 7)]
    edges, nodes = graph.remap_node_ids(tiny)
    sources.save_graph(edges, nodes, str(tmp_path / "saved"))
    again, _ = sources.load_saved_graph(spark, str(tmp_path / "saved"))
    assert sorted(map(tuple, again.collect())) == sorted(TINY)
    with pytest.raises(ValueError, match="mouse"):
        sources.load_graph(spark, "mouse", str(tmp_path / "g.txt"))


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src long, tgt long, weight long")
    assert graph.degrees(none).count() == 0 and components.strongly_connected_components(none).count() == 0
    assert graph.remap_node_ids(none)[0].count() == 0


def tarjan_free(edges):
    """Components by plain reachability: the smallest node that each node reaches and is reached by."""
    nodes = {x for e in edges for x in e}
    out = {u: {v for a, v in edges if a == u} for u in nodes}

    def reach(u):
        seen, todo = set(), [u]
        while todo:
            for v in out[todo.pop()] - seen:
                seen.add(v)
                todo.append(v)
        return seen

    r = {u: reach(u) for u in nodes}
    return {u: min([u, *(v for v in r[u] if u in r[v])]) for u in nodes}


@pytest.mark.parametrize("small", [0, 10**6])
def test_components_against_reachability(spark, small):
    rng = random.Random(4)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(45)} | {(100 + i, 100 + (i + 1) % 9) for i in range(9)} | {(7, 100), (104, 200), (200, 201), (300, 300)}
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, tgt long, weight double")
    got = {r["node"]: r["component"] for r in components.strongly_connected_components(df, small=small).collect()}
    assert got == tarjan_free(edges)


@pytest.mark.parametrize("ring", [False, True])
def test_components_of_long_chains_take_few_rounds(spark, ring, monkeypatch):
    n, tables = 1000, []
    monkeypatch.setattr(components, "written", lambda df, name: tables.append(name) or storage.written(df, name))
    order = list(range(n))
    random.Random(2).shuffle(order)
    pairs = list(zip(order, order[1:], strict=False)) + ([(order[-1], order[0])] if ring else [])
    df = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, tgt long, weight double")
    got = {r["node"]: r["component"] for r in components.strongly_connected_components(df, small=0).collect()}
    assert got == ({u: 0 for u in order} if ring else {u: u for u in order})
    assert tables.count("scc-labels") < 70 and tables.count("scc-edges") <= 3 and tables.count("peel-pointers") < 30


def test_a_search_leaves_few_tables(spark):
    folder = Path(storage.shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    df = spark.createDataFrame([(i % 7, (i * 3 + 1) % 7, float(i)) for i in range(30)], "src long, tgt long, weight double")
    best, history = search.run_ordering(df, search.Config(epochs=8, log_interval=2))
    assert best.count() == 7 and history.count() >= 4
    assert len(set(folder.iterdir()) - before) == 1


def greedy_by_scan(edges, use_abs):
    left, front, back = {x for u, v, _ in edges for x in (u, v)}, [], []
    while left:
        d = {x: sum(w for u, v, w in edges if u == x and v in left) - sum(w for u, v, w in edges if v == x and u in left) for x in left}
        x = min(left, key=lambda y: (-(abs(d[y]) if use_abs else d[y]), y))
        (back if use_abs and d[x] <= 0 else front).append(x)
        left.remove(x)
    return {x: i for i, x in enumerate(front + back[::-1])}


@pytest.mark.parametrize("use_abs", [False, True])
def test_greedy_against_plain_scans(spark, use_abs):
    rng = random.Random(5)
    rows = [(g, rng.randrange(12), rng.randrange(12), float(rng.randint(1, 4))) for g in range(5) for _ in range(40)]
    rows = [r for r in rows if r[1] != r[2]]
    got = search.order_greedy(spark.createDataFrame(rows, "graph_id int, src long, tgt long, weight double"), use_abs=use_abs).collect()
    for g in range(5):
        assert {r["node"]: r["rank"] for r in got if r["graph_id"] == g} == greedy_by_scan([r[1:] for r in rows if r[0] == g], use_abs)
    with pytest.raises(ValueError):
        search.order_greedy(spark.createDataFrame(rows, "graph_id int, src long, tgt long, weight double"), max_edges=10)


@pytest.mark.parametrize("small", [0, 10**6])
def test_bulk_greedy_by_absolute_difference(spark, small):
    rng = random.Random(8)
    edges = [(rng.randrange(30), rng.randrange(30), float(rng.randint(1, 9))) for _ in range(150)]
    df = spark.createDataFrame(edges, "src long, tgt long, weight double")
    order = search.order_peeled(df, small=small, use_abs=True)
    rank = {r["node"]: r["rank"] for r in order.collect()}
    assert sorted(rank.values()) == list(range(len({x for e in edges for x in e[:2]})))
    forward = sum(w for u, v, w in edges if rank[u] < rank[v])
    assert forward > 0.6 * sum(w for u, v, w in edges if u != v)


def test_generators_draw_what_they_should(spark):
    rng = np.random.default_rng(1)
    counts = [sum(len(x) for x in generators.hits(rng, 1000, 0.02)) for _ in range(400)]
    assert abs(np.mean(counts) - 20) < 1 and abs(np.var(counts) - 19.6) < 6
    assert np.concatenate(list(generators.hits(rng, 50, 1.0))).tolist() == list(range(50)) and not list(generators.hits(rng, 50, 0.0))
    e = generators.erdos_renyi(spark, 300, 0.05)
    assert e.where("src = tgt OR tgt >= 300").count() == 0 and abs(e.count() - 300 * 299 * 0.05) < 400
    assert {tuple(r) for r in e.collect()} == {tuple(r) for r in generators.erdos_renyi(spark.newSession(), 300, 0.05).repartition(3).collect()}
    c = generators.synthetic_connectome(spark, 300, 0.03, 0.0, 1.0)
    k = {r["node"]: r["degree"] for r in generators.power_law_degrees(spark, 300).collect()}
    out = {r["src"]: r["count"] for r in c.groupBy("src").count().collect()}
    assert np.corrcoef([k[i] for i in range(300)], [out.get(i, 0) for i in range(300)])[0, 1] > 0.8
    assert c.count() == c.select("src", "tgt").distinct().count() and c.where("src = tgt OR tgt >= 300").count() == 0


def test_quantiles_against_numpy(spark):
    values = [random.Random(3).random() for _ in range(101)] + [0.5] * 7
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    got = graph.quantiles(df, "x", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}).first()
    assert [got[k] for k in "abcd"] == pytest.approx(np.quantile(values, [0, 0.37, 0.5, 1]).tolist())
    assert graph.quantiles(df.limit(0), "x", {"a": 0.5}).first()["a"] is None


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "a"})

    with pytest.raises(ValueError):
        storage.shared_dir(Elsewhere)


@pytest.mark.parametrize("order", ["up", "down", "alternating"])
def test_a_ring_of_any_numbering_takes_logarithmic_tables(spark, order, monkeypatch):
    n, tables = 10_000, []
    monkeypatch.setattr(components, "written", lambda df, name: tables.append(name) or storage.written(df, name))
    ring = {"up": np.arange(n), "down": np.arange(n)[::-1], "alternating": np.where(np.arange(n) % 2, n - 1 - np.arange(n) // 2, np.arange(n) // 2)}[order]
    df = spark.createDataFrame(list(zip(ring.tolist(), np.roll(ring, -1).tolist(), [1.0] * n, strict=True)), "src long, tgt long, weight double")
    found = components.strongly_connected_components(df, small=0)
    assert tuple(found.agg(F.max("component"), F.count("*")).first()) == (0, n) and len(tables) <= 60


def test_contraction_keeps_components_between_chains(spark):
    """Two components joined by a chain, a chain that goes back, and one that leaves and returns to the same node."""
    ring = [(i, (i + 1) % 4) for i in range(4)] + [(0, 2), (1, 3)]
    other = [(10 + i, 10 + (i + 1) % 4) for i in range(4)] + [(10, 12), (11, 13)]
    chains = [(3, 20), (20, 21), (21, 10), (2, 30), (30, 31), (31, 0), (12, 40), (40, 12)]
    edges = set(ring + other + chains)
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, tgt long, weight double")
    assert {r["node"]: r["component"] for r in components.strongly_connected_components(df, small=0).collect()} == tarjan_free(edges)


HOT = {"distinct": lambda rng: rng.normal(size=4000), "hot": lambda rng: np.r_[np.ones(3600), rng.normal(size=400)], "few": lambda rng: rng.integers(0, 4, 4000).astype(float)}


@pytest.mark.parametrize("kind", HOT)
def test_order_statistics_of_repeated_values(spark, kind):
    values = HOT[kind](np.random.default_rng(2))
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    ordered = np.sort(values)
    ranks = {f"r{k}": k for k in (0, 17, 399, 400, 2000, 3998, 3999)}
    for small, splitters in ((1 << 20, 63), (100, 7)):
        found = ranking.at_ranks(df, "v", {**ranks, "beyond": 4000}, small, splitters).first().asDict()
        assert found.pop("beyond") is None and found == {k: ordered[r] for k, r in ranks.items()}
    assert [tuple(r) for r in ranking.ranked_values(df, "v").orderBy("rank").collect()] == list(enumerate(ordered.tolist()))


def test_ranks_of_a_hot_value_go_to_many_tasks(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 10 > 0, 1.0).otherwise(F.col("id") / 7).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in ranking.ranked_values(df, "v").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 200_000 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


def test_insertions_gain_what_they_say_and_are_the_best_places(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(30), rng.randrange(30), rng.randint(1, 9)) for _ in range(200)]
    edges = spark.createDataFrame(rows, "src long, tgt long, weight long")
    order = score.node_ranks(search.init_positions(edges, "random", 3))
    place = {r["node"]: r["rank"] for r in order.collect()}
    line = sorted(place, key=place.get)

    def weight(nodes):
        at = {x: k for k, x in enumerate(nodes)}
        return sum(w for a, b, w in rows if at[b] > at[a])

    moves = {r["node"]: r for r in search.insertion_moves(edges, order).collect()}
    for x in line:
        gains = {p: weight(line[:k][:p] + [x] + (line[:k] + line[k + 1 :])[p:] if p <= k else (line[:k] + line[k + 1 :])[:p] + [x] + (line[:k] + line[k + 1 :])[p:]) - weight(line) for k in [place[x]] for p in range(30)}
        top = max(gains.values())
        assert (moves[x]["gain"] == top == gains[moves[x]["place"]]) if top > 0 else x not in moves
    gains = []
    after = search.local_search(edges, order, 4, gains=gains)
    ranks = {r["node"]: r["rank"] for r in after.collect()}
    assert sorted(ranks.values()) == list(range(30)) and gains and weight(sorted(ranks, key=ranks.get)) == weight(line) + sum(gains)


def test_chosen_moves_lie_apart(spark):
    rng = random.Random(7)
    spans = [(i, r, max(0, r + rng.choice([-1, 1]) * rng.randint(1, 60_000)), rng.randint(1, 50)) for i, r in enumerate(rng.sample(range(300_000), 400))]
    moves = spark.createDataFrame([s for s in spans if s[1] != s[2]], "node long, rank long, place long, gain long")
    for seed in (1, 2):
        chosen = sorted((min(r["rank"], r["place"]), max(r["rank"], r["place"])) for r in search.independent_moves(moves, seed).collect())
        assert len(chosen) > 5 and all(a[1] < b[0] for a, b in zip(chosen, chosen[1:]))


def test_one_block_takes_the_same_steps_as_the_search(spark):
    df = spark.createDataFrame([(i % 9, (i * 5 + 2) % 9, float(i % 7 + 1)) for i in range(40)], "src long, tgt long, weight double")
    cfg = search.Config(epochs=6, cycles=1, log_interval=3)
    start = search.init_positions(df, "uniform", 5)
    one = search.search(df, {"a": (1, cfg)}, start=start)[1].where("iter = 5").first()
    two = search.search_blocked(df, {"a": (1, cfg)}, 2, start=start)[1].where("iter = 5").first()
    assert one["loss"] == pytest.approx(two["loss"]) and one["score"] == two["score"]
    parts = search.search_blocked(df, {"a": (1, cfg), "b": (2, cfg)}, 2, block_edges=10)
    assert parts[0].count() == 18 and parts[1].count() == 4


def test_inversions_and_kendall_with_ties(spark):
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 300):
        v = rng.integers(0, 20, n)
        assert stability.inversions(v) == sum(int(v[i] > v[j]) for i in range(n) for j in range(i + 1, n))
    a, b = rng.integers(0, 15, 120), rng.integers(0, 15, 120)
    p = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(a)] + [("b", i, float(x)) for i, x in enumerate(b)], "run string, node long, pos double")
    plain = sum(int((a[i] - a[j]) * (b[i] - b[j]) < 0) for i in range(120) for j in range(i))
    for block in (1 << 16, 16):
        old, stability.BLOCK = stability.BLOCK, block
        try:
            assert stability.kendall_pairs(p).first()["discordant"] == plain
        finally:
            stability.BLOCK = old


def test_scratch_keeps_what_is_named(spark):
    folder = Path(storage.shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    with storage.scratch() as outer:
        storage.written(spark.range(3), "gone")
        with storage.scratch() as inner:
            kept = inner.keep(spark.range(4), "inner")
        assert kept.count() == 4
        final = outer.keep(kept, "final")
    assert final.count() == 4 and len(set(folder.iterdir()) - before) == 1


def test_components_of_pieces_take_few_tables(spark, monkeypatch):
    """Pieces of at most `small` edges are told apart in a few rounds and finished side by side, not by rounds of colours."""
    rng, rows = random.Random(4), []
    for k in range(30):
        rows += [(100 * k + a, 100 * k + b, 1) for a in range(20) for b in rng.sample(range(20), 3)]
    calls = []
    monkeypatch.setattr(components, "written", lambda df, name: calls.append(name) or storage.written(df, name))
    out = components.strongly_connected_components(spark.createDataFrame(rows, "src long, tgt long, weight long"), small=100)
    got = {}
    for r in out.collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert {frozenset(v) for v in got.values()} == set(strong(rows).values()) and all(c == min(v) for c, v in got.items())
    assert calls.count("scc-labels") <= 8


def test_search_in_chunks_takes_the_steps_of_the_gradient(spark, monkeypatch):
    """Edges in many small blocks give the same epochs as plain gradient steps; an epoch writes one table."""
    df = spark.createDataFrame([(i % 23, (i * 7 + 3) % 29, i % 5 + 1) for i in range(300)], "src long, tgt long, weight long")
    cfg = search.Config(epochs=4, cycles=1, log_interval=1)
    names = []
    monkeypatch.setattr(search, "PIECE", 20)
    monkeypatch.setattr(search, "written", lambda df, name: names.append(name) or storage.written(df, name))
    history = {r["iter"]: r for r in search.search(df, {"a": (3, cfg)})[1].collect()}
    assert names.count("search-state") == 1 + 5
    norm = graph.normalise_weights(df)
    state = search.init_positions(df, "random", 3).select(F.lit("a").alias("run"), "node", "pos", F.lit(0.0).alias("m"), F.lit(0.0).alias("v"))
    for i, beta in enumerate(search.cyclic_betas(4, 1)):
        grad = score.surrogate_gradient(norm, state.select("run", "node", "pos"), beta)
        state = storage.written(search.adam_step(state, grad, search.learning_rate(cfg, i), i + 1), "by-hand")
        positions = state.select("node", "pos")
        assert score.score_from_positions(df, positions).first()["score"] == history[i]["score"]
        assert score.surrogate_loss(norm, positions, beta).first()["loss"] == pytest.approx(history[i]["loss"])


def test_one_epoch_an_exchange_is_exact_in_any_blocks(spark):
    df = spark.createDataFrame([(i % 23, (i * 7 + 3) % 29, i % 5 + 1) for i in range(300)], "src long, tgt long, weight long")
    cfg = search.Config(epochs=3, cycles=1, log_interval=1)
    one = search.search(df, {"a": (3, cfg)})[1].orderBy("iter").collect()
    two = search.search_blocked(df, {"a": (3, cfg)}, 3, block_edges=20)[1].orderBy("iter").collect()
    assert two[0]["loss"] == pytest.approx(one[0]["loss"]) and two[0]["score"] == one[0]["score"]
    assert [r["loss"] for r in two] == pytest.approx([r["loss"] for r in one])
