"""One registered query for each operator, with the SQL that checks it where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from arcorder.functions import columns as fn
from arcorder.functions.columns import equal_bins
from arcorder.operators import components, generators, geometry, graph, history, regions, score, search, stability
from arcorder.operators.storage import shared_dir
from arcorder.plans import fixtures as fx
from arcorder.plans.fixtures import frame, plain
from arcorder.sources import edges as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False, **tables: str):
    """Register a query under its function's name; `tables` name the common table expressions of its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            heads = ", ".join(f"{name} AS ({plain(text)})" for name, text in tables.items())
            # SQL that starts with a comma goes on with further common table expressions
            ORACLES[fn.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{heads} " if heads else "") + sql.strip()
        return fn

    return add


def r6(column):
    return F.round(column, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


# --- sources and sinks: each writes what it derives from the tables to the shared folder and reads it back -----------


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT src, tgt, weight FROM edges", edges=fx.PART_FLOW)
def a1_read_csv(spark, d):
    path = _folder(spark, "a1")
    frame(spark, d, fx.PART_FLOW).toDF(*sources.CSV_COLUMNS).write.option("header", True).option("compression", "gzip").csv(path)
    return sources.read_edges_csv(spark, path)


@query("SELECT src, tgt, weight FROM edges", edges=fx.USER_FLOW)
def a2_read_tsv(spark, d):
    path = _folder(spark, "a2")
    frame(spark, d, fx.USER_FLOW).select(F.concat_ws("\t", "src", "tgt", "weight").alias("value")).write.text(path)
    return sources.read_edges_tsv(spark, path)


@query(
    "SELECT s.idx AS src, t.idx AS tgt, weight, s.node AS src_id FROM edges JOIN dict s ON edges.src = s.node JOIN dict t ON edges.tgt = t.node",
    edges=fx.USER_FLOW, dict="SELECT node, ROW_NUMBER() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM edges UNION SELECT tgt FROM edges)",
)
def a4_saved_graph(spark, d):
    path = _folder(spark, "a4")
    sources.save_graph(*graph.remap_node_ids(frame(spark, d, fx.USER_FLOW)), path)
    edges, nodes = sources.load_saved_graph(spark, path)
    return edges.join(nodes.toDF("src", "src_id"), "src").select("src", "tgt", "weight", "src_id")


@query(
    "SELECT s.idx AS src, t.idx AS tgt, weight FROM edges JOIN dict s ON edges.src = s.node JOIN dict t ON edges.tgt = t.node",
    edges=fx.MIXED_FLOW, dict="SELECT node, ROW_NUMBER() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM edges UNION SELECT tgt FROM edges)",
)
def a3_load_graph(spark, d):
    path, edges = _folder(spark, "a3"), frame(spark, d, fx.MIXED_FLOW)
    edges.toDF(*sources.CSV_COLUMNS).write.option("header", True).csv(path)
    s = graph.degree_stats(edges).first()
    return sources.load_graph(spark, "written", path, spec=sources.Dataset("csv", s["n_nodes"], s["n_edges"], s["total_weight"]))[0]


@query("SELECT algo, dataset, seed, score, run_no AS n_epochs_done FROM r QUALIFY ROW_NUMBER() OVER (PARTITION BY algo, dataset ORDER BY score DESC, run_no) = 1", r=fx.RUNS)
def a5_read_runs(spark, d):
    """The best run of each group as one JSON file each, read back by a glob."""
    path = _folder(spark, "a5")
    best = history.best_of(frame(spark, d, fx.RUNS), ["algo", "dataset"], "score", "run_no").withColumnRenamed("run_no", "n_epochs_done")
    best.select("algo", "dataset", "seed", "score", "n_epochs_done").write.option("maxRecordsPerFile", 1).json(path)
    return sources.read_runs(spark, f"{path}/*.json").select("algo", "dataset", "seed", "score", "n_epochs_done")


@query(
    """SELECT STRFTIME(stamp, '%Y%m%dT%H%M%SZ') || '-' || algo || '-' || dataset || '-s' || CAST(seed AS VARCHAR) || '-' || SUBSTRING(config_hash, 1, 6) AS exp_id,
  algo, dataset, seed, score, wall_clock_s, git_commit, 'spark' AS engine, CAST(NULL AS VARCHAR) AS cuda FROM r""",
    r=fx.RUNS,
)
def a6_run_records(spark, d):
    path = _folder(spark, "a6")
    sources.write_runs(history.build_records(frame(spark, d, fx.RUNS), F.col("stamp"), {"python": "3", "jax_or_torch": "spark", "cuda": None, "gpu": "none"}), path)
    back = sources.read_runs(spark, path, multi_line=False)
    return back.select("exp_id", "algo", "dataset", "seed", "score", "wall_clock_s", "git_commit", F.col("env.jax_or_torch").alias("engine"), F.col("env.cuda").alias("cuda"))


@query("SELECT node, pos FROM p WHERE run = 'scatter'", p=fx.POSITIONS_BY_RUN)
def a7_positions(spark, d):
    path = _folder(spark, "a7")
    sources.write_positions(frame(spark, d, fx.POSITIONS_BY_RUN), path)
    return sources.read_positions(spark, path, "scatter").select("node", "pos")


@query("SELECT run, CAST(COUNT(*) AS BIGINT) AS n, MAX(score) AS best FROM h GROUP BY run", h=fx.HISTORY)
def a8_result_table(spark, d):
    path = _folder(spark, "a8")
    sources.write_table(frame(spark, d, fx.HISTORY).groupBy("run").agg(F.count("*").alias("n"), F.max("score").alias("best")), path, "csv")
    return spark.read.schema("run bigint, n bigint, best double").option("header", True).csv(path)


@query("SELECT exp_id, src_region, tgt_region, value FROM raw WHERE exp_id % 3 = 2 AND exp_id % 2 = 1", raw=fx.PROJECTIONS)
def a9_projections(spark, d):
    path = _folder(spark, "a9")
    rows = frame(spark, d, fx.PROJECTIONS).selectExpr("exp_id", "src_region", "tgt_region", "INT(exp_id % 3) AS hemisphere", "value", "exp_id % 2 = 0 AS cre")
    rows.write.option("header", True).csv(path)
    return sources.read_projections(spark, path, hemisphere=2, cre=False).select("exp_id", "src_region", "tgt_region", "value")


# --- preparation -----------------------------------------------------------------------------------------------------

DEGREES = """deg AS (SELECT node, CAST(SUM(1 - o) AS BIGINT) AS in_deg, CAST(SUM(o) AS BIGINT) AS out_deg, COUNT(*) AS total_deg,
  SUM(CASE WHEN o = 0 THEN weight ELSE 0 END) AS in_w, SUM(CASE WHEN o = 1 THEN weight ELSE 0 END) AS out_w
  FROM (SELECT src AS node, 1 AS o, weight FROM edges UNION ALL SELECT tgt, 0, weight FROM edges) e GROUP BY node)"""


@query("SELECT src AS node FROM edges UNION SELECT tgt FROM edges", edges=fx.PART_FLOW)
def b3_nodes(spark, d):
    return graph.nodes_of(frame(spark, d, fx.PART_FLOW))


@query(
    "SELECT s.idx AS src, t.idx AS tgt, weight FROM edges JOIN dict s ON edges.src = s.node JOIN dict t ON edges.tgt = t.node",
    edges=fx.PART_FLOW, dict="SELECT node, ROW_NUMBER() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM edges UNION SELECT tgt FROM edges)",
)
def b1_remap(spark, d):
    return graph.remap_node_ids(frame(spark, d, fx.PART_FLOW))[0]


@query("SELECT src, tgt, weight FROM edges", edges=fx.PART_FLOW)
def b2_restore(spark, d):
    return graph.restore_node_ids(*graph.remap_node_ids(frame(spark, d, fx.PART_FLOW)))


@query("SELECT src, tgt, weight, ROUND(CAST(weight AS DOUBLE) / (SELECT MAX(weight) FROM edges), 6) AS norm_weight FROM edges", edges=fx.PART_FLOW)
def b4_normalise(spark, d):
    return rounded(graph.normalise_weights(frame(spark, d, fx.PART_FLOW)), "norm_weight")


@query("SELECT src, tgt, CAST(SUM(weight) AS BIGINT) AS weight FROM steps GROUP BY src, tgt", steps=fx.STEPS)
def b5_adjacency(spark, d):
    return graph.adjacency(frame(spark, d, fx.STEPS))


@query("""SELECT id AS src, CAST(i - 1 AS BIGINT) AS tgt, ROUND(CAST(x AS DOUBLE), 6) AS weight
FROM (SELECT id, UNNEST(e) AS x, generate_subscripts(e, 1) AS i FROM f) t WHERE x > 0""", f=fx.FEATURES)
def b6_matrix_to_edges(spark, d):
    return rounded(graph.matrix_to_edges(frame(spark, d, fx.FEATURES), "id", "e"), "weight")


@query(
    """SELECT src, CAST(k AS BIGINT) AS tgt, CAST(COALESCE(weight, 0) AS DOUBLE) AS weight
FROM (SELECT s.src, k, (SELECT weight FROM edges e WHERE e.src = s.src AND e.tgt = k) AS weight FROM (SELECT DISTINCT src FROM edges) s, (SELECT UNNEST(GENERATE_SERIES(0, 24)) AS k))""",
    edges=fx.NATION_FLOW,
)
def b6_edges_to_matrix(spark, d):
    """The way back: one array a source, here taken apart again."""
    rows = graph.edges_to_matrix(frame(spark, d, fx.NATION_FLOW).withColumn("weight", F.col("weight").cast("double")), 25)
    return rows.select("src", F.posexplode("values").alias("tgt", "weight")).withColumn("tgt", F.col("tgt").cast("long"))


@query("SELECT src, tgt, weight, s.pos AS pos_src, t.pos AS pos_tgt FROM edges JOIN p s ON src = s.node JOIN p t ON tgt = t.node", edges=fx.PART_FLOW, p=fx.POSITIONS)
def b7_with_positions(spark, d):
    return score.with_positions(frame(spark, d, fx.PART_FLOW), frame(spark, d, fx.POSITIONS), check=True).select("src", "tgt", "weight", "pos_src", "pos_tgt")


@query(
    f""", {DEGREES}, ranked AS (SELECT node, ROW_NUMBER() OVER (ORDER BY out_deg DESC, node) - 1 AS rk FROM deg)
SELECT s.rk AS "row", t.rk AS "col", ROUND(LN(1 + weight), 6) AS value FROM edges JOIN ranked s ON src = s.node JOIN ranked t ON tgt = t.node""",
    edges=fx.USER_FLOW,
)
def b8_ordered_adjacency(spark, d):
    return rounded(graph.ordered_adjacency(frame(spark, d, fx.USER_FLOW)), "value")


# --- regions ---------------------------------------------------------------------------------------------------------

CLIPPED = "SELECT exp_id, src_region, tgt_region, CASE WHEN value > 0 THEN value ELSE 0 END AS value FROM raw"
MEANS = """SELECT s.src_region AS src, tgt_region AS tgt, total / n AS weight
FROM (SELECT src_region, tgt_region, SUM(value) AS total FROM clipped GROUP BY src_region, tgt_region) s
JOIN (SELECT src_region, COUNT(DISTINCT exp_id) AS n FROM clipped GROUP BY src_region) c ON s.src_region = c.src_region"""
SQUARE = "SELECT src, tgt, weight FROM means WHERE src <> tgt AND src IN (SELECT tgt FROM means) AND tgt IN (SELECT src FROM means)"


def _means(spark, d):
    return regions.replicate_mean(regions.clip_negative(frame(spark, d, fx.PROJECTIONS)))


@query("SELECT * FROM clipped", raw=fx.PROJECTIONS, clipped=CLIPPED)
def d1_clip_negative(spark, d):
    return regions.clip_negative(frame(spark, d, fx.PROJECTIONS))


@query("SELECT src, tgt, ROUND(weight, 6) AS weight FROM means", raw=fx.PROJECTIONS, clipped=CLIPPED, means=MEANS)
def d2_replicate_mean(spark, d):
    return rounded(_means(spark, d), "weight")


@query("SELECT src, tgt, ROUND(weight, 6) AS weight FROM sq", raw=fx.PROJECTIONS, clipped=CLIPPED, means=MEANS, sq=SQUARE)
def d3_square_submatrix(spark, d):
    return rounded(regions.square_submatrix(_means(spark, d)), "weight")


@query(
    """SELECT src, tgt, ROUND(weight, 6) AS weight FROM sq, (SELECT CAST(FLOOR(0.3 * COUNT(*) * (COUNT(*) - 1)) AS BIGINT) AS k FROM (SELECT src FROM means INTERSECT SELECT tgt FROM means))
QUALIFY RANK() OVER (ORDER BY weight DESC) <= k""",
    raw=fx.PROJECTIONS, clipped=CLIPPED, means=MEANS, sq=SQUARE,
)
def d4_threshold_to_density(spark, d):
    square = regions.square_submatrix(_means(spark, d))
    n = graph.nodes_of(square).count()
    return rounded(regions.threshold_to_density(square, n, 0.3), "weight")


# --- statistics ------------------------------------------------------------------------------------------------------


def deg_query(sql: str, edges: str = fx.PART_FLOW, **more: str):
    return query(f", {DEGREES} {sql}", edges=edges, **more)


@deg_query("SELECT node, in_deg, out_deg, total_deg, CAST(in_w AS BIGINT) AS in_w, CAST(out_w AS BIGINT) AS out_w FROM deg")
def c1_degrees(spark, d):
    return graph.degrees(frame(spark, d, fx.PART_FLOW))


@deg_query(
    """SELECT n_nodes, ROUND(mean_in, 6) AS mean_in_degree, ROUND(mean_in, 6) AS mean_out_degree, max_in_degree, max_out_degree, n_sources, n_sinks, n_edges, total_weight,
  weight_min, weight_median, ROUND(weight_mean, 6) AS weight_mean, weight_max, weight_p99, ROUND(n_edges / (CAST(n_nodes AS DOUBLE) * (n_nodes - 1)), 9) AS density
FROM (SELECT COUNT(*) AS n_nodes, AVG(in_deg) AS mean_in, MAX(in_deg) AS max_in_degree, MAX(out_deg) AS max_out_degree,
        COUNT(*) FILTER (in_deg = 0) AS n_sources, COUNT(*) FILTER (out_deg = 0) AS n_sinks FROM deg),
  (SELECT COUNT(*) AS n_edges, CAST(SUM(weight) AS BIGINT) AS total_weight, MIN(weight) AS weight_min, QUANTILE_CONT(weight, 0.5) AS weight_median, AVG(weight) AS weight_mean,
        MAX(weight) AS weight_max, QUANTILE_CONT(weight, 0.99) AS weight_p99 FROM edges)"""
)
def c2_degree_stats(spark, d):
    out = graph.degree_stats(frame(spark, d, fx.PART_FLOW))
    return rounded(out, "mean_in_degree", "mean_out_degree", "weight_mean").withColumn("density", F.round("density", 9))


@deg_query("SELECT 'source' AS kind, node FROM deg WHERE in_deg = 0 UNION ALL SELECT 'sink', node FROM deg WHERE out_deg = 0", edges=fx.UP_FLOW)
def c3_sources_sinks(spark, d):
    edges = frame(spark, d, fx.UP_FLOW)
    return graph.sources(edges).select(F.lit("source").alias("kind"), "node").unionByName(graph.sinks(edges).select(F.lit("sink").alias("kind"), "node"))


@deg_query("SELECT in_deg AS degree, COUNT(*) AS n, ROUND(COUNT(*) * CAST(100 AS DOUBLE) / (SELECT COUNT(*) FROM deg), 6) AS pct FROM deg WHERE in_deg > 0 GROUP BY in_deg")
def c4_degree_distribution(spark, d):
    return rounded(graph.degree_distribution(frame(spark, d, fx.PART_FLOW)), "pct")


@deg_query("SELECT out_deg - in_deg AS diff, COUNT(*) AS n, ROUND(COUNT(*) * CAST(100 AS DOUBLE) / (SELECT COUNT(*) FROM deg), 6) AS pct FROM deg GROUP BY out_deg - in_deg")
def c5_degree_diff_distribution(spark, d):
    return rounded(graph.degree_diff_distribution(frame(spark, d, fx.PART_FLOW)), "pct")


def hist_sql(source: str, column: str, bins: int, extra: str = "") -> str:
    return f"""SELECT bin, COUNT(*) AS n, ROUND(lo0 + bin * ((hi0 - lo0) / {bins}), 6) AS lo{extra} FROM (
  SELECT lo0, hi0, n0, CAST(LEAST(FLOOR((x - lo0) / ((hi0 - lo0) / {bins})), {bins - 1}) AS BIGINT) AS bin
  FROM (SELECT CAST({column} AS DOUBLE) AS x FROM {source}), (SELECT CAST(MIN({column}) AS DOUBLE) AS lo0, CAST(MAX({column}) AS DOUBLE) AS hi0, COUNT(*) AS n0 FROM {source}))
GROUP BY bin, lo0, hi0, n0"""


@query(hist_sql("edges", "weight", 60), edges=fx.PART_FLOW)
def c6_weight_histogram(spark, d):
    return rounded(graph.histogram(frame(spark, d, fx.PART_FLOW), "weight", 60), "lo")


@query(hist_sql("body", "weight", 30), edges=fx.PART_FLOW, body="SELECT weight FROM edges WHERE weight <= (SELECT QUANTILE_CONT(weight, 0.99) FROM edges)")
def c6_body_histogram(spark, d):
    edges = frame(spark, d, fx.PART_FLOW)
    cut = graph.quantiles(edges, "weight", {"cut": 0.99})
    return rounded(graph.histogram(edges.crossJoin(F.broadcast(cut)).where("weight <= cut"), "weight", 30), "lo")


@query(hist_sql("logs", "lw", 40, ", ROUND(COUNT(*) / (n0 * ((hi0 - lo0) / 40)), 6) AS density"), edges=fx.NATION_FLOW, logs="SELECT LN(weight) AS lw FROM edges")
def c7_log_weight_density(spark, d):
    logs = frame(spark, d, fx.NATION_FLOW).select(F.ln("weight").alias("lw"))
    return rounded(graph.histogram(logs, "lw", 40, density=True), "lo", "density")


@query(
    """SELECT CAST(LEAST(FLOOR((z + 10) / (CAST(15 AS DOUBLE) / 69)), 68) AS BIGINT) AS bin, COUNT(*) AS n
FROM (SELECT LN(weight / (SELECT STDDEV_POP(weight) FROM edges)) AS z FROM edges) t WHERE z BETWEEN -10 AND 5 GROUP BY 1""",
    edges=fx.USER_FLOW,
)
def c7_normed_shape(spark, d):
    pool = graph.connectome_stats(frame(spark, d, fx.USER_FLOW))[1].select(F.ln("weight_normed").alias("z")).where("z BETWEEN -10 AND 5")
    return pool.groupBy(equal_bins(F.col("z"), F.lit(-10.0), F.lit(5.0), 69).alias("bin")).agg(F.count("*").alias("n"))


@query(
    """SELECT COUNT(*) AS n_edges, COUNT(*) FILTER (src = tgt) AS self_loops,
  CAST((SELECT COALESCE(SUM(c - 1), 0) FROM (SELECT COUNT(*) AS c FROM edges GROUP BY src, tgt)) AS BIGINT) AS duplicates,
  COUNT(*) FILTER (EXISTS (SELECT 1 FROM edges b WHERE b.src = a.tgt AND b.tgt = a.src)) AS bidirectional,
  ROUND(COUNT(*) FILTER (EXISTS (SELECT 1 FROM edges b WHERE b.src = a.tgt AND b.tgt = a.src)) * CAST(100 AS DOUBLE) / COUNT(*), 6) AS bidirectional_pct FROM edges a""",
    edges=fx.STEPS,
)
def c8_reciprocity(spark, d):
    return rounded(graph.reciprocity(frame(spark, d, fx.STEPS)), "bidirectional_pct")


REACH = """, reach(a, b) AS (SELECT src, tgt FROM edges UNION SELECT reach.a, e.tgt FROM reach JOIN edges e ON reach.b = e.src),
nodes AS (SELECT src AS node FROM edges UNION SELECT tgt FROM edges),
scc AS (SELECT node, LEAST(node, COALESCE((SELECT MIN(r.b) FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a WHERE r.a = node), node)) AS component FROM nodes)"""


@query(f"{REACH} SELECT node, component FROM scc", recursive=True, edges=fx.MIXED_FLOW)
def c9_scc_bulk(spark, d):
    """By rounds of bulk work down to 1,000 edges, as a graph of more than 200,000 takes."""
    return components.strongly_connected_components(frame(spark, d, fx.MIXED_FLOW), small=1000)


@query(
    f"""{REACH}, sizes AS (SELECT COUNT(*) AS size FROM scc GROUP BY component)
SELECT (SELECT COUNT(*) FROM nodes) AS n_nodes, (SELECT COUNT(*) FROM edges) AS n_edges, COUNT(*) AS n_scc, MAX(size) AS largest_scc, ROUND(MAX(size) / CAST(SUM(size) AS DOUBLE), 9) AS largest_scc_frac FROM sizes""",
    recursive=True, edges=fx.MIXED_FLOW,
)
def c2_graph_summary(spark, d):
    out = components.graph_summary(frame(spark, d, fx.MIXED_FLOW))
    return out.select("n_nodes", "n_edges", "n_scc", "largest_scc", F.round("largest_scc_frac", 9).alias("largest_scc_frac"))


@query(f"{REACH} SELECT node, component FROM scc", recursive=True, edges=fx.MIXED_FLOW)
def c9_scc(spark, d):
    return components.strongly_connected_components(frame(spark, d, fx.MIXED_FLOW))


@query(
    f"""{REACH}, sizes AS (SELECT component, COUNT(*) AS size FROM scc GROUP BY component), top AS (SELECT * FROM sizes ORDER BY size DESC, component LIMIT 1)
SELECT node, scc.component = top.component AS in_largest, ROUND(size / CAST((SELECT COUNT(*) FROM nodes) AS DOUBLE), 9) AS fraction FROM scc, top""",
    recursive=True, edges=fx.PART_FLOW,
)
def c10_largest_scc(spark, d):
    return components.largest_scc(frame(spark, d, fx.PART_FLOW)).withColumn("fraction", F.round("fraction", 9))


@deg_query("SELECT node, in_deg FROM deg WHERE in_deg >= (SELECT QUANTILE_CONT(in_deg, 0.9) FROM deg)")
def c11_hubs(spark, d):
    return graph.hubs(frame(spark, d, fx.PART_FLOW))


@deg_query(
    """, ks AS (SELECT UNNEST(GENERATE_SERIES(1, CAST(FLOOR((SELECT QUANTILE_CONT(total_deg, 0.95) FROM deg)) AS BIGINT) - 1)) AS k),
counts AS (SELECT k, (SELECT COUNT(*) FROM deg WHERE total_deg > k) AS n_k,
  (SELECT COUNT(*) FROM edges JOIN deg s ON src = s.node JOIN deg t ON tgt = t.node WHERE s.total_deg > k AND t.total_deg > k) AS e_k FROM ks)
SELECT k, n_k, e_k, CASE WHEN n_k >= 2 THEN ROUND(CAST(e_k AS DOUBLE) / (n_k * (n_k - 1)), 6) END AS phi,
  ROUND((SELECT COUNT(*) FROM edges) / ((SELECT CAST(COUNT(*) AS DOUBLE) FROM deg) * ((SELECT COUNT(*) FROM deg) - 1)), 6) AS density FROM counts""",
    edges=fx.USER_FLOW,
)
def c12_rich_club(spark, d):
    return rounded(graph.rich_club(frame(spark, d, fx.USER_FLOW)), "phi", "density")


@query("SELECT ROUND(AVG(LN(weight)), 6) AS mu, ROUND(STDDEV_POP(LN(weight)), 6) AS sigma FROM edges WHERE weight > 0", edges=fx.PART_FLOW)
def c13_lognormal_fit(spark, d):
    return rounded(graph.lognormal_fit(frame(spark, d, fx.PART_FLOW)), "mu", "sigma")


#: The coefficients of an approximation of the error function (within 1.5e-7), and Acklam's of the inverse normal.
ERF = """(1 - EXP(-u * u) * (((((1.061405429 / (1 + 0.3275911 * u) - 1.453152027) / (1 + 0.3275911 * u) + 1.421413741) / (1 + 0.3275911 * u) - 0.284496736) / (1 + 0.3275911 * u)
  + 0.254829592) / (1 + 0.3275911 * u)))"""


@query(
    f"""SELECT ROUND(MAX(GREATEST(r / n - f, f - (r - 1) / n)), 4) AS statistic FROM (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY lw) AS DOUBLE) AS r, CAST(COUNT(*) OVER () AS DOUBLE) AS n, 0.5 + 0.5 * SIGN(z) * {ERF} AS f
  FROM (SELECT lw, z, ABS(z) / SQRT(CAST(2 AS DOUBLE)) AS u FROM (SELECT lw, (lw - AVG(lw) OVER ()) / STDDEV_POP(lw) OVER () AS z FROM logs)))""",
    edges=fx.PART_FLOW, logs="SELECT LN(weight) AS lw FROM edges",
)
def c14_ks_normal(spark, d):
    return geometry.ks_normal(frame(spark, d, fx.PART_FLOW).select(fn.natural_log("weight").alias("lw")), "lw").select(F.round("statistic", 4).alias("statistic"))


#: The first two terms of the asymptotic distribution of the statistic, for more than 140 rows.
KS_SERIES = """(SELECT SQRT(2 * PI()) / z * SUM(EXP(-(2 * k - 1) * (2 * k - 1) * PI() * PI() / (8 * z * z)))
  + SQRT(PI() / 2) / (3 * z * z * z * z * SQRT(n)) * SUM((PI() * PI() * (k - 0.5) * (k - 0.5) - z * z) * EXP(-PI() * PI() * (k - 0.5) * (k - 0.5) / (2 * z * z))) FROM (SELECT UNNEST(GENERATE_SERIES(1, 200)) AS k))"""


@query(
    f"""SELECT graph, CAST(n AS BIGINT) AS n, ROUND(statistic, 4) AS statistic, ROUND(1 - {KS_SERIES}, 2) AS p_value FROM (
  SELECT graph, n, MAX(GREATEST(r / n - f, f - (r - 1) / n)) AS statistic, SQRT(n) * MAX(GREATEST(r / n - f, f - (r - 1) / n)) AS z FROM (
  SELECT graph, CAST(ROW_NUMBER() OVER (PARTITION BY graph ORDER BY lw) AS DOUBLE) AS r, CAST(COUNT(*) OVER (PARTITION BY graph) AS DOUBLE) AS n, 0.5 + 0.5 * SIGN(z) * {ERF} AS f
  FROM (SELECT graph, lw, z, ABS(z) / SQRT(CAST(2 AS DOUBLE)) AS u FROM (SELECT graph, lw, (lw - AVG(lw) OVER (PARTITION BY graph)) / STDDEV_POP(lw) OVER (PARTITION BY graph) AS z FROM logs))) GROUP BY graph, n)""",
    nations=fx.NATION_FLOW, users=fx.USER_FLOW, logs="SELECT 'nations' AS graph, LN(weight) AS lw FROM nations UNION ALL SELECT 'users', LN(weight) FROM users",
)
def c14_ks_p_value(spark, d):
    out = None
    for name, edges in (("nations", frame(spark, d, fx.NATION_FLOW)), ("users", frame(spark, d, fx.USER_FLOW))):
        logs = edges.select(fn.natural_log("weight").alias("lw"))
        one = geometry.ks_normal(logs, "lw").select(F.lit(name).alias("graph"), F.lit(logs.count()).cast("long").alias("n"), F.round("statistic", 4).alias("statistic"), F.round("pValue", 2).alias("p_value"))
        out = one if out is None else out.unionByName(one)
    return out


def _horner(x: str, coefficients: tuple[float, ...]) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out}) * {x} + {c!r}"
    return f"({out})"


QUANTILE = f"""CASE WHEN p < {fn.ACKLAM_TAIL} THEN {_horner("t", fn.ACKLAM_C)} / {_horner("t", fn.ACKLAM_D)} WHEN p > 1 - {fn.ACKLAM_TAIL} THEN -{_horner("t", fn.ACKLAM_C)} / {_horner("t", fn.ACKLAM_D)}
  ELSE (p - 0.5) * {_horner("((p - 0.5) * (p - 0.5))", fn.ACKLAM_A)} / {_horner("((p - 0.5) * (p - 0.5))", fn.ACKLAM_B)} END"""


@query(
    f"""SELECT "rank", ROUND(sample, 6) AS sample, ROUND({QUANTILE}, 6) AS theoretical FROM (SELECT *, SQRT(-2 * LN(LEAST(p, 1 - p))) AS t FROM (
  SELECT *, CASE WHEN "rank" = 0 THEN 1 - POW(0.5, 1 / n) WHEN "rank" = n - 1 THEN POW(0.5, 1 / n) ELSE ("rank" + 1 - 0.3175) / (n + 0.365) END AS p FROM (
    SELECT ROW_NUMBER() OVER (ORDER BY lw) - 1 AS "rank", lw AS sample, CAST(COUNT(*) OVER () AS DOUBLE) AS n FROM logs)))""",
    edges=fx.USER_FLOW, logs="SELECT LN(weight) AS lw FROM edges",
)
def c15_qq_points(spark, d):
    return rounded(geometry.qq_points(frame(spark, d, fx.USER_FLOW).select(fn.natural_log("weight").alias("lw")), "lw"), "sample", "theoretical")


@deg_query("SELECT node, ROUND(in_deg / (SELECT AVG(in_deg) FROM deg), 6) AS in_degree_ratio FROM deg")
def c16_degree_ratio(spark, d):
    return rounded(graph.connectome_stats(frame(spark, d, fx.PART_FLOW))[0], "in_degree_ratio")


@query("SELECT src, tgt, ROUND(weight / (SELECT STDDEV_POP(weight) FROM edges), 6) AS weight_normed FROM edges WHERE weight > 0", edges=fx.PART_FLOW)
def c16_weight_pool(spark, d):
    return rounded(graph.connectome_stats(frame(spark, d, fx.PART_FLOW))[1], "weight_normed")


# --- generators: their sizes come from the tables --------------------------------------------------------------------


@query()
def n1_erdos_renyi(spark, d):
    s = graph.degree_stats(frame(spark, d, fx.USER_FLOW)).first()
    return graph.degrees(generators.erdos_renyi(spark, s["n_nodes"], s["density"]).withColumn("weight", F.lit(1)))


@query("SELECT COUNT(*) AS n, CAST(0 AS BIGINT) AS loops, CAST(0 AS BIGINT) AS twice, TRUE AS dense_enough FROM (SELECT src FROM edges UNION SELECT tgt FROM edges)", edges=fx.PART_FLOW)
def n1_erdos_renyi_holds(spark, d):
    """What must hold of a random graph of the table's size: no loops, no edge twice, its density within five standard deviations."""
    s = graph.degree_stats(frame(spark, d, fx.PART_FLOW)).first()
    n, p = s["n_nodes"], s["density"]
    edges = generators.erdos_renyi(spark, n, p)
    counts = edges.agg(F.count("*").alias("m"), F.count_if(F.col("src") == F.col("tgt")).alias("loops")).crossJoin(edges.distinct().agg(F.count("*").alias("different")))
    spread = 5 * (n * (n - 1) * p * (1 - p)) ** 0.5
    return counts.select(F.lit(n).cast("long").alias("n"), "loops", (F.col("m") - F.col("different")).alias("twice"), (F.abs(F.col("m") - n * (n - 1) * p) < spread).alias("dense_enough"))


@query()
def n2_power_law_degrees(spark, d):
    return generators.power_law_degrees(spark, graph.nodes_of(frame(spark, d, fx.PART_FLOW)).count())


@query("SELECT COUNT(*) AS n, TRUE AS bounded, TRUE AS tail_holds FROM (SELECT src FROM edges UNION SELECT tgt FROM edges)", edges=fx.PART_FLOW)
def n2_power_law_holds(spark, d):
    """All degrees lie between 1 and n - 1, and the share of those above 4 is the law's within five standard deviations."""
    k = n2_power_law_degrees(spark, d)
    n, tail = k.count(), 4.5**-1.3
    return k.agg(F.count("*").alias("n"), F.bool_and(F.col("degree").between(1, n - 1)).alias("bounded"), (F.abs(F.count_if(F.col("degree") > 4) / n - tail) < 5 * (tail / n) ** 0.5).alias("tail_holds"))


@query()
def n3_synthetic_connectome(spark, d):
    edges = frame(spark, d, fx.USER_FLOW)
    s, fit = graph.degree_stats(edges).first(), graph.lognormal_fit(edges).first()
    return generators.synthetic_connectome(spark, s["n_nodes"], s["density"], fit["mu"], fit["sigma"])


@query("SELECT CAST(0 AS BIGINT) AS loops, CAST(0 AS BIGINT) AS twice, TRUE AS inside, TRUE AS weights_hold FROM (SELECT 1)")
def n3_synthetic_holds(spark, d):
    """No loops, no edge twice, ids below n, and the mean log weight is mu within five standard deviations."""
    edges = frame(spark, d, fx.USER_FLOW)
    n, fit, made = graph.nodes_of(edges).count(), graph.lognormal_fit(edges).first(), n3_synthetic_connectome(spark, d)
    mean = F.avg(F.ln("weight"))
    counts = made.agg(
        F.count_if(F.col("src") == F.col("tgt")).alias("loops"), F.count("*").alias("m"), F.max(F.greatest("src", "tgt")).alias("top"),
        (F.abs(mean - fit["mu"]) < 5 * fit["sigma"] / F.sqrt(F.count("*"))).alias("weights_hold"),
    )
    different = made.select("src", "tgt").distinct().agg(F.count("*").alias("different"))
    return counts.crossJoin(different).select("loops", (F.col("m") - F.col("different")).alias("twice"), (F.col("top") < n).alias("inside"), "weights_hold")


# --- scores ----------------------------------------------------------------------------------------------------------

JOINED = "joined AS (SELECT edges.*, s.pos AS ps, t.pos AS pt FROM edges JOIN p s ON src = s.node JOIN p t ON tgt = t.node)"
SCORE = """SELECT CAST(SUM(CASE WHEN pt > ps THEN weight ELSE 0 END) AS BIGINT) AS score, CAST(SUM(weight) AS BIGINT) AS total_weight,
  CAST(SUM(CASE WHEN pt > ps THEN 0 ELSE weight END) AS BIGINT) AS feedback_weight, ROUND(SUM(CASE WHEN pt > ps THEN weight ELSE 0 END) * CAST(100 AS DOUBLE) / SUM(weight), 6) AS pct"""


@query(f", {JOINED} {SCORE} FROM joined", edges=fx.PART_FLOW, p=fx.POSITIONS)
def e1_score_positions(spark, d):
    return rounded(score.score_from_positions(frame(spark, d, fx.PART_FLOW), frame(spark, d, fx.POSITIONS)), "pct")


RANKS = "SELECT node, ROW_NUMBER() OVER (ORDER BY pos, node) - 1 AS pos FROM pp"


@query(f", {JOINED} {SCORE} FROM joined", edges=fx.PART_FLOW, pp=fx.POSITIONS, p=RANKS)
def e2_score_order(spark, d):
    order = score.node_ranks(frame(spark, d, fx.POSITIONS))
    return rounded(score.score_from_order(frame(spark, d, fx.PART_FLOW), order), "pct")


@query(
    f", {JOINED} SELECT ROUND(SUM(CASE WHEN pt > ps THEN weight ELSE 0 END), 2) AS score, ROUND(SUM(CASE WHEN pt > ps THEN 0 ELSE weight END), 2) AS feedback_weight FROM joined",
    edges=fx.USER_FLOW, p="SELECT user_id AS node, AVG(value) AS pos FROM {events} GROUP BY user_id",
)
def e3_float_weights(spark, d):
    positions = frame(spark, d, "SELECT user_id AS node, AVG(value) AS pos FROM {events} GROUP BY user_id")
    out = score.score_runs(frame(spark, d, fx.USER_FLOW), positions)
    return out.select(F.round("score", 2).alias("score"), F.round("feedback_weight", 2).alias("feedback_weight"))


@query('SELECT ROW_NUMBER() OVER (ORDER BY pos, node) - 1 AS "rank", node FROM p', p=fx.POSITIONS)
def e4_order_nodes(spark, d):
    return score.order_nodes(frame(spark, d, fx.POSITIONS))


@query('SELECT run, node, ROW_NUMBER() OVER (PARTITION BY run ORDER BY pos, node) - 1 AS "rank" FROM p', p=fx.POSITIONS_BY_RUN)
def e5_node_ranks(spark, d):
    return score.node_ranks(frame(spark, d, fx.POSITIONS_BY_RUN))


@query(
    f", joined AS (SELECT s.run, weight, s.pos AS ps, t.pos AS pt FROM edges JOIN p s ON src = s.node JOIN p t ON tgt = t.node AND s.run = t.run) {SCORE}, run FROM joined GROUP BY run",
    edges=fx.PART_FLOW, p=fx.POSITIONS_BY_RUN,
)
def e6_score_runs(spark, d):
    return rounded(score.score_runs(frame(spark, d, fx.PART_FLOW), frame(spark, d, fx.POSITIONS_BY_RUN)), "pct")


@query(f", {JOINED} {SCORE} FROM joined", edges=fx.PART_FLOW, pp=fx.POSITIONS, p=RANKS.replace("ORDER BY pos, node", "ORDER BY pos DESC, node DESC"))
def e7_reverse_order(spark, d):
    order = score.reverse_order(score.node_ranks(frame(spark, d, fx.POSITIONS)))
    return rounded(score.score_from_order(frame(spark, d, fx.PART_FLOW), order), "pct")


NORMED = "SELECT src, tgt, weight, CAST(weight AS DOUBLE) / (SELECT MAX(weight) FROM raw) AS norm_weight FROM raw"
SCALED = fx.POSITIONS.replace("p_retailprice AS pos", "p_retailprice / 1000 AS pos")


@query(f", {JOINED} SELECT ROUND(-SUM(norm_weight / (1 + EXP(-0.5 * (pt - ps)))), 6) AS loss FROM joined", raw=fx.PART_FLOW, edges=NORMED, p=SCALED)
def e8_surrogate_loss(spark, d):
    edges = graph.normalise_weights(frame(spark, d, fx.PART_FLOW))
    return rounded(score.surrogate_loss(edges, frame(spark, d, SCALED), 0.5), "loss")


GRADIENT = """pulls AS (SELECT src, tgt, 0.5 * s * (1 - s) * norm_weight AS g FROM (SELECT *, 1 / (1 + EXP(-0.5 * (pt - ps))) AS s FROM joined)),
grads AS (SELECT node, SUM(g) AS grad FROM (SELECT src AS node, g FROM pulls UNION ALL SELECT tgt, -g FROM pulls) GROUP BY node)"""


@query(f", {JOINED}, {GRADIENT} SELECT node, ROUND(grad, 6) + 0 AS grad FROM grads", raw=fx.PART_FLOW, edges=NORMED, p=SCALED)
def e9_surrogate_gradient(spark, d):
    edges = graph.normalise_weights(frame(spark, d, fx.PART_FLOW))
    return rounded(score.surrogate_gradient(edges, frame(spark, d, SCALED), 0.5), "grad")


@query(
    f""", joined AS (SELECT s.run, weight, s.pos AS ps, t.pos AS pt FROM edges JOIN p s ON src = s.node JOIN p t ON tgt = t.node AND s.run = t.run),
exact AS (SELECT run, CAST(SUM(CASE WHEN pt > ps THEN weight ELSE 0 END) AS BIGINT) AS exact FROM joined GROUP BY run)
SELECT run, exact + CASE WHEN run = 'size' THEN 1 ELSE 0 END AS stored, exact, run <> 'size' AS ok FROM exact""",
    edges=fx.PART_FLOW, p=fx.POSITIONS_BY_RUN,
)
def e10_verify_scores(spark, d):
    edges, positions = frame(spark, d, fx.PART_FLOW), frame(spark, d, fx.POSITIONS_BY_RUN)
    stored = score.score_runs(edges, positions).select("run", (F.col("score") + (F.col("run") == "size").cast("int")).alias("best_score"))
    return score.verify_scores(stored, edges, positions)


# --- search ----------------------------------------------------------------------------------------------------------


@query()
def f1_simple(spark, d):
    return search.order_simple(frame(spark, d, fx.PART_FLOW))


ORDER_HOLDS = """SELECT COUNT(*) AS n, TRUE AS permutation, TRUE AS good FROM (SELECT src FROM edges UNION SELECT tgt FROM edges)"""


def order_holds(edges, order, least):
    """One row: the number of nodes, whether the ranks are 0 to n - 1 once each, and whether `least` percent of the weight points forward."""
    shape = order.agg(F.count("*").alias("n"), (F.countDistinct("rank", "node") == F.count("*")).alias("once"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.countDistinct("rank").alias("ranks"))
    pct = score.score_from_order(edges, order).select("pct")
    whole = F.col("once") & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("ranks") == F.col("n"))
    return shape.crossJoin(pct).select("n", whole.alias("permutation"), (F.col("pct") >= least).alias("good"))


def _shares(edges):
    """Half of what is no loop, in percent: the better of an order and its reverse reaches it."""
    return 50.0 * edges.agg((F.sum(F.when(F.col("src") != F.col("tgt"), F.col("weight")).otherwise(0)) / F.sum("weight")).alias("s")).first()["s"]


def _greedy_share(edges, use_abs):
    """What the exact greedy order of the graph reaches, in percent."""
    order = search.order_greedy(edges.withColumn("graph_id", F.lit(0)), use_abs).select("node", "rank")
    return score.score_from_order(edges, order).first()["pct"]


@query(ORDER_HOLDS, edges=fx.PART_FLOW)
def f1_simple_holds(spark, d):
    edges = frame(spark, d, fx.PART_FLOW)
    return order_holds(edges, f1_simple(spark, d), _shares(edges))


#: One node a step of every graph at once: the one of highest out - in weight among the nodes left, the smallest of equals.
GREEDY = """, nodes AS (SELECT graph_id, src AS node FROM edges UNION SELECT graph_id, tgt FROM edges),
state(graph_id, node, step, back, rk) AS (
  SELECT graph_id, node, CAST(0 AS BIGINT), COUNT(*) OVER (PARTITION BY graph_id) - 1, CAST(NULL AS BIGINT) FROM nodes
  UNION ALL
  (WITH open_ AS (SELECT * FROM state WHERE rk IS NULL),
   diff AS (SELECT o.*, COALESCE((SELECT SUM(weight) FROM edges e JOIN open_ p ON p.graph_id = e.graph_id AND p.node = e.tgt WHERE e.graph_id = o.graph_id AND e.src = o.node), 0)
      - COALESCE((SELECT SUM(weight) FROM edges e JOIN open_ p ON p.graph_id = e.graph_id AND p.node = e.src WHERE e.graph_id = o.graph_id AND e.tgt = o.node), 0) AS d FROM open_ o),
   best AS (SELECT graph_id, node, {last} AS last_ FROM diff QUALIFY ROW_NUMBER() OVER (PARTITION BY graph_id ORDER BY {key} DESC, node) = 1)
   SELECT o.graph_id, o.node, o.step + CASE WHEN last_ THEN 0 ELSE 1 END, o.back - CASE WHEN last_ THEN 1 ELSE 0 END, CASE WHEN b.node = o.node THEN CASE WHEN last_ THEN o.back ELSE o.step END END
   FROM open_ o JOIN best b ON b.graph_id = o.graph_id))
SELECT graph_id, node, rk AS "rank" FROM state WHERE rk IS NOT NULL"""


@query(GREEDY.format(key="d", last="FALSE"), recursive=True, edges=fx.CUSTOMER_FLOW)
def f2_greedy(spark, d):
    return search.order_greedy(frame(spark, d, fx.CUSTOMER_FLOW))


@query(GREEDY.format(key="ABS(d)", last="d <= 0"), recursive=True, edges=fx.CUSTOMER_FLOW)
def f3_greedy_abs(spark, d):
    return search.order_greedy(frame(spark, d, fx.CUSTOMER_FLOW), use_abs=True)


@query()
def f2_peeled(spark, d):
    return search.order_peeled(frame(spark, d, fx.PART_FLOW))


@query(ORDER_HOLDS, edges=fx.PART_FLOW)
def f2_peeled_holds(spark, d):
    """No more than three points of the weight below the exact rule on the same graph."""
    edges = frame(spark, d, fx.PART_FLOW)
    return order_holds(edges, f2_peeled(spark, d), _greedy_share(edges, False) - 3)


@query(ORDER_HOLDS, edges=fx.PART_FLOW)
def f3_peeled_abs_holds(spark, d):
    edges = frame(spark, d, fx.PART_FLOW)
    return order_holds(edges, search.order_peeled(edges, use_abs=True), _greedy_share(edges, True) - 3)


@deg_query("SELECT node, ROUND((out_w - in_w) / ((SELECT MAX(ABS(out_w - in_w)) FROM deg) + 0.00000001), 6) AS pos FROM deg")
def f4_init_degree_diff(spark, d):
    return rounded(search.init_positions(frame(spark, d, fx.PART_FLOW), "degree_diff", noise=0), "pos")


@deg_query("SELECT node, ROUND(CAST(ROW_NUMBER() OVER (ORDER BY ABS(out_w - in_w) DESC, node) - 1 AS DOUBLE) / (SELECT COUNT(*) FROM deg) * 2 - 1, 6) AS pos FROM deg")
def f4_init_degree_abs(spark, d):
    return rounded(search.init_positions(frame(spark, d, fx.PART_FLOW), "degree_abs", noise=0), "pos")


@query(
    f""", {JOINED}, {GRADIENT}, normed AS (SELECT node, grad * LEAST(1, 1 / (SQRT((SELECT SUM(grad * grad) FROM grads)) + 0.000001)) AS g FROM grads)
SELECT p.node, ROUND(pos - 0.05 * (0.1 * COALESCE(g, 0) / (1 - 0.9)) / (SQRT(0.001 * COALESCE(g, 0) * COALESCE(g, 0) / (1 - 0.999)) + 0.00000001), 5) AS pos,
  ROUND(0.1 * COALESCE(g, 0), 6) + 0 AS m FROM p LEFT JOIN normed ON p.node = normed.node""",
    raw=fx.PART_FLOW, edges=NORMED, p=SCALED,
)
def f8_adam_step(spark, d):
    positions = frame(spark, d, SCALED).withColumn("run", F.lit("r"))
    grad = score.surrogate_gradient(graph.normalise_weights(frame(spark, d, fx.PART_FLOW)), positions, 0.5)
    state = positions.select("run", "node", "pos", F.lit(0.0).alias("m"), F.lit(0.0).alias("v"))
    return search.adam_step(state, grad, 0.05, 1).select("node", F.round("pos", 5).alias("pos"), r6("m").alias("m"))


#: The operators' own epochs and cycles: the fastest schedule has ten epochs for each half of a cycle.
FULL = search.Config()


@query()
def f9_run_ordering(spark, d):
    return search.run_ordering(frame(spark, d, fx.PART_FLOW), FULL)[1].select("run", "iter", "score", "best_score", "pct", "best_pct", "beta", "loss", "lr")


@query(
    f""", {JOINED}, {GRADIENT}, normed AS (SELECT node, grad * LEAST(1, 1 / (SQRT((SELECT SUM(grad * grad) FROM grads)) + 0.000001)) AS g FROM grads),
q AS (SELECT p.node, pos - 0.05 * (0.1 * COALESCE(g, 0) / (1 - 0.9)) / (SQRT(0.001 * COALESCE(g, 0) * COALESCE(g, 0) / (1 - 0.999)) + 0.00000001) AS pos FROM p LEFT JOIN normed ON p.node = normed.node),
one AS (SELECT CAST(SUM(CASE WHEN t.pos > s.pos THEN weight ELSE 0 END) AS DOUBLE) AS score, ROUND(-SUM(norm_weight / (1 + EXP(-0.5 * (t.pos - s.pos)))), 4) AS loss
  FROM edges JOIN q s ON src = s.node JOIN q t ON tgt = t.node)
SELECT run, one.* FROM one, (SELECT UNNEST(['epochs', 'blocks']) AS run)""",
    raw=fx.PART_FLOW, edges=NORMED, p=SCALED,
)
def f9_resume(spark, d):
    """One epoch of either search from given positions: the score and the loss of the step that f8_adam_step shows."""
    edges, start = frame(spark, d, fx.PART_FLOW), frame(spark, d, SCALED)
    cfg = search.Config(epochs=1, betas=lambda t: [0.5] * t, log_interval=1)
    one = search.search(edges, {"epochs": (42, cfg)}, start=start)[1].unionByName(search.search_blocked(edges, {"blocks": (42, cfg)}, 1, start=start)[1])
    return one.select("run", "score", F.round("loss", 4).alias("loss"))


@query()
def f9_blocked(spark, d):
    return search.search_blocked(frame(spark, d, fx.PART_FLOW), {"seed42": (42, FULL)}, 10, block_edges=20_000)[1].select("run", "iter", "score", "best_score", "pct", "best_pct", "beta", "loss", "lr")


@query(
    f""", order_ AS (SELECT node, ROW_NUMBER() OVER (ORDER BY pos, node) - 1 AS r FROM p),
pairs AS (SELECT LEAST(a.node, b.node) AS u, GREATEST(a.node, b.node) AS v FROM order_ a JOIN order_ b ON b.r = a.r + 1 WHERE a.r % 2 = 0),
ranked AS (SELECT pairs.*, x.r AS ru, y.r AS rv FROM pairs JOIN order_ x ON u = x.node JOIN order_ y ON v = y.node),
touched AS (SELECT u, v, ru, rv, edges.* FROM ranked JOIN edges ON src = u OR src = v OR tgt = u OR tgt = v),
moved AS (SELECT u, v, weight, s.r AS rs, t.r AS rt, CASE WHEN src = u THEN rv WHEN src = v THEN ru ELSE s.r END AS ns, CASE WHEN tgt = u THEN rv WHEN tgt = v THEN ru ELSE t.r END AS nt
  FROM touched JOIN order_ s ON src = s.node JOIN order_ t ON tgt = t.node)
SELECT pairs.u, pairs.v, CAST(COALESCE(SUM(CASE WHEN nt > ns THEN weight ELSE 0 END - CASE WHEN rt > rs THEN weight ELSE 0 END), 0) AS BIGINT) AS delta
FROM pairs LEFT JOIN moved ON pairs.u = moved.u AND pairs.v = moved.v GROUP BY pairs.u, pairs.v""",
    edges=fx.PART_FLOW, p=fx.POSITIONS,
)
def f10_swap_deltas(spark, d):
    order = score.node_ranks(frame(spark, d, fx.POSITIONS))
    pairs = order.groupBy(F.floor(F.col("rank") / 2).alias("k")).agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u <> v").select("u", "v")
    return search.swap_deltas(frame(spark, d, fx.PART_FLOW), order, pairs)


@query(
    """, order_ AS (SELECT node, ROW_NUMBER() OVER (ORDER BY pos, node) - 1 AS r FROM p),
e AS (SELECT src, tgt, weight, s.r AS rs, t.r AS rt FROM edges JOIN order_ s ON src = s.node JOIN order_ t ON tgt = t.node WHERE src <> tgt),
passed AS (SELECT src AS node, rs AS r, rt AS o, -weight AS c FROM e UNION ALL SELECT tgt, rt, rs, weight FROM e),
steps AS (SELECT node, r, o > r AS later, ABS(o - r) AS far, SUM(CASE WHEN o > r THEN c ELSE -c END) AS c FROM passed GROUP BY node, r, o > r, ABS(o - r)),
places AS (SELECT *, SUM(c) OVER (PARTITION BY node, later ORDER BY far) AS gain FROM steps)
SELECT node, r AS "rank", r + CASE WHEN later THEN far ELSE -far END AS place, CAST(gain AS BIGINT) AS gain FROM places WHERE gain > 0
QUALIFY ROW_NUMBER() OVER (PARTITION BY node ORDER BY gain DESC, far, later DESC) = 1""",
    edges=fx.PART_FLOW, p=fx.POSITIONS,
)
def f10_insertion_moves(spark, d):
    return search.insertion_moves(frame(spark, d, fx.PART_FLOW), score.node_ranks(frame(spark, d, fx.POSITIONS)))


@query("SELECT COUNT(*) AS n, TRUE AS gained, TRUE AS adds_up FROM p", p=fx.POSITIONS)
def f10_gains_hold(spark, d):
    """The forward weight grows by the sum of the rounds' gains, to the unit."""
    edges, start = frame(spark, d, fx.PART_FLOW), score.node_ranks(frame(spark, d, fx.POSITIONS))
    gains = []
    after = search.local_search(edges, start, 3, gains=gains)
    was, now = (score.score_from_order(edges, o).first()["score"] for o in (start, after))
    return after.agg(F.countDistinct("rank").alias("n"), F.lit(now > was).alias("gained"), F.lit(now - was == sum(gains)).alias("adds_up"))


@query()
def f10_local_search(spark, d):
    return search.local_search(frame(spark, d, fx.PART_FLOW), score.node_ranks(frame(spark, d, fx.POSITIONS)), rounds=2)


@query("SELECT COUNT(*) AS n, TRUE AS permutation, TRUE AS good FROM p", p=fx.POSITIONS)
def f10_local_search_holds(spark, d):
    """The order is whole and scores no less than the one it starts from."""
    edges, start = frame(spark, d, fx.PART_FLOW), score.node_ranks(frame(spark, d, fx.POSITIONS))
    return order_holds(edges, f10_local_search(spark, d), score.score_from_order(edges, start).first()["pct"])


@query()
def f11_multi_start(spark, d):
    return search.multi_start(frame(spark, d, fx.PART_FLOW), [42, 123, 999], FULL)


@query()
def f12_init_ablation(spark, d):
    return search.init_ablation(frame(spark, d, fx.PART_FLOW), ["random", "uniform", "degree_diff"], FULL).select("run", "score", "pct", "best")


@query()
def f13_beta_ablation(spark, d):
    return search.beta_ablation(frame(spark, d, fx.PART_FLOW), list(search.BETA_VARIANTS), FULL)


@query(
    f""", {DEGREES}, p AS (SELECT node, (out_w - in_w) / ((SELECT MAX(ABS(out_w - in_w)) FROM deg) + 0.00000001) AS pos FROM deg), {JOINED},
one AS ({SCORE} FROM joined) SELECT 'seed' || CAST(seed AS VARCHAR) AS run, one.* FROM one, (SELECT UNNEST([42, 123, 999]) AS seed)""",
    edges=fx.PART_FLOW,
)
def f14_run_variant(spark, d):
    return rounded(search.run_variant(frame(spark, d, fx.PART_FLOW), lambda e, s: search.init_positions(e, "degree_diff", s, noise=0.0), [42, 123, 999]), "pct")


# --- histories and records -------------------------------------------------------------------------------------------

BEST = "SELECT *, MAX(score) OVER (PARTITION BY run ORDER BY iter ROWS UNBOUNDED PRECEDING) AS best_score FROM h"


def _history(spark, d):
    return frame(spark, d, fx.HISTORY)


def _with_pct(spark, d):
    return history.with_running_best(_history(spark, d)).withColumn("best_pct", F.col("best_score"))


@query("SELECT run, iter, score, GREATEST(20, best_score) AS best_score FROM b", h=fx.HISTORY, b=BEST)
def g1_running_best(spark, d):
    return history.with_running_best(_history(spark, d), F.lit(20.0)).select("run", "iter", "score", "best_score")


@query("SELECT run, MIN(elapsed) FILTER (best_score >= 70) AS t_70, MIN(elapsed) FILTER (best_score >= 200) AS t_200 FROM b GROUP BY run", h=fx.HISTORY, b=BEST)
def g2_time_to_threshold(spark, d):
    return history.time_to_threshold(_with_pct(spark, d), [70, 200])


@query("SELECT * EXCLUDE (stamp, pct) FROM r QUALIFY ROW_NUMBER() OVER (PARTITION BY algo, dataset ORDER BY score DESC, run_no) = 1", r=fx.RUNS)
def g3_best_of(spark, d):
    return history.best_of(frame(spark, d, fx.RUNS).drop("stamp", "pct"), ["algo", "dataset"], "score", "run_no")


@query(
    """SELECT algo, dataset, MAX(score) AS best, (ARRAY_AGG(seed ORDER BY score DESC, seed))[1] AS best_seed, MIN(score) AS worst, ROUND(AVG(score), 4) AS mean,
  ROUND(STDDEV_SAMP(score), 4) AS std, COUNT(*) AS n_runs FROM r GROUP BY algo, dataset""",
    r=fx.RUNS,
)
def g4_summarise_runs(spark, d):
    return history.summarise_runs(frame(spark, d, fx.RUNS), ["algo", "dataset"]).withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query(
    """SELECT algo, dataset, config_hash, COUNT(*) AS n_seeds, ROUND(AVG(pct), 6) AS pct_mean, ROUND(STDDEV_SAMP(pct), 6) AS pct_std, ROUND(AVG(score), 3) AS score_mean,
  ROUND(STDDEV_SAMP(score), 3) AS score_std, ROUND(AVG(wall_clock_s), 6) AS wall_clock_mean, STRING_AGG(CAST(seed AS VARCHAR), ', ' ORDER BY seed) AS seeds,
  (SELECT STRING_AGG(c, ', ' ORDER BY c) FROM (SELECT DISTINCT SUBSTRING(COALESCE(git_commit, 'n/a'), 1, 11) AS c FROM r q WHERE q.algo = r.algo AND q.dataset = r.dataset AND q.config_hash = r.config_hash)) AS git_commits
FROM r GROUP BY algo, dataset, config_hash""",
    r=fx.RUNS,
)
def g5_aggregate_runs(spark, d):
    out = history.aggregate_runs(frame(spark, d, fx.RUNS)).drop("score_text")
    return rounded(out, "pct_mean", "pct_std", "wall_clock_mean").withColumns({c: F.round(c, 3) for c in ("score_mean", "score_std")})


PER_ALGO = "SELECT algo AS algorithm, MAX(pct) AS pct, AVG(wall_clock_s) AS time FROM r WHERE dataset = '{}' GROUP BY algo"


@query(
    """SELECT a.algorithm, ROUND(a.pct, 6) AS pct, ROUND(a.time, 6) AS time, ROUND(b.pct, 6) AS ref_pct, ROUND(b.time, 6) AS ref_time, ROUND(a.pct - b.pct, 6) AS delta_pp,
  ROUND(a.time / NULLIF(b.time, 0), 6) AS time_ratio FROM a JOIN b ON a.algorithm = b.algorithm""",
    r=fx.RUNS, a=PER_ALGO.format("O"), b=PER_ALGO.format("F"),
)
def g6_compare(spark, d):
    runs = frame(spark, d, fx.RUNS).groupBy(F.col("algo").alias("algorithm"), "dataset").agg(F.max("pct").alias("pct"), F.avg("wall_clock_s").alias("time"))
    out = history.compare(runs.where("dataset = 'O'"), runs.where("dataset = 'F'"))
    return rounded(out, "pct", "time", "ref_pct", "ref_time", "delta_pp", "time_ratio")


@query(
    """SELECT 'seeds' AS experiment, algo AS algorithm, MAX(score) AS score, CAST(NULL AS DOUBLE) AS time_s FROM r GROUP BY algo
UNION ALL SELECT 'threshold', CAST(run AS VARCHAR), NULL, MIN(elapsed) FILTER (best_score >= 70) FROM b GROUP BY run""",
    r=fx.RUNS, h=fx.HISTORY, b=BEST,
)
def g7_master_results(spark, d):
    best = frame(spark, d, fx.RUNS).groupBy(F.col("algo").alias("algorithm")).agg(F.max("score").alias("score")).withColumn("experiment", F.lit("seeds"))
    times = history.time_to_threshold(_with_pct(spark, d), [70]).select(F.lit("threshold").alias("experiment"), F.col("run").cast("string").alias("algorithm"), F.col("t_70").alias("time_s"))
    return history.master_results(best, times)


@query(
    """SELECT run_no, SUBSTRING(SHA256('{"algo": "' || algo || '", "dataset": "' || dataset || '", "epochs": ' || CAST(run_no % 5 AS VARCHAR) || '}'), 1, 12) AS config_hash FROM r""",
    r=fx.RUNS,
)
def g8_config_hash(spark, d):
    fields = {"algo": history.json_string(F.col("algo")), "dataset": history.json_string(F.col("dataset")), "epochs": (F.col("run_no") % 5).cast("string"), "seed": F.col("seed").cast("string")}
    return frame(spark, d, fx.RUNS).select("run_no", history.config_hash(fields).alias("config_hash"))


GATE = """base AS (SELECT dataset, AVG(pct) AS bm, STDDEV_SAMP(pct) AS bs FROM r WHERE algo = '5-LOW' GROUP BY dataset),
gain AS (SELECT algo, r.dataset, AVG(pct + CASE WHEN algo = '1-URGENT' THEN 50 ELSE 0 END) - MIN(bm) AS delta, MIN(bs) AS bs, COUNT(*) AS n FROM r JOIN base ON r.dataset = base.dataset GROUP BY algo, r.dataset)"""


def _gate(spark, d):
    runs = frame(spark, d, fx.RUNS)
    base = runs.where("algo = '5-LOW'").groupBy("dataset").agg(F.avg("pct").alias("mean"), F.stddev_samp("pct").alias("std"))
    return runs.withColumn("pct", F.col("pct") + F.when(F.col("algo") == "1-URGENT", 50).otherwise(0)), base


@query(f", {GATE} SELECT algo, COUNT(*) AS n_datasets, BOOL_AND(delta > 2 * bs) AND COUNT(*) = (SELECT COUNT(*) FROM base) AS promoted FROM gain GROUP BY algo", r=fx.RUNS)
def g9_screen(spark, d):
    return history.screen(*_gate(spark, d))


@query(
    f", {GATE} SELECT algo, ROUND(MIN(delta - 1.96 * bs * SQRT(CAST(2 AS DOUBLE) / n)), 6) AS least_ci_low, MIN(delta - 1.96 * bs * SQRT(CAST(2 AS DOUBLE) / n)) > 0 AND COUNT(*) = (SELECT COUNT(*) FROM base) AS confirmed FROM gain GROUP BY algo",
    r=fx.RUNS,
)
def g10_confirm(spark, d):
    return rounded(history.confirm(*_gate(spark, d)), "least_ci_low")


@query(
    """SELECT STRFTIME(stamp, '%Y%m%dT%H%M%SZ') || '-' || algo || '-' || dataset || '-s' || CAST(seed AS VARCHAR) || '-' || SUBSTRING(config_hash, 1, 6) AS exp_id,
  STRFTIME(stamp, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp", 'spark' AS engine FROM r""",
    r=fx.RUNS,
)
def g11_build_records(spark, d):
    out = history.build_records(frame(spark, d, fx.RUNS), F.col("stamp"), {"python": "3", "jax_or_torch": "spark", "cuda": None, "gpu": "none"})
    return out.select("exp_id", "timestamp", F.col("env.jax_or_torch").alias("engine"))


@query("SELECT run, elapsed AS x, best_score AS best_pct FROM b WHERE elapsed > 0", h=fx.HISTORY, b=BEST)
def g12_convergence_series(spark, d):
    return history.convergence_series(_with_pct(spark, d), "elapsed")


# --- stability -------------------------------------------------------------------------------------------------------

TIED = "SELECT run, node, ROW_NUMBER() OVER (PARTITION BY run ORDER BY pos, node) - 1 AS r, RANK() OVER w + (COUNT(*) OVER (PARTITION BY run, pos) - 1) / CAST(2 AS DOUBLE) AS tr, DENSE_RANK() OVER w AS dr, COUNT(*) OVER (PARTITION BY run) AS n FROM p WINDOW w AS (PARTITION BY run ORDER BY pos)"
PAIRED = "SELECT a.run AS run1, b.run AS run2, a.node, a.r AS r1, b.r AS r2, a.tr AS t1, b.tr AS t2, a.dr AS d1, b.dr AS d2, a.n FROM t a JOIN t b ON a.node = b.node AND a.run < b.run"


@query("SELECT run1, run2, ROUND(CORR(t1, t2), 6) AS rho FROM q GROUP BY run1, run2", p=fx.POSITIONS_BY_RUN, t=TIED, q=PAIRED)
def t1_spearman(spark, d):
    return rounded(stability.spearman_pairs(frame(spark, d, fx.POSITIONS_BY_RUN)), "rho")


@query(
    """SELECT run1, run2, disc AS discordant, ROUND((conc - disc) / SQRT(CAST(conc + disc + only2 AS DOUBLE) * (conc + disc + only1)), 6) AS tau FROM (
  SELECT x.run1, x.run2, COUNT(*) FILTER ((x.d1 < y.d1 AND x.d2 > y.d2) OR (x.d1 > y.d1 AND x.d2 < y.d2)) AS disc,
    COUNT(*) FILTER ((x.d1 < y.d1 AND x.d2 < y.d2) OR (x.d1 > y.d1 AND x.d2 > y.d2)) AS conc,
    COUNT(*) FILTER (x.d1 = y.d1 AND x.d2 <> y.d2) AS only1, COUNT(*) FILTER (x.d2 = y.d2 AND x.d1 <> y.d1) AS only2
  FROM q x JOIN q y ON x.run1 = y.run1 AND x.run2 = y.run2 AND x.node < y.node GROUP BY x.run1, x.run2)""",
    p=fx.POSITIONS_BY_RUN, t=TIED, q=PAIRED,
)
def t2_kendall(spark, d):
    return rounded(stability.kendall_pairs(frame(spark, d, fx.POSITIONS_BY_RUN)), "tau")


@query(
    """SELECT run1, run2, ROUND(s / CAST(200 - s AS DOUBLE), 6) AS source_jaccard, ROUND(k / CAST(200 - k AS DOUBLE), 6) AS sink_jaccard FROM (
  SELECT run1, run2, COUNT(*) FILTER (r1 < 100 AND r2 < 100) AS s, COUNT(*) FILTER (r1 >= n - 100 AND r2 >= n - 100) AS k FROM q GROUP BY run1, run2)""",
    p=fx.POSITIONS_BY_RUN, t=TIED, q=PAIRED,
)
def t3_end_set_jaccard(spark, d):
    return rounded(stability.end_set_jaccard(frame(spark, d, fx.POSITIONS_BY_RUN), 100), "source_jaccard", "sink_jaccard")


@query("SELECT node, ROUND(STDDEV_POP(CAST(r AS DOUBLE) / n), 6) AS rank_std FROM t GROUP BY node", p=fx.POSITIONS_BY_RUN, t=TIED)
def t4_rank_stability(spark, d):
    return rounded(stability.rank_stability(frame(spark, d, fx.POSITIONS_BY_RUN)), "rank_std")


@query(
    "SELECT ROUND(AVG(s), 6) AS mean_rank_std, ROUND(1 / SQRT(12), 6) AS independent FROM (SELECT STDDEV_POP(CAST(r AS DOUBLE) / n) AS s FROM t GROUP BY node)",
    p=fx.POSITIONS_BY_RUN, t=TIED,
)
def t4_mean_stability(spark, d):
    return rounded(stability.mean_stability(frame(spark, d, fx.POSITIONS_BY_RUN)), "mean_rank_std", "independent")


@query(
    """, spots AS (SELECT (r1 + (n - 1) * 1e-9) / (((n - 1) + 2 * ((n - 1) * 1e-9)) / 80) AS u, (r2 + (n - 1) * 1e-9) / (((n - 1) + 2 * ((n - 1) * 1e-9)) / 46) AS v FROM q WHERE run1 = 'price' AND run2 = 'size'),
near AS (SELECT *, (u - ROUND_EVEN(u, 0)) * (u - ROUND_EVEN(u, 0)) + 3 * (v - ROUND_EVEN(v, 0)) * (v - ROUND_EVEN(v, 0)) < (u - FLOOR(u) - 0.5) * (u - FLOOR(u) - 0.5) + 3 * (v - FLOOR(v) - 0.5) * (v - FLOOR(v) - 0.5) AS one FROM spots)
SELECT CASE WHEN one THEN 0 ELSE 1 END AS lattice, CAST(CASE WHEN one THEN ROUND_EVEN(u, 0) ELSE FLOOR(u) END AS BIGINT) AS x, CAST(CASE WHEN one THEN ROUND_EVEN(v, 0) ELSE FLOOR(v) END AS BIGINT) AS y, COUNT(*) AS n FROM near GROUP BY 1, 2, 3""",
    p=fx.POSITIONS_BY_RUN, t=TIED, q=PAIRED,
)
def t5_rank_hexagons(spark, d):
    return stability.rank_hexagons(frame(spark, d, fx.POSITIONS_BY_RUN), "price", "size")


@query(
    """SELECT CAST(LEAST(FLOOR(CAST(r1 AS DOUBLE) / (CAST(n - 1 AS DOUBLE) / 80)), 79) AS BIGINT) AS x, CAST(LEAST(FLOOR(CAST(r2 AS DOUBLE) / (CAST(n - 1 AS DOUBLE) / 80)), 79) AS BIGINT) AS y,
  COUNT(*) AS n FROM q WHERE run1 = 'price' AND run2 = 'size' GROUP BY 1, 2""",
    p=fx.POSITIONS_BY_RUN, t=TIED, q=PAIRED,
)
def t5_rank_density(spark, d):
    return stability.rank_density(frame(spark, d, fx.POSITIONS_BY_RUN), "price", "size")


@query(hist_sql("sd", "rank_std", 100), p=fx.POSITIONS_BY_RUN, t=TIED, sd="SELECT ROUND(STDDEV_POP(CAST(r AS DOUBLE) / n), 9) AS rank_std FROM t GROUP BY node")
def t5_stability_histogram(spark, d):
    sd = stability.rank_stability(frame(spark, d, fx.POSITIONS_BY_RUN)).select(F.round("rank_std", 9).alias("rank_std"))
    return rounded(graph.histogram(sd, "rank_std", 100), "lo")


# --- geometry --------------------------------------------------------------------------------------------------------


def _features(spark, d):
    return frame(spark, d, fx.FEATURES).withColumn("e", F.col("e").cast("array<double>"))


FLAT = "SELECT id, label, generate_subscripts(e, 1) - 1 AS k, CAST(UNNEST(e) AS DOUBLE) AS x FROM f"
DIMS = "SELECT k, AVG(x) AS m, STDDEV_POP(x) AS s FROM flat GROUP BY k"


@query("SELECT id, CAST(flat.k AS BIGINT) AS k, ROUND(CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END, 6) + 0 AS x FROM flat JOIN dims ON flat.k = dims.k", f=fx.FEATURES, flat=FLAT, dims=DIMS)
def i1_standardise(spark, d):
    out = geometry.standardise(_features(spark, d)).select("id", F.posexplode("e").alias("k", "x"))
    return rounded(out.withColumn("k", F.col("k").cast("long")), "x")


def _outputs(spark, d):
    """A layer with an output for each customer."""
    return spark.read.parquet(f"{d}/customer.parquet").count()


@query()
def i2_init_weights(spark, d):
    size, outputs = len(_features(spark, d).select("e").first()["e"]), _outputs(spark, d)
    out = None
    for s in geometry.SCHEMES:
        w = geometry.init_weights(spark, s, size, outputs).withColumn("scheme", F.lit(s))
        out = w if out is None else out.unionByName(w)
    return out.groupBy("scheme").agg(F.count("*").alias("n"), r6(F.avg("w")).alias("mean"), r6(F.stddev_pop("w")).alias("std"), F.count_if(F.col("w") == 0).alias("zeros"))


@query()
def i3_sample_marginal(spark, d):
    pool = graph.connectome_stats(frame(spark, d, fx.PART_FLOW))[1].select(F.col("weight_normed").alias("value"))
    return geometry.sample_marginal(pool, 64, _outputs(spark, d))


@query()
def i4_sample_lognormal(spark, d):
    fit = graph.lognormal_fit(frame(spark, d, fx.PART_FLOW)).first()
    return geometry.sample_lognormal(spark, fit["mu"], fit["sigma"], 64, _outputs(spark, d))


@query()
def i5_sample_degree(spark, d):
    return geometry.sample_degree(graph.connectome_stats(frame(spark, d, fx.PART_FLOW))[0], 64, _outputs(spark, d))


@query("""SELECT scheme, 64 * c AS n, CAST(CASE scheme WHEN 'sparse' THEN 64 * CEIL(0.8 * c) WHEN 'zeros' THEN 64 * c ELSE 0 END AS BIGINT) AS zeros, TRUE AS holds
FROM (SELECT COUNT(*) AS c FROM customer), (SELECT UNNEST(['random_normal', 'xavier_uniform', 'he_normal', 'kaiming_uniform', 'orthogonal', 'lecun_normal', 'sparse', 'constant_small', 'zeros']) AS scheme)""")
def i2_init_weights_holds(spark, d):
    """Cells and zeros of each scheme, and whether its deviation is the one that it stands for (within 3 percent)."""
    outputs = _outputs(spark, d)
    want = {
        "random_normal": 0.01, "xavier_uniform": (2 / (64 + outputs)) ** 0.5, "he_normal": (2 / 64) ** 0.5, "kaiming_uniform": (2 / 64) ** 0.5, "lecun_normal": (1 / 64) ** 0.5,
        "orthogonal": (1 / max(64, outputs)) ** 0.5, "sparse": 0.01 * 0.2**0.5, "constant_small": 0.0, "zeros": 0.0,
    }
    std = F.element_at(F.create_map(*[F.lit(x) for pair in want.items() for x in pair]), F.col("scheme"))
    return i2_init_weights(spark, d).select("scheme", "n", "zeros", (F.abs(F.col("std") - std) <= 0.03 * std + 1e-6).alias("holds"))


@query("SELECT CAST(64 * 64 AS BIGINT) AS n, CAST(0 AS BIGINT) AS wrong FROM (SELECT COUNT(*) FROM customer)")
def i2_orthogonal_holds(spark, d):
    """Of a layer with 100 outputs for each customer, the products of columns that are not orthonormal."""
    dots = geometry.column_products(geometry.orthogonal_rows(spark, 64, 100 * _outputs(spark, d)))
    return dots.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("dot") - (F.col("a") == F.col("b")).cast("int")) > 1e-9).alias("wrong"))


@query("SELECT name, 64 * c AS n, ROUND(SQRT(CAST(2 AS DOUBLE) / 64), 6) AS std FROM (SELECT COUNT(*) AS c FROM customer), (SELECT UNNEST(['marginal', 'lognormal', 'degree']) AS name)")
def i3_i4_i5_samplers_hold(spark, d):
    """Each sampler fills its layer and has the wanted deviation."""
    made = {"marginal": i3_sample_marginal(spark, d), "lognormal": i4_sample_lognormal(spark, d), "degree": i5_sample_degree(spark, d)}
    rows = [w.agg(F.lit(name).alias("name"), F.count("*").alias("n"), r6(F.stddev_pop("w")).alias("std")) for name, w in made.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT id AS i, CAST(k AS BIGINT) AS j, ROUND(x * (SQRT(CAST(2 AS DOUBLE) / 64) / (SELECT STDDEV_POP(x) FROM flat)), 6) + 0 AS w FROM flat", f=fx.FEATURES, flat=FLAT)
def i6_match_variance(spark, d):
    cells = _features(spark, d).select(F.col("id").alias("i"), F.posexplode("e").alias("j", "w"))
    return rounded(geometry.match_variance(cells.withColumn("j", F.col("j").cast("long")), (2 / 64) ** 0.5), "w")


#: Weights of two layers by their numbers, so that SQL can make them too.
FIRST, SECOND = "CAST((i * 31 + j * 17) % 13 - 6 AS DOUBLE) / 10", "CAST((i * 7 + j * 5) % 11 - 5 AS DOUBLE) / 10"
LAYER = """SELECT id, label, i, GREATEST(SUM(x * {w}), 0) AS x FROM (SELECT id, label, CAST(k AS BIGINT) AS j, x FROM {source}) t, (SELECT UNNEST(GENERATE_SERIES(0, 31)) AS i) GROUP BY id, label, i"""


@query(
    """SELECT id, label, CAST(1 AS INTEGER) AS layer, ROUND(SUM(x), 6) AS total FROM one GROUP BY id, label
UNION ALL SELECT id, label, CAST(2 AS INTEGER), ROUND(SUM(x), 6) FROM two GROUP BY id, label""",
    f=fx.FEATURES, flat="SELECT id, label, generate_subscripts(e, 1) - 1 AS k, CAST(UNNEST(e) AS DOUBLE) AS x FROM f", one=LAYER.format(w=FIRST, source="flat"), two=LAYER.format(w=SECOND, source="(SELECT id, label, i AS k, x FROM one)"),
)
def i7_forward_layers(spark, d):
    df = _features(spark, d)
    size = len(df.select("e").first()["e"])
    made = [spark.range(32 * n).selectExpr(f"id div {n} AS i", f"id % {n} AS j").selectExpr("i", "j", f"{w} AS w") for w, n in ((FIRST, size), (SECOND, 32))]
    layers = geometry.forward_layers(df, geometry.layer_matrices(made))
    return layers.select("id", "label", "layer", r6(F.aggregate("e", F.lit(0.0), lambda a, x: a + x)).alias("total"))


RELU = "SELECT id, label, CASE WHEN x > 0 THEN x ELSE 0 END AS x FROM flat"


def _relu(spark, d):
    return _features(spark, d).withColumn("e", F.transform("e", lambda x: F.greatest(x, F.lit(0.0))))


@query("SELECT label, ROUND(COUNT(*) FILTER (x = 0) / CAST(COUNT(*) AS DOUBLE), 6) AS dead_fraction FROM relu GROUP BY label", f=fx.FEATURES, flat=FLAT, relu=RELU)
def i8_dead_fraction(spark, d):
    return rounded(geometry.dead_fraction(_relu(spark, d), ["label"]), "dead_fraction")


@query("SELECT label, ROUND(STDDEV_POP(x), 6) AS std, STDDEV_POP(x) < 0.00000001 AS collapsed FROM flat GROUP BY label", f=fx.FEATURES, flat=FLAT)
def i9_collapse(spark, d):
    return rounded(geometry.collapse(_features(spark, d), ["label"]), "std")


@query()
def i10_pca(spark, d):
    df = _features(spark, d)
    mean, parts, _ = geometry.pca(df, 2)
    return geometry.project(df, mean, parts).select("id", r6(F.col("e")[0]).alias("x"), r6(F.col("e")[1]).alias("y"))


PLANE = """SELECT *, (sxx + syy) / 2 + SQRT(((sxx - syy) / 2) * ((sxx - syy) / 2) + sxy * sxy) AS l1, (sxx + syy) / 2 - SQRT(((sxx - syy) / 2) * ((sxx - syy) / 2) + sxy * sxy) AS l2
FROM (SELECT VAR_SAMP(u) AS sxx, VAR_SAMP(v) AS syy, COVAR_SAMP(u, v) AS sxy, AVG(u) AS mu, AVG(v) AS mv FROM uv)"""
UV = "SELECT id, CAST(e[1] AS DOUBLE) + 2 * CAST(e[2] AS DOUBLE) AS u, CAST(e[2] AS DOUBLE) - CAST(e[3] AS DOUBLE) / 2 AS v FROM f"


def _plane(spark, d):
    """Two dimensions made of three, where the axes are known in closed form."""
    return _features(spark, d).withColumn("e", F.array(F.get("e", F.lit(0)) + 2 * F.get("e", F.lit(1)), F.get("e", F.lit(1)) - F.get("e", F.lit(2)) / 2))


@query(
    """SELECT id, ROUND(((u - mu) * a + (v - mv) * b) / h, 6) + 0 AS x, ROUND(((u - mu) * c + (v - mv) * d) / h, 6) + 0 AS y FROM uv, (
  SELECT *, SQRT(a * a + b * b) AS h, CASE WHEN ABS(b) > ABS(a) THEN b * SIGN(b) ELSE -b * SIGN(a) END AS c, CASE WHEN ABS(b) > ABS(a) THEN -a * SIGN(b) ELSE a * SIGN(a) END AS d
  FROM (SELECT mu, mv, CASE WHEN ABS(p) >= ABS(sxy) THEN p * SIGN(p) ELSE p * SIGN(sxy) END AS a, CASE WHEN ABS(p) >= ABS(sxy) THEN sxy * SIGN(p) ELSE sxy * SIGN(sxy) END AS b FROM (SELECT *, l1 - syy AS p FROM plane)))""",
    f=fx.FEATURES, uv=UV, plane=PLANE,
)
def i10_pca_plane(spark, d):
    df = _plane(spark, d)
    mean, parts, _ = geometry.pca(df, 2)
    return geometry.project(df, mean, parts).select("id", (r6(F.col("e")[0]) + 0).alias("x"), (r6(F.col("e")[1]) + 0).alias("y"))


@query("SELECT CAST(CASE WHEN l1 / (l1 + l2) >= 0.9 THEN 1 ELSE 2 END AS INTEGER) AS effective_rank, ROUND(l1 / (l1 + l2), 6) AS first_ratio FROM plane", f=fx.FEATURES, uv=UV, plane=PLANE)
def i11_effective_rank_plane(spark, d):
    ratios = geometry.pca(_plane(spark, d), 2)[2]
    return spark.range(1).select(F.lit(geometry.effective_rank(ratios)).alias("effective_rank"), F.lit(round(float(ratios[0]), 6)).alias("first_ratio"))


@query()
def i11_effective_rank(spark, d):
    df = _features(spark, d)
    ratios = geometry.pca(df, 2)[2]
    return df.agg(F.count("*").alias("n")).select("n", F.lit(geometry.effective_rank(ratios)).alias("effective_rank"), F.lit(geometry.effective_rank(ratios, cap=50)).alias("capped_rank"))


@query(
    """SELECT ROUND(AVG(CASE WHEN GREATEST(a, b) > 0 THEN (b - a) / GREATEST(a, b) ELSE 0 END), 6) AS silhouette FROM (
  SELECT id, SUM(total) FILTER (own) / (MAX(n) FILTER (own) - 1) AS a, MIN(CASE WHEN own THEN NULL ELSE total / n END) AS b FROM (
    SELECT x.id, x.label = y.label AS own, SUM(LIST_DISTANCE(CAST(x.e AS DOUBLE[]), CAST(y.e AS DOUBLE[]))) AS total, COUNT(*) AS n FROM f x, f y GROUP BY x.id, x.label, y.label) GROUP BY id)""",
    f=fx.FEATURES,
)
def i12_silhouette(spark, d):
    return rounded(geometry.silhouette(_features(spark, d)), "silhouette")


@query()
def i13_linear_probe(spark, d):
    df = _features(spark, d)
    return df.agg(F.count("*").alias("n")).withColumn("accuracy", F.lit(geometry.linear_probe(df)))


@query("SELECT COUNT(*) AS n, TRUE AS optimal FROM f", f=fx.FEATURES)
def i13_probe_holds(spark, d):
    """The probe's weights are the optimum: every part of the penalised loss's gradient is nought."""
    df = _features(spark, d)
    model, ranked, cut = geometry.fit_probe(df, iterations=2000)
    steepest = geometry.probe_gradient(model, ranked.where(F.col("rank") < cut)).agg((F.max(F.abs("gradient")) < 1e-5).alias("optimal"))
    return ranked.agg(F.count("*").alias("n")).crossJoin(steepest)


@query("SELECT label, ROUND(AVG(v), 6) AS mean_norm FROM (SELECT id, label, SQRT(SUM(x * x)) AS v FROM relu GROUP BY id, label) GROUP BY label", f=fx.FEATURES, flat=FLAT, relu=RELU)
def i14_mean_norm(spark, d):
    return rounded(geometry.mean_norm(_relu(spark, d), ["label"]), "mean_norm")


@query()
def i15_geometry_sweep(spark, d):
    return geometry.geometry_sweep(_features(spark, d), list(geometry.SCHEMES), [1, 3], 32, curve_depth=3)


@query(
    """SELECT dataset, ROUND(MAX(m) FILTER (algo = '1-URGENT'), 4) AS "1-URGENT", ROUND(MAX(m) FILTER (algo = '5-LOW'), 4) AS "5-LOW" FROM (SELECT dataset, algo, MAX(score) AS m FROM r GROUP BY dataset, algo) GROUP BY dataset""",
    r=fx.RUNS,
)
def i16_pivot(spark, d):
    best = frame(spark, d, fx.RUNS).groupBy("dataset", "algo").agg(F.max("score").alias("m"))
    return geometry.pivot_metric(best, "dataset", "algo", "m", ["1-URGENT", "5-LOW"])


@query("SELECT label, COUNT(*) AS n FROM f GROUP BY label", f=fx.FEATURES)
def i17_class_counts(spark, d):
    return geometry.class_counts(frame(spark, d, fx.FEATURES))
