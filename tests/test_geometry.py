import numpy as np
import pytest

from arcorder.functions.columns import natural_log
from arcorder.operators import geometry


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(0)
    label = rng.integers(0, 2, 90)
    x = rng.normal(size=(90, 6)) + 3 * label[:, None]
    return spark.createDataFrame([(i, int(label[i]), [float(v) for v in x[i]]) for i in range(90)], "id long, label int, e array<double>"), x, label


def brute_silhouette(x, label):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        a, b = d[i][own].mean(), min(d[i][label == k].mean() for k in set(label) if k != label[i])
        out.append((b - a) / max(a, b))
    return np.mean(out)


@pytest.mark.parametrize("block", [16, 2048])
def test_silhouette_in_blocks(features, block):
    df, x, label = features
    assert geometry.silhouette(df, block=block).first()["silhouette"] == pytest.approx(brute_silhouette(x, label))


def test_pca_and_rank(features):
    df, x, _ = features
    _, parts, ratios = geometry.pca(df, 2)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert ratios == pytest.approx(values / values.sum()) and parts.shape == (2, 6)
    assert geometry.effective_rank(np.array([0.5, 0.3, 0.15, 0.05])) == 3
    assert geometry.effective_rank(np.array([0.5, 0.3, 0.15, 0.05]), cap=2) == 3


def test_forward_pass_is_a_product(features):
    df, x, _ = features
    w = [np.random.default_rng(1).normal(size=(4, 6)), np.random.default_rng(2).normal(size=(3, 4))]
    got = {(r["id"], r["layer"]): r["e"] for r in geometry.forward_layers(df, w).collect()}
    h = np.maximum(x @ w[0].T, 0)
    assert got[5, 1] == pytest.approx(h[5]) and got[5, 2] == pytest.approx(np.maximum(h @ w[1].T, 0)[5])


def test_schemes(spark):
    for scheme in geometry.SCHEMES:
        w = geometry.init_weights(spark, scheme, 20, 10).toPandas()
        m = np.zeros((10, 20))
        m[w["i"], w["j"]] = w["w"]
        assert len(w) == 200
        if scheme == "orthogonal":
            assert m @ m.T == pytest.approx(np.eye(10))
        if scheme == "sparse":
            assert (m == 0).sum(0).tolist() == [8] * 20
    assert geometry.linear_probe is not None


def test_probe_finds_an_easy_split(features):
    assert geometry.linear_probe(features[0]) > 0.9


def test_moments_far_from_the_origin(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 4)) * [2, 1, 0.4, 0.2]
    label = rng.integers(0, 2, 600)
    near, far = (spark.createDataFrame([(i, int(label[i]), (x[i] + shift).tolist()) for i in range(600)], "id long, label int, e array<double>").repartition(5) for shift in (0, 1e8))
    want = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    for df in (near, far):
        assert geometry.pca(df, 2)[2] == pytest.approx(want / want.sum(), abs=1e-6)
    assert geometry.silhouette(far).first()[0] == pytest.approx(geometry.silhouette(near).first()[0], abs=1e-6)


@pytest.mark.parametrize(("fan_in", "fan_out"), [(5, 20_000), (20_000, 5), (7, 7)])
def test_orthogonal_layers_by_blocks(spark, fan_in, fan_out):
    w = geometry.init_weights(spark, "orthogonal", fan_in, fan_out).toPandas()
    m = np.zeros((fan_out, fan_in))
    m[w["i"], w["j"]] = w["w"]
    m = m if fan_out >= fan_in else m.T
    assert len(w) == fan_in * fan_out and m.T @ m == pytest.approx(np.eye(min(fan_in, fan_out)), abs=1e-9)


def test_moments_with_partitions_that_hold_no_row(features):
    df, x, _ = features
    n, mean, cov = geometry.gram(df.repartition(8, "label"))  # two labels, so most partitions are empty
    assert n == 90 and mean == pytest.approx(x.mean(0)) and cov == pytest.approx(np.cov(x.T))


def test_ks_of_a_logarithm_of_nought(spark):
    logs = spark.createDataFrame([(w,) for w in (0.0, 1.0, 2.0, 5.0, None)], "w double").select(natural_log("w").alias("lw"))
    assert [r[0] for r in logs.collect()] == [-np.inf, 0.0, np.log(2), np.log(5), None]
    got = geometry.ks_normal(logs, "lw").first()
    assert np.isnan(got["statistic"]) and np.isnan(got["pValue"])
    assert 0 < geometry.ks_normal(logs.where("lw >= 0"), "lw").first()["statistic"] < 1
    assert geometry.ks_normal(logs.where("lw > 9"), "lw").first()["statistic"] is None


@pytest.mark.parametrize("sampler", ["marginal", "degree"])
def test_samplers_do_not_broadcast_the_ranks(spark, sampler):
    """Few different values of many rows: their ranks must not go through the driver."""
    pool = spark.range(40_000).selectExpr("id % 3 + 1.0D AS value")
    w = geometry.sample_marginal(pool, 8, 50) if sampler == "marginal" else geometry.sample_degree(pool.toDF("in_degree_ratio"), 8, 50)
    plan = w._jdf.queryExecution().optimizedPlan().toString()
    assert w.count() == 400 and ("leftHint=(strategy=merge" in plan or "rightHint=(strategy=merge" in plan)


def test_qq_points_of_a_logarithm_of_nought(spark):
    logs = spark.createDataFrame([(w,) for w in (2.0, 0.0, 1.0)], "w double").select(natural_log("w").alias("lw"))
    got = [tuple(r) for r in geometry.qq_points(logs, "lw").orderBy("rank").collect()]
    assert [r[:2] for r in got] == [(0, -np.inf), (1, 0.0), (2, np.log(2))] and got[1][2] == pytest.approx(0, abs=1e-9)


def test_products_of_columns_shuffle_no_cells(spark):
    """What is shuffled is a sum for each pair of columns and task, not a row for each cell of the layer."""
    rows = spark.range(3000).selectExpr("array(id / 1000, 1D, -id % 7D) AS values").repartition(3)
    x = np.array([r["values"] for r in rows.collect()])
    df = geometry.column_products(rows)
    got = {(r["a"], r["b"]): r["dot"] for r in df.collect()}
    assert np.array([[got[a, b] for b in range(3)] for a in range(3)]) == pytest.approx(x.T @ x)
    w = {(r["i"], r["j"]): r["w"] for r in geometry.init_weights(spark, "orthogonal", 4, 30).collect()}
    assert all(w[r["row"], j] == v for r in geometry.orthogonal_rows(spark, 4, 30).collect() for j, v in enumerate(r["values"]))
