from pyspark.sql import functions as F

from arcorder.operators import history
from arcorder.sources import edges as sources


def test_config_hash_equals_sorted_json(spark):
    import hashlib
    import json

    row = spark.range(1).select(
        history.config_hash({"dataset": history.json_string(F.lit('a"b')), "algo": history.json_string(F.lit("x")), "epochs": F.lit("5"), "seed": F.lit("3"), "device": history.json_string(F.lit("cpu"))}).alias("h")
    )
    blob = json.dumps({"algo": "x", "dataset": 'a"b', "epochs": 5}, sort_keys=True)
    assert row.first()["h"] == hashlib.sha256(blob.encode()).hexdigest()[:12]


def test_one_run_has_no_deviation_and_commits_are_distinct(spark):
    rows = [("a", "d", "h", 1, 2000.5, 50.0, 1.0, "0123456789abcdef"), ("a", "d", "h", 1, 3000.5, 60.0, 2.0, None), ("b", "d", "h", 2, 1.5, 50.0, 1.0, "")]
    runs = spark.createDataFrame(rows, "algo string, dataset string, config_hash string, seed long, score double, pct double, wall_clock_s double, git_commit string")
    got = {r["algo"]: r for r in history.aggregate_runs(runs).collect()}
    assert got["a"]["n_seeds"] == 2 and got["a"]["seeds"] == "1, 1" and got["a"]["git_commits"] == "0123456789a, n/a"
    assert got["a"]["score_text"] == "2,500" or got["a"]["score_text"] == "2,501"
    assert got["b"]["score_std"] is None and got["b"]["score_text"] == "1.5000"


def test_records_round_trip(spark, tmp_path):
    scores = spark.createDataFrame([("a", "d", 42, 1.5, 2.5, 0.1, None, "abcdef012345")], "algo string, dataset string, seed long, score double, pct double, wall_clock_s double, git_commit string, config_hash string")
    records = history.build_records(scores, F.to_timestamp(F.lit("2026-06-21 00:16:07")), {"python": "3", "jax_or_torch": "spark", "cuda": None, "gpu": None})
    sources.write_runs(records, str(tmp_path / "runs"))
    back = sources.read_runs(spark, str(tmp_path / "runs" / "*.json")).first()
    assert back["exp_id"] == "20260621T001607Z-a-d-s42-abcdef" and back["env"]["cuda"] is None and back["timestamp"] == "2026-06-21T00:16:07Z"


def test_gates_need_every_dataset(spark):
    base = spark.createDataFrame([("x", 50.0, 1.0), ("y", 50.0, 1.0)], "dataset string, mean double, std double")
    runs = spark.createDataFrame([("good", "x", 55.0), ("good", "y", 56.0), ("half", "x", 60.0), ("weak", "x", 51.0), ("weak", "y", 51.0)], "algo string, dataset string, pct double")
    assert {r["algo"] for r in history.screen(runs, base).where("promoted").collect()} == {"good"}
    assert {r["algo"] for r in history.confirm(runs, base).where("confirmed").collect()} == {"good"}
