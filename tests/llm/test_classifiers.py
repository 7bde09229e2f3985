import collections
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arcorder.llm import language_id, quality, queries, toxicity
from arcorder.llm.common import bounded_rows, split_batch, text_bytes, written
from arcorder.llm.hashing import SOLID, WORD, Forest, ngram_hashes, shingle_sets, word_hashes, word_spans

DATA = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "\n \n"), (4, "1234 5678"), (5, "word " * 40_000), (5, "word " * 40_000), (None, "the and of"), (6, "日本語のテキスト")]


def raw(texts):
    return text_bytes(pa.array(texts, pa.string()))


def test_word_spans_and_hashes_follow_the_texts():
    texts = ["ab cd", None, "", " x", "cd", "ab  cd\nab", "é1 é1"]
    off, data = raw(texts)
    for letters in (WORD, SOLID):
        starts, ends, first = word_spans(off, data, letters)
        words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
        assert words == [w for t in texts for w in (t or "").split()]
        assert np.diff(first).tolist() == [len((t or "").split()) for t in texts]
    h = word_hashes(data, starts, ends)
    assert len(set(h.tolist())) == len(set(words)) and all(h[i] == h[words.index(w)] for i, w in enumerate(words))
    assert [len(s) for s in shingle_sets(*raw(["a b c d e f", "a b", "", None, "a a a a a a a"]), 5)] == [2, 1, 0, 0, 1]
    assert len(ngram_hashes(h[:2], 3)) == 0


def test_slices_of_a_batch_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 100, 0, 7)], pa.string())], names=["t"]).slice(1)
    assert [r for p in split_batch(batch, 0, 8) for r in p.column(0).to_pylist()] == ["x" * n for n in (100, 0, 7)]


def test_indicators_do_not_depend_on_the_batch():
    texts = ["b b\na", "a a b", None, "b", "", "b b"]
    alone = [next(iter(quality.indicators(*raw([t])))).tolist() for t in texts]
    assert [s.tolist() for s in quality.indicators(*raw(texts))] == alone
    together = toxicity.word_rows(*raw(texts))
    assert together[1].tolist() == [3, 3, 1, 1, 1, 2]


def test_forest_joins():
    f = Forest(6)
    f.join(np.array([5, 4]), np.array([4, 3]))
    f.join(np.array([3]), np.array([0]))
    assert f.root.tolist() == [0, 1, 2, 0, 0, 0]


def test_quality_fit_holds_one_array_of_values():
    rng = np.random.default_rng(3)
    flat, lengths = rng.integers(0, 1 << quality.BITS, 1_500_000, dtype=np.int32), np.full(1500, 1000)
    sets = quality.views(flat, lengths)
    labels = (np.arange(1500) % 3 > 0).astype(int)
    counts = quality.counted(sets)
    assert counts.tolist() == np.bincount(flat, minlength=1 << quality.BITS).tolist() and not quality.counted([]).any()
    tracemalloc.start()
    quality.fit_sets(sets, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # eight bytes for each entry of the four fifths that are fitted on, and a few megabytes for the weights and views
    assert peak < 0.8 * 8 * len(flat) + (6 << 20)


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(40, 6, replace=False)).astype(np.int32) for _ in range(60)]
    y = np.where([3 in r or 7 in r for r in rows], 1, -1)
    values = [np.ones(6) for _ in rows]
    c = np.full(60, 0.5)
    w, b = quality.dual_coordinate_descent(rows, values, y, c, epochs=400)

    def objective(w, b):
        return 0.5 * (w @ w + b * b) + sum(0.5 * max(0, 1 - k * (w[r].sum() + b)) for r, k in zip(rows, y, strict=True))

    best = objective(w, b)
    for _ in range(200):
        step = np.zeros_like(w)
        step[:40] = rng.normal(scale=0.01, size=40)
        assert objective(w + step, b + rng.normal(scale=0.01)) >= best - 1e-3


def test_forward_backward_against_all_paths():
    import itertools

    crf = language_id.Crf(["a", "b", "c"], np.zeros(0, np.uint64))
    rng = np.random.default_rng(1)
    crf.move, crf.first = rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths, s = np.array([1, 4, 3]), rng.normal(size=(8, 3))
    begin = np.array([0, 1, 5])
    p, pairs = crf.marginals(s, begin, lengths)
    want, moves = np.zeros((8, 3)), np.zeros((3, 3))
    for a, n in zip(begin, lengths, strict=True):
        weight = {}
        for path in itertools.product(range(3), repeat=int(n)):
            weight[path] = np.exp(crf.first[path[0]] + sum(s[a + i, k] for i, k in enumerate(path)) + sum(crf.move[x, y] for x, y in zip(path, path[1:], strict=False)))
        z = sum(weight.values())
        for path, v in weight.items():
            for i, k in enumerate(path):
                want[a + i, k] += v / z
            for x, y in zip(path, path[1:], strict=False):
                moves[x, y] += v / z
    assert p == pytest.approx(want) and pairs == pytest.approx(moves)


def test_crf_labels_code_switched_lines(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    crf = language_id.fit(docs)
    text = "der die und ist ein " * 4 + "the and of that is with " * 4
    off, data = raw([text])
    starts, ends, first = word_spans(off, data)
    h = word_hashes(data, starts, ends)
    p, _ = crf.marginals(crf.emissions(*crf.features(data, starts, ends, h)), np.array([0]), np.array([len(h)]))
    best = [crf.languages[i] for i in p.argmax(1)]
    assert best[:18].count("de") >= 16 and best[22:].count("en") >= 20
    assert np.abs(p.sum(1) - 1).max() < 1e-9


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = [r for r in queries.op4_language(spark, DATA).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in got]) > 0.97
    for name, column, least in (("op3_quality", "quality", 0.95), ("op6_toxicity", "toxic", 0.9)):
        rows = queries.QUERIES[name](spark, DATA).collect()
        assert len(rows) == len(langs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
        held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
        assert np.mean([r["predicted"] == labels[r["doc_id"]][column] for r in held]) > least


def test_classifiers_on_odd_rows(spark):
    df = spark.createDataFrame([(i, t, 1.0) for i, t in ODD], "doc_id long, text string, score double")
    lab = spark.createDataFrame([(1, 0), (2, 1), (4, 0), (5, 1), (6, None)], "doc_id long, label int")
    rows = quality.training_rows(df, lab, "label", lambda c: F.lit(True), 100)
    q, t = quality.fit(rows), toxicity.fit(rows)
    for out in (quality.score(df, q, ["doc_id"]), toxicity.score(df, t, ["doc_id"])):
        assert all(0 <= r["score"] <= 1 for r in out.collect()) and out.count() == len(ODD)
    assert quality.score(df, q, df.columns, score_col="q").columns == [*df.columns, "q"]
    none = quality.training_rows(df.limit(0), lab.limit(0), "label", lambda c: F.lit(True), 100)
    assert quality.score(df, quality.fit(none), ["doc_id"]).count() == len(ODD) and toxicity.score(df, toxicity.fit(none), ["doc_id"]).count() == len(ODD)
    crf = language_id.fit(df.withColumn("lang", F.when(F.col("doc_id") > 4, "en")))
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, crf, ["doc_id"]).collect()}
    assert out[1] == out[2] == out[3] == out[4] == "und" and out[5] == "en"
    assert language_id.identify(df.limit(0), crf, ["doc_id"]).count() == 0
    assert language_id.identify(df, language_id.fit(df.limit(0).withColumn("lang", F.lit("en"))), ["doc_id"]).count() == len(ODD)


def test_letter_clusters_part_scripts_and_stay_few():
    latin, greek, han = ["the quick brown fox jumps over it"] * 9, ["και οι άλλοι ήταν εδώ μαζί μας"] * 9, ["我们在这里看到很多东西"] * 9
    off, raw = text_bytes(pa.array(latin + greek + han + ["", None, "12 34"]))
    x = toxicity.profiles(off, raw)
    centres = toxicity.clusters(x[:27])
    groups = (x @ centres.T).argmax(1)[:27]
    assert len(centres) <= toxicity.GROUPS and len(set(groups)) == 3 and all(len(set(groups[i : i + 9])) == 1 for i in (0, 9, 18))
    assert len(toxicity.clusters(x[:9])) == 1 and len(toxicity.clusters(x[:0])) == 1 and (x[27:] == 0).all()


def test_every_pipeline_stage_on_odd_rows(spark):
    extra = [(i, t, None, "s", None, "e", "f", "g") for i, t in ODD]
    docs = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, score string, base string, row string")
    for rows in (docs, docs.limit(0)):
        at = rows
        for name, stage in corpus_pipeline.STAGES:
            at = written(stage(spark, at, DATA), f"odd-{name}")
            assert name == "packing" or at.columns == docs.columns


def test_pipeline_against_its_stages_one_by_one(spark):
    """Rows that go in and out of each stage of run(), from the operators' own full results in plain Python."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scores = {r["doc_id"]: r["score"] for r in queries.op3_quality(spark, DATA).collect()}
    kept = [r for r in docs.collect() if scores[r["doc_id"]] >= 0.7]
    first = {}
    for r in sorted(kept, key=lambda r: r["doc_id"]):
        first.setdefault(r["text"] or "", r["doc_id"])
    stage = spark.createDataFrame([r for r in kept if first[r["text"] or ""] == r["doc_id"]], docs.schema)
    near = {r["doc_id"] for r in corpus_pipeline.near_stage(spark, stage, DATA).collect()}
    out = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in out} == near
    lengths = collections.Counter()
    for r in out:
        lengths[r["doc_id"]] += r["length"]
    assert all(lengths[r["doc_id"]] == r["doc_tokens"] for r in out)


def test_log_count_ratio_and_link_against_plain_formulas():
    sets, y = [np.array(s, dtype=np.int32) for s in ([1, 2], [2, 3], [3], [1, 2, 3])], np.array([1, 1, -1, -1])
    r = quality.log_count_ratio(sets, y)
    p, q = (np.array([1 + sum(f in s for s, k in zip(sets, y, strict=True) if k == side) for f in range(1 << quality.BITS)]) for side in (1, -1))
    assert r == pytest.approx(np.log(p / p.sum() / (q / q.sum())))
    rng = np.random.default_rng(0)
    m = rng.normal(size=200)
    y = np.where(m + rng.normal(size=200) > 0.3, 1, -1)
    a, b = quality.logistic_link(m, y)
    good, bad = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * m + b)))
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).sum()

    assert all(loss(a, b) <= loss(a + x, b + z) + 1e-6 for x, z in rng.normal(scale=0.05, size=(100, 2)))


def small_net(monkeypatch):
    monkeypatch.setattr(toxicity, "BITS", 5)
    net = toxicity.Net(seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["c"] *= 2
    net.p["b"] += 0.03  # a blank text has no kink at 0 then
    return net


NET_TEXTS = ["a b c d e f g", "", "x", "b a b a", "one two three four five six seven eight nine ten"]


def test_forward_pass_against_plain_loops(monkeypatch):
    net = small_net(monkeypatch)
    rows, n = toxicity.word_rows(*raw(NET_TEXTS))
    got, at = net.logits(rows, n), 0
    for i, m in enumerate(n):
        x = [sum(net.p["e"][k, rows[at + j, k]] for k in range(toxicity.TABLES)) for j in range(m + toxicity.PAD)]
        total = net.p["o"][0]
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                top = max(sum(x[j + o] @ net.p["c"][k, o][:, f] for o in range(width)) for j in range(m)) + net.p["b"][k * toxicity.FILTERS + f]
                total += net.p["w"][k * toxicity.FILTERS + f] * max(0, top)
        assert got[i] == pytest.approx(total)
        at += m + toxicity.PAD


def test_gradients_against_differences(monkeypatch):
    net = small_net(monkeypatch)
    rows, n = toxicity.word_rows(*raw(NET_TEXTS))
    y, weight = np.array([1.0, 0, 1, 0, 1]), np.array([0.2, 0.1, 0.3, 0.2, 0.2])
    g, pos, change = net.gradients(rows, n, y, weight)
    g["e"] = np.zeros_like(net.p["e"])
    for side in range(toxicity.TABLES):
        np.add.at(g["e"][side], rows[pos, side], change)
    g["e"][:, 0] = 0

    def loss():
        p = 1 / (1 + np.exp(-net.logits(rows, n)))
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + 0.5e-4 * (net.p["w"] ** 2).sum()

    rng = np.random.default_rng(1)
    for name in g:
        flat, mine = net.p[name].reshape(-1), np.asarray(g[name]).reshape(-1)
        places = rng.choice(np.flatnonzero(np.abs(mine) > 1e-7) if name == "e" else len(flat), min(12, len(flat)), replace=False)
        for i in places:
            old, step = flat[i], 1e-5
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert (up - down) / (2 * step) == pytest.approx(mine[i], rel=2e-3, abs=1e-6), name


def test_samples_for_the_driver_are_bounded_and_do_not_depend_on_the_order(spark):
    rows = [(i, "x" * (i % 50), 1) for i in range(400)] + [(7, "y" * 5000, 0)] * 300 + [(None, "z", 1)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    got = bounded_rows(df, "text", 200, 1600).to_pylist()
    assert len(got) <= 200 and sum(len(r["text"]) for r in got) <= 1600 and max(len(r["text"]) for r in got) <= 100
    assert got == bounded_rows(df.repartition(7).orderBy("label", "text"), "text", 200, 1600).to_pylist()
    every = bounded_rows(df, "text", 10_000, 1 << 20).to_pylist()
    assert len(every) == 401 and sum(r["id"] == 7 for r in every) == 2
    assert bounded_rows(df.limit(0), "text", 10, 10).num_rows == 0


def test_language_sample_takes_rare_languages_and_whole_texts(spark):
    rows = [(i, "the and of that is with", "en") for i in range(600)] + [(1000 + i, "der die und ist ein mit", "de") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    crf = language_id.fit(df, sample=40)
    assert crf.languages == ["de", "en"]
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, crf, ["doc_id"]).collect()}
    assert np.mean([out[i] == lang for i, _, lang in rows]) > 0.99
    # of equal sums the first by name
    tied = language_id.Crf(["aa", "bb"], np.zeros(0, np.uint64))
    assert tied.label(*raw(["word and word", ""]))[0] == ["aa", "aa"]


def test_kept_columns_with_names_of_the_output(spark):
    df = spark.createDataFrame([(1, "a b", 0.5, "x", "y")], "doc_id long, text string, SCORE double, letters string, text_ string")
    model, net, crf = quality.Model(np.zeros(1 << quality.BITS), 0.0, 1.0, 0.0), toxicity.Net(), language_id.Crf(["en"], np.zeros(0, np.uint64))
    net.calibrate(np.zeros(0), np.zeros(0), np.zeros(0))
    for run in (lambda keep: quality.score(df, model, keep), lambda keep: toxicity.score(df, net, keep), lambda keep: language_id.identify(df, crf, keep)):
        with pytest.raises(ValueError):
            run(["doc_id", "SCORE"])
        assert run(["letters", "text_", "text"]).first()["text"] == "a b"
