import collections
import functools
import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arcorder.llm import bpe, components, embedding_dedup, exact_dedup, html_text, ngram_join, packing, pii, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def library():
    return Tokenizer.from_file(PATH)


@functools.cache
def own():
    return bpe.Bpe(bpe.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def tokenizer():
    return library()


@pytest.fixture(scope="module")
def model():
    return own()


@pytest.fixture(scope="module")
def vocabulary(spark):
    return queries.vocabulary(spark)


PIECES = [" ", "  ", "\n", "a", "the", "'", "'s", "'ll", "12", "é", "日本", "🎉", "!", "\t", " ", "<|endoftext|>", "ing", "%%%", "\r\n"]
HARD = ["", None, "a   b", "foo\n \nbar", "x \n y", "it's 's\n's", "<|endoftext|>a <|endoftext|>", "a" * 3000 + " " + "ab" * 2000, "a b\x1c c", "﻿ x"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_bpe_equals_the_library(text):
    ids = np.frombuffer(own().encode([text])[0], "<u4")
    want = library().encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want
    assert own().decode_bytes(ids).decode("utf-8", "replace") == library().decode(want, skip_special_tokens=False)


def test_bpe_on_hard_texts_and_with_full_caches(model, tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    for _ in range(3):
        for text, got in zip(HARD, model.encode(HARD), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_block_and_single_trees_agree(model):
    rng = random.Random(1)
    for n in (2, 3, 17, 100, 129):
        word = bytes(rng.choice(b"abcdethin g") for _ in range(n)).decode()
        w = 1 << max(0, (n - 2).bit_length())
        letters = np.zeros((1, w + 2), dtype=np.uint8)
        letters[0, :n] = np.frombuffer(word.encode(), dtype=np.uint8)
        assert model.merge_block(letters, np.array([n]), w)[0] == model.merge_long(word.encode())


def test_bpe_job_keeps_rows_and_other_columns(spark, vocabulary):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y")], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, vocabulary, keep=["doc_id"]), vocabulary).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in out) == [(0, ""), (1, "a b"), (1, "a b"), (2, "")]
    assert bpe.encode(df.limit(0), vocabulary).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(df, vocabulary, keep=["doc_id", "ids"])


ROWS = [(5, "same"), (2, "same"), (9, "same"), (9, "same"), (None, "same"), (1, None), (3, ""), (4, "x" * 200_000), (7, "other "), (8, "other")]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup_against_groups(spark, keep):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    out = exact_dedup.exact_dedup(df, keep=keep).collect()
    groups = collections.defaultdict(list)
    for i, t in ROWS:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    assert len(out) == len(ROWS)
    for sha, ids in groups.items():
        mine = [r for r in out if r["text_sha256"] == sha]
        known = [i for i in ids if i is not None]
        want = max(known) if keep == "largest" else min(known)
        assert {(r["keep_id"], r["group_size"]) for r in mine} == {(want, len(ids))}
        assert [r["doc_id"] for r in mine if r["kept"]] == [want]


def test_exact_dedup_spreads_a_hot_text(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_dedup.exact_dedup(df.repartition(8))
    hot = out.where("group_size > 1")
    assert hot.count() == 2000 and hot.where("kept").select("doc_id").collect()[0][0] == 1 and hot.where("kept").count() == 1


def test_without_duplicates_keeps_columns(spark):
    df = spark.createDataFrame([(i, t, "c", "d", "e") for i, t in ROWS], "doc_id long, text string, sha string, kept_id string, kept_sha string")
    out = exact_dedup.without_duplicates(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 2, 4, 7, 8]
    assert exact_dedup.without_duplicates(df.limit(0)).count() == 0


def test_packing_covers_every_id_once(spark, vocabulary, tokenizer):
    rng = random.Random(4)
    texts = [None, "", "a"] + [" ".join(rng.choice(["the", "of", "stone", "river"]) for _ in range(rng.choice([3, 40, 700, 3000]))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    rows = packing.pack(df, vocabulary).collect()
    docs, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        docs[r["id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        parts = sorted(docs[i], key=lambda r: r["start"])
        assert [x for r in parts for x in np.frombuffer(bytes(r["ids"]), "<u4").tolist()] == ids
        assert {r["doc_tokens"] for r in parts} == {len(ids)}
    padding = 0
    for parts in sequences.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == [sum(x["length"] for x in parts[:k]) for k in range(len(parts))]
        total = sum(r["length"] for r in parts)
        assert total <= 1024
        padding += 0 if total & (total - 1) == 0 else 1024 - total
    assert padding == 0
    assert packing.pack(df.limit(0), vocabulary).count() == 0


def test_packing_and_the_encoder_agree_on_the_tables(spark, vocabulary, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.lit("x").alias("id"), F.lit("y").alias("ids"))
    packed = collections.defaultdict(list)
    for r in packing.pack(docs, vocabulary).collect():
        packed[r["id"]].append((r["start"], bytes(r["ids"])))
    encoded = {r["doc_id"]: r["ids"] for r in bpe.encode(docs.select("doc_id", "text"), vocabulary, keep=["doc_id"]).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert packed.keys() == encoded.keys() == texts.keys()
    for i, parts in packed.items():
        ids = np.frombuffer(b"".join(x for _, x in sorted(parts)), "<u4").tolist()
        assert ids == [*encoded[i], 0] == [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 0]


def grouped(n, pairs):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def shingles(text):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(30, 200))] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(rng.choice([1, 2, 6, 20])):
            c = list(b)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))
    return texts + [None, "", "one two", "One two!", "...", "one two three four five", "word " * 3000, "word " * 4000]


@pytest.mark.parametrize("tile", [1024, 8])
def test_ngram_join_against_all_pairs(spark, tile, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    texts = near_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sets = [shingles(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    root, links = grouped(len(texts), pairs), collections.Counter(x for p in pairs for x in p)
    out = {r["doc_id"]: r for r in ngram_join.ngram_join(df).collect()}
    assert len(out) == len(texts)
    for i in range(len(texts)):
        assert (out[i]["class_id"], out[i]["n_links"], out[i]["kept"]) == (root[i], links[i], root[i] == i), texts[i]


@pytest.mark.parametrize("rows", [6, 60])
def test_tiles_of_two_blocks_compare_across_only(rows):
    """A block of a crowded node may hold no candidate; the pairs of the other one belong to that one's own tile."""
    sig = np.ones((rows, ngram_join.TRIES * ngram_join.DEPTH), dtype=np.uint8)
    none, depth = np.zeros(rows, dtype=np.int64), np.full(rows, ngram_join.DEPTH)
    for first in (0, 2, rows):
        side = np.repeat([-1, 1], [first, rows - first])
        assert sum(len(r) for r, _, _ in ngram_join.tile_pairs(sig, none, side, none, depth, 1)) == first * (rows - first)
    assert sum(len(r) for r, _, _ in ngram_join.tile_pairs(sig, none, none, none, depth, 1)) == rows * (rows - 1) // 2


def test_ngram_join_defined_cases(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", None), (2, None, None)]
    out = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string, class_id string")).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"], r["n_links"]) for r in out) == [(0, None, 0), (1, 1, 1), (1, 1, 1), (2, 2, 0)]
    assert ngram_join.ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ngram_join_keeps_links_of_texts_that_share_an_id(spark):
    words = [f"w{i}" for i in range(90)]
    a, b = " ".join(words[:40]), " ".join(words[40:])
    rows = [(3, a + " gg"), (4, b + " fourteen"), (5, a), (5, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {(r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in ngram_join.ngram_join(df).collect()}
    assert out == {(3, 3, 1, True), (4, 4, 1, True), (5, 3, 1, False), (5, 4, 1, False)}
    left = ngram_join.without_near_duplicates(df.select("*", F.lit(1).alias("id"), F.lit(2).alias("key")))
    assert left.columns == ["doc_id", "text", "id", "key"] and {r["text"] for r in left.collect()} == {a + " gg", b + " fourteen"}


def test_prefixes_are_shortened_until_the_recall_is_reached(spark):
    """A class that only has very like candidates stops at the full depth; others go on to the depth of the threshold."""
    least = ngram_join.least_depth(0.8)
    assert ngram_join.found_at(0.8, least) >= ngram_join.RECALL > ngram_join.found_at(0.8, least + 1)
    for depth in range(least, ngram_join.DEPTH + 1):
        assert ngram_join.found_at(ngram_join.enough(depth), depth) == pytest.approx(ngram_join.RECALL, abs=1e-9)
    df = spark.createDataFrame(list(enumerate(near_texts())), "doc_id long, text string")
    docs = df.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("print"), F.lower("text").alias("text")).mapInArrow(ngram_join._signatures(5), "id long, print long, set binary, sig binary")
    classes = docs.where("set IS NOT NULL").dropDuplicates(["set"]).select(F.col("id").alias("cls"), "set", "sig").cache()
    found = ngram_join._candidates(classes, 0.5).collect()
    assert ngram_join.least_depth(0.5) <= min(r["depth"] for r in found) < 6 and max(r["depth"] for r in found) == ngram_join.DEPTH
    assert all(len(r["prefix"]) == r["depth"] for r in found)


def test_ngram_join_against_all_pairs_of_the_tables(spark):
    """Every link of sf0.01, by plain set overlap of all pairs that share a shingle."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = {r["doc_id"]: frozenset(shingles(r["text"])) for r in rows}
    holders, shared = collections.defaultdict(list), collections.Counter()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for h in holders.values():
        shared.update((a, b) for k, a in enumerate(h) for b in h[k + 1 :])
    links = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
    want = collections.Counter(x for p in links for x in p)
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.ngram_join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert len(links) > 100 and all(got[i] <= want[i] for i in sets)
    assert sum(got.values()) >= 0.999 * sum(want.values())


@pytest.mark.parametrize("block", [4096, 40])
def test_embedding_dedup_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "TILE", 32)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 16))
    v = np.concatenate([base, base[:10] + 0.05 * rng.normal(size=(10, 16)), np.repeat(base[:1], 70, 0) * rng.uniform(0.1, 9, (70, 1))]).astype(np.float32)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0] * 15 + [None]), (905, [float("inf")] * 16), (906, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(3).withColumns({"row": F.lit("x"), "id": F.lit("y"), "n_links": F.lit("z")})
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    root = grouped(len(v), list(zip(*np.nonzero(near), strict=True)))
    out = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(out) == len(rows) + len(odd)
    for i in range(len(v)):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (near[i].sum(), root[i], root[i] == i)
    for i, _ in odd:
        assert out[i]["n_links"] == 0 and out[i]["component_id"] == i
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_pairs_at_the_threshold_do_not_depend_on_their_tile():
    """A cosine within rounding of the threshold is decided by one formula, in dense and sparse tiles alike."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(40, 24))
    v = np.concatenate([a, a + 0.28 * rng.normal(size=(40, 24))])
    u = v / np.abs(v).max(1)[:, None]
    norm = np.sqrt(np.einsum("ij,ij->i", u, u))
    for k in range(10):
        threshold = float(np.einsum("i,i->", u[k], u[40 + k]) / (norm[k] * norm[40 + k]))
        ids = np.arange(80)
        together = embedding_dedup.links_of(v, *[x.astype(np.float64) if x.dtype == np.int8 else x for x in embedding_dedup.quantised(v)], 0, threshold, ids)[0]
        pair = v[[k, 40 + k]]
        alone = embedding_dedup.links_of(pair, *[x.astype(np.float64) if x.dtype == np.int8 else x for x in embedding_dedup.quantised(pair)], 0, threshold, np.arange(2))[0]
        exact = np.array([[np.einsum("ij,ij->i", u[i : i + 1], u[j : j + 1])[0] / (norm[i] * norm[j]) >= threshold for j in range(80)] for i in range(80)])
        assert alone[0] == exact[k, 40 + k] and together.sum() == np.triu(exact, 1).sum() * 2


def test_embedding_bounds_hold():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 17)) * rng.uniform(1e-30, 1e30, (200, 1))
    q, scale, err = embedding_dedup.quantised(v)
    u = v / np.linalg.norm(v / np.abs(v).max(1)[:, None], axis=1)[:, None] / np.abs(v).max(1)[:, None]
    off = np.abs(u @ u.T - scale[:, None] * scale[None, :] * (q.astype(float) @ q.astype(float).T))
    assert (off <= err[None, :] + err[:, None] * (1 + err[None, :])).all()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100)], "a long, b long")
    assert {(r["node"], r["component"]) for r in components.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100)}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    found = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end(), "card"))
    found += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def test_pii_base_spans_against_plain_patterns(spark):
    rng = random.Random(5)
    bits = ["a", "b.c", "@", "x-y.com", "1", "255", "256", ".", "+", "-", " ", "(", ")", "4111111111111111", "4736962573099581", "é", "\x01", "\n", "7", "_", "192.168.0.1", "+1 (336) 555-3810", "a@b.co", "𝒳"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(800)]
    texts += [None, "", "9" * 5000, "a" * 5000 + "@", "1." * 2000, "+1" + "(" * 3000, "@".join(["a.b"] * 300)]
    df = spark.createDataFrame([(i, t, "row") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    out = pii.find_pii(df, model=("0.0D", dict.fromkeys(pii.WIDE, 2.0))).withColumn("red", pii.redact("text", "spans")).collect()
    for r in out:
        assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == base_spans(texts[r["doc_id"]] or "")
        assert r["row"] == "row"
        if r["text"] and not r["base"]:
            assert r["red"] == r["text"]


@pytest.fixture(scope="module")
def pii_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = docs
    for k in range(1, 6):
        more = more.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000 * k))
    return more, pii.fit_trees(more, "doc_id", "text")


def test_pii_trees_add_personal_data_and_spare_lookalikes(spark, pii_model):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        key, d = "".join(rng.choice("0123456789abcdef") for _ in range(40)), "".join(rng.choice("23456789") for _ in range(12))
        kinds = [("secret", f'the token = "{key}" of it'), ("secret", f"und {key} dem"), ("number", f"les phone {d[:3]}-{d[3:6]}-{d[6:10]} dans"), ("number", f"of call ({d[:3]}) {d[3:6]}-{d[6:10]} then"),
                 ("", f"see internationalisation{2000 + i}conference words"), ("", f"order 4000{d}1 on 2024-01-0{i % 9 + 1} 12"), ("", f"id=the-best-of-{2000 + i}-in-review now")]
        rows.append((i, *rng.choice(kinds)))
    out = pii.find_pii(spark.createDataFrame(rows, "doc_id long, want string, text string"), model=pii_model[1]).collect()
    right = collections.Counter((r["want"], {s["kind"] for s in r["spans"]} - set(pii.KINDS) == ({r["want"]} - {""})) for r in out)
    for kind in ("secret", "number", ""):
        assert right[kind, True] >= 0.95 * (right[kind, True] + right[kind, False]), right


def test_pii_trees_decide_otherwise_than_one_rule(pii_model):
    """By kind; the plain rule is that a text assigns the span to a name."""
    docs, (score, thresholds) = pii_model
    rows = pii.planted_rows(docs, "doc_id", "text").withColumn("f", F.struct(*pii.FEATURES)).withColumn("p", F.expr(score))
    for kind in pii.WIDE:
        mine = rows.where(F.col("kind") == kind).select("label", "assigned", (F.col("p") >= thresholds[kind]).alias("chosen")).collect()
        chosen = [r for r in mine if r["chosen"]]
        assert len(chosen) > 20 and np.mean([r["label"] for r in chosen]) > 0.95
        assert len(chosen) > 0.7 * sum(r["label"] for r in mine)
        assert np.mean([r["assigned"] == r["label"] for r in mine]) < np.mean([r["chosen"] == r["label"] for r in mine]) - 0.1


def test_pii_thresholds_hold_on_families_that_the_trees_did_not_see(pii_model):
    families = []
    _, thresholds = pii.fit_trees(pii_model[0], "doc_id", "text", families=families)
    assert {f["family"] for f in families} == set(pii.UNSEEN) and {(f["kind"], f["label"]) for f in families} == {(k, y) for k in pii.WIDE for y in (0.0, 1.0)}
    for kind in pii.WIDE:
        chosen = [f for f in families if f["kind"] == kind]
        good, n = (sum(f["selected"] for f in chosen if f["label"] >= least) for least in (1.0, 0.0))
        assert thresholds[kind] < 1 and n > 50 and good >= pii.PRECISION * n
        assert good > 0.4 * sum(f["n"] for f in chosen if f["label"] == 1.0)


def test_pii_fit_has_few_tasks_into_however_many_partitions_its_rows_are_dealt(spark, pii_model, monkeypatch):
    deal = type(pii_model[0]).repartition
    monkeypatch.setattr(type(pii_model[0]), "repartition", lambda self, n, *cols: deal(self, max(n, 60) if cols and isinstance(n, int) else n, *cols))
    context = spark.sparkContext
    context.setJobGroup("few-tasks", "the fit of the trees")
    try:
        score, thresholds = pii.fit_trees(pii_model[0], "doc_id", "text")
    finally:
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(key, None)
    status = context.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("few-tasks") for s in status.getJobInfo(j).stageIds]
    tasks = [s.numTasks for s in stages if s is not None]
    assert len(tasks) > 50 and sum(n > pii.FIT_TASKS for n in tasks) < 10
    assert score != "0.0D" and set(thresholds) == set(pii.WIDE)


def test_pii_trees_as_sql_equal_the_model(pii_model):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = pii.planted_rows(pii_model[0], "doc_id", "text")
    table = VectorAssembler(inputCols=list(pii.FEATURES), outputCol="features").transform(rows).withColumn("f", F.struct(*pii.FEATURES))
    model = GBTClassifier(maxIter=3, maxDepth=3, seed=1).fit(table)
    both = model.transform(table).select(vector_to_array("probability")[1].alias("p"), F.expr(pii.trees_sql(model)).alias("q"))
    assert both.where("abs(p - q) > 1e-9").count() == 0 and both.count() > 500


def test_pii_of_texts_with_very_many_matches(spark, pii_model):
    times = {}
    for n in (10_000, 10_000, 40_000):
        text = " and ".join(f"a@b{i}.com {4000000000000000 + i}" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.time()
        got = pii.find_pii(df, model=pii_model[1]).withColumn("red", pii.redact("text", "spans")).collect()[0]
        times[n] = time.time() - start
        assert [(s["kind"], s["start"], s["end"]) for s in got["base"]] == base_spans(text)
        assert got["red"].count("[email]") == n
    assert times[40_000] < 8 * times[10_000]


def test_pii_key_around_a_base_span_stays_beside_it(spark, pii_model):
    df = spark.createDataFrame([(1, 'token = "ab4111111111111111cdef0123456789abcdef0123" x')], "doc_id long, text string")
    r = pii.find_pii(df, model=pii_model[1]).withColumn("red", pii.redact("text", "spans")).collect()[0]
    assert [s["kind"] for s in r["spans"]] == ["secret", "card"] and r["red"] == 'token = "[secret]" x'
    assert pii.find_pii(df.limit(0)).count() == 0


def test_redact_against_plain_python(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(60):
        text = "".join(rng.choice("aé𝒳 b") for _ in range(rng.randint(1, 2000)))
        spans = sorted((a, rng.randint(0, 5), min(len(text), a + rng.randint(1, 9)), rng.choice(["x", "y"])) for a in (rng.randrange(len(text)) for _ in range(rng.choice([0, 1, 5, 700]))))
        rows.append((text, spans))
    df = spark.createDataFrame(rows, "text string, spans array<struct<start: int, rank: int, end: int, kind: string>>")
    for r in df.withColumn("red", pii.redact("text", "spans")).collect():
        out, at = "", 0
        for s in r["spans"]:
            if s["start"] >= at:
                out += r["text"][at : s["start"]] + f"[{s['kind']}]"
            at = max(at, s["end"])
        assert r["red"] == out + r["text"][at:]


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var x = "</p><article>";</script></head><body>
<header><a href="/">Home page of the site</a></header><nav class="menu"><ul><li><a href=a>one</a><li><a>two</a></ul></nav><div class="cookie-notice">We use cookies for everything we do here</div>
<div class='ad'>Buy this now</div><main><article><h1>The&nbsp;title</h1><p>First   paragraph<br>of
text &lt;here&gt; with <b>bold</b> words and more words to read.<p>Second <a href="x">linked words</a> paragraph, long enough.</p>
<aside>Related things</aside><form><input name=q><button>Send it</button></form><blockquote>A quote of some length.</blockquote></article></main>
<section id="comments"><p>I disagree with this article a lot and say so at length here.</p></section><footer>&copy; footer words</footer></body>"""


WANT = "The title\nFirst paragraph of text <here> with bold words and more words to read.\nSecond linked words paragraph, long enough.\nA quote of some length."


def test_html_main_text():
    weights = html_text.fit_weights([PAGE] * 3)
    plain = PAGE.replace("<main><article>", "<div>").replace("</article></main>", "</div>")
    for page in (PAGE, plain):
        for w in (weights, html_text.Weights()):
            assert html_text.main_text(page, w) == WANT


def test_best_run_against_all_runs():
    rng = random.Random(3)
    for _ in range(50):
        values = [rng.choice([1.0, -0.25, -2.0, 0.0, 3.0]) for _ in range(15)]
        a, b = html_text.best_run(values)
        assert sum(values[a:b]) == max([0.0, *(sum(values[i:j]) for i in range(15) for j in range(i + 1, 16))])


def said(page):
    """Words that stand in nothing but a section."""
    return [w for names, text, n in html_text.tokens(page) if n and html_text.Weights().of((names, "", 1)) > 0 for w in text.split()]


def test_html_asides_end_with_their_elements():
    assert said('<body><p class="notice">off<p>one</p><p>two</p></body>') == ["one", "two"]
    assert said('<ul><li class="share">off<li>one</ul><p>two</p>') == ["one", "two"]
    assert said('<div><span class="ads">off</div><p>one') == ["one"]
    assert said('<ul class="menu"><li>off<ul><li>off</ul><li>off</ul><p>one') == ["one"]
    assert said('<div class="sidebar"><div><p>off</div><p>off</div>one') == ["one"]
    assert said("<table><tr><td class=ad>off<td>one<tr><td>two</table>three") == ["one", "two", "three"]
    assert said("<head><meta charset=utf-8><p>one") == ["one"]
    assert said('<div class="with-sidebar"><p class="no-ads has_menu">one</p></div>') == ["one"]
    assert said('<p>one <svg class="i"/> two</p><p>three</p><iframe src="x" />four') == ["one", "two", "three", "four"]
    assert said("<title-bar>one</title-bar> <svg-icon></svg-icon>two <svg><path d='M'/></svg>three") == ["one", "two", "three"]
    assert said("one<iframe src=http://a/>off</iframe>two<svg a='/>'><text>off</text></svg>three") == ["one", "two", "three"]
    assert said("one <!-- off > off --> two<!doctype x>three < four <5") == ["one", "two", "three", "<", "four", "<5"]
    assert said("<table><tr><td>one<p>two</b></td></tr></table><b>three<td>four</b>five") == ["one", "two", "three", "four", "five"]


@pytest.mark.parametrize("piece", ["<p class=x ", "<p a='\"x> ", "<b><i>", "<li><div class=a>", "<!-- x ", "<svg ", "</", "<b><td></b>", "<p><button><i>"])
def test_html_of_broken_markup_takes_linear_time(piece):
    page = "<p>one two three</p>" + piece * (1_000_000 // len(piece))
    start = time.process_time()
    html_text.main_text(page, html_text.Weights())
    assert time.process_time() - start < 8


def stripped(page):
    return re.sub("</?(article|main)[^>]*>", "", page)


def f1(got, want):
    both = sum((collections.Counter(got.split()) & collections.Counter(want.split())).values())
    return 2 * both / max(1, len(got.split()) + len(want.split()))


def test_the_scan_finds_the_labelled_region_of_pages_without_marks(spark):
    """End to end on whole pages; without the scan, or with the weights the perceptron starts from, it doesn't."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect()
    train, held = rows[::2], rows[1::2]
    weights = html_text.fit_weights([r["html"] for r in train])
    start = html_text.fit_weights([r["html"] for r in train], epochs=0)
    want = [html_text.region_text(f[a:b], html_text.Weights()) for f, a, b in (html_text.labelled_page(r["html"]) for r in held)]
    scores = {}
    for name, how in (("whole", lambda p: html_text.main_text(p, weights)), ("unlearned", lambda p: html_text.main_text(p, start)), ("no scan", lambda p: html_text.region_text(html_text.tokens(p), weights))):
        got = [how(stripped(r["html"])) for r in held]
        scores[name] = np.mean([f1(g, w) for g, w in zip(got, want, strict=True)]), np.mean([g == w for g, w in zip(got, want, strict=True)])
    assert scores["whole"][0] > 0.999 and scores["whole"][1] > 0.98
    assert scores["no scan"][1] < 0.05 and scores["no scan"][0] < scores["whole"][0] - 0.02
    assert scores["unlearned"][1] < 0.5


def test_html_weights_do_not_depend_on_the_order_of_rows(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")
    one = html_text.fit(pages, "page_id", "html", sample=60)
    two = html_text.fit(pages.orderBy(F.desc("html")).repartition(7), "page_id", "html", sample=60)
    learned = html_text.fit(pages.unionByName(pages), "page_id", "html", sample=60, budget=1 << 17)
    assert dict(one) == dict(two) and one["in:footer"] < -1 and learned


def test_html_kept_names(spark):
    df = spark.createDataFrame([(1, "<p>a", "x", "y")], "page_id long, html string, names string, html_ string")
    assert html_text.extract(df).columns == ["page_id", "names", "html_", "text"]
    with pytest.raises(ValueError):
        html_text.extract(df.withColumnRenamed("names", "TEXT"), keep=["TEXT"])


def test_html_job_on_odd_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "", ""), (4, "x", "<p>unclosed <b"), (5, "y", "<p>" + "word " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = sorted((r["page_id"], r["text"]) for r in html_text.extract(df, keep=["page_id"]).collect())
    assert [t for _, t in out][2:4] == ["", ""] and out[0] == out[1] and len(out[5][1]) == 50_000 * 5 - 1
    assert html_text.extract(df.limit(0)).count() == 0
