import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row, functions as F
from tokenizers import Tokenizer

from arcorder.llm import bpe, components, genetic_packing, html_text, packing, periodic_runs, prefix_trie, queries
from arcorder.operators.storage import shared_dir

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# --- prefix trie -----------------------------------------------------------------------------------------------------


def test_slots_are_minimal_perfect_and_foreign_keys_have_none():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 5000):
        hi, lo = prefix_trie.distinct(rng.integers(-(2**62), 2**62, n), rng.integers(0, 3, n))
        table = prefix_trie.SlotTable(hi, lo)
        assert sorted(table.slots(hi, lo)) == list(range(len(hi)))
        assert (table.slots(hi, lo + 7) == -1).all()


def plain_trie(rows, rebuild=True):
    """The contract's rows by dictionaries. rows: (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    paths = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        paths[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + t[h:]  # as in SQL, a remainder has the sign of c
    members = collections.defaultdict(list)
    for c, t in paths.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(WORDS.findall(node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in children[node])
    out = set()
    for node, m in members.items():
        ends = hashlib.sha256(",".join(map(str, sorted(c for c in m if len(paths[c]) == len(node)))).encode()).hexdigest()
        out.add((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], ends))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found_trie(spark, rows, tmp_path):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("hi", F.lit("clash")).write.parquet(f"{tmp_path}/conversations.parquet")
    out = [tuple(r[c] for c in COLUMNS) for r in queries.op11_prefix_trie(spark, str(tmp_path)).collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_trie_against_dictionaries(spark, tmp_path):
    rng = random.Random(3)
    texts = ["yes", "no well", None, "", "three words here", "a\x1cb c"]
    rows = []
    for c in [*range(130), 400, 401, 420, -40, -19]:
        rows += [(c, rng.choice([t, t, None]), rng.choice(["user", "user", None, "system"]), rng.choice(texts[: rng.randint(1, 6)])) for t in range(rng.randint(1, 7))]
    rows += [(None, 0, "user", "of nobody"), (7, 3, "user", "twice"), (7, 3, "user", "twice")]
    # a group of copies, and two copies of a conversation of more turns than a block
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1200) for t in range(3)]
    long = [(t, "user", f"turn {t % 50} {t // 3000}") for t in range(2 * prefix_trie.BAND + 5)]
    rows += [(c, *t) for c in (2000, 2001) for t in long] + [(2002, *t) for t in long[:5000]]
    assert found_trie(spark, rows, tmp_path) == plain_trie(rows)


def test_trie_of_no_conversations(spark, tmp_path):
    assert found_trie(spark, [], tmp_path) == set()


def test_trie_builds_again_when_digests_clash(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 1, bytearray(16), 1)], "conv long, depth long, content binary, words long")
    lengths = spark.createDataFrame([(1, 1)], "conv long, length long")
    real, seeds = prefix_trie._nodes, []

    def clashing(r, n, seed, long):
        seeds.append(seed)
        paths, nodes = real(r, n, seed, long)
        return paths, prefix_trie.written(nodes.withColumn("clash", F.lit(seed < 2)), "clashing")

    monkeypatch.setattr(prefix_trie, "_nodes", clashing)
    assert prefix_trie.trie(rows, lengths).count() == 2 and seeds == [0, 1, 2]


# --- periodic runs ---------------------------------------------------------------------------------------------------


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            a, b = i, j + q
            if j > i and b - a >= max(24, 3 * q):
                s = w[a:b]
                if not any(all(s[k] == s[k + d] for k in range(len(s) - d)) for d in range(1, q)):
                    out.append((a, b, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng, n):
    w = []
    while len(w) < n:
        base = [rng.randint(0, rng.choice([1, 2, 5, 50])) for _ in range(rng.randint(1, 40))]
        w += [base[k % len(base)] for k in range(rng.randint(1, 150))]
        if rng.random() < 0.3:
            w[rng.randrange(len(w))] = 9
    return w


def test_runs_against_all_periods():
    rng = random.Random(8)
    for _ in range(300):
        texts = [repetitive(rng, rng.randint(0, 300)) for _ in range(rng.randint(0, 4))] + [[rng.randint(0, 1) for _ in range(rng.randint(0, 120))]]
        assert periodic_runs.find_runs([np.array(w, dtype=np.int64) for w in texts]) == [plain_runs(w) for w in texts]


def test_runs_query_against_plain_python(spark, tmp_path):
    rng = random.Random(9)
    texts = [None, "", " \t\n", "a", *[" ".join(f"w{x}" for x in repetitive(rng, rng.randint(0, 200))) for _ in range(60)], "x y\x1cz " * 40, "word " * 200]
    docs = [(i if i != 5 else None, t) for i, t in enumerate(texts)] + [(9, texts[9])]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("runs", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in docs:
        w = WORDS.findall(text or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = plain_runs(w)
        best = max(runs, key=lambda r: ((r[1] - r[0]) / r[2], -r[0], -r[2]), default=None)
        first = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        gone = {k for a, b, q in runs for k in range(a + q, b)}
        lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs)
        want.append((i, len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r[c] for c in columns) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(x[1] for x in want) > 20
    assert any(i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs)


def test_runs_of_no_rows_and_clashing_names(spark):
    none = spark.createDataFrame([], "id long, text string")
    assert periodic_runs.periodic_runs(none).count() == 0
    with pytest.raises(ValueError, match="best"):
        periodic_runs.periodic_runs(none.withColumn("best", F.lit(1)), keep=["best"])


# --- grouping genetic algorithm --------------------------------------------------------------------------------------


def bins_of(lengths, assigned, width):
    fill = collections.Counter()
    for row, sequence, offset in sorted(assigned, key=lambda r: (r[1], r[2])):
        assert offset == fill[sequence]
        fill[sequence] += lengths[row]
    assert max(fill.values(), default=0) <= width and len(assigned) == len(lengths)
    return len(fill)


@pytest.mark.parametrize("block", [4096, 60])
def test_bins_are_whole_and_few(spark, block):
    rng = random.Random(4)
    lengths = {i: rng.choice([rng.randint(1, 1023), rng.randint(200, 400)]) for i in range(400)}
    found = genetic_packing.assign(spark.createDataFrame(list(lengths.items()), "row long, length long"), 1024, block)
    n = bins_of(lengths, [tuple(r) for r in found.collect()], 1024)
    order = np.array(sorted(lengths, key=lambda i: -lengths[i]))
    sizes = np.array([lengths[i] for i in range(400)])
    plain = genetic_packing.Individual(genetic_packing.best_fit(np.zeros(400, np.int64), [], order, sizes, 1024), sizes).fitness[0]
    least = -(-int(sizes.sum()) // 1024)
    assert least <= n <= (plain if block > 400 else plain + 3)


def test_children_are_packings_and_never_worse_than_the_best():
    rng = np.random.default_rng(5)
    sizes = np.concatenate([rng.integers(300, 420, 90), rng.integers(200, 330, 90), rng.integers(250, 360, 90)])
    first = genetic_packing.evolve(sizes, 1024, [], np.random.default_rng(1), 0, 6)
    last = genetic_packing.evolve(sizes, 1024, first, np.random.default_rng(1), 150, 6)
    for x in last:
        assert x.fill.max() <= 1024 and (np.bincount(x.bin_of, weights=sizes) == x.fill).all() and len(x.bin_of) == 270
    assert last[0].fitness < first[0].fitness


def test_genetic_pieces_cover_every_id_once(spark):
    vocabulary, tokenizer = queries.vocabulary(spark), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "a short one", "many words " * 900, "x" * 3000, *[f"text {i} " * (i % 40) for i in range(80)]]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit("clash"))
    rows = genetic_packing.pack(df, vocabulary).collect()
    bins, whole = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        whole[r["id"]].append((r["piece"], r["start"], r["length"], bytes(r["ids"])))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
    for i, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        mine = sorted(set(whole[i]))
        assert b"".join(x[3] for x in mine) == ids and [x[0] for x in mine] == list(range(len(mine)))
        assert all(x[2] == 1024 for x in mine[1:]) and (len(mine) == 1 or len(ids) // 4 > 1024)
    assert len(rows) == sum(len(x) for x in whole.values()) and len(whole[3]) == 2 * len(set(whole[3]))
    assert genetic_packing.pack(df.limit(0), vocabulary).count() == 0


# --- very long texts, nested marks, components -----------------------------------------------------------------------


@pytest.mark.parametrize("letter", [" ", "\n", "\t"])
def test_packing_takes_a_million_blanks(spark, letter):
    vocabulary = queries.vocabulary(spark)
    text = f"a{letter * 1_000_000}b"
    rows = packing.pack(spark.createDataFrame([(1, text), (2, "c")], "doc_id long, text string"), vocabulary).where("id = 1").orderBy("start").collect()
    ids = np.frombuffer(b"".join(r["ids"] for r in rows), "<u4")
    model = bpe.Bpe(vocabulary.value)
    assert ids[-1] == 0 and model.decode_bytes(ids[:-1].astype(np.int64)).decode() == text


def test_a_vocabulary_out_of_order_is_encoded_without_tiktoken(spark):
    model = bpe.Bpe(queries.vocabulary(spark).value)
    model.made = model.made[::-1].copy()
    assert packing.fast_encoder(model, []) is None


W, C = " ".join(f"word{i}" for i in range(60)), " ".join(f"cmt{i}" for i in range(90))


@pytest.mark.parametrize(
    "page",
    [
        f"<article><p>{W}</p><section class=comments><article class=comment><p>{C}</p></article></section></article>",
        f"<article><p>{W}</p></article><section class=comments><article class=comment><p>{C}</p></article><article class=comment><p>{C}</p></article></section>",
        f"<div><p>{W}</p></div><aside><article class=teaser><p>{C} {C}</p></article></aside>",
        f"<article class=post><p>{W}</p></article><article class=comment><p>{C}</p></article>",
        f"<div class=content-sidebar-wrap><main><article class=post><p>{W}</p></article></main><aside class=sidebar>{C}</aside></div>",
        "<div>" * 2000 + f"<div class=comments><p>{C}</p></div>" + "</div>" * 2000 + f"<article><p>{W}</p></article>",
    ],
)
def test_html_marks_within_others_keep_what_they_stand_in(page):
    assert html_text.main_text(f"<html><body>{page}</body></html>", html_text.Weights()) == W


def test_html_names_nested_very_deep_cost_one_pass():
    page = "<body>" + "".join(f"<div class=c{'x' * (i % 7)}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}>" for i in range(40_000)) + "text here</body>"
    assert html_text.main_text(page, html_text.Weights()) == "text here"
    assert html_text.fit_weights([page.replace("text here", "<article>text</article>")]) is not None


@pytest.mark.parametrize("order", ["up", "shuffled", "zigzag"])
def test_components_take_logarithmic_rounds_and_leave_one_table(spark, order):
    n = 3000
    path = {"up": np.arange(n), "shuffled": np.random.default_rng(1).permutation(n), "zigzag": np.where(np.arange(n) % 2, n - 1 - np.arange(n) // 2, np.arange(n) // 2)}[order]
    edges = spark.createDataFrame([Row(a=int(a), b=int(b)) for a, b in zip(path[:-1], path[1:], strict=True)])
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    tables = lambda: len(folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder))
    before, rounds = tables(), []
    found = components.components(edges, rounds).agg(F.max("component"), F.count("*")).first()
    assert tuple(found) == (0, n) and rounds[0] <= 16 and tables() == before + 1
