"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from arcorder.llm import bpe, embedding_dedup, exact_dedup, genetic_packing, html_text, language_id, ngram_join, packing, periodic_runs, pii, prefix_trie, quality, toxicity
from arcorder.llm.common import scratch, table, written

#: Public vocabulary, by the installed package's own path; a parameter of the operators.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary(spark: SparkSession) -> bpe.SharedVocabulary:
    return bpe.SharedVocabulary(spark, public_tokenizers.path(VOCABULARY))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = vocabulary(spark)
    ids = bpe.encode(table(spark, sf_dir, "documents"), entries, keep=["doc_id"])
    both = bpe.decode(ids, entries)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary(spark))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _remainder(column, modulus: int):
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % modulus


def learn_quality(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """From labelled rows whose crc32(doc_id as text) mod 4 is not 2."""
    return quality.fit(quality.training_rows(docs, labels, "quality", lambda c: _remainder(c, 4) != 2, quality.SAMPLE))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, learn_quality(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", (_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crf = language_id.fit(docs.where(_remainder(F.col("doc_id"), 3) != 1))
    found = language_id.identify(docs, crf, ["doc_id"])
    return found.select("doc_id", (_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = toxicity.fit(quality.training_rows(docs, labels, "toxic", lambda c: _remainder(c, 3) != 1, toxicity.SAMPLE))
    scored = toxicity.score(docs, net, ["doc_id"])
    return scored.select("doc_id", (_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *_base_columns(), pii.listed("spans").alias("spans"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


#: Of `links(a, b)`, both ways round, and `every(id)`: the smallest id that each id reaches.
CLASSES = """, reach(id, other) AS (SELECT a, b FROM links UNION SELECT reach.id, b FROM reach JOIN links ON reach.other = links.a),
classes AS (SELECT every.id, LEAST(every.id, COALESCE(MIN(other), every.id)) AS class FROM every LEFT JOIN reach ON reach.id = every.id GROUP BY every.id),
counted AS (SELECT a AS id, COUNT(*) AS n FROM links GROUP BY a)"""

OP7_SQL = f"""
WITH RECURSIVE every AS (SELECT vec_id AS id FROM embeddings),
good AS (SELECT vec_id AS id, LEN(embedding) AS dim, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE LEN(embedding) > 0 AND LEN(LIST_FILTER(embedding, lambda x: x IS NULL OR NOT ISFINITE(x))) = 0 AND LEN(LIST_FILTER(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.dim = y.dim AND x.id <> y.id
  WHERE LIST_INNER_PRODUCT(x.v, y.v) / (SQRT(LIST_INNER_PRODUCT(x.v, x.v)) * SQRT(LIST_INNER_PRODUCT(y.v, y.v))) >= 0.95){CLASSES}
SELECT c.id AS vec_id, COALESCE(n, 0) AS n_links, class AS component_id, class = c.id AS kept FROM classes c LEFT JOIN counted ON c.id = counted.id
"""

#: Words are runs of ASCII letters and digits and of whatever lies beyond ASCII.
OP9_SQL = f"""
WITH RECURSIVE every AS (SELECT doc_id AS id FROM documents),
words AS (SELECT doc_id AS id, REGEXP_EXTRACT_ALL(LOWER(text), '[a-z0-9\\x{{80}}-\\x{{10ffff}}]+') AS w FROM documents),
shingles AS (SELECT DISTINCT id, ARRAY_TO_STRING(w[k : k + 4], ' ') AS s FROM (SELECT id, w, UNNEST(GENERATE_SERIES(1, GREATEST(LEN(w) - 4, 1))) AS k FROM words WHERE LEN(w) > 0)),
sizes AS (SELECT id, COUNT(*) AS size FROM shingles GROUP BY id),
shared AS (SELECT x.id AS a, y.id AS b, COUNT(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.id <> y.id GROUP BY x.id, y.id),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 5 * n >= 4 * (x.size + y.size - n)){CLASSES}
SELECT c.id AS doc_id, class AS class_id, COALESCE(n, 0) AS n_links, class = c.id AS kept FROM classes c LEFT JOIN counted ON c.id = counted.id
"""


def _matches(kind: str, pattern: str, rank: int) -> str:
    """SQL of (doc_id, kind, rank, a, b, m): the matches of a plain pattern, by the lengths of what lies before them."""
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, CAST(COALESCE(SUM(LENGTH(p)) OVER w, 0) AS BIGINT) AS a, CAST(COALESCE(SUM(LENGTH(p)) OVER w, 0) + LENGTH(p) AS BIGINT) AS b, p AS m, k
FROM (SELECT doc_id, UNNEST(ps) AS p, GENERATE_SUBSCRIPTS(ps, 1) AS k FROM (SELECT doc_id, STRING_SPLIT(REGEXP_REPLACE(t, '({pattern})', CHR(1) || '\\1' || CHR(1), 'g'), CHR(1)) AS ps FROM texts))
WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
DIGITS = "REGEXP_REPLACE(m, '[^0-9]', '', 'g')"
PII_SQL = f"""
WITH texts AS (SELECT doc_id, REPLACE(COALESCE(text, ''), CHR(1), CHR(2)) AS t FROM documents),
found AS ({" UNION ALL ".join(f"SELECT * FROM ({_matches(k, p, i)}) WHERE k % 2 = 0" for i, (k, p) in enumerate(PLAIN.items()))}),
good AS (SELECT * FROM found WHERE kind = 'email'
  OR kind = 'ip' AND LEN(LIST_FILTER(STRING_SPLIT(m, '.'), lambda x: CAST(RIGHT('00000' || LTRIM(x, '0'), GREATEST(5, LENGTH(LTRIM(x, '0')))) AS HUGEINT) > 255)) = 0
  OR kind = 'phone' AND LENGTH({DIGITS}) BETWEEN 9 AND 15
  OR kind = 'card' AND LENGTH({DIGITS}) BETWEEN 12 AND 19 AND LIST_SUM(LIST_TRANSFORM(GENERATE_SERIES(1, LENGTH({DIGITS})),
    lambda i: CASE WHEN i % 2 = 1 THEN CAST(SUBSTRING({DIGITS}, LENGTH({DIGITS}) + 1 - i, 1) AS INTEGER) ELSE CAST(SUBSTRING('0246813579', CAST(SUBSTRING({DIGITS}, LENGTH({DIGITS}) + 1 - i, 1) AS INTEGER) + 1, 1) AS INTEGER) END)) % 10 = 0)
SELECT d.doc_id, COUNT(*) FILTER (kind = 'email') AS n_email, COUNT(*) FILTER (kind = 'ip') AS n_ip, COUNT(*) FILTER (kind = 'card') AS n_card, COUNT(*) FILTER (kind = 'phone') AS n_phone,
  SHA256(COALESCE(STRING_AGG(kind || ':' || a || ':' || b, ',' ORDER BY a, rank), '')) AS base_sha256 FROM documents d LEFT JOIN good g ON d.doc_id = g.doc_id GROUP BY d.doc_id
"""


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5_pii that its base patterns decide alone, which SQL can check."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), model=("0.0D", dict.fromkeys(pii.WIDE, 2.0)))
    return found.select("doc_id", *_base_columns())


def _base_columns() -> list:
    return [*[F.expr(f"bigint(size(filter(base, s -> s.kind = '{k}')))").alias(f"n_{k}") for k in pii.KINDS], F.sha2(pii.listed("base"), 256).alias("base_sha256")]


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), n=5, threshold=0.8)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    texts = html_text.extract(pages, keep=["page_id", "url"], weights=html_text.fit(pages, "page_id", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def rebuilt(ranked: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, content, words) and (conv, length): the first h turns of conversation c - c % 20, then c's own after its first h."""
    conv = F.col("conv")
    some = convs.select("conv", "first", "n", (F.crc32(conv.cast("string")) % 4).alias("h"), (conv - conv % 20).alias("base"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    some = some.join(convs.select(conv.alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("taken", taken)
    some = written(some.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-rebuilt")
    pos = F.col("rank") - F.col("first")
    own = ranked.join(some.select("conv", "first", "h", "taken"), "conv").where(pos >= F.col("h")).select("conv", (F.col("taken") + pos - F.col("h") + 1).alias("depth"), "content", "words")
    heads = ranked.where("conv % 20 = 0").join(convs.where("conv % 20 = 0").select("conv", "first"), "conv").where(pos < 3).select(conv.alias("base"), (pos + 1).alias("depth"), "content", "words")
    given = some.where("taken > 0").select("conv", "base", "taken").join(heads, "base").where("depth <= taken").select("conv", "depth", "content", "words")
    return written(own.unionByName(given), "trie-turns"), some.select("conv", "length")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch() as work:
        rows, lengths = rebuilt(*prefix_trie.turns(table(spark, sf_dir, "conversations")))
        return work.keep(prefix_trie.trie(rows, lengths), "op11")


#: CRC-32 of the decimal digits of x, bit by bit.
CRC32_SQL = """xor(4294967295, LIST_REDUCE(LIST_PREPEND(4294967295::BIGINT, LIST_TRANSFORM(STRING_SPLIT(CAST(x AS VARCHAR), ''), lambda ch: ASCII(ch)::BIGINT)),
    lambda c, b: LIST_REDUCE([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"""
OP11_SQL = f"""
WITH own AS (SELECT conv_id AS c, LENGTH(COALESCE(role, '')) || ':' || COALESCE(role, '') || COALESCE(text, '') AS said, LEN(REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS words,
  ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, n, {CRC32_SQL.replace("(x ", "(c ")} % 4 AS h, c - c % 20 AS base FROM (SELECT c, COUNT(*) AS n FROM own GROUP BY c)),
info AS (SELECT v.c, v.n, v.h, v.base, LEAST(v.h, COALESCE(b.n, 0)) AS taken FROM convs v LEFT JOIN convs b ON v.base = b.c),
turns AS (SELECT own.c, taken + pos - h AS depth, said, words FROM own JOIN info ON own.c = info.c WHERE pos > h
  UNION ALL SELECT info.c, pos, said, words FROM info JOIN own ON own.c = base WHERE pos <= taken
  UNION ALL SELECT c, 0, '', 0 FROM convs),
paths AS (SELECT c, depth, words, depth = MAX(depth) OVER (PARTITION BY c) AS ends, STRING_AGG(SHA256(said), '') OVER (PARTITION BY c ORDER BY depth) AS path FROM turns),
nodes AS (SELECT path, depth, MIN(c) AS conv_id, COUNT(*) AS n_convs, MAX(words) AS words, LEFT(path, LENGTH(path) - 64) AS above,
  SHA256(COALESCE(STRING_AGG(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256, BOOL_AND(ends) AS leaf FROM paths GROUP BY path, depth),
pairs AS (SELECT DISTINCT a.path AS top, b.path AS node FROM paths a JOIN paths b ON a.c = b.c AND a.depth <= b.depth),
sums AS (SELECT top, CAST(SUM((n_convs - 1) * words) AS BIGINT) AS saved_tokens, COUNT(*) FILTER (leaf) AS n_leaves, COUNT(*) FILTER (above = top AND depth > 0) AS n_children FROM pairs JOIN nodes ON node = path GROUP BY top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums ON n.path = top LEFT JOIN nodes p ON n.depth > 0 AND n.above = p.path
"""


def op12_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = genetic_packing.pack(table(spark, sf_dir, "documents"), vocabulary(spark))
    return found.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; with h = crc32(doc_id) a multiple of 10 and g = h div 10, the words from g % n on repeat the first 1 + (n - g % n) div (3 + g % 8) of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(prefix_trie.WORD), F.lit(0)))
    some = docs.select("doc_id", "text", words.alias("w"), g.alias("g")).withColumn("n", F.coalesce(F.size("w"), F.lit(0)))
    some = some.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    some = some.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)")
    return some.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_repeats(table(spark, sf_dir, "documents")), keep=["doc_id"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op1_bpe": op1_bpe, "op2_exact_dedup": op2_exact_dedup, "op3_quality": op3_quality, "op4_language": op4_language, "op5_pii": op5_pii, "op6_toxicity": op6_toxicity, "op7_embedding_dedup": op7_embedding_dedup, "op8_packing": op8_packing, "op9_ngram_join": op9_ngram_join, "op10_html": op10_html, "op11_prefix_trie": op11_prefix_trie, "op12_genetic_packing": op12_genetic_packing, "op13_periodic_runs": op13_periodic_runs, "pii_base_spans": pii_base_spans}
ORACLES = {"op2_exact_dedup": OP2_SQL, "op7_embedding_dedup": OP7_SQL, "op9_ngram_join": OP9_SQL, "op11_prefix_trie": OP11_SQL, "pii_base_spans": PII_SQL}
