r"""Personal data: candidate spans, boosted trees and calibrated redaction, in DataFrame and SQL functions only.

High-recall generators propose overlapping spans. The base kinds (email, ip, card, phone) are validated by format and
checksum and always stay. The wider generators propose secrets (long runs of letters and digits) and numbers (digits in
any grouping); gradient boosted trees score these by format and context, and a threshold for each kind, calibrated for
PRECISION on forms that the trees did not see, selects them. One that lies within another span adds nothing and is left out; one that holds a base span stays beside it.

No table says what is personal data, so the trees learn from phrases whose answer is known: PLANTED phrases, personal data
(national phone numbers, keys, accounts) and lookalikes of it (dates, prices, reference numbers, slugs, identifiers), are
set into windows of a bounded, hashed sample of SAMPLE documents, at places and with values that a hash of the id gives.
A candidate that covers a planted span has that phrase's answer, whatever its features; all others are left out of the fit.
Phrases of one form are a family, and the thresholds come from families that the trees did not see.

A pattern marks its matches with U+0001 (one that stands in the text is read as U+0002, which no pattern accepts), so
one pass and one split give pieces and matches. Running sums over them are taken in blocks of BLOCK, so a text with many
thousands of matches costs little more than its length. The same holds for redact.

Null and empty texts have no spans. Repeated rows and any id are kept as they are. Java's patterns use possessive
forms that accept the same strings as the plain ones, so very long runs neither recurse nor backtrack.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from arcorder.llm.common import hashed_sample

#: Documents into whose windows phrases are planted, at most about, and the window's code points on each side.
SAMPLE, WINDOW = 20_000, 100
#: Share of planted personal data among what a threshold selects of the unseen families.
PRECISION = 0.98
#: Tasks of each of the fit's many small jobs; the driver remembers every task of a job that has ended.
FIT_TASKS = 8
BLOCK = 256
KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"[A-Za-z0-9+/_-]{16,}+",
    "number": r"[0-9(](?:[\x20().-]{0,4}+[0-9]++)++",
}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
DIGITS = "regexp_replace(s.m, '[^0-9]', '')"
LUHN = (
    f"(aggregate(sequence(1, length({DIGITS})), 0, (a, i) -> a + int(if(i % 2 = 1, substring(reverse({DIGITS}), i, 1),"
    f" substring('0246813579', int(substring(reverse({DIGITS}), i, 1)) + 1, 1)))) % 10 = 0)"
)
VALID = {
    "email": "true",
    "ip": rf"s.m rlike r'^(?:{PART}\.){{3}}{PART}$'",
    "card": f"length({DIGITS}) between 12 and 19 and {LUHN}",
    "phone": f"length({DIGITS}) between 9 and 15",
    "secret": "s.m rlike '[0-9]' and s.m rlike '[A-Za-z]'",
    "number": f"length(s.m) >= 9 and length({DIGITS}) between 7 and 19",
}
#: Cheap conditions without which a pattern can't match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+", "secret": "", "number": ""}
WIDE = tuple(k for k in PATTERNS if k not in KINDS)
FEATURES = {
    "length": "double(length(s.m))",
    "digits": f"double(length({DIGITS}))",
    "letters": "double(length(regexp_replace(s.m, '[^A-Za-z]', '')))",
    "capitals": "double(length(regexp_replace(s.m, '[^A-Z]', '')))",
    "distinct": "double(size(array_distinct(split(s.m, ''))))",
    "hex": "double(s.m rlike '^[0-9a-fA-F]+$')",
    "changes": "double(length(regexp_replace(s.m, '(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])', ' ')) - length(s.m))",
    "longest": "double(array_max(transform(split(s.m, '[^A-Za-z]+'), w -> length(w))))",
    "groups": "double(size(split(s.m, '[^A-Za-z0-9]+')))",
    "last": "double(length(element_at(split(s.m, '[^0-9]+'), -1)))",
    "dots": "double(length(regexp_replace(s.m, '[^.]', '')))",
    "dashes": "double(length(regexp_replace(s.m, '[^_/-]', '')))",
    "gaps": "double(length(regexp_replace(s.m, '[^ ]', '')))",
    "brackets": "double(length(regexp_replace(s.m, '[^()]', '')))",
    "assigned": r"double(s.before rlike r'[=:]\s*[\x22\x27]?$')",
    "quoted": r"double(s.before rlike r'[\x22\x27]$' and s.after rlike r'^[\x22\x27]')",
    "named": "double(s.before rlike '(?i)(token|key|secret|passw|auth|bearer|iban|account)')",
    "called": "double(s.before rlike '(?i)(phone|tel|call|mobile|fax)')",
    "inside": "double(s.before rlike '[/@.A-Za-z0-9]$' or s.after rlike '^[/@A-Za-z0-9]')",
}
#: What the values of planted phrases are made of: hashed digits, hexadecimal digits and letters of both cases, and words of the window.
MATERIAL = {
    "some_digits": "translate(sha2(concat(id, 'd'), 256), 'abcdef', '135790')",
    "some_hex": "sha2(concat(id, 'h'), 256)",
    "some_letters": "translate(base64(unhex(sha2(concat(id, 'b'), 256))), '+/=', 'xyz')",
    "some_words": "lower(regexp_replace(substring(w, 1 + int(pmod(xxhash64(id, 23), 10)), 34), '[^A-Za-z]+', '-'))",
}
_D, _H, _B, _WORDS = MATERIAL


def _digits(*groups: int | str) -> str:
    """SQL of hashed digits in groups, with what stands between them."""
    out, at = [], 1
    for g in groups:
        out.append(f"substring({_D}, {at}, {g})" if isinstance(g, int) else f"'{g}'")
        at += g if isinstance(g, int) else 0
    return f"concat({', '.join(out)})"


#: Families of phrases of one form: is it personal data, what stands before it, SQL of its value (of MATERIAL), what stands after it.
FAMILIES: list[list[tuple[bool, str, str, str]]] = [
    [(True, before, _digits("(", 3, ") ", 3, "-", 4), "") for before in ("", "call ", "at ")],
    [(True, before, _digits(3, "-", 3, "-", 4), "") for before in ("", "phone ", "number ")],
    [(True, "tel. ", _digits("0", 2, " ", 4, " ", 4), "")],
    [(True, "phone: ", _digits("00", 2, " ", 3, " ", 7), "")],
    [(True, "mobile ", _digits(3, ".", 3, ".", 4), "")],
    [(True, "fax ", _digits(1, " (", 3, ") ", 3, "-", 4), "")],
    [(True, "", _digits("(0", 2, ") ", 3, " ", 4), "")],
    [(True, before, f"substring({_H}, 1, {n})", after) for before, n, after in (('token = "', 40, '"'), ("key: ", 32, ""), ("", 40, ""), ("", 64, ""), ("secret=", 24, ""))],
    [(True, 'TOKEN = "', f"upper(substring({_H}, 1, 40))", '"')],
    [(True, before, f"substring({_B}, 1, {n})", after) for before, n, after in (("api_key=", 32, ""), ("password: ", 20, ""), ("Bearer ", 43, ""), ("", 40, ""), ("auth='", 28, "'"))],
    [(True, "", f"concat('sk_live_', substring({_B}, 1, 24))", "")],
    [(True, "iban ", f"concat('DE', substring({_D}, 1, 20))", "")],
    [(False, "on ", _digits("20", 2, "-0", 1, "-1", 1, " 1", 1), "")],
    [(False, "", _digits("19", 2, "-20", 2, " 20", 2), "")],
    [(False, "costs ", _digits(1, " ", 3, " ", 3, ".", 2), "")],
    [(False, before, _digits(16), "") for before in ("", "no. ", "order ")],
    [(False, before, _digits(n), "") for before, n in (("order ", 10), ("", 12), ("item ", 9))],
    [(False, "version ", _digits(2, ".", 2, ".3", 2, ".", 1), "")],
    [(False, "pages ", _digits(3, "-", 3, " ", 3), "")],
    [(False, "", _digits("(", 2, ".", 1, ") - (", 1, ".", 2, ")"), "")],
    [(False, "isbn ", _digits("978-", 1, "-", 2, "-", 6, "-", 1), "")],
    [(False, before, f"concat('x', {_WORDS}, '-20', substring({_D}, 3, 2))", after) for before, after in (("see ", ""), ("/", "/index.html"), ("id=", ""), ('title: "', '"'))],
    [(False, before, f"concat(replace(initcap(replace({_WORDS}, '-', ' ')), ' ', ''), 'Plus20', substring({_D}, 3, 2))", after) for before, after in (("", ""), ("key: ", ""), ('"', '"'))],
    [(False, "", f"concat(repeat(substring({_H}, 1, 1), 17), 'a1')", "")],
    [(False, "ref=", f"concat('item_20', substring({_D}, 1, 2), '_000', substring({_D}, 4, 3), '_v', substring({_D}, 8, 1))", "")],
    [(False, "", f"concat('chapter-', substring({_D}, 1, 2), '-section-', substring({_D}, 4, 1), '-figure-', substring({_D}, 6, 1))", "")],
]
PLANTED = [phrase for family in FAMILIES for phrase in family]
FAMILY_OF = [k for k, family in enumerate(FAMILIES) for _ in family]
#: Families that the trees behind the thresholds never see, of both answers and both kinds: two forms of telephone numbers, two of keys,
#: prices, pages, item numbers and chapters.
UNSEEN = [2, 6, 8, 10, 14, 18, 24, 25]


def running(items: str, kind: str, weight: str, join: str) -> str:
    """SQL of items (an array, a name) as array of (at, x): x an item, at the join of the weights (SQL of x) of all items before it, 0 at first.

    An array that grows item by item is copied each time, so it is grown in blocks and then flattened.
    """
    put = {"sum": "{a} + {w}", "max": "greatest({a}, {w})"}[join]
    empty = f"cast(array() as array<struct<at: int, x: {kind}>>)"
    return f"""if(size({items}) = 0, {empty},
        transform(array(transform(sequence(0, int((size({items}) - 1) div {BLOCK})), j -> slice({items}, j * {BLOCK} + 1, {BLOCK}))), bs ->
        transform(array(aggregate(transform(bs, b -> aggregate(b, 0, (a, x) -> {put.format(a="a", w=weight)})), named_struct('at', 0, 'out', cast(array() as array<int>)),
            (a, t) -> named_struct('at', {put.format(a="a.at", w="t")}, 'out', concat(a.out, array(a.at))), a -> a.out)), firsts ->
        flatten(transform(bs, (b, k) -> aggregate(b, named_struct('at', firsts[k], 'out', {empty}),
            (a, x) -> named_struct('at', {put.format(a="a.at", w=weight)}, 'out', concat(a.out, array(named_struct('at', a.at, 'x', x)))), a -> a.out))))[0])[0])"""


def with_candidates(df: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """df and one array column for each of the kinds: the spans (start, end, m, before, after) that pass the kind's own check."""
    df = df.withColumn("_t", F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "\x01", "\x02"))
    df = df.withColumn("_digit", F.col("_t").rlike("[0-9]"))
    for kind in kinds:
        can = F.col("_t").contains(NEEDS[kind]) if kind == "email" else F.col("_digit") & F.col("_t").contains(NEEDS[kind])
        df = df.withColumn(f"_p_{kind}", F.when(can, F.split(F.regexp_replace("_t", F.lit(PATTERNS[kind]), F.lit("\x01$0\x01")), "\x01")).otherwise(F.array("_t")))
    for kind in kinds:
        items = "if(size(p) = 1, cast(array() as array<struct<g: string, m: string, n: string>>), transform(sequence(0, int((size(p) - 1) div 2) - 1), i -> named_struct('g', p[2 * i], 'm', p[2 * i + 1], 'n', p[2 * i + 2])))"
        spans = running("items", "struct<g: string, m: string, n: string>", "length(x.g) + length(x.m)", "sum")
        found = f"""filter(transform(transform(array(_p_{kind}), p -> transform(array({items}), items -> {spans})[0])[0], r -> named_struct('start', r.at + length(r.x.g),
            'end', r.at + length(r.x.g) + length(r.x.m), 'm', r.x.m, 'before', right(r.x.g, 24), 'after', left(r.x.n, 8))), s -> {VALID[kind]})"""
        df = df.withColumn(f"_{kind}", F.expr(found))
    return df.drop("_t", "_digit", *[f"_p_{kind}" for kind in kinds])


def _base(kind: str) -> str:
    return f"transform(_{kind}, s -> named_struct('start', s.start, 'rank', {KINDS.index(kind)}, 'end', s.end, 'kind', '{kind}'))"


def planted_rows(df: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE) -> DataFrame:
    """(id, kind, the features, label, family): the candidates of the wider generators that cover a planted span."""
    texts = hashed_sample(df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")), "id", sample)
    at = F.pmod(F.xxhash64("id", F.lit(21)), F.greatest(F.length("text") - 2 * WINDOW, F.lit(0)) + 1).cast("int")
    windows = texts.groupBy("id").agg(F.min(F.substring("text", at + 1, F.lit(2 * WINDOW))).alias("w"))
    parts = [F.substring("w", 1, WINDOW).alias("left_part"), F.expr(f"substring(w, {WINDOW + 1})").alias("right_part")]
    made = windows.select("id", *parts, *[F.expr(sql).alias(name) for name, sql in MATERIAL.items()], F.pmod(F.xxhash64("id", F.lit(22)), F.lit(len(PLANTED))).cast("int").alias("which"))
    values = F.expr("CASE which " + " ".join(f"WHEN {i} THEN {sql}" for i, (_, _, sql, _) in enumerate(PLANTED)) + " END")
    label, before, after = (F.array(*[F.lit(phrase[k]) for phrase in PLANTED])[F.col("which")] for k in (0, 1, 3))
    family = F.array(*map(F.lit, FAMILY_OF))[F.col("which")]
    made = made.select("id", "left_part", "right_part", values.alias("value"), before.alias("before"), after.alias("after"), label.alias("label"), family.alias("family"))
    start = F.length("left_part") + 1 + F.length("before")
    made = made.select("id", F.concat("left_part", F.lit(" "), "before", "value", "after", F.lit(" "), "right_part").alias("text"), start.alias("a"), (start + F.length("value")).alias("b"), "label", "family")
    found = with_candidates(made, kinds=WIDE)
    wide = F.concat(*[F.expr(f"transform(_{k}, s -> named_struct('kind', '{k}', 'start', s.start, 'end', s.end, 'm', s.m, 'before', s.before, 'after', s.after))") for k in WIDE])
    rows = found.select("id", "a", "b", "label", "family", F.explode(wide).alias("s")).where("2 * (least(s.end, b) - greatest(s.start, a)) > greatest(s.end, b) - least(s.start, a)")
    return rows.select("id", "s.kind", *[F.expr(sql).alias(name) for name, sql in FEATURES.items()], F.col("label").cast("double").alias("label"), "family")


def trees_sql(model) -> str:
    """The probability of the fitted trees, as SQL over a struct f of the features."""
    names = list(FEATURES)

    def sql(node) -> str:
        if not hasattr(node, "split") or node.getClass().getSimpleName() == "LeafNode":
            return repr(float(node.prediction())) + "D"
        return f"if(f.{names[node.split().featureIndex()]} <= {node.split().threshold()!r}D, {sql(node.leftChild())}, {sql(node.rightChild())})"

    margin = " + ".join(f"{w!r}D * {sql(t._call_java('rootNode'))}" for w, t in zip(model.treeWeights, model.trees, strict=True))
    return f"1D / (1D + exp(-2D * ({margin})))"


def _trees() -> GBTClassifier:
    return GBTClassifier(maxIter=8, maxDepth=4, stepSize=0.3, seed=3, maxBins=32)


def fit_trees(df: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE, families: list[dict] | None = None) -> tuple[str, dict[str, float]]:
    """The trees as an SQL expression over the features f of a candidate, and the threshold of each kind; nothing passes one of 2.0.

    Trees that never saw the UNSEEN families give the thresholds: among the candidates of these families, PRECISION of what
    a threshold selects is planted personal data. The trees that are used are then fitted on all families.
    families: a list that gets (family, kind, label, n, selected) of each unseen family.
    """
    none = ("0.0D", dict.fromkeys(WIDE, 2.0))
    table = planted_rows(df, id_col, text_col, sample)
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table).select("id", "kind", "features", "label", "family").repartition(FIT_TASKS, "id").coalesce(FIT_TASKS).cache()
    unseen = F.col("family").isin(UNSEEN)
    counts = {r["label"]: r["count"] for r in table.where(~unseen).groupBy("label").count().collect()}
    if min(counts.get(0.0, 0), counts.get(1.0, 0)) < 5:
        table.unpersist()
        return none
    blind = _trees().fit(table.where(~unseen))
    scored = blind.transform(table.where(unseen)).select("kind", "family", "label", vector_to_array("probability")[1].alias("p"))
    grid = scored.groupBy("kind", "family", "label", F.round("p", 3).alias("p")).agg(F.count("*").alias("n")).collect()
    thresholds = dict.fromkeys(WIDE, 2.0)
    for kind in WIDE:
        good, n = 0, 0
        steps: dict[float, list[int]] = {}
        for r in grid:
            if r["kind"] == kind:
                step = steps.setdefault(r["p"], [0, 0])
                step[0], step[1] = step[0] + int(r["label"]) * r["n"], step[1] + r["n"]
        for p in sorted(steps, reverse=True):
            good, n = good + steps[p][0], n + steps[p][1]
            if p >= 0.5 and n >= 5 and good >= PRECISION * n:
                thresholds[kind] = p - 0.0005
    if families is not None:
        found: dict[tuple, list[int]] = {}
        for r in grid:
            one = found.setdefault((r["family"], r["kind"], r["label"]), [0, 0])
            one[0], one[1] = one[0] + r["n"], one[1] + r["n"] * (r["p"] >= thresholds[r["kind"]])
        families += [{"family": f, "kind": k, "label": y, "n": n, "selected": m} for (f, k, y), (n, m) in sorted(found.items())]
    model = _trees().fit(table)
    table.unpersist()
    return trees_sql(model), thresholds


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: tuple[str, dict[str, float]] | None = None) -> DataFrame:
    """df with `base` and `spans`: sorted arrays of (start, end, kind), in code points, ends exclusive.

    Columns of df with these names are replaced; all others are kept whatever they are called.
    """
    score, thresholds = model or fit_trees(df, id_col, text_col)
    kept = [c for c in df.columns if c.lower() not in ("base", "spans")]
    found = with_candidates(df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text_col}`").alias("text")), "text")
    found = found.withColumn("base", F.array_sort(F.concat(*[F.expr(_base(k)) for k in KINDS])))
    features = ", ".join(f"'{name}', {sql}" for name, sql in FEATURES.items())
    wide = ", ".join(f"transform(_{k}, s -> named_struct('kind', '{k}', 'rank', {len(KINDS) + i}, 's', s))" for i, k in enumerate(WIDE))
    scored = f"transform(concat({wide}), c -> transform(array(c.s), s -> named_struct('start', s.start, 'rank', c.rank, 'end', s.end, 'kind', c.kind, 'f', named_struct({features})))[0])"
    least = "CASE c.kind " + " ".join(f"WHEN '{k}' THEN {thresholds[k]!r}D" for k in WIDE) + " END"
    chosen = f"filter({scored}, c -> transform(array(c.f), f -> {score})[0] >= {least})"
    found = found.withColumn("more", F.expr(f"transform({chosen}, c -> named_struct('start', c.start, 'rank', c.rank, 'end', c.end, 'kind', c.kind))"))
    # in order of the starts, a span lies within another one if one before it ends no earlier
    order = "concat(transform(base, s -> named_struct('start', s.start, 'late', 0, 's', s)), transform(more, s -> named_struct('start', s.start, 'late', 1, 's', s)))"
    kind = "struct<start: int, late: int, s: struct<start: int, rank: int, end: int, kind: string>>"
    swept = running("items", kind, "x.s.end", "max")
    left = f"transform(filter(transform(array(array_sort({order})), items -> {swept})[0], r -> r.x.late = 0 or r.at < r.x.s.end), r -> r.x.s)"
    return found.withColumn("spans", F.when(F.size("more") > 0, F.array_sort(F.expr(left))).otherwise(F.col("base"))).select("row.*", "base", "spans")


def listed(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str, spans: str) -> Column:
    """The text (a column) with each span replaced by its kind in brackets; of overlapping spans the first names the whole."""
    swept = running("spans", "struct<start: int, rank: int, end: int, kind: string>", "x.end", "max")
    pieces = f"transform(filter({swept}, r -> r.x.start >= r.at), r -> concat(array_join(slice(letters, r.at + 1, r.x.start - r.at), ''), '[', r.x.kind, ']'))"
    rest = "array_join(slice(letters, array_max(transform(spans, s -> s.end)) + 1, size(letters)), '')"
    whole = f"transform(array(split(`{text}`, '')), letters -> transform(array(`{spans}`), spans -> concat(array_join({pieces}, ''), {rest}))[0])[0]"
    return F.when(F.size(F.col(f"`{spans}`")) > 0, F.expr(whole)).otherwise(F.col(f"`{text}`"))
