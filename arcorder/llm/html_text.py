r"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tags and words. A word scores the weight of a word and the weights of what it stands in:
landmark elements (nav, footer, aside, ...), links, and the names in classes, ids and roles; a tag scores the weight of
its name. One linear scan finds the contiguous region of the highest sum, and words inside it that score negative
between ones that score positive (an advert in the middle of an article) are left out.

The weights come from pages that label themselves with one <article> or <main> element. The marks are taken off, and a
structured perceptron moves the weights until the best region is the labelled one by a margin of MARGIN for each word, on
a bounded, hashed sample of SAMPLE pages and BYTES bytes of them. A name that stands only outside of their marks starts
at 0, so the pages alone decide about it; any other has a prior by its meaning (UNSEEN).

An <article> or <main> that stands in nothing negative and in no other one is read as if nothing were around it; any
other (a comment or a teaser is an article too) counts what it stands in and its own names like all elements do. Where a
page has several outermost articles, their own names count as well, so a comment beside the article is told from it.

White space inside a block becomes one space, blocks are joined by a newline, character references are decoded; a
<br> is white space. Null, empty or textless pages give an empty text. Every row is kept, whole pages are read in time
that is linear in their length, however deep their elements are nested (the fit leaves out pages with more than NAMES
names around one word). An output column named like one in `keep` is an error.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcorder.llm.common import bounded_rows, hashed_sample, no_clash, split_batch, unused_name

#: Labelled pages that the weights are fitted on, at most about, and their bytes in all.
SAMPLE, BYTES = 400, 1 << 25
#: By how much, for each word, the labelled region must beat every other one.
MARGIN = 0.25
#: Names around one word of a page that the fit takes, at most.
NAMES = 512
#: The rest of a self-closed tag; a slash that ends an unquoted value is part of the value.
SELF_CLOSED = r"(?:[^\s\"'>=/]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+|\s++|/(?!>))*+/>"
SELF_CLOSED_REST = re.compile(SELF_CLOSED)
#: Elements whose content is no markup, and is no text of the page either.
RAW = {n: re.compile(rf"</{n}\s*>", re.IGNORECASE) for n in ("script", "style", "noscript", "template", "textarea", "title", "select", "svg", "iframe")}
TAG_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
TAG_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
#: Elements that say what their content is for; others only lay it out.
LANDMARKS = set("aside button dialog fieldset footer form head header menu nav section".split())
#: Priors of names that no labelled page shows: landmarks but sections, and words that name what is no main text.
UNSEEN = re.compile(
    r"(?:^|[\s_-])(?<!\bno[_-])(?<!\bhas[_-])(?<!\bwith[_-])(?<!\bwithout[_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|newsletter|subscri\w*|shar(?:e|ing)|social|related|recommend\w*|"
    r"sidebar|aside|menu|nav\w*|breadcrumbs?|footer|header|masthead|comments?|repl(?:y|ies)|disqus|log-?in|sign-?up|search|pag(?:er|ination)|pop-?up|modal|toolbar|widget|"
    r"complementary|contentinfo)(?:$|[\s_-])",
    re.IGNORECASE,
)
BLOCKS = set(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
MARKS = {"article", "main"}
DIGITS = re.compile("[0-9]+")
#: Elements whose end tag is optional: the start tags that end them, and the open elements that these don't reach across.
LISTS, TABLE = {"ul", "ol", "menu"}, {"table"}
CLOSED_BY = {
    "p": (BLOCKS - {"body", "caption", "html", "tbody", "td", "tfoot", "th", "thead", "tr"} | {"menu", "dialog"}, {"button", "td", "th", "caption", "table"}),
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th", "tr", "tbody", "thead", "tfoot"}, TABLE),
    "th": ({"td", "th", "tr", "tbody", "thead", "tfoot"}, TABLE),
    "tr": ({"tr", "tbody", "thead", "tfoot"}, TABLE),
    "tbody": ({"tbody", "tfoot"}, TABLE),
    "thead": ({"tbody", "tfoot"}, TABLE),
    "option": ({"option", "optgroup"}, {"select", "datalist"}),
}
CLOSES = {n: {k for k, (by, _) in CLOSED_BY.items() if n in by} for n in set().union(*[by for by, _ in CLOSED_BY.values()])}
HEAD_ONLY = {"base", "link", "meta"}
CELLS = {"td", "th", "caption"}
TABLE_PARTS = {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "body", "html"}

#: What the words stand in (its names, or the sum of their weights), or (tag,); text; number of words (0 for tags and white space).
Token = tuple[tuple[str, ...] | float, str, int]
SPACE: tuple[str, ...] = (" ",)


def markup(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of all that is no text, in order; no name for comments and raw elements.

    An end that was looked for in vain once isn't looked for again, so a page of broken tags costs one pass.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while (at := page.find("<", at)) >= 0:
        start = at
        m = TAG_NAME.match(page, at)
        if m is None:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = len(page) if end < 0 else end + 3
            elif page.startswith(("<!", "<?", "</"), at) and at < last:
                at = page.find(">", at) + 1
            else:
                at += 1
                continue
            yield start, at, "", False, ""
            continue
        name = m[1].lower()
        if last < m.end():  # a tag that the page breaks off
            yield start, len(page), "", False, ""
            return
        rest = TAG_REST.match(page, m.end()) if quotes else None
        quotes = rest is not None  # a quote that never ends: from here on the first > ends a tag
        at = rest.end() if rest else page.find(">", m.end()) + 1
        attributes = page[m.end() : at - 1]
        closing = page[start + 1] == "/"
        if name in RAW and not closing and not (name in ("svg", "iframe") and SELF_CLOSED_REST.fullmatch(attributes + ">")):
            end = RAW[name].search(page, at)
            at = end.end() if end else len(page)
            name = ""
        yield start, at, name, closing, attributes


def names_of(name: str, attributes: str) -> list[str]:
    """Names that say what an element is for: its own if it is a landmark or a link, and those of its classes, id and role."""
    found = [f"in:{name}"] if name in LANDMARKS or name == "a" else []
    if "=" in attributes:
        for x in ATTRIBUTES.findall(attributes):
            found += [f"in:.{DIGITS.sub('0', n)}" for n in (x[0] or x[1] or x[2]).lower().split()]
    return found


class Around:
    """What the words of an element stand in: the sum of the weights of its distinct names, or, for the fit, the names.

    Each element only keeps the names that it adds, so nesting costs nothing more.
    """

    __slots__ = ("added", "mark", "names", "negative", "open", "score")

    def __init__(self, outer: Around | None = None, added: list[str] = (), weights: Weights | None = None) -> None:
        self.open: Counter[str] = outer.open if outer else Counter()  # names open now, shared by all that stand in one another
        self.added = [n for n in dict.fromkeys(added) if not self.open[n]]
        self.open.update(self.added)
        self.mark: list | None = None
        self.score, self.negative, self.names = 0.0, False, ()
        if weights is None:
            self.names = outer.names if outer else ()
            if self.added:
                self.names = tuple(sorted({*self.names, *self.added}))
        elif outer:
            self.score = outer.score + sum(weights[n] for n in self.added)
            self.negative = outer.negative or any(weights[n] < 0 for n in self.added)

    def close(self) -> None:
        self.open.subtract(self.added)


class TooDeep(Exception):
    pass


def tokens(page: str, weights: Weights | None = None) -> list[Token]:
    """With weights, what words stand in is the sum of its names' weights; without (for the fit), it is the names, and
    article and main are no elements at all."""
    out: list[Token] = []
    at = 0
    opened = Opened()
    within = [Around()]  # what a word stands in, outside of all elements and in each of them
    marks: list[list] = []  # first token, end, weight of the own names of each outermost article

    def text(a: int, b: int) -> None:
        if b > a and (raw := page[a:b]) and not raw.isspace():
            said = html_lib.unescape(raw) if "&" in raw else raw
            words = len(said.split())
            around = within[-1].names if weights is None else within[-1].score
            out.append((around if words else SPACE, said, words))
        elif b > a:
            out.append((SPACE, " ", 0))

    def close(depth: int) -> None:
        while len(within) > depth:
            done = within.pop()
            done.close()
            if done.mark:
                done.mark[1] = len(out)

    for start, end, name, closing, attributes in markup(page):
        text(at, start)
        at = end
        if not name:
            continue
        if weights is not None or name not in MARKS:
            if closing:
                opened.end_tag(name)
            else:
                opened.start_tag(name)
            close(len(opened.names) + 1)
            if not closing and name not in VOID and not attributes.endswith("/"):
                own = names_of(name, attributes) if name not in ("html", "body") else []
                outermost = name in MARKS and not opened.places.get("main") and not (name == "article" and opened.places.get("article"))
                if name in ("html", "body") or outermost and (name == "main" or not within[-1].negative):
                    within.append(Around())
                    if name == "article":
                        within[-1].mark = [len(out), -1, sum(weights[n] for n in dict.fromkeys(own))]
                        marks.append(within[-1].mark)
                else:
                    within.append(Around(within[-1], own, weights))
                    if weights is None and len(within[-1].names) > NAMES:
                        raise TooDeep
                opened.push(name)
        out.append(((f"{'/' if closing else ''}{name}",), "", 0))
    text(at, len(page))
    close(1)
    if len(marks) > 1:
        for a, b, own in marks:
            if own:
                out[a:b] = [(t[0] + own, t[1], t[2]) if t[2] else t for t in out[a:b]]
    return out


class Opened:
    """The open elements, with the places of each name, so that every tag costs a bounded number of steps."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}

    def last(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def push(self, name: str) -> None:
        for kind in (name, *([" block"] if name in BLOCKS else []), *([" cell"] if name in CELLS else [])):
            self.places.setdefault(kind, []).append(len(self.names))
        self.names.append(name)

    def cut(self, i: int) -> None:
        for name in self.names[i:]:
            self.places[name].pop()
            if name in BLOCKS:
                self.places[" block"].pop()
            if name in CELLS:
                self.places[" cell"].pop()
        del self.names[i:]

    def start_tag(self, name: str) -> None:
        """Ends the elements that the start tag of `name` ends."""
        if self.names and self.names[-1] == "head" and name not in HEAD_ONLY:
            self.cut(len(self.names) - 1)
        ended = [at for k in CLOSES.get(name, ()) if (at := self.last((k,))) > self.last(CLOSED_BY[k][1])]
        if ended:
            self.cut(min(ended))

    def end_tag(self, name: str) -> None:
        """Ends the nearest open element of its name and all in it; an inline one ends none across a block, none ends across a cell but a table's."""
        at = self.last((name,))
        if at < 0:
            return
        if name not in BLOCKS and name not in LANDMARKS and self.last((" block",)) > at:
            return
        if name not in TABLE_PARTS and self.last((" cell",)) > at:
            return
        self.cut(at)


def prior(name: str) -> float:
    if not name.startswith("in:"):
        return 0.0 if name == " " else -8.0 if name.lstrip("/") in MARKS else -0.2
    if name == "in:a":
        return -0.5
    return -1.2 if name[3:] in LANDMARKS - {"section"} or name.startswith("in:.") and UNSEEN.search(name[4:]) else 0.0


class Weights(dict):
    """Weights by name; one that was not learned is its prior."""

    def __missing__(self, name: str) -> float:
        self[name] = value = prior(name)
        return value

    def of(self, token: Token) -> float:
        names, _, words = token
        if not words:
            return self[names[0]]
        if isinstance(names, float):
            return words * (1.0 + names)
        return words * (1.0 + sum(self[n] for n in names))


def best_run(values: list[float]) -> tuple[int, int]:
    """Start and end of the run with the highest sum; the first of equal ones, (0, 0) if none is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, v in enumerate(values):
        total += v
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    return span


def region_text(found: list[Token], weights: Weights) -> str:
    """The text of a region, without the words that score negative between ones that score positive."""
    values = [weights.of(t) if t[2] else 0.0 for t in found]
    good = [i for i, v in enumerate(values) if v > 0]
    blocks: list[str] = []
    now: list[str] = []
    for i, (names, said, words) in enumerate(found):
        if words:
            if values[i] >= 0 or not good or i < good[0] or i > good[-1]:
                now.append(said)
        elif names is SPACE or names[0] == "br":
            now.append(" ")
        elif names[0].lstrip("/") in BLOCKS:
            blocks.append(" ".join("".join(now).split()))
            now = []
    blocks.append(" ".join("".join(now).split()))
    return "\n".join(b for b in blocks if b)


def main_text(page: str | None, weights: Weights) -> str:
    found = tokens(page or "", weights)
    a, b = best_run([weights.of(t) for t in found])
    return region_text(found[a:b], weights)


def labelled_page(page: str) -> tuple[list[Token], int, int] | None:
    """The tokens without the marks, and the region that they labelled; None unless there is exactly one of one kind."""
    try:
        found = tokens(page)
    except TooDeep:
        return None
    for name in ("article", "main"):
        a, b = [i for i, t in enumerate(found) if not t[2] and t[0][0] == name], [i for i, t in enumerate(found) if not t[2] and t[0][0] == f"/{name}"]
        if len(a) == len(b) == 1 and a[0] < b[0]:
            marks = [not t[2] and t[0][0].lstrip("/") in MARKS for t in found]
            return [t for t, m in zip(found, marks, strict=True) if not m], a[0] - sum(marks[: a[0]]), b[0] - sum(marks[: b[0]])
    return None


def fit_weights(pages: list[str], epochs: int = 30, rate: float = 0.1) -> Weights:
    """Structured perceptron with a margin over pages that label themselves; tags stay negative, and a link alone never makes a word so."""
    labelled = [x for p in pages if (x := labelled_page(p or "")) is not None]
    # a name inside of a labelled region says nothing: asides stand in articles too
    inside = {n for found, a, b in labelled for names, _, words in found[a:b] if words for n in names} - {"in:a"}
    free = {n for found, _, _ in labelled for names, _, words in found if words for n in names} - inside
    weights = Weights({n: 0.0 for n in free})
    for _ in range(epochs):
        wrong = 0
        for found, a, b in labelled:
            # words outside are made dearer and those inside cheaper, so the best region is right only by the margin
            values = [weights.of(t) + t[2] * (-MARGIN if a <= i < b else MARGIN) for i, t in enumerate(found)]
            x, y = best_run(values)
            change: Counter[str] = Counter()
            for i in range(min(a, x), max(b, y)):
                side = (a <= i < b) - (x <= i < y)
                if side and (found[i][2] or found[i][0] is not SPACE):
                    for n in found[i][0]:
                        if n in free or not n.startswith("in:"):
                            change[n] += side * max(1, found[i][2])
            if not any(found[i][2] and (a <= i < b) != (x <= i < y) for i in range(min(a, x), max(b, y))):
                continue
            wrong += 1
            for n, c in change.items():
                step = rate * max(-1.0, min(1.0, c))
                weights[n] = max(weights[n] + step, -0.8) if n == "in:a" else weights[n] + step if n.startswith("in:") else min(weights[n] + step / 10, -0.01)
        if not wrong:
            break
    return weights


def fit(df: DataFrame, id_col: str, html_col: str, sample: int = SAMPLE, budget: int = BYTES) -> Weights:
    """Weights from self-labelled pages; equal whatever the order of files and rows."""
    pages = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").cast("string").alias("html")).where(F.col("html").rlike("<(article|main)"))
    return fit_weights(bounded_rows(hashed_sample(pages, "id", sample), "html", 2 * sample, budget).column("html").to_pylist())


def extract(df: DataFrame, html_col: str = "html", keep: list[str] | None = None, weights: Weights | None = None) -> DataFrame:
    """The columns in `keep` (all but the html if None) and the page's main text as `text`."""
    keep = [c for c in df.columns if c not in (html_col, "text")] if keep is None else keep
    no_clash(keep, "text")
    weights = weights if weights is not None else Weights()
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").cast("string").alias(unused_name(keep, "html")))
    schema = df.select(*[F.col(f"`{c}`") for c in keep], F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, len(keep)):
                texts = [main_text(page, weights) for page in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    return source.mapInArrow(run, schema)
