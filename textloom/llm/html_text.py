"""Main text of web pages by equivalence-class template deduction.

1. Every page becomes a sequence of tokens: tags, told apart by their paths, and the text of blocks with its path. Pages of a host
   with equal sequences count once.
2. A token's occurrence vector says how often each page of the host has it. Tokens with the same vector over all the host's
   pages are an equivalence class. Vectors are compared by hashes that tasks sum up, so no host is gathered in one task. Classes that at
   least SUPPORT of the pages have are candidates.
3. A class is ordered if its tokens stand on every page as repetitions of one sequence; others are dropped.
4. Two ordered classes nest if they never interleave and all occurrences of the one lie in the same gap of the other, or all
   outside; of two that don't nest the less supported one is dropped. What is left nests into the host's template.
5. The template's texts are the host's fixed words and go, wherever they stand. What stands in the gaps are the slots; those
   outside menus, headers, footers, sidebars, notices, adverts, forms and comments, which tags and their marks tell, are the text, within
   <article> or <main> where a page has one.

Defined cases: null html is empty; no text gives an empty string. A null url is the host of no name. Repeated pages are pages each, but a
host needs LEAST_PAGES different pages before it has a template. Broken markup: an end tag without start is ignored, an
unclosed element ends with its parent, a lone < is text. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialize, slices, table

LEAST_PAGES, SUPPORT = 4, 0.6
#: Bytes of all templates up to which they are broadcast; beyond, they are joined by host.
BROADCAST_BYTES = 16_000_000
OUTSIDE, CROSSED = -1, -2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*>|[^<]+|<",
    re.S | re.I,
)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_BOILER_TAGS = frozenset("nav header footer aside form button menu dialog head noscript label fieldset".split())
_BOILER_MARKS = re.compile(
    r"(?:^|[\s_\"'-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar\w*|side-bar|rail|menu\w*|nav\w*|navigation|footer\w*|header|masthead|comment\w*|disqus\w*|cookie\w*|consent\w*|gdpr|notice\w*|alert\w*|popup\w*|modal\w*|overlay"
    r"|newsletter\w*|subscri\w*|social\w*|share\w*|sharing|related\w*|recommend\w*|breadcrumb\w*|widget\w*|pagination|pager|toolbar|contentinfo|complementary|reply|replies|respond|login|signup)(?:$|[\s_\"'-])",
    re.I,
)
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_KEEPS_P = frozenset("a abbr b bdi bdo cite code del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var br img wbr input".split())




def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - 2**63


class _Stack:
    """Open elements; where each name and the last block stand is known without a search, however deep the page is."""

    def __init__(self) -> None:
        self.items: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]  # name, boilerplate, in article, path
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = [0]

    def last(self, *names: str) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def push(self, name: str, boiler: bool, article: bool, path: int) -> None:
        self.at[name].append(len(self.items))
        if name in _BLOCKS:
            self.blocks.append(len(self.items))
        self.items.append((name, boiler, article, path))

    def cut(self, at: int) -> None:
        while len(self.items) > at:
            self.at[self.items.pop()[0]].pop()
            if self.blocks[-1] == len(self.items):
                self.blocks.pop()


class Page:
    """Blocks of a page: (text, boilerplate, in article, token), and its tokens in order."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, bool, int]] = []
        self.tokens: list[int] = []
        self.main = False
        stack, words = _Stack(), []

        def flush() -> None:
            text = " ".join(html.unescape("".join(words)).split())
            words.clear()
            if text:
                _, boiler, article, path = stack.items[-1]
                self.tokens.append(_hash(f"{path} {text}"))
                self.blocks.append((text, boiler, article, self.tokens[-1]))

        end = source.rfind(">") + 1  # no tag goes beyond
        for m in _TOKEN.finditer(source, 0, end):
            t = m[0]
            if t[0] != "<" or t == "<":
                words.append(t)
                continue
            if m[1] or t[1] in "!?":
                if m[1] and m[1].lower() != "svg":
                    words.append(" ")
                continue
            name = _NAME.match(t)[1].lower()
            block = name in _BLOCKS
            if t[1] == "/":
                at = stack.last(name)
                if block:
                    flush()
                if at and (block or stack.blocks[-1] < at):
                    stack.cut(at)
                continue
            if block:
                flush()
                if name not in _KEEPS_P:
                    at = stack.last("p")
                    if at and stack.blocks[-1] <= at:
                        stack.cut(at)
                if name in _CLOSES:
                    at = stack.last(*_CLOSES[name])
                    if at > stack.last("ul", "ol", "dl", "table", "select"):
                        stack.cut(at)
            elif name == "br":
                words.append(" ")
            if name in _VOID or t.endswith("/>") and not block:
                continue
            _, boiler, article, path = stack.items[-1]
            marks = " ".join(x.strip("\"'") for x in _MARKS.findall(t))
            if block or marks:
                path = _hash(f"{path}/{name}.{marks}")
                self.tokens.append(path)
            if name in ("article", "main"):
                article, self.main = True, True
            stack.push(name, boiler or name in _BOILER_TAGS or bool(marks and _BOILER_MARKS.search(marks)), article, path)
        words.append(source[end:])
        flush()

    def text(self, fixed: set[int]) -> str:
        main = self.main and any(a and not b for _, b, a, _ in self.blocks)
        return "\n\n".join(t for t, boiler, article, token in self.blocks if not boiler and (article or not main) and token not in fixed)


# --- the template ------------------------------------------------------------------------------------------------------


def order_of(sequence: list[int]) -> tuple[int, ...] | None:
    """The sequence that a class's tokens on a page repeat, None if they don't."""
    size = len(set(sequence))
    first = sequence[:size]
    return tuple(first) if len(set(first)) == size and len(sequence) % size == 0 and first * (len(sequence) // size) == sequence else None


def nesting(tokens: list[int], classes: dict[int, tuple[int, ...]]) -> Iterator[tuple[int, int, int]]:
    """(class, other class of several tokens, state) of each occurrence: the other's gap it lies in, OUTSIDE or CROSSED."""
    place = {t: (c, i) for c, order in classes.items() for i, t in enumerate(order)}
    here = [(*place[t],) for t in tokens if t in place]
    several = {c for c, _ in here if len(classes[c]) > 1}
    stack: list[list[int]] = []  # class, its tokens so far
    for c, i in here:
        if i:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == c), None)
            if at is None:
                continue
            for d, _ in stack[at + 1 :]:
                yield d, c, CROSSED
            del stack[at + 1 :]
            stack[at][1] = i + 1
            if i + 1 == len(classes[c]):
                stack.pop()
            continue
        inside = dict(map(tuple, stack))
        for d in several:
            if d != c:
                yield c, d, inside[d] - 1 if d in inside else OUTSIDE
        if len(classes[c]) > 1:
            stack.append([c, 1])


@lean
def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) -> host, page, tokens."""
    for some in slices(batches, 1):
        tokens = [Page(x.as_py() or "").tokens for x in some.column(1)]
        pages = [xxhash.xxh64_intdigest(b"".join(t.to_bytes(8, "little", signed=True) for t in own)) - 2**63 for own in tokens]
        yield pa.RecordBatch.from_arrays([some.column(0), pa.array(pages, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["host", "page", "tokens"])


@lean
def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, tokens) -> of each token its pages and a hash of its vector over these."""
    for batch in batches:
        sums: dict[tuple[int, int], list[int]] = {}
        for host, page, tokens in zip(*(batch.column(c).to_pylist() for c in range(3))):
            counts: dict[int, int] = defaultdict(int)
            for t in tokens:
                counts[t] += 1
            of = {n: xxhash.xxh64_intdigest(page.to_bytes(8, "little", signed=True), n) - 2**63 for n in set(counts.values())}
            for t, n in counts.items():
                own = sums.setdefault((host, t), [0, 0])
                own[0] += 1
                own[1] ^= of[n]
        cols = ([k[0] for k in sums], [k[1] for k in sums], [v[0] for v in sums.values()], [v[1] for v in sums.values()])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["host", "tok", "pages", "vec"])


@lean
def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, tokens, [(vec, tok)]) -> (host, vec, hash, order), at most two different ones of a class and batch: two tell that it isn't ordered."""
    for batch in batches:
        found: dict[tuple[int, int], dict[int, tuple[int, ...]]] = defaultdict(dict)
        for host, tokens, classes in zip(*(batch.column(c).to_pylist() for c in range(3))):
            of = {x["tok"]: x["vec"] for x in classes}
            own: dict[int, list[int]] = defaultdict(list)
            for t in tokens:
                if t in of:
                    own[of[t]].append(t)
            for vec, sequence in own.items():
                seen = found[host, vec]
                if len(seen) < 2:
                    order = order_of(sequence) or ()
                    seen[_hash(repr(order))] = order
        rows = [(host, vec, h, order) for (host, vec), seen in found.items() for h, order in seen.items()]
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.int64()))], ["host", "vec", "hash", "toks"])


@lean
def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, tokens, [(vec, pages, toks)]) -> (host, c, c_rank, d, d_rank, least, most) of the states of c to d."""
    for batch in batches:
        found: dict[tuple[int, int, int], list[int]] = {}
        rank: dict[tuple[int, int], int] = {}
        for host, tokens, classes in zip(*(batch.column(c).to_pylist() for c in range(3))):
            for x in classes:
                rank[host, x["vec"]] = (x["pages"] << 24) + min(len(x["toks"]), (1 << 24) - 1)
            for c, d, state in nesting(tokens, {x["vec"]: tuple(x["toks"]) for x in classes}):
                own = found.setdefault((host, c, d), [state, state])
                own[0], own[1] = min(own[0], state), max(own[1], state)
        rows = [(host, c, rank[host, c], d, rank[host, d], *own) for (host, c, d), own in found.items()]
        cols = list(zip(*rows)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["host", "c", "c_rank", "d", "d_rank", "least", "most"])


def _beside(rows: DataFrame, templates: DataFrame, size: str) -> DataFrame:
    """rows and templates joined by host; templates are broadcast only while all of them are small."""
    total = templates.agg(F.sum(F.lit(64) + F.expr(size) * 16)).first()[0] or 0
    side = templates.withColumnRenamed("host", "_host")
    return rows.join(F.broadcast(side) if total <= BROADCAST_BYTES else side, F.col("host") == F.col("_host"), "left").drop("_host")


def templates(pages: DataFrame) -> DataFrame:
    """pages (host long, html) -> host, fixed: the tokens of its template. Hosts without one have no row."""
    parsed = pages.mapInArrow(_parsed, "host long, page long, tokens array<long>")
    parsed = materialize(parsed.dropDuplicates(["host", "page"]), "parsed")
    sizes = parsed.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES)
    vectors = parsed.mapInArrow(_vectors, "host long, tok long, pages long, vec long").groupBy("host", "tok").agg(F.sum("pages").alias("pages"), F.bit_xor("vec").alias("vec"))
    common = vectors.filter("pages > 1").join(sizes, "host").filter(F.col("pages") >= F.col("n") * SUPPORT)
    common = materialize(common.groupBy("host").agg(F.collect_list(F.struct("vec", "tok", "pages")).alias("classes")), "classes")
    able = _beside(parsed.select("host", "tokens"), common, "size(classes)").filter("classes IS NOT NULL").select("host", "tokens", "classes")
    orders = able.mapInArrow(_orders, "host long, vec long, hash long, toks array<long>")
    ordered = orders.groupBy("host", "vec").agg(F.min("hash").alias("h"), F.max("hash").alias("g"), F.min_by("toks", "hash").alias("toks")).filter("h = g AND size(toks) > 0")
    support = common.select("host", F.explode("classes").alias("x")).select("host", "x.vec", "x.pages").distinct()
    ordered = materialize(ordered.join(support, ["host", "vec"]).select("host", "vec", "pages", "toks"), "ordered")
    nested = ordered.groupBy("host").agg(F.collect_list(F.struct("vec", "pages", "toks")).alias("classes"))
    able = _beside(parsed.select("host", "tokens"), nested, "aggregate(classes, 0L, (a, x) -> a + 2 + size(x.toks))").filter("classes IS NOT NULL").select("host", "tokens", "classes")
    states = able.mapInArrow(_states, "host long, c long, c_rank long, d long, d_rank long, least long, most long").groupBy("host", "c", "c_rank", "d", "d_rank").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    wrong = states.filter(f"least <> most OR least = {CROSSED}")
    loser = F.when(F.struct("c_rank", "c") < F.struct("d_rank", "d"), F.col("c")).otherwise(F.col("d"))
    out = wrong.select("host", loser.alias("vec")).distinct()
    kept = ordered.join(out, ["host", "vec"], "left_anti")
    return materialize(kept.groupBy("host").agg(F.flatten(F.collect_list("toks")).alias("fixed")), "templates")


@lean
def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, set[int]] = {}
    for some in slices(batches, 2):
        out = []
        for host, source, fixed in zip(some.column(3).to_pylist(), some.column(2), some.column(4)):
            if host not in held:
                held = {} if len(held) >= 256 else held
                held[host] = set(fixed.as_py() or ())
            out.append(Page(source.as_py() or "").text(held[host]))
        yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars. Pages are read twice and shuffled only if the templates are too many to broadcast."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", "html", F.xxhash64(host).alias("host"))
    found = templates(rows.select("host", "html"))
    return _beside(rows, found, "size(fixed)").select("page_id", "url", "html", "host", "fixed").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
