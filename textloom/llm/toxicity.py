"""Toxicity by weak supervision.

1. Words over-represented in toxic training documents (a bounded sample of labelled rows, written once) give lexicons. A family of
   copies counts as one document.
2. Lexicons and patterns vote on every document: toxic, clean or no vote. The counts of all documents' vote patterns are summed.
3. A generative label model is fitted to these counts by expectation maximisation: the class balance and each voter's chances of
   its votes given the class. Voters that agree more than the class explains are correlated; they are joined into cliques, whose
   joint votes are modelled together, and the model is fitted again.
4. A linear classifier over the lexicon and the patterns is trained on the model's posterior labels of the sampled documents, and
   scores every whole text.

Only rows whose crc32(doc_id) mod 5 is not 0 give labels; labels, lang, source and doc_id are never inputs of a score.

Defined cases: null and empty texts are scored as texts without words. A null doc_id is not held out and never trains. Repeated
rows are scored each. Without usable labels the curated lexicon alone votes. Rows with a null label are skipped. An empty table
gives no rows. Extra columns are ignored by ``score`` and kept by ``reject``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_text, blobs, buffer_of, lean, materialize, slices, table
from .jaccard_join import shingles

#: Labelled documents that may train, and a word's least toxic documents.
TRAIN_ROWS, LEAST = 12_000, 4
#: Documents are counted in parts of this, so that sums are whole numbers and alike in any order.
UNIT = 1 << 20
#: A lexicon word's share of the toxic documents, and the standard deviations by which it exceeds chance.
SHARE, DEVIATIONS = 0.03, 5.0
SEED_WORDS = frozenset(
    b"idiot idiots moron morons stupid dumb scum loser losers trash pathetic worthless clown clowns imbecile jerk creep freak disgusting vermin "
    b"dummkopf trottel abschaum versager idiota idiotas imbecil basura idiote abruti ordure minable".split()
)
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_LEET = bytes(dict(zip(b"013457@$!", b"oieastasi")).get(c, _SPLIT[c]) for c in range(256))
_ASCII, _ASCII_UPPER, _ASCII_LOWER = bytes(range(128)), bytes(range(65, 91)), bytes(range(97, 123))
VOTERS = ("seed", "strong", "strong twice", "weak twice", "disguised", "direct", "shouting", "no word", "long and no word")
NONE, CLEAN, TOXIC = 0, 1, 2


def _mostly_upper(text: bytes) -> bool:
    """Whether the whole text, in any script, has more upper than lower case letters."""
    rest = text.translate(None, _ASCII).decode("utf-8", "ignore")
    upper = len(text) - len(text.translate(None, _ASCII_UPPER)) + sum(map(str.isupper, rest))
    return upper > len(text) - len(text.translate(None, _ASCII_LOWER)) + sum(map(str.islower, rest))


@dataclass
class Lexicon:
    strong: dict[bytes, int] = field(default_factory=dict)
    weak: dict[bytes, int] = field(default_factory=dict)

    def read(self, text: bytes) -> tuple[tuple[int, ...], list[int], int]:
        """Votes, numbers of the lexicon words in the text, and its words."""
        words = text.translate(_SPLIT).split()
        found = set(words)
        strong = found & self.strong.keys()
        weak = found & self.weak.keys()
        seed = found & SEED_WORDS
        disguised = False
        if not strong and not seed:
            plain = set(text.translate(_LEET).split())
            disguised = bool((plain & self.strong.keys() or plain & SEED_WORDS) and plain != found)
        direct = False
        if strong or seed:
            bad = strong | seed
            direct = any(w in bad and {b"you", b"your", b"du", b"tu", b"vous"} & set(words[max(0, i - 3) : i]) for i, w in enumerate(words))
        shouting = text.count(b"!") >= 5 and _mostly_upper(text)
        hit = bool(strong or seed)
        votes = (
            TOXIC if seed else NONE,
            TOXIC if strong else NONE,
            TOXIC if len(strong) >= 2 else NONE,
            TOXIC if len(weak) >= 2 else NONE,
            TOXIC if disguised else NONE,
            TOXIC if direct else NONE,
            TOXIC if shouting else NONE,
            NONE if hit or disguised else CLEAN,
            NONE if hit or weak or len(words) < 60 else CLEAN,
        )
        return votes, sorted([self.strong[w] for w in strong] + [len(self.strong) + self.weak[w] for w in weak]), len(words)

    @property
    def size(self) -> int:
        return len(self.strong) + len(self.weak)


@lean
def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text, weight) -> (word, clean, toxic): weights of the documents that hold it; all documents' under the empty word."""
    counts: dict[bytes, list[int]] = {}
    rows = [0, 0]
    for b in slices(batches, 1):
        for toxic, text, weight in zip(b.column(0).to_pylist(), blobs(b.column(1)), b.column(2).to_pylist()):
            rows[toxic] += weight
            for w in set(text.translate(_SPLIT).split()):
                counts.setdefault(w, [0, 0])[toxic] += weight
        if len(counts) > 200_000:
            yield _counted(counts)
            counts = {}
    counts[b""] = rows
    yield _counted(counts)


def _counted(counts: dict[bytes, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["word", "clean", "toxic"])


@lean
def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a text's smallest shingle hash, which most near copies share."""
    for b in slices(batches, 1):
        off, data = buffer_of(b.column(1))
        bounds, h = shingles(off, data)
        least = [int(h[i]) >> 1 if i < j else -1 for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.int64())], ["toxic", "text", "sketch"])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, text, weight of at most TRAIN_ROWS labelled documents, written once. Copies of a label share the weight of one document."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    sample = usable.select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "toxic").limit(TRAIN_ROWS)
    found = docs.join(F.broadcast(sample), "doc_id").select("toxic", binary_text().alias("text"))
    rows = materialize(found.mapInArrow(_sketched, "toxic int, text binary, sketch long"), "train")
    alike = rows.groupBy("toxic", "sketch").agg(F.count("*").alias("n"))  # at most TRAIN_ROWS small rows
    return rows.join(F.broadcast(alike), ["toxic", "sketch"]).select("toxic", "text", F.greatest(F.lit(1), F.floor(F.lit(UNIT) / F.col("n"))).cast("long").alias("weight"))


def mine(train: DataFrame) -> Lexicon:
    """train (toxic int, text binary, weight long)."""
    sums = train.mapInArrow(_words, "word binary, clean long, toxic long").groupBy("word").agg((F.sum("clean") / UNIT).alias("clean"), (F.sum("toxic") / UNIT).alias("toxic"))
    sums = materialize(sums, "words")
    all_rows = sums.filter(F.length("word") == 0).first()
    if all_rows is None or not all_rows.toxic or not all_rows.clean:
        return Lexicon({w: i for i, w in enumerate(sorted(SEED_WORDS))}, {})
    lift = ((F.col("toxic") + 0.1) / all_rows.toxic) / ((F.col("clean") + 0.5) / all_rows.clean)
    # a word's toxic documents must be a share of all toxic ones, and more than chance gives, so that copies of one text name no words
    chance = (F.col("toxic") + F.col("clean")) * F.lit(all_rows.toxic / (all_rows.toxic + all_rows.clean))
    least = max(LEAST, SHARE * all_rows.toxic)
    rated = sums.filter((F.length("word") > 0) & (F.col("toxic") >= least) & ((F.col("toxic") - chance) / F.sqrt(chance) >= DEVIATIONS)).withColumn("lift", lift)
    # the words of a bounded sample, each in LEAST documents or more
    strong = rated.filter("lift >= 12").orderBy(F.desc("toxic"), "word").collect()
    weak = rated.filter("lift >= 3 AND lift < 12").orderBy(F.desc("toxic"), "word").collect()
    return Lexicon({bytes(r.word): i for i, r in enumerate(strong)}, {bytes(r.word): i for i, r in enumerate(weak)})


# --- the label model ---------------------------------------------------------------------------------------------------


@dataclass
class LabelModel:
    balance: float
    cliques: list[tuple[int, ...]]
    chances: list[dict[tuple[int, ...], tuple[float, float]]]

    def posterior(self, votes: tuple[int, ...]) -> float:
        odds = math.log(self.balance / (1 - self.balance))
        for clique, chance in zip(self.cliques, self.chances):
            clean, toxic = chance.get(tuple(votes[i] for i in clique), (1.0, 1.0))
            odds += math.log(toxic / clean)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def _fit(patterns: list[tuple[int, ...]], counts: np.ndarray, cliques: list[tuple[int, ...]], start: np.ndarray, rounds: int = 40) -> tuple[LabelModel, np.ndarray]:
    post = start
    values = [[tuple(p[i] for i in c) for p in patterns] for c in cliques]
    model = LabelModel(0.1, cliques, [])
    for _ in range(rounds):
        heavy = counts * post
        balance = float(np.clip(heavy.sum() / counts.sum(), 0.005, 0.5))
        chances = []
        for own in values:
            clean, toxic = Counter(), Counter()
            for v, c, h in zip(own, counts, heavy):
                clean[v] += c - h
                toxic[v] += h
            kinds, low, high = set(own), sum(clean.values()), sum(toxic.values())
            chances.append({v: ((clean[v] + 0.5) / (low + 0.5 * len(kinds)), (toxic[v] + 0.5) / (high + 0.5 * len(kinds))) for v in kinds})
        model = LabelModel(balance, cliques, chances)
        post = np.array([model.posterior(p) for p in patterns])
    return model, post


def label_model(patterns: dict[tuple[int, ...], int], limit: float = 0.15) -> LabelModel:
    """Fitted to counts of vote patterns; voters whose votes correlate beyond ``limit`` given the class share a clique."""
    keys = sorted(patterns)
    counts = np.array([patterns[k] for k in keys], float)
    n = len(keys[0]) if keys else len(VOTERS)
    single = [(i,) for i in range(n)]
    if not keys:
        return LabelModel(0.1, single, [{} for _ in single])
    start = np.array([0.9 if k.count(TOXIC) >= 1 and k[:3].count(TOXIC) else 0.05 for k in keys])
    _, post = _fit(keys, counts, single, start)
    votes = np.array(keys, float)
    parent = list(range(n))
    for side in (post, 1 - post):
        w = counts * side
        if w.sum() < 1:
            continue
        mean = (w[:, None] * votes).sum(0) / w.sum()
        away = votes - mean
        cov = (away * w[:, None]).T @ away / w.sum()
        dev = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / dev[:, None] / dev[None]
        for i in range(n):
            for j in range(i):
                if abs(corr[i, j]) > limit and dev[i] > 1e-3 and dev[j] > 1e-3:
                    parent[[k for k in range(n) if parent[k] == k and k == parent[i]][0]] = parent[j]
                    parent = [parent[parent[k]] for k in range(n)]
    for _ in range(n):
        parent = [parent[p] for p in parent]
    cliques = [tuple(i for i in range(n) if parent[i] == p) for p in sorted(set(parent))]
    return _fit(keys, counts, cliques, start)[0]


def _patterns(lexicon: Lexicon):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in slices(batches, 0):
            for text in blobs(b.column(0)):
                counts[bytes(lexicon.read(text)[0])] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["votes", "n"])

    return run


# --- the classifier ----------------------------------------------------------------------------------------------------


def _features(lexicon: Lexicon, text: bytes) -> tuple[tuple[int, ...], list[int], list[float]]:
    """Votes, and the places and values of what isn't 0: lexicon words, voters, their sum and density, the constant."""
    votes, hits, words = lexicon.read(text)
    at = list(hits)
    value = [1.0] * len(hits)
    base = lexicon.size
    for i, v in enumerate(votes):
        if v:
            at.append(base + i)
            value.append(1.0)
    at += [base + len(VOTERS), base + len(VOTERS) + 1, base + len(VOTERS) + 2]
    value += [math.log1p(len(hits)), min(5.0, 20.0 * len(hits) / (words + 20.0)), 1.0]
    return votes, at, value


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, text: bytes) -> float:
        _, at, value = _features(self.lexicon, text)
        z = float(self.weights[at] @ np.array(value))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on weighted soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ ((p - y) * weight) + ridge * w
        curve = (x * (p * (1 - p) * weight)[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(curve, grad)
    return w


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    train = training_rows(docs, labels)
    lexicon = mine(train)
    votes = docs.select(binary_text().alias("text")).mapInArrow(_patterns(lexicon), "votes binary, n long")
    patterns = {tuple(bytes(r.votes)): r.n for r in votes.groupBy("votes").agg(F.sum("n").alias("n")).collect()}  # at most 2^9 patterns
    labeller = label_model(patterns)

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            got = [_features(lexicon, t) for t in blobs(b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([labeller.posterior(v) for v, _, _ in got]), pa.array([a for _, a, _ in got], pa.list_(pa.int32())), pa.array([x for _, _, x in got], pa.list_(pa.float64())), b.column(2)], ["y", "at", "value", "weight"])

    found = train.mapInArrow(rows, "y double, at array<int>, value array<double>, weight long")
    # at most TRAIN_ROWS short rows; equal ones are summed and sorted, so the fit doesn't depend on the order of rows
    got = sorted(found.groupBy("y", "at", "value").agg(F.sum("weight").alias("weight")).collect())
    width = lexicon.size + len(VOTERS) + 3
    if not got:
        weights = np.zeros(width)
        weights[: lexicon.size], weights[-1] = 4.0, -2.0
        return Model(lexicon, weights)
    x, y, weight = np.zeros((len(got), width)), np.array([r.y for r in got]), np.array([r.weight / UNIT for r in got])
    for i, r in enumerate(got):
        x[i, r.at] = r.value
    return Model(lexicon, _train(x, y, weight))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Adds a score to every row; text and all other columns stay."""
    kept = [c for c in docs.columns if c != name]
    schema = docs.select(*kept).schema.add(name, "double")
    text = kept.index("text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            score = [model.score((t.as_py() or "").encode()) for t in b.column(text)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], [*kept, name])

    return docs.select(*kept).mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([model.score(t) for t in blobs(b.column(2))], pa.float64())], ["doc_id", "held_out", "score"])

    out = docs.select("doc_id", held_out().alias("held_out"), binary_text().alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    name = "_toxicity"
    while name in docs.columns:
        name = "_" + name
    return scored(docs, fit(docs, labels), name).filter(F.col(name) < 0.5).select(*docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
