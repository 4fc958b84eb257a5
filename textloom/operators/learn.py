"""Learning on token and pair features: a linear-chain conditional random field, and a linear support vector machine.

The field's features are hashed into WIDTH columns, so weights have a bounded size. A pass trains every partition from the same
weights and averages the results by their numbers of sentences; the driver holds the weights alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 1 << 16


def feature(name: str, value: Column) -> Column:
    """The number of name=value, null where the value is."""
    return F.when(value.isNotNull(), F.pmod(F.xxhash64(F.concat(F.lit(name + "="), value.cast("string"))), F.lit(WIDTH)).cast("int"))


def sentences(tokens: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    """tokens -> doc_id, sent_id, toks: each with its feature columns (hashed as name=value) and label, in order."""
    hashed = F.array_compact(F.array(*(feature(c, F.col(f"`{c}`")) for c in features)))
    row = F.struct("tok_id", hashed.alias("f"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"))
    return tokens.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(row)).alias("toks"))


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(unary: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log of the sum over all label sequences, marginals of labels and of neighbouring labels; of one sequence, or of many of one length (first axis)."""
    if unary.ndim == 2:
        total, one, two = forward_backward(unary[None], trans)
        return float(total[0]), one[0], two[0]
    m, n, k = unary.shape
    trans = np.broadcast_to(trans, (m, k, k))
    a, b = np.zeros((m, n, k)), np.zeros((m, n, k))
    a[:, 0] = unary[:, 0]
    for i in range(1, n):
        a[:, i] = unary[:, i] + _sum_exp(a[:, i - 1, :, None] + trans, 1)
    for i in range(n - 2, -1, -1):
        b[:, i] = _sum_exp(trans + (unary[:, i + 1] + b[:, i + 1])[:, None], 2)
    total = _sum_exp(a[:, -1], 1)
    pairs = np.exp(a[:, :-1, :, None] + trans[:, None] + (unary[:, 1:] + b[:, 1:])[:, :, None, :] - total[:, None, None, None])
    return total, np.exp(a + b - total[:, None, None]), pairs


def viterbi(unary: np.ndarray, trans: np.ndarray):
    """The best labels of one sequence as a list, or of many of one length (first axis) as an array."""
    if unary.ndim == 2:
        return viterbi(unary[None], trans)[0].tolist()
    m, n, _ = unary.shape
    best, back, path = unary[:, 0], [], np.zeros((m, n), np.int64)
    for i in range(1, n):
        s = best[:, :, None] + trans
        back.append(s.argmax(1))
        best = s.max(1) + unary[:, i]
    path[:, -1] = best.argmax(1)
    for i in range(n - 2, -1, -1):
        path[:, i] = back[i][np.arange(m), path[:, i + 1]]
    return path


class Crf:
    def __init__(self, labels: list[str], weights: np.ndarray | None = None, trans: np.ndarray | None = None):
        self.labels = labels
        self.w = np.zeros((WIDTH, len(labels)), np.float32) if weights is None else weights
        self.t = np.zeros((len(labels), len(labels)), np.float32) if trans is None else trans

    def tag(self, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """feats (sentences of one length, places, features; WIDTH is none) -> labels' numbers and their marginals."""
        unary = np.append(self.w, np.zeros((1, len(self.labels)), np.float32), 0)[feats].sum(2)
        path = viterbi(unary, self.t)
        return path, np.take_along_axis(forward_backward(unary, self.t)[1], path[:, :, None], 2)[:, :, 0]


class _Lanes:
    """Copies of the weights that are trained side by side, each on its own sentences one after the other; a step takes a sentence of one length in each."""

    def __init__(self, n: int, w: np.ndarray, t: np.ndarray):
        self.w, self.t, self.seen = np.repeat(np.append(w, np.zeros((1, w.shape[1]), np.float32), 0)[None], n, 0), np.repeat(t[None], n, 0), np.zeros(n)

    def step(self, feats: np.ndarray, gold: np.ndarray, rate: float) -> None:
        m, n, _ = feats.shape
        width, k = self.w.shape[1:]
        lane = np.arange(m)
        w = self.w.reshape(-1, k)
        at = feats + (lane * width)[:, None, None]
        _, one, two = forward_backward(w[at].sum(2), self.t[:m])
        grad = -one
        grad[lane[:, None], np.arange(n)[None], gold] += 1
        np.add.at(w, at, (rate * grad)[:, :, None, :])
        self.w[:m, -1] = 0
        self.t[:m] -= rate * two.sum(1)
        np.add.at(self.t, (lane[:, None], gold[:, :-1], gold[:, 1:]), rate)
        self.seen[:m] += 1

    def moved(self, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far all lanes have moved, summed by their numbers of sentences."""
        return sum((own[:-1] - w) * n for own, n in zip(self.w, self.seen)), sum((own - t) * n for own, n in zip(self.t, self.seen))


#: Sentences of a batch for each lane, and lanes at most: few sentences are trained on in one lane, in their order.
LANE, LANES = 512, 32


def _arrays(toks: pa.Array) -> tuple[np.ndarray, pa.StructArray, np.ndarray]:
    """Where sentences begin and end among the tokens, the tokens, and their features, filled up with WIDTH."""
    off = np.append(0, np.cumsum(pc.list_value_length(toks).to_numpy(zero_copy_only=False))).astype(np.int64)
    flat = toks.flatten()
    sizes = pc.list_value_length(flat.field("f")).to_numpy(zero_copy_only=False).astype(np.int64)
    feats = np.full((len(sizes), max(1, sizes.max(initial=0))), WIDTH, np.int64)
    feats[np.arange(feats.shape[1])[None] < sizes[:, None]] = flat.field("f").flatten().to_numpy(zero_copy_only=False)
    return off, flat, feats


def _alike(off: np.ndarray, most: int) -> list[np.ndarray]:
    """Sentences by their lengths, ``most`` at once."""
    sizes = np.diff(off)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    runs = np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []
    return [run[i : i + most] for run in runs for i in range(0, len(run), most)]


def train_crf(rows: DataFrame, passes: int = 5, rate: float = 0.2) -> Crf:
    """rows of ``sentences`` with labels. The labels are few; weights of all passes have WIDTH x labels numbers."""
    labels = sorted(r[0] for r in rows.select(F.explode(F.array_distinct("toks.label")).alias("l")).distinct().collect())
    model = Crf(labels)
    for n in range(passes):
        w, t, step = model.w, model.t, rate / (1 + n)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lanes = None
            for b in batches:
                off, flat, feats = _arrays(b.column(0))
                gold = pc.index_in(flat.field("label"), pa.array(labels, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
                lanes = lanes or _Lanes(max(1, min(LANES, len(b) // LANE)), w, t)
                count = len(lanes.seen)
                steps = _alike(off, count) if count > 1 else [np.array([i]) for i in np.flatnonzero(np.diff(off))]
                if count > 1:
                    np.random.default_rng(17).shuffle(steps)
                for some in steps:
                    at = off[some][:, None] + np.arange(off[some[0] + 1] - off[some[0]])[None]
                    lanes.step(feats[at], gold[at], step)
            if lanes is not None and lanes.seen.sum():
                away, turned = lanes.moved(w, t)
                used = np.flatnonzero(away.any(1))
                yield pa.RecordBatch.from_pydict({"at": pa.array([*used.tolist(), -1], pa.int32()), "d": pa.array([*away[used].astype(float).tolist(), [*turned.astype(float).ravel().tolist(), float(lanes.seen.sum())]], pa.list_(pa.float64()))})

        moved = rows.select("toks").mapInArrow(run, "at int, d array<double>")
        sums = moved.select("at", F.posexplode("d").alias("k", "x")).groupBy("at", "k").agg(F.sum("x").alias("x")).groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("d")).collect()
        got = {r["at"]: np.array(r["d"]) for r in sums}
        if -1 not in got:
            break
        seen = got[-1][-1]
        w2, t2 = w.copy(), t + got.pop(-1)[:-1].reshape(t.shape) / seen
        for at, d in got.items():
            w2[at] += d / seen
        model = Crf(labels, w2, t2.astype(np.float32))
    return model


def tag_crf(rows: DataFrame, model: Crf) -> DataFrame:
    """rows of ``sentences`` -> doc_id, sent_id, tok_id, label, confidence (the label's marginal)."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(model.labels, pa.string())
        for b in batches:
            off, flat, feats = _arrays(b.column(2))
            label, sure = np.zeros(off[-1], np.int64), np.zeros(off[-1])
            for some in _alike(off, 512):
                at = off[some][:, None] + np.arange(off[some[0] + 1] - off[some[0]])[None]
                label[at], sure[at] = model.tag(feats[at])
            row = pa.array(np.repeat(np.arange(len(b)), np.diff(off)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), flat.field("tok_id").cast(pa.int32()), names.take(pa.array(label)), pa.array(sure)], ["doc_id", "sent_id", "tok_id", "label", "confidence"])

    return rows.select("doc_id", "sent_id", "toks").mapInArrow(run, f"doc_id {kinds['doc_id']}, sent_id {kinds['sent_id']}, tok_id int, label string, confidence double")


# --- pairs ----------------------------------------------------------------------------------------------------------------


def vectors(features: DataFrame, vocabulary: DataFrame, size: int) -> DataFrame:
    """features (doc_id, ent_id1, ent_id2, name, value), vocabulary (name, f_index) -> a sparse vector a pair. Names that aren't listed are left out."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    made = F.udf(lambda xs: SparseVector(size, sorted({x["f_index"]: x["value"] for x in xs}.items())), VectorUDT())
    j = features.join(vocabulary, "name")
    return j.groupBy("doc_id", "ent_id1", "ent_id2").agg(made(F.collect_list(F.struct(F.col("f_index").cast("int").alias("f_index"), F.col("value").cast("double").alias("value")))).alias("raw"))


class Svm:
    """A linear machine on pairs' vectors scaled by each feature's largest absolute value; ``steps`` replace that scaling."""

    def __init__(self, steps: list | None = None, threshold: float = 0.0, **parameters):
        self.steps, self.threshold, self.parameters, self.model = steps, threshold, {"maxIter": 50, "regParam": 0.01, **parameters}, None

    def train(self, rows: DataFrame) -> Svm:
        """rows (raw, real_target: 1 or -1)."""
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LinearSVC
        from pyspark.ml.feature import MaxAbsScaler

        steps = self.steps if self.steps is not None else [MaxAbsScaler(inputCol="raw", outputCol="features")]
        self.model = Pipeline(stages=[*steps, LinearSVC(**self.parameters)]).fit(rows.withColumn("label", (F.col("real_target") > 0).cast("double")))
        return self

    def annotate(self, rows: DataFrame) -> DataFrame:
        """Adds pred_target: 1 above the threshold, else -1."""
        from pyspark.ml.functions import vector_to_array

        got = self.model.transform(rows)
        margin = F.get(vector_to_array("rawPrediction"), F.lit(1))
        return got.withColumn("pred_target", F.when(margin > self.threshold, 1).otherwise(-1)).select(*rows.columns, "pred_target")


def undersampled(rows: DataFrame, seed: int = 17) -> DataFrame:
    """As many rows of the larger class as the smaller has, by a seeded order; exact by counts in ranges of the order."""
    from pyspark.sql.window import Window as W

    own = rows.withColumn("_h", F.pmod(F.xxhash64("doc_id", "ent_id1", "ent_id2", F.lit(seed)), F.lit(1 << 32)))
    own = own.withColumn("_r", F.floor(F.col("_h") / (1 << 20)))
    cells = own.groupBy("real_target", "_r").agg(F.count("*").alias("n"))
    least = F.broadcast(cells.groupBy("real_target").agg(F.sum("n").alias("m")).agg(F.min("m").alias("least")))
    before = F.coalesce(F.sum("n").over(W.partitionBy("real_target").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = cells.withColumn("_before", before).crossJoin(least).select("real_target", "_r", (F.col("least") - F.col("_before")).alias("_left")).filter("_left > 0")
    k = F.row_number().over(W.partitionBy("real_target", "_r").orderBy("_h", "doc_id", "ent_id1", "ent_id2"))
    return own.join(left, ["real_target", "_r"]).withColumn("_k", k).filter("_k <= _left").select(*rows.columns)
