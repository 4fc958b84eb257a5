"""Near copies among vectors of one label by an epsilon grid order join.

Cosine of at least 0.98 between unit vectors is a distance of at most eps = sqrt(0.04). Vectors are rotated to their principal
dimensions, sorted by the grid cells (of width eps) of the leading ones, and cut into intervals with bounding boxes. The sequence
of a label's intervals is joined with itself recursively: joins of small tables of boxes go down a tree of intervals, FAN at a
time, and skip pairs further apart than eps; a task then gets two intervals of vectors once and halves them down to pairs of
blocks. It returns, per vector, the weight of its links and the root of its part, never the pairs. Equal vectors of a label are one
class beforehand, so copies are never compared with each other.

Defined cases: null, zero and empty vectors and those with null or non-finite components link with nothing, nor do those
without label. Vectors of another size count as padded with zeros. Repeated rows are classed by vector; each keeps its row, and so
does a vec_id with different vectors. A component is named by its smallest vec_id, by null only where it holds no other, and then all
its rows are kept. Components of any finite size are scaled by a vector's largest one. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .components import components
from .vectors import list_column, matrix, rotation, unit, valid, width_of

COSINE = 0.98
LEADING, BLOCK_ROWS = 6, 256
#: Bytes of an interval's vectors; a label's intervals that are paired without a tree, and nodes of a tree under one.
INTERVAL_BYTES, TOP, FAN = 2_000_000, 64, 16
#: Products this near the limit are computed again with all digits.
NEAR = 1e-10


def _boxes_far(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], eps: float) -> bool:
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float(gap @ gap) > eps * eps


def _tree(lo: np.ndarray, hi: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    size = 1
    while size < max(1, len(lo)):
        size *= 2
    low, high = np.full((2 * size, lo.shape[1]), np.inf), np.full((2 * size, lo.shape[1]), -np.inf)
    low[size : size + len(lo)], high[size : size + len(hi)] = lo, hi
    for i in range(size - 1, 0, -1):
        low[i], high[i] = np.minimum(low[2 * i], low[2 * i + 1]), np.maximum(high[2 * i], high[2 * i + 1])
    return size, low, high


def interval_pairs(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray] | None, eps: float) -> Iterator[tuple[int, int]]:
    """Pairs of blocks (boxes lo, hi, in grid order) that may hold points within eps: halves intervals, skips distant ones. Of one with itself: i <= j."""
    n, low, high = _tree(*one)
    m, low2, high2 = (n, low, high) if two is None else _tree(*two)
    todo = [(1, 1)]
    while todo:
        a, b = todo.pop()
        same = two is None and a == b
        if low[a, 0] > high[a, 0] or low2[b, 0] > high2[b, 0] or (not same and _boxes_far((low[a], high[a]), (low2[b], high2[b]), eps)):
            continue
        if a >= n and b >= m:
            yield a - n, b - m
        elif same:
            todo += [(2 * a, 2 * a), (2 * a, 2 * a + 1), (2 * a + 1, 2 * a + 1)]
        else:
            todo += [(x, y) for x in ((a,) if a >= n else (2 * a, 2 * a + 1)) for y in ((b,) if b >= m else (2 * b, 2 * b + 1))]


def _links(m: np.ndarray, o: np.ndarray, limit: float) -> np.ndarray:
    cos = m @ o.T
    hit = cos >= limit
    for i, j in zip(*np.nonzero(np.abs(cos - limit) < NEAR)):
        hit[i, j] = float(np.dot(m[i].astype(np.longdouble), o[j].astype(np.longdouble))) >= limit
    return hit


def _meet(m: np.ndarray, n1: np.ndarray, w1: np.ndarray, o: np.ndarray, n2: np.ndarray, w2: np.ndarray, limit: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(node, links, root) of the vectors of two blocks that link."""
    hit = _links(m, o, limit)
    if same:
        np.fill_diagonal(hit, False)
    if not hit.any():
        return None
    least1, least2 = n1.copy(), n2.copy()
    while True:  # spread the smallest node along the links of this pair of blocks
        a = np.minimum(least1, np.where(hit, least2[None], np.iinfo(np.int64).max).min(1))
        b = np.minimum(least2, np.where(hit, a[:, None], np.iinfo(np.int64).max).min(0))
        if (a == least1).all() and (b == least2).all():
            break
        least1, least2 = a, b
    i, j = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    parts = [(n1[i], (hit @ w2)[i], least1[i])] + ([] if same else [(n2[j], (w1 @ hit)[j], least2[j])])
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*parts))


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds whether the vector of column 1 and the label of column 2 take part."""
    for b in batches:
        v = b.column(1)
        able = valid(v) & b.column(2).is_valid().to_numpy(zero_copy_only=False)
        size = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.concatenate([[0], np.cumsum(v.flatten().fill_null(0).to_numpy(zero_copy_only=False) != 0)])
        ends = np.cumsum(size)
        able &= flat[ends] > flat[ends - size]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(able)], [*b.schema.names, "able"])


def _joined_pairs(boxes: DataFrame, dims: int, eps: float) -> DataFrame:
    """boxes (label, pos, lo, hi), pos dense in grid order -> (a, b), a <= b, of one label's intervals within eps."""
    near = lambda c: sum((F.pow(F.greatest(F.lit(0.0), F.col(f"{c}1.lo")[d] - F.col(f"{c}2.hi")[d], F.col(f"{c}2.lo")[d] - F.col(f"{c}1.hi")[d]), F.lit(2.0)) for d in range(dims)), F.lit(0.0)) <= eps * eps
    levels = [boxes]
    while (levels[-1].groupBy("label").count().agg(F.max("count")).first()[0] or 0) > TOP:
        ends = [F.array(*(f(F.col(c)[d]) for d in range(dims))).alias(c) for c, f in (("lo", F.min), ("hi", F.max))]
        levels.append(materialize(levels[-1].groupBy("label", F.floor(F.col("pos") / FAN).cast("long").alias("pos")).agg(*ends), "level"))
    side = lambda t, s: t.select("label", F.struct("pos", "lo", "hi").alias(s))
    top = levels.pop()
    pairs = side(top, "n1").join(side(top, "n2"), "label").filter((F.col("n1.pos") <= F.col("n2.pos")) & near("n")).select("label", F.col("n1.pos").alias("a"), F.col("n2.pos").alias("b"))
    while levels:
        below = levels.pop()
        under = lambda c: F.explode(F.sequence(F.col(c) * FAN, F.col(c) * FAN + FAN - 1))
        pairs = materialize(pairs, "pairs").withColumn("a", under("a")).withColumn("b", under("b")).filter("a <= b")
        node = lambda s, c: below.select("label", F.col("pos").alias(c), F.struct("pos", "lo", "hi").alias(s))
        pairs = pairs.join(node("n1", "a"), ["label", "a"]).join(node("n2", "b"), ["label", "b"]).filter(near("n")).select("label", "a", "b")
    return pairs.select("a", "b")


def near_copies(vectors: DataFrame, limit: float = COSINE) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, n_links, component_id, kept."""
    eps = float(np.sqrt(2 - 2 * limit)) * (1 + 1e-9)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), "label")
    rows = rows.mapInArrow(_usable, ", ".join(f"{name} {kind}" for name, kind in rows.dtypes) + ", able boolean")
    able = rows.filter("able").drop("able")
    # a node is a class of equal vectors of a label, whatever ids its rows have
    grouped = able.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("w"))
    classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    width = width_of(classes, "v")
    alone = lambda t: t.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not width:
        return alone(rows)
    turn = rotation(classes, "v", width, unit)[:, : min(LEADING, width)]
    dims, kinds = turn.shape[1], dict(classes.dtypes)
    single = kinds["v"] == "array<float>"
    most = max(BLOCK_ROWS, INTERVAL_BYTES // ((4 if single else 8) * width))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.floor(unit(matrix(b.column(1), width)) @ turn / eps).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, list_column(at)], [*b.schema.names, "cell"])

    spread = classes.select("label", "v", "node", "w").mapInArrow(cells, f"label {kinds['label']}, v {kinds['v']}, node long, w long, cell array<long>")
    n = int(spread.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = spread.repartitionByRange(n, "label", "cell", "node").sortWithinPartitions("label", "cell", "node")

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        for b in batches:
            label = b.column(0)
            change = [0, *(np.flatnonzero(np.array(label[1:].to_pylist(), object) != np.array(label[:-1].to_pylist(), object)) + 1).tolist(), len(b)] if len(b) else []
            for i, j in zip(change, change[1:]):
                for lo in range(i, j, most):
                    part = b.slice(lo, min(most, j - lo))
                    m = matrix(part.column(1), width)
                    lead = unit(m) @ turn
                    data = (part.column(2).to_numpy(), part.column(3).to_numpy(), m.astype("<f4") if single else m)
                    yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([k]), part.column(0).slice(0, 1), list_column(lead.min(0)[None]), list_column(lead.max(0)[None]), *(pa.array([x.tobytes()]) for x in data)], ["task", "k", "label", "lo", "hi", "nodes", "ws", "data"])
                    k += 1

    cut = materialize(ordered.mapInArrow(intervals, f"task long, k long, label {kinds['label']}, lo array<double>, hi array<double>, nodes binary, ws binary, data binary"), "intervals")
    sizes = sorted(cut.groupBy("task").count().collect())  # a row a task
    starts, at = [], 0
    for task, count in sizes:
        starts.append((task, at))
        at += count
    start = cut.sparkSession.createDataFrame(starts, "task long, start long")
    placed = cut.join(F.broadcast(start), "task").withColumn("pos", F.col("start") + F.col("k"))
    pairs = _joined_pairs(placed.select("label", "pos", "lo", "hi"), dims, eps)
    side = lambda s: placed.select(*(F.col(c).alias(c + s) for c in ("pos", "nodes", "ws", "data")))
    both = pairs.repartition(n, "a", "b").join(side("1"), F.col("a") == F.col("pos1")).join(side("2"), F.col("b") == F.col("pos2")).select("a", "b", "nodes1", "ws1", "data1", "nodes2", "ws2", "data2")

    def opened(row: dict, s: str) -> tuple:
        m = unit(np.frombuffer(row["data" + s], "<f4" if single else "<f8").astype(np.float64).reshape(-1, width))
        lead = m @ turn
        begin = np.arange(0, len(m), BLOCK_ROWS)
        return m, np.frombuffer(row["nodes" + s], np.int64), np.frombuffer(row["ws" + s], np.int64), (np.minimum.reduceat(lead, begin), np.maximum.reduceat(lead, begin))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                same = row["a"] == row["b"]
                one = opened(row, "1")
                two = one if same else opened(row, "2")
                out = []
                for x, y in interval_pairs(one[3], None if same else two[3], eps):
                    p, q = slice(x * BLOCK_ROWS, (x + 1) * BLOCK_ROWS), slice(y * BLOCK_ROWS, (y + 1) * BLOCK_ROWS)
                    got = _meet(one[0][p], one[1][p], one[2][p], two[0][q], two[1][q], two[2][q], limit, same and x == y)
                    if got is not None:
                        out.append(got)
                    if len(out) >= 1024:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["node", "links", "root"])
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["node", "links", "root"])

    links = materialize(both.mapInArrow(compare, "node long, links long, root long"), "links")
    root = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    found = links.groupBy("node").agg(F.sum("links").alias("links")).join(root.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = materialize(found, "found")
    named = classes.select("node", "least").join(found, "node").groupBy("root").agg(F.min("least").alias("first"))
    found = found.join(named, "root").select("node", "links", "first")
    per_class = classes.join(found, "node", "left").select("label", "v", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(F.col("links").isNull(), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    out = able.join(per_class, ["label", "v"]).select("vec_id", "n_links", "component_id")
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.withColumn("kept", kept).unionByName(alone(rows.filter("NOT able")))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
c(a, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.a WHERE c.r < l.b),
r AS (SELECT a, min(r) AS r FROM c GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, r.r AS component_id, e.vec_id = r.r AS kept
FROM embeddings e JOIN r ON r.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
