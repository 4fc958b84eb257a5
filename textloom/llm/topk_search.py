"""Exact top-k inner products of a query set against all vectors.

Vectors are sorted by descending length and rotated to their singular directions. A query's k-th best score over the HEAD
longest vectors is a floor for its result. Runs of candidates meet blocks of queries; a query skips a run when its length
times the run's largest is under the floor, and a pair when the partial product over the leading directions plus the product
of the remaining lengths (Cauchy-Schwarz) is. What is left is scored exactly in integers, and the k-th best of what a task has
found raises its floor for the shorter vectors that follow. Each task reads the query blocks one by one from the shared folder, so
memory holds one query block, one run of candidates and the floors of at most FLOORS queries (others begin from the head's floor).

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id. Shorter
vectors count as padded with zeros. Repeated query rows are answered once each; a candidate with the query's vec_id is its own
row and is left out. Ties go to the smaller vec_id. Components beyond 1e150 count as that, and a score outside a long is given as the
nearest long, ties by id. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, scratch_path, table
from .token_files import _fs
from .vectors import matrix, rotation, valid, width_of

SCALE = 256
HEAD, QUERY_ROWS, RUN_ROWS, FLOORS = 2048, 1024, 4096, 1 << 22
EXACT, MOST = 2.0**53, 1e150
LONG = (-(2**63), 2**63 - 1)


def _files(path: str) -> list[str]:
    import pyarrow.fs as pafs

    fs, at = _fs(path)
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted(f.path for f in found if f.path.endswith(".parquet"))


def _blocks(path: str, rows: int) -> Iterator[pa.RecordBatch]:
    fs, _ = _fs(path)
    for f in _files(path):
        with fs.open_input_file(f) as source:
            yield from pq.ParquetFile(source).iter_batches(rows)


def _dots(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, small: bool) -> np.ndarray:
    """Exact products of pairs of integer vectors."""
    if small:
        return np.concatenate([np.einsum("ij,ij->i", q[i[a : a + 65536]], c[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.empty(0)]).astype(np.int64)
    return np.array([min(LONG[1], max(LONG[0], sum(int(x) * int(y) for x, y in zip(q[a], c[b])))) for a, b in zip(i, j)], dtype=np.int64)


def _first(row: np.ndarray, cid: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row, rows in order."""
    order = np.lexsort((cid, -np.maximum(score, -LONG[1]), row))
    r = row[order]
    begin = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1]) if len(r) else np.empty(0, np.int64)
    place = np.arange(len(r)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(r)]]))) if len(r) else r
    return order[place < k]


def _raised(floor: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> None:
    """Lifts the floors of rows that have k scores, the last of which is the k-th best."""
    last = np.flatnonzero(np.bincount(row, minlength=len(floor)) == k)
    at = np.searchsorted(row, last, "right") - 1
    low = score[at].astype(np.float64)
    floor[last] = np.maximum(floor[last], np.where(np.abs(low) < EXACT, low, np.nextafter(low, -np.inf)))


class Side:
    """Vectors, their lengths, rotated leading parts and the lengths of the rest."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, turn: np.ndarray, lead: int):
        self.ids, self.m, self.norm = ids, m, np.linalg.norm(m, axis=1)
        turned = m @ turn
        self.lead, self.rest = turned[:, :lead], np.linalg.norm(turned[:, lead:], axis=1)

    def __len__(self) -> int:
        return len(self.ids)


def _best(q: Side, floor: np.ndarray, c: Side, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's best k among these candidates that aren't under its floor, which rises."""
    row, col, score = (np.empty(0, np.int64) for _ in range(3))
    for lo in range(0, len(c), 1024):
        part = slice(lo, lo + 1024)
        live = np.flatnonzero(q.norm * c.norm[part].max() * (1 + 1e-9) >= floor)
        if not len(live):
            continue
        bound = q.lead[live] @ c.lead[part].T + q.rest[live, None] * c.rest[part][None] + 1e-9 * q.norm[live, None] * c.norm[part][None]
        i, j = np.nonzero(np.maximum(bound, float(LONG[0])) >= floor[live, None])
        i, j = live[i], j + lo
        other = q.ids[i] != c.ids[j]
        i, j = i[other], j[other]
        s = _dots(q.m, c.m, i, j, q.norm.max() * c.norm.max() < EXACT)
        high = s >= floor[i]
        row, col, score = np.concatenate([row, i[high]]), np.concatenate([col, j[high]]), np.concatenate([score, s[high]])
        kept = _first(row, c.ids[col], score, k)
        row, col, score = row[kept], col[kept], score[kept]
        _raised(floor, row, score, k)
    return row, col, score


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding, is query) -> the integer vectors that take part, with their squared lengths."""
    for b in batches:
        v = b.column(1)
        fine = valid(v) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
        b = b.filter(pa.array(fine))
        v = b.column(1)
        flat = np.clip(np.floor(SCALE * np.clip(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64), -MOST, MOST)), -MOST, MOST)
        sizes = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
        sums = np.add.reduceat(np.concatenate([flat * flat, [0.0]]), sizes[:-1]) if len(b) else np.empty(0)
        sums = np.where(np.diff(sizes) > 0, sums, 0.0)
        ints = pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))
        yield pa.RecordBatch.from_arrays([b.column(0), ints, pa.array(sums, pa.float64()), b.column(2)], ["vec_id", "v", "square", "asks"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, lead: int = 16) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = materialize(given.mapInArrow(_scaled, "vec_id long, v array<double>, square double, asks boolean"), "vectors")
    width = width_of(rows, "v")
    if not width:
        return spark.createDataFrame([], schema)
    turn, lead = rotation(rows, "v", width), min(lead, width)
    queries, head = scratch_path(spark, "queries"), scratch_path(spark, "head")
    rows.orderBy(F.desc("square"), "vec_id").limit(HEAD).select("vec_id", "v").write.parquet(head)

    def side(ids: pa.Array, v: pa.Array) -> Side:
        return Side(ids.to_numpy(), matrix(v, width), turn, lead)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = None
        for b in batches:
            if tops is None:
                t = pa.Table.from_batches(list(_blocks(head, HEAD)))
                tops = side(t.column("vec_id"), t.column("v"))
            for lo in range(0, len(b), QUERY_ROWS):
                some = b.slice(lo, QUERY_ROWS)
                floor = np.full(len(some), -np.inf)
                _best(side(some.column(0), some.column(1)), floor, tops, k)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(floor)], ["vec_id", "v", "floor"])

    asked = rows.filter("asks").select("vec_id", "v").mapInArrow(floors, "vec_id long, v array<double>, floor double")
    asked.withColumn("q", F.monotonically_increasing_id()).write.parquet(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raised: dict[int, np.ndarray] = {}  # block of queries -> its floors
        for b in batches:
            for lo in range(0, len(b), RUN_ROWS):
                some = b.slice(lo, RUN_ROWS)
                run = side(some.column(0), some.column(1))
                for n, qs in enumerate(_blocks(queries, QUERY_ROWS)):
                    floor = raised.get(n, qs.column(2).to_numpy().copy())
                    if len(raised) * QUERY_ROWS < FLOORS:
                        raised[n] = floor
                    asking = side(qs.column(0), qs.column(1))
                    row, col, score = _best(asking, floor, run, k)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([qs.column(3).take(pa.array(row)), pa.array(asking.ids[row]), pa.array(run.ids[col]), pa.array(score)], ["q", "query_id", "vec_id", "score"])

    by_length = rows.select("vec_id", "v", "square").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.desc("square")).sortWithinPartitions(F.desc("square"))
    found = by_length.select("vec_id", "v").mapInArrow(search, "q long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
