"""Packing of documents into sequences of at most 2048 tokens: first-fit decreasing over a tournament tree of bins.

A document's ids are those of the vocabulary plus the end id. Its full stretches of ``capacity`` ids are sequences of their
own, made where the document is read; only the rest of less than ``capacity`` ids is packed. Rests go to randomised groups of
about ``group_rows`` documents, and each group is packed alone by first-fit decreasing: the tree holds the largest remaining
capacity of each half of the bins, so the first bin that fits is found by one walk from the root. Texts are read once; their
pieces (document, start, length, checksum) are written to the shared folder, and only those of rests are shuffled.

Defined cases: null or empty text is the end id alone. Null doc_id is kept as null. Repeated rows are separate documents.
Ties in length go by doc_id, then start, then checksum. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordpieces
from .common import binary_text, blobs, lean, materialize, slices, table

CAPACITY = 2048
END_ID = 1
#: Rests in a randomised group, on average.
GROUP_ROWS = 40_000
#: Sequences of rests have a group's number times this, plus their own; those of full stretches have SOLO plus.
SPAN = 1 << 24
SOLO = 1 << 56

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def first_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the order given, each in the first bin that still has room."""
    n = len(lengths)
    leaves = 1
    while leaves < max(1, n):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, need in enumerate(lengths.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < need:
                at += 1
        bins[i] = at - leaves
        offsets[i] = capacity - tree[at]
        tree[at] -= need
        at //= 2
        while at:
            best = tree[2 * at] if tree[2 * at] >= tree[2 * at + 1] else tree[2 * at + 1]
            if tree[at] == best:
                break
            tree[at] = best
            at //= 2
    return bins, offsets


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    bins[order], offsets[order] = first_fit(lengths[order], capacity)
    return bins, offsets


def _cut(capacity: int, vocabulary: str):
    end = np.array([END_ID], "<u4").tobytes()
    mix = 0x9E3779B97F4A7C15

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache = wordpieces.words(vocabulary)
        task, seen, solo = TaskContext.get().partitionId(), 0, 0
        for some in slices(batches, 1):
            rows = []
            for doc, text in zip(some.column(0).to_pylist(), blobs(some.column(1))):
                ids = wordpieces.encode(cache, text) + end
                total = len(ids) // 4
                full = total - total % capacity
                for start in range(0, full, capacity):
                    rows.append((doc, start, capacity, zlib.crc32(ids[4 * start : 4 * (start + capacity)]), total, None, SOLO + (task << 32) + solo))
                    solo += 1
                if full < total:
                    seen += 1
                    mixed = ((((doc or 0) * mix) & (2**64 - 1)) ^ (seen * 0xC2B2AE3D27D4EB4F + task * 0x165667B19E3779F9)) & (2**64 - 1)
                    mixed = ((mixed ^ (mixed >> 29)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
                    rows.append((doc, full, total - full, zlib.crc32(ids[4 * full :]), total, mixed >> 32, None))
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "draw", "sequence_id"])

    return run


def _pack(capacity: int):
    def run(key, pieces):
        pieces = pieces.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(pieces.column("length").to_numpy(), capacity)
        return pieces.drop_columns(["grp"]).append_column("sequence_id", pa.array(bins + key[0].as_py() * SPAN)).append_column("offset", pa.array(offsets))

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = vocabulary or wordpieces.vocabulary_path()
    cut = docs.select("doc_id", binary_text().alias("text")).mapInArrow(_cut(capacity, path), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, draw long, sequence_id long")
    cut = materialize(cut, "pieces")  # texts are read once; what is written has no text
    plain = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = cut.filter("sequence_id IS NOT NULL").select(*plain, "sequence_id", F.lit(0).cast("long").alias("offset"))
    rests = cut.filter("sequence_id IS NULL")
    groups = max(1, round(rests.count() / group_rows))
    packed = rests.select(*plain, F.pmod("draw", F.lit(groups)).alias("grp")).groupBy("grp").applyInArrow(_pack(capacity), PIECES)
    return full.unionByName(packed)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
