"""Grouped prefix join: all pairs of documents whose sets of word shingles have Jaccard similarity of at least 0.8.

1. One scan gives each document's set size and a signature of its set; equal sets are a class.
2. A document that links with another shares at least 80 of 100 of its shingles with it, so one in which more than 20 of 100
   are found nowhere else links with nothing. Fingerprints of half the hash space, spread over buckets, count these for all
   documents (a lower bound, so no link is lost). A shingle repeated within a chunk of documents is sent once for the chunk,
   so a passage that a third of all documents share adds a few entries a chunk. The test runs again among classes only.
3. Shingles left are ordered by document frequency. Documents with the same size and prefix form a group; groups meet in a join
   on prefix shingles under the size and position filters.
4. Group pairs are verified by blocks: members are placed in blocks of bounded size by the component of the candidate graph, a task gets two
   blocks with the group pairs between them, expands these and counts intersections. It returns, per member, the weight of what
   it links with and the root of its part, never the pairs.

Defined cases: null, empty and white-space texts have an empty set and link with nothing. Texts below five words are one
shingle. Equal rows count once; a doc_id with different texts has a row for each, and so have null ids, which are no one document.
A component is named by its smallest doc_id, by null only where it holds no other id. An empty table gives no rows. Extra columns
are ignored by ``similar`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import binary_text, buffer_of, lean, materialize, table
from .components import components

WORDS = 5
#: Text bytes worked on at once, except for a longer document; fingerprints of a bucket and shingles of a block, on average.
CHUNK_BYTES, BUCKET_PRINTS, BLOCK_SHINGLES = 1_000_000, 1_500_000, 400_000
#: Part of the hash space in which the first test counts.
SPACE = 0.5
NULL_ID = -(2**63)

_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240607)
_LETTERS = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_PLACES = _RANDOM.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for a chunk are kept, a longer document's are not."""
    make = lambda size: [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b % 2**64, np.uint64), dtype=np.uint64)]) for b in (_BASE, pow(_BASE, -1, 2**64))]
    if not _POWERS:
        _POWERS[:] = make(CHUNK_BYTES + 1)
    up, down = _POWERS if n < len(_POWERS[0]) else make(n + 1)
    return up, down


def shingles(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (documents + 1) and the sorted distinct shingle hashes of each document."""
    docs = len(offsets) - 1
    if not len(data):
        return np.zeros(docs + 1, np.int64), np.empty(0, np.uint64)
    inside = ~_SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * up[: len(data)], dtype=np.uint64)])
    word = _mix((sums[last] - sums[first]) * down[first])
    owner = np.searchsorted(offsets, first, "right") - 1
    counts = np.bincount(owner, minlength=docs)
    begins = np.concatenate([[0], np.cumsum(counts)])
    sizes = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    h = np.empty(bounds[-1], np.uint64)
    if len(word) >= WORDS:
        n = len(word) - WORDS + 1
        five = sum(word[j : j + n] * _PLACES[j] for j in range(WORDS))
        long = np.flatnonzero(counts >= WORDS)
        at = np.repeat(begins[long] - bounds[long], sizes[long])
        to = np.repeat(counts >= WORDS, sizes)
        h[to] = five[np.flatnonzero(to) + at]
    for d in np.flatnonzero((counts > 0) & (counts < WORDS)):
        w = word[begins[d] : begins[d + 1]]
        h[bounds[d]] = (w * _PLACES[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))
    h = _mix(h)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[bounds[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return kept[bounds], h[fresh]


def signatures(bounds: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for k in (0x51ED270B9F3C4D17, 0xA24BAED4963EE407):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(h ^ np.uint64(k)), dtype=np.uint64)])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def _keys(ids: np.ndarray, s1: np.ndarray) -> np.ndarray:
    return _mix(s1.view(np.uint64) + ids.astype(np.int64).view(np.uint64) * np.uint64(_BASE)).view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of (doc_id, text) batches of about CHUNK_BYTES with their sets."""
    for batch in batches:
        off, data = buffer_of(batch.column(1))
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK_BYTES, "right")) - 1)
            yield batch.slice(lo, hi - lo), *shingles(off[lo : hi + 1] - off[lo], data[off[lo] : off[hi]])
            lo = hi


@lean
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, bounds, h in _chunks(batches):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        s1, s2 = signatures(bounds, h)
        yield pa.RecordBatch.from_pydict({"doc_id": ids, "txt": batch.column(2), "key": _keys(ids, s1), "s1": s1, "s2": s2, "n": np.diff(bounds)})


def _prints(keys: np.ndarray, bounds: np.ndarray, h: np.ndarray, buckets: int, space: float) -> pa.RecordBatch:
    owner = np.repeat(np.arange(len(keys)), np.diff(bounds))
    if space < 1:
        some = (h & np.uint64(0xFFFF)) < np.uint64(space * 65536)
        owner, h = owner[some], h[some]
    order = np.argsort(h, kind="stable")
    g = h[order]
    new = np.ones(len(g) + 1, bool)
    new[1:-1] = g[1:] != g[:-1]
    alone = np.zeros(len(h), bool)
    alone[order] = new[:-1] & new[1:]
    again = np.repeat(g[new[:-1] & ~new[1:]], 2)
    own, h, owner = np.concatenate([h[alone], again]), None, np.concatenate([owner[alone], np.full(len(again), -1)])
    bucket = ((own >> np.uint64(16)) & np.uint64(0xFFFFF)) % np.uint64(buckets)
    order = np.lexsort((owner, bucket))
    bucket, owner, prints = bucket[order], owner[order], (own[order] >> np.uint64(32)).astype("<u4")
    ends = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    rows: list[tuple[int, bytes, bytes, bytes]] = []
    for b, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        if i < j:
            who, count = np.unique(owner[i:j], return_counts=True)
            rows.append((b, np.where(who < 0, 0, keys[who]).astype("<i8").tobytes(), np.where(who < 0, -count, count).astype("<i4").tobytes(), prints[i:j].tobytes()))
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "keys", "counts", "prints"])


def _prints_of_texts(buckets: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds, h in _chunks(batches):
            yield _prints(_keys(batch.column(0).to_numpy(zero_copy_only=False), signatures(bounds, h)[0]), bounds, h, buckets, SPACE)

    return run


def _prints_of_sets(buckets: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                some = batch.slice(lo, 500)
                off = np.concatenate([[0], np.cumsum(some.column(1).value_lengths().to_numpy(zero_copy_only=False))])
                yield _prints(some.column(0).to_numpy(), off, some.column(1).flatten().to_numpy().view(np.uint64), buckets, 1.0)

    return run


def _alone(bucket, rows):
    """Fingerprints found once in the bucket, per document."""
    keys, counts, prints = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("keys", "<i8"), ("counts", "<i4"), ("prints", "<u4")))
    order = np.argsort(prints, kind="stable")
    g = prints[order]
    new = np.ones(len(g) + 1, bool)
    new[1:-1] = g[1:] != g[:-1]
    single = np.zeros(len(g), np.int64)
    single[order] = new[:-1] & new[1:]
    sums = np.concatenate([[0], np.cumsum(single)])
    ends = np.concatenate([[0], np.cumsum(np.abs(counts))])
    own = sums[ends[1:]] - sums[ends[:-1]]
    some = (own > 0) & (counts > 0)
    return pa.table({"key": keys[some], "u": own[some]})


def _single(prints: DataFrame) -> DataFrame:
    return prints.groupBy("bucket").applyInArrow(_alone, "key long, u long").groupBy("key").agg(F.sum("u").alias("u"))


_PRINTS = "bucket int, keys binary, counts binary, prints binary"


def _need(n1: Column, n2: Column) -> Column:
    """Least intersection of linked sets: 9 i >= 4 (n1 + n2)."""
    return F.ceil((n1 + n2) * 4 / F.lit(9.0))


@lean
def _reread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, key) -> (key, h) of the rows whose set has that key."""
    for batch, bounds, h in _chunks(batches):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        mine = _keys(ids, signatures(bounds, h)[0]) == batch.column(2).to_numpy()
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(2), lists], ["key", "h"]).filter(pa.array(mine))


def _verify(key, pairs, members):
    """Links between two blocks: per member the weight of its partners, and the root of its part."""
    node, place, w = (members.column(c).to_numpy() for c in ("node", "blk", "w"))
    lists = members.column("h").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    code = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    of: dict[tuple[int, int], list[int]] = {}
    for i, at in enumerate(zip(members.column("gid").to_pylist(), place.tolist())):
        of.setdefault(at, []).append(i)
    partners: dict[int, list[int]] = {}
    for g1, b1, g2, b2 in zip(*(pairs.column(c).to_pylist() for c in ("g1", "b1", "g2", "b2"))):
        left, right = of.get((g1, b1), ()), of.get((g2, b2), ())
        for x, i in enumerate(left):
            mine = right[x + 1 :] if (g1, b1) == (g2, b2) else right
            if mine:
                partners.setdefault(i, []).extend(mine)
    links, parent, mark = np.zeros(len(node), np.int64), list(range(len(node))), np.zeros(code.max(initial=0) + 1, bool)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, some in partners.items():
        own = code[ends[i] : ends[i + 1]]
        mark[own] = True
        js = np.array(some)
        js = js[9 * np.minimum(sizes[js], sizes[i]) >= 4 * (sizes[js] + sizes[i])]
        for lo in range(0, len(js), 256):
            part = js[lo : lo + 256]
            n = sizes[part]
            at = np.repeat(ends[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.add.reduceat(mark[code[at]].astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]]))
            hit = part[9 * both >= 4 * (n + sizes[i])]
            links[i] += w[hit].sum()
            links[hit] += w[i]
            for j in hit.tolist():
                a, b = root(i), root(j)
                if a != b:
                    low, high = (a, b) if node[a] < node[b] else (b, a)
                    parent[high] = low
        mark[own] = False
    some = np.flatnonzero(links)
    return pa.table({"node": node[some], "links": links[some], "root": node[[root(i) for i in some.tolist()]].astype(np.int64) if len(some) else np.empty(0, np.int64)})


def _linked(reps: DataFrame) -> DataFrame:
    """reps (node, w, n, h): classes that may link. -> (node, links, root), a row for each pair of blocks."""
    posts = reps.select("node", "n", F.explode("h").alias("x"))
    # counted before the join, so a passage's shingles are summed in every task and no task gets all documents that have one
    posts = posts.join(posts.groupBy("x").agg(F.count("*").alias("df")).filter("df > 1"), "x")
    within = W.partitionBy("node")
    posts = posts.withColumns({"r": F.count("*").over(within), "k": F.row_number().over(within.orderBy("df", "x"))})
    posts = posts.withColumns({"pos": F.col("n") - F.col("r") + F.col("k"), "own": F.col("n") - F.col("r")})
    prefix = posts.filter(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * 8 / F.lit(10.0)) + 1)
    prefix = prefix.groupBy("node", "n", "own").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("prefix"))
    # shingles of one's own come first in the order, so a prefix that holds any is no other document's
    prefix = prefix.withColumn("lone", F.when(F.col("own") > 0, F.col("node")))
    groups = prefix.groupBy("n", "prefix", "lone").agg(F.min("node").alias("gid"), F.count("*").alias("m"))
    groups = materialize(groups.select("gid", "n", "m", "prefix"), "groups")
    member_of = prefix.alias("p").join(groups.alias("g"), (F.col("p.n") == F.col("g.n")) & (F.col("p.prefix") == F.col("g.prefix")) & ((F.col("p.own") == 0) | (F.col("p.node") == F.col("g.gid")))).select("p.node", "g.gid")
    member_of = materialize(member_of, "members")
    index = groups.select("gid", "n", F.explode("prefix").alias("e")).select("gid", "n", "e.pos", "e.x")
    a, b = (index.select(*(F.col(c).alias(c + s) for c in ("gid", "n", "pos")), "x") for s in "12")
    need = _need(F.col("n1"), F.col("n2"))
    near = a.join(b, "x").filter((F.col("gid1") < F.col("gid2")) & (F.col("n1") * 10 >= F.col("n2") * 8) & (F.col("n2") * 10 >= F.col("n1") * 8))
    near = near.filter((F.col("n1") - F.col("pos1") + 1 >= need) & (F.col("n2") - F.col("pos2") + 1 >= need)).select("gid1", "gid2").distinct()
    own = groups.filter("m > 1").select(F.col("gid").alias("gid1"), F.col("gid").alias("gid2"))
    pairs = materialize(near.unionByName(own), "pairs")
    # blocks: all groups of a component of candidate pairs sit together, so only a component of several blocks is copied
    root = components(pairs.select(F.col("gid1").alias("u"), F.col("gid2").alias("v")))
    met = pairs.select(F.explode(F.array("gid1", "gid2")).alias("gid")).distinct()
    spot = met.join(root.withColumnRenamed("u", "gid"), "gid", "left").select("gid", F.coalesce("root", "gid").alias("c"))
    placed = member_of.join(spot, "gid").join(reps, "node")
    load = placed.groupBy("c").agg(F.sum("n").alias("load"))
    total = load.agg(F.sum("load")).first()[0] or 0
    blocks = max(1, total // BLOCK_SHINGLES)
    cut = F.pmod(F.xxhash64("node"), F.ceil(F.col("load") / F.lit(float(BLOCK_SHINGLES))))
    placed = materialize(placed.join(load, "c").select("node", "gid", "w", "h", F.pmod(F.xxhash64("c", cut), F.lit(blocks)).alias("blk")), "placed")
    at = placed.select("gid", "blk").distinct()
    p = pairs.join(at.select(F.col("gid").alias("gid1"), F.col("blk").alias("b1")), "gid1").join(at.select(F.col("gid").alias("gid2"), F.col("blk").alias("b2")), "gid2")
    p = p.filter("gid1 <> gid2 OR b1 <= b2").select(F.least("b1", "b2").alias("lo"), F.greatest("b1", "b2").alias("hi"), F.col("gid1").alias("g1"), "b1", F.col("gid2").alias("g2"), "b2")
    p = materialize(p, "tasks")
    tasks = p.select("lo", "hi").distinct()
    who = tasks.select("lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("blk"))
    held = who.join(placed, "blk").select(F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), "node", "gid", "w", "h", "blk")
    return p.groupBy("lo", "hi").cogroup(held.groupBy("lo_", "hi_")).applyInArrow(_verify, "node long, links long, root long")


def _text_hash() -> Column:
    return F.xxhash64(binary_text())


def _parts(docs: DataFrame) -> DataFrame:
    """A row for each doc_id (null as NULL_ID) and set: doc_id, txt (its least text hash), n, n_similar, first (the component's first document)."""
    texts = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), binary_text().alias("text"), _text_hash().alias("txt"))
    sets = texts.mapInArrow(_sets, "doc_id long, txt long, key long, s1 long, s2 long, n long")
    sets = materialize(sets.groupBy("doc_id", "key", "s1", "s2", "n").agg(F.min("txt").alias("txt")), "sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, int(total * SPACE) // BUCKET_PRINTS)
    single = _single(texts.select("doc_id", "text").mapInArrow(_prints_of_texts(buckets), _PRINTS))
    spare = F.floor(F.col("n") * 2 / F.lit(10.0))
    tested = sets.filter("n > 0").join(single, "key", "left").withColumn("may", F.coalesce("u", F.lit(0)) <= spare)
    # a class is the node of its first document's key, which the text tells apart from others of that doc_id
    who = F.struct((F.col("doc_id") == NULL_ID).alias("none"), "doc_id", "txt", "key")
    classes = tested.groupBy("s1", "s2", "n").agg(F.min(who).alias("rep"), F.count("*").alias("w"), F.max("may").alias("may"))
    classes = materialize(classes.select("s1", "s2", "n", "rep", F.col("rep.key").alias("node"), "w", "may"), "classes")
    chosen = classes.filter("may")
    reread = texts.join(chosen.select("rep.doc_id", "rep.txt", F.col("node").alias("key")), ["doc_id", "txt"]).select("doc_id", "text", "key")
    reps = materialize(reread.mapInArrow(_reread, "key long, h array<long>").join(chosen.select(F.col("node").alias("key"), "node", "w", "n"), "key").dropDuplicates(["key"]), "reps")
    buckets = max(1, (reps.agg(F.sum("n")).first()[0] or 0) // BUCKET_PRINTS)
    single = _single(reps.select("key", "h").mapInArrow(_prints_of_sets(buckets), _PRINTS))
    left = materialize(reps.join(single, "key", "left").filter(F.coalesce("u", F.lit(0)) <= spare).select("node", "w", "n", "h"), "left")
    links = materialize(_linked(left), "links")
    root = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    found = links.groupBy("node").agg(F.sum("links").alias("links")).join(root.withColumnRenamed("u", "node"), "node", "left")
    found = materialize(found.select("node", "links", F.coalesce("root", "node").alias("root")), "found")
    first = classes.join(found, "node").groupBy("root").agg(F.min("rep").alias("first"))
    found = found.join(first, "root").select("node", "links", "first")
    per_class = classes.join(found, "node", "left").select("s1", "s2", "n", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_similar"), F.coalesce("first", "rep").alias("first"))
    return sets.join(per_class, ["s1", "s2", "n"], "left").select("doc_id", "txt", "n", "n_similar", "first")


def similar(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, n_similar, component_id."""
    back = lambda c: F.when(c != NULL_ID, c)
    return _parts(docs).select(back(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).alias("n_similar"), back(F.coalesce("first.doc_id", "doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, its first document's; repeated rows of one document become one.

    Texts without words link with nothing: one row for each doc_id and text stays, and every row without an id.
    """
    own = docs.withColumns({"_id": F.coalesce("doc_id", F.lit(NULL_ID)), "_txt": _text_hash(), "_void": ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")})
    stay = _parts(docs).filter("n > 0").select("first.doc_id", "first.txt").distinct()
    full = own.filter("NOT _void").join(stay.toDF("_stay", "_text"), (F.col("_id") == F.col("_stay")) & (F.col("_txt") == F.col("_text")), "left_semi")
    void = own.filter("_void")
    some = full.unionByName(void.filter("doc_id IS NOT NULL")).dropDuplicates(["_id", "_txt"])
    return some.unionByName(void.filter("doc_id IS NULL")).select(*docs.columns)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * i >= 80 * (na + nb - i)),
c(a, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.a WHERE c.r < l.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, (SELECT count(*) FROM l WHERE l.a = s.doc_id)::BIGINT AS n_similar, (SELECT min(r) FROM c WHERE c.a = s.doc_id) AS component_id
FROM s
"""
