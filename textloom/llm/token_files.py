"""Token ids in files of a static range asymmetric numeral system (rANS).

One frequency table, counted over all documents, serves every file. A file holds blocks; a block codes up to BLOCK ids in
interleaved lanes (id i in lane i mod lanes) whose words share one stream, so a step codes or decodes all lanes at once. Each
block carries its checksum and, every CHECKPOINT steps, the lanes' states with the place in the stream: decoding can begin at
any checkpoint of any block, in parallel: a task decodes about READ_BLOCKS blocks. The end of a file indexes its blocks and documents.

Steps: documents are range-partitioned by doc_id and sorted; each task tokenizes its range into a raw segment in the shared
folder and counts ids; the counts give the table; each raw segment is then coded into a file. Tasks write files of their own
names and only those of finished tasks enter the manifest, so a task lost with its executor is simply run again.

Defined cases: null or empty text is the end id alone. Null doc_id comes first. Repeated rows are separate documents, in the
order of their text's hash. An empty table gives a manifest without files and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordpieces
from .common import binary_text, blobs, lean, materialize, remove_path, scratch_path, slices, table
from .packing import END_ID

SCALE = 20
LOW = np.uint64(1 << 31)
BLOCK, LANES, CHECKPOINT = 1 << 19, 1024, 256
#: Bytes of a generation of the word cache: documents come here in the order of ids, which keeps copies apart.
CACHE_BYTES = 96_000_000
#: Blocks that one task decodes, about.
READ_BLOCKS = 16
MAGIC = b"TLRANS01"
VOCABULARY_SIZE = 49408


# --- the coder -------------------------------------------------------------------------------------------------------


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE, at least 1 for each symbol that occurs; deterministic."""
    total, slots = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.uint32)
    used = np.flatnonzero(counts)
    free = slots - len(used)
    share = counts[used].astype(np.float64) * (free / total)
    freq = np.floor(share).astype(np.int64) + 1
    most = np.lexsort((used, -(share - np.floor(share))))
    freq[most[: slots - int(freq.sum())]] += 1
    out = np.zeros(len(counts), np.uint32)
    out[used] = freq
    return out


def lanes_of(n: int) -> int:
    """Lanes of a block of n ids."""
    return max(1, min(LANES, n // 64))


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.base = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = lanes_of(n)
        steps = -(-n // lanes)
        state = np.full(lanes, LOW, np.uint64)
        f_all, b_all = self.freq[ids], self.base[ids]
        limit = f_all << np.uint64(31 + 32 - SCALE)
        words: list[np.ndarray] = []
        points: list[tuple[int, np.ndarray]] = []
        written = 0
        for step in range(steps - 1, -1, -1):
            lo, hi = step * lanes, min(n, (step + 1) * lanes)
            x, f = state[: hi - lo], f_all[lo:hi]
            full = x >= limit[lo:hi]
            if full.any():
                out = x[full].astype(np.uint32)
                words.append(out)
                written += len(out)
                x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[: hi - lo] = (q << np.uint64(SCALE)) + (x - q * f) + b_all[lo:hi]
            if step % CHECKPOINT == 0:
                points.append((written, state.copy()))
        stream = np.concatenate(words[::-1]).astype("<u4") if words else np.empty(0, "<u4")
        points.reverse()
        head = struct.pack("<IIII", n, lanes, len(points), len(stream))
        marks = b"".join(struct.pack("<I", written - w) + s.astype("<u8").tobytes() for w, s in points)
        body = head + marks + stream.tobytes()
        return struct.pack("<II", zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body

    def decode(self, data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of a block, or those from checkpoint ``first`` up to checkpoint ``last``."""
        whole, ids_crc = struct.unpack_from("<II", data)
        if zlib.crc32(data[8:]) != whole:
            raise ValueError("a block's checksum is wrong")
        n, lanes, marks, words = struct.unpack_from("<IIII", data, 8)
        size = 4 + 8 * lanes
        at, state = 0, np.empty(0, np.uint64)
        if marks:
            at = struct.unpack_from("<I", data, 24 + first * size)[0]
            state = np.frombuffer(data, "<u8", lanes, 28 + first * size).astype(np.uint64)
        stream = np.frombuffer(data, "<u4", words, 24 + marks * size)
        begin, end = first * CHECKPOINT, -(-n // lanes) if last is None else min(last * CHECKPOINT, -(-n // lanes))
        out = np.empty(max(0, min(n, end * lanes) - begin * lanes), np.uint32)
        mask = np.uint64((1 << SCALE) - 1)
        for step in range(begin, end):
            lo, hi = step * lanes, min(n, (step + 1) * lanes)
            x = state[: hi - lo]
            slot = x & mask
            s = self.symbol[slot]
            x = self.freq[s] * (x >> np.uint64(SCALE)) + slot - self.base[s]
            low = np.flatnonzero(x < LOW)
            if len(low):
                x[low] = (x[low] << np.uint64(32)) | stream[at : at + len(low)]
                at += len(low)
            state[: hi - lo] = x
            out[lo - begin * lanes : hi - begin * lanes] = s
        if first == 0 and last is None and zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
            raise ValueError("decoded ids have another checksum")
        return out


# --- files -----------------------------------------------------------------------------------------------------------


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _create(path: str):
    fs, at = _fs(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(at)


def _read(path: str, start: int = 0, size: int | None = None) -> bytes:
    fs, at = _fs(path)
    with fs.open_input_file(at) as f:
        return f.read_at(f.size() - start if size is None else size, start)


def write_table(path: str, freq: np.ndarray) -> None:
    data = freq.astype("<u4").tobytes()
    with _create(path) as f:
        f.write(MAGIC + struct.pack("<II", zlib.crc32(data), len(freq)) + zlib.compress(data))


def read_table(path: str) -> np.ndarray:
    raw = _read(path)
    crc, _ = struct.unpack_from("<II", raw, 8)
    data = zlib.decompress(raw[16:])
    if raw[:8] != MAGIC or zlib.crc32(data) != crc:
        raise ValueError("not a frequency table")
    return np.frombuffer(data, "<u4")


class Writer:
    """Takes documents' ids in order and writes blocks as they fill."""

    def __init__(self, path: str, coder: Coder, start: int):
        self.file, self.coder, self.start = _create(path), coder, start
        self.file.write(MAGIC)
        self.at, self.held, self.waiting = len(MAGIC), 0, []
        self.blocks: list[tuple[int, int, int]] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.sizes.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            joined = np.concatenate(self.waiting)
            whole = len(joined) - len(joined) % BLOCK
            for i in range(0, whole, BLOCK):
                self._block(joined[i : i + BLOCK])
            self.waiting, self.held = [joined[whole:]], len(joined) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = self.coder.encode(ids)
        self.file.write(data)
        self.blocks.append((self.at, len(data), len(ids)))
        self.at += len(data)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        null = np.array([d is None for d in self.docs], np.uint8)
        docs = np.array([d or 0 for d in self.docs], "<i8")
        body = struct.pack("<QII", self.start, len(self.blocks), len(docs)) + np.array(self.blocks, "<u8").tobytes() + null.tobytes() + docs.tobytes() + np.array(self.sizes, "<u8").tobytes()
        packed = zlib.compress(body)
        self.file.write(packed + struct.pack("<II", len(packed), zlib.crc32(packed)) + MAGIC)
        self.file.close()


def read_index(path: str) -> tuple[int, np.ndarray, list[int | None], np.ndarray]:
    """Start, blocks (place, bytes, ids), document ids and sizes of a file."""
    fs, at = _fs(path)
    with fs.open_input_file(at) as f:
        size = f.size()
        n, crc = struct.unpack("<II", f.read_at(8, size - 16))
        packed = f.read_at(n, size - 16 - n)
    if zlib.crc32(packed) != crc:
        raise ValueError("a file's index is broken")
    body = zlib.decompress(packed)
    start, nb, nd = struct.unpack_from("<QII", body)
    blocks = np.frombuffer(body, "<u8", 3 * nb, 16).reshape(-1, 3)
    o = 16 + 24 * nb
    null, docs = np.frombuffer(body, np.uint8, nd, o), np.frombuffer(body, "<i8", nd, o + nd)
    return start, blocks, [None if z else int(d) for z, d in zip(null, docs)], np.frombuffer(body, "<u8", nd, o + 9 * nd)


def documents_of(path: str, coder: Coder, part: int = 0, parts: int = 1) -> Iterator[tuple[int | None, int, int, int]]:
    """(doc_id, start, ids, crc32) of the documents that begin in one of equal parts of a file's ids; decoding begins at the checkpoint before them."""
    at, blocks, docs, sizes = read_index(path)
    ends = np.cumsum(sizes.astype(np.int64))
    starts = ends - sizes.astype(np.int64)
    total = int(ends[-1]) if len(ends) else 0
    lo, hi = (int(np.searchsorted(starts, -(-total * p // parts))) if p < parts else len(docs) for p in (part, part + 1))
    if lo >= hi:
        return
    begins = np.concatenate([[0], np.cumsum(blocks[:, 2].astype(np.int64))])
    block = int(np.searchsorted(begins, starts[lo], "right")) - 1
    skip = int(starts[lo] - begins[block])
    first = skip // (CHECKPOINT * lanes_of(int(blocks[block, 2])))
    have = coder.decode(_read(path, int(blocks[block, 0]), int(blocks[block, 1])), first)
    have = have[skip - first * CHECKPOINT * lanes_of(int(blocks[block, 2])) :]
    for doc, start, size in zip(docs[lo:hi], starts[lo:hi].tolist(), sizes[lo:hi].tolist()):
        left, crc = size, 0
        while left:
            if not len(have):
                block += 1
                have = coder.decode(_read(path, int(blocks[block, 0]), int(blocks[block, 1])))
            crc = zlib.crc32(have[:left].astype("<u4").tobytes(), crc)
            took = min(left, len(have))
            have, left = have[took:], left - took
        yield doc, at + start, size, crc


# --- the job ---------------------------------------------------------------------------------------------------------

_MANIFEST = "part long, path string, n_docs long, n_tokens long, hist binary"


def _segments(folder: str, vocabulary: str):
    end = np.array([END_ID], "<u4").tobytes()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, part = wordpieces.words(vocabulary, CACHE_BYTES), TaskContext.get().partitionId()
        path, n_docs, n_tokens, hist, out = f"{folder}/{part}-{uuid.uuid4().hex}.raw", 0, 0, np.zeros(VOCABULARY_SIZE, np.int64), None
        for some in slices(batches, 1):
            ids = [wordpieces.encode(cache, t) + end for t in blobs(some.column(1))]
            flat = np.frombuffer(b"".join(ids), "<u4")
            if flat.max(initial=0) >= VOCABULARY_SIZE:
                raise ValueError(f"ids of {VOCABULARY_SIZE} and more have no place in these files")
            hist += np.bincount(flat, minlength=VOCABULARY_SIZE)
            chunk = pa.compress(flat.astype("<u2").tobytes(), codec="zstd", asbytes=True)
            docs = some.column(0).to_pylist()
            meta = json.dumps([docs, [len(x) // 4 for x in ids]]).encode()
            out = out or _create(path)
            out.write(struct.pack("<IIQ", len(meta), len(chunk), 2 * len(flat)) + meta + chunk)
            n_docs, n_tokens = n_docs + len(docs), n_tokens + len(flat)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [n_docs], "n_tokens": [n_tokens], "hist": [zlib.compress(hist.tobytes(), 1)]})

    return run


def _raw(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    fs, at = _fs(path)
    with fs.open_input_stream(at) as f:
        while head := f.read(16):
            m, c, n = struct.unpack("<IIQ", head)
            docs, sizes = json.loads(f.read(m))
            flat = np.frombuffer(pa.decompress(f.read(c), n, codec="zstd", asbytes=True), "<u2")
            ends = np.cumsum(sizes)
            for doc, e, s in zip(docs, ends.tolist(), sizes):
                yield doc, flat[e - s : e]


def _coded(folder: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for row in batch.to_pylist():
                coder = coder or Coder(read_table(f"{folder}/table.bin"))
                path = f"{folder}/part-{row['part']:06d}-{uuid.uuid4().hex}.rans"
                w = Writer(path, coder, row["start"])
                for doc, ids in _raw(row["path"]):
                    w.add(doc, ids)
                w.close()
                yield pa.RecordBatch.from_pydict({"part": [row["part"]], "path": [path], "n_blocks": [len(w.blocks)], "n_bytes": [w.at]})

    return run


def _decoded(folder: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for row in batch.to_pylist():
                coder = coder or Coder(read_table(f"{folder}/table.bin"))
                found = documents_of(row["path"], coder, row["part"], row["parts"])
                while rows := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def _spread(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A row in a task of its own."""
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), schema)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None) -> list[tuple[str, int, int]]:
    """Writes ``folder``: table.bin, part files, MANIFEST.json; the files with their starts and blocks in order of doc_id."""
    spark = docs.sparkSession
    raw = scratch_path(spark, "raw")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = docs.select("doc_id", binary_text().alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = text.repartitionByRange(n, *order).sortWithinPartitions(*order)
    done = materialize(ranged.mapInArrow(_segments(raw, vocabulary or wordpieces.vocabulary_path()), _MANIFEST), "segments")

    def total(key, t):
        hist = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in blobs(t.column("hist").combine_chunks()))
        return pa.table({"hist": [zlib.compress(hist.tobytes(), 1)]})

    parts = sorted(done.select("part", "path", "n_tokens").collect())  # one row a partition
    hists = done.groupBy(F.pmod("part", F.lit(16)).alias("g")).applyInArrow(total, "hist binary").collect()
    counts = sum((np.frombuffer(zlib.decompress(r[0]), np.int64) for r in hists), np.zeros(VOCABULARY_SIZE, np.int64))
    write_table(f"{folder}/table.bin", frequencies(counts))
    starts = np.concatenate([[0], np.cumsum([p[2] for p in parts])]).astype(int).tolist()
    files: list[tuple[str, int, int]] = []
    if parts:
        rows = [(p[0], p[1], s) for p, s in zip(parts, starts)]
        coded = _spread(spark, rows, "part long, path string, start long").mapInArrow(_coded(folder), "part long, path string, n_blocks long, n_bytes long").collect()
        found = {r["part"]: r for r in coded}
        files = [(found[p]["path"], s, found[p]["n_blocks"]) for p, _, s in rows]
    with _create(f"{folder}/MANIFEST.json") as f:
        f.write(json.dumps({"files": files, "tokens": starts[-1], "scale": SCALE}).encode())
    remove_path(spark, raw)
    return files


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files that the manifest names: doc_id, start, n_tokens, ids_crc32."""
    files = json.loads(_read(f"{folder}/MANIFEST.json"))["files"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    rows = [(path, i, n) for path, _, blocks in files for n in [max(1, -(-blocks // READ_BLOCKS))] for i in range(n)]
    return _spread(spark, rows, "path string, part long, parts long").mapInArrow(_decoded(folder), schema)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "rans")
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder)
