"""Substring dedup: remove words inside 13-word windows that also start in a document with a smaller id.

Every window becomes a 64-bit hash. A window belongs to the bucket of its smallest hash of three
words in a row, so equal windows meet in one bucket and neighbours mostly travel together. Within a
block of documents repeated windows are settled at once and only the first document's windows
travel, so a passage that a third of all documents share reaches its bucket once a block. A bucket
sorts its hashes; those of a later document than the first go back to it as spans of window starts, gathered
once more so that a document gets one row. Windows settled in their block are spread by document and
pass the buckets packed. Three words that a sample shows to draw many windows do not hold them
together: these windows go by their own hash, which equal windows share as well.

Buckets grow in number with the corpus, so none outgrows a task; a block then sends each at least one
window, some 60 bytes. Windows are equal if their 64-bit hashes and their buckets are, so bits are
added as buckets are: about 87 at 100 TB, where two different windows of 10^13 are expected to agree.

Suffix automata of reference shards would have to meet every document in turn, so their work grows
with the square of the corpus; see the README for figures. Buckets give the same removals.

Defined cases: a null or empty text has no words; a text of fewer words than a window keeps all; a
null id removes nothing and is no reference; rows of one id never remove each other's words, and all
lose the same ones; ids that are not whole numbers go by their order; an empty table gives no rows; a column with the name of a result is replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argosy.llm.common import kept, row, unpacked
from argosy.llm.wordhash import chunks, mix
from argosy.session import with_checkpoint_dir

WINDOW = 13
ANCHOR = 3
BUCKET_BYTES = 8_000_000
BLOCK_WORDS = 1_000_000
SAMPLE_BYTES = 16_000_000
#: An anchor of so many windows (a quarter of the windows of a bucket) is heavy.
HEAVY_WINDOWS = 500_000


def _pack(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def _unpack(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def pack_starts(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """Window starts of documents, both in order: runs of neighbours as (id, first, length)."""
    cut = np.flatnonzero((ids[1:] != ids[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    at = np.concatenate([[0], cut])
    size = np.diff(np.concatenate([at, [len(ids)]]))
    step = np.diff(ids[at], prepend=0)
    return _pack(struct.pack("<q", len(at)) + step.astype("<i8").tobytes() + starts[at].astype("<u4").tobytes() + size.astype("<u4").tobytes())


def unpack_starts(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = _unpack(x)
    (n,) = struct.unpack_from("<q", raw)
    ids = np.cumsum(np.frombuffer(raw, "<i8", n, 8))
    first = np.frombuffer(raw, "<u4", n, 8 + 8 * n).astype(np.int64)
    size = np.frombuffer(raw, "<u4", n, 8 + 12 * n).astype(np.int64)
    back = np.repeat(np.cumsum(size) - size, size)
    return np.repeat(ids, size), np.repeat(first, size) + np.arange(len(back)) - back


def later_windows(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which windows also start in a document with a smaller id."""
    by = np.lexsort((ids, hashes))
    h, d = hashes[by], ids[by]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else d
    out = np.zeros(len(h), bool)
    out[by] = d > least
    return out


def block_windows(batch: pa.RecordBatch, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(id, start, hash, anchor) of every window, by id and start, for blocks of documents of some BLOCK_WORDS words."""
    ids = batch.column("_id")
    known = np.array(ids.is_valid())
    ids = np.array(ids.fill_null(0), np.int64)
    k = min(ANCHOR, window)
    parts: list[tuple] = []

    def joined() -> tuple[np.ndarray, ...]:
        out = [np.concatenate([p[i] for p in parts]) for i in range(4)]
        if (np.diff(out[0]) < 0).any():
            by = np.argsort(out[0], kind="stable")
            out = [x[by] for x in out]
        parts.clear()
        return tuple(out)

    size = 0
    for a, b, words in chunks(batch.column("_t")):
        runs, small = words.runs(window), words.runs(k)
        anchor = small[: len(runs)].copy()
        for i in range(1, window - k + 1):
            np.minimum(anchor, small[i : i + len(runs)], out=anchor)
        first = words.first
        count = np.where(known[a:b], np.maximum(np.diff(first) - window + 1, 0), 0)
        start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = np.repeat(first[:-1], count) + start
        parts.append((np.repeat(ids[a:b], count), start, runs[place], anchor[place]))
        size += len(place)
        if size >= BLOCK_WORDS:
            yield joined()
            size = 0
    if parts:
        yield joined()


def modulo(x: np.ndarray, n: int) -> np.ndarray:
    return (mix(x) % np.uint64(n)).astype(np.int64)


def by_end(ids: np.ndarray, starts: np.ndarray, ends: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(end, ids, starts) for the ends where the removals of documents are gathered; both in order."""
    to = modulo(ids.astype(np.uint64), ends)
    by = np.lexsort((starts, ids, to))
    ids, starts, to = ids[by], starts[by], to[by]
    for a, b in _cuts(to):
        yield int(to[a]), ids[a:b], starts[a:b]


def routed(block: tuple[np.ndarray, ...], buckets: int, ends: int, heavy: np.ndarray) -> Iterator[tuple]:
    """(bucket, to, hashes, starts) of a block: settled windows have an end ``to`` and no hashes, open ones no end."""
    ids, start, hashes, anchor = block
    late = later_windows(hashes, ids)
    for to, i, p in by_end(ids[late], start[late], ends):
        yield int(modulo(i[:1].astype(np.uint64), buckets)[0]), to, None, pack_starts(i, p)
    on = np.flatnonzero(~late)
    key = anchor[on]
    if len(heavy):
        key = np.where(np.isin(key, heavy), hashes[on], key)
    bucket = modulo(key, buckets)
    by = np.argsort(bucket, kind="stable")
    on, bucket = on[by], bucket[by]
    for a, b in _cuts(bucket):
        part = on[a:b]
        yield int(bucket[a]), None, hashes[part].tobytes(), pack_starts(ids[part], start[part])


def heavy_anchors(docs: DataFrame, window: int, share: float, limit: int) -> np.ndarray:
    """Anchors of ``limit`` windows or more, as a sample of that share of the documents shows. They decide where windows meet, not which go."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, hashes, anchor in (x for batch in batches for x in block_windows(batch, window)):
            _, first = np.unique(hashes, return_index=True)
            key, n = np.unique(anchor[first], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    some = docs.sample(share, 1) if share < 1 else docs
    found = some.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(2.0, limit * share))
    return np.array(sorted(r.anchor for r in found.collect()), np.int64).view(np.uint64)


BUCKETED = "bucket int, to int, hashes binary, starts binary"


def repeated_starts(docs: DataFrame, window: int, buckets: int, heavy: np.ndarray) -> DataFrame:
    """(_of, _starts): for each document that has some, the starts of the windows to remove; ``docs`` has _id and _t."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (x for batch in batches for x in block_windows(batch, window)):
            columns = list(zip(*routed(block, buckets, ends, heavy), strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "to", "hashes", "starts"])

    def settle(table: pa.Table) -> pa.Table:
        ids, starts, hashes, done = [], [], [], []
        for to, h, s in zip(*(table.column(c).to_pylist() for c in ("to", "hashes", "starts")), strict=True):
            if to is not None:
                done.append((to, s))
                continue
            i, p = unpack_starts(s)
            ids.append(i)
            starts.append(p)
            hashes.append(np.frombuffer(h, np.uint64))
        if ids:
            i, p = np.concatenate(ids), np.concatenate(starts)
            late = later_windows(np.concatenate(hashes), i)
            done += [(to, pack_starts(i, p)) for to, i, p in by_end(i[late], p[late], ends)]
        return pa.table({"to": pa.array([x for x, _ in done], pa.int32()), "starts": pa.array([x for _, x in done], pa.binary())})

    def collect(table: pa.Table) -> pa.Table:
        both = [unpack_starts(x) for x in table.column("starts").to_pylist()]
        i, p = (np.concatenate([x[k] for x in both]) for k in (0, 1))
        by = np.lexsort((p, i))
        i, p = i[by], p[by]
        cuts = list(_cuts(i))
        return pa.table({"_of": pa.array([int(i[a]) for a, _ in cuts], pa.int64()), "_starts": pa.array([_runs(p[a:b]) for a, b in cuts], pa.binary())})

    ends = max(4, buckets // 8)
    moved = docs.mapInArrow(spread, BUCKETED)
    settled = moved.groupBy("bucket").applyInArrow(settle, "to int, starts binary")
    return settled.groupBy("to").applyInArrow(collect, "_of long, _starts binary")


def _cuts(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of the runs of equal values."""
    edge = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]) if len(x) else np.zeros(1, int)
    return zip(edge[:-1], edge[1:], strict=True)


def _runs(starts: np.ndarray) -> bytes:
    """Sorted starts as runs of neighbours (first, length)."""
    at = np.concatenate([[0], np.flatnonzero(np.diff(starts) != 1) + 1])
    return np.stack([starts[at], np.diff(np.concatenate([at, [len(starts)]]))], 1).astype("<u4").tobytes()


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def with_ranks(rows: DataFrame) -> DataFrame:
    """Rows whose _id is a long. Ids of another type, such as texts, give way to their ranks, which keep their order."""
    if isinstance(rows.schema["_id"].dataType, T.IntegralType):
        return rows.withColumn("_id", F.col("_id").cast("long"))
    with_checkpoint_dir(rows.sparkSession)
    ids = rows.filter("_id IS NOT NULL").select(F.col("_id").alias("_name")).distinct().orderBy("_name")
    ranks = ids.select("_name", F.monotonically_increasing_id().alias("_rank")).checkpoint()
    return rows.join(ranks, F.col("_id") == F.col("_name"), "left").select("_row", F.col("_rank").alias("_id"), "_t")


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Documents with n_words, n_removed, removed (word spans) and kept_text (the words left, joined by one space).

    keep: the document columns that go on (all if None).
    """
    made = ["n_words", "n_removed", "removed", "kept_text"]
    on = kept(docs, keep, made)
    whole = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(16, int(whole // BUCKET_BYTES))
    rows = with_ranks(docs.select(row(on).alias("_row"), F.col(doc_id).alias("_id"), F.col(text).alias("_t")))
    d = rows.select("_id", "_t")
    heavy = heavy_anchors(d, window, min(1.0, SAMPLE_BYTES / max(whole, 1)), HEAVY_WINDOWS)
    late = repeated_starts(d, window, buckets, heavy)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([_pack(x or b"") for x in batch.column("_t").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_id"), packed], names=["_row", "_id", "_z"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, spans, left = [], [], [], []
            for z, starts in zip(batch.column("_z").to_pylist(), batch.column("_starts").to_pylist(), strict=True):
                words = _unpack(z).split()
                edges = np.zeros(len(words) + 1, np.int32)
                if starts:
                    runs = np.frombuffer(starts, "<u4").reshape(-1, 2).astype(np.int64)
                    np.add.at(edges, runs[:, 0], 1)
                    np.add.at(edges, runs[:, 0] + runs[:, 1] + window - 1, -1)
                covered = np.cumsum(edges[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                sizes.append(len(words))
                gone.append(int(covered.sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2], strict=True)])
                at, pieces = 0, []
                for a, b in zip(turns[::2], turns[1::2], strict=True):
                    pieces += words[at:a]
                    at = b
                left.append(b" ".join(pieces + words[at:]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(left, pa.string())],
                names=["_row", *made],
            )

    of_row = rows.schema["_row"]
    packed = rows.mapInArrow(squeeze, T.StructType([of_row, T.StructField("_id", T.LongType()), T.StructField("_z", T.BinaryType())]))
    both = packed.join(late, F.col("_id") == F.col("_of"), "left").select("_row", "_z", "_starts")
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", SPANS), T.StructField("kept_text", T.StringType())]
    return both.mapInArrow(cut, T.StructType([of_row, *fields])).select(*unpacked(on), *made)
