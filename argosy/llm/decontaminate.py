"""Benchmark decontamination by suffix arrays over shards of the training text.

Each Arrow batch of documents is a shard. Its words become integers, a suffix array orders all
suffixes that could match, and every benchmark suffix is binary-searched in it. Documents are never
shuffled: the benchmark goes to them, in blocks whose size is bounded, and a document carries what
earlier blocks found.

Defined cases: a null or empty text has no words and no match; an item without id or text is left
out; repeated rows are judged each by itself; an item id that occurs twice counts once; an empty
benchmark matches nothing; a document column with the name of a result column is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argosy.llm.common import kept, map_batches, texts

WINDOW = 13
BLOCK_CHARS = 8_000_000
SHARD_WORDS = 4_000_000
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
MATCH = T.StructType(
    [
        T.StructField("item", T.StringType()),
        T.StructField("item_pos", T.IntegerType()),
        T.StructField("doc_pos", T.IntegerType()),
        T.StructField("n_words", T.IntegerType()),
    ]
)
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(SPAN)),
    T.StructField("matches", T.ArrayType(MATCH)),
]


def words_of(text: bytes) -> list[bytes]:
    """bytes.lower() changes A-Z only, which is the rule."""
    return WORD_BYTES.findall(text.lower())


class Benchmark:
    """The suffixes of a block of items that start a window, as integers."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names, parts, owner, start, need, left = [], [np.zeros(0, np.int32)], [], [], [], []
        at = 0
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text.encode())]
            if not ids:
                continue
            k = min(window, len(ids))
            for pos in range(len(ids) - k + 1):
                owner.append(len(self.names))
                start.append(at + pos)
                need.append(k)
                left.append(len(ids) - pos)
            self.names.append(name)
            parts.append(np.array([*ids, 0], np.int32))
            at += len(ids) + 1
        self.words = np.concatenate(parts)
        self.owner, self.start, self.need, self.left = (np.array(x, np.int64) for x in (owner, start, need, left))
        self.first = np.full(len(self.names), 0, np.int64)
        if len(self.owner):
            self.first = self.start[np.searchsorted(self.owner, np.arange(len(self.names)))]
        self.longest = int(self.left.max()) if len(self.left) else 0


def suffix_array(words: np.ndarray, starts: np.ndarray, depth: int, top: int) -> np.ndarray:
    """``starts`` in the order of their suffixes' first ``depth`` words.

    Words are packed several to an integer; each round sorts only what is still tied.
    """
    bits = max(1, int(top).bit_length())
    per = max(1, 62 // bits)
    padded = np.concatenate([words, np.zeros(depth + per, words.dtype)])
    order = starts.copy()
    lo = np.zeros(1, np.int64)
    hi = np.array([len(order)], np.int64)
    for d in range(0, depth, per):
        big = hi - lo > 1
        lo, hi = lo[big], hi[big]
        if not len(lo):
            break
        sizes = hi - lo
        group = np.repeat(np.arange(len(lo)), sizes)
        where = np.repeat(lo - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(group))
        key = np.zeros(len(group), np.int64)
        for i in range(per):
            key = (key << bits) | padded[order[where] + d + i]
        by = np.lexsort((key, group))
        order[where] = order[where[by]]
        key, group = key[by], group[by]
        cut = np.flatnonzero((key[1:] != key[:-1]) | (group[1:] != group[:-1])) + 1
        edge = np.concatenate([[0], cut, [len(key)]])
        lo, hi = where[edge[:-1]], where[edge[1:] - 1] + 1
    return order


def bound(column, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
    """First place in [lo, hi) whose word is not below (right: above) value, for all at once."""
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        seen = column(mid, open_)
        less = seen <= value[open_] if right else seen < value[open_]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def search(words: np.ndarray, order: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """The range of the suffix array that holds each benchmark suffix's window."""
    lo = np.zeros(len(bench.start), np.int64)
    hi = np.full(len(bench.start), len(order), np.int64)
    alive = np.arange(len(bench.start))
    for d in range(int(bench.need.max(initial=0))):
        alive = alive[(hi[alive] > lo[alive]) & (bench.need[alive] > d)]
        if not len(alive):
            break
        value = bench.words[bench.start[alive] + d]

        def column(mid: np.ndarray, _: np.ndarray, d: int = d) -> np.ndarray:
            return words[order[mid] + d]

        left = bound(column, lo[alive], hi[alive], value, False)
        hi[alive] = bound(column, left, hi[alive], value, True)
        lo[alive] = left
    return lo, hi


def search_shard(docs: list[list[int]], bench: Benchmark, earlier: list) -> tuple[list, list]:
    """Merged hit spans and the longest match with each item, for every document of a shard."""
    sizes = np.array([len(x) for x in docs], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    total = int(begin[-1])
    words = np.zeros(total + bench.longest + 1, np.int32)
    for at, ids in zip(begin, docs, strict=False):
        words[at : at + len(ids)] = ids
    edges = np.zeros(len(words) + 1, np.int32)
    for at, spans in zip(begin, earlier, strict=False):
        for s in spans:
            edges[at + s["start"]] += 1
            edges[at + s["end"]] -= 1
    matches: list[list[dict]] = [[] for _ in docs]
    if len(bench.start):
        place = np.arange(len(words))
        stop = np.minimum.accumulate(np.where(words == 0, place, len(words))[::-1])[::-1]
        starts = np.flatnonzero(stop - place >= bench.need.min())
        order = suffix_array(words, starts, bench.longest, len(bench.vocabulary) + 1)
        lo, hi = search(words, order, bench)
        found = np.flatnonzero(hi > lo)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for part in np.array_split(found, max(1, int((hi - lo)[found].sum()) // 2_000_000)):
            n = (hi - lo)[part]
            suffix = np.repeat(part, n)
            at = order[np.repeat(lo[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(suffix))] if len(part) else suffix
            np.add.at(edges, at, 1)
            np.add.at(edges, at + bench.need[suffix], -1)
            size = bench.need[suffix].copy()
            more = np.flatnonzero(size < bench.left[suffix])
            while len(more):
                same = words[at[more] + size[more]] == bench.words[bench.start[suffix[more]] + size[more]]
                more = more[same]
                size[more] += 1
                more = more[size[more] < bench.left[suffix[more]]]
            doc = np.searchsorted(begin, at, side="right") - 1
            by = np.lexsort((at, bench.start[suffix], -size, bench.owner[suffix], doc))
            pair = doc[by] * len(bench.names) + bench.owner[suffix[by]]
            for i in by[np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))] if len(by) else ():
                key = (int(doc[i]), int(bench.owner[suffix[i]]))
                new = (-int(size[i]), int(bench.start[suffix[i]] - bench.first[key[1]]), int(at[i] - begin[key[0]]))
                best[key] = min(best.get(key, new), new)
        for (doc, item), (size, item_pos, doc_pos) in sorted(best.items()):
            matches[doc].append({"item": bench.names[item], "item_pos": item_pos, "doc_pos": doc_pos, "n_words": -size})
    hit = np.cumsum(edges) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    spans: list[list[dict]] = [[] for _ in docs]
    for s, e in zip(turns[::2], turns[1::2], strict=True):
        doc = int(np.searchsorted(begin, s, side="right") - 1)
        spans[doc].append({"start": int(s - begin[doc]), "end": int(e - begin[doc])})
    return spans, matches


def find_matches(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Documents with n_words, hit_spans (merged word spans inside matched windows) and matches
    (the longest verbatim match with each item and where it is).

    keep: the document columns that go on (all if None).
    """
    spark = docs.sparkSession
    keep = kept(docs, keep, [f.name for f in FIELDS])
    known = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).dropna().distinct()
    chars = known.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = int(chars // BLOCK_CHARS) + 1
    out = docs
    for b in range(blocks):
        block = known.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast(Benchmark(sorted((r.i, r.t) for r in block.collect()), window))

        def run(batch: pa.RecordBatch, sent=sent, first=b == 0) -> list:
            bench, get = sent.value, sent.value.vocabulary.get
            prior = [[]] * batch.num_rows if first else batch.column("hit_spans").to_pylist()
            counts, spans, matches, shard, size, done = [], [], [], [], 0, 0
            raw = texts(batch, text)
            for i, x in enumerate(raw):
                words = words_of(x)
                counts.append(len(words))
                shard.append([get(w, 0) for w in words])
                size += len(words)
                if size >= SHARD_WORDS or i == len(raw) - 1:
                    s, m = search_shard(shard, bench, prior[done : i + 1])
                    spans, matches, shard, size, done = spans + s, matches + m, [], 0, i + 1
            if not first:
                matches = [x + y for x, y in zip(batch.column("matches").to_pylist(), matches, strict=True)]
            return [counts, spans, matches]

        on = keep if b == blocks - 1 else list(dict.fromkeys([*keep, text]))
        out = map_batches(out, run, FIELDS, on)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, min_share: float = 0.05, **names) -> DataFrame:
    """find_matches with n_hit, n_items, items and contaminated: the share of hit words is min_share at least."""
    hits = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    return (
        find_matches(docs, items, **names)
        .withColumn("n_hit", hits)
        .withColumn("items", found)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(min_share) * F.col("n_words")))
    )
