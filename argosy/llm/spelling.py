"""Spelling variants: words within one edit, found by pivotal bigrams, and the common form each of them leads to.

Bigrams are ordered by how many words have them, rare first. A word's prefix holds its first three (and all that share
the last one's bigram); of these, dynamic programming takes the two pivots that don't overlap and are rarest together.
One edit leaves one of two pivots whole. Of two words, that whose prefix ends first has its surviving pivot in the
other's prefix, so pivots meet prefixes both ways. Position limits: an edit to the right of the first pivot leaves it and
all before it, at the same distance from the word's begin; any other leaves the second and all after it, at the same
distance from the end. Of the edited side, cut in the middle of the pivot's word, one half is equal too. Keys hold all
that must be equal, so that no list of a common bigram is ever multiplied out; pairs are then verified by edit distance.

The table of bigrams has 8,100 rows at most, as words are of 90 letters. Form and root: a word's form is its near word
of largest count, if that is twice its own at least; counts double along forms, so roots are reached in a few doublings.

Defined cases: a null text has no words, a null id is written as nothing in the hash; words need ``least`` code points
and ``times`` occurrences; ties go to the smaller word in code-point order; an empty table gives no rows; repeated rows
are so many occurrences; other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argosy.session import with_checkpoint_dir

LEAST, TIMES, EVERY = 5, 3, 97
GRAM, EDITS = 2, 1
#: Distinct words that a task counts before it sends them on.
HELD = 500_000
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, bytes(range(97, 123)))
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST)


def words_of(doc_id: str, text: bytes) -> Counter:
    """The runs of at least LEAST code points, each with the letter deleted that the hash of id and run names."""
    runs = Counter(_RUN.findall(text.translate(_LOWER).decode("utf-8", "replace")))  # a broken character ends a run
    begun, crc = zlib.crc32(f"{doc_id}:".encode()), zlib.crc32
    hit = [(r, crc(r.encode(), begun)) for r in runs]
    # all are taken out before any result goes in: a result may be another run that the hash names
    for run, h, n in [(r, h, runs.pop(r)) for r, h in hit if h % EVERY == 0]:
        at = h % len(run)
        runs[run[:at] + run[at + 1 :]] += n
    return runs


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of whole texts that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                seen.update(words_of("" if name is None else name, t or b""))
                if len(seen) > HELD:
                    yield packed(seen)
                    seen = Counter()
        yield packed(seen)

    def packed(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    made = docs.select(F.col(f"`{doc_id}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t")).mapInArrow(run, "word string, n long")
    return made.filter(F.length("word") >= LEAST).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= TIMES)


def pivots_of(places: list[tuple[int, int]]) -> list[int]:
    """Of (place, cost), in order of places, the EDITS + 1 places that don't overlap and cost least together."""
    best: list[list[tuple[int, tuple[int, ...]]]] = [[(0, ())] + [(2**62, ())] * (EDITS + 1)]
    for i, (place, cost) in enumerate(places):
        apart = max((j + 1 for j in range(i) if places[j][0] + GRAM <= place), default=0)
        taken = [(best[apart][m - 1][0] + cost, (*best[apart][m - 1][1], place)) for m in range(1, EDITS + 2)]
        best.append([(0, ())] + [min(best[i][m], taken[m - 1]) for m in range(1, EDITS + 2)])
    return list(best[-1][-1][1])


def grams_of(word: str, often: dict[str, int]) -> tuple[list[int], list[int]]:
    """Places of the pivots and of the prefix."""
    grams = [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]
    order = sorted(range(len(grams)), key=lambda i: (often[grams[i]], grams[i], i))
    last = order[min(len(order), GRAM * EDITS + 1) - 1]
    end = (often[grams[last]], grams[last])
    prefix = [i for i in order if (often[grams[i]], grams[i]) <= end]
    first = sorted(order[: GRAM * EDITS + 1])
    return pivots_of([(i, often[grams[i]]) for i in first]), prefix


def keys_of(word: str, places: list[int], sides: str, edited: int) -> set[str]:
    """What must be equal if the bigram at one of ``places`` is left whole by an edit to its right (L) or to its left (R).

    Of the edited side, of m letters in the pivot's word, the first m // 2 are equal (f) or the others (t). The pivot's word
    has edited = 0; the other word, whose side may be longer or shorter by one, has 1.
    """
    out = set()
    for p, side in ((p, side) for p in places for side in sides):
        same, rest = (word[: p + GRAM], word[p + GRAM :]) if side == "L" else (word[p:], word[:p])
        for m in range(max(0, len(rest) - edited), len(rest) + edited + 1):
            if (first := m // 2) <= len(rest):
                out.add(f"{side}f{same},{rest[:first]}")
            if (tail := m - first) <= len(rest):
                out.add(f"{side}t{same},{rest[len(rest) - tail :]}")
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near): all ordered pairs of different words of ``words`` (word, n) with edit distance one."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - GRAM + 1), lambda i: F.substring(F.col("word"), i, F.lit(GRAM)))
    often = {r["g"]: r["count"] for r in words.select(F.explode(F.array_distinct(grams)).alias("g")).groupBy("g").count().collect()}  # 90 x 90 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, word, pivot = [], [], []
            for w in batch.column(0).to_pylist():
                pivots, prefix = grams_of(w, often)
                for is_pivot, found in ((True, keys_of(w, pivots[:1], "L", 0) | keys_of(w, pivots[1:], "R", 0)), (False, keys_of(w, prefix, "LR", EDITS))):
                    key += found
                    word += [w] * len(found)
                    pivot += [is_pivot] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(word, pa.string()), pa.array(pivot, pa.bool_())], names=["key", "word", "pivot"])

    keys = words.select("word").mapInArrow(run, "key string, word string, pivot boolean").select(F.xxhash64("key").alias("key"), "word", "pivot")
    a, b = keys.filter("pivot").select("key", F.col("word").alias("a")), keys.filter("NOT pivot").select("key", F.col("word").alias("b"))
    near = (F.col("a") != F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= EDITS) & (F.levenshtein("a", "b", EDITS) == EDITS)
    half = a.join(b, "key").filter(near)
    return half.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(half.select(F.col("b").alias("word"), F.col("a").alias("near"))).distinct()


def variants(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each row of ``words`` (word, n)."""
    with_checkpoint_dir(words.sparkSession)
    words = words.checkpoint()
    pairs = near_pairs(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # the largest count, then the smallest word: counts fall and words rise in the same order
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    of = words.join(best, "word", "left").withColumn("leads", F.coalesce(-F.col("best.less") >= 2 * F.col("n"), F.lit(False)))
    of = of.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("leads"), F.col("best.near")).alias("form"), F.when(F.col("leads"), -F.col("best.less")).alias("form_n")).checkpoint()
    roots = of.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        there = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = roots.join(there, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).checkpoint()
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return of.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The variants among the words of ``docs``."""
    return variants(counts(docs, doc_id, text))
