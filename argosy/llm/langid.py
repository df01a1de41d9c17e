"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a linear classifier over hashed byte trigrams says
on which side the text is: its weights are the log ratio of the mean trigram distributions of the
languages with a 1 and of those with a 0. Decoding takes the codeword with the least weighted logistic
loss over the bits; a small lead over the next codeword is flagged as ambiguous.

Training is one scan that counts trigrams per language over all training rows, in Arrow batches with
one partial row a language; the counts of the languages (BUCKETS numbers each) come to the driver.
Prediction is one scan with the weights broadcast. No text is shuffled.

Defined cases: a null text or one without a letter gets `und` and score 0; rows with a null language
teach nothing; with nothing to learn from, everything is `und`; with one language, every text with a
letter gets it; ties go to the language that is first by code point; repeated rows are judged each by
itself; a column with the name of a result column is replaced.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argosy.llm.common import kept, map_batches

BUCKETS = 1 << 13
SMOOTHING = 0.5
#: Scales the mean log ratio of a text's trigrams to a margin.
SHARPNESS = 4.0
AMBIGUOUS = 0.6
#: More languages than this are refused, as all their counts come to the driver.
MAX_LANGUAGES = 2000
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def trigram_counts(text: str) -> np.ndarray:
    """How often each hashed byte trigram occurs in the whole lower-cased text, its ends padded by a space."""
    b = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(BUCKETS, np.int64)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return np.bincount((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13), minlength=BUCKETS)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each of n languages: all splits for up to 7, else random ones that are all different."""
    if n <= 7:
        splits = range(1, 2 ** max(0, n - 1))
        return np.array([[1 if (s >> i) & 1 else -1 for s in splits] for i in range(n)], np.int8).reshape(n, len(splits))
    draw, columns = random.Random(seed), []
    while len(columns) < int(15 * np.log2(n)):
        column = [draw.choice((-1, 1)) for _ in range(n)]
        if abs(sum(column)) < n and column not in columns:
            columns.append(column)
    return np.array(columns, np.int8).T


class Model:
    """Languages, their codewords, and a weight row and an importance for each bit."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.languages = sorted(counts)
        self.code = codewords(len(self.languages)).astype(np.float64)
        share = np.array([(counts[x] + SMOOTHING) / (counts[x].sum() + SMOOTHING * BUCKETS) for x in self.languages]).reshape(-1, BUCKETS)
        bits = self.code.shape[1]
        self.weights = np.zeros((bits, BUCKETS), np.float32)
        self.importance = np.ones(bits)
        for k in range(bits):
            one, other = share[self.code[:, k] > 0].mean(axis=0), share[self.code[:, k] < 0].mean(axis=0)
            self.weights[k] = np.log(one) - np.log(other)
            # a bit counts by how far apart it holds its two sides
            self.importance[k] = np.abs(share @ self.weights[k]).mean()
        if bits:
            self.importance /= self.importance.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability, ambiguous)."""
        if not self.languages or text is None or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        counts = trigram_counts(text)
        at = np.flatnonzero(counts)
        margin = SHARPNESS * (self.weights[:, at] @ counts[at]) / counts.sum()
        loss = np.logaddexp(0.0, -self.code * margin) @ self.importance
        near = np.exp((loss.min() - loss) * len(self.importance))
        best = int(np.argmin(loss))
        score = float(near[best] / near.sum())
        return self.languages[best], score, score < AMBIGUOUS


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model from all rows with a text and a language."""
    known = docs.select(F.col(text).alias("_t"), F.col(lang).alias("_l")).dropna()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, x in zip(batch.column("_t").to_pylist(), batch.column("_l").to_pylist(), strict=True):
                c = trigram_counts(t)
                sums[x] = sums[x] + c if x in sums else c
        for x, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "bucket", "n"])

    found = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    per = found.groupBy("lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(per) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = {}
    for r in per:
        counts[r.lang] = np.zeros(BUCKETS, np.int64)
        counts[r.lang][r.at] = r.n
    return Model(counts)


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Documents with lang_pred, score and ambiguous. keep: the document columns that go on (all if None)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list:
        made = [sent.value.predict(x) for x in batch.column(text).to_pylist()]
        return [list(x) for x in zip(*made, strict=True)] if made else [[], [], []]

    return map_batches(docs, run, FIELDS, kept(docs, keep, []))


def held_out(doc_id: Column) -> Column:
    """The fold that training never sees; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1
