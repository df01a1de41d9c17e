"""MinHash near-duplicates: SuperMinHash signatures, banding, verification on full sets, components.

Equal shingle sets collapse to the smallest id first, so copies cost one row each. Signatures make 30
band keys of 5 values: two texts of similarity 0.8 share none of them with probability 7e-6. In a
bucket every member is verified against the smallest one. After the components of these links, only
members of different components are compared, and of these only pairs whose bit maps leave room for a
link: in bands of many members by blocks of bit maps, as matrices. So a large group of near copies costs about one
comparison a member, and no link between different components is left out.

Defined cases: a text without words has the empty set and is linked with nothing; one with fewer
words than a shingle has one shingle, the whole sequence; a null id is never linked, has no component
and is kept; repeated rows share one component and all carry kept; empty tables give no rows; a
document column with the name of a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argosy.llm.common import kept, map_batches, row, unpacked
from argosy.llm.components import components
from argosy.llm.wordhash import Words, chunks, mix
from argosy.session import with_checkpoint_dir

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 30, 5
#: Numbers of 64 bits in a text's bit map, in which each shingle sets the bit that its hash names.
MAP = 32
#: Bands with more members than FEW are held against each other in blocks of about BLOCK rows.
FEW, BLOCK = 64, 2048
SKETCH = [
    T.StructField("_n", T.LongType()),
    T.StructField("_set", T.BinaryType()),
    T.StructField("_bands", T.ArrayType(T.LongType())),
    T.StructField("_bits", T.ArrayType(T.LongType())),
]


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    runs, out = words.runs(k), []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= k:
            x = np.sort(runs[a : b - k + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        else:
            x = np.full(1, b - a, np.uint64)
            for h in words.hash[a:b]:
                x = mix(x * np.uint64(0xA0761D6478BD642F) + h)
            out.append(x[: int(b > a)])
    return out


def super_min_hash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures of m values, infinite for an empty set.

    Element e sends the value j + r_j(e) to place p_j(e) for j = 0, 1, ..., where the places of an element are a random
    permutation. All texts go through step j together; a text is finished, as later steps can't lower anything, once all
    its values are below j + 1.
    """
    out = np.full((len(sets), m), np.inf)
    flat = out.reshape(-1)
    sizes = np.array([len(x) for x in sets], np.int64)
    text = np.repeat(np.arange(len(sets)), sizes)
    element = np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint64)
    places = None
    for j in range(m):
        if not len(element):
            break
        draw = mix(element + np.uint64((2 * j + 1) * 0xD1B54A32D192ED03 % 2**64))
        value = (draw >> np.uint64(24)).astype(np.float64) / 2.0**40 + j
        k = j + (((draw & np.uint64(0xFFFFFF)) * np.uint64(m - j)) >> np.uint64(24)).astype(np.int64)
        if places is None and j == 1:
            places = np.tile(np.arange(m, dtype=np.uint8), (len(element), 1))
            places[np.arange(len(element)), first] = 0
            places[:, 0] = first
        if j:
            at = np.arange(len(element))
            place = places[at, k].astype(np.int64)
            places[at, k] = places[:, j]
            places[:, j] = place
        else:
            place = first = k
        np.minimum.at(flat, text * m + place, value)
        on = (out.max(axis=1) >= j + 1)[text]
        if not on.all():
            element, text = element[on], text[on]
            places = places[on] if places is not None else None
            if j == 0:
                first = first[on]
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, rows)
    key = np.arange(bands, dtype=np.uint64)[None, :] + np.zeros((len(signatures), 1), np.uint64)
    for i in range(rows):
        key = mix(key * np.uint64(0xE7037ED1A0B428DB) + bits[:, :, i])
    return key.view(np.int64)


def bit_map(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(MAP * 64, np.uint8)
    out[hashes % np.uint64(MAP * 64)] = 1
    return np.packbits(out).view(np.int64)


def sketch(batch: pa.RecordBatch, text: str, k: int) -> list:
    sizes, names, keys, maps = [], [], [], []
    for _, _, words in chunks(batch.column(text), lower=True):
        sets = shingle_sets(words, k)
        sizes += [len(x) for x in sets]
        names += [blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
        found = band_keys(super_min_hash(sets, BANDS * ROWS))
        keys += [x if len(s) else None for x, s in zip(found, sets, strict=True)]
        maps += [bit_map(x) for x in sets]
    return [sizes, names, keys, maps]


def squeezed(batch: pa.RecordBatch, text: str) -> list:
    pack = zstandard.ZstdCompressor(level=1).compress
    return [[pack((x or b"").lower()) for x in batch.column(text).cast(pa.binary()).to_pylist()]]


def _set_of(packed: bytes, k: int) -> set:
    w = zstandard.ZstdDecompressor().decompress(packed).split()
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} - {()}


def verify(pairs: DataFrame, packed: DataFrame, k: int, percent: int) -> DataFrame:
    """The (a, b) whose full shingle sets, made anew from the texts, are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_a = None, set()
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("za").to_pylist(), batch.column("zb").to_pylist(), strict=True):
                if x != last:
                    last, of_a = x, _set_of(x, k)
                of_b = _set_of(y, k)
                both = len(of_a & of_b)
                ok.append(both > 0 and 100 * both >= percent * (len(of_a) + len(of_b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    a, b = (packed.select(F.col("_id").alias(x), F.col("_z").alias(f"z{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "za", "zb")
    return both.mapInArrow(check, pairs.select("a", "b").schema)


def few_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """(rep_x, rep_y) of different parts in one band whose bit maps leave room for a link, by a join."""
    x, y = (open_.select("band", *(F.col(c).alias(f"{c}_{i}") for c in ("rep", "n", "part", "bits"))) for i in "xy")
    # a bit that only one text has is a shingle at least that the other lacks, which bounds the similarity from above
    lacks = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda n, k: n + k)
    most = F.least(F.col("n_x") - lacks("bits_x", "bits_y"), F.col("n_y") - lacks("bits_y", "bits_x"))
    within = F.lit(100) * most >= F.lit(percent) * (F.col("n_x") + F.col("n_y") - most)
    return x.join(y, (x["band"] == y["band"]) & (F.col("part_x") < F.col("part_y")) & within).select("rep_x", "rep_y")


def block_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """The same of bands with many members, cut into blocks of about BLOCK rows; each two blocks of a band meet in one group, as
    matrices of bits, and only the pairs that are left leave it."""
    salts = F.ceil(F.col("held") / BLOCK).cast("int")
    salt = F.pmod(F.xxhash64("rep"), salts).cast("int")
    meets = F.transform(F.sequence(F.lit(0), salts - 1), lambda t: F.struct(F.least(salt, t).alias("i"), F.greatest(salt, t).alias("j")))
    rows = open_.select("band", "rep", "n", "part", "bits", salt.alias("salt"), F.explode(meets).alias("_m")).select("*", "_m.i", "_m.j").drop("_m")

    def meet(group: pa.Table) -> pa.Table:
        n, salt = (group[c].to_numpy().astype(np.int64) for c in ("n", "salt"))
        rep, part = group["rep"].combine_chunks(), np.unique(group["part"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
        bits = group["bits"].combine_chunks().flatten().to_numpy().astype(np.int64).reshape(len(n), MAP).view(np.uint64)
        one = salt == salt.min()
        left, right = (np.flatnonzero(one), np.flatnonzero(~one)) if not one.all() else (np.arange(len(n)),) * 2
        size, out = np.bitwise_count(bits).sum(axis=1, dtype=np.int64), []
        for at in range(0, len(left), 64):
            x = left[at : at + 64]
            both = np.zeros((len(x), len(right)), np.int64)
            for w in range(MAP):
                both += np.bitwise_count(bits[x, w][:, None] & bits[right, w][None, :])
            most = np.minimum(n[x][:, None] - (size[x][:, None] - both), n[right][None, :] - (size[right][None, :] - both))
            fits = (100 * most >= percent * (n[x][:, None] + n[right][None, :] - most)) & (part[x][:, None] != part[right][None, :])
            i, j = np.nonzero(fits)
            out.append((x[i], right[j]))
        a, b = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
        once = a < b if left is right else slice(None)
        return pa.table({"rep_x": rep.take(pa.array(a[once])), "rep_y": rep.take(pa.array(b[once]))})

    kind = open_.schema["rep"].dataType.simpleString()
    return rows.groupBy("band", "i", "j").applyInArrow(meet, f"rep_x {kind}, rep_y {kind}")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each document."""
    with_checkpoint_dir(docs.sparkSession)
    d = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t"))
    made = map_batches(d, lambda batch: sketch(batch, "_t", shingle), SKETCH, ["_id"]).checkpoint()
    some = made.filter(F.col("_id").isNotNull() & (F.col("_n") > 0))
    sets = some.groupBy("_set").agg(F.min("_id").alias("rep"), F.max("_n").alias("n"), F.min_by(F.struct("_bands", "_bits"), "_id").alias("of")).select("_set", "rep", "n", "of._bands", "of._bits")
    sets = sets.withColumnsRenamed({"_bands": "bands", "_bits": "bits"})
    keyed = sets.select("rep", "n", F.explode("bands").alias("band"))
    leaders = keyed.groupBy("band").agg(F.min("rep").alias("lead"), F.count("*").alias("members")).filter("members > 1")
    shared = keyed.join(leaders, "band").checkpoint()
    # only texts that share a band are ever verified; they are packed once
    packed = map_batches(d.filter(F.col("_id").isNotNull()), lambda batch: squeezed(batch, "_t"), [T.StructField("_z", T.BinaryType())], ["_id"])
    packed = packed.join(shared.select(F.col("rep").alias("_id")).distinct(), "_id", "left_semi").checkpoint()

    tested = shared.filter(F.col("rep") != F.col("lead")).select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    links = verify(tested, packed, shingle, percent).distinct().checkpoint()
    first = components(links)
    # buckets whose members are still apart; in one of two members both have been compared
    placed = shared.filter("members > 2").join(first, F.col("rep") == F.col("node"), "left").select("band", "rep", "n", F.coalesce("component", "rep").alias("part"))
    apart = placed.groupBy("band").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("held")).filter("p < q")
    open_ = placed.join(apart.select("band", "held"), "band").checkpoint()
    bits = open_.select("rep").distinct().join(sets.select(F.col("rep").alias("_of"), "bits"), F.col("rep") == F.col("_of")).drop("_of")
    open_ = open_.join(bits, "rep")
    rest = few_pairs(open_.filter(F.col("held") <= FEW), percent).unionByName(block_pairs(open_.filter(F.col("held") > FEW), percent))
    rest = rest.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    late = verify(rest, packed, shingle, percent).distinct().checkpoint()
    final = first
    if not late.isEmpty():
        final = components(links.unionByName(late))
    of_set = sets.select("_set", "rep").join(final, F.col("rep") == F.col("node"), "left").select("_set", F.coalesce("component", "rep").alias("of_set"))
    out = made.select("_id", "_n", "_set").join(of_set, "_set", "left")
    component = F.when(F.col("_n") > 0, F.when(F.col("_id").isNotNull(), F.col("of_set"))).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """The documents of which one of each group stays: the smallest id; rows without an id stay. Of rows that share an id one
    stays, the first by a hash of the whole row, so that reruns agree."""
    keep = near_duplicates(docs, doc_id=doc_id, **how).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_keep")).distinct()
    on = kept(docs, None, [])
    d = docs.select(F.col(f"`{doc_id}`").alias("_id"), row(on).alias("_row"))
    one = d.filter(F.col("_id").isNotNull()).join(keep, F.col("_id") == F.col("_keep")).groupBy("_keep").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return one.select("_row").unionByName(d.filter(F.col("_id").isNull()).select("_row")).select(*unpacked(on))
