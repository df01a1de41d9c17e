"""Whitening, nearest neighbours and spelling variants against brute force, with odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from argosy.llm import nearest, queries, spelling, whiten

VECTORS = "vec_id LONG, embedding ARRAY<FLOAT>"


def vectors_of(spark, rows, schema=VECTORS):
    return spark.createDataFrame(rows, schema)


def random_vectors(seed, n=150, d=6):
    r = np.random.default_rng(seed)
    x = (r.normal(size=(n, d)) * np.arange(1, d + 1)).astype(np.float32)
    return [(i, [float(a) for a in v]) for i, v in enumerate(x)]


ODD = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, []), (905, [1.0])]


def usable(rows, d=6):
    return [(i, v) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]


def test_whiten(spark):
    rows = random_vectors(1)
    rows += [rows[3], (None, rows[4][1]), (7, rows[5][1]), (906, [0.0] * 6)]
    df = vectors_of(spark, rows + ODD).withColumn("Whitened", F.lit("clash")).withColumn("more", F.col("vec_id"))
    model = whiten.fit(df)
    out = whiten.whiten(df, model)
    assert out.columns == ["vec_id", "embedding", "more", "deviation", "whitened"]
    got = out.collect()
    good = usable(rows)
    assert Counter(r.vec_id for r in got) == Counter(i for i, _ in good)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good], dtype=object)
    n, sums = len(good), x.sum(axis=0)
    assert (model.rows, model.sums) == (n, list(sums))
    y = (n * x - sums).astype(float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    assert np.allclose(model.variances, e, rtol=1e-12) and np.allclose(np.abs(model.vectors), np.abs(v.T), atol=1e-10)
    assert np.allclose(model.explained, e / e.sum(), rtol=1e-12)
    signs = np.sign((model.vectors * v.T).sum(axis=1))
    want = sorted((int(sum(int(a) ** 2 for a in n * p - sums)), *np.round(q, 8)) for p, q in zip(x, (y @ v) / np.sqrt(e) * signs, strict=True))
    assert np.allclose(np.array(sorted((r.deviation, *np.round(r.whitened, 8)) for r in got), float), np.array(want, float), atol=1e-7)
    assert whiten.identity_error(out, n, len(e)) < 1e-9


@pytest.mark.parametrize("case", ["equal variances", "few directions", "one row", "equal rows", "nothing", "more than components"])
def test_whiten_spectra(spark, case):
    d = 40 if case == "more than components" else 6
    r = np.random.default_rng(2)
    if case == "equal variances":
        x = np.concatenate([np.eye(d), -np.eye(d)]) * 4
    elif case == "few directions":
        x = r.integers(-9, 9, (60, 2)) @ r.integers(-3, 3, (2, d))
    elif case == "more than components":
        x = np.round(r.normal(size=(200, d)) * 50)
    else:
        x = np.full(({"one row": 1, "equal rows": 5, "nothing": 0}[case], d), 3.0)
    df = vectors_of(spark, [(i, [float(a) for a in v]) for i, v in enumerate(x)])
    model = whiten.fit(df, scale=1.0)
    out = whiten.whiten(df, model, keep=["vec_id"], scale=1.0)
    got = out.collect()
    assert len(got) == len(x)
    wanted = {"equal variances": d, "few directions": 2, "more than components": 32}.get(case, 0)
    assert len(model.variances) == wanted and all(len(r.whitened) == wanted for r in got)
    if wanted:
        y = x - x.mean(axis=0)
        assert np.allclose(model.variances, np.linalg.eigvalsh(y.T @ y / len(x))[::-1][:wanted], rtol=1e-10)
        assert whiten.identity_error(out, model.rows, wanted) < 1e-8
        assert np.allclose(model.vectors @ model.vectors.T, np.eye(wanted), atol=1e-10)


def test_whiten_large_numbers(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.5, 2.0])]
    df = vectors_of(spark, rows)
    model = whiten.fit(df)
    got = {r.vec_id: r for r in whiten.whiten(df, model).collect()}
    assert got[1].deviation is None and len(model.variances) == 1
    y = np.array([[2**31, -(2**30)], [3 * 10**9, 5]], np.int64)
    assert whiten.deviation(y) == [2**62 + 2**60, 9 * 10**18 + 25]
    assert whiten.deviation(np.array([[2**32, 0]], np.int64)) == [None]


def brute_nearest(rows, k, every):
    items = list({(i, tuple(v)) for i, v in usable(rows) if any(v)})
    out = set()
    for q, v in items:
        if q is not None and q % every == 0:
            found = [(-float(np.dot(np.array(v), np.array(w))), c is None, c or 0) for c, w in items if (c, w) != (q, v)]
            for rank, (s, none, c) in enumerate(sorted(found)[:k], 1):
                out.add((q, rank, None if none else c, round(-s, 9)))
    return out


@pytest.mark.parametrize("tiles", [None, 7])
def test_nearest(spark, monkeypatch, tiles):
    if tiles:
        for name, value in {"TILE_Q": 3, "TILE_C": tiles, "STRIPE": 6 * 40, "GROUP": 6 * 4, "AT_ONCE": 5}.items():
            monkeypatch.setattr(nearest, name, value)
    r = random.Random(3)
    # small whole numbers tie often; a third of the rows are copies of one vector
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(6)]) for i in range(160)] + [(i, [1.0, 2.0, 0.0, -1.0, 0.0, 2.0]) for i in range(160, 240)]
    rows += [rows[0], (5, rows[6][1]), (20, rows[7][1]), (None, rows[8][1]), (None, rows[170][1]), (910, [0.0] * 6), (911, [-0.0] * 6)] + ODD
    df = vectors_of(spark, rows).withColumn("rank", F.lit("clash"))
    got = nearest.nearest(df, df.filter("vec_id % 20 = 0"), k=9).collect()
    assert {(x.query_id, x["rank"], x.vec_id, round(x.score, 9)) for x in got} == brute_nearest(rows, 9, 20)
    assert len(got) == len({(x.query_id, x["rank"], x.vec_id, x.score) for x in got})


def test_nearest_few(spark):
    empty = vectors_of(spark, [])
    assert nearest.nearest(empty, empty).count() == 0
    one = vectors_of(spark, [(0, [1.0, 0.0])])
    assert nearest.nearest(one, one).count() == 0
    two = vectors_of(spark, [(0, [1.0, 0.0]), (3, [2.0, 1.0])])
    assert [tuple(x) for x in nearest.nearest(two, two.filter("vec_id = 0")).collect()] == [(0, 1, 3, 2.0)]


def test_nearest_bounds():
    r = np.random.default_rng(4)
    q, c = r.normal(size=(20, 33)) * r.exponential(size=(20, 1)) * 1e3, r.normal(size=(50, 33)) * 1e-3
    of_q, of_c = nearest.Quantised(q), nearest.Quantised(c)
    about, err = nearest.bounds(of_q, of_c, slice(None), slice(None), np.float32)
    assert (np.abs(q @ c.T - about) <= err).all() and (err < 0.03 * of_q.norm[:, None] * of_c.norm).all()


def test_nearest_oracle(spark, sf, same):
    assert same(queries.QUERIES["op12_nearest"](spark, sf), queries.ORACLES["op12_nearest"])


def test_whiten_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x = np.floor(64 * np.array([v for _, v in rows], float)) + 1_000_000
    y = x - x.mean(axis=0)
    e, v = np.linalg.eigh(y.T @ y / len(x))
    e, v = e[::-1][:32], v[:, ::-1][:, :32]
    got = queries.QUERIES["op11_whiten"](spark, sf).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 32 * len(rows) and got.identity_error.max() < 1e-9 and (got.n == len(rows)).all()
    z = got.whitened.to_numpy().reshape(len(rows), 32)
    order = np.argsort([i for i, _ in rows])
    assert np.allclose(np.abs(z), np.abs((y @ v) / np.sqrt(e))[order], atol=1e-8)
    assert np.allclose(got.explained.to_numpy()[:32], e / (y**2).sum() * len(x), rtol=1e-9)


def changed(doc_id, run):
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_variants(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f is not None and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, n[w], len(near[w]), form[w], None if form[w] is None else n[form[w]], root(w)) for w in n}


def lower(text):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)


def test_spelling(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcéÿ") for _ in range(r.randint(5, 8))) for _ in range(12)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa"]
    texts = []
    for i in range(150):
        words = []
        for _ in range(25):
            w = r.choice(base)
            if r.random() < 0.6:
                at, to = r.randrange(len(w)), r.choice("abcÉéz")
                w = r.choice([w[:at] + to + w[at:], w[:at] + to + w[at + 1 :], w[:at] + w[at + 1 :], w.upper()])
            words.append(w)
        texts.append((i % 140, r.choice([" ", "-", "1", "ß¿"]).join(words)))
    texts += [(200, None), (201, ""), (None, "abcab " * 5), (202, "Straße Ärger ärger ÄRGER " * 4 + "x" * 50_000), texts[0]]
    n = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            n[changed(i, lower(run))] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    df = spark.createDataFrame(texts, "doc_id LONG, text STRING").withColumn("n", F.lit(1)).withColumn("word", F.lit("x"))
    got = spelling.spelling_variants(df).collect()
    assert len(got) == len(n) > 100
    assert {(x.word, x.n, x.n_near, x.form, x.form_n, x.root) for x in got} == brute_variants(n)


def test_spelling_words_of():
    """A result that the hash names as a run too keeps all its letters; what is no character ends a run."""
    text = "ddcfhdha ddchdha ddcfhdha"
    assert changed(1, "ddcfhdha") == "ddchdha" and changed(1, "ddchdha") != "ddchdha"
    for t in (text, text[::-1], "ddchdha ddcfhdha"):
        assert spelling.words_of("1", t.encode()) == Counter(changed(1, w) for w in t.split())
    assert spelling.words_of("1", b"abcdef\xffghijk") == Counter(changed(1, w) for w in ("abcdef", "ghijk"))


def test_spelling_chains_and_none(spark):
    n = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "zzzzz": 3, "zzzzy": 5}
    got = {x.word: x for x in spelling.variants(spark.createDataFrame(list(n.items()), "word STRING, n LONG")).collect()}
    assert got["aaaaa"].root == "bbbbb" and got["aaaaa"].form == "aaaab" and got["zzzzz"].form is None and got["zzzzz"].root == "zzzzz" and got["zzzzz"].n_near == 1
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id LONG, text STRING")).count() == 0


def test_pivots():
    r = random.Random(6)
    for _ in range(300):
        places = sorted(r.sample(range(9), 3))
        costs = [(p, r.randint(1, 9)) for p in places]
        cost = dict(costs)
        best = min(cost[a] + cost[b] for a in places for b in places if b - a >= 2)
        a, b = spelling.pivots_of(costs)
        assert b - a >= 2 and cost[a] + cost[b] == best


def test_spelling_query(spark, sf):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n = Counter(changed(i, lower(run)) for i, t in docs for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    got = queries.QUERIES["op13_spelling"](spark, sf).collect()
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if one_edit(w, x)] for w in sorted(n)[::10]}
    assert {x.word: x.n for x in got} == n
    for x in got:
        if x.word in near:
            best = min(near[x.word], key=lambda y: (-n[y], y), default=None)
            assert x.n_near == len(near[x.word]) and x.form == (best if best is not None and n[best] >= 2 * n[x.word] else None)
