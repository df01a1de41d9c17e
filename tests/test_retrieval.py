"""Exact top k over skewed token lists, and the vector index: against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from argosy.operators import retrieve, vector_blocks, vector_index
from argosy.plans import catalogue

HELD = "chunk_id STRING, chunk_order LONG, t ARRAY<STRING>, grps ARRAY<STRING>"
ASKED = "qid STRING, grp STRING, q ARRAY<STRING>"


def brute_overlap(asked, held, k):
    out = set()
    for qid, grp, q in asked:
        found = sorted((-len(set(q) & set(t)), order, i) for i, order, t, grps in held if grp in grps)
        out |= {(qid, grp, i, round(-s / len(q), 9) if q else 0.0, rank) for rank, (s, _, i) in enumerate(found[:k], 1)}
    return out


@pytest.mark.parametrize("k", [1, 4])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_best_overlap(spark, seed, k):
    r = random.Random(seed)
    vocab = [f"t{i}" for i in range(40)]
    some = lambda n: list(dict.fromkeys(r.choices(vocab, [1 / (i + 1) ** 1.3 for i in range(40)], k=n)))
    held = [(f"c{i}", r.randrange(10**6) * 1000 + i, some(r.randint(0, 12)), r.sample(["a", "b", "all"], r.randint(1, 3))) for i in range(300)]
    asked = [(f"q{i}", r.choice(["a", "b", "all", "none"]), some(r.randint(1, 8)) + r.choice([[], ["unknown"]])) for i in range(40)] + [("empty", "a", [])]
    got = retrieve.best_overlap(spark.createDataFrame(asked, ASKED), spark.createDataFrame(held, HELD), k).collect()
    assert {(x.qid, x.grp, x.chunk_id, round(x.score, 9), x["rank"]) for x in got} == brute_overlap(asked, held, k)
    assert len(got) == len({(x.qid, x["rank"]) for x in got})


def test_best_overlap_work(spark):
    """Tokens that every chunk has bring no question and chunk together."""
    held = [(f"c{i}", i, ["report", "annual", "of", f"own{i}", f"half{i % 2}"], ["all"]) for i in range(2_000)]
    asked = [(f"q{i}", "all", ["report", "annual", "of", f"own{7 * i}", f"half{i % 2}"]) for i in range(100)]
    work = Observation()
    got = retrieve.best_overlap(spark.createDataFrame(asked, ASKED), spark.createDataFrame(held, HELD), 4, work).collect()
    assert {(x.qid, x.grp, x.chunk_id, round(x.score, 9), x["rank"]) for x in got} == brute_overlap(asked, held, 4)
    assert work.get["pairs"] <= 100 * 2_000 // 4
    # chunks alike are scored once for each question
    same = [(f"c{i}", i, ["report", "annual"], ["all"]) for i in range(2_000)]
    work = Observation()
    asked = [(f"q{i}", "all", ["report", "annual", f"x{i}"]) for i in range(100)]
    assert retrieve.best_overlap(spark.createDataFrame(asked, ASKED), spark.createDataFrame(same, HELD), 4, work).count() == 400
    assert work.get["pairs"] == 100


def test_retrieval_of_nothing(spark):
    none = spark.createDataFrame([], "chunk_id STRING, company STRING, text STRING, chunk_order LONG")
    q = spark.createDataFrame([("q", "what is it", None)], "qid STRING, sub_question STRING, company STRING")
    assert retrieve.retrieve(q, none).count() == 0 and retrieve.retrieve(q.limit(0), none).count() == 0
    one = spark.createDataFrame([("c", None, None, 1)], none.schema)
    assert [(r.chunk_id, r.score, r.distance) for r in retrieve.retrieve(q, one).collect()] == [("c", 0.0, 1.0)]


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 8)) * 3
    x = centres[r.integers(0, 12, 900)] + r.normal(size=(900, 8))
    x[300:600] = x[299]  # a third are copies
    rows = [(i, [float(a) for a in v], i % 3) for i, v in enumerate(x)] + [(9_000, None, 0)]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>, label INT")
    return df, df.filter("vec_id % 30 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def ranked(df):
    return {(r.query_id, r["rank"]): (r.vec_id, round(r.distance, 6)) for r in df.collect()}


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_index_exact(spark, clustered, metric):
    vectors, queries = clustered
    index = vector_index.measured(vector_index.build(vectors, 12, metric))
    for equal in ({}, {"label": 1}):
        want = ranked(retrieve.vector_top_k(queries, vectors, 5, metric, equal))
        assert ranked(vector_index.search(index, queries, 5, 2, exact=True, equal=equal)) == want
    near = ranked(vector_index.search(index, queries, 5, 4))
    whole = ranked(retrieve.vector_top_k(queries, vectors, 5, metric))
    assert sum(near.get(k, (None, None))[1] == v[1] for k, v in whole.items()) >= 0.9 * len(whole)


def test_index_stored(spark, clustered, tmp_path):
    vectors, queries = clustered
    index = vector_index.stored(vector_index.build(vectors, 12), str(tmp_path / "index"))
    assert index.vectors.count() == 900 and ranked(vector_index.search(index, queries, 5, 1, exact=True)) == ranked(retrieve.vector_top_k(queries, vectors, 5))
    found = vector_index.search(vector_index.opened(spark, str(tmp_path / "index")), queries.limit(1), 5, 1)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "dynamicpruning" in plan.lower()
    assert found.count() == 5


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id LONG, embedding ARRAY<FLOAT>")
    index = vector_index.measured(vector_index.build(none, 4))
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id LONG, q ARRAY<FLOAT>")
    assert vector_index.search(index, q, 5, 2, exact=True).count() == 0
    one = vector_index.measured(vector_index.build(spark.createDataFrame([(7, [1.0, 1.0])], "vec_id LONG, embedding ARRAY<FLOAT>"), 4))
    assert [tuple(r) for r in vector_index.search(one, q, 5, 2, exact=True).collect()] == [(1, 7, 1.0, 1)]
    with pytest.raises(ValueError):
        vector_index.build(none, 4, "dot")


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_index_recall(spark, folder):
    """Recall at 5 of the registered query against the exact one."""
    path = f"/root/testdata/{folder}"
    want = {(r.query_id, r.vec_id) for r in catalogue.QUERIES["vector_topk"](spark, path).collect()}
    got = {(r.query_id, r.vec_id) for r in catalogue.QUERIES["vector_topk_index"](spark, path).collect()}
    recall = len(want & got) / len(want)
    print(folder, recall)
    assert recall >= 0.9


@pytest.mark.parametrize("metric", ["l2sq", "dot"])
def test_blocks(spark, metric, monkeypatch):
    """Products of blocks against plain distances of all pairs, with copies and rows that no block holds; k rows a query and pair
    of blocks go on, where a pair of vectors each did."""
    monkeypatch.setattr(vector_blocks, "ROWS", 64)
    r = np.random.default_rng(7)
    x = [[float(a) for a in v] for v in r.integers(-2, 3, (300, 4)).astype(np.float32) * np.float32(0.1)]
    rows = list(enumerate(x)) + [(1_000 + i, x[5]) for i in range(40)] + [(None, x[5]), (2_000, [1.0, None, 0.0, 0.0]), (2_001, [float("nan")] * 4), (2_002, [1.0]), (2_003, [])]
    vectors = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>").repartition(3)
    queries = vectors.filter("vec_id % 10 = 0 OR vec_id > 1999").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    plain = vectors.join(queries).select("query_id", "vec_id", retrieve.distance(metric, F.col("q"), F.col("embedding")).alias("distance"))
    want = retrieve.top_k(plain, 5, "query_id", -F.col("distance"), ["vec_id"])
    rows_of = lambda df: sorted((str(a.query_id), a["rank"], str(a.vec_id), str(a.distance)) for a in df.collect())
    assert rows_of(retrieve.vector_top_k(queries, vectors, 5, metric)) == rows_of(want)
    good = lambda df, c: df.filter(F.forall(c, lambda a: a.isNotNull() & ~F.isnan(a)) & (F.size(c) == 4))
    handed = vector_blocks.candidates(good(queries, "q"), good(vectors, "embedding"), 5, metric, lambda a, b: retrieve.distance(metric, a, b)).count()
    assert handed <= 5 * 9 * good(queries, "q").count() < good(queries, "q").count() * good(vectors, "embedding").count()


def test_equal_sub_questions_are_looked_at_once(spark, monkeypatch):
    """The company of a sub-question that many questions share is looked for once, and every question gets its evidence."""
    from argosy.operators import research

    q = spark.createDataFrame([(i, f"What is revenue of Acme {i % 2} Ltd, and what is total debt?") for i in range(6)] + [(6, None)], "question_id INT, question STRING")
    chunks = spark.createDataFrame([(f"{c}-0", c, f"Acme {c} Ltd", f"revenue and total debt of Acme {c}") for c in range(2)], "chunk_id STRING, chunk_order INT, company STRING, text STRING")
    looked, real = [], retrieve.infer_company
    monkeypatch.setattr(retrieve, "infer_company", lambda questions, *more: (looked.append(questions.filter("sub_question IS NOT NULL").count()), real(questions, *more))[1])
    got = {(r.question_id, r.step, r["rank"]): (r.scope, r.chunk_id) for r in research.evidence(q, chunks).collect()}
    assert looked == [3]
    assert got == {(i, 1, 1): (f"Acme {i % 2} Ltd", f"{i % 2}-0") for i in range(6)} | {(i, 2, r): (None, f"{r - 1}-0") for i in range(6) for r in (1, 2)}


def test_names_of_all_lengths(spark):
    """The first name by code point that is part of the question, by brute force, whether names are shorter than a gram or not."""
    import random

    r = random.Random(5)
    word = lambda n: "".join(r.choice("abC é") for _ in range(n))
    for lengths in ((1, 2, 3), (9, 10, 12), (2, 7, 8, 9)):
        names = sorted({word(r.choice(lengths)) for _ in range(40)})
        asked = [word(r.randint(0, 6)) + r.choice(names) + word(r.randint(0, 6)) for _ in range(30)] + ["", "a", None]
        q = spark.createDataFrame(list(enumerate(asked)), "qid INT, sub_question STRING")
        got = {x.qid: x.company for x in retrieve.infer_company(q, spark.createDataFrame([(n,) for n in names], "company STRING")).collect()}
        assert got == {i: next((n for n in names if n.lower() in t.lower()), None) if t is not None else None for i, t in enumerate(asked)}


def test_columns_of_evidence(spark, sf, monkeypatch):
    """Chunks for evidence are made without the columns that no answer shows."""
    from argosy.operators import research
    from argosy.plans import catalogue

    monkeypatch.setattr(research, "evidence", lambda questions, chunks: chunks)
    assert set(catalogue.evidence(spark, sf).columns) == {"chunk_id", "chunk_order", "company", "doc_type", "section", "source_file", "text"}


def test_copies_do_not_fill_the_sample(spark):
    """Centroids are fitted on different vectors, however many copies of one stand first by hash."""
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 6)], "vec_id LONG, embedding ARRAY<FLOAT>")
    first = few.orderBy(F.xxhash64("embedding")).limit(1).crossJoin(spark.range(40)).select("vec_id", "embedding")
    centroids = vector_index.fit_centroids(few.unionByName(first), 5, "l2sq", sample=20)
    assert sorted(c[0] for c in centroids) == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_placed_rows(spark):
    """Vectors of length 1 are the same in Spark and in Python, whose sums go by the entries' order."""
    r = np.random.default_rng(3)
    x = r.normal(size=(50, 257))
    e = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "i INT, e ARRAY<DOUBLE>")
    got = np.array([a.x for a in e.orderBy("i").select(vector_index._placed(F.col("e"), "cosine").alias("x")).collect()])
    assert (got == vector_index._placed_rows(x, "cosine")).all() and (x == vector_index._placed_rows(x, "l2sq")).all()
    odd = spark.createDataFrame([([0.0, 0.0],), ([3.0, None],)], "e ARRAY<FLOAT>")
    assert [r.x for r in odd.select(vector_index._placed(F.col("e"), "cosine").alias("x")).collect()] == [[None, None]] * 2
    assert np.isnan(vector_index._placed_rows(np.array([[0.0, 0.0], [3.0, np.nan]]), "cosine")).all()


def test_equal_questions_are_searched_for_once(spark, monkeypatch):
    """Questions of the same tokens share a search, each gets its chunks; the copies of a vector don't all go to its cell's task."""
    from argosy.functions import hooks

    texts = ["total debt", "revenue sales", "default risk", "audit report"]
    chunks = spark.createDataFrame([(f"c{i:03}", texts[i % 4]) for i in range(400)], "vec_id STRING, text STRING").repartition(2)
    asked = [f"Debt {i}?" if i % 2 else f"REVENUE, {i}" for i in range(30)] + ["17", None, "nothing known"]
    q = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(asked)], "qid STRING, sub_question STRING")
    model = hooks.fit_embedding(chunks, 4_096)
    index = vector_index.measured(vector_index.build(hooks.embed(chunks, model=model).select("vec_id", "embedding"), 4, "cosine"))
    searched, real = [], vector_index.search
    monkeypatch.setattr(vector_index, "search", lambda index, queries, *more: (searched.append(queries.count()), real(index, queries, *more))[1])
    packed, sent = vector_blocks.packed, []
    monkeypatch.setattr(vector_blocks, "packed", lambda rows, most, copies=None: (sent.append(rows.count()) if copies else None, packed(rows, most, copies))[1])
    got = {}
    for r in vector_index.retrieve_by_embedding(q, index, model, 3, 4).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.chunk_id)
    known = hooks.embed(spark.createDataFrame([("nothing known",)], "text STRING"), model=model).first().embedding
    assert searched == [2 + any(known)] and sent[0] <= 2 * 4 * 3
    assert {k: v for k, v in got.items() if k != "q32"} == {f"q{i}": ["c000", "c004", "c008"] if i % 2 else ["c001", "c005", "c009"] for i in range(30)}
