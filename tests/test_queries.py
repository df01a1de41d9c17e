import hashlib

import pytest

import __spark_entry__ as entry
from argosy.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, same, name):
    df = catalogue.QUERIES[name](spark, sf)
    if name in catalogue.ORACLES:
        assert same(df, catalogue.ORACLES[name])
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_word_windows_all(spark, sf):
    """Every document with a word has all its windows, whatever its language; cut by brute force."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()
    got = {(r.doc_id, r.chunk_index): r.text_md5 for r in entry.queries()["word_windows_all"](spark, sf).collect()}
    want = {}
    for d in docs:
        words = (d.text or "").split()
        want |= {(d.doc_id, i): hashlib.md5(" ".join(words[a : a + 450]).encode()).hexdigest() for i, a in enumerate(range(0, len(words), 350))}
    assert got == want
    assert {d.lang for d in docs if (d.doc_id, 0) in got} > {"en"}


def test_stored_side(spark, sf):
    """The store holds the labelled documents, grows with them and is met; the manifest reports every document."""
    run = lambda name: entry.queries()[name](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labelled = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert labelled and not labelled & {r.doc_id for r in run("doc_hash_dedupe_stored").collect()}
    status = {r.doc_id: r.status for r in run("ingest_manifest_stored").collect()}
    assert set(status) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(status[i] in ("duplicate", "no_content") for i in labelled & set(status)) and "success" in status.values()
    first = docs.agg({"source": "min"}).first()[0]
    got = run("replaced_sources_whole").collect()
    assert len(got) == docs.count() and all((r.doc_id < 0) == (r.source == first) for r in got)
