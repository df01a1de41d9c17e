"""The chunk store, ingest of folders and streams."""

import pytest
from pyspark.sql import functions as F

from argosy.sources import store
from argosy.streaming.ingest import ingest_folder, ingest_stream

CHUNK = "collection STRING, source STRING, text STRING, n INT"
REPORT = "Northwind Trading Ltd\nAnnual Report 2023\n\nRisk Factors\n\nDebt rose to $5 million. Liquidity fell.\n\nNorthwind Trading Ltd sells tea."


def rows(df):
    return sorted((str(r.collection), str(r.source), r.text, r.n) for r in df.collect())


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    make = lambda data: spark.createDataFrame(data, CHUNK)
    assert store.read(spark, path) is None and store.version(spark, path) == -1
    one = [("1", "a", "x", 1), ("1", "b", "y", 2), (None, "a", "z", 3), ("", None, "w", 4)]
    assert store.append(make(one), path, "b0")
    want = sorted((c or "unknown", str(s), t, n) for c, s, t, n in one)
    assert rows(store.read(spark, path)) == want
    # a batch that is in changes nothing
    assert not store.append(make(one), path, "b0") and rows(store.read(spark, path)) == want
    assert store.append(make([("1", "a", "more", 5)]), path, "b1")
    before = store.read(spark, path)
    old = rows(before)
    assert old == sorted([*want, ("1", "a", "more", 5)])
    # replacing touches the partitions of its sources only, and a reader from before sees what it saw
    assert store.replace(make([("1", "a", "new", 6), ("2", "c", "other", 7)]), path, "b2")
    assert rows(before) == old and rows(store.read(spark, path, 1)) == old
    now = sorted([*(r for r in want if r[:2] != ("1", "a")), ("1", "a", "new", 6), ("2", "c", "other", 7)])
    assert rows(store.read(spark, path)) == now
    written = {(r.collection, r.source) for r in spark.read.option("basePath", path + "/data").schema(CHUNK).parquet(path + "/data/commit=2").collect()}
    assert written <= {("1", "a"), ("2", "c"), ("1", "b")}
    assert not store.replace(make([("1", "a", "again", 8)]), path, "b2") and rows(store.read(spark, path)) == now
    # nothing to write, and a source that goes with nothing in its place
    assert store.append(make([]), path) and rows(store.read(spark, path)) == now
    assert store.vacuum(spark, path) == [1, 3] or store.vacuum(spark, path) == []
    assert rows(store.read(spark, path)) == now


def test_store_after_a_failure(spark, tmp_path):
    """Files of a commit without a manifest do not count and are written over."""
    path = str(tmp_path / "store")
    make = lambda t: spark.createDataFrame([("c", "a", t, 1)], CHUNK)
    store.append(make("one"), path)
    make("lost").withColumn("bucket", F.lit(3)).write.partitionBy("collection", "bucket").parquet(path + "/data/commit=1")
    (tmp_path / "store" / "manifests" / "v=1").mkdir()
    assert rows(store.read(spark, path)) == [("c", "a", "one", 1)] and store.version(spark, path) == 0
    assert store.replace(make("two"), path)
    assert rows(store.read(spark, path)) == [("c", "a", "two", 1)] and store.version(spark, path) == 1


def test_ingest_folder(spark, tmp_path):
    src, path = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    (src / "annual_report_2023.txt").write_text(REPORT)
    (src / "copy.txt").write_text(REPORT)
    (src / "skip.csv").write_text("a,b")
    (src / "empty.txt").write_text(" \n")
    run = lambda **how: {r.doc_id: (r.status, r.chunks > 0) for r in ingest_folder(spark, str(src), path, "c", 2026, "s1", **how).collect()}
    run(batch="1")
    held = store.read(spark, path)
    assert {r.source for r in held.collect()} == {"annual_report_2023.txt"} and len(held.columns) >= 56
    first = held.orderBy("chunk_index").first()
    assert (first.company_name, first.financial_year, first.analysis_id, first.collection) == ("Northwind Trading Ltd", 2023, "s1", "c")
    n = held.count()
    (src / "notes.txt").write_text("Other text of 1999.")
    assert run()["annual_report_2023.txt"][0] == "duplicate"
    assert {r.source for r in store.read(spark, path).collect()} == {"annual_report_2023.txt", "notes.txt"}
    (src / "annual_report_2023.txt").write_text(REPORT + " And coffee.")
    run(force=True)
    now = store.read(spark, path)
    assert now.filter("source = 'annual_report_2023.txt' AND text LIKE '%coffee%'").count() >= 1
    assert now.filter("source = 'annual_report_2023.txt'").count() >= n and now.groupBy("chunk_id", "source").count().filter("count > 1").isEmpty()


def test_ingest_stream(spark, tmp_path):
    src, path, seen = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "cp")
    src.mkdir()
    run = lambda: ingest_stream(spark, str(src), path, seen).awaitTermination(90)
    (src / "a.txt").write_text("one two three")
    (src / "b.txt").write_text("one two three")
    (src / "table.csv").write_text("no text")
    run()
    (src / "c.txt").write_text("one two three")
    (src / "d.txt").write_text("four")
    run()
    (src / "e.txt").write_text("four")
    (src / "f.txt").write_bytes(b"five \xff six")
    run()
    held = store.read(spark, path)
    assert sorted(r.text for r in held.collect()) == ["five six", "four", "one two three"]
    # a batch that ended in the store but not in the stream's log is run again and changes nothing
    commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    for crc in (tmp_path / "cp" / "commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    run()
    assert sorted(r.text for r in store.read(spark, path).collect()) == ["five six", "four", "one two three"]


@pytest.mark.parametrize("name", ["7", "a/b c", "ü"])
def test_store_names(spark, tmp_path, name):
    path = str(tmp_path / "s")
    store.append(spark.createDataFrame([(name, name, "x", 1)], CHUNK), path)
    assert rows(store.read(spark, path)) == [(name, name, "x", 1)]
