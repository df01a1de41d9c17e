"""Packing and layout chunks against plain folds over random blocks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from argosy.operators import chunk, layout

WORDS = "aa bb. cc, dd! ee ff? Gg 12 3.4 é x".split(" ")


def words(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def folded(parts, size, measure, joiner, carry):
    out, held, used = [], [], 0
    for part in parts:
        n = measure(part)
        if held and used + n > size:
            out.append(joiner.join(held))
            tail = out[-1].split()[-carry:] if carry else []
            held, used = ([" ".join(tail)] if tail else []), len(tail)
        held.append(part)
        used += n
    return [*out, joiner.join(held)] if held else out


@pytest.mark.parametrize("size,carry", [(30, 0), (30, 8), (6, 20), (1, 3)])
def test_packed(spark, size, carry):
    r = random.Random(size)
    docs = [(i, [words(r, r.randint(1, 12)) if r.random() < 0.9 else r.choice(["", " ", "\n "]) for _ in range(r.randint(0, 30))]) for i in range(60)] + [(99, None), (98, ["x " * 5_000] * 3)]
    df = spark.createDataFrame(docs, "doc_id INT, p ARRAY<STRING>")
    got = {x.doc_id: x.c for x in df.select("doc_id", chunk.packed(F.col("p"), size, True, "\n", carry).alias("c")).collect()}
    assert got == {i: folded([x for x in p or [] if x.strip()], size, lambda s: len(s.split()), "\n", carry) for i, p in docs}
    got = {x.doc_id: x.c for x in df.select("doc_id", chunk.packed(F.col("p"), size, False, "\n\n").alias("c")).collect()}
    assert got == {i: folded([x for x in p or [] if x.strip()], size, len, "\n\n", 0) for i, p in docs}


def section_of(spark, texts):
    """What the library's own rules say about single blocks: (kind, title, type, rows)."""
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "text STRING").withColumn("kind", layout.tags.block_type(F.col("text")))
    head = F.when(F.col("kind") == "heading", layout.heading_of(F.col("text")))
    return {x.text: (x.kind, x.title, x.type, x.rows) for x in df.select("text", "kind", head["title"].alias("title"), head["type"].alias("type"), layout.table_rows(F.col("text")).alias("rows")).collect()}


def layout_folded(pages, known, size, overlap):
    blocks = [(p, b) for p, text in pages for b in (x.strip() for x in re.split(r"\n\s*\n", text)) if b]
    count = lambda s: len(s.split())
    out, held, used, label, section, skip = [], [], 0, ("", "other"), ("", "other"), False

    def close():
        text = "\n\n".join(t for t, _, _ in held)
        out.append((text.strip(), sorted({k for _, _, k in held}), sorted({p for _, p, _ in held}), label[0]))
        return text.split()

    for i, (page, text) in enumerate(blocks):
        if skip:
            skip = False
            continue
        kind, title, of, rows = known[text]
        if kind == "heading":
            section = section if title is None else (title, of)
            if i + 1 < len(blocks) and blocks[i + 1][0] == page:
                text, kind, skip = f"{text}\n\n{blocks[i + 1][1]}", "narrative", True
        if kind == "table":
            if held:
                close()
                held, used = [], 0
            rows = rows if count(" ".join(rows)) <= size else [x.strip() for x in rows]
            pieces = [rows] if count(" ".join(rows)) <= size or len(rows) < 2 else []
            for row in rows[1:] if not pieces or len(rows) > 1 and count(" ".join(rows)) > size else []:
                if pieces and sum(map(count, [*pieces[-1], row])) <= size:
                    pieces[-1].append(row)
                else:
                    pieces.append([rows[0], row])
            out += [("\n".join(p).strip(), ["table"], [page], section[0]) for p in pieces]
            continue
        parts = [text] if kind != "narrative" or count(text) <= size else folded([s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()], size, count, " ", 0)
        for part in parts:
            alone = kind in ("list", "heading", "note")
            if held and (alone or used + count(part) > size):
                tail = close()
                tail = tail[-overlap:] if overlap else []
                used, held = len(tail), [] if alone or not tail else [(" ".join(tail), held[-1][1], "narrative")]
            label = section if section[0] else label
            held.append((part, page, kind))
            used += count(part)
    if held:
        close()
    return out


@pytest.mark.parametrize("size,overlap", [(30, 5), (30, 0), (12, 20), (450, 100)])
def test_layout_chunks_random(spark, size, overlap):
    r = random.Random(overlap)

    def block():
        kind = r.choice(["head", "head", "list", "table", "table", "note", "text", "text", "text"])
        return {
            "head": re.sub(r"[.!?]", "", words(r, r.randint(1, 4))).strip() + "x", "list": f"- {words(r, 4)}\n- {words(r, 3)}", "note": f"Note 1: {words(r, 5)}",
            "table": "\n".join(" | ".join(words(r, r.randint(1, 3)) for _ in range(3)) + " 7" for _ in range(r.randint(2, 9))), "text": words(r, r.randint(3, 60)),
        }[kind]

    docs = {d: [(p, "\n\n".join(block() for _ in range(r.randint(0, 7)))) for p in range(1, r.randint(2, 6))] for d in range(60)}
    texts = {b for pages in docs.values() for _, t in pages for b in (x.strip() for x in re.split(r"\n\s*\n", t)) if b}
    known = section_of(spark, texts)
    got = {}
    rows = [(d, p, t) for d, pages in docs.items() for p, t in pages]
    for x in layout.layout_chunks(spark.createDataFrame(rows, "doc_id INT, page_number INT, text STRING"), size, overlap).orderBy("doc_id", "chunk_index").collect():
        assert x.chunk_index == len(got.setdefault(x.doc_id, []))
        got[x.doc_id].append((x.text, x.block_types, x.page_numbers, x.section_title))
    want = {d: layout_folded(pages, known, size, overlap) for d, pages in docs.items()}
    assert got == {d: c for d, c in want.items() if c}


def test_chunkers_stay_in_the_jvm(spark):
    pages = spark.createDataFrame([(1, 1, "Heading\n\nSome text. More of it.")], "doc_id INT, page_number INT, text STRING")
    docs = pages.drop("page_number")
    for df in (layout.layout_chunks(pages), chunk.paragraph_chunks(docs), chunk.sentence_chunks(docs, 5, 2), chunk.semantic_chunks(docs)):
        assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_rules_in_one_pass(spark):
    """Rules give the labels that their patterns give one by one."""
    from argosy.functions import tags

    assert tags.alternatives(r"\ba\b|(?:b|c)|d\|e|\(|f") == [r"\ba\b", "(?:b|c)", r"d\|e", r"\(", "f"]
    r = random.Random(1)
    vocab = "revenue operating income gross profit cash flow free eps diluted net data center machine learning regulator regulatory services service ai e.b.i.t. r&d r & d growth rate x é".split()
    texts = [r.choice([" ", "  ", "\n", "-"]).join(r.choice(vocab) + r.choice(["", "", "", ".", "s", "é", "_"]) for _ in range(r.randint(0, 25))) for _ in range(300)] + ["", None, "REVENUE and Cash Flow", "cash\nflow"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    for rules in (tags.METRICS, tags.TOPICS):
        got = {x.i: x.l for x in df.select("i", tags.all_rules(F.col("t"), rules).alias("l")).collect()}
        for i, t in enumerate(texts):
            want = list(dict.fromkeys(label for label, p in rules if t is not None and re.search(p, t.lower())))
            assert (got[i] or []) == want, t
