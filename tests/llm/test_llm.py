"""The ten operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from argosy.llm import chat, components, decontaminate, html, langid, linedup, mix, neardup, quality, queries, shard, substring

DOCS = "doc_id LONG, text STRING, source STRING, lang STRING"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, x) for i, t, s, x in rows], DOCS)


def random_docs(seed, n=60, words=40):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(30)]
    base = [" ".join(r.choice(vocab) for _ in range(words)) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2, 8])):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, " ".join(w), f"s{i % 5}" if i % 7 else None, "en"))
    return rows + [(n, None, "s0", None), (n + 1, "", "s1", "en"), (n + 2, "w1", "s1", "en"), (n + 3, rows[0][1], "s2", "en"), (n + 4, " ".join(vocab * 400), "s3", "en")]


@pytest.fixture(scope="module")
def rows():
    return random_docs(1)


@pytest.mark.parametrize("name", ["op1_decontaminate", "op8_substring"])
def test_oracle(spark, sf, same, name):
    assert same(queries.QUERIES[name](spark, sf), queries.ORACLES[name])


def spans_of(row):
    return sorted((s["start"], s["end"]) for s in row)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_CHARS, 40])
def test_decontaminate(spark, rows, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    items = [(1, rows[0][1]), (2, "w1 w2"), (3, None), (4, rows[5][1] + " and more words"), (2, "w3 w3 w3"), (None, "w1")]
    got = decontaminate.decontaminate(docs_of(spark, rows).withColumn("N_Words", F.lit("clash")), spark.createDataFrame(items, "item_id INT, text STRING")).collect()
    windows = {}
    for i, t in items:
        w = decontaminate.words_of((t or "").encode()) if i is not None else []
        k = min(13, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + k]), set()).add(str(i))
    for r in got:
        w = decontaminate.words_of((r.text or "").encode())
        hit, found = set(), set()
        for p in range(len(w)):
            for k in {len(x) for x in windows}:
                if tuple(w[p : p + k]) in windows:
                    hit.update(range(p, p + k))
                    found |= windows[tuple(w[p : p + k])]
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(found))
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
        for m in r.matches:
            assert m["n_words"] >= 1


def test_decontaminate_empty(spark, rows):
    none = spark.createDataFrame([], "item_id INT, text STRING")
    assert {r.n_hit for r in decontaminate.decontaminate(docs_of(spark, rows), none).collect()} == {0}
    assert decontaminate.decontaminate(docs_of(spark, []), none).collect() == []


def targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(cap * sizes[s] for s in full)) / max(1e-9, sum(w[s] for s in free)) if free else 0
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else level * w[s] for s in names}
        full |= over


def test_mix(spark, rows):
    rows = rows + [(1000 + i, "x " * (i % 9 + 1), "s4", "en") for i in range(300)]
    d = docs_of(spark, rows).withColumn("SIZE", F.lit(0))
    got = mix.mix(d).collect()
    again = mix.mix(d).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want, taken = targets(sizes), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    # copies are whole, so half of a source's longest document can be missed
    longest = {s: max(r.size for r in got if r.source == s) for s in want}
    for s in want:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], longest[s] / 2), (s, taken[s], want[s])
    assert mix.mix(docs_of(spark, [])).collect() == []
    # the rates satisfy the token constraint before they are rounded
    sums = defaultdict(float)
    for r in got:
        sums[r.source] += r.rate * r.size
    for s in want:
        assert abs(sums[s] - want[s]) < 0.01 * max(1, want[s])


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">A, b, c</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, many, many, cookies.</p></div>
<div id="main-wrap"><div class="post-content"><h1>Head &amp; line</h1><p>First,   para &eacute;<br>more.<p>Second <b>bold</b> one, with, commas.</p>
<div class="ad">Buy, now, please, all, of, it.</div><ul><li>item one<li>item two</ul><form><p>Name, mail, text</p></form></div>
<aside><p>Other, things, to, read.</p></aside></div>
<section id="comments"><div class="comment"><p>Nice, very, nice, post, I, like, it, a, lot, really, so, much.</p></div></section>
<footer><p>&copy; x, y, z</p></footer></body></html>"""


def test_html():
    assert html.main_text(PAGE) == "Head & line\n\nFirst, para é more.\n\nSecond bold one, with, commas.\n\nitem one\n\nitem two"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav><p>a, b</p></nav>") == ""
    assert html.main_text("<article><p>a &lt; b</p><p>c") == "a < b\n\nc"
    assert html.main_text("<p>lost < bracket & amp</p>") == "lost < bracket & amp"


LONG = "A long paragraph, with commas, and many words that say what the page is about, line after line."
BESIDE = f"""<body><nav><a href="/">Home</a></nav><h1>Title</h1><p>The lead.</p><div class="share">Share, it</div>Bare <b>text</b> before.
<div>{f"<p>{LONG}</p>" * 4}</div><h2>Between</h2><pre>some code</pre><ul><li>point one<li>point two</ul><div><p>Closing words.</p></div>
<p><a href="/a">Link</a> <a href="/b">Other link</a></p><div><a href="/c">More</a><a href="/d">And more</a></div><h3>Trailing</h3><ul><li><a href="/e">Related</a></ul></body>"""


@pytest.mark.parametrize("wrap", ["{}", "<div id=outer>{}</div>"])
def test_html_beside_container(wrap):
    """Without article and main, headings, leads and text runs beside the best container or its wrapper stay."""
    page = BESIDE.replace(f"<div>{f'<p>{LONG}</p>' * 4}</div>", wrap.format(f"<div>{f'<p>{LONG}</p>' * 4}</div>"))
    want = ["Title", "The lead.", "Bare text before.", *[LONG] * 4, "Between", "some code", "point one", "point two", "Closing words."]
    assert html.main_text(page).split("\n\n") == want


def test_html_operator(spark):
    pages = spark.createDataFrame([(1, PAGE, "old"), (2, None, "old"), (1, PAGE, "old")], "page_id INT, html STRING, TEXT STRING")
    got = html.extract(pages).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, len(html.main_text(PAGE)))] * 2 + [(2, 0)]
    assert html.extract(pages.limit(0)).collect() == []


def test_html_drops_blocks_of_links():
    """Lists and paragraphs that are links go wherever they stand; a sentence with a link and a linked heading stay."""
    links = "<ul><li><a href=/x>Read this other story, now</a></li><li><a href=/y>And this one</a></li></ul>"
    body = f"<h1><a href=/t>Title</a></h1><p>{LONG}</p>{links}<p>See <a href=/z>the whole long report on it</a>.</p><p><a href=/w>More of this</a></p><ul><li>one<li><a href=/l>two</a><li>three, and more</ul>"
    want = ["Title", LONG, "See the whole long report on it.", "one", "two", "three, and more"]
    for page in (f"<body><article>{body}</article></body>", f"<body><div>{body}</div></body>", f"<main><div><div>{body}</div></div></main>"):
        assert html.main_text(page).split("\n\n") == want
    # the best of several containers wins, and an article keeps what scoring alone would leave out
    assert html.main_text(f"<div><p>Short.</p></div><article><header><h1>T</h1></header><p>Lead.</p><div>{f'<p>{LONG}</p>' * 3}</div><p>End</p></article>") == "\n\n".join(["Short.", "T", "Lead.", *[LONG] * 3, "End"])


@pytest.mark.parametrize("page", ["<a " * 100_000, "<a " * 100_000 + ">", "<div>" * 20_000 + "<p>a, b", "<b>" * 20_000 + "<p>a, b" * 5_000, "<div>" * 10_000 + "<li>x" * 10_000,
    "<div class=nav>" * 5_000 + "<h1>x</h1>" * 5_000, "<a " + "b" * 200_000 + ">", "<b><div>" + "<i>" * 20_000 + "</b>" * 20_000, "<!--" * 50_000, "<p>" + "&" * 200_000, "< " * 200_000])
def test_html_long_pages(page):
    """Work grows with the length of a page, whatever is left open in it."""
    import time

    began = time.time()
    html.main_text(page)
    assert time.time() - began < 3


def test_html_round_trip():
    """Random articles come back whole out of random pages around them."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghi") for _ in range(r.randint(2, 9)))
    said = lambda n: " ".join(word() + r.choice(["", "", "", ","]) for _ in range(n)) + "."
    noise = [
        lambda: f"<nav><ul><li><a href='/a'>{said(2)}</a><li><a href='/b'>{said(2)}</a></ul></nav>", lambda: f"<div class=\"ad\">{said(9)}</div>", lambda: f"<script>if (a < b) {{ {said(3)} }}</script>",
        lambda: f"<aside><p>{said(30)}</p></aside>", lambda: f"<form><p>{said(5)}</p><input name=x></form>", lambda: f"<!-- {said(4)} --><style>p {{}}</style>", lambda: f"<div id='comments'><p>{said(40)}</p></div>",
        lambda: f"<footer>&copy; {said(4)}</footer>", lambda: f"<div class='cookie-banner'><p>{said(12)}</p></div>", lambda: f"<ul><li><a href=x>{said(3)}</a></ul>",
    ]
    for _ in range(60):
        body, want = [], []
        for k in range(r.randint(4, 12)):
            t = said(r.randint(15, 60))
            kind = r.choice(["p", "p", "p", "h2", "li", "quote", "table"]) if k else "h1"
            t = said(3) if kind in ("h1", "h2") else t
            shown = t.replace(" ", r.choice([" ", "  ", "\n", "<br>", " <b>", "&#32;"]), 1)
            want.append(t)
            body.append({"p": f"<p>{shown}", "h1": f"<h1>{t}</h1>", "h2": f"<h2>{t}</h2>", "li": f"<ul><li>{t}</ul>", "quote": f"<blockquote><p>{t}</p></blockquote>", "table": f"<table><tr><td>{t}</td></tr></table>"}[kind])
            if r.random() < 0.3:
                body.append(r.choice(noise)())
        inside = r.choice(["<article>%s</article>", "<main><article class=post>%s</article></main>", "<div id=main><article>%s</article></div>"]) % "".join(body)
        page = "<html><body>" + "".join(r.choice(noise)() for _ in range(r.randint(0, 4))) + inside + "".join(r.choice(noise)() for _ in range(r.randint(0, 4))) + "</body></html>"
        assert html.main_text(page).split("\n\n") == want


TURNS = [("system", "Be brief."), ("user", "What is it?\nTell me."), ("assistant", "It is a long explanation of something.\nWith lines."), ("user", "Why?")]


def test_chat(spark):
    rows = [(c, i, r, t) for c in range(30) for i, (r, t) in enumerate(TURNS[c % 2 :])] + [(99, 0, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id INT, turn INT, role STRING, text STRING")
    model = chat.train(turns)
    marked = "\n".join(f"{r.title()}: {t}" for r, t in TURNS)
    assert model.parse(marked)[1] == TURNS
    assert chat.render(model.parse(marked)[1]).startswith("<|system|>\nBe brief.\n<|end|>\n<|user|>\n")
    assert model.parse(None) == model.parse("") == ([], [])
    out = chat.format_transcripts(chat.transcripts_of(turns), model).collect()
    right = [a == b for r in out for a, b in zip(r.line_roles, r.true_roles, strict=False)]
    assert len(out) == 31 and sum(right) > 0.9 * len(right)
    empty = turns.limit(0)
    assert chat.train(empty).parse("User: a\nAssistant: b")[0] == ["user", "assistant"]
    assert chat.transcripts_of(empty).collect() == []


def test_chat_held_out(spark, sf):
    """Most lines of conversations that were not trained on get their role, though every fifth turn has no marker."""
    out = [r for r in queries.op4_chat(spark, sf).collect() if r.held_out]
    assert out and sum(r.n_right for r in out) >= 0.85 * sum(r.n_lines for r in out)
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    assert {r.conv_id for r in queries.op4_chat(spark, sf).collect()} == {r.conv_id for r in turns.collect()}


def test_chat_forms_agree(spark):
    """Counting and parsing see the same form of a line."""
    lines = ["", " ", "\t", "Is it?\t", "\x0bUpper", " é?", "É", "x" * 61, "\r" + "y" * 119 + " ", "?", "\u00a0a"]
    got = spark.createDataFrame(list(enumerate(lines)), "i INT, x STRING").select("i", chat.form_column(F.col("x")).alias("f")).collect()
    assert {r.i: r.f for r in got} == {i: chat.form_of(x) for i, x in enumerate(lines)}


def test_chat_odd_rows(spark):
    """Clashing names, repeated rows and other roles."""
    rows = [(1, 0, "tool", "Hi."), (1, 1, "user", "What?"), (1, 1, "user", "What?"), (2, 0, None, None)]
    turns = spark.createDataFrame(rows, "conv_id INT, turn INT, role STRING, text STRING")
    model = chat.train(turns)
    t = chat.transcripts_of(turns).withColumn("Rendered", F.lit("old"))
    out = {r.conv_id: r for r in chat.format_transcripts(t.union(t), model).collect()}
    assert len(out) == 2 and out[1]["transcript"].count("What?") == 2 and out[1]["rendered"].startswith("<|") and [c.lower() for c in chat.format_transcripts(t, model).columns].count("rendered") == 1


def test_chat_blocks_by_place(spark, monkeypatch):
    """Repeated, null and sparse turns fill blocks by their place; rows without a conversation stand alone."""
    monkeypatch.setattr(chat, "BLOCK_TURNS", 4)
    rows = [(1, 0, "user", f"r{i}") for i in range(6)] + [(1, None, "user", "null"), (1, 5, "user", "five"), (1, 900, "user", "last")]
    rows += [(2, 1000 * i, "user", f"s{i}") for i in range(5)] + [(None, i % 2, "user", "same") for i in range(3)]
    out = chat.transcripts_of(spark.createDataFrame(rows, "conv_id INT, turn INT, role STRING, text STRING")).collect()
    assert sorted((r.conv_id or 0, r.block, sum(w in r.transcript for _, _, _, w in rows if w != "same") + r.transcript.count("same")) for r in out) == [(0, 0, 1)] * 3 + [(1, 0, 4), (1, 1, 4), (1, 2, 1), (2, 0, 4), (2, 1, 1)]


def test_viterbi_is_best(spark):
    import itertools

    turns = spark.createDataFrame([(c, i, r, t) for c in range(9) for i, (r, t) in enumerate(TURNS)], "conv_id INT, turn INT, role STRING, text STRING")
    m, r = chat.train(turns), random.Random(2)
    for _ in range(5):
        seen = [(r.choice([None, None, 0, 1, 2]), r.randrange(16)) for _ in range(4)]
        score = lambda p: m.start[p[0]] + sum(m.mark[s][a] + m.form[s][f] for s, (a, f) in zip(p, seen)) + sum(m.move[a][b] for a, b in zip(p, p[1:]))  # noqa: E731, B023, B905
        assert abs(score(m.viterbi(seen)) - max(map(score, itertools.product(range(6), repeat=4)))) < 1e-9


def base_counts(t):
    w = (t or "").encode().split()
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {q for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for q in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum((t or "").count(x) for x in quality.SYMBOLS), dup, len(covered)


def test_quality(spark, rows):
    rows = rows + [(2000, "a b\n \na b\nc # $\n\n", "s", "en"), (2001, "x " * 50, "s", "en"), (2002, "é ü\x0b1 2 3 4 5 6 7 8 1 2 3 4 5 6 7 8 9", "s", "en")]
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, None)], "doc_id LONG, quality INT, toxic INT")
    got = quality.judge(docs_of(spark, rows), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        n = base_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and (not r.base_failed or not r.kept)
    bare = quality.judge(docs_of(spark, rows), labels.limit(0)).collect()
    assert all(abs(r.score) < 1e-9 and r.kept == (not r.base_failed) for r in bare)
    assert quality.judge(docs_of(spark, []), labels).collect() == []


def test_quality_score(spark, rows):
    """The score and the verdict, by counting the hashed words and pairs once more."""
    import math

    import xxhash

    signed = lambda h: h - 2**64 if h >= 2**63 else h
    word = lambda w: signed(xxhash.xxh64(w, seed=42).intdigest())
    number = lambda n, seed: signed(xxhash.xxh64((n % 2**64).to_bytes(8, "little"), seed=seed % 2**64).intdigest())

    def grams(t):
        h = [word(w) for w in (t or "").encode().split()]
        return h + [number(b, number(a, 42)) for a, b in zip(h, h[1:], strict=False)]

    rows = [*rows, (3000, "toxic words " * 3 + "w1 w2 w3 " * 9, "s", "en")]
    labels = [(i, int(i % 2 == 0), int(i % 10 == 0)) for i in range(0, 40, 2)] + [(None, 1, 0)]
    good = {i for i, q, x in labels if q == 1 and x == 0 and i is not None}
    raw, target = Counter(), Counter()
    for i, t, *_ in rows:
        raw.update(g % quality.BUCKETS for g in grams(t))
        if i in good:
            target.update(g % quality.BUCKETS for g in grams(t))
    share = [quality.SMOOTHING + raw[b] for b in range(quality.BUCKETS)]
    whole, seen, prior = sum(share), sum(target.values()), quality.PRIOR * quality.BUCKETS
    ratio = [math.log((target[b] + prior * share[b] / whole) / (seen + prior)) - math.log(share[b] / whole) for b in range(quality.BUCKETS)]
    for threshold in (quality.THRESHOLD, 0.0):
        out = quality.judge(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT"), threshold).collect()
        for r in out:
            g = grams(r.text)
            score = sum(ratio[x % quality.BUCKETS] for x in g) / len(g) if g else 0.0
            assert abs(r.score - score) < 1e-9 and r.kept == (not r.base_failed and r.score >= threshold)


def test_quality_rejects_junk(spark):
    r = random.Random(5)
    vocab = ["word%d" % i for i in range(200)]
    rows = [(i, " ".join(r.choice(vocab) + ("%%%" if i % 4 == 0 else "") for _ in range(300)), "s", "en") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 200, 3)], "doc_id LONG, quality INT, toxic INT")
    got = {x.doc_id: x.kept for x in quality.judge(docs_of(spark, rows), labels).collect()}
    assert all(got[i] == (i % 4 > 0) for i in got)


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def classes(items, linked):
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(items):
        for b in items[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in items}


def test_edit_distance(spark):
    r = random.Random(3)
    pairs = []
    for i in range(150):
        a = [r.choice("abé") for _ in range(r.randint(0, 30))]
        b = list(a)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randint(0, 1)] = [r.choice("abé")] * r.randint(0, 1)
        pairs.append((i, i, "".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a LONG, b LONG, x STRING, y STRING")
    for t in (1, 2):
        lines = [spark.createDataFrame([(p[0], p[k]) for p in pairs], "id LONG, line STRING") for k in (2, 3)]
        both = linedup.trimmed(df).withColumn("may", linedup.may_match("x", "y", t))
        chars = both.withColumns({c: F.array_remove(F.split(c, ""), "") for c in "xy"})
        got = {x.a: (x.may, x.ok) for x in chars.select("a", "may", linedup.within("x", "y", t).alias("ok")).collect()}
        for i, _, a, b in pairs:
            assert got[i][1] == (edits(a, b) <= t) and (got[i][0] or not got[i][1])
        assert lines


def test_linedup(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(12, 40))) for _ in range(8)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(4):
            x = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                k = r.randrange(len(x))
                x[k : k + r.randint(0, 1)] = [r.choice("abcdefgh")]
            lines.append("".join(x))
        rows.append((i, "\n".join([*lines, "", "short", "short"]), "s", "en"))
    rows += [(100, None, "s", "en"), (101, "", "s", "en"), (102, base[0] + "\n" + base[0], "s", "en")]
    occ, first = [], {}
    for i, t, _, _ in rows:
        for p, x in enumerate((t or "").split("\n")):
            if x.strip():
                occ.append((i, p, x))
                first.setdefault(x, (i, p))
    of = classes(sorted(first), lambda a, b: min(len(a), len(b)) >= linedup.MIN_LENGTH and edits(a, b) <= 2)
    best = {}
    for x, at in first.items():
        best[of[x]] = min(best.get(of[x], at), at)
    gone = defaultdict(list)
    for i, p, x in occ:
        if best[of[x]] != (i, p):
            gone[i].append(p)
    out = linedup.drop_repeated_lines(docs_of(spark, rows)).collect()
    assert {r.doc_id: list(r.removed) for r in out} == {i: sorted(gone[i]) for i, *_ in rows}
    equal = {(i, p) for i, p, x in occ if best[of[x]] != (i, p) and best[of[x]] == first[x]}
    assert {r.doc_id: r.n_near for r in out} == {i: sum((i, p) not in equal for p in gone[i]) for i, *_ in rows}
    left = linedup.without_repeated_lines(docs_of(spark, rows).withColumn("N_Near", F.lit("x"))).collect()
    assert {r.doc_id: r.text for r in left} == {i: t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t, *_ in rows}
    shared = linedup.drop_repeated_lines(docs_of(spark, [(None, base[0], "s", "en"), (1, base[0], "s", "en"), (1, base[0], "s", "en")])).collect()
    assert {(r.doc_id, r.n_removed, tuple(r.removed)) for r in shared} == {(None, 0, ()), (1, 2, (0,))}
    assert linedup.drop_repeated_lines(docs_of(spark, [])).collect() == []


@pytest.mark.parametrize("few", [16, 10**6])
def test_linedup_hot_segments(spark, monkeypatch, few):
    """Lines that share a long middle, or all but two words, are not compared all with all, and no link between them is lost."""
    monkeypatch.setattr(linedup, "FEW", few)
    r = random.Random(8)
    shared = "a middle that every one of these lines has in common"
    abc = "abcdefghijklmnopqrstuvwxyz"
    lines = ["".join(r.choice(abc) for _ in range(25)) + shared + "".join(r.choice(abc) for _ in range(25)) for _ in range(250)]
    words = ["".join(r.choice(abc) for _ in range(5)) for _ in range(24)]
    for _ in range(250):
        w = list(words)
        for k in r.sample(range(24), 3):
            w[k] = "".join(r.choice(abc) for _ in range(5))
        lines.append(" ".join(w))
    planted = []
    for x in r.sample(lines, 60):
        y = list(x)
        for _ in range(r.choice([1, 2, 2, 3])):
            k = r.randrange(len(y))
            y[k : k + r.choice([0, 1, 1])] = r.choice([[], [r.choice(abc)]])
        planted.append("".join(y))
    lines = sorted(set(lines + planted))
    made = []
    verified = linedup.verify
    monkeypatch.setattr(linedup, "verify", lambda pairs, texts, t: made.append(pairs.count()) or verified(pairs, texts, t))
    got = {x.node: x.component for x in linedup.line_classes(spark.createDataFrame(list(enumerate(lines)), "id LONG, line STRING")).collect()}
    # two lines within 2 edits differ in at most 2 of their words or lie within 2 of their counts of characters
    of = [Counter(x) for x in lines]
    near = lambda a, b: abs(len(lines[a]) - len(lines[b])) <= 2 and sum(((of[a] - of[b]) | (of[b] - of[a])).values()) <= 4 and edits(lines[a], lines[b]) <= 2
    want = classes(range(len(lines)), near)
    size = Counter(want.values())
    assert got == {x: c for x, c in want.items() if size[c] > 1} and len(got) > 40
    assert sum(made) < 40 * len(lines)


@pytest.mark.parametrize(("copies", "cell_rows"), [(0, 10**6), (3000, 10**6), (3000, 1)])
def test_shard(spark, rows, monkeypatch, copies, cell_rows):
    monkeypatch.setattr(shard, "CELL_ROWS", cell_rows)
    rows = rows + [(5000 + i, "hot copy", "s", "en") for i in range(copies)] + [rows[0]]
    got = shard.shard(docs_of(spark, rows).withColumn("Slot", F.lit("x"))).collect()
    key = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    order = sorted((key(t or ""), key(str(i)), i, len((t or "").encode()) + 8) for i, t, _, _ in rows)
    total, before, want = sum(x[3] for x in order), 0, []
    for n, (a, b, i, size) in enumerate(order):
        if n and (a, b) != order[n - 1][:2]:
            before = sum(x[3] for x in order[:n]) if copies == 0 else before + group
        group = size if not n or (a, b) != order[n - 1][:2] else group + size
        want.append((i, 24 * before // total))
    assert sorted((r.doc_id, r.shard) for r in got) == sorted(want)
    assert (shard.slice_bits(len(rows), cell_rows) > 0) == (cell_rows == 1)
    slots = defaultdict(list)
    for r in sorted(got, key=lambda r: (key(r.text or ""), key(str(r.doc_id)), r.slot)):
        slots[r.shard].append(r.slot)
    assert all(x == sorted(x) for x in slots.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert shard.shard(docs_of(spark, [])).collect() == []


def test_shard_query(spark, sf):
    got = queries.op7_shard(spark, sf).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 8 for r in got)
    assert len(got) == len(text) and {r.law for r in got} == {"bytes"}


def test_substring(spark, rows):
    shuffled = rows + [(None, rows[0][1], "s", "en"), rows[3]]
    random.Random(1).shuffle(shuffled)
    got = substring.remove_repeats(docs_of(spark, shuffled).withColumn("n_words", F.lit("x"))).collect()
    least = {}
    for i, t, _, _ in shuffled:
        w = (t or "").encode().split()
        for p in range(len(w) - 12):
            if i is not None:
                g = tuple(w[p : p + 13])
                least[g] = min(least.get(g, i), i)
    assert len(got) == len(shuffled)
    for r in got:
        w = (r.text or "").encode().split()
        gone = {q for p in range(len(w) - 12) if r.doc_id is not None and least[tuple(w[p : p + 13])] < r.doc_id for q in range(p, p + 13)}
        assert (r.n_words, r.n_removed, r.kept_text) == (len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone).decode())
    assert substring.remove_repeats(docs_of(spark, [])).collect() == []


def test_substring_text_ids(spark, rows):
    """Ids that are texts remove by their order."""
    d = docs_of(spark, rows)
    want = {f"{r.doc_id:05d}": r.kept_text for r in substring.remove_repeats(d).collect()}
    got = substring.remove_repeats(d.withColumn("doc_id", F.format_string("%05d", "doc_id"))).collect()
    assert {r.doc_id: r.kept_text for r in got} == want


def windows_of(rows, window=13):
    import pyarrow as pa

    ids, texts = zip(*rows, strict=True)
    return next(substring.block_windows(pa.record_batch({"_id": pa.array(ids, pa.int64()), "_t": pa.array(texts, pa.string())}), window))


def test_substring_spreads_copies():
    """Blocks with copies of one text do not all send their settled windows to one bucket."""
    import numpy as np

    r = random.Random(6)
    copy, none = " ".join("c%d" % r.randrange(9999) for _ in range(40)), np.zeros(0, np.uint64)
    load = Counter()
    for b in range(40):
        for bucket, to, _, starts in substring.routed(windows_of([(100 * b + i, copy) for i in range(30)]), 16, 4, none):
            if to is not None:
                load[bucket] += len(substring.unpack_starts(starts)[0])
    seen = sum(load.values())
    assert seen == 40 * 29 * 28 and max(load.values()) < 0.25 * seen


def test_substring_splits_heavy_anchors(spark, monkeypatch):
    import numpy as np

    r = random.Random(7)
    # the smallest of many three-word hashes stands in every text, so nearly all windows meet there
    hot = min((" ".join("h%d" % r.randrange(9999) for _ in range(3)) for _ in range(3000)), key=lambda x: int(windows_of([(1, x)], 3)[3][0]))
    texts = [(i, " ".join("t%d" % r.randrange(10**6) for _ in range(10)) + f" {hot} " + " ".join("t%d" % r.randrange(10**6) for _ in range(10))) for i in range(300)]
    texts += [(1000 + i, t) for i, t in texts[:20]]
    block = windows_of(texts)
    d = docs_of(spark, [(i, t, "s", "en") for i, t in texts]).selectExpr("doc_id AS _id", "text AS _t")
    heavy = substring.heavy_anchors(d, 13, 1.0, 1000)
    assert len(heavy) == 1
    share = lambda h: max(len(x[2]) for x in substring.routed(block, 16, 4, h) if x[2]) / sum(len(x[2]) for x in substring.routed(block, 16, 4, h) if x[2])
    assert share(np.zeros(0, np.uint64)) > 0.9 and share(heavy) < 0.2
    monkeypatch.setattr(substring, "HEAVY_WINDOWS", 1000)
    got = {x.doc_id: x.n_removed for x in substring.remove_repeats(docs_of(spark, [(i, t, "s", "en") for i, t in texts])).collect()}
    assert got == {i: 23 if i >= 1000 else 0 for i, _ in texts}


def test_langid(spark, sf):
    got = queries.op9_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)
    d = docs_of(spark, [(1, "the cat and the dog", "s", "en"), (2, "der hund und die katze", "s", "de"), (3, None, "s", "en"), (4, "123 !", "s", None), (5, "der mann", "s", None)])
    out = {r.doc_id: r.lang_pred for r in langid.identify(d, langid.train(d)).collect()}
    assert out == {1: "en", 2: "de", 3: "und", 4: "und", 5: "de"}
    assert {r.lang_pred for r in langid.identify(d, langid.train(d.limit(0))).collect()} == {"und"}
    assert {r.lang_pred for r in langid.identify(d, langid.train(d.limit(1))).collect()} == {"en", "und"}


def test_langid_by_counting(spark):
    """Predictions and scores of all rows, by counting trigrams in plain loops; clashing names, repeated rows, no rows."""
    import math

    r = random.Random(12)
    words = {"aa": "lo mi ta ru", "bb": "schön grün weiß", "cc": "été garçon là", "dd": "ñu año sí"}
    rows = [(i, " ".join(r.choice(words[x].split()) for _ in range(r.randint(3, 12))), "s", x) for i, x in enumerate(sorted(words) * 8)]
    asked = rows + [(100, "lo grün là año", "s", None), (101, "", "s", "aa"), (102, "9 9 9", "s", "aa"), (103, "x", "s", None), rows[0], (104, "lo " * 5000, "s", None)]

    def count(text):
        b, out = b" " + text.lower().encode() + b" ", Counter()
        for k in range(len(b) - 2):
            out[(int.from_bytes(b[k : k + 3], "big") * 0x9E3779B1 % 2**32) >> 19] += 1
        return out

    total = {x: sum((count(t) for _, t, _, y in rows if y == x), Counter()) for x in sorted(words)}
    share = {x: [(c[b] + langid.SMOOTHING) / (sum(c.values()) + langid.SMOOTHING * langid.BUCKETS) for b in range(langid.BUCKETS)] for x, c in total.items()}
    code, langs = langid.codewords(4), sorted(words)
    weights, weigh = [], []
    for k in range(code.shape[1]):
        side = [[share[x] for i, x in enumerate(langs) if code[i, k] == s] for s in (1, -1)]
        weights.append([math.log(sum(a) / len(a)) - math.log(sum(b) / len(b)) for a, b in zip(zip(*side[0], strict=True), zip(*side[1], strict=True), strict=True)])
        weigh.append(sum(abs(sum(p * w for p, w in zip(share[x], weights[-1], strict=True))) for x in langs) / 4)
    weigh = [w / sum(weigh) for w in weigh]
    model = langid.train(docs_of(spark, rows))
    out = langid.identify(docs_of(spark, asked).withColumn("SCORE", F.lit("old")), model).collect()
    assert len(out) == len(asked)
    for row in out:
        if not any(c.isalpha() for c in row.text):
            assert (row.lang_pred, row.score) == ("und", 0.0)
            continue
        c = count(row.text)
        margin = [langid.SHARPNESS * sum(w[b] * n for b, n in c.items()) / sum(c.values()) for w in weights]
        loss = [sum(g * math.log1p(math.exp(-code[i, k] * m)) for k, (m, g) in enumerate(zip(margin, weigh, strict=True))) for i in range(4)]
        near = [math.exp((min(loss) - v) * len(weigh)) for v in loss]
        assert row.lang_pred == langs[loss.index(min(loss))] and abs(row.score - max(near) / sum(near)) < 1e-4
    assert langid.identify(docs_of(spark, []), model).collect() == []


def test_codewords():
    for n in (2, 3, 7, 9):
        code = langid.codewords(n)
        assert len({tuple(x) for x in code}) == n and code.shape[0] == n


def sets_of(rows, k):
    out = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        out[i] = set(zip(*(w[j:] for j in range(k)), strict=False)) if len(w) >= k else {tuple(w)} - {()}
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_neardup(spark, rows, k):
    sets = sets_of(rows, k)
    link = lambda a, b: bool(sets[a] & sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    want = classes(sorted(sets), link)
    got = neardup.near_duplicates(docs_of(spark, rows + [(None, rows[0][1], "s", "en")]), shingle=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {i: (len(sets[i]), want[i]) for i in sets}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = neardup.drop_near_duplicates(docs_of(spark, rows + [rows[0]]), shingle=k).collect()
    assert sorted(r.doc_id for r in left) == sorted(set(want.values()))


def test_neardup_empty(spark):
    assert neardup.near_duplicates(docs_of(spark, [])).collect() == []


def test_super_min_hash():
    import numpy as np

    from argosy.llm.wordhash import mix as scramble

    a = scramble(np.arange(1, 401, dtype=np.uint64))
    sig = neardup.super_min_hash([a[:300], a[100:400], a[:1], a[:0]], 150)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.12 and np.isfinite(sig[:3]).all() and np.isinf(sig[3]).all()
    # by its definition: every element meets every place once
    for s in (a[:3], a[:20]):
        out = np.full(12, np.inf)
        for e in s:
            p = list(range(12))
            for j in range(12):
                x = int(scramble(np.array([e + np.uint64((2 * j + 1) * 0xD1B54A32D192ED03 % 2**64)]))[0])
                q = j + (((x & 0xFFFFFF) * (12 - j)) >> 24)
                p[j], p[q] = p[q], p[j]
                out[p[j]] = min(out[p[j]], (x >> 24) / 2.0**40 + j)
        assert (neardup.super_min_hash([s], 12)[0] == out).all()


def test_components(spark):
    r = random.Random(6)
    links = [(i, i + 1) for i in range(200, 260)] + [(r.randrange(100), r.randrange(100)) for _ in range(60)] + [(300, i) for i in range(301, 400)]
    nodes = sorted({x for e in links for x in e if e[0] != e[1]})
    pairs = {tuple(sorted(e)) for e in links}
    want = classes(nodes, lambda a, b: (b, a) in pairs or (a, b) in pairs)
    got = components.components(spark.createDataFrame(links, "a LONG, b LONG")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    step = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, sf).cache()
        kept[name] = step
        if name != "sharding":
            assert step.columns == docs.columns
    n = {k: v.count() for k, v in kept.items()}
    assert 0.6 * docs.count() < n["quality_rules"] < docs.count() and n["near_dedup"] < n["quality_rules"] and 0 < n["decontamination"] <= n["near_dedup"]
    sets = sets_of([(r.doc_id, r.text) for r in kept["quality_rules"].collect()], 5)
    want = classes(sorted(sets), lambda a, b: bool(sets[a] & sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert sorted(r.doc_id for r in kept["near_dedup"].collect()) == sorted(set(want.values()))
    assert n["sharding"] == n["mixing"] and {"shard", "slot", "size"} <= set(kept["sharding"].columns)


def test_pipeline_odd_rows(spark, tmp_path):
    """Every stage keeps columns whatever their names are, and takes nulls, empty and repeated rows and empty tables."""
    import corpus_pipeline

    r = random.Random(11)
    text = lambda n: " ".join("v%d" % r.randrange(500) for _ in range(n))
    rows = [(i, text(40), f"s{i % 3}", "en") for i in range(40)] + [(None, text(40), None, None), (50, None, "s0", None), (51, "", "s1", "en"), (3, text(40), "s1", "en"), (60, text(20_000), "s2", "en")]
    clash = "score n_words kept _n copies target contaminated component_id rate size_ _row".split()
    docs = docs_of(spark, rows).withColumns({c: F.lit(f"own {c}") for c in clash})
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id LONG, quality INT, toxic INT")
    bench = spark.createDataFrame([(1, rows[5][1])], "item_id LONG, text STRING")
    for name, df in (("labels", labels), ("benchmark", bench)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    for start in (docs, docs.limit(0)):
        step = start
        for name, stage in corpus_pipeline.STAGES:
            step = stage(spark, step, str(tmp_path)).cache()
            assert set(docs.columns) <= set(step.columns) and (name == "sharding" or step.columns == docs.columns), name
            assert all(x[c] == f"own {c}" for x in step.collect() for c in clash), name
            ids = {x.doc_id for x in step.collect()}
            if start is docs:
                assert 1 in ids and None in ids or name in ("mixing", "sharding")
                assert not ids & {50, 51} and (5 in ids) == (name in ("quality_rules", "near_dedup"))
