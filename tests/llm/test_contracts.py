"""Parts of articles that look like what surrounds them, and rows without ids, as the contracts want them."""

import pytest

from argosy.llm import html

LONG = "A long paragraph, with commas, and many words that say what the page is about, line after line."
SHARE = "The share price rose by a tenth, and the other one, of which less was known, fell all day long."
CITED = ["Smith, J. (2020). On whales and other large animals of the sea", "Jones, A. (2021). On the fish that live in the deep sea"]
KEPT = {
    "headed list of links": ("<h2>References</h2><ul><li><a href=a>Smith, On whales</a></li><li><a href=b>Jones, On fish</a></li></ul>", ["References", "Smith, On whales", "Jones, On fish"]),
    "list of long links": ("<ul>" + "".join(f"<li><a href=a>{x}</a></li>" for x in CITED) + "</ul>", CITED),
    "table with linked column": ("<table><tr><td><a href=a>Berlin</a></td><td>3.6</td></tr><tr><td><a href=b>Hamburg</a></td><td>1.8</td></tr></table>", ["Berlin", "3.6", "Hamburg", "1.8"]),
    "paragraph of one link": ("<p><a href=a>The whole report can be read in the archive</a></p>", ["The whole report can be read in the archive"]),
    "marks inside longer names": (f"<section class='body related-work'><h2>Related work</h2><p>{LONG}</p></section><section id=comments-on-method><p>{LONG}</p></section>", ["Related work", LONG, LONG]),
    "mark on a paragraph with a text": (f"<p class=share>{SHARE}</p>", [SHARE]),
    "formula": ("<p>We write <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='application/x-tex'>x=2</annotation></math> here.</p>", ["We write x=2 here."]),
    "nothing of gadgets": (
        f"<div class='comment-list'><p>{LONG}</p></div><div class=share-buttons><a href=a>Tweet</a> it</div><form><p>Your mail</p><input></form><ul class='nav-menu'><li>a<li>b</ul><div id='sidebar-1'>{LONG}</div>"
        f"<ul><li><a href=x>Home</a><li><a href=y>More</a></ul><p><a href=z>Read on</a></p><div class='ad banner-2'>{LONG}</div><div role=navigation>{LONG}</div>",
        [],
    ),
}


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div>%s</div>", "<form action=x><input type=hidden name=v><nav><a href=/>Home</a></nav><div>%s</div><button>Go</button></form>", "<div class='menu-wrap'><article>%s</article></div>"])
@pytest.mark.parametrize("case", KEPT)
def test_html_keeps(case, wrap):
    body, want = KEPT[case]
    assert html.main_text("<html><body>" + wrap % (f"<p>{LONG}</p>" * 4 + body) + "</body></html>").split("\n\n") == [LONG] * 4 + want


def test_html_table_alone():
    assert html.main_text("<table><tr><th>Year<th>Sum<tr><td>2020<td>4.5</table>") == "Year\n\nSum\n\n2020\n\n4.5"


def test_html_many_lists():
    """Lists of links under one parent are each looked at once."""
    import time

    began = time.time()
    html.main_text("<article>" + "<ul><li><a>x</a><li><a>y</a></ul>" * 20_000 + "</article>")
    assert time.time() - began < 5


def test_shard_rows_without_id(spark):
    """Equal texts without ids are dealt to all shards; sizes stay near equal and slots gapless."""
    from pyspark.sql import functions as F

    from argosy.llm import shard

    docs = spark.range(2_400).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text for all").alias("text"), F.col("id").alias("more"))
    docs = docs.unionByName(spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"), (F.col("id") + 5_000).alias("more")))
    got = shard.shard(docs, shards=24).collect()
    assert len(got) == 2_700 == len({r.more for r in got})
    sizes = [sum(r.size for r in got if r.shard == i) for i in range(24)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)
    for i in range(24):
        assert sorted(r.slot for r in got if r.shard == i) == list(range(sum(r.shard == i for r in got)))


@pytest.mark.parametrize("few,block", [(64, 2048), (1, 2048), (1, 5)])
def test_neardup_bands_of_many(spark, monkeypatch, few, block):
    """Late pairs by a join, by one block and by several blocks are those of brute force."""
    import random

    from argosy.llm import neardup

    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "BLOCK", block)
    r = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randint(2, 9)):
            w[r.randrange(60)] = f"x{r.randrange(400)}"
        docs.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 2]) for k in range(59)} for i, t in docs}
    of = {i: i for i in sets}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                of[y] = x
    seen = []
    monkeypatch.setattr(neardup, "block_pairs", lambda df, p, f=neardup.block_pairs: (seen.append(df.count()), f(df, p))[1])
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id INT, text STRING"), shingle=2).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: root(i) for i in sets} and len({root(i) for i in sets}) > 3
    assert (seen[0] > 0) == (few == 1)
