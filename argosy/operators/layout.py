"""Layout blocks of texts: sections carried forward, table rows, block chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argosy.functions import tags
from argosy.functions import text as tx
from argosy.operators.chunk import last_words, packed, starts


def blocks(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(..., pos, text, kind): the parts between blank lines with their kind."""
    keep = [c for c in docs.columns if c != "text"]
    rows = docs.select(*keep, F.posexplode(F.filter(F.transform(F.split("text", r"\n\s*\n"), tx.strip), lambda x: x != "")).alias("pos", "text"))
    return rows.withColumn("kind", tags.block_type(F.col("text")))


def place(parts: DataFrame) -> list[str]:
    """The columns by which a document's blocks stand in order."""
    return (["page_number"] if "page_number" in parts.columns else []) + ["pos"]


def heading_of(c: Column) -> Column:
    """struct(title, type) of a heading block: by the section rules, else a short heading itself; null if it is neither."""
    head = tags.section_heading(c)
    own = F.when(F.size(F.split(c, r"\s+")) <= 10, F.struct(tx.normalize_heading(c).alias("title"), F.lit("other").alias("type")))
    return F.when(head["title"] != "", head).otherwise(own)


def section_carry(parts: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Add section_title and section_type: those of the latest heading up to each block, '' and other before the first.

    Blocks stand in order by page_number, where there is one, and pos.
    """
    w = Window.partitionBy(doc_id).orderBy(*place(parts)).rowsBetween(Window.unboundedPreceding, 0)
    of = F.last(F.when(F.col("kind") == "heading", heading_of(F.col("text"))), ignorenulls=True).over(w)
    return parts.withColumn("_h", of).withColumns({"section_title": F.coalesce("_h.title", F.lit("")), "section_type": F.coalesce("_h.type", F.lit("other"))}).drop("_h")


def table_rows(c: Column) -> Column:
    """The rows of a table block, cells joined by " | ": they part at bars, else tabs (empty ones count), else wide gaps. A row
    of one cell stays as it is."""
    lines = F.filter(F.transform(F.split(c, r"\r?\n"), lambda x: F.regexp_replace(x, r"\s+\z", "")), lambda x: x != "")

    def row(x: Column) -> Column:
        cells = F.when(F.contains(x, F.lit("|")), F.split(x, r"\|", -1)).when(F.contains(x, F.lit("\t")), F.split(x, r"\t", -1)).otherwise(F.filter(F.split(x, r"\s{2,}"), lambda y: tx.strip(y) != ""))
        return F.when(F.size(cells) > 1, F.array_join(F.transform(cells, tx.strip), " | ")).otherwise(x)

    return F.transform(lines, row)


def block_chunks(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(..., section_title, section_type, chunk_index, text): a heading takes the block after it; tables stand alone.

    Blocks that a heading opens are grouped by a running count, so no state passes between documents. With pages, a chunk
    carries the page that it begins on.
    """
    parts = section_carry(blocks(docs, doc_id), doc_id)
    at = place(parts)
    w = Window.partitionBy(doc_id).orderBy(*at)
    alone = (F.col("kind") == "table") & (F.coalesce(F.lag("kind").over(w), F.lit("")) != "heading")
    no = parts.withColumn("_alone", alone).withColumn("_a", F.lag("_alone").over(w)).withColumn("_open", ((F.col("kind") == "heading") | F.col("_alone") | F.coalesce("_a", F.lit(True))).cast("int"))
    grouped = no.withColumn("chunk_index", F.sum("_open").over(w) - 1)
    keep = [c for c in docs.columns if c not in ("text", "page_number")]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*at, "text"))), lambda x: x["text"]), "\n\n")
    pages = [F.min("page_number").alias("page_number")] if "page_number" in docs.columns else []
    return grouped.groupBy(*keep, "section_title", "section_type", "chunk_index").agg(joined.alias("text"), *pages)


ATOMIC = ("list", "heading", "note")


def merged(parts: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Blocks behind their headings: (..., text, kind, section_title, section_type, label).

    A heading sets the section and takes the next block of its page into one narrative, so of headings in a row every second
    is taken and sets none. section is that of the latest heading; label the latest that is not empty beside a block that is
    no table.
    """
    page = Window.partitionBy(doc_id, "page_number").orderBy("pos")
    doc = Window.partitionBy(doc_id).orderBy(*place(parts)).rowsBetween(Window.unboundedPreceding, 0)
    heads = F.col("kind") == "heading"
    rows = parts.withColumn("_n", F.row_number().over(page)).withColumn("_other", F.max(F.when(~heads, F.col("_n"))).over(page.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_takes", heads & ((F.col("_n") - F.coalesce("_other", F.lit(0))) % 2 == 1))
    rows = rows.withColumns({"_taken": F.coalesce(F.lag("_takes").over(page), F.lit(False)), "_next": F.lead("text").over(page)}).filter("NOT _taken")
    both = F.col("_takes") & F.col("_next").isNotNull()
    rows = rows.withColumn("_h", F.last(F.when(F.col("_takes"), heading_of(F.col("text"))), ignorenulls=True).over(doc))
    rows = rows.withColumns({"section_title": F.coalesce("_h.title", F.lit("")), "section_type": F.coalesce("_h.type", F.lit("other"))})
    rows = rows.withColumns({"text": F.when(both, F.concat_ws("\n\n", "text", "_next")).otherwise(F.col("text")), "kind": F.when(both, "narrative").otherwise(F.col("kind"))})
    named = F.when((F.col("section_title") != "") & (F.col("kind") != "table"), F.struct("section_title", "section_type"))
    none = F.struct(F.lit("").alias("section_title"), F.lit("other").alias("section_type"))
    return rows.withColumn("label", F.coalesce(F.last(named, ignorenulls=True).over(doc), none)).drop("_n", "_other", "_takes", "_taken", "_next", "_h")


def n_words(c: Column) -> Column:
    return F.size(tx.words(c))


def sentence_pieces(c: Column, size: int) -> Column:
    """A text of more than ``size`` words in pieces of whole sentences."""
    return F.when(n_words(c) <= size, F.array(c)).otherwise(packed(F.transform(tx.sentences(c), tx.strip), size, True, " "))


def table_pieces(rows: Column, size: int) -> Column:
    """A table's rows in one piece; more than ``size`` words in pieces, each under its first row."""

    def pieces(r: Column) -> Column:
        cut = lambda at: F.transform(at, lambda a, i: F.array_join(F.concat(F.array(r[0]), F.slice(r, a + 2, F.coalesce(F.get(at, i + 1), F.size(r) - 1) - a)), "\n"))
        head = lambda used: n_words(r[0])
        sizes = F.transform(F.slice(r, 2, F.size(r)), lambda x, i: n_words(x) + F.when(i == 0, n_words(r[0])).otherwise(0))
        return F.when(F.size(r) < 2, r).otherwise(tx.let(starts(sizes, size, head), cut))

    return F.when(n_words(F.array_join(rows, " ")) <= size, F.array(F.array_join(rows, "\n"))).otherwise(tx.let(F.transform(rows, tx.strip), pieces))


def _chunk(held: Column, text: Column) -> Column:
    """The chunk of an array of pieces (text, page, kind, label), whose joined text is ``text``."""
    label = F.element_at(held, -1)["label"]
    of = lambda name: F.array_sort(F.array_distinct(F.transform(held, lambda x: x[name])))
    return F.struct(tx.strip(text).alias("text"), of("kind").alias("block_types"), of("page").alias("page_numbers"), label["section_title"].alias("section_title"), label["section_type"].alias("section_type"))


def filled(pieces: Column, size: int, overlap: int) -> Column:
    """The chunks of an array of pieces (text, page, kind, label), which stand in order, without tables.

    A chunk ends where its words would pass size and before a list, heading or note. It hands on its last words but to such a
    block, where they still count. A chunk that was opened takes on what follows, whatever its first block is.
    """
    held, chunk = "array<struct<text:string,page:int,kind:string,label:struct<section_title:string,section_type:string>>>", "array<struct<text:string,block_types:array<string>,page_numbers:array<int>,section_title:string,section_type:string>>"
    first = F.struct(F.array().cast(chunk).alias("out"), F.array().cast(held).alias("held"), F.lit(0).alias("used"))
    text_of = lambda h: F.array_join(F.transform(h, lambda x: x["text"]), "\n\n")

    def step(s: Column, p: Column) -> Column:
        alone = p["kind"].isin(*ATOMIC)

        def sized(n: Column) -> Column:
            def closed(text: Column) -> Column:
                tail = last_words(text, overlap) if overlap else F.array().cast("array<string>")

                def after(t: Column) -> Column:
                    on = F.struct(F.array_join(t, " ").alias("text"), F.element_at(s["held"], -1)["page"].alias("page"), F.lit("narrative").alias("kind"), p["label"].alias("label"))
                    kept = F.when((F.size(t) > 0) & ~alone, F.array(on, p)).otherwise(F.array(p))
                    return F.struct(F.concat(s["out"], F.array(_chunk(s["held"], text))).alias("out"), kept.alias("held"), (F.size(t) + n).alias("used"))

                return tx.let(tail, after)

            more = F.struct(s["out"].alias("out"), F.concat(s["held"], F.array(p)).alias("held"), (s["used"] + n).alias("used"))
            cut = (F.size(s["held"]) > 0) & (alone | (s["used"] + n > size))
            return F.when(cut, tx.let(text_of(s["held"]), closed)).otherwise(more)

        return tx.let(n_words(p["text"]), sized)

    end = lambda s: F.when(F.size(s["held"]) > 0, F.concat(s["out"], F.array(_chunk(s["held"], text_of(s["held"]))))).otherwise(s["out"])
    return F.aggregate(pieces, first, step, end)


def layout_chunks(pages: DataFrame, size: int = 450, overlap: int = 100) -> DataFrame:
    """(doc_id, chunk_index, text, block_types, page_numbers, section_title, section_type) from (doc_id, page_number, text).

    Headings and sections are found by windows over blocks. A table ends a chunk and hands nothing on, so what stands between
    two tables is folded by itself: a document without tables is one row, any other is not.
    """
    rows = merged(blocks(pages.select("doc_id", F.col("page_number").cast("int").alias("page_number"), "text")))
    at = ["page_number", "pos"]
    tables = F.col("kind") == "table"
    rows = rows.withColumn("seg", F.sum(tables.cast("int")).over(Window.partitionBy("doc_id").orderBy(*at)))
    piece = F.struct(*at, "text", F.col("page_number").alias("page"), "kind", "label")
    held = rows.filter(~tables).groupBy("doc_id", "seg").agg(F.array_sort(F.collect_list(piece)).alias("b"))

    def cut(b: Column) -> Column:
        texts = F.when(b["kind"] == "narrative", sentence_pieces(b["text"], size)).otherwise(F.array(b["text"]))
        return F.transform(texts, lambda t: F.struct(t.alias("text"), b["page"].alias("page"), b["kind"].alias("kind"), b["label"].alias("label")))

    made = held.select("doc_id", "seg", F.lit(1).alias("_k"), F.posexplode(filled(F.flatten(F.transform("b", cut)), size, overlap)).alias("_i", "c")).select("doc_id", "seg", "_k", "_i", "c.*")
    apart = rows.filter(tables).select("doc_id", "seg", F.lit(0).alias("_k"), "page_number", "section_title", "section_type", F.posexplode(table_pieces(table_rows(F.col("text")), size)).alias("_i", "_t"))
    apart = apart.select("doc_id", "seg", "_k", "_i", tx.strip(F.col("_t")).alias("text"), F.array(F.lit("table")).alias("block_types"), F.array("page_number").alias("page_numbers"), "section_title", "section_type")
    order = Window.partitionBy("doc_id").orderBy("seg", "_k", "_i")
    return made.unionByName(apart).select("doc_id", (F.row_number().over(order) - 1).alias("chunk_index"), "text", "block_types", "page_numbers", "section_title", "section_type")
