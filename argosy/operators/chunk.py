"""Chunk tables from document tables, and the neighbour columns of chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argosy.functions import tags
from argosy.functions import text as tx


def exploded(docs: DataFrame, pieces: Column, doc_id: str = "doc_id") -> DataFrame:
    """One row for each piece: chunk_id {doc_id}-{index}, chunk_index from 0, total_chunks, text."""
    each = tx.let(pieces, lambda p: F.transform(p, lambda x, i: F.struct(F.size(p).alias("total_chunks"), i.alias("chunk_index"), x.alias("text"))))
    rows = docs.select(*(c for c in docs.columns if c not in ("text", "chunk_index", "total_chunks", "chunk_id")), F.inline(each))
    return rows.withColumn("chunk_id", F.concat_ws("-", F.col(doc_id), F.col("chunk_index")))


def word_chunks(docs: DataFrame, size: int = 120, overlap: int = 20, doc_id: str = "doc_id") -> DataFrame:
    """Word windows with a section guess."""
    return exploded(docs, tx.word_windows(F.col("text"), size, overlap), doc_id).withColumn("section", tags.guess_section(F.col("text")))


def char_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200, doc_id: str = "doc_id") -> DataFrame:
    return exploded(docs, tx.char_windows(F.col("text"), size, overlap), doc_id)


def with_neighbours(chunks: DataFrame, doc_id: str = "doc_id", table: Column | None = None) -> DataFrame:
    """Add previous_chunk_id, next_chunk_id ('' at the ends) and window_text (the chunk between its neighbours; where
    ``table`` holds, behind its own text once more)."""
    w = Window.partitionBy(doc_id).orderBy("chunk_index")
    near = tx.strip(F.array_join(F.collect_list("text").over(w.rowsBetween(-1, 1)), "\n\n"))
    rows = chunks.withColumns({"previous_chunk_id": F.lag("chunk_id", 1, "").over(w), "next_chunk_id": F.lead("chunk_id", 1, "").over(w), "window_text": near})
    return rows if table is None else rows.withColumn("window_text", F.when(table, F.concat_ws("\n\n", "text", F.nullif("window_text", F.lit("")))).otherwise(F.col("window_text")))


def starts(sizes: Column, size: int, after: Callable[[Column], Column]) -> Column:
    """Where greedy packing opens a chunk: the places (from 0) of an array of sizes at which ``size`` would be passed, the first
    included. after(used) is what a closed chunk of so much leaves in the next one."""
    first = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("used"), F.lit(0).alias("at"))

    def step(s: Column, n: Column) -> Column:
        opens = (s["at"] == 0) | (s["used"] + n > size)
        used = F.when(s["at"] == 0, n).when(opens, after(s["used"]) + n).otherwise(s["used"] + n)
        return F.struct(F.when(opens, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"]).alias("starts"), used.alias("used"), (s["at"] + 1).alias("at"))

    return F.aggregate(sizes, first, step, lambda s: s["starts"])


def last_words(c: Column, n: int) -> Column:
    """The last n words of a text (all, if fewer), as an array."""
    return tx.let(tx.words(c), lambda w: F.slice(w, F.greatest(F.size(w) - n, F.lit(0)) + 1, F.lit(n)))


def packed(parts: Column, size: int, words: bool, joiner: str, carry: int = 0) -> Column:
    """Chunks of an array of parts that are filled up to size; one that is closed hands on its last ``carry`` words.

    The fold keeps places and counts alone; texts are put together once, from the parts between two places. What is handed on
    are the last words before a place, wherever in the parts before it they stand.
    """

    def run(p: Column, at: Column, end: Column) -> Column:
        return F.slice(p, at + 1, end - at)

    def tail(w: Column, before: Column, at: Column) -> Column:
        last = lambda x: F.slice(x, F.greatest(F.size(x) - carry, F.lit(0)) + 1, F.lit(carry))
        near = tx.let(F.flatten(run(w, before, at)), lambda x: F.when(F.size(x) >= carry, last(x)).otherwise(tx.let(F.flatten(run(w, F.greatest(at - carry, F.lit(0)), at)), last)))
        return F.array(F.array_join(near, " "))

    def texts(p: Column, w: Column | None, at: Column) -> Column:
        def text(begin: Column, i: Column) -> Column:
            own = run(p, begin, F.coalesce(F.get(at, i + 1), F.size(p)))
            return F.array_join(own if w is None else F.when(i > 0, F.concat(tail(w, F.get(at, i - 1), begin), own)).otherwise(own), joiner)

        return F.transform(at, text)

    after = lambda used: F.least(F.lit(carry), used)
    filled = F.coalesce(F.filter(parts, lambda x: ~tx.blank(x)), F.array().cast("array<string>"))
    if not carry:
        measure = (lambda x: F.size(tx.words(x))) if words else F.length
        return tx.let(filled, lambda p: tx.let(starts(F.transform(p, measure), size, after), lambda at: texts(p, None, at)))
    if not words:
        raise ValueError("words are handed on only where words are counted")
    each = lambda p: tx.let(F.transform(p, tx.words), lambda w: tx.let(starts(F.transform(w, F.size), size, after), lambda at: texts(p, w, at)))
    return tx.let(filled, each)


def packed_chunks(docs: DataFrame, split: Column, size: int, words: bool, joiner: str, carry: int = 0, doc_id: str = "doc_id") -> DataFrame:
    """Greedy packing of the parts that ``split`` gives, in each document's row; nothing is shuffled."""
    return exploded(docs, packed(split, size, words, joiner, carry), doc_id)


def paragraph_chunks(docs: DataFrame, size: int = 1200, doc_id: str = "doc_id") -> DataFrame:
    """Paragraphs packed by characters; separators don't count."""
    return packed_chunks(docs, F.transform(F.split(F.col("text"), r"\n{2,}"), tx.strip), size, False, "\n\n", 0, doc_id)


def sentence_chunks(docs: DataFrame, size: int = 450, carry: int = 0, doc_id: str = "doc_id") -> DataFrame:
    """Sentences packed by words, with the last ``carry`` words of a chunk at the head of the next."""
    return packed_chunks(docs, tx.sentences(F.col("text")), size, True, " ", carry, doc_id)


def semantic_chunks(docs: DataFrame, size: int = 450, carry: int = 100, doc_id: str = "doc_id") -> DataFrame:
    """Blocks between blank lines, those of more than ``size`` words by sentences, packed by words; a chunk that is closed
    hands on its last ``carry`` words."""
    whole = F.filter(F.transform(F.split("text", r"\n\s*\n"), tx.strip), lambda x: x != "")
    parts = F.flatten(F.transform(whole, lambda b: F.when(F.size(F.split(b, r"\s+")) <= size, F.array(b)).otherwise(tx.sentences(b))))
    return packed_chunks(docs, parts, size, True, "\n\n", carry, doc_id)


def wordsafe(text: str, size: int, overlap: int) -> list[str]:
    """Windows of ``size`` characters that end at the last space in reach; each starts ``overlap`` before the last one's end,
    half as much where that would be the text's start again, and a character after the last one's start at least."""
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            space = text.rfind(" ", start + 1, end + 1)
            end = space if space > start else end
        out.append(text[start:end].strip())
        if end >= len(text):
            break
        back = end - overlap if end > overlap else end - overlap // 2
        start = max(start + 1, min(back, end - 1))
    return [x for x in out if x]


def wordsafe_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200, doc_id: str = "doc_id") -> DataFrame:
    """Character windows that cut no word where they can help it, folded in each document's row.

    Rows go to Python a hundred at a time and come back as they are done. An Arrow batch would hold ten thousand texts and
    all their windows.
    """
    cut = F.udf(lambda t: wordsafe(t, size, overlap) if t else [], "array<string>", useArrow=False)
    return exploded(docs, cut("text"), doc_id)


def chunk_id_hash(path: Column, company: Column, index: Column) -> Column:
    """The id of a chunk by where it comes from."""
    return F.sha2(F.concat_ws("::", path, company, index.cast("string")), 256)


def drop_known_paths(docs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, refused) of docs (collection, source_file, text, ...): a path that its collection holds is refused, with
    skipped_chunks, the chunks that it would have made. Paths without a chunk in it are new."""
    known = chunks.select("collection", "source_file").distinct()
    at = ["collection", "source_file"]
    again = docs.join(known, at, "left_semi")
    parts = packed_chunks(again, F.split(F.col("text"), r"\n{2,}"), 1200, False, "\n\n", 0, "source_file")
    sizes = parts.groupBy(*at).agg(F.count("*").alias("skipped_chunks"))
    return docs.join(known, at, "left_anti"), again.join(sizes, at, "left").withColumn("skipped_chunks", F.coalesce("skipped_chunks", F.lit(0)))


def drop_known(docs: DataFrame, known: DataFrame, doc_hash: str = "doc_hash", order: str = "source") -> DataFrame:
    """Documents whose hash is not stored yet; of several with one hash the first by ``order``."""
    first = docs.groupBy(doc_hash).agg(F.min(F.struct(F.col(order), F.col("doc_id"))).alias("_first"))
    fresh = first.join(known.select(F.col(doc_hash)).distinct(), doc_hash, "left_anti").select(F.col("_first.doc_id").alias("doc_id"))
    return docs.join(fresh, "doc_id", "left_semi")


def strip_repeated_margins(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_number, text) without the lines that stand among the first or last three of many pages.

    In a document of three pages or more, a line (stripped) that does so on max(3, half the pages) of them goes everywhere.
    All else stays as it is: other lines with their blanks, empty pages, and documents of fewer pages. A page has six such
    lines at most, so a document's list of repeated ones has some twenty.
    """
    lines = pages.select("doc_id", "page_number", "text", F.split(F.regexp_replace("text", r"\r?\n\z", ""), r"\r?\n", -1).alias("_lines"))
    edges = F.concat(F.slice("_lines", 1, 3), F.slice("_lines", F.greatest(F.lit(1), F.size("_lines") - 2), F.lit(3)))
    edge = lines.select("doc_id", "page_number", F.explode(F.array_distinct(F.filter(F.transform(edges, tx.strip), lambda x: x != ""))).alias("line"))
    total = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    often = edge.groupBy("doc_id", "line").agg(F.count("*").alias("on")).join(total, "doc_id")
    often = often.filter((F.col("n") >= 3) & (F.col("on") >= F.greatest(F.lit(3), F.floor(F.col("n") / 2)))).groupBy("doc_id").agg(F.collect_list("line").alias("_often"))
    left = F.array_join(F.filter("_lines", lambda x: ~F.array_contains("_often", tx.strip(x))), "\n")
    return lines.join(often, "doc_id", "left").select("doc_id", "page_number", F.when(F.col("_often").isNull(), F.col("text")).otherwise(left).alias("text"))
