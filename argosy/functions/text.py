"""Column functions over text: cleaning, windows, measures, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "\u2026"
# White space of all scripts and the separators of ASCII, as a Java pattern; \\s alone is a part of ASCII's.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; trim() takes spaces alone."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_text(c: Column) -> Column:
    """Printable characters, line feeds and tabs stay; blanks and tabs collapse, more than two line feeds too; stripped."""
    printable = F.regexp_replace(c, r"[\p{C}\p{Z}&&[^ \n\t]]", "")
    return strip(F.regexp_replace(F.regexp_replace(printable, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def squash(c: Column) -> Column:
    """White space runs become one space; trimmed."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, f"{SPACE}+"), "")


def blank(c: Column) -> Column:
    """Is there nothing but white space?"""
    return ~c.rlike(f"[^{SPACE[1:]}")


def tokens(c: Column) -> Column:
    """The distinct runs of a-z of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0))


def word_windows(c: Column, size: int, overlap: int) -> Column:
    """Word windows that start every size - overlap words, the last one included even if it lies in the one before."""
    if size <= overlap:
        raise ValueError("size must be larger than overlap")

    def cut(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))

    return let(words(c), cut)


def char_windows(c: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Plain character windows that start every size - overlap characters.

    The text is cut into steps once; a window is the few steps that it covers, so none is looked for from the text's start.
    """
    if size <= overlap:
        raise ValueError("size must be larger than overlap")
    step = size - overlap

    def cut(steps: Column) -> Column:
        return F.transform(steps, lambda _, i: F.left(F.array_join(F.slice(steps, i + 1, F.lit(-(-size // step))), ""), F.lit(size)))

    return let(F.regexp_extract_all(c, F.lit(f"(?s).{{1,{step}}}"), 0), cut)


def sentences(c: Column) -> Column:
    return F.split(c, rf"(?<=[.!?]){SPACE}+")


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's tokens (an array) that the text's tokens hold; 0 without tokens."""
    return F.coalesce(F.size(F.array_intersect(query, text)) / F.nullif(F.size(query), F.lit(0)), F.lit(0.0))


def snippet(c: Column, size: int = 220) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit(ELLIPSIS))).otherwise(F.coalesce(c, F.lit("")))


def normalize_heading(c: Column) -> Column:
    """Without closing colons and dashes, white space squashed."""
    return squash(F.regexp_replace(strip(c), r"\s*[:\-\u2013\u2014]\s*$", ""))


def csv_set(c: Column) -> Column:
    """Trimmed distinct values of an array, sorted without regard to case, joined by commas."""
    values = F.array_distinct(F.filter(F.transform(c, lambda x: strip(x)), lambda x: x != ""))
    by = F.transform(values, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))
    return F.array_join(F.transform(F.array_sort(by), lambda x: x["v"]), ",")


def text_measures(c: Column) -> dict[str, Column]:
    """Characters, words, sentences, paragraphs and minutes of reading at 3.33 words a second, as columns by name."""
    n = F.size(words(c))
    filled = lambda parts: F.size(F.filter(parts, lambda x: strip(x) != ""))
    return {
        "characters": F.length(c),
        "words": n,
        "sentences": filled(sentences(c)),
        "paragraphs": filled(F.split(c, rf"\n{SPACE}*\n")),
        "reading_seconds": F.bround(n / 3.33, 1),
    }


def decompose(c: Column) -> Column:
    """Sub-questions: split at question marks, semicolons and "and"; the whole question if nothing is left."""
    parts = F.filter(F.transform(F.split(c, r"(?i)\?|,?\s+and\s+|;"), lambda x: F.btrim(x, F.lit(" ,."))), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.trim(c)))
