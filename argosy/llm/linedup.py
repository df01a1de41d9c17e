"""Line dedup by a segment-partition edit join.

Lines of length l are cut into THRESHOLD + 1 even segments. Of two lines within THRESHOLD edits, one
segment of the shorter is untouched and stands in the longer at one of few places that the lengths
allow, so a row for each segment and for each such substring, keyed by its hash, segment number and
length, brings both together. Candidates are trimmed of their common ends and verified with a banded
bit-parallel edit distance. Only DataFrame operations.

Equal lines are one row from the start. Under a key every line is verified against the smallest
indexed one, and these links make classes. Where lines of different classes still share a key of at
most FEW rows, the pairs whose gram maps leave room for a link are verified. A key of more rows is
refined: its lines are cut into twice as many segments, of which THRESHOLD may be touched, and meet
again by all untouched ones together, which two lines within THRESHOLD edits still share. So a
segment that many different lines have costs each of them some rows more, never a comparison with
all others, and no link is lost. The first line of a class in (doc_id, position) order stays.

Defined cases: lines are split at \\n; those without a word are kept and never compared; lines under
MIN_LENGTH code points are duplicates only if equal; a null text has no line; a null id comes first;
rows of one id are one document, whose lines count as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argosy.llm.common import WORD, kept, row, unpacked
from argosy.llm.components import components
from argosy.session import with_checkpoint_dir

THRESHOLD = 2
MIN_LENGTH = 12
#: Under a key of at most so many rows the gram maps of all lines of different classes are compared; a key with more is refined.
FEW = 512
#: Grams of so many characters in stretches of so many set bits in maps of so many 64-bit numbers.
GRAM, STRETCH, MAP = 2, 16, 32


def segment(length: Column, i: int, t: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 0) of a line."""
    start = edge(length, F.lit(i), t + 1)
    return start + 1, edge(length, F.lit(i + 1), t + 1) - start


def edge(length: Column, i: Column, parts: int) -> Column:
    """Where segment i of so many parts begins (from 0). Twice as many parts have these edges too."""
    return F.floor(i.cast("long") * length / parts).cast("int")


def keys(line: str, t: int) -> tuple[Column, list[tuple]]:
    """An array of keys, null where there is none: the line's own segments, and its substrings that may equal a shorter
    line's segment. Also the place of each: (touched segments, shifts of the runs between them, gap of the lengths)."""
    own, out, places = F.length(line), [], []
    for gap in range(t + 1):
        length = own - gap
        for i in range(t + 1):
            start, size = segment(length, i, t)
            # multi-match-aware bounds of how far segment i can have moved
            for off in range(max(-i, gap - (t - i)), min(i, gap + (t - i)) + 1):
                at = start + off
                places.append(([j for j in range(t + 1) if j != i], [off if r == i else None for r in range(1, t)], gap))
                out.append(F.when((at >= 1) & (at + size - 1 <= own), F.xxhash64(F.lit(i), length, F.substring(F.col(line), at, size))))
    return F.array(*out), places


PLACE = "struct<touched: array<int>, shifts: array<int>, gap: int>"


def place(touched: list, shifts: list, gap) -> Column:
    ints = lambda x: F.array(*(c if isinstance(c, Column) else F.lit(c).cast("int") for c in x)).cast("array<int>")
    return F.struct(ints(touched).alias("touched"), ints(shifts).alias("shifts"), (gap if isinstance(gap, Column) else F.lit(gap)).cast("int").alias("gap"))


def is_indexed(p: str) -> Column:
    """Is a place the line's own, not one where it may meet a shorter line?"""
    return (F.col(f"{p}.gap") == 0) & F.forall(f"{p}.shifts", lambda s: F.coalesce(s, F.lit(0)) == 0)


def finer(p: Column, t: int) -> Column:
    """The places at twice as many segments that a match at place p may have: t of the halves of its touched segments are
    touched. Runs that were untouched keep their shift; a new run takes any shift that t edits can make."""
    halves = [F.get(p["touched"], F.lit(k // 2)) * 2 + k % 2 for k in range(2 * t)]
    out = []
    for chosen in combinations(range(2 * t), t):
        for moves in product(range(-t, t + 1), repeat=t - 1):
            fits, shifts, last, cost = F.lit(True), [], F.lit(0), F.lit(0)
            for r, move in enumerate(moves, 1):
                bare = halves[chosen[r]] == halves[chosen[r - 1]] + 1
                fits = fits & (~bare | F.lit(move == 0))
                shifts.append(F.when(~bare, F.lit(move)))
                here = F.when(bare, last).otherwise(F.lit(move))
                cost, last = cost + F.abs(here - last), here
            for r in range(1, t):
                run = sum(q < 2 * r for q in chosen)
                old = F.get(p["shifts"], F.lit(r - 1))
                now = F.lit(0) if run == 0 else p["gap"] if run == t else F.lit(moves[run - 1])
                fits = fits & (old.isNull() | (old == now))
            fits = fits & (cost + F.abs(p["gap"] - last) <= t)
            out.append(F.when(fits, place([halves[q] for q in chosen], shifts, p["gap"])))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def place_key(line: str, p: str, parts: int, t: int) -> Column:
    """The hash of all that is untouched at a place, null where the line is too short for its shifts."""
    own, gap = F.length(line), F.col(f"{p}.gap")
    length, fits, pieces = own - gap, F.lit(True), []
    touched = lambda r: F.get(f"{p}.touched", F.lit(r))
    for r in range(t + 1):
        shift = F.lit(0) if r == 0 else gap if r == t else F.coalesce(F.get(f"{p}.shifts", F.lit(r - 1)), F.lit(0))
        begin = edge(length, touched(r - 1) + 1, parts) + shift if r else F.lit(0)
        end = edge(length, touched(r), parts) + shift if r < t else own
        fits = fits & (begin >= 0) & (begin <= end) & (end <= own)
        pieces.append(F.substring(F.col(line), begin + 1, end - begin))
    return F.when(fits, F.xxhash64(F.lit(parts), length, F.col(f"{p}.touched"), *pieces))


def common(x: str, y: str, take) -> Column:
    """Length of the common beginning (take: left) or end (right), by halving."""

    def step(acc: Column, _: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        mid = F.shiftright(lo + hi + 1, 1)
        same = (lo < hi) & (take(F.col(x), mid) == take(F.col(y), mid))
        return F.struct(F.when(same, mid).otherwise(lo).alias("lo"), F.when(same | (lo >= hi), hi).otherwise(mid - 1).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.least(F.length(x), F.length(y)).alias("hi"))
    steps = F.ceil(F.log2(F.least(F.length(x), F.length(y)) + 2)).cast("int") + 1
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda acc: acc["lo"])


def trimmed(pairs: DataFrame) -> DataFrame:
    """Cut the common beginning and then the common end off x and y."""
    pairs = pairs.withColumn("cut", common("x", "y", F.left))
    pairs = pairs.withColumns({c: F.substr(F.col(c), F.col("cut") + 1) for c in "xy"}).withColumn("cut", common("x", "y", F.right))
    return pairs.withColumns({c: F.left(F.col(c), F.length(c) - F.col("cut")) for c in "xy"}).drop("cut")


def may_match(x: str, y: str, t: int) -> Column:
    """False only for trimmed lines that can't be within t edits. Both ends of what trimming leaves take an edit, so of t + 1
    segments of x one between the first and the last is untouched and stands in y, moved by t at most."""
    n = F.length(x)
    kept_ = F.lit(False)
    for i in range(1, t):
        start, size = segment(n, i, t)
        for move in range(-t, t + 1):
            kept_ = kept_ | ((start + move >= 1) & (F.substring(F.col(x), start, size) == F.substring(F.col(y), start + move, size)))
    return (F.abs(n - F.length(y)) <= t) & ((F.least(n, F.length(y)) < 4 * (t + 1)) | kept_)


def within(x: str, y: str, t: int) -> Column:
    """Is the edit distance of two arrays of characters t at most? A band of 2t+1 diagonals goes over y as bits of one number.

    Bit k of a vector is row j - t + k of column j. Rows above the matrix act as a run of insertions, so the distance
    starts at t below the main diagonal and is followed along the band's lowest diagonal, then along the last row. There it
    can fall by 2t at most, so a line beyond 3t is given up.
    """
    w = 2 * t + 1
    full = (1 << w) - 1
    n, m = F.size(x), F.size(y)

    def step(acc: Column, j: Column) -> Column:
        char = F.get(y, j - 1)
        match = F.lit(0).cast("long")
        for k in range(w):
            row = j - t + k
            match = match + F.when((row >= 1) & (F.get(x, row - 1) == char), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.struct(match.alias("match"), acc["vp"].alias("vp"), acc["vn"].alias("vn"), acc["d"].alias("d"))

    def advance(acc: Column, j: Column) -> Column:
        s = step(acc, j)
        out = F.transform(F.array(s), lambda s: _column(s, j, t, full, n))
        return F.when(acc["d"] > 3 * t, acc).otherwise(F.get(out, F.lit(0)))

    first = F.struct(F.lit(full & ~((1 << t) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(F.lit(t), n).alias("d"))
    last = F.aggregate(F.sequence(F.lit(1), m), first, advance)
    return (F.abs(n - m) <= t) & F.when(m == 0, n <= t).when(n == 0, m <= t).otherwise(last["d"] <= t)


def _column(s: Column, j: Column, t: int, full: int, n: Column) -> Column:
    """One column of the band: the bit vectors of vertical differences and the followed distance."""
    vp, vn, match = s["vp"], s["vn"], s["match"]
    d0 = ((((match.bitwiseAND(vp)) + vp).bitwiseXOR(vp)).bitwiseOR(match).bitwiseOR(vn)).bitwiseAND(F.lit(full).cast("long"))
    mask = F.lit(full).cast("long")
    return F.transform(F.array(F.struct(vp.alias("vp"), vn.alias("vn"), d0.alias("d0"), s["d"].alias("d"))), lambda r: _shift(r, j, t, mask, n))[0]


def _shift(r: Column, j: Column, t: int, mask: Column, n: Column) -> Column:
    vp, vn, d0 = r["vp"], r["vn"], r["d0"]
    hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(mask))
    hn = d0.bitwiseAND(vp)
    down = F.shiftright(d0, 1)
    new_vp = hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(mask))
    new_vn = down.bitwiseAND(hp)
    # along the lowest diagonal while it is in the matrix, then along the last row, whose bit moves up the band
    top = F.lit(1 << (2 * t)).cast("long")
    edge = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.least(F.lit(2 * t), n - j + t)).cast("int"))
    diagonal = F.when(d0.bitwiseAND(top) == 0, 1).otherwise(0)
    across = F.when(hp.bitwiseAND(edge) != 0, 1).when(hn.bitwiseAND(edge) != 0, -1).otherwise(0)
    return F.struct(new_vp.alias("vp"), new_vn.alias("vn"), (r["d"] + F.when(j + t <= n, diagonal).otherwise(across)).alias("d"))


def verify(pairs: DataFrame, texts: DataFrame, t: int) -> DataFrame:
    """The (a, b) whose lines are within t edits."""
    x, y = (texts.select(F.col("id").alias(i), F.col("line").alias(c)) for i, c in (("a", "x"), ("b", "y")))
    both = trimmed(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"))
    likely = fenced(both, may_match("x", "y", t))
    chars = likely.withColumns({c: F.array_remove(F.split(c, ""), "") for c in "xy"})
    return fenced(chars, within("x", "y", t)).select("a", "b")


def fenced(df: DataFrame, condition: Column) -> DataFrame:
    """A filter that stays above the columns that it reads. Pushed below them it would compute them again at each mention."""
    return df.withColumn("fence", F.monotonically_increasing_id()).filter(condition & (F.col("fence") >= 0)).drop("fence")


def gram_maps(lines: DataFrame, t: int) -> DataFrame:
    """(of, own, near) of (id, line): maps with a bit for each gram of the line and the stretch of it that it stands in, and for
    each stretch that t edits elsewhere could move it to. MAP numbers each.

    The line becomes an array of characters first, as taking substrings of a long line at every place would take the square
    of its length.
    """
    def bits(moved: int, first: int) -> Column:
        of = lambda i: F.xxhash64(*(F.get("chars", i + k) for k in range(GRAM)), F.floor((i + moved) / STRETCH))
        at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("chars") - GRAM))
        return F.transform(at, lambda i: (F.pmod(of(i), F.lit(64 * MAP)) + 64 * first).cast("int"))

    chars = lines.select("id", F.array_remove(F.split("line", ""), "").alias("chars"))
    each = chars.select("id", F.explode(F.array_distinct(F.concat(bits(0, 0), bits(-t, MAP), bits(t, MAP)))).alias("b"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b") % 64)
    words = each.groupBy("id", F.shiftright("b", 6).alias("k")).agg(F.bit_or(one).alias("w"))
    held = words.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("m"))
    taken = lambda first: F.transform(F.sequence(F.lit(first), F.lit(first + MAP - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long")))
    return held.select(F.col("id").alias("of"), taken(0).alias("own"), taken(MAP).alias("near"))


def between(rows: DataFrame, texts: DataFrame, t: int) -> DataFrame:
    """(a, b): all pairs of an indexed line and one of another class under one key whose gram maps leave room for t edits."""
    maps = gram_maps(texts.join(rows.select("id").distinct(), "id", "left_semi"), t)
    mapped = rows.join(maps, F.col("id") == F.col("of"))
    x = mapped.filter(is_indexed("place")).select(F.col("key").alias("kx"), F.col("id").alias("i"), F.col("part").alias("p"), F.col("own").alias("ox"), F.col("near").alias("nx"))
    y = mapped.select(F.col("key").alias("ky"), F.col("id").alias("j"), F.col("part").alias("q"), F.col("own").alias("oy"), F.col("near").alias("ny"))
    # an edit touches GRAM grams; all others stand at most t characters from where they stood
    lacks = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda n, k: n + k)
    near = (lacks("ox", "ny") <= GRAM * t) & (lacks("oy", "nx") <= GRAM * t)
    return x.join(y, (F.col("kx") == F.col("ky")) & (F.col("p") != F.col("q")) & near).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def still_open(rows: DataFrame) -> DataFrame:
    """Of (key, id, place, part) the rows whose key has lines of several classes, with their number n."""
    apart = rows.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("n")).filter("p < q").select("key", "n")
    return rows.join(apart, "key").checkpoint()


def refined(rows: DataFrame, texts: DataFrame, parts: int, t: int) -> DataFrame:
    """(key, id, place, part) of the lines of some rows, cut into ``parts`` segments, at the places within those of the rows."""
    each = rows.groupBy("id").agg(F.first("part").alias("part"), F.collect_set("place").alias("places")).join(texts, "id")
    each = each.select("id", "part", "line", F.explode(F.array_distinct(F.flatten(F.transform("places", lambda p: finer(p, t))))).alias("place"))
    return fenced(each.withColumn("key", place_key("line", "place", parts, t)), F.col("key").isNotNull()).select("key", "id", "place", "part")


def against_first(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key several lines share, with its first indexed line as lead (id, part), and the (a, b) of such lines
    where they are of another class."""
    w = Window.partitionBy("key")
    first = F.min(F.when(is_indexed("place"), F.struct("id", "part"))).over(w)
    met = rows.withColumns({"lead": first, "low": F.min("id").over(w), "high": F.max("id").over(w)}).filter("lead IS NOT NULL AND low < high").drop("low", "high").checkpoint()
    return met, met.filter("lead.part != part").select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct()


def late_links(open_: DataFrame, texts: DataFrame, tested: DataFrame, t: int) -> DataFrame:
    """The links between classes that share a key. open_: (key, id, place, part, n) at t + 1 segments; see the module's head."""
    parts, found, pairs, longest = t + 1, [], [], None
    while True:
        whole = longest is not None and parts > 2 * longest
        pairs.append(between(open_ if whole else open_.filter(F.col("n") <= FEW), texts, t))
        hot = open_.filter(F.col("n") > FEW)
        if whole or hot.isEmpty():
            break
        longest = longest or hot.select("id").distinct().join(texts, "id").agg(F.max(F.length("line"))).first()[0]
        parts *= 2
        met, against = against_first(refined(hot, texts, parts, t))
        found.append(verify(against, texts, t).checkpoint())
        # a line that is linked with its lead is of the lead's class from here on
        links = found[-1].select(F.col("a").alias("_a"), F.col("b").alias("_b"))
        joined = met.join(links, (F.col("lead.id") == F.col("_a")) & (F.col("id") == F.col("_b")), "left")
        open_ = still_open(joined.select("key", "id", "place", F.when(F.col("_b").isNotNull(), F.col("lead.part")).otherwise(F.col("part")).alias("part")))
    rest = reduce(DataFrame.unionByName, pairs).distinct().join(tested, ["a", "b"], "left_anti")
    return reduce(DataFrame.unionByName, [verify(rest, texts, t).checkpoint(), *found])


def line_classes(lines: DataFrame, t: int = THRESHOLD) -> DataFrame:
    """(node, component) of the lines (id, line; equal lines have one id) that are within t edits of a different one."""
    with_checkpoint_dir(lines.sparkSession)
    long_ = lines.filter(F.length("line") >= max(MIN_LENGTH, t + 1))
    made, places = keys("line", t)
    own = [i for i, (_, shifts, gap) in enumerate(places) if gap == 0 and not any(shifts)]
    each = long_.select("id", made.alias("keys")).groupBy("id").agg(F.first("keys").alias("keys"))
    rows = each.select("id", F.posexplode("keys").alias("i", "key")).filter("key IS NOT NULL").select("id", "key", F.col("i").cast("byte").alias("i"))
    w = Window.partitionBy("key")
    met = rows.withColumns({"lead": F.min(F.when(F.col("i").isin(own), F.col("id"))).over(w), "low": F.min("id").over(w), "high": F.max("id").over(w)})
    met = met.filter("lead IS NOT NULL AND low < high").select("key", "id", "i", "lead").checkpoint()
    texts = long_.groupBy("id").agg(F.first("line").alias("line")).join(met.select("id").distinct(), "id", "left_semi").checkpoint()
    tested = met.filter("id != lead").select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).distinct().checkpoint()
    links = verify(tested, texts, t).checkpoint()
    first = components(links)
    placed = met.join(first, F.col("id") == F.col("node"), "left").select("key", "id", F.get(F.array(*(place(*p) for p in places)), F.col("i")).cast(PLACE).alias("place"), F.coalesce("component", "id").alias("part"))
    late = late_links(still_open(placed), texts, tested, t)
    return first if late.isEmpty() else components(links.unionByName(late))


def drop_repeated_lines(docs: DataFrame, t: int = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, n_near, removed): the lines with a word, those that go, those among them that are equal
    to no line that stays, and the positions (from 0, of all lines) of those that go. One row for each id."""
    parts = docs.select(F.col(doc_id).alias("doc"), F.posexplode_outer(F.split(text, "\n", -1)).alias("pos", "line"))
    worded = F.coalesce(F.col("line").rlike(WORD), F.lit(False))
    all_lines = parts.withColumn("id", F.when(worded, F.xxhash64("line")))
    known = all_lines.filter("id IS NOT NULL")
    classes = line_classes(known.select("id", "line"), t)
    first = known.groupBy("id").agg(F.min(F.struct("doc", "pos")).alias("at"))
    at = first.join(classes, F.col("id") == F.col("node"), "left").select("id", "at", "component")
    linked = at.filter("component IS NOT NULL").groupBy("component").agg(F.min("at").alias("best")).withColumnRenamed("component", "of")
    stays = at.join(linked, F.col("component") == F.col("of"), "left").select(F.col("id").alias("line_id"), F.col("at").alias("own"), F.coalesce("best", "at").alias("stays"))
    judged = all_lines.select("doc", "pos", "id").join(stays, F.col("id") == F.col("line_id"), "left")
    goes = F.col("stays").isNotNull() & ~F.struct("doc", "pos").eqNullSafe(F.col("stays"))
    near = goes & (F.col("own") != F.col("stays"))
    return judged.groupBy(F.col("doc").alias("doc_id")).agg(
        F.count("id").alias("n_lines"),
        F.count_if(goes).alias("n_removed"),
        F.count_if(near).alias("n_near"),
        F.array_sort(F.collect_set(F.when(goes, F.col("pos")))).alias("removed"),
    )


def without_repeated_lines(docs: DataFrame, t: int = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, with n_lines, n_removed and n_near of drop_repeated_lines() and without the lines that go.

    Rows of one id lose the lines at the same places. A column with the name of a result column is replaced.
    """
    made = ["n_lines", "n_removed", "n_near"]
    on = kept(docs, None, [*made, text])
    gone = drop_repeated_lines(docs, t, doc_id, text).withColumnRenamed("doc_id", "_of")
    rows = docs.select(row(on).alias("_row"), F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_t")).join(gone, F.col("_id").eqNullSafe(F.col("_of")))
    left = F.array_join(F.filter(F.split("_t", "\n", -1), lambda x, i: ~F.array_contains("removed", i)), "\n")
    return rows.select(*unpacked(on), F.when(F.col("_t").isNotNull(), left).alias(text), *made)
