"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

States are a role and whether a line begins a turn or goes on with it. A line shows a speaker marker
(or none) and features of its form. Start, transition and form probabilities are counted over
labelled turns by one Spark aggregation each; marker probabilities are fixed values. Viterbi finds the
best states of a transcript, lines that begin a turn part it, and turns are rendered one way.

A transcript is one row. Conversations become transcripts in blocks of BLOCK_TURNS turns, which bounds
a row; a longer conversation is parsed block by block, none of it is left out.

Defined cases: a null or empty transcript has no lines and no turns; lines of white space join the turn
they stand in; a null turn is turn 0; a row without conv_id is a conversation of its own; turns of
other roles than ROLES, of null role or null text are left out of training, and written with the role
they have; without labelled turns the probabilities are even and markers alone decide; ties go to
the state that is first; repeated rows are parsed each by itself; a column with the name of a result
column is replaced.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argosy.llm.common import kept, map_batches

ROLES = ("system", "user", "assistant")
BLOCK_TURNS = 4096
#: What is trimmed off a line before its form is read, while counting as while parsing.
SPACES = " \t\n\x0b\f\r"
#: What speakers are called in transcripts.
NAMES = {
    "system": "system instruction instructions context",
    "user": "user human prompt question q customer me you",
    "assistant": "assistant ai bot gpt model response answer a agent",
}
SPEAKER = {name: role for role, names in NAMES.items() for name in names.split()}
_NAME = "|".join(sorted(SPEAKER, key=len, reverse=True))
MARKER = re.compile(rf"^\s*(?:<\|(?:im_start\|>)?({_NAME})(?:\|>)?|\[({_NAME})\]|#{{1,4}}\s*({_NAME})\s*:?\s*$|#{{1,4}}\s*({_NAME})\s*:|\**({_NAME})\**\s*:\**)\s*", re.I)
#: Chances that a line shows the marker of its own role, none, or another's.
FIRST_MARK, FIRST_NONE, LATER_NONE = 0.7, 0.28, 0.99
FLOOR = 1e-6


def marker_of(line: str) -> tuple[str | None, str]:
    """(role, rest of the line)."""
    m = MARKER.match(line)
    return (SPEAKER[next(x for x in m.groups() if x).lower()], line[m.end() :]) if m else (None, line)


def form_of(line: str) -> int:
    """Length in four steps, a question, a capital at the start: one of 16 forms."""
    x = line.strip(SPACES)
    return min(3, len(x) // 60) * 4 + 2 * x.endswith("?") + x[:1].isupper()


def form_column(line: Column) -> Column:
    """form_of() as a column, for counting."""
    x = F.btrim(line, F.lit(SPACES))
    return F.least(F.lit(3), F.floor(F.length(x) / 60)).cast("int") * 4 + F.when(F.endswith(x, F.lit("?")), 2).otherwise(0) + F.when(x.rlike(r"^\p{Lu}"), 1).otherwise(0)


class Model:
    """Log probabilities of start, transition and form; state 2r begins a turn of role r, state 2r + 1 goes on with it."""

    def __init__(self, starts: dict, follows: dict, stays: dict, forms: dict) -> None:
        n = len(ROLES)
        share = lambda counts, keys: [math.log((counts.get(k, 0) + 1) / (sum(counts.get(j, 0) for j in keys) + len(keys))) for k in keys]
        start = share(starts, range(n))
        self.start = [start[s // 2] if s % 2 == 0 else math.log(FLOOR) for s in range(2 * n)]
        self.move = [[math.log(FLOOR)] * (2 * n) for _ in range(2 * n)]
        for s in range(2 * n):
            stay = share({k: stays.get((s // 2, k), 0) for k in (0, 1)}, (0, 1))
            to = share({r: follows.get((s // 2, r), 0) for r in range(n)}, range(n))
            for r in range(n):
                self.move[s][2 * r] = stay[0] + to[r]
            self.move[s][s // 2 * 2 + 1] = stay[1]
        self.form = [share({k: forms.get((s, k), 0) for k in range(16)}, range(16)) for s in range(2 * n)]
        other = (1 - FIRST_MARK - FIRST_NONE) / (n - 1)
        self.mark = [{r: math.log((FIRST_MARK if r == s // 2 else other) if s % 2 == 0 else (1 - LATER_NONE) / n) for r in range(n)} | {None: math.log(FIRST_NONE if s % 2 == 0 else LATER_NONE)} for s in range(2 * n)]

    def viterbi(self, seen: list[tuple[int | None, int]]) -> list[int]:
        """The likeliest states of lines that show (marker, form)."""
        states, back, best = range(2 * len(ROLES)), [], None
        for mark, form in seen:
            here = [self.mark[s][mark] + self.form[s][form] for s in states]
            if best is None:
                best = [self.start[s] + here[s] for s in states]
                continue
            came = [max(states, key=lambda p, s=s: best[p] + self.move[p][s]) for s in states]
            best = [best[came[s]] + self.move[came[s]][s] + here[s] for s in states]
            back.append(came)
        if best is None:
            return []
        path = [max(states, key=lambda s: best[s])]
        for came in reversed(back):
            path.append(came[path[-1]])
        return path[::-1]

    def parse(self, transcript: str | None) -> tuple[list[str], list[tuple[str, str]]]:
        """The role of each line, and the turns as (role, text)."""
        roles: list[str] = []
        turns: list[tuple[str, list[str]]] = []
        lines = [marker_of(x) for x in transcript.split("\n")] if transcript else []
        seen = [(ROLES.index(role) if role else None, form_of(rest)) for role, rest in lines]
        for state, (role, rest) in zip(self.viterbi(seen), lines, strict=True):
            name = ROLES[state // 2]
            if state % 2 == 0 or not turns:
                turns.append((name, []))
            turns[-1][1].append(rest)
            roles.append(name)
        return roles, [(name, "\n".join(x).strip()) for name, x in turns]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def _role(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ROLES)), F.lower(c)).cast("int") - 1


def train(turns: DataFrame) -> Model:
    """Count (conv_id, turn, role, text) rows whose role is known; a few hundred counts come to the driver."""
    known = turns.select("conv_id", "turn", _role(F.col("role")).alias("r"), F.col("text").alias("x")).filter("r >= 0 AND x IS NOT NULL")
    w = Window.partitionBy("conv_id").orderBy("turn", "r", "x")
    alone = known.filter("conv_id IS NULL").select("r", F.lit(None).cast("int").alias("p"))
    steps = known.filter("conv_id IS NOT NULL").select("r", F.lag("r").over(w).alias("p")).unionAll(alone).groupBy("p", "r").agg(F.count("*").alias("n")).collect()
    lines = known.select("r", F.posexplode(F.split("x", "\n", -1)).alias("i", "line")).withColumns({"later": (F.col("i") > 0).cast("int"), "form": form_column(F.col("line"))})
    forms = lines.groupBy("r", "later", "form").agg(F.count("*").alias("n")).collect()
    stays: dict = {}
    for x in forms:
        stays[x.r, x.later] = stays.get((x.r, x.later), 0) + x.n
    return Model({x.r: x.n for x in steps if x.p is None}, {(x.p, x.r): x.n for x in steps if x.p is not None}, stays, {(2 * x.r + x.later, x.form): x.n for x in forms})


TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
FIELDS = [T.StructField("line_roles", T.ArrayType(T.StringType())), T.StructField("turns", T.ArrayType(TURN)), T.StructField("rendered", T.StringType())]


def format_transcripts(transcripts: DataFrame, model: Model, text: str = "transcript", keep: list[str] | None = None) -> DataFrame:
    """Transcripts with line_roles, turns and rendered. keep: the columns that go on (all if None)."""

    def run(batch: pa.RecordBatch) -> list:
        parsed = [model.parse(x) for x in batch.column(text).to_pylist()]
        return [[r for r, _ in parsed], [[{"role": a, "text": b} for a, b in t] for _, t in parsed], [render(t) for _, t in parsed]]

    return map_batches(transcripts, run, FIELDS, kept(transcripts, keep, []))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, name, text, n): the turns of each conversation with their place from 0.

    Places are counted in runs of BLOCK_TURNS turn values and shifted by the runs before, so that a long
    conversation is not sorted in one task.
    """
    t = turns.select("conv_id", "turn", F.coalesce(F.lower("role"), F.lit("user")).alias("name"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("turn", F.lit(0)).alias("_t"))
    own, shared = t.filter("conv_id IS NULL"), t.filter("conv_id IS NOT NULL").withColumn("_c", F.floor(F.col("_t") / BLOCK_TURNS))
    before = Window.partitionBy("conv_id").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    shift = shared.groupBy("conv_id", "_c").agg(F.count("*").alias("_k")).select("conv_id", "_c", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy("conv_id", "_c").orderBy("_t", "text", "name")) - 1
    placed = shared.withColumn("_i", place).join(shift, ["conv_id", "_c"])
    return placed.select("conv_id", "turn", "name", "text", (F.col("_o") + F.col("_i")).alias("n")).unionAll(own.select("conv_id", "turn", "name", "text", F.lit(0).cast("long").alias("n")))


def transcripts_of(turns: DataFrame) -> DataFrame:
    """(conv_id, block, transcript, true_roles): turns written as people paste them, in one of four styles a conversation.

    Every fifth turn after the first of its block, by hash, has no marker, so that the model has to find it.
    """
    name = F.col("name")
    styles = F.array(F.concat(F.initcap(name), F.lit(": ")), F.concat(F.lit("### "), F.initcap(name), F.lit(":\n")), F.concat(F.lit("<|"), name, F.lit("|>\n")), F.concat(F.lit("**"), F.upper(name), F.lit("**: ")))
    bare = (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0) & (F.col("n") % BLOCK_TURNS > 0)
    mark = F.when(bare, F.lit("")).otherwise(F.get(styles, F.pmod(F.xxhash64("conv_id"), F.lit(4)).cast("int")))
    text = F.concat(mark, F.col("text"))
    one = F.struct("n", text.alias("text"), F.array_repeat(name, F.size(F.split(text, "\n", -1))).alias("roles"))
    all_turns = numbered(turns).withColumns({"block": F.floor(F.col("n") / BLOCK_TURNS), "_one": one})
    whole = all_turns.filter("conv_id IS NOT NULL").groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("_one")).alias("t"))
    whole = whole.unionByName(all_turns.filter("conv_id IS NULL").select("conv_id", "block", F.array("_one").alias("t")))
    return whole.select("conv_id", "block", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("transcript"), F.flatten(F.transform("t", lambda x: x["roles"])).alias("true_roles"))
