"""Retrieval: company inference, candidate generation, top-k by word overlap or by vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from argosy.functions import text as tx
from argosy.operators import vector_blocks
from argosy.session import with_checkpoint_dir

SEED = 8
#: So many distinct tokens of questions go to every task, so that chunks need not be dealt by token.
FEW_TOKENS = 200_000
# Fixed value: what is asked about a company behind its name.
COMPANY_QUERY = "financial report risks financial statements performance"


def where(df: DataFrame, equal: dict) -> DataFrame:
    """Rows in which every named column equals its value; a null or absent value never does."""
    for name, value in equal.items():
        df = df.filter(F.col(name) == value) if name in df.columns else df.filter(F.lit(False))
    return df


def get(df: DataFrame, equal: dict | None = None, limit: int | None = None, include: list[str] | None = None, order: str = "chunk_id") -> DataFrame:
    """Rows where columns equal values, the first ``limit`` by ``order`` (all if None), with the ``include`` columns."""
    rows = where(df, equal or {})
    rows = rows if limit is None else rows.orderBy(order).limit(limit)
    return rows if include is None else rows.select(*dict.fromkeys([order, *include]))


def session(df: DataFrame, analysis_id: str) -> DataFrame:
    """The rows of one analysis session."""
    return where(df, {"analysis_id": analysis_id})


def sample_one(df: DataFrame, equal: dict | None = None) -> DataFrame:
    """Any one row where columns equal values; none if there is none."""
    return where(df, equal or {}).limit(1)


def infer_company(questions: DataFrame, companies: DataFrame, question: str = "sub_question", key: str = "qid") -> DataFrame:
    """Add company: the first by code point whose lower-cased name is part of the lower-cased question; null if none.

    A name that is part of a question shares all its grams of SEED characters with it (a shorter one: itself), so it is looked
    for by the one gram that fewest names have, an equi-join, and then tested whole. Words that most names share, such as
    their legal form, so bring no name and question together.
    """
    names = companies.select(F.col("company").alias("_name")).filter("_name != ''").distinct()
    at = lambda c, n: F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1))
    grams = F.array_distinct(F.transform(at(F.lower("_name"), SEED), lambda i: F.substring(F.lower("_name"), i, SEED)))
    each = names.select("_name", F.explode(grams).alias("_seed"))
    shared = each.groupBy("_seed").agg(F.count("*").alias("_n"))
    rarest = each.join(shared, "_seed").groupBy("_name").agg(F.min(F.struct("_n", "_seed"))["_seed"].alias("_seed"))
    # a name's gram has SEED characters or is all of the name, so these are the lengths to look for
    sizes = names.agg(F.collect_set(F.least(F.length(F.lower("_name")), F.lit(SEED))).alias("_sizes"))
    low = F.lower(F.col(question))
    seeds = F.array_distinct(F.flatten(F.transform("_sizes", lambda n: F.transform(at(low, n), lambda i: F.substring(low, i, n)))))
    asked = questions.crossJoin(F.broadcast(sizes)).select(F.col(key).alias("_key"), F.explode(seeds).alias("_seed"))
    texts = questions.select(F.col(key).alias("_key"), low.alias("_low"))
    met = asked.join(rarest, "_seed").select("_key", "_name").join(texts, "_key")
    found = met.filter(F.contains("_low", F.lower("_name"))).groupBy("_key").agg(F.min("_name").alias("company"))
    return questions.drop("company").join(found, F.col(key) == F.col("_key"), "left").drop("_key")


def top_k(scored: DataFrame, k: int, by: str, score: Column, order: list[str]) -> DataFrame:
    """The k best rows of each ``by``, rank from 1; ties by ``order``."""
    w = Window.partitionBy(by).orderBy(score.desc(), *order)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_overlap(asked: DataFrame, held: DataFrame, k: int, work: Observation | None = None) -> DataFrame:
    """(qid, grp, chunk_id, score, rank): the k chunks of each question that share most of its tokens, ties by order.

    asked: qid, grp, q (distinct tokens); held: chunk_id, chunk_order, t (distinct tokens), grps, the groups in which the chunk
    can be found. A question meets the chunks of its group. Exact, without holding every question against every chunk of a
    common token:

    * Only tokens that questions have count. Chunks of a group that have the same of them score alike for every question, so
      they are one class, of which the k first by order can be needed.
    * The k first classes of each token's list give a question k chunks, and so a floor under its k-th score.
    * A chunk that reaches the floor has one at least of the question's tokens but the (floor - 1) most frequent. Only the
      lists of these rarer tokens are joined; the others are looked up in the classes found.

    A question with fewer than k such chunks gets the first chunks of its group with score 0. ``work`` is told how many
    (question, class) pairs were scored behind the floor.
    """
    with_checkpoint_dir(held.sparkSession)
    asked = asked.select("qid", "grp", "q").checkpoint()
    words = asked.select("qid", "grp", F.explode("q").alias("token"))
    sought = words.select("token").distinct().withColumn("_sought", F.lit(True))
    sought = sought.checkpoint()
    sought = F.broadcast(sought) if sought.count() <= FEW_TOKENS else sought
    tokens = held.select("grps", "chunk_id", "chunk_order", F.explode_outer("t").alias("token")).join(sought, "token", "left")
    marked = tokens.groupBy("grps", "chunk_id", "chunk_order").agg(F.array_sort(F.collect_set(F.when(F.col("_sought"), F.col("token")))).alias("mark"))
    marked = marked.select(F.explode("grps").alias("grp"), "chunk_id", "chunk_order", "mark")
    place = Window.partitionBy("grp", "mark").orderBy("chunk_order")
    members = marked.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= k)
    listed = members.groupBy("grp", "mark").agg(F.array_sort(F.collect_list(F.struct("chunk_order", "chunk_id"))).alias("members"))
    classes = listed.select("grp", "mark", "members", F.col("members")[0]["chunk_order"].alias("first"), F.monotonically_increasing_id().alias("class")).checkpoint()

    lists = classes.select("grp", F.explode("mark").alias("token"), "class", "first")
    often = lists.groupBy("grp", "token").agg(F.count("*").alias("often"))
    rare, whole = Window.partitionBy("qid", "grp").orderBy("often", "token"), Window.partitionBy("qid", "grp")
    words = words.join(often, ["grp", "token"]).select("qid", "grp", "token", F.row_number().over(rare).alias("at"), F.count("*").over(whole).alias("known"))

    def scored(found: DataFrame) -> DataFrame:
        """(qid, grp, shared, members) of distinct (qid, grp, class)."""
        both = found.join(classes.select("class", "mark", "members"), "class").join(asked, ["qid", "grp"])
        return both.select("qid", "grp", F.size(F.array_intersect("q", "mark")).alias("shared"), "members")

    head = Window.partitionBy("grp", "token").orderBy("first")
    heads = lists.withColumn("_n", F.row_number().over(head)).filter(F.col("_n") <= k)
    tried = scored(words.join(heads, ["grp", "token"]).select("qid", "grp", "class").distinct())
    order = Window.partitionBy("qid", "grp").orderBy(F.desc("shared")).rowsBetween(Window.unboundedPreceding, 0)
    floor = tried.withColumn("_sum", F.sum(F.size("members")).over(order)).filter(F.col("_sum") >= k).groupBy("qid", "grp").agg(F.max("shared").alias("floor"))
    needed = words.join(floor, ["qid", "grp"], "left").filter(F.col("at") <= F.col("known") - F.coalesce("floor", F.lit(1)) + 1)
    met = needed.join(lists, ["grp", "token"]).select("qid", "grp", "class").distinct()
    met = met if work is None else met.observe(work, F.count(F.lit(1)).alias("pairs"))
    hits = scored(met).select("qid", "grp", F.explode("members").alias("_m"), "shared")

    # chunks that share nothing fill up k: the first of a group
    start = Window.partitionBy("grp").orderBy("chunk_order")
    first = classes.select("grp", F.inline("members")).withColumn("_n", F.row_number().over(start)).filter(F.col("_n") <= k)
    spare = asked.select("qid", "grp").join(first.select("grp", F.struct("chunk_order", "chunk_id").alias("_m")), "grp")
    offered = hits.unionByName(spare.withColumn("shared", F.lit(0))).groupBy("qid", "grp", "_m").agg(F.max("shared").alias("shared"))
    best = Window.partitionBy("qid", "grp").orderBy(F.desc("shared"), "_m.chunk_order")
    top = offered.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).join(asked, ["qid", "grp"])
    score = F.coalesce(F.col("shared") / F.nullif(F.size("q"), F.lit(0)), F.lit(0.0))
    return top.select("qid", "grp", F.col("_m.chunk_id").alias("chunk_id"), score.alias("score"), "rank")


def retrieve(questions: DataFrame, chunks: DataFrame, k: int = 4) -> DataFrame:
    """(qid, rank, score, distance) with the chunk's columns: the k best chunks of each question.

    questions: qid, sub_question, company (null: all companies are asked). chunks: chunk_id, company, text, chunk_order; they
    are read twice, so a caller may want to checkpoint them. Scoped questions meet their company's chunks.
    """
    every, of = F.struct(F.lit(True).alias("every"), F.lit(None).cast("string").alias("company")), F.struct(F.lit(False).alias("every"), F.col("company").alias("company"))
    asked = questions.select("qid", F.when(F.col("company").isNull(), every).otherwise(of).alias("grp"), tx.tokens(F.col("sub_question")).alias("q"))
    held = chunks.select("chunk_id", "chunk_order", tx.tokens(F.col("text")).alias("t"), F.array(every, of).alias("grps"))
    best = best_overlap(asked, held, k).drop("grp")
    return best.join(chunks.drop("chunk_order"), "chunk_id").withColumn("distance", F.bround(1 - F.col("score"), 4))


def retrieve_for_company(requests: DataFrame, chunks: DataFrame, k: int = 5, scoped: bool = False) -> DataFrame:
    """(company, collection, rank, score) with the chunk's columns: the k best chunks of a request's collection for a fixed
    question about its company. Chunks of other companies count unless ``scoped``."""
    text = F.concat(F.col("company"), F.lit(f" {COMPANY_QUERY}"))
    tokens = F.coalesce(tx.tokens(text), F.array().cast("array<string>"))
    grp = F.struct(F.col("collection").alias("collection"), (F.col("company") if scoped else F.lit(None).cast("string")).alias("of"))
    named = lambda df: df.filter("collection IS NOT NULL" + " AND company IS NOT NULL" * scoped)
    asked = named(requests).select(F.struct("company").alias("qid"), grp.alias("grp"), tokens.alias("q")).distinct()
    held = named(chunks).select("chunk_id", "chunk_order", tx.tokens(F.col("text")).alias("t"), F.array(grp).alias("grps"))
    best = best_overlap(asked, held, k).select(F.col("qid.company").alias("company"), F.col("grp.collection").alias("collection"), "chunk_id", "rank", "score")
    rest = chunks.withColumnRenamed("company", "chunk_company").drop("chunk_order")
    return best.join(rest, ["collection", "chunk_id"])


def distance(metric: str, x: Column, y: Column) -> Column:
    """The distance of two arrays: l2sq, cosine, or dot (the negative product)."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, v: s + v)
    if metric == "l2sq":
        return F.aggregate(F.zip_with(x, y, lambda i, j: (i.cast("double") - j.cast("double")) * (i.cast("double") - j.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    if metric == "cosine":
        return 1 - dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))
    if metric == "dot":
        return -dot(x, y)
    raise ValueError(f"unknown metric {metric}")


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2sq", equal: dict | None = None) -> DataFrame:
    """(query_id, vec_id, distance, rank): the exact k nearest vectors of each query, of those where columns equal values.

    queries: query_id, q; vectors: vec_id, embedding. Blocks of vectors meet blocks of queries and hand on the k best of each
    query (vector_blocks); vector_index finds them without meeting all.
    """
    held = where(vectors, equal or {}).filter("embedding IS NOT NULL")
    pairs = vector_blocks.candidates(queries, held, k, metric, lambda x, y: distance(metric, x, y))
    return top_k(pairs, k, "query_id", -F.col("distance"), ["vec_id"])
