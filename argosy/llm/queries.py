"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosy.llm import chat, decontaminate, html, langid, linedup, mix, nearest, neardup, quality, shard, spelling, substring, whiten
from argosy.session import table


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix.mix(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    held_out = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))) % 3 == 1
    model = chat.train(turns.filter(~held_out))
    out = chat.format_transcripts(chat.transcripts_of(turns), model, keep=["conv_id", "block", "true_roles"])
    right = F.size(F.filter(F.arrays_zip("line_roles", "true_roles"), lambda x: x["line_roles"] == x["true_roles"]))
    return out.select(
        "conv_id", "block", held_out.alias("held_out"), F.size("line_roles").alias("n_lines"), right.alias("n_right"), F.size("turns").alias("n_turns"), "rendered"
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])


def op6_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_near", F.array_join("removed", ",").alias("removed"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    out = shard.shard(docs, keep=["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring.remove_repeats(docs, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("held_out"))
    model = langid.train(docs.filter(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model, keep=["doc_id", "held_out"])


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whiten.fit(vectors)
    out = whiten.whiten(vectors, model, keep=["vec_id"])
    error = whiten.identity_error(out, model.rows, len(model.variances))
    each = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.lit(model.explained or [0.0]).cast("array<double>"), F.col("at") + 1)
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.rows).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"pipeline": pipeline, "op1_decontaminate": op1_decontaminate, "op2_mix": op2_mix, "op3_html": op3_html, "op4_chat": op4_chat, "op5_quality": op5_quality, "op6_linedup": op6_linedup, "op7_shard": op7_shard, "op8_substring": op8_substring, "op9_langid": op9_langid, "op10_neardup": op10_neardup, "op11_whiten": op11_whiten, "op12_nearest": op12_nearest, "op13_spelling": op13_spelling}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_decontaminate": rf"""
with it as (
  select cast(item_id as varchar) as item, ws, len(ws) as n from (
    select item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark)
  where item_id is not null and len(ws) > 0),
win as (
  select distinct item, least(n, 13) as k, ws[p:p + least(n, 13) - 1] as w
  from it, unnest(range(1, n - least(n, 13) + 2)) t(p)),
d as (
  select row_number() over () as rn, doc_id, coalesce(ws, []) as ws, coalesce(len(ws), 0) as n from (
    select doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents)),
dw as (
  select rn, k, p, ws[p:p + k - 1] as w
  from d, (select distinct k from win), unnest(range(1, n - k + 2)) t(p)),
occ as (select rn, p, k, item from dw join win using (k, w)),
hit as (select rn, count(distinct q) as n_hit from occ, unnest(range(p, p + k)) t(q) group by rn),
its as (select rn, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rn, item from occ) group by rn)
select doc_id, n as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= n as contaminated
from d left join hit using (rn) left join its using (rn)""",
    "op8_substring": r"""
with d as (
  select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents),
win as (select doc_id, p, md5(array_to_string(ws[p:p + 12], ' ')) as w from d, unnest(range(1, len(ws) - 11)) t(p)),
late as (select doc_id, p from (select doc_id, p, min(doc_id) over (partition by w) as m from win) where doc_id > m),
gone as (select distinct doc_id, q from late, unnest(range(p, p + 13)) t(q)),
word as (select doc_id, q, ws[q] as x from d, unnest(range(1, len(ws) + 1)) t(q)),
left_ as (select doc_id, string_agg(x, ' ' order by q) as kept, count(*) as n from word anti join gone using (doc_id, q) group by doc_id)
select doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join left_ using (doc_id)""",
    "op12_nearest": """
with v as (select distinct vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e) as score from v q join v c on q.vec_id % 20 = 0 and q.vec_id is distinct from c.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20""",
}
