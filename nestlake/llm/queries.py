"""Queries over the shared tables for the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, langid, mixing, neardup, sentences, suffixes, tokenfiles, tokens
from .shared import documents

#: The tokenizer of the queries; the operators take any file of the same kind.
TOKENIZER = "word_bpe_49k.json"


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_mixture_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), _tokenizer())


def op3_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its block, slot and place in the mixture."""
    d = documents(spark, sf_dir).select("doc_id", "source")
    return mixing.pfair_mix(d)


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.repeats_report(documents(spark, sf_dir), run=sentences.RUN)


def op6_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), words=4)


def op7_block_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = documents(spark, sf_dir, "embeddings")
    return ann.nearest(e.where(F.col("vec_id") % 100 == 0), e)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.chat_digest(c.unionByName(extra))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_files(documents(spark, sf_dir), _tokenizer())


def op10_suffix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.substring_report(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_mixture_language, op2_token_counts, op3_pfair_mix, op4_winnowing, op5_sentence_spans, op6_hamming_join, op7_block_matrix, op8_chat, op9_token_files, op10_suffix_intervals]
    return {f.__name__: f for f in found}


OP4_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w, row_number() over () rid from documents),
b as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where item_id is not null),
bw as (select distinct item, least(len(w), 8) n, array_to_string(w[s:s + least(len(w), 8) - 1], ' ') win from (select item, w, unnest(range(1, len(w) - least(len(w), 8) + 2)) s from b where len(w) > 0)),
dw as (select doc_id, rid, s, n, array_to_string(w[s:s + n - 1], ' ') win from (select doc_id, rid, w, n, unnest(range(1, len(w) - n + 2)) s from d, (select distinct n from bw) where len(w) >= n)),
h as (select doc_id, rid, s, dw.n, item from dw join bw on dw.win = bw.win and dw.n = bw.n),
hit as (select rid, count(distinct p) n_hit from (select rid, unnest(range(s, s + n)) p from (select distinct rid, s, n from h)) group by rid),
it as (select rid, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct rid, item from h) group by rid)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
sha256(coalesce(items, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated from d left join hit using (rid) left join it using (rid)
"""

OP8_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
union all select * from (values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)),
e as (select *, replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l') esc, replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c') escrole from c)
select conv_id, count(*) n_turns,
sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) loss_chars,
sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) loss_sha256,
cast(sum(length(escrole) + length(esc) + 15) as bigint) formatted_chars
from e group by conv_id
"""

OP6_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') g from (select doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by 1),
i as (select a.doc_id a, b.doc_id b, count(*) i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select i.a, i.b from i join n x on x.doc_id = i.a join n y on y.doc_id = i.b where 100 * i.i >= 80 * (x.n + y.n - i.i)),
r as (select doc_id a, doc_id b from d union select r.a, e.b from r join e on r.b = e.a),
c as (select a doc_id, min(b) component_id from r group by 1)
select d.doc_id, cast(coalesce(n, 0) as bigint) n_shingles, component_id, d.doc_id = component_id kept from d left join n using (doc_id) join c using (doc_id)
"""

OP7_SQL = """
with e as (select vec_id, cast(embedding as double[]) v from embeddings
where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.vec_id query_id, c.vec_id, list_distance(q.v, c.v) score from e q join e c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score, vec_id) as int) "rank", vec_id, score from p)
select * from r where "rank" <= 10
"""

OP10_SQL = """
with d as (select row_number() over () rid, doc_id, lower(hex(encode(coalesce(text, '')))) h from documents),
w as (select rid, doc_id, i, substr(h, 2 * i - 1, 100) win from (select rid, doc_id, h, unnest(range(1, length(h) // 2 - 48)) i from d where doc_id is not null and length(h) >= 100)),
m as (select win, min(doc_id) least from w group by win having min(doc_id) < max(doc_id)),
b as (select rid, i, coalesce(lag(i) over (partition by rid order by i) + 50, 0) covered from w join m using (win) where doc_id > least),
s as (select rid, i begins, coalesce(lead(i) over (partition by rid order by i), 9223372036854775807) next, max(i) over (partition by rid) last, i > covered from b where i > covered),
e as (select rid, begins, (select max(b.i) from b where b.rid = s.rid and b.i >= s.begins and b.i < s.next) + 50 ends from s),
k as (select rid, list(struct_pack(a := begins, z := ends) order by begins) cuts, sum(ends - begins) n, count(*) c from e group by rid)
select doc_id, cast(length(h) // 2 as bigint) n_bytes, cast(coalesce(n, 0) as bigint) n_removed, cast(coalesce(c, 0) as bigint) n_spans,
sha256(unhex(case when n is null then h else array_to_string(list_transform(range(1, len(cuts) + 2), lambda j: substr(h, case when j = 1 then 1 else 2 * cuts[j - 1].z - 1 end, case when j = 1 then 2 * cuts[1].a - 2 when j > len(cuts) then length(h) else 2 * (cuts[j].a - cuts[j - 1].z) end)), '') end)) kept_sha256
from d left join k using (rid)
"""

SQL: dict[str, str] = {"op4_winnowing": OP4_SQL, "op6_hamming_join": OP6_SQL, "op7_block_matrix": OP7_SQL, "op8_chat": OP8_SQL, "op10_suffix_intervals": OP10_SQL}
