"""The operators of this subpackage as registered queries, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpechunk, chatfmt, htmltext, ordermin, pii, simhash, subdedup, tokencount, toxicity, winnow
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).select("doc_id", "held_out", "score", "predicted")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, words=1, radius=2).select("doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), 512)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpechunk.encode(table(spark, sf_dir, "documents"), tokenizer_path(), keep=False)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subdedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The conversation that op10 adds to the table.
CONTROL = r"\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats the table and a control conversation -7; turns that the table itself has under -7 are part of that conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    back = chatfmt.read_back(chatfmt.format_windows(turns.unionByName(extra)))
    return back.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def queries() -> dict:
    made = [op1_toxicity, op2_simhash, op3_token_counts, op4_pii, op5_order_minhash, op6_html_text, op7_bpe, op8_decontaminate, op9_substring_dedup, op10_chat]
    return {f.__name__: f for f in made}


OP8_SQL = r"""
with d as (select row_number() over () as r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
           from documents),
b as (select distinct item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
      from benchmark where text is not null and item_id is not null),
bw as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as s
       from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select r, n, i, array_to_string(w[i : i + n - 1], ' ') as s
       from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hits as (select dw.r, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.s = bw.s),
pos as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + n)) as j from hits) group by r),
its as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items
        from (select distinct r, cast(item_id as varchar) as item from hits) group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos on d.r = pos.r left join its on d.r = its.r
"""

OP9_SQL = r"""
with d as (select row_number() over (order by doc_id nulls first, text nulls first) as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select r, i, row_number() over (partition by s order by r, i) as nth
        from (select r, i, array_to_string(w[i : i + 19], ' ') as s from (select r, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20))),
gone as (select distinct r, unnest(range(i, i + 20)) as j from win where nth > 1),
words as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as j from d where len(w) > 0),
kept as (select words.r, string_agg(word, ' ' order by words.j) as kept, count(*) as n
         from words left join gone on words.r = gone.r and words.j = gone.j where gone.r is null group by words.r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(len(d.w) - coalesce(kept.n, 0) as bigint) as n_removed, sha256(coalesce(kept.kept, '')) as kept_sha256
from d left join kept on d.r = kept.r
"""

OP10_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as nth,
             cast(len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]')) + 4 as bigint) as tok,
             15 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g')) as chars
      from c),
e as (select *, cast(sum(tok) over (partition by conv_id order by nth) as bigint) as fin from o),
w as (select *, 2 * ((fin - 1) // 384) + case when tok > 384 then 0 else 1 end as win from e),
p as (select *, lag(win) over (partition by conv_id order by nth) as pwin, lag(tok) over (partition by conv_id order by nth) as ptok,
             lag(chars) over (partition by conv_id order by nth) as pchars, lag(role) over (partition by conv_id order by nth) as prole from w),
one as (select conv_id, win as first_win, tok as sys_tok, chars as sys_chars from w where nth = 1 and role = 'system'),
wins as (select conv_id, win, sum(tok) as spent, max(case when pwin <> win and ptok <= 256 and not (nth = 2 and prole = 'system') then ptok end) as hist_tok,
                max(case when pwin <> win and ptok <= 256 and not (nth = 2 and prole = 'system') then pchars end) as hist_chars from p group by conv_id, win),
said as (select wins.*, case when one.first_win <> wins.win and spent + sys_tok <= 1024 then sys_tok end as kept_tok, sys_chars
         from wins left join one on wins.conv_id is not distinct from one.conv_id),
again as (select conv_id, sum(case when kept_tok is not null then sys_chars else 0 end
                              + case when spent + coalesce(kept_tok, 0) + hist_tok <= 1024 then hist_chars else 0 end) as chars from said group by conv_id),
body as (select conv_id, cast(count(*) as bigint) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by nth) as turns,
                coalesce(string_agg(text, '' order by nth) filter (where role = 'assistant'), '') as loss,
                sum(chars) as chars
         from w group by conv_id)
select body.conv_id, n_turns, sha256(turns) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256,
       cast(body.chars + again.chars as bigint) as formatted_chars
from body join again on body.conv_id is not distinct from again.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_decontaminate": OP8_SQL, "op9_substring_dedup": OP9_SQL, "op10_chat": OP10_SQL}
