"""Log lines, checkpoint side files, result records, metric texts, error texts, unreadable files, special ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..functions import clean, fmt, quality, records
from ..operators import bpe
from .build_queries import RATE, RATE_SQL
from .core import query, quote, read
from .math_queries import EV, events
from .text_queries import BLANKS, CODEPAGE_SQL, FILE_SQL, MARKUP_SQL, filter_lines_sql, markup_sql, with_markup

# --- training log ---------------------------------------------------------------------------------------

STAMP = "'[' || lpad((event_id // 3)::varchar, greatest(6, len((event_id // 3)::varchar))::integer, ' ') || 's] '"
STEP = "lpad(event_id::varchar, greatest(6, len(event_id::varchar))::integer, ' ')"
PPL = "printf('%.2f', exp(loss / 100))"
query(
    "s26_training_log",
    f"""select event_id, {STAMP} || case event_id % 50
when 10 then 'EVAL Step ' || {STEP} || ' | Loss: ' || printf('%.4f', loss) || ' | PPL: ' || printf('%.2f', loss / 4)
when 20 then 'CHECKPOINT Step ' || event_id || ' -> out/step_' || event_id
when 30 then '=== EPOCH ' || (event_id // 1000) || ' ==='
when 40 then 'SAMPLE: "user ' || user_id || '" -> "' || substr(repeat('ã' || event_id, 40), 1, 100) || '"'
else 'Step ' || {STEP} || ' | Loss: ' || printf('%.4f', loss / 100) || ' | PPL: ' || lpad({PPL}, greatest(8, len({PPL}))::integer, ' ') || ' | LR: ' || {RATE_SQL} || ' | GradNorm: ' || printf('%.4f', loss / 8) end as line
from {EV} where event_id % 10 = 0""",
)(lambda s, d: _log(events(s, d)))


def _log(rows: DataFrame) -> DataFrame:
    """Every tenth step, as the log does, with each kind of line in turn."""
    i, x, at = F.col("event_id"), F.col("loss"), F.floor(F.col("event_id") / 3)
    rate = F.lit(3e-4) * ((i % 100 + 1).cast("double") / 100)
    sample = F.repeat(F.concat(F.lit("ã"), i.cast("string")), F.lit(40))
    line = (
        F.when(i % 50 == 10, records.eval_line(at, i, x, x / 4))
        .when(i % 50 == 20, records.checkpoint_line(at, i, F.concat(F.lit("out/step_"), i.cast("string"))))
        .when(i % 50 == 30, records.epoch_line(at, F.floor(i / 1000)))
        .when(i % 50 == 40, records.sample_line(at, F.concat(F.lit("user "), F.col("user_id").cast("string")), sample))
        .otherwise(records.step_line(at, i, x / 100, rate, x / 8))
    )
    return rows.filter(i % 10 == 0).select("event_id", line.alias("line"))


# --- checkpoint side file -------------------------------------------------------------------------------

META_RATE = f"regexp_replace(printf('%.6e', {RATE}), 'e([-+])0*([0-9]+)$', 'e\\1\\2')"
META_SQL = f"""(select event_id, case event_id % 5 when 1 then 'step=x' || chr(10) || 'ema_loss=' || chr(10) || 'best_loss=inf.' || chr(10) when 2 then 'total_clips=3' || chr(10) || ' step=5' || chr(10) else
'step=' || event_id || chr(10) || 'lr=' || {META_RATE} || chr(10) || 'ema_loss=' || printf('%.6f', loss) || chr(10) || 'best_loss=' || printf('%.6f', loss / 2) || chr(10) || 'last_update_norm=' || printf('%.6f', loss / 8) || chr(10)
|| case event_id % 5 when 3 then 'step=+' || (event_id + 1) || chr(10) || 'best_loss=1.5e1' else '' end end as meta from {EV})"""
query("s27_meta_text", f"select event_id, meta from {META_SQL}")(lambda s, d: _meta(events(s, d)))


def _after_sql(name: str) -> str:
    return f"list_last(list_filter(string_split(meta, chr(10)), lambda z: starts_with(z, '{name}=')))[{len(name) + 2}:]"


query(
    "s27_meta_read",
    f"""with v as (select event_id, {_after_sql('step')} as a, {_after_sql('ema_loss')} as b, {_after_sql('best_loss')} as c from {META_SQL})
select event_id, case when a is not null then coalesce(try_cast(a as bigint), 0) end as step, case when b is not null then coalesce(try_cast(b as double), 10) end as ema_loss,
case when c is not null then coalesce(try_cast(c as double), {int(fmt.FLOAT_MAX)}.0::double) end as best_loss from v""",
)(lambda s, d: _meta(events(s, d)).select("event_id", *[c.alias(n) for n, c in records.parse_meta(F.col("meta")).items()]))


def _meta(rows: DataFrame) -> DataFrame:
    """Side files as written, with lines that are missing, repeated or no numbers."""
    i, x = F.col("event_id"), F.col("loss")
    written = records.meta_text(i, F.lit(3e-4) * ((i % 100 + 1).cast("double") / 100), x, x / 2, x / 8)
    again = F.concat(written, F.lit("step=+"), (i + 1).cast("string"), F.lit("\nbest_loss=1.5e1"))
    meta = F.when(i % 5 == 1, "step=x\nema_loss=\nbest_loss=inf.\n").when(i % 5 == 2, "total_clips=3\n step=5\n").when(i % 5 == 3, again).otherwise(written)
    return rows.select("event_id", meta.alias("meta"))


# --- results and metrics --------------------------------------------------------------------------------

query(
    "s28_generation_record",
    """with p as (select doc_id, text, strpos(text, ' ') as cut from documents),
g as (select doc_id, text, case when cut > 0 then substr(text, 1, cut - 1) else text end as prompt, case when cut > 0 then substr(text, cut) else '' end as generated from p)
select doc_id, md5(to_json({'full_text': text, 'generated_text': generated, 'model_size': '400m', 'prompt': prompt, 'temperature': 0.8::float::double, 'tokens_generated': strlen(generated), 'top_k': 40})::varchar) as record_md5 from g""",
)(lambda s, d: _generation(read(s, d, "documents")))


def _generation(docs: DataFrame) -> DataFrame:
    """The first word is the prompt, the rest of the text what was made."""
    cut = F.instr("text", " ")
    docs = docs.select("doc_id", F.when(cut > 0, F.substring("text", F.lit(1), cut - 1)).otherwise(F.col("text")).alias("prompt"), F.when(cut > 0, F.substring("text", cut, F.length("text"))).otherwise("").alias("generated"))
    record = records.generation_record(F.col("prompt"), F.col("generated"), F.octet_length("generated").cast("long"), F.lit("400m"), F.lit(0.8), F.lit(40))
    return docs.select("doc_id", F.md5(record).alias("record_md5"))


SUMS = f"""(select user_id, sum(n * l)::double / 10000 / greatest(sum(n), 1) as loss, sum(n)::bigint as tokens, sum(least(n, event_id % 3))::double / greatest(sum(n), 1) as acc1,
sum(least(n, event_id % 3 + 2))::double / greatest(sum(n), 1) as acc5, sum(n * l)::double / 80000 / greatest(sum(n), 1) as h from (select user_id, event_id, event_id % 7 as n, round(loss * 100)::bigint as l from {EV}) group by user_id)"""
query("z13_metric_texts", f"""select user_id, 'Loss: ' || printf('%.4f', loss) || ' | PPL: ' || printf('%.2f', exp(loss)) || ' | Tokens: ' || tokens as evaluation,
'Loss: ' || printf('%.4f', loss) || ' | PPL: ' || printf('%.2f', exp(loss)) || ' | Acc@1: ' || printf('%.2f', acc1 * 100) || '% | Acc@5: ' || printf('%.2f', acc5 * 100) || '% | H: ' || printf('%.2f', h) as validation from {SUMS}""")(
    lambda s, d: _metric_texts(events(s, d))
)


def _metric_texts(rows: DataFrame) -> DataFrame:
    """Means weighted by tokens; nothing evaluated gives a loss of 0."""
    i, n, l = F.col("event_id"), F.col("n"), F.col("l")
    rows = rows.select("user_id", "event_id", (i % 7).alias("n"), F.round(F.col("loss") * 100).cast("long").alias("l"))
    least = F.greatest(F.sum("n"), F.lit(1))
    sums = rows.groupBy("user_id").agg(
        (F.sum(n * l).cast("double") / 10000 / least).alias("loss"), F.sum("n").alias("tokens"), (F.sum(F.least(n, i % 3)).cast("double") / least).alias("acc1"),
        (F.sum(F.least(n, i % 3 + 2)).cast("double") / least).alias("acc5"), (F.sum(n * l).cast("double") / 80000 / least).alias("h"),
    )
    loss, ppl = F.col("loss"), F.exp("loss")
    return sums.select("user_id", records.evaluation_text(loss, ppl, F.col("tokens")).alias("evaluation"), records.validation_text(loss, ppl, F.col("acc1"), F.col("acc5"), F.col("h")).alias("validation"))


FIELDS = {"path": "a/b.txt", "source": "denied", "offset": 8, "reason": "short", "expected": "4", "got": "5", "kernel": "wkv", "id": 70000}
query(
    "z18_error_texts",
    """select * from (values ('FileRead', 'Failed to read file a/b.txt: denied'), ('FileWrite', 'Failed to write file a/b.txt: denied'), ('Io', 'IO Error: denied'), ('FileNotFound', 'File not found: a/b.txt'),
('DataCorrupt', 'Dataset corrupt at byte offset 8: short'), ('MmapError', 'Mmap failed for a/b.txt: denied'), ('DatasetEmpty', 'Dataset empty: a/b.txt'), ('ShapeMismatch', 'Shape mismatch: expected 4, got 5'),
('CheckpointLoad', 'Checkpoint load failed: short'), ('CudaError', 'CUDA kernel `wkv` failed: short'), ('CudaUnavailable', 'CUDA unavailable — compile with --features cuda'), ('TokenizerError', 'Tokenizer error: short'),
('TokenizerLoad', 'Tokenizer load failed: short'), ('UnknownToken', 'Unknown token ID: 70000'), ('ConfigError', 'Invalid config: short')) t(kind, text)""",
)(lambda s, d: s.createDataFrame([(name, str(kind(**FIELDS))) for name, kind in errors.KINDS.items()], "kind string, text string"))

# --- files ----------------------------------------------------------------------------------------------

query("s7_unreadable_files", f"select doc_id, case when doc_id % 50 = 0 then 0 else bytes end as bytes, case when doc_id % 50 = 0 then 0 else score end as score, case when doc_id % 50 = 0 then 'Erro leitura' else issues end as issues from {FILE_SQL}")(
    lambda s, d: quality.score_contents(read(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 50 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))).otherwise(F.encode("text", "UTF-8")).alias("content")), "content")
    .select("doc_id", "bytes", "score", F.array_join("issues", "; ").alias("issues"))
)
CLEAN_SQL = "(with a as (select doc_id, " + markup_sql(CODEPAGE_SQL.format("text")) + f" as text from {MARKUP_SQL}) select doc_id, trim({filter_lines_sql('text')}, {quote(BLANKS)}) as text from a)"
query("f4_clean_minimum", f"select doc_id, strlen(text)::integer as bytes from {CLEAN_SQL} where strlen(text) >= 200")(
    lambda s, d: with_markup(s, d).select("doc_id", F.octet_length(clean.clean(F.col("text"), entities=False)).alias("bytes")).filter(F.col("bytes") >= 200)
)
ENTITY = "&(amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);"
query(
    "c0_5_unescape",
    f"""with t as (select doc_id, concat(text, case doc_id % 4 when 0 then ' &lt;a&gt; &#65;&#xe9;' when 1 then ' &bad; &lt;' when 2 then ' &amp;lt; &quot;&apos;' else ' &lt; & b' end) as x from documents)
select doc_id, case when contains(regexp_replace(x, '{ENTITY}', '', 'g'), '&') then x else array_to_string(list_transform(regexp_extract_all(x, '{ENTITY}|[^&]+'),
lambda z: case when z = '&amp;' then '&' when z = '&lt;' then '<' when z = '&gt;' then '>' when z = '&quot;' then '"' when z = '&apos;' then chr(39) when starts_with(z, '&#x') then chr(('0x' || z[4:-2])::integer) when starts_with(z, '&#') then chr(z[3:-2]::integer) else z end), '') end as text from t""",
)(lambda s, d: read(s, d, "documents").select("doc_id", clean.unescape(F.concat("text", F.when(F.col("doc_id") % 4 == 0, " &lt;a&gt; &#65;&#xe9;").when(F.col("doc_id") % 4 == 1, " &bad; &lt;").when(F.col("doc_id") % 4 == 2, " &amp;lt; &quot;&apos;").otherwise(" &lt; & b"))).alias("text")))


def _special_ids(spark) -> DataFrame:
    """Ids by name of three vocabularies: all names, none of the padding or unknown ones, another order."""
    made = {"usual": bpe.Vocabulary.base(), "edges": bpe.Vocabulary.base(special=["[BOS]", "[EOS]"]), "turned": bpe.Vocabulary.base(special=["[EOS]", "[UNK]", "[BOS]", "[PAD]"])}
    return spark.createDataFrame([(n, v.pad, v.unknown, *v.edges()) for n, v in made.items()], "vocabulary string, pad int, unknown int, first int, last int")


query("j6_special_ids", "select * from (values ('usual', 256, 257, 258, 259), ('edges', 0, 1, 256, 257), ('turned', 259, 257, 258, 256)) t(vocabulary, pad, unknown, first, last)")(lambda s, d: _special_ids(s))
