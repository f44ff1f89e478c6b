"""The dataset build and its windows, reports, presets and the vocabulary pilot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fmt, schedule, vector
from ..operators import bpe, build, pilot, segment
from .core import query, quote, read
from .math_queries import EV, LG, R, events, logits, rounded
from .text_queries import BLANKS, BLOCK_SQL, LINE_SQL, PRE_SQL, TRIM, WEIGHTED_SQL, audited, normalise_sql, with_blocks

# --- the build: filter, normalise, filter, encode, [BOS] and [EOS], over weighted sources ----------

LEAST = 100
FLUSH_SQL = f"""f as (select b.doc_id, text, greatest(weight, 1) as passes, contains(text, chr(10) || chr(10)) as by_block from {BLOCK_SQL} b join {WEIGHTED_SQL} w on b.doc_id = w.doc_id),
l as (select doc_id, by_block, unnest(range(0, len(x))) as n, unnest(x) as line from (select doc_id, by_block, string_split(text, chr(10)) as x from f)),
m as (select *, trim(line, {quote(BLANKS)}) = '' as blank from l),
g as (select *, sum(case when blank then 1 else 0 end) over (partition by doc_id order by n) as grp from m),
parts as (select doc_id, n as part, line as text from g where not by_block union all
  select doc_id, row_number() over (partition by doc_id order by grp) - 1, string_agg(line, chr(10) order by n) from g where by_block and not blank group by doc_id, grp),
kept as (select * from (select doc_id, part, {normalise_sql('nfc_normalize(t)')} as text from (select doc_id, part, {TRIM.format('text')} as t from parts) where strlen(t) >= {LEAST}) where strlen(text) >= {LEAST}),
pieces as {PRE_SQL.replace("from documents", "from (select doc_id * 100000 + part as doc_id, text from kept)").strip()},
docs as (select doc_id // 100000 as doc_id, (doc_id % 100000)::integer as part, string_agg(word, '' order by n) as s from pieces group by 1, 2),
coded as (select doc_id, part, list_concat(list_concat([258], list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda z: ('0x' || z)::integer)), [259]) as tokens from docs)"""


def built(spark, d) -> DataFrame:
    weights = read(spark, d, "documents").select("doc_id", (F.substring("source", 4, 10).cast("int") % 3).alias("weight"))
    return build.build(with_blocks(spark, d).join(weights, "doc_id"), "weight", bpe.Vocabulary.base(), LEAST, "doc_id")


query(
    "z1_build_dataset",
    f"with {FLUSH_SQL} select c.doc_id, unnest(range(1, passes + 1))::integer as pass_no, part, len(tokens)::bigint as n_tokens, md5(array_to_string(tokens, ',')) as tokens_md5 from coded c join f on c.doc_id = f.doc_id",
)(lambda s, d: built(s, d).select("doc_id", "pass_no", "part", "n_tokens", F.md5(F.array_join("tokens", ",")).alias("tokens_md5")))
query("z1_build_totals", f"with {FLUSH_SQL} select count(*) as docs, sum(n)::bigint as tokens from (select len(tokens) as n, unnest(range(0, passes)) from coded c join f on c.doc_id = f.doc_id)")(
    lambda s, d: built(s, d).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
)
SEQ = 512
STREAM_SQL = "(select row_number() over (order by doc_id, i) - 1 as pos, tok from (select doc_id, unnest(range(0, len(t))) as i, unnest(t) as tok from (select doc_id, list_concat(list_concat([258], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda z: ('0x' || z)::integer)), [259]) as t from documents)))"
query(
    "w1_stream_windows",
    f"""with s as {STREAM_SQL}, n as (select (count(*) - {SEQ} - 1) // {SEQ} as k from s),
p as (select pos // {SEQ} as idx, pos, tok from s union all select pos // {SEQ} - 1, pos, tok from s where pos % {SEQ} = 0 and pos > 0),
w as (select idx, list(tok order by pos) as t from p group by idx)
select idx, t[1:{SEQ}] as input, t[2:{SEQ + 1}] as target from w, n where idx < k""",
)(lambda s, d: build.stream_windows(read(s, d, "documents").select("doc_id", F.concat(F.array(F.lit(258)), bpe.byte_ids(F.col("text")), F.array(F.lit(259))).alias("tokens")), "tokens", "doc_id", SEQ))
query("o1_sorted_listing", "select source || '/' || doc_id || '.txt' as path from documents where doc_id % 3 > 0 order by path")(
    lambda s, d: read(s, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 > 0, ".txt").otherwise(".md")).alias("path")).filter(F.col("path").endswith(".txt")).orderBy("path")
)
query("d5_epochs", "select event_id, (row_number() over (order by event_id) - 1) // 1000 as epoch, (row_number() over (order by event_id) - 1) % 1000 as step from events")(
    lambda s, d: (lambda e: segment.row_numbers(e, "n", segment.range_bucket(e, "event_id"), "event_id").select("event_id", F.floor(F.col("n") / 1000).alias("epoch"), (F.col("n") % 1000).cast("long").alias("step")))(read(s, d, "events").select("event_id"))
)
query(
    "d6_dense_batch",
    "with r as (select doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda z: ('0x' || z)::integer)[1:64] as t, (row_number() over (order by doc_id) - 1) // 16 as batch_id from documents where strlen(text) >= 64)"
    " select batch_id, count(*)::integer as height, 64 as width, flatten(list(t order by doc_id)) as dense from r group by batch_id",
)(lambda s, d: (lambda b: b.select("batch_id", F.col("n").alias("height"), F.lit(64).alias("width"), F.flatten("t").alias("dense")))(
    segment.batches(read(s, d, "documents").filter(F.octet_length("text") >= 64).select("doc_id", F.slice(bpe.byte_ids(F.col("text")), 1, 64).alias("t")), "doc_id", 16, "t")
))
RAGGED = "(select vec_id, label, case when vec_id % 97 = 0 then embedding[1:63] when vec_id % 101 = 1 then [] else embedding end as v from embeddings)"
query("f17_well_formed_batches", f"select label, count(*) > 0 and min(len(v)) = max(len(v)) and min(len(v)) > 0 as ok from {RAGGED} group by label")(
    lambda s, d: read(s, d, "embeddings").select("label", F.when(F.col("vec_id") % 97 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 101 == 1, F.slice("embedding", 1, 0)).otherwise(F.col("embedding")).alias("v"))
    .groupBy("label").agg(((F.min(F.size("v")) == F.max(F.size("v"))) & (F.min(F.size("v")) > 0)).alias("ok"))
)
SHAPES = "(select l_orderkey, l_linenumber, l_linenumber::bigint as b, (l_quantity::bigint % 5 + 1) as t, 64::bigint as c, l_linenumber * (l_quantity::bigint % 5 + 1) * 64 - case when l_orderkey % 11 = 0 then 1 else 0 end as k, l_linenumber * (l_quantity::bigint % 5 + 1) * 64 as v, case when l_orderkey % 13 = 0 then 63 else 64 end as w, 64 as u from lineitem)"
query("f18_shapes", f"select l_orderkey, l_linenumber, case when k <> b * t * c or v <> b * t * c then 'expected B*T*C = ' || (b * t * c) || ', got k=' || k || ', v=' || v when w <> c or u <> c then 'expected C = ' || c || ', got w=' || w || ', u=' || u else 'ok' end as verdict from {SHAPES}")(
    lambda s, d: _shapes(read(s, d, "lineitem"))
)


def _shapes(rows: DataFrame) -> DataFrame:
    text = lambda c: c.cast("string")
    b, t, c = F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long") % 5 + 1, F.lit(64).cast("long")
    k, w = b * t * c - F.when(F.col("l_orderkey") % 11 == 0, 1).otherwise(0), F.when(F.col("l_orderkey") % 13 == 0, 63).otherwise(64)
    return rows.select("l_orderkey", "l_linenumber", vector.shape_verdict(b, t, c, k, b * t * c, w, F.lit(64)).alias("verdict"))


# --- vector operations of the models -----------------------------------------------------------------

query("f15_finite_fallback", f"select vec_id, case when len(list_filter(x, lambda v: abs(v) < 0.02)) = 0 then [0] else list_filter(list_transform(range(1, 65), lambda i: case when abs(x[i]) < 0.02 then (i - 1)::integer end), lambda i: i is not null) end as ids from {LG}")(
    lambda s, d: logits(s, d).select("vec_id", F.transform(vector.finite_or_zero(F.transform("x", lambda v: F.when(F.abs(v) < 0.02, v).otherwise(F.lit(float("inf"))))), lambda p: p["i"]).alias("ids"))
)
_T = f"(1 / (1 + {vector.ERF_T} * abs(v / sqrt(2))))"
_POLY = "0.0::double"
for _c in reversed(vector.ERF):
    _POLY = f"({_POLY} + {_c}::double) * {_T}"
GELU_SQL = f"round(0.5 * v * (1 + sign(v) * (1 - {_POLY} * exp(-(v / sqrt(2)) * (v / sqrt(2))))), {R})"
query("t21_gelu", f"select vec_id, list_transform(x, lambda v: {GELU_SQL}) as gelu from {LG}")(lambda s, d: logits(s, d).select("vec_id", rounded(F.transform("x", vector.gelu)).alias("gelu")))
GROUP = "x[g * 16 + 1 : g * 16 + 16]"
query("t6_group_norm", f"select vec_id, flatten(list_transform(range(0, 4), lambda g: list_transform({GROUP}, lambda v: round((v - list_avg({GROUP})) / sqrt(list_avg(list_transform({GROUP}, lambda u: (u - list_avg({GROUP})) * (u - list_avg({GROUP})))) + 64e-5), 6)))) as x from {LG}")(
    lambda s, d: logits(s, d).select("vec_id", rounded(vector.group_norm(F.col("x"), 4, 16), 6).alias("x"))
)
CLAMPED = f"(select vec_id, list_transform(x, lambda v: greatest(least(v * 200, 30), -30)) as x, y from {LG})"
query("m3_clamped", f"select round(avg(list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) - x[y + 1]), 6) as loss from {CLAMPED}")(
    lambda s, d: logits(s, d).agg(F.round(F.avg(vector.cross_entropy(F.transform("x", lambda v: v * 200), F.col("y"), 30.0)), 6).alias("loss"))
)
query(
    "z2_generate_step",
    f"""with t as (select vec_id, list_transform(list_reverse_sort(list_transform(range(1, 65), lambda i: {{'v': x[i], 'i': i - 1}}))[1:8], lambda r: r) as c from {LG}),
e as (select vec_id, c, list_transform(c, lambda r: exp((r.v - c[1].v) / 0.8)) as ex from t),
p as (select vec_id, c, list_transform(ex, lambda v: v / list_sum(ex)) as p, ('0x' || substr(md5(vec_id::varchar), 1, 8))::bigint / 4294967296.0::double as u from e)
select vec_id, '{{"id":' || vec_id || ',"token":' || c[coalesce(list_position(list_transform(range(1, 9), lambda i: list_sum(p[1:i]) > u), true), 8)].i || '}}' as record from p""",
)(lambda s, d: _generated(logits(s, d)))


def _generated(rows: DataFrame) -> DataFrame:
    """Finite logits, the 8 best, temperature 0.8, a draw by a hash, one JSON record a row."""
    draw = F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0
    best = F.slice(F.sort_array(F.transform(vector.finite_or_zero(F.col("x")), lambda p: F.struct(p["v"].alias("v"), p["i"].alias("i"))), asc=False), 1, 8)
    rows = rows.select("vec_id", best.alias("c"))
    at = vector.inverse_cdf(vector.softmax(F.transform("c", lambda r: r["v"]), 0.8), draw)
    return rows.select("vec_id", F.to_json(F.struct(F.col("vec_id").alias("id"), F.get("c", at)["i"].alias("token"))).alias("record"))


# --- trainer state --------------------------------------------------------------------------------------

LIMIT, RUN, SKIP = 50, 5, 100
query(
    "w12_bad_batches",
    f"""with recursive o as (select user_id, event_id, case when event_id % 7 = 0 then 'nan'::double else loss end as loss, row_number() over (partition by user_id order by event_id) as n from {EV}),
r as (select user_id, event_id, n, 0::bigint as left_, case when isnan(loss) or loss > {LIMIT} then 1 else 0 end as run, false as skipped, 0::bigint as runs from o where n = 1 union all
select o.user_id, o.event_id, o.n, case when r.left_ > 0 then r.left_ - 1 when (isnan(o.loss) or o.loss > {LIMIT}) and r.run + 1 >= {RUN} then {SKIP} else 0 end,
  case when r.left_ > 0 then 0 when isnan(o.loss) or o.loss > {LIMIT} then case when r.run + 1 >= {RUN} then 0 else r.run + 1 end else 0 end, r.left_ > 0,
  r.runs + case when r.left_ = 0 and (isnan(o.loss) or o.loss > {LIMIT}) and r.run + 1 >= {RUN} then 1 else 0 end
from r join o on o.user_id = r.user_id and o.n = r.n + 1)
select user_id, max(runs)::bigint as runs, count(*) filter (where skipped) as skipped from r group by user_id""",
)(lambda s, d: _bad_batches(s, d))


def _bad_batches(spark, d) -> DataFrame:
    """Five batches in a row that are not finite or above the limit: the next hundred are skipped."""
    rows = events(spark, d).withColumn("loss", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("loss")))
    xs = rows.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "loss"))), lambda x: x["loss"]).alias("xs"))
    zero = F.lit(0).cast("long")

    def step(acc, x):
        skipping = acc["left"] > 0
        bad = ~skipping & (F.isnan(x) | (x > LIMIT) | (F.abs(x) == float("inf")))
        full = bad & (acc["run"] + 1 >= RUN)
        return F.struct(
            F.when(skipping, acc["left"] - 1).when(full, SKIP).otherwise(0).cast("long").alias("left"), F.when(bad & ~full, acc["run"] + 1).otherwise(0).cast("long").alias("run"),
            (acc["runs"] + full.cast("long")).alias("runs"), (acc["skipped"] + skipping.cast("long")).alias("skipped"),
        )

    state = F.aggregate("xs", F.struct(*[zero.alias(n) for n in ("left", "run", "runs", "skipped")]), step)
    return xs.select("user_id", state.alias("s")).select("user_id", "s.runs", "s.skipped")


# --- reports --------------------------------------------------------------------------------------------

RATE = "(3e-4::double * ((event_id % 100 + 1)::double / 100))"
RATE_SQL = f"regexp_replace(printf('%.2e', {RATE}), 'e([-+])0*([0-9]+)$', 'e\\1\\2')"
HEADER = "step,loss,ppl,lr,grad_norm,tokens_per_sec,eval_loss,eval_ppl,epoch"


def _rate() -> Column:
    return fmt.scientific(F.lit(3e-4) * ((F.col("event_id") % 100 + 1).cast("double") / 100), 2)


def _joined(*parts) -> Column:
    return F.concat_ws(",", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


query(
    "s24_metrics_csv",
    f"""select -1::bigint as event_id, {quote(HEADER)} as line union all select event_id, case event_id % 4
when 0 then '# Epoch ' || (event_id // 1000) || ' started at step ' || event_id
when 1 then event_id || ',' || printf('%.6f', loss) || ',' || printf('%.2f', exp(loss / 100)) || ',' || {RATE_SQL} || ',' || printf('%.4f', loss / 8) || ',' || printf('%.1f', loss * 4) || ',,,,'
when 2 then event_id || ',,,,,,' || printf('%.6f', loss) || ',' || printf('%.2f', loss / 4) || ','
else event_id || ',' || printf('%.6f', loss) || ',' || printf('%.2f', exp(loss / 100)) || ',' || {RATE_SQL} || ',' || printf('%.4f', loss / 8) || ',' || printf('%.1f', loss * 4) || ',' || printf('%.6f', loss) || ',' || printf('%.2f', loss / 4) || ',' || (event_id // 1000) end as line from {EV}""",
)(lambda s, d: _metrics(s, d))


def _metrics(spark, d) -> DataFrame:
    """Header, epoch comments, train rows (one field more than the header, as always), eval rows, full rows."""
    i, x = F.col("event_id"), F.col("loss")
    epoch = F.floor(i / 1000)
    train = [i, fmt.fixed(x, 6), fmt.fixed(F.exp(x / 100), 2), _rate(), fmt.fixed(x / 8, 4), fmt.fixed(x * 4, 1)]
    evals = [fmt.fixed(x, 6), fmt.fixed(x / 4, 2)]
    comment = F.concat(F.lit("# Epoch "), epoch.cast("string"), F.lit(" started at step "), i.cast("string"))
    line = F.when(i % 4 == 0, comment).when(i % 4 == 1, _joined(*train, "", "", "", "")).when(i % 4 == 2, _joined(i, "", "", "", "", "", *evals, "")).otherwise(_joined(*train, *evals, epoch))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(HEADER).alias("line"))
    return head.union(events(spark, d).select("event_id", line.alias("line")))


query(
    "s25_trainer_csv",
    f"""select -1::bigint as event_id, 'step,loss,ppl,lr,update_norm,tokens_per_sec,eval_loss,eval_ppl' as line union all select event_id, case when event_id % 100 = 0
then event_id || ',,,,,,' || printf('%.6f', loss) || ',' || printf('%.2f', loss / 4)
else event_id || ',' || printf('%.6f', loss) || ',' || printf('%.2f', exp(loss / 100)) || ',' || {RATE_SQL} || ',' || printf('%.4f', loss / 8) || ',' || printf('%.1f', loss * 4) || ',,' end as line from {EV} where event_id % 10 = 0 or event_id % 10 = 5""",
)(lambda s, d: _trainer_csv(s, d))


def _trainer_csv(spark, d) -> DataFrame:
    i, x = F.col("event_id"), F.col("loss")
    train = _joined(i, fmt.fixed(x, 6), fmt.fixed(F.exp(x / 100), 2), _rate(), fmt.fixed(x / 8, 4), fmt.fixed(x * 4, 1), "", "")
    line = F.when(i % 100 == 0, _joined(i, "", "", "", "", "", fmt.fixed(x, 6), fmt.fixed(x / 4, 2))).otherwise(train)
    head = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("step,loss,ppl,lr,update_norm,tokens_per_sec,eval_loss,eval_ppl").alias("line"))
    return head.union(events(spark, d).filter("event_id % 10 = 0 or event_id % 10 = 5").select("event_id", line.alias("line")))


query(
    "s23_dirty_report",
    f"""with a as (select * from {LINE_SQL}), n as (select count(distinct doc_id) as files, count(*) as lines, count(*) filter (where flagged) as flags from a),
top as (select row_number() over (order by score desc, doc_id, line_no) as i, * from a where flagged order by i limit 200)
select 0::bigint as entry, 'DIRTY SAMPLES LOG - TOP 200 WORST OFFENDERS' || chr(10) || 'Total Files Scanned: ' || files || chr(10) || 'Total Lines Scanned: ' || lines || chr(10) || 'Total Flags Raised: ' || flags || ' (' || printf('%.4f', case when lines > 0 then flags::double / lines * 100 else 0 end) || '%)' || chr(10) || repeat('=', 50) as text from n
union all select i, '[#' || i || '] Score: ' || printf('%.2f', score::double) || ' | Reason: ' || reason || chr(10) || 'Line: ' || line || chr(10) || repeat('-', 50) from top""",
)(lambda s, d: _dirty_report(audited(s, d)))


def _dirty_report(rows: DataFrame) -> DataFrame:
    """Header with the totals, then the 200 worst lines, worst first."""
    string = lambda c: F.col(c).cast("string")
    totals = rows.agg(F.countDistinct("doc_id").alias("files"), F.count("*").alias("lines"), F.count("score").alias("flags"))
    percent = F.when(F.col("lines") > 0, F.col("flags").cast("double") / F.col("lines") * 100).otherwise(0.0)
    head = F.concat(
        F.lit("DIRTY SAMPLES LOG - TOP 200 WORST OFFENDERS\nTotal Files Scanned: "), string("files"), F.lit("\nTotal Lines Scanned: "), string("lines"),
        F.lit("\nTotal Flags Raised: "), string("flags"), F.lit(" ("), fmt.fixed(percent, 4), F.lit("%)\n" + "=" * 50),
    )
    top = rows.filter(F.col("score").isNotNull()).orderBy(F.desc("score"), "doc_id", "line_no").limit(200)
    # 200 rows at most
    top = top.withColumn("entry", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id", "line_no")).cast("long"))
    text = F.concat(F.lit("[#"), string("entry"), F.lit("] Score: "), fmt.fixed(F.col("score"), 2), F.lit(" | Reason: "), "reason", F.lit("\nLine: "), "line", F.lit("\n" + "-" * 50))
    return totals.select(F.lit(0).cast("long").alias("entry"), head.alias("text")).union(top.select("entry", text.alias("text")))


query(
    "m12_summary",
    f"""select user_id, 'Steps: ' || count(*) || ' | Tokens: ' || (count(*) * 512) || ' | Epochs: ' || (count(*) // 20) || ' | Best Loss: ' || printf('%.4f', min(loss)) || ' | Best Eval: ' || printf('%.4f', coalesce(min(loss) filter (where event_id % 10 = 0), 340282346638528859811704183484516925440.0::double)) || ' | Time: ' || sum(loss)::bigint || 's | ' || printf('%.1f', case when sum(loss)::bigint > 0 then (count(*) * 512)::double / sum(loss)::bigint / 1000 else 0 end) || 'K tok/s' as line
from (select user_id, event_id, loss from (select user_id, event_id, floor(loss) as loss from {EV})) group by user_id""",
)(lambda s, d: _summary(events(s, d).withColumn("loss", F.floor("loss").cast("double"))))


def _summary(rows: DataFrame) -> DataFrame:
    made = rows.groupBy("user_id").agg(
        F.count("*").alias("steps"), (F.count("*") * 512).alias("tokens"), F.floor(F.count("*") / 20).alias("epochs"), F.min("loss").alias("best"),
        F.coalesce(F.min(F.when(F.col("event_id") % 10 == 0, F.col("loss"))), F.lit(fmt.FLOAT_MAX)).alias("best_eval"), F.sum("loss").cast("long").alias("seconds"),
    )
    return made.select("user_id", fmt.training_summary(*[F.col(c) for c in ("steps", "tokens", "epochs", "best", "best_eval", "seconds")]).alias("line"))


# --- presets and initial values ---------------------------------------------------------------------------

ALL_PRESETS = [(n, v, m, l, f, 4) for n, v, m, l, f in schedule.PRESETS] + [(n, v, m, l, f, 7) for n, v, m, l, f in schedule.PRESETS_V7]
query("z6_presets", "select name, version, v, m, m // 64 as heads, greatest(m // 16, 32) as low_rank from (values " + ", ".join(f"({quote(n)}, {v}::bigint, {m}::bigint, {k})" for n, v, m, _, _, k in ALL_PRESETS) + ") t(name, v, m, version)")(
    lambda s, d: s.createDataFrame(ALL_PRESETS, "name string, v long, m long, l long, f long, version int").select("name", "version", "v", "m", schedule.heads(F.col("m")).alias("heads"), schedule.low_rank(F.col("m")).alias("low_rank"))
)
query("z7_training_presets", "select name, batch * accumulation as effective, round(rate, 9) as rate, warmup, steps from (values ('default', 3e-4::double, 4::bigint, 16::bigint, 200::bigint, 10000::bigint), ('t4_400m', 3e-4, 2, 32, 300, 50000), ('t4_safe', 1e-4, 2, 32, 500, 50000)) t(name, rate, batch, accumulation, warmup, steps)")(
    lambda s, d: s.createDataFrame(schedule.TRAINING, schedule.TRAINING_SCHEMA).select("name", (F.col("batch") * F.col("accumulation")).alias("effective"), F.round("rate", 9).alias("rate"), "warmup", "steps")
)
query(
    "t3_initial_values",
    """with g as (select l, i, l / 11.0::double as r, i / 767.0::double as c from range(0, 12) a(l), range(0, 768) b(i))
select l as layer, i as channel, round(greatest(least((-5.0::double + 4.5::double * c) * (0.8::double + 0.4::double * r), -0.01), -5.0), 9) as decay, round(greatest(least(-0.5::double + c, 0.5), -0.5), 9) as first,
round(pow(1.0::double - c, 1.0::double - r), 9) as mix_k, round(pow(1.0::double - c, 1.0::double - r) + 0.3::double * r, 9) as mix_v, round(pow(1.0::double - c, 0.5::double * (1.0::double - r)), 9) as mix_r from g""",
)(lambda s, d: schedule.initial_values(s, 12, 768).select("layer", "channel", *[F.round(c, 9).alias(c) for c in ("decay", "first", "mix_k", "mix_v", "mix_r")]))

# --- vocabulary pilot -------------------------------------------------------------------------------------

WORDS_SQL = f"(select row_number() over (order by word) - 1 as id, word from (select distinct word from {PRE_SQL}))"


def word_table(spark, d) -> DataFrame:
    words = read(spark, d, "documents").select(F.explode(bpe.pre_tokenize(F.col("text"))).alias("word")).distinct()
    lead = F.conv(F.hex(F.substring(F.encode("word", "UTF-8"), 1, 2)), 16, 10).cast("int")
    return segment.row_numbers(words, "id", F.when(F.octet_length("word") < 2, lead * 256).otherwise(lead), "word")


query("o9_first_lines", "select doc_id from documents where strlen(trim(text)) > 20 order by doc_id limit 20000")(lambda s, d: pilot.first_lines(read(s, d, "documents").select("doc_id", F.col("text").alias("line")), 20_000, "doc_id").select("doc_id"))
query("o10_long_tokens", f"select id, word from {WORDS_SQL} where id >= (select count(*) from {WORDS_SQL}) - 5000 and strlen(word) > 10 order by id desc limit 10")(
    lambda s, d: pilot.long_tokens(word_table(s, d), "id", "word").select("id", "word")
)
query("o11_id_slice", f"select id, word from {WORDS_SQL} where id between 256 and 305")(lambda s, d: pilot.id_slice(word_table(s, d), "id").select("id", "word"))
query("u4_special_names", "select * from (values (0, '[PAD]'), (1, '[UNK]'), (2, '[BOS]'), (3, '[EOS]'), (4, '[SEP]'), (5, '[USER]'), (6, '[BOT]')) t(n, name)")(
    lambda s, d: s.createDataFrame([(i - 256, n) for n, i in bpe.Vocabulary.base(more=["[USER]", "[BOT]", "[PAD]"]).special.items()], "n int, name string")
)


@query("z4_pilot")
def z4(spark, d):
    lines = segment.lines(read(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")
    return pilot.run(lines, "line", "doc_id", "line_no")
