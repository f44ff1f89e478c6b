"""Windows over series, probabilities, schedules, recurrences, formats, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fmt, schedule, vector
from ..operators import bpe, matrix_state, segment
from .core import query, quote, read

R = 9  # decimals compared


def events(spark, d) -> DataFrame:
    return read(spark, d, "events").select("event_id", "user_id", vector.nearest(F.col("value"), 4).alias("loss"))


EV = "(select event_id, user_id, round(value, 4) as loss from events)"
def by_step():
    """Each user's events in order, as SQL sorts: an event without an id comes last."""
    return Window.partitionBy("user_id").orderBy(F.asc_nulls_last("event_id"))



def series(spark, d) -> DataFrame:
    """(user_id, xs) of each user's losses in order."""
    return events(spark, d).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "loss"))), lambda x: x["loss"]).alias("xs"))


SERIES = f"(select user_id, list(loss order by event_id) as xs from {EV} group by user_id)"

query("w3_token_shift", f"select event_id, coalesce(lag(loss) over (partition by user_id order by event_id), 0) as prev from {EV}")(lambda s, d: events(s, d).select("event_id", F.coalesce(F.lag("loss").over(by_step()), F.lit(0.0)).alias("prev")))
query("w4_lerp", f"select event_id, round(p + 0.3 * (loss - p), {R}) as mixed from (select event_id, loss, coalesce(lag(loss) over (partition by user_id order by event_id), 0) as p from {EV})")(
    lambda s, d: events(s, d).withColumn("p", F.coalesce(F.lag("loss").over(by_step()), F.lit(0.0))).select("event_id", F.round(F.col("p") + 0.3 * (F.col("loss") - F.col("p")), R).alias("mixed"))
)
query("w5_ema", f"select user_id, round(list_reduce(xs, lambda a, x: 0.99::double * a + 0.01::double * x), 6) as ema from {SERIES}")(lambda s, d: series(s, d).select("user_id", F.round(vector.ema(F.col("xs")), 6).alias("ema")))
query("w7_accumulate", f"select user_id, g, round(avg(loss), 6) as mean from (select user_id, loss, (row_number() over (partition by user_id order by event_id) - 1) // 4 as g from {EV}) group by user_id, g having count(*) = 4")(
    lambda s, d: events(s, d).withColumn("g", F.floor((F.row_number().over(by_step()) - 1) / 4)).groupBy("user_id", "g").agg(F.round(F.avg("loss"), 6).alias("mean"), F.count("*").alias("n")).filter("n = 4").drop("n")
)
query(
    "w8_trend",
    f"select event_id, round(case when o is null then 0 else (o - r) / o end, 6) as trend from (select event_id, avg(loss) over (partition by user_id order by event_id rows between 4 preceding and current row) as r, avg(loss) over (partition by user_id order by event_id rows between 9 preceding and 5 preceding) as o from {EV})",
)(lambda s, d: events(s, d).select("event_id", F.avg("loss").over(by_step().rowsBetween(-4, 0)).alias("r"), F.avg("loss").over(by_step().rowsBetween(-9, -5)).alias("o")).select("event_id", F.when(F.col("o").isNull(), 0.0).otherwise(vector.quotient(F.col("o") - F.col("r"), F.col("o"))).alias("q")).select("event_id", vector.nearest(F.col("q"), 6).alias("trend")))
query("w9_history_100", f"select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id desc) as n from {EV}) where n <= 100")(
    lambda s, d: events(s, d).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))).filter("n <= 100").select("user_id", "event_id")
)
query(
    "w10_steepest",
    f"""select user_id, round(pow(1.1, case when n < 3 then n // 2 else best end) * 1e-5 / case when n < 3 then 1 else 10 end, 12) as lr from
(select user_id, count(*) as n, arg_min(i, (g, i)) filter (where g is not null) as best from (select user_id, row_number() over w - 1 as i, (lead(loss) over w - lag(loss) over w) / 2 as g from {EV} window w as (partition by user_id order by event_id)) group by user_id)""",
)(lambda s, d: events(s, d).select("user_id", (F.row_number().over(by_step()) - 1).alias("i"), ((F.lead("loss").over(by_step()) - F.lag("loss").over(by_step())) / 2).alias("g")).groupBy("user_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("g").isNotNull(), F.struct("g", "i")))["i"].alias("best")).select("user_id", F.round(F.when(F.col("n") < 3, F.pow(F.lit(1.1), F.floor(F.col("n") / 2)) * 1e-5).otherwise(F.pow(F.lit(1.1), F.col("best")) * 1e-5 / 10), 12).alias("lr")))
query(
    "w11_early_stop",
    f"""with recursive o as (select user_id, loss, row_number() over (partition by user_id order by event_id) as n from {EV}),
r as (select user_id, n, loss as best, 0 as bad, false as stopped from o where n = 1 union all
select o.user_id, o.n, case when o.loss < r.best - 0.5 then o.loss else r.best end, case when o.loss < r.best - 0.5 then 0 else r.bad + 1 end, r.stopped or (not o.loss < r.best - 0.5 and r.bad + 1 >= 5) from r join o on o.user_id = r.user_id and o.n = r.n + 1)
select user_id, min(n) filter (where stopped) as stop_at from r group by user_id""",
)(lambda s, d: series(s, d).select("user_id", F.aggregate("xs", F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("bad"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("stop")), _stop)["stop"].alias("stop_at")))


def _stop(acc, x):
    better = acc["best"].isNull() | (x < acc["best"] - 0.5)
    bad = F.when(better, 0).otherwise(acc["bad"] + 1)
    n = acc["n"] + 1
    return F.struct(F.when(better, x).otherwise(acc["best"]).alias("best"), bad.alias("bad"), n.alias("n"), F.coalesce(acc["stop"], F.when(bad >= 5, n)).alias("stop"))


query("w14_explosion", f"select event_id from (select event_id, max(case when loss > 10 * f or loss > 1e300 then 1 else 0 end) over (partition by user_id order by event_id) as bad from (select *, first(loss) over (partition by user_id order by event_id) as f from {EV})) where bad = 0")(
    lambda s, d: events(s, d).withColumn("f", F.first("loss").over(by_step())).withColumn("bad", F.max(F.when(F.col("loss") > 10 * F.col("f"), 1).otherwise(0)).over(by_step())).filter("bad = 0").select("event_id")
)
query("w15_batch_id", "select event_id, (row_number() over (order by event_id) - 1) // 256 as batch_id from events")(lambda s, d: (lambda e: segment.row_numbers(e, "n", segment.range_bucket(e, "event_id"), "event_id").select("event_id", F.floor(F.col("n") / 256).alias("batch_id")))(events(s, d).select("event_id")))
query("g16_running_best", f"select event_id, min(loss) over (partition by user_id order by event_id) as best from {EV}")(lambda s, d: events(s, d).select("event_id", F.min("loss").over(by_step()).alias("best")))
query("g14_perplexity", f"select user_id, round(exp(sum(loss / 100 * (1 + event_id % 7)) / sum(1 + event_id % 7)), 6) as ppl from {EV} group by user_id")(
    lambda s, d: events(s, d).withColumn("n", 1 + F.col("event_id") % 7).groupBy("user_id").agg(F.round(F.exp(F.sum(F.col("loss") / 100 * F.col("n")) / F.sum("n")), 6).alias("ppl"))
)
query("g17_throughput", f"select user_id, round(case when sum(loss) > 0 then count(*) * 512 / sum(loss) else 0 end, 6) as tps from {EV} group by user_id")(
    lambda s, d: events(s, d).groupBy("user_id").agg(F.round(F.when(F.sum("loss") > 0, F.count("*") * 512 / F.sum("loss")).otherwise(0.0), 6).alias("tps"))
)
query("g18_mean_time", f"select round(avg(loss), 6) as mean from {EV}")(lambda s, d: events(s, d).agg(F.round(F.avg("loss"), 6).alias("mean")))
query("f16_skip_batch", f"select event_id from {EV} where loss is not null and not isnan(loss) and loss <= 50")(lambda s, d: events(s, d).filter("loss is not null and not isnan(loss) and loss <= 50").select("event_id"))
query("k10_cadence", "select event_id, event_id > 0 and event_id % 100 = 0 as evaluate, event_id > 0 and event_id % 500 = 0 as save from events")(
    lambda s, d: events(s, d).select("event_id", ((F.col("event_id") > 0) & (F.col("event_id") % 100 == 0)).alias("evaluate"), ((F.col("event_id") > 0) & (F.col("event_id") % 500 == 0)).alias("save"))
)
query("o12_tail", "select event_id from events order by event_id desc limit 50")(lambda s, d: read(s, d, "events").select("event_id").orderBy(F.desc("event_id")).limit(50))

# --- logits: the embeddings, with the label as target -------------------------------------------


def logits(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: vector.nearest(x.cast("double"), 5)).alias("x"), F.pmod("label", F.lit(64)).alias("y"))


LG = "(select vec_id, list_transform(embedding, lambda e: round(e::double, 5)) as x, label % 64 as y from embeddings)"
PROB = f"(select vec_id, x, y, list_transform(ex, lambda v: v / list_sum(ex)) as p from (select vec_id, x, y, list_transform(x, lambda v: exp(v - list_max(x))) as ex from {LG}))"


def probs(spark, d) -> DataFrame:
    return logits(spark, d).withColumn("p", vector.softmax(F.col("x")))


rounded = lambda c, n=R: F.transform(c, lambda x: vector.nearest(x, n))
query("m1_softmax", f"select vec_id, list_transform(p, lambda v: round(v, {R})) as p from {PROB}")(lambda s, d: probs(s, d).select("vec_id", rounded("p").alias("p")))
TOPI = "list_transform(list_reverse_sort(list_transform(range(1, 65), lambda i: {'v': x[i], 'i': i - 1})), lambda r: r.i)"
query("o4_top_k", f"select vec_id, {TOPI}[1:8] as ids from {LG}")(lambda s, d: logits(s, d).select("vec_id", F.transform(vector.top_k(F.col("x"), 8), lambda r: r["i"].cast("long")).alias("ids")))
query("o6_top5_hit", f"select vec_id, list_contains({TOPI}[1:5], y) as hit from {LG}")(lambda s, d: logits(s, d).select("vec_id", F.array_contains(F.transform(vector.top_k(F.col("x"), 5), lambda r: r["i"]), F.col("y")).alias("hit")))
query("o7_argmax", f"select vec_id, ({TOPI}[1])::integer as best from {LG}")(lambda s, d: logits(s, d).select("vec_id", vector.argmax(F.col("x")).alias("best")))
query(
    "m2_temperature_top_k",
    f"""select vec_id, list_transform(e, lambda v: round(v / list_sum(e), {R})) as p from (select vec_id, list_transform(t, lambda v: exp((v - list_max(t)) / 0.8)) as e from (select vec_id, list_reverse_sort(x)[1:8] as t from {LG}))""",
)(lambda s, d: logits(s, d).select("vec_id", F.transform(vector.top_k(F.col("x"), 8), lambda r: r["v"]).alias("t")).select("vec_id", rounded(vector.softmax(F.col("t"), 0.8)).alias("p")))
query("m3_cross_entropy", f"select vec_id, round(-ln(p[y + 1]), {R}) as loss from {PROB}")(lambda s, d: logits(s, d).select("vec_id", F.round(vector.cross_entropy(F.col("x"), F.col("y")), R).alias("loss")))
query("m4_perplexity", f"select round(exp(avg(-ln(p[y + 1]))), 6) as ppl from {PROB}")(lambda s, d: logits(s, d).agg(F.round(F.exp(F.avg(vector.cross_entropy(F.col("x"), F.col("y")))), 6).alias("ppl")))
query("m5_entropy", f"select vec_id, round(list_sum(list_transform(p, lambda v: case when v > 1e-10 then -v * ln(v) else 0 end)), {R}) as h from {PROB}")(lambda s, d: probs(s, d).select("vec_id", F.round(vector.entropy(F.col("p")), R).alias("h")))
query("g15_accuracy", f"select round(avg(case when {TOPI}[1] = y then 1.0::double else 0 end), 6) as top1, round(avg(case when list_contains({TOPI}[1:5], y) then 1.0::double else 0 end), 6) as top5 from {LG}")(
    lambda s, d: logits(s, d).agg(F.round(F.avg(F.when(vector.argmax(F.col("x")) == F.col("y"), 1.0).otherwise(0.0)), 6).alias("top1"), F.round(F.avg(F.when(F.array_contains(F.transform(vector.top_k(F.col("x"), 5), lambda r: r["i"]), F.col("y")), 1.0).otherwise(0.0)), 6).alias("top5"))
)
query("j8_gather", f"select vec_id, x[y + 1] as v from {LG}")(lambda s, d: logits(s, d).select("vec_id", F.get("x", F.col("y")).alias("v")))
query("j9_embedding_lookup", "select event_id, e.embedding[1]::double as first from events join embeddings e on e.vec_id = event_id % (select count(*) from embeddings)")(
    lambda s, d: events(s, d).select("event_id", (F.col("event_id") % F.lit(read(s, d, "embeddings").count())).alias("vec_id")).join(read(s, d, "embeddings"), "vec_id").select("event_id", F.get("embedding", F.lit(0)).cast("double").alias("first"))
)
query("g19_l2", f"select a.vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i])))), {R}) as dist from {LG} a join {LG} b on b.vec_id = a.vec_id + 1")(
    lambda s, d: logits(s, d).alias("a").join(logits(s, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("z")), "vec_id").select("vec_id", F.round(vector.l2_distance(F.col("x"), F.col("z")), R).alias("dist"))
)
query("t9_logit_clamp", f"select vec_id, list_transform(x, lambda v: greatest(least(v * 100, 65), -65)) as x from {LG}")(lambda s, d: logits(s, d).select("vec_id", vector.logit_clamp(F.transform("x", lambda v: v * 100)).alias("x")))
query("t6_l2_normalise", f"select vec_id, list_transform(x, lambda v: round(v / greatest(sqrt(list_sum(list_transform(x, lambda u: u * u))), 1e-12), {R})) as x from {LG}")(
    lambda s, d: logits(s, d).withColumn("n", F.greatest(F.sqrt(vector.total(F.transform("x", lambda v: v * v))), F.lit(1e-12))).select("vec_id", rounded(F.transform("x", lambda v: v / F.col("n"))).alias("x"))
)
query("t21_activations", f"select vec_id, list_transform(x, lambda v: greatest(v, 0)) as relu, list_transform(x, lambda v: round(1 / (1 + exp(-v)), {R})) as sigmoid, list_transform(x, lambda v: round(-ln(1 + exp(-v)), {R})) as log_sigmoid from {LG}")(
    lambda s, d: logits(s, d).select("vec_id", F.transform("x", lambda v: F.greatest(v, F.lit(0.0))).alias("relu"), rounded(F.transform("x", lambda v: 1 / (1 + F.exp(-v)))).alias("sigmoid"), rounded(F.transform("x", lambda v: -F.log(1 + F.exp(-v)))).alias("log_sigmoid"))
)
query("f15_finite", f"select vec_id, len(list_filter(x, lambda v: abs(v) < 0.1)) as n from {LG}")(
    lambda s, d: logits(s, d).select("vec_id", F.size(vector.finite(F.transform("x", lambda v: F.when(F.abs(v) < 0.1, v).otherwise(F.lit(float("nan")))))).cast("long").alias("n"))
)
query(
    "r4_categorical",
    f"""select vec_id, coalesce(list_position(list_transform(range(1, 65), lambda i: list_sum(p[1:i]) > u), true), 64) - 1 as token from (select vec_id, p, ('0x' || substr(md5(vec_id::varchar), 1, 8))::bigint / 4294967296.0::double as u from {PROB})""",
)(lambda s, d: probs(s, d).select("vec_id", vector.inverse_cdf(F.col("p"), F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0).cast("long").alias("token")))
query("o5_top5_per_label", "select label, vec_id from (select label, vec_id, row_number() over (partition by label order by embedding[1] desc, vec_id) as n from embeddings) where n <= 5")(
    lambda s, d: read(s, d, "embeddings").withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.get("embedding", F.lit(0))), "vec_id"))).filter("n <= 5").select("label", "vec_id")
)

# --- recurrences ---------------------------------------------------------------------------------

STATE = "{'aa': 0.0::double, 'bb': 0.0::double, 'pp': -1e30::double, 'y': 0.0::double, 'k': 0.0::double, 'v': 0.0::double}"


def wkv_sql(w: float, u: float, clamp: bool, eps: float) -> str:
    y = f"(exp(x.k + {u} - greatest(s.pp, x.k + {u})) * x.v + exp(s.pp - greatest(s.pp, x.k + {u})) * s.aa) / (exp(x.k + {u} - greatest(s.pp, x.k + {u})) + exp(s.pp - greatest(s.pp, x.k + {u})) * s.bb + {eps})"
    y = f"greatest(least({y}, 20.0), -20.0)" if clamp else y
    return f"""with recursive kv as (select vec_id, i as t, x[i] as k, x[i % 64 + 1] as v from (select vec_id, x, unnest(range(1, 65)) as i from {LG})),
s as (select vec_id, 0::bigint as t, 0.0::double as aa, 0.0::double as bb, -1e30::double as pp, 0.0::double as y from {LG} union all
select x.vec_id, x.t, exp(s.pp + {w} - greatest(s.pp + {w}, x.k)) * s.aa + exp(x.k - greatest(s.pp + {w}, x.k)) * x.v, exp(s.pp + {w} - greatest(s.pp + {w}, x.k)) * s.bb + exp(x.k - greatest(s.pp + {w}, x.k)), greatest(s.pp + {w}, x.k), {y}
from s join kv x on x.vec_id = s.vec_id and x.t = s.t + 1)
select vec_id, t - 1 as t, round(y, 6) as y from s where t > 0"""


def wkv_rows(spark, d, w, u, clamp, eps) -> DataFrame:
    rows = logits(spark, d).select("vec_id", "x", F.concat(F.slice("x", 2, 63), F.slice("x", 1, 1)).alias("v"))
    return rows.select("vec_id", F.posexplode(vector.wkv(F.col("x"), F.col("v"), w, u, clamp, eps)).alias("t", "y")).select("vec_id", F.col("t").cast("long").alias("t"), F.round("y", 6).alias("y"))


query("k2_wkv", wkv_sql(-0.5, 0.3, True, 1e-8))(lambda s, d: wkv_rows(s, d, -0.5, 0.3, True, 1e-8))
query("k4_wkv_plain", wkv_sql(-0.5, 0.3, False, 0.0))(lambda s, d: wkv_rows(s, d, -0.5, 0.3, False, 0.0))


@query("k5_matrix_state")
def k5(spark, d):
    part = lambda k: F.slice("x", k * 8 + 1, 8)
    rows = logits(spark, d).select((F.col("vec_id") % 10).alias("seq"), F.floor(F.col("vec_id") / 10).alias("t"), *[part(i).alias(n) for i, n in enumerate(("r", "w", "k", "v", "neg", "adapt"))])
    return matrix_state.run(rows.withColumn("w", F.transform("w", lambda x: -F.abs(x))), 2, 4)


BYTES = "list_concat(list_concat([258], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda z: ('0x' || z)::integer)), [259])"
query("k7_context_512", f"select doc_id, {BYTES}[-512:] as context from documents")(
    lambda s, d: read(s, d, "documents").select("doc_id", F.concat(F.array(F.lit(258)), bpe.byte_ids(F.col("text")), F.array(F.lit(259))).alias("t")).select("doc_id", F.slice("t", -F.least(F.size("t"), F.lit(512)), F.lit(512)).alias("context"))
)

# --- schedules, sizes, formats, records ----------------------------------------------------------

query("m6_learning_rate", "select i as step, round(case when i < 100 then 3e-4 * ((i + 1.0::double) / 100) * ((i + 1.0::double) / 100) else 3e-5 + 2.7e-4 * 0.5 * (1 + cos(least((i - 100.0::double) / 900, 1) * pi())) end, 12) as lr from range(0, 1200) t(i)")(
    lambda s, d: s.range(1200).select(F.col("id").alias("step"), F.round(schedule.learning_rate(F.col("id"), 3e-4, 100, 1000, 0.1), 12).alias("lr"))
)
query("m7_ladder", "select i, round(1e-7 * pow(pow(1e6, 0.01), i), 12) as lr from range(0, 101) t(i)")(lambda s, d: s.range(101).select(F.col("id").alias("i"), F.round(1e-7 * F.pow(F.pow(F.lit(1e6), F.lit(0.01)), F.col("id")), 12).alias("lr")))
PRE = "(values " + ", ".join(f"({quote(n)}, {v}::bigint, {m}::bigint, {l}::bigint, {f}::bigint)" for n, v, m, l, f in schedule.PRESETS) + ") t(name, v, m, l, f)"
NP = "(v * m + l * (4 * m * m + 5 * m + m * m + 2 * m * f + 2 * m + 4 * m) + 4 * m)"


def presets(spark) -> DataFrame:
    return spark.createDataFrame(schedule.PRESETS, "name string, v long, m long, l long, f long")


def _params():
    return schedule.parameters(F.col("v"), F.col("m"), F.col("l"), F.col("f"))


query("m8_parameters", f"select name, {NP} as params, m // 64 as heads, greatest(m // 16, 32) as low_rank from {PRE}")(lambda s, d: presets(s).select("name", _params().alias("params"), schedule.heads(F.col("m")).alias("heads"), schedule.low_rank(F.col("m")).alias("low_rank")))
GRID = "(select b, s, row_number() over () as o from (values (4), (2), (1)) x(b), (values (512), (384), (256), (192), (128), (96), (64)) y(s))"
MEM = f"({NP} * 12 + (4 * b * s * m + 2 * b * s * f) * 2 * l + 12 * b * m * l + b * s * m * 2 + b * s * v * 2)"


def grid(spark) -> DataFrame:
    g = spark.createDataFrame([(i * 3 + j, b, q) for i, q in enumerate(schedule.SEQUENCES) for j, b in enumerate(schedule.BATCHES)], "o int, b long, s long")
    return presets(spark).crossJoin(F.broadcast(g)).withColumn("bytes", schedule.memory(_params(), F.col("v"), F.col("m"), F.col("l"), F.col("f"), F.col("b"), F.col("s")))


query("m9_memory", f"select name, b, s, {MEM} + {MEM} // 7 as bytes, {MEM} + {MEM} // 7 < {schedule.FITS} as fits from {PRE}, {GRID}")(lambda s, d: grid(s).select("name", "b", "s", "bytes", (F.col("bytes") < schedule.FITS).alias("fits")))
query("m9_suggest", f"select name, coalesce(arg_max(b, s * 10 + b) filter (where {MEM} + {MEM} // 7 < {schedule.FITS}), 1)::bigint as b, coalesce(arg_max(s, s * 10 + b) filter (where {MEM} + {MEM} // 7 < {schedule.FITS}), 64)::bigint as s from {PRE}, {GRID} group by name")(
    lambda s, d: grid(s).groupBy("name").agg(F.min(F.when(F.col("bytes") < schedule.FITS, F.struct("o", "b", "s"))).alias("g")).select("name", F.coalesce("g.b", F.lit(1)).cast("long").alias("b"), F.coalesce("g.s", F.lit(64)).cast("long").alias("s"))
)
query("m11_loss_scale", f"select user_id, round(list_reduce(list_prepend(1.0::double, xs), lambda a, x: case when x > 90 then a * 0.5 else a end), 9) as scale from {SERIES}")(
    lambda s, d: series(s, d).select("user_id", F.round(F.aggregate("xs", F.lit(1.0), lambda a, x: F.when(x > 90, a * 0.5).otherwise(a)), 9).alias("scale"))
)
LI = "(select l_orderkey * 7919 as n, l_linenumber from lineitem)"


def numbers(spark, d) -> DataFrame:
    return read(spark, d, "lineitem").select((F.col("l_orderkey") * 7919).alias("n"), "l_linenumber")


def unit_sql(units, rest: str, x: str = "n") -> str:
    return "case " + " ".join(f"when {x} >= {at} then printf('%.{n}f{unit}', {x}::double / {at}.0::double)" for at, n, unit in units) + f" else {rest} end"


query("y1_params", f"select n, l_linenumber, {unit_sql(fmt.PARAMS, 'n::varchar')} as s from {LI}")(lambda s, d: numbers(s, d).select("n", "l_linenumber", fmt.params(F.col("n")).alias("s")))
query("y2_number", f"select n, l_linenumber, {unit_sql(fmt.NUMBER, 'n::varchar')} as s from {LI}")(lambda s, d: numbers(s, d).select("n", "l_linenumber", fmt.number(F.col("n")).alias("s")))
BYTES_CASE = unit_sql(fmt.BYTES, "n::varchar || ' B'")
query("y3_bytes", f"select n, l_linenumber, {BYTES_CASE} as s from {LI}")(lambda s, d: numbers(s, d).select("n", "l_linenumber", fmt.size(F.col("n")).alias("s")))
query("y4_duration", f"select n, l_linenumber, case when n // 3600 > 0 then printf('%dh%dm%ds', n // 3600, n % 3600 // 60, n % 60) when n % 3600 // 60 > 0 then printf('%dm%ds', n % 3600 // 60, n % 60) else printf('%ds', n % 60) end as s from {LI}")(
    lambda s, d: numbers(s, d).select("n", "l_linenumber", fmt.duration(F.col("n")).alias("s"))
)
TP_CASE = unit_sql(fmt.THROUGHPUT, "printf('%.1f tok/s', n::double)")
query("y5_throughput", f"select n, l_linenumber, {TP_CASE} as s from {LI}")(lambda s, d: numbers(s, d).select("n", "l_linenumber", fmt.throughput(F.col("n")).alias("s")))
query("s24_metrics_rows", f"select event_id, concat_ws(',', event_id, printf('%.4f', loss), printf('%.4f', exp(loss / 100)), '', '') as line from {EV}")(
    lambda s, d: events(s, d).select("event_id", F.concat_ws(",", F.col("event_id").cast("string"), fmt.fixed(F.col("loss"), 4), fmt.fixed(F.exp(F.col("loss") / 100), 4), F.lit(""), F.lit("")).alias("line"))
)
query("s28_json", "select event_id, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' as j from events")(
    lambda s, d: read(s, d, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("j"))
)
query("s29_inline", "select * from (values (1, 'O Brasil'), (2, 'A lei')) t(id, prompt)")(lambda s, d: s.createDataFrame([(1, "O Brasil"), (2, "A lei")], "id int, prompt string"))
query("p3_dispatch", f"select c_custkey, coalesce(m, 768)::bigint as width from customer left join {PRE} on name = case c_custkey % 4 when 0 then '400m' when 1 then '1b' when 2 then '1.5b' else 'other' end")(
    lambda s, d: read(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "400m").when(F.col("c_custkey") % 4 == 1, "1b").when(F.col("c_custkey") % 4 == 2, "1.5b").otherwise("other").alias("name")).join(F.broadcast(presets(s)), "name", "left").select("c_custkey", F.coalesce("m", F.lit(768)).cast("long").alias("width"))
)
query("p4_safe_config", "select b, s, case when least(b, 4) * least(s, 512) > 1024 then 2 else least(b, 4) end as batch, least(s, 512) as seq, case when least(b, 4) * least(s, 512) > 1024 then ceil(4 * b / 2.0)::bigint else 4 end as accum from range(1, 9) x(b), (values (128::bigint), (512), (1024)) y(s)")(
    lambda s, d: s.range(1, 9).withColumnRenamed("id", "b").crossJoin(s.createDataFrame([(128,), (512,), (1024,)], "s long")).withColumn("over", F.least("b", F.lit(4)) * F.least("s", F.lit(512)) > 1024).select("b", "s", F.when(F.col("over"), F.lit(2).cast("long")).otherwise(F.least("b", F.lit(4))).alias("batch"), F.least("s", F.lit(512)).alias("seq"), F.when(F.col("over"), F.ceil(4 * F.col("b") / 2.0)).otherwise(4).alias("accum"))
)
