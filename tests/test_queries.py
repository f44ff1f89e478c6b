"""Every registered query with SQL, against DuckDB."""

import glob
import math
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from loomwell import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        made.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return made


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def table(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, con, name):
    want = con.execute(plans.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert table(got.select([f"`{n}`" for n in names]).collect()) == table(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_rows_only(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_are_pruned(spark):
    from loomwell.operators.segment import window_count
    from pyspark.sql import functions as F

    plan = plans.queries()["g8_approval_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lang" not in plan.split("ReadSchema")[1]
    assert spark.range(1).select(window_count(F.lit(33), 16)).first()[0] == 1


def test_rankings_and_histories_are_whole(spark):
    made, n = entry.queries(), spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = made["o2_ranked_files"](spark, SF).collect()
    assert len(rows) == n > 20 and rows == sorted(rows, key=lambda r: (r.score, r.doc_id))
    assert [r.doc_id for r in made["s22_ranked_report"](spark, SF).collect()] == [r.doc_id for r in rows]
    assert max(len(r.context) for r in made["k7_context_512"](spark, SF).collect()) == 512
    n = max(made["w9_history_100"](spark, SF).groupBy("user_id").count().collect(), key=lambda r: r["count"])["count"]
    assert 10 < n <= 100


def exactly_sql(spark, folder, name, **tables):
    """Rows of the query over `tables`, which must equal its SQL's to the bit, the sign of zero included."""
    con = duckdb.connect()
    for t, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(plans.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = entry.queries()[name](spark, str(folder)).select(names).collect()
    bits = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert bits(got) == bits(want.fetchall())
    return got


def test_trend_after_zeros(spark, tmp_path):
    loss = [0.0] * 5 + [1.0] * 5 + [0.0] * 10 + [0.1, 0.2, 0.3, 0.2, 0.1, 0.3, 0.1, 0.2, 0.2, 0.1000001]
    n = len(loss)
    got = exactly_sql(spark, tmp_path, "w8_trend", events={"event_id": list(range(n)), "user_id": [1] * n, "value": loss})
    trend = {r.event_id: r.trend for r in got}
    assert trend[9] == -math.inf and math.isnan(trend[19]) and trend[0] == 0.0


@pytest.mark.parametrize("name", ["w8_trend", "w3_token_shift", "w4_lerp", "w7_accumulate", "w10_steepest", "w14_explosion", "g16_running_best"])
def test_event_without_id_is_last(spark, tmp_path, name):
    loss = [0.5, 3.0, 8.0, 1.0, 2.0, 9.0, 4.0, 7.0, 6.0, 5.0, 2.5, 90.0]
    got = exactly_sql(spark, tmp_path, name, events={"event_id": [*range(11), None], "user_id": [1] * 12, "value": loss})
    assert name != "w8_trend" or {r.event_id: r.trend for r in got}[None] != 0.0


#: Values that become -0.0: at 5 decimals, and (the last group) at 6 once a group is normalised.
TINY = [-4e-6, -0.0, 0.0, 4e-6, -1e-5, 0.015625, -0.7, 0.7, 50.0, -50.0, *[0.0625] * 38, 10.0, -10.0, 10.0, -10.0, 10.0, -10.0, 10.0, -10.0, 10.0, -10.0, 10.0, -10.0, 10.0, -10.0, 0.0, 1e-5]
EMBEDDINGS = {"vec_id": pa.array([0, 1]), "label": pa.array([0, 1], pa.int32()), "embedding": pa.array([TINY, [-x for x in TINY]], pa.list_(pa.float32()))}
minus = lambda xs: [i for i, x in enumerate(xs) if x == 0 and math.copysign(1, x) < 0]


def test_activations_keep_minus_zero(spark, tmp_path):
    got = exactly_sql(spark, tmp_path, "t21_activations", embeddings=EMBEDDINGS)
    assert {tuple(minus(r.relu)) for r in got if r.vec_id == 0} == {(0, 1)}


def test_gelu_keeps_minus_zero(spark, tmp_path):
    got = exactly_sql(spark, tmp_path, "t21_gelu", embeddings=EMBEDDINGS)
    assert {tuple(minus(r.gelu))[:2] for r in got if r.vec_id == 0} == {(0, 1)}


def test_group_norm_keeps_minus_zero(spark, tmp_path):
    got = exactly_sql(spark, tmp_path, "t6_group_norm", embeddings=EMBEDDINGS)
    assert 62 in {i for r in got if r.vec_id == 0 for i in minus(r.x)}


def test_group_norm_of_short_vectors_and_nulls(spark, tmp_path):
    rows = [TINY[:63], TINY[:37], TINY[:5], [], None, [None] * 64, [None] * 16 + TINY[:48], [*TINY[:20], None, *TINY[21:40], None], TINY + TINY[:3]]
    got = exactly_sql(spark, tmp_path, "t6_group_norm", embeddings={"vec_id": range(len(rows)), "label": pa.array([0] * len(rows), pa.int32()), "embedding": pa.array(rows, pa.list_(pa.float32()))})
    x = {r.vec_id: r.x for r in got}
    assert [len(x[i]) for i in range(len(rows))] == [63, 37, 5, 0, 0, 64, 64, 41, 64]
    assert [i for i, v in enumerate(x[7]) if v is None] == [20, 40]


def test_l2_normalise_keeps_minus_zero(spark, tmp_path):
    got = exactly_sql(spark, tmp_path, "t6_l2_normalise", embeddings=EMBEDDINGS)
    assert {tuple(minus(r.x)) for r in got if r.vec_id == 0} == {(0, 1)}


def test_logit_clamp_keeps_minus_zero(spark, tmp_path):
    got = exactly_sql(spark, tmp_path, "t9_logit_clamp", embeddings=EMBEDDINGS)
    assert {(tuple(minus(r.x)), r.x[8]) for r in got if r.vec_id == 0} == {((0, 1), 65.0)}
