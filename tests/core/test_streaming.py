from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.operators import temporal
from tessera.streaming import changes as ch

T0 = datetime(2024, 1, 1)


def land(spark, folder, rows):
    df = spark.createDataFrame([(i, T0 + timedelta(minutes=m), 1, "view", float(v), "{}") for i, m, v in rows], ch.EVENTS)
    df.coalesce(1).write.mode("append").parquet(folder)


def test_changes_late_ticks_and_restart(spark, tmp_path):
    land_, out, cp = (f"{tmp_path}/{x}" for x in ("in", "out", "cp"))
    land(spark, land_, [(1, 0, 5), (2, 1, 5), (3, 2, 7)])
    ch.run_available(ch.changed_ticks(ch.tick_stream(spark, land_)), out, cp)
    land(spark, land_, [(4, 3, 7), (5, 1, 9), (6, 4, 5)])
    ch.run_available(ch.changed_ticks(ch.tick_stream(spark, land_)), out, cp)
    got = [(r.event_id, r.late) for r in spark.read.parquet(out).orderBy("event_id").collect()]
    assert got == [(1, False), (3, False), (5, True), (6, False)]


def test_stream_equals_batch_on_ordered_arrival(spark, tmp_path):
    rows = [(i, i, (i * 7 % 5) // 2) for i in range(60)]
    land(spark, f"{tmp_path}/in", rows)
    ch.run_available(ch.changed_ticks(ch.tick_stream(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp")
    batch = temporal.changes(spark.read.parquet(f"{tmp_path}/in"), ["user_id", "event_type"], ["ts", "event_id"], ["value"])
    ids = lambda df: sorted(r.event_id for r in df.select("event_id").collect())
    assert ids(spark.read.parquet(f"{tmp_path}/out")) == ids(batch)


def test_moves_against_a_day_before_and_again_within_the_cooldown(spark, tmp_path):
    h, d = 60, 1440
    rows = [(1, 0, 0.50), (2, h, 0.51), (3, d, 0.55), (4, d + h, 0.56), (5, d + 2 * h, 0.60), (6, d + 7 * h, 0.60), (7, 3 * d, 0.60)]
    land(spark, f"{tmp_path}/in", rows)
    ch.run_available(ch.moves(ch.tick_stream(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = [(r.value, r.reference) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("ts").collect()]
    # the first reaches 0.04 against a day before; 0.56 is within the cooldown and only 0.01 further; 0.60 is 0.05 further; after 5 h it is no further;
    # at the end the price of a day before is the same
    assert got == [(0.55, 0.50), (0.60, 0.51)]


def test_windows_and_redelivery(spark, tmp_path):
    land(spark, f"{tmp_path}/in", [(1, 0, 1), (1, 0, 1), (2, 30, 1)])
    ch.run_available(ch.delivered_once(ch.tick_stream(spark, f"{tmp_path}/in")), f"{tmp_path}/o1", f"{tmp_path}/c1")
    assert spark.read.parquet(f"{tmp_path}/o1").count() == 2
    land(spark, f"{tmp_path}/in2", [(1, 0, 1), (2, 30, 1)])
    ch.run_available(ch.window_counts(ch.tick_stream(spark, f"{tmp_path}/in2")), f"{tmp_path}/o2", f"{tmp_path}/c2")
    land(spark, f"{tmp_path}/in2", [(3, 3 * 1440, 1)])
    ch.run_available(ch.window_counts(ch.tick_stream(spark, f"{tmp_path}/in2")), f"{tmp_path}/o2", f"{tmp_path}/c2")
    got = spark.read.parquet(f"{tmp_path}/o2").filter(F.col("start") == F.lit(T0)).collect()
    assert [r.n for r in got] == [2]
