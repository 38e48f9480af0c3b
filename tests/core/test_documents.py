from datetime import datetime

from tessera.sources import documents as dc


def test_json_ld(spark):
    page = '<script type="application/ld+json">{"name": "A", "start": "2024-01-01"}</script><p>x</p><SCRIPT type=\'application/ld+json\'>{bad</SCRIPT>'
    got = dc.json_ld(spark.createDataFrame([(1, page), (2, None), (3, "<p>")], "id int, html string"), "html", "name STRING, start DATE").collect()
    assert [(r.id, r.ld.name if r.ld else None) for r in got] == [(1, "A"), (1, None)]


def test_calendar(spark):
    text = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nDTSTART;TZID=UTC:20240101T200000\r\nSUMMARY:A long\r\n  title\\, folded\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nEND:VEVENT\r\nEND:VCALENDAR"
    got = dc.calendar_events(spark.createDataFrame([("f", text), ("g", "")], "file string, body string"), "body", ["UID", "DTSTART", "SUMMARY"]).collect()
    assert [tuple(r) for r in got] == [("f", "1", "20240101T200000", "A long title, folded"), ("f", "2", None, None)]


def test_backfill_goes_on_where_it_stopped(spark, tmp_path):
    jobs = spark.createDataFrame([(i,) for i in range(4)], "k int")
    log = [(0, 1, True), (1, 1, False), (1, 2, False), (2, 1, False)]
    rows = spark.createDataFrame(log, "k int, attempt int, ok boolean")
    assert [dc.record_done(rows, f"{tmp_path}/log", "k") for _ in range(2)] == [4, 0]
    left = dc.pending(jobs, spark.read.parquet(f"{tmp_path}/log"), "k", tries=2)
    assert sorted(r.k for r in left.collect()) == [2, 3]


def test_replay_order(spark):
    t = lambda d: datetime(2024, 1, d)
    rows = spark.createDataFrame([(1, None, t(3)), (2, t(2), t(9)), (3, t(1), None), (4, None, t(3))], "id int, a timestamp_ntz, b timestamp_ntz")
    assert [r.id for r in dc.replayed(rows, ["a", "b"], "id", "2024-01-02 00:00:00").collect()] == [2, 1, 4]
