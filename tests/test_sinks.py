"""Logs, totals, word boxes and histories that are written or kept over time."""

import datetime

from pyspark.sql import functions as F

from foliospark.operators import operations as ops
from foliospark.sources import adapters
from foliospark.streaming import streams


def test_audit_round_trip(spark, tmp_path):
    events = spark.createDataFrame([("START", "scan", "ok", {"pages": "3", "a": "x=y"}), ("END", "scan", "ok", None)], "event string, op string, status string, fields map<string,string>")
    for _ in range(2):
        adapters.append_audit(events, str(tmp_path / "log"))
    lines = adapters.log_lines(spark, str(tmp_path / "log"))
    assert sorted(r.value for r in lines.collect()) == ["END | scan | ok"] * 2 + ["START | scan | ok | a=x=y | pages=3"] * 2
    read = adapters.audit_log(lines.where(F.col("value").startswith("START"))).first()
    assert (read.event, read.op, read.status, read.fields) == ("START", "scan", "ok", {"pages": "3", "a": "x=y"})


def test_merge_totals(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "k string, n long, bytes long")
    new = spark.createDataFrame([("b", 5, 1), ("c", 1, 1)], "k string, n long, bytes long")
    assert sorted(map(tuple, ops.merge_totals(old, new, "k").collect())) == [("a", 1, 10), ("b", 7, 21), ("c", 1, 1)]
    assert ops.merge_totals(old.limit(0), new.limit(0), "k").count() == 0


def test_hocr_words(spark):
    html = (
        "<span class='ocrx_word' title='bbox 1 2 3 4; x_wconf 90'>one</span><em title=\"rotate 90; bbox 5 6 7 8\" class='ocrx_word'><b>two</b></em>"
        "<span class='ocrx_word' title='bbox 1 2 3 4'> </span><span class='ocrx_word'>boxless</span><span title='bbox 1 1 1 1'>plain</span>"
    )
    rows = adapters.hocr_words(spark.createDataFrame([(1, html), (2, ""), (3, None)], "page int, hocr string")).collect()
    assert [(r.page, r.text, r.x0, r.x1, r.top, r.bottom, r.rotate) for r in rows] == [(1, "one", 1, 3, 2, 4, 0), (1, "two", 5, 7, 6, 8, 90)]


def test_recent_history_keeps_the_newest_over_batches(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    for name, rows in (("a", [("x", at(5), 1), ("x", at(1), 2), ("y", at(1), 3)]), ("b", [("x", at(3), 4), ("x", at(5), 5)])):
        spark.createDataFrame(rows, "account string, ts timestamp, event_id long").coalesce(1).write.parquet(str(tmp_path / "in" / name))
    events = spark.readStream.schema("account string, ts timestamp, event_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    rows = streams.drain(streams.recent_history(events, 2), str(tmp_path), "update").collect()
    last = {a: max(r.seen for r in rows if r.account == a) for a in ("x", "y")}
    assert last == {"x": 4, "y": 1}
    assert sorted((r.account, r.rank, r.ts, r.event_id) for r in rows if r.seen == last[r.account]) == [("x", 1, at(5), 5), ("x", 2, at(5), 1), ("y", 1, at(1), 3)]
