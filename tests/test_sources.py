import os

from panemill.functions.metrics import events_per_second, out_of_order
from panemill.plans.engine import run_text
from panemill.sources.events import batch_stream, decode_events, write_batch
from panemill.sources.sinks import print_results, with_latency, with_text_id, without_empty, write_results
from panemill.streaming.windows import watermarked


def lines(spark, *rows):
    return decode_events(spark.createDataFrame([(r,) for r in rows], "value string"))


def test_result_text_and_sink(spark, tmp_path):
    rows = lines(spark, "0,1,5,7", "0,150,2,8")
    results = run_text(rows, "TUMBLING,100,4", "SUM", dense=True)
    text = {r.result_id: r.result_text for r in with_text_id(results).collect()}
    assert text == {"4,0,100,0,-1,7": "5", "4,100,200,0,-1,7": "null", "4,0,100,0,-1,8": "null", "4,100,200,0,-1,8": "2"}
    assert without_empty(results).count() == 2
    assert sorted(r.latency_ms for r in with_latency(results, 10).collect()) == [5, 8]
    write_results(results, str(tmp_path / "out"))
    assert os.path.exists(tmp_path / "out" / "_SUCCESS")


def test_a_stream_is_printed_without_empty_results(spark, tmp_path):
    write_batch(lines(spark, "0,1,5", "0,2,7"), f"{tmp_path}/in")
    query = print_results(watermarked(batch_stream(spark, f"{tmp_path}/in")).selectExpr("CASE WHEN value > 5 THEN value END AS value"))
    query.processAllAvailable()
    assert query.isActive and sum(p["numInputRows"] for p in query.recentProgress) == 2
    query.stop()


def test_metrics(spark):
    rows = lines(spark, "0,10,1", "0,30,1", "0,20,1", "0,40,1", "1,5,1").coalesce(1)
    got = {r.stream_id: (r.events, r.late, r.ratio) for r in out_of_order(rows).collect()}
    assert got == {0: (4, 1, 0.25), 1: (1, 0, 0.0)}
    far = lines(spark, *[f"0,{t},1" for t in [*range(100, 3000), 50, *range(3000, 4000), 3500]]).coalesce(1)
    assert [(r.events, r.late) for r in out_of_order(far).collect()] == [(3902, 2)]
    assert {(r.stream_id, r.second): r.events for r in events_per_second(rows).collect()} == {(0, 0): 4, (1, 0): 1}
