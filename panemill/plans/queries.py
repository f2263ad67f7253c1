"""The registered queries over events, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panemill.functions.aggregates import Aggregate, Part, aggregate, aggregate_names, at_place, mean_between, most_frequent, register_aggregate
from panemill.functions.metrics import events_per_second, out_of_order, received_per_second
from panemill.plans.engine import long_results, run
from panemill.plans.spec import LATENESS_MS, QuerySpec, WindowSpec, parse_windows, session, sliding, tumbling
from panemill.sources.events import NO_KEY, batch_stream, decode_events, read_event_stream, read_events, union_streams, write_batch, write_end
from panemill.sources.shared import shared_folder
from panemill.sources.sinks import with_latency, with_text_id, without_empty, write_results
from panemill.streaming.arrival import out_of_order_stream
from panemill.streaming.dense import with_empty_windows_of_stream
from panemill.streaming.sinks import drained
from panemill.streaming.windows import closing_ms, count_window_stream, query_stream

HOUR = 3_600_000
DAY = 24 * HOUR
ALL = "SUM;MIN;MAX;AVG;MEDIAN;M_SUM;M_AVG;M_MEDIAN;M_MIN"
CONCURRENT = f"CONCURRENT,10,TUMBLING,{DAY}"
SHARED = f"TUMBLING,{12 * HOUR},0;SLIDING,{12 * HOUR},{4 * HOUR},1;SLIDING,{8 * HOUR},{2 * HOUR},2;TUMBLING,{6 * HOUR},3"
HOLISTIC = "MODE;NINTH_DECILE;TRIMMED_MEAN;SUM;MEDIAN"
#: Far values are so many times as large; results are looked at at this time (ms).
FAR, NOW = 10**13, 1_800_000_000_000

Query = Callable[[SparkSession, str], DataFrame]

#: name: windows, functions, options
BATCH: dict[str, tuple[str, str, dict]] = {
    **{f"tumbling_{f.lower()}": (f"TUMBLING,{HOUR},0", f, {}) for f in ALL.split(";")},
    "tumbling_all_aggs_long": (f"TUMBLING,{DAY},1", ALL + ";SUM;MEDIAN", {}),
    "tumbling_unkeyed": (f"TUMBLING,{HOUR},0", "SUM;AVG;MEDIAN", {"keyed": False}),
    "sliding_sum": (f"SLIDING,{6 * HOUR},{HOUR},1", "SUM", {}),
    "sliding_avg": (f"SLIDING,{6 * HOUR},{2 * HOUR},1", "AVG", {}),
    "sliding_median": (f"SLIDING,{6 * HOUR},{2 * HOUR},1", "MEDIAN", {}),
    "sliding_uneven": (f"SLIDING,{5 * HOUR},{2 * HOUR},1", "MIN;MAX", {}),
    "session_sum": (f"SESSION,{2 * HOUR},2", "SUM", {}),
    "session_median": (f"SESSION,{2 * HOUR},2", "MEDIAN;AVG", {}),
    "session_unkeyed": ("SESSION,300000,2", "SUM;MAX", {"keyed": False}),
    "multi_window_sum": (f"TUMBLING,{DAY},0;SLIDING,{6 * HOUR},{3 * HOUR},1;SESSION,{2 * HOUR},2", "SUM;AVG", {}),
    "concurrent_tumbling_max": (CONCURRENT, "MAX", {"keyed": False}),
    "count_tumbling_global": ("TUMBLING,100,0,COUNT", "SUM;AVG", {}),
    "count_tumbling_per_key": ("TUMBLING,5,0,COUNT", "SUM;MEDIAN", {"scope": "key"}),
    "count_sliding_global": ("SLIDING,100,30,4,COUNT", "SUM", {}),
    "count_and_time_mix": (f"TUMBLING,50,0,COUNT;TUMBLING,{DAY},1", "SUM", {}),
    "dense_tumbling_sum": (f"TUMBLING,{DAY},0", "SUM;MEDIAN", {"dense": True}),
    "pane_shared_sliding": (SHARED, "SUM;AVG;MEDIAN", {}),
}


def _batch(windows: str, functions: str, *, keyed: bool = True, dense: bool = False, scope: str = "global") -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(read_events(spark, sf_dir), QuerySpec.parse(windows, functions, scope, keyed=keyed), dense=dense)

    return query


def out_of_order_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-order events of each stream if events arrive by the hash of their ids."""
    return out_of_order(_arrivals(spark, sf_dir), "arrival")


def throughput_per_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_per_second(read_events(spark, sf_dir))


def result_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as text, empty windows left out."""
    results = run(read_events(spark, sf_dir), QuerySpec.parse(f"TUMBLING,{DAY},0", "SUM;MIN"), dense=True)
    return with_text_id(without_empty(results)).select("result_id", "result_text")


def _stream(windows: Sequence[WindowSpec], functions: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec = QuerySpec(tuple(windows), tuple(aggregate(f) for f in functions.split(";")))
        return long_results(drained(query_stream(read_event_stream(spark, sf_dir), spec)))

    return query


#: Events of a file of a stream in several batches.
FILE_EVENTS = 1_000_000


def _batches(events: DataFrame, *parts: Column) -> tuple[str, int]:
    """Write the events of each condition one after the other, in equally many files: the folder, and files a part."""
    folder = shared_folder(events.sparkSession) + "/in"
    files = events.count() // FILE_EVENTS + 1
    for part in parts:
        write_batch(events.where(part), folder, files)
    return folder, files


def _thirds(events: DataFrame) -> list[Column]:
    """Conditions that cut events into three parts, one after the other in time."""
    low, high = events.agg(F.min("event_ts"), F.max("event_ts")).first()
    one, two = low + (high - low) // 3, low + (high - low) * 2 // 3
    ts = F.col("event_ts")
    return [ts <= one, (ts > one) & (ts <= two), ts > two]


def _ended(events: DataFrame, query: QuerySpec, *parts: Column) -> DataFrame:
    """A stream of the events of each condition, one after the other, and of a closing mark at its end."""
    folder, files = _batches(events, *parts)
    last = events.agg(F.max("event_ts")).first()[0]
    write_end(events.sparkSession, folder, closing_ms(last or 0, query))
    return batch_stream(events.sparkSession, folder, files)


def _overlapping(events: DataFrame) -> list[Column]:
    """Conditions that cut events into three parts which overlap in time, by less than the events' lateness: even and odd
    events of 80 ms around each cut change places."""
    low, high = events.agg(F.min("event_ts"), F.max("event_ts")).first()
    ts, part = F.col("event_ts"), F.lit(0)
    for k in (1, 2):
        cut = low + (high - low) * k // 3
        inside, odd = (ts > cut - 40) & (ts <= cut + 40), F.col("event_id") % 2 == 1
        part = part + F.when(inside, odd.cast("int")).when(ts > cut, 1).otherwise(0)
    return [part == 0, part == 1, part == 2]


def _count_stream(window: WindowSpec, functions: str, scope: str, *, dense_in_time: bool = False) -> Query:
    """Count windows of a stream that comes in three micro-batches, which overlap in time, and then ends."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = read_events(spark, sf_dir)
        if dense_in_time:
            events = closer(events)
        found = tuple(aggregate(f) for f in functions.split(";"))
        stream = _ended(events, QuerySpec((window,), found), *_overlapping(events))
        return long_results(drained(count_window_stream(stream, window, found, scope)))

    return query


#: So many times closer the events of ``closer`` are, that many of them come at one time and around a cut.
CLOSER = 60_000


def closer(events: DataFrame) -> DataFrame:
    """The same events in an hour instead of a month, many of them at one time."""
    return events.withColumn("event_ts", F.expr(f"event_ts div {CLOSER}")).withColumn("ts", F.timestamp_millis("event_ts"))


def stream_shared_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four windows of a stream over one state of panes."""
    events = read_events(spark, sf_dir)
    spec = QuerySpec.parse(SHARED, "SUM;AVG")
    return long_results(drained(query_stream(batch_stream(spark, *_batches(events, *_thirds(events))), spec)))


def stream_median_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of a stream in which one key has all events of two users in three, and few different values."""
    events = read_events(spark, sf_dir)
    hot = events.withColumns({"key": F.when(F.col("key") % 3 < 2, F.lit(0)).otherwise(F.col("key")).cast("bigint"), "value": F.expr("value div 10")})
    spec = QuerySpec.parse(f"SLIDING,{DAY},{6 * HOUR},0;TUMBLING,{DAY},1", "MEDIAN;SUM")
    return long_results(drained(query_stream(batch_stream(spark, *_batches(hot, *_thirds(hot))), spec)))


def stream_session_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream in three batches; their medians come from counts that wait until a session closes."""
    events = read_events(spark, sf_dir)
    spec = QuerySpec.parse(f"SESSION,{2 * HOUR},2", "MEDIAN;AVG")
    return long_results(drained(query_stream(batch_stream(spark, *_batches(events, *_thirds(events))), spec)))


def stream_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that ends: its closing mark gives all windows, as in a bounded query."""
    events = read_events(spark, sf_dir)
    spec = QuerySpec.parse(f"TUMBLING,{DAY},0;SLIDING,{DAY},{6 * HOUR},1;SESSION,{2 * HOUR},2", "SUM;MEDIAN")
    return long_results(drained(query_stream(_ended(events, spec, *_thirds(events)), spec)))


def stream_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream in three batches, with a row for each window without events of a key that is known."""
    events = read_events(spark, sf_dir)
    stream = batch_stream(spark, *_batches(events, *_thirds(events)))
    (window,) = parse_windows(f"TUMBLING,{6 * HOUR},0")
    return long_results(drained(with_empty_windows_of_stream(query_stream(stream, QuerySpec((window,), (aggregate("SUM"), aggregate("MAX")))), window)))


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive by the hash of their ids."""
    arrival = F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 13), 16, 10).cast("bigint")
    return read_events(spark, sf_dir).withColumn("arrival", arrival)


def stream_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The out-of-order share of each stream after the last of four batches, for the arrival of ``out_of_order_ratio``."""
    events = _arrivals(spark, sf_dir)
    quarter = F.floor(F.col("arrival") / (1 << 50))
    stream = batch_stream(spark, *_batches(events.drop("event_id").withColumnRenamed("arrival", "event_id"), *[quarter == k for k in range(4)]))
    found = drained(out_of_order_stream(stream))
    last = found.groupBy("stream_id").agg(F.max_by(F.struct("events", "late", "ratio"), "batch").alias("r"))
    return last.select("stream_id", "r.*")


def own_holistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holistic functions that this module has registered, over every kind of window."""
    windows = f"TUMBLING,{DAY},0;SLIDING,{DAY},{6 * HOUR},1;SESSION,{2 * HOUR},2;TUMBLING,7,3,COUNT"
    return run(_rounded(read_events(spark, sf_dir)), QuerySpec.parse(windows, HOLISTIC, "key"))


def stream_own_holistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same functions over a stream's windows."""
    events = _rounded(read_events(spark, sf_dir))
    spec = QuerySpec.parse(f"TUMBLING,{DAY},0;SESSION,{2 * HOUR},2", HOLISTIC)
    return long_results(drained(query_stream(_ended(events, spec, *_thirds(events)), spec)))


def _rounded(events: DataFrame) -> DataFrame:
    return events.withColumn("value", F.expr("value div 10"))


def _some_null(events: DataFrame) -> DataFrame:
    """Values that are null for each user in seven, and for some events of all; far values for each user in two."""
    far = F.when(F.col("key") % 2 == 1, F.col("value") * FAR).otherwise(F.col("value"))
    return events.withColumn("value", F.when((F.col("key") % 7 != 0) & (F.col("event_id") % 5 != 0), far))


def _null_values(functions: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        windows = f"TUMBLING,{6 * HOUR},0;SLIDING,{DAY},{6 * HOUR},1;SESSION,{2 * HOUR},2;TUMBLING,4,3,COUNT"
        return run(_some_null(read_events(spark, sf_dir)), QuerySpec.parse(windows, functions, "key"))

    return query


def stream_null_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null values in the windows of a stream, and in count windows of both scopes."""
    events = _some_null(read_events(spark, sf_dir))
    spec = QuerySpec.parse(f"TUMBLING,{6 * HOUR},0;SESSION,{2 * HOUR},2", "SUM;MEDIAN;AVG;MAX")
    found = long_results(drained(query_stream(_ended(events, spec, *_thirds(events)), spec)))
    stream = _ended(events, spec, *_overlapping(events))
    for window, scope in ((tumbling(4, 3, "COUNT"), "key"), (sliding(50, 20, 4, "COUNT"), "global")):
        counted = count_window_stream(stream, window, spec.functions, scope)
        found = found.unionByName(long_results(drained(counted)))
    return found


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each window's latest event time, as values that are times are for."""
    events = read_events(spark, sf_dir)
    times = events.withColumn("value", F.when(F.col("key") % 7 != 0, F.col("event_ts")))
    return run(times, QuerySpec.parse(f"TUMBLING,{HOUR},0", "M_SUM;M_AVG", keyed=True))


def result_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long after each window's latest event its result came, at a fixed time; empty results are dropped."""
    found = with_latency(_latest(spark, sf_dir), NOW)
    return found.select("window_start", "function_id", "key", "value", "latency_ms")


def receive_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and their mean latency by the second in which they came in, a while after the window's end."""
    received = F.col("window_end") + F.col("key") % 5000
    return received_per_second(_latest(spark, sf_dir).withColumn("received", received), "received")


def stream_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even and odd streams as two sources: the slower one's watermark closes the windows."""
    events = read_events(spark, sf_dir)
    odd = events.where("stream_id % 2 = 1")
    low, high = odd.agg(F.min("event_ts"), F.max("event_ts")).first()
    sources = [events.where("stream_id % 2 = 0"), odd.where(F.col("event_ts") <= low + (high - low) // 2)]
    streams = [batch_stream(spark, *_batches(s, *_thirds(s))) for s in sources]
    return long_results(drained(query_stream(streams, QuerySpec.parse(f"TUMBLING,{DAY},0", "SUM;MAX"))))


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the events comes when the watermark has passed most of their windows: only the rest of them counts."""
    events = read_events(spark, sf_dir)
    late = F.col("event_id") % 10 == 0
    folder, files = _batches(events, *[third & ~late for third in _thirds(events)], late)
    return long_results(drained(query_stream(batch_stream(spark, folder, files), QuerySpec.parse(f"TUMBLING,{HOUR},0", "SUM"))))


def stream_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that ends after a part of its events and goes on from its checkpoint when the others have come."""
    events = read_events(spark, sf_dir)
    first, second, third = _thirds(events)
    folder, files = _batches(events, first, second)
    spec, base = QuerySpec.parse(f"TUMBLING,{DAY},0;SESSION,{2 * HOUR},1", "SUM"), shared_folder(spark)
    drained(query_stream(batch_stream(spark, folder, files), spec), base)
    write_batch(events.where(third), folder, files)
    return long_results(drained(query_stream(batch_stream(spark, folder, files), spec), base))


def decoded_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as text lines of two inputs, one of them without keys."""
    events = read_events(spark, sf_dir)
    keyed = events.where("stream_id < 2").select(F.concat_ws(",", "stream_id", "event_ts", "value", "key").alias("value"))
    bare = events.where("stream_id >= 2").select(F.concat_ws(",", "stream_id", "event_ts", "value").alias("value"))
    return run(union_streams(decode_events(keyed), decode_events(bare)), QuerySpec.parse(f"TUMBLING,{DAY},0", "SUM;MEDIAN"))


def own_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function that this module has registered: the difference of the largest and the least value."""
    return run(read_events(spark, sf_dir), QuerySpec.parse(f"SLIDING,{DAY},{6 * HOUR},0", "RANGE;SUM"))


def written_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as files and read again."""
    folder = shared_folder(spark)
    write_results(run(read_events(spark, sf_dir), QuerySpec.parse(f"TUMBLING,{DAY},0", "MIN;AVG")), folder)
    return spark.read.parquet(folder)


def null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which some have a null key: these are a key of their own."""
    events = read_events(spark, sf_dir).withColumn("key", F.when(F.col("key") % 3 != 0, F.col("key")))
    return run(events, QuerySpec.parse(f"TUMBLING,{DAY},0;SESSION,{2 * HOUR},1;TUMBLING,7,2,COUNT", "SUM;MEDIAN", "key"))


if "RANGE" not in aggregate_names():
    register_aggregate(Aggregate("RANGE", "algebraic", (Part("_low", F.min, F.min), Part("_high", F.max, F.max)), lambda low, high: high - low))
    register_aggregate(Aggregate("MODE", "holistic", over_counts=most_frequent))
    register_aggregate(Aggregate("NINTH_DECILE", "holistic", over_counts=at_place(lambda total: F.floor(total * 9 / 10))))
    register_aggregate(Aggregate("TRIMMED_MEAN", "holistic", over_counts=mean_between(lambda total: F.floor(total / 10), lambda total: total - F.floor(total / 10))))


QUERIES: dict[str, Query] = {
    **{name: _batch(windows, functions, **options) for name, (windows, functions, options) in BATCH.items()},
    "out_of_order_ratio": out_of_order_ratio,
    "throughput_per_second": throughput_per_second,
    "result_text": result_text,
    "stream_tumbling_sum": _stream([tumbling(HOUR, 0)], "SUM;AVG"),
    "stream_sliding_max": _stream([sliding(6 * HOUR, 3 * HOUR, 1)], "MAX"),
    "stream_session_sum": _stream([session(2 * HOUR, 2)], "SUM"),
    "stream_multi_window": _stream([tumbling(DAY, 0), session(HOUR, 1)], "SUM;MEDIAN"),
    "stream_count_window": _count_stream(tumbling(5, 0, "COUNT"), "SUM", "key"),
    "stream_count_global": _count_stream(tumbling(100, 0, "COUNT"), "SUM;M_MIN;MEDIAN", "global"),
    "stream_count_avg_median": _count_stream(sliding(6, 4, 1, "COUNT"), "AVG;MEDIAN;MIN;MAX", "key"),
    "stream_sliding_median": _stream([sliding(6 * HOUR, 3 * HOUR, 1)], "MEDIAN"),
    "stream_count_by_time": _count_stream(sliding(40, 15, 2, "COUNT"), "SUM;MEDIAN;MAX", "global", dense_in_time=True),
    "stream_count_by_time_per_key": _count_stream(sliding(5, 3, 2, "COUNT"), "SUM;MEDIAN;MAX", "key", dense_in_time=True),
    "stream_shared_panes": stream_shared_panes,
    "stream_median_hot_key": stream_median_hot_key,
    "stream_session_median": stream_session_median,
    "stream_closed": stream_closed,
    "stream_dense": stream_dense,
    "stream_out_of_order": stream_out_of_order,
    "stream_own_holistic": stream_own_holistic,
    "stream_null_values": stream_null_values,
    "own_holistic": own_holistic,
    "null_values": _null_values("MEDIAN;SUM"),
    "null_values_median": _null_values("MEDIAN"),
    "result_latency": result_latency,
    "receive_rates": receive_rates,
    "stream_two_sources": stream_two_sources,
    "stream_late_rows": stream_late_rows,
    "stream_restarted": stream_restarted,
    "decoded_union": decoded_union,
    "own_aggregate": own_aggregate,
    "written_results": written_results,
    "null_keys": null_keys,
}

_SQL_OF = {
    "SUM": "CAST(sum(v) AS BIGINT)",
    "MIN": "min(v)",
    "MAX": "max(v)",
    "AVG": "CAST(sum(v) AS BIGINT) // count(v)",
    "MEDIAN": "list_sort(list(v) FILTER (v IS NOT NULL))[count(v) // 2 + 1]",
    "M_SUM": "max(v)",
    "M_AVG": "max(v)",
    "M_MEDIAN": "max(v)",
    "M_MIN": "abs(min(-v))",
    "RANGE": "max(v) - min(v)",
    "MODE": "(list_sort(list_transform(list_distinct(list(v)), lambda x: {'n': -len(list_filter(list(v), lambda y: y = x)), 'v': x}))[1]).v",
    "NINTH_DECILE": "list_sort(list(v))[count(v) * 9 // 10 + 1]",
    "TRIMMED_MEAN": "CAST(list_sum(list_sort(list(v))[count(v) // 10 + 1:count(v) - count(v) // 10]) AS BIGINT) // (count(v) - count(v) // 10 * 2)",
}


def _events_sql(keyed: bool | str, value: str = "v", time: str = "t") -> str:
    """The events; a text gives SQL for the key. ``value`` and ``time`` make others of v, t, key and event_id."""
    key = keyed if isinstance(keyed, str) else f"coalesce(user_id, {NO_KEY})" if keyed else str(NO_KEY)
    plain = f"(SELECT epoch_us(ts) // 1000 AS t, CAST(floor(value) AS BIGINT) AS v, CAST({key} AS BIGINT) AS key, event_id % 4 AS stream_id, event_id FROM events)"
    return plain if (value, time) == ("v", "t") else f"(SELECT {time} AS t, CAST({value} AS BIGINT) AS v, key, stream_id, event_id FROM {plain})"


def _rows_sql(w: WindowSpec, events: str, scope: str) -> str:
    """SQL for (s, e, key, v): each event once for each window that it lies in."""
    if w.measure == "COUNT":
        part, key = ("PARTITION BY key ", "key") if scope == "key" else ("", str(NO_KEY))
        placed = f"(SELECT row_number() OVER ({part}ORDER BY t, stream_id, event_id) - 1 AS t, v, CAST({key} AS BIGINT) AS key FROM {events})"
        starts = ", ".join(f"(t // {w.slide} - {k}) * {w.slide}" for k in range(-(-w.size // w.slide)))
        return f"SELECT s, s + {w.size} AS e, key, v FROM (SELECT unnest(list_filter([{starts}], lambda x: x >= 0 AND x + {w.size} > t)) AS s, key, v FROM {placed})"
    if w.kind == "SESSION":
        return f"""SELECT min(t) OVER (PARTITION BY key, n) AS s, max(t) OVER (PARTITION BY key, n) + {w.size} AS e, key, v FROM (
          SELECT *, sum(opens) OVER (PARTITION BY key ORDER BY t, event_id) AS n FROM (
            SELECT *, CASE WHEN t > lag(t) OVER (PARTITION BY key ORDER BY t, event_id) + {w.size} THEN 1 ELSE 0 END AS opens FROM {events}))"""
    starts = ", ".join(f"(t // {w.slide} - {k}) * {w.slide}" for k in range(-(-w.size // w.slide)))
    return f"SELECT s, s + {w.size} AS e, key, v, event_id FROM (SELECT unnest(list_filter([{starts}], lambda x: x >= 0 AND x + {w.size} > t)) AS s, key, v, event_id FROM {events})"


def results_sql(windows: Sequence[WindowSpec], functions: str, *, keyed: bool | str = True, dense: bool = False, scope: str = "global", closed: bool | str = False, where: str = "true", value: str = "v", time: str = "t") -> str:
    """SQL for a query's long results; ``closed`` leaves out windows that a stream's watermark has not passed (a text:
    SQL for the watermark), ``where`` is a condition for events and their windows."""
    events, parts = _events_sql(keyed, value, time), []
    for w in windows:
        rows = _rows_sql(w, events, scope)
        having = [f"count(*) = {w.size}"] if w.measure == "COUNT" else []
        having += [f"e <= ({closed if isinstance(closed, str) else f'SELECT max(t) - {LATENESS_MS} FROM {events}'})"] if closed else []
        for i, name in enumerate(functions.split(";")):
            sql = f"SELECT CAST({w.window_id} AS BIGINT) AS window_id, CAST(s AS BIGINT) AS window_start, CAST(e AS BIGINT) AS window_end, {i} AS function_id, key, {_SQL_OF[name]} AS value FROM ({rows}) WHERE {where} GROUP BY s, e, key" + (" HAVING " + " AND ".join(having) if having else "")
            if dense:
                sql = f"""SELECT {w.window_id}::BIGINT AS window_id, s.s AS window_start, s.s + {w.size} AS window_end, {i} AS function_id, k.key, r.value
                  FROM (SELECT DISTINCT key FROM {events}) k CROSS JOIN (SELECT unnest(range(min(t) // {w.size} * {w.size}, max(t) + 1, {w.slide})) AS s FROM {events}) s
                  LEFT JOIN ({sql}) r ON r.key = k.key AND r.window_start = s.s"""
            parts.append(sql)
    return "\nUNION ALL\n".join(parts)


#: The values of ``_some_null``, and those of users in a hot key.
_SOME_NULL = f"CASE WHEN key % 7 <> 0 AND event_id % 5 <> 0 THEN v * CASE WHEN key % 2 = 1 THEN {FAR} ELSE 1 END END"
_HOT = f"CASE WHEN coalesce(user_id, {NO_KEY}) % 3 < 2 THEN 0 ELSE coalesce(user_id, {NO_KEY}) END"
#: Count windows in the key scope beside others, which have no scope.
_OF_ALL_KINDS = f"TUMBLING,{6 * HOUR},0;SLIDING,{DAY},{6 * HOUR},1;SESSION,{2 * HOUR},2;TUMBLING,4,3,COUNT"


def _dense_stream_sql() -> str:
    """Results of closed windows, and a null row for each closed window of a key after its first one."""
    size, results = 6 * HOUR, results_sql([tumbling(6 * HOUR, 0)], "SUM;MAX", closed=True)
    events = _events_sql(True)
    return f"""SELECT CAST(0 AS BIGINT) AS window_id, CAST(s.s AS BIGINT) AS window_start, CAST(s.s + {size} AS BIGINT) AS window_end, f.f AS function_id, k.key, r.value
      FROM (SELECT key, min(window_start) AS first FROM ({results}) GROUP BY key) k
      JOIN (SELECT unnest(range(0, max(t) - {LATENESS_MS} - {size} + 1, {size})) AS s FROM {events}) s ON s.s >= k.first
      CROSS JOIN (SELECT unnest([0, 1]) AS f) f
      LEFT JOIN ({results}) r ON r.key = k.key AND r.window_start = s.s AND r.function_id = f.f"""


def _latest_sql() -> str:
    return results_sql([tumbling(HOUR, 0)], "M_SUM;M_AVG", value="CASE WHEN key % 7 <> 0 THEN t END")


def _two_sources_sql() -> str:
    events = _events_sql(True)
    half = f"(SELECT min(t) + (max(t) - min(t)) // 2 FROM {events} WHERE stream_id % 2 = 1)"
    tops = f"SELECT least((SELECT max(t) FROM {events} WHERE stream_id % 2 = 0), (SELECT max(t) FROM {events} WHERE stream_id % 2 = 1 AND t <= {half})) - {LATENESS_MS}"
    return results_sql([tumbling(DAY, 0)], "SUM;MAX", closed=tops, where=f"event_id % 2 = 0 OR event_id IN (SELECT event_id FROM {events} WHERE t <= {half})")


def _before_late_sql() -> str:
    """The watermark of the batch before the late one: it tells late rows, and it follows from the batches before that."""
    events = _events_sql(True)
    return f"SELECT max(t) - {LATENESS_MS} FROM {events} WHERE event_id % 10 <> 0 AND t <= (SELECT min(t) + (max(t) - min(t)) * 2 // 3 FROM {events})"


_OUT_OF_ORDER = f"""SELECT CAST(stream_id AS INTEGER) AS stream_id, count(*) AS events, CAST(sum(late) AS BIGINT) AS late, sum(late) / count(*) AS ratio FROM (
      SELECT stream_id, CASE WHEN t < max(t) OVER (PARTITION BY stream_id ORDER BY substr(md5(CAST(event_id AS VARCHAR)), 1, 13), t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS late FROM {_events_sql(True)}) GROUP BY stream_id"""


ORACLE_SQL: dict[str, str] = {
    **{name: results_sql(parse_windows(windows), functions, **options) for name, (windows, functions, options) in BATCH.items()},
    "out_of_order_ratio": _OUT_OF_ORDER,
    "stream_out_of_order": _OUT_OF_ORDER,
    "throughput_per_second": f"SELECT CAST(stream_id AS INTEGER) AS stream_id, t // 1000 AS second, count(*) AS events FROM {_events_sql(True)} GROUP BY ALL",
    "result_text": f"SELECT concat_ws(',', window_id, window_start, window_end, function_id, -1, key) AS result_id, CAST(value AS VARCHAR) AS result_text FROM ({results_sql([tumbling(DAY, 0)], 'SUM;MIN')})",
    "stream_tumbling_sum": results_sql([tumbling(HOUR, 0)], "SUM;AVG", closed=True),
    "stream_sliding_max": results_sql([sliding(6 * HOUR, 3 * HOUR, 1)], "MAX", closed=True),
    "stream_session_sum": results_sql([session(2 * HOUR, 2)], "SUM", closed=True),
    "stream_multi_window": results_sql([tumbling(DAY, 0), session(HOUR, 1)], "SUM;MEDIAN", closed=True),
    "stream_count_window": results_sql([tumbling(5, 0, "COUNT")], "SUM", scope="key"),
    "stream_count_global": results_sql([tumbling(100, 0, "COUNT")], "SUM;M_MIN;MEDIAN"),
    "stream_count_avg_median": results_sql([sliding(6, 4, 1, "COUNT")], "AVG;MEDIAN;MIN;MAX", scope="key"),
    "stream_count_by_time": results_sql([sliding(40, 15, 2, "COUNT")], "SUM;MEDIAN;MAX", time=f"t // {CLOSER}"),
    "stream_count_by_time_per_key": results_sql([sliding(5, 3, 2, "COUNT")], "SUM;MEDIAN;MAX", scope="key", time=f"t // {CLOSER}"),
    "stream_shared_panes": results_sql(parse_windows(SHARED), "SUM;AVG", closed=True),
    "stream_median_hot_key": results_sql(parse_windows(f"SLIDING,{DAY},{6 * HOUR},0;TUMBLING,{DAY},1"), "MEDIAN;SUM", keyed=_HOT, closed=True, value="v // 10"),
    "stream_session_median": results_sql([session(2 * HOUR, 2)], "MEDIAN;AVG", closed=True),
    "stream_closed": results_sql(parse_windows(f"TUMBLING,{DAY},0;SLIDING,{DAY},{6 * HOUR},1;SESSION,{2 * HOUR},2"), "SUM;MEDIAN"),
    "stream_dense": _dense_stream_sql(),
    "own_holistic": results_sql(parse_windows(f"TUMBLING,{DAY},0;SLIDING,{DAY},{6 * HOUR},1;SESSION,{2 * HOUR},2;TUMBLING,7,3,COUNT"), HOLISTIC, scope="key", value="v // 10"),
    "stream_own_holistic": results_sql(parse_windows(f"TUMBLING,{DAY},0;SESSION,{2 * HOUR},2"), HOLISTIC, value="v // 10"),
    "null_values": results_sql(parse_windows(_OF_ALL_KINDS), "MEDIAN;SUM", scope="key", value=_SOME_NULL),
    "null_values_median": results_sql(parse_windows(_OF_ALL_KINDS), "MEDIAN", scope="key", value=_SOME_NULL),
    "stream_null_values": "\nUNION ALL\n".join(results_sql([w], "SUM;MEDIAN;AVG;MAX", scope=scope, value=_SOME_NULL) for w, scope in ((tumbling(6 * HOUR, 0), "global"), (session(2 * HOUR, 2), "global"), (tumbling(4, 3, "COUNT"), "key"), (sliding(50, 20, 4, "COUNT"), "global"))),
    "result_latency": f"SELECT window_start, function_id, key, value, {NOW} - value AS latency_ms FROM ({_latest_sql()}) WHERE value IS NOT NULL",
    "receive_rates": f"SELECT (window_end + key % 5000) // 1000 AS second, count(*) AS results, CAST(sum(window_end + key % 5000 - value) AS BIGINT) // count(*) AS latency_ms FROM ({_latest_sql()}) WHERE value IS NOT NULL GROUP BY 1",
    "stream_sliding_median": results_sql([sliding(6 * HOUR, 3 * HOUR, 1)], "MEDIAN", closed=True),
    "stream_two_sources": _two_sources_sql(),
    "stream_late_rows": results_sql([tumbling(HOUR, 0)], "SUM", closed=True, where=f"NOT (event_id % 10 = 0 AND e <= ({_before_late_sql()}))"),
    "stream_restarted": results_sql([tumbling(DAY, 0), session(2 * HOUR, 1)], "SUM", closed=True),
    "decoded_union": results_sql([tumbling(DAY, 0)], "SUM;MEDIAN", keyed=f"CASE WHEN event_id % 4 < 2 THEN coalesce(user_id, {NO_KEY}) ELSE {NO_KEY} END"),
    "own_aggregate": results_sql([sliding(DAY, 6 * HOUR, 0)], "RANGE;SUM"),
    "written_results": results_sql([tumbling(DAY, 0)], "MIN;AVG"),
    "null_keys": results_sql(parse_windows(f"TUMBLING,{DAY},0;SESSION,{2 * HOUR},1;TUMBLING,7,2,COUNT"), "SUM;MEDIAN", keyed=f"CASE WHEN coalesce(user_id, {NO_KEY}) % 3 <> 0 THEN coalesce(user_id, {NO_KEY}) END", scope="key"),
}
