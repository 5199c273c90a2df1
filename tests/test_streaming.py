"""Streaming operators over several micro-batches."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from faultline.session import configure
from faultline.streaming import telemetry as S

EPOCH = dt.datetime(2024, 1, 1)


def at(seconds):
    return EPOCH + dt.timedelta(seconds=seconds)


def stream(spark, path, schema, *batches):
    """One file per batch, read one file at a time in the order they were written."""
    for i, rows in enumerate(batches):
        part = str(path / f"in-{i}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        source = next((path / f"in-{i}").glob("part-*.parquet"))
        (path / "stream").mkdir(exist_ok=True)
        (path / "stream" / f"{i:03d}.parquet").write_bytes(source.read_bytes())
        time.sleep(0.05)
    return (
        spark.readStream.schema(spark.createDataFrame([], schema).schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(str(path / "stream"))
    )


SPAN = (
    "ts timestamp, trace_id string, span_id string, parent_span_id string, service_name string, "
    "span_kind string, status_code string, duration_ns long"
)


def client(second, ident, service="web"):
    return (at(second), "t", ident, "", service, "SPAN_KIND_CLIENT", "STATUS_CODE_UNSET", 1)


def server(second, parent, service="api", status="STATUS_CODE_UNSET"):
    return (at(second), "t", f"s{second}", parent, service, "SPAN_KIND_SERVER", status, 5)


END = [client(900_000, "end"), server(900_000, "none")]


def test_call_edges_over_batches(spark, tmp_path):
    rows = stream(
        spark, tmp_path, SPAN,
        [client(10, "a"), client(70, "b")],
        # The child of `a` comes a batch later, one of `b` out of reach, and a self-call.
        [server(11, "a", status="STATUS_CODE_ERROR"), server(70 + 3601, "b"), client(80, "c"),
         server(81, "c", service="web")],
        END,
    )
    got = S.run_available(S.stream_call_edges(rows), str(tmp_path / "out")).collect()
    second = int((at(0) - dt.datetime(1970, 1, 1)).total_seconds())
    assert [(r.window_start - second, r.src_id, r.dst_id, r.request_count, r.error_count, r.duration_max)
            for r in got] == [(0, "web", "api", 1, 1, 5)]


def test_unmatched_clients_wait_for_the_bound(spark, tmp_path):
    rows = stream(
        spark, tmp_path, SPAN,
        [client(10, "a"), client(20, "b")], [server(3000, "a")], END,
    )
    got = S.run_available(S.stream_unmatched_clients(rows), str(tmp_path / "out")).collect()
    assert [r.span_id for r in got] == ["b"]


def day_of_spans(spark):
    """Calls of a day in no order of time, with children up to 70 minutes later, and a closing pair."""
    rows = []
    for i in range(720):
        second = i * 577 % 720 * 120
        rows.append(client(second, f"c{i}"))
        if i % 7:
            rows.append(server(second + i * 131 % 4200, f"c{i}", status="STATUS_CODE_ERROR" if i % 5 else "STATUS_CODE_UNSET"))
    return spark.createDataFrame(rows + END, SPAN)


def in_reach(spans):
    """Each client with its children in reach, or none."""
    c = spans.where("span_kind = 'SPAN_KIND_CLIENT'").select("span_id", F.col("ts").alias("c_ts"))
    s = spans.where("span_kind = 'SPAN_KIND_SERVER'").select(
        F.col("parent_span_id").alias("of"), F.col("ts").alias("s_ts"), "status_code")
    reach = F.col("s_ts").between(F.col("c_ts") - F.expr("INTERVAL 5 MINUTES"), F.col("c_ts") + F.expr("INTERVAL 1 HOUR"))
    return c.join(s, (c.span_id == s.of) & reach, "left").where("span_id <> 'end'")


def test_a_stream_in_order_of_time_takes_many_batches_and_loses_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FILE_ROWS", 100)
    monkeypatch.setattr(S, "STATE_ROWS", 25)
    spans = day_of_spans(spark).repartition(5, "span_id")
    rows = S.stream_by_time(spans, str(tmp_path / "in"))
    # Files follow each other both by name and by their own time, and do not overlap.
    files = sorted((tmp_path / "in").glob("part-*"))
    assert len(files) > 8 and files == sorted(files, key=lambda f: f.stat().st_mtime_ns)
    ends = [spark.read.parquet(str(f)).agg(F.min("ts"), F.max("ts")).first() for f in files]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))

    given = S.in_batches(spark)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    got = S.run_available(S.stream_call_edges(rows), str(tmp_path / "k1"), given=given)
    batches = [int(f.name) for f in (tmp_path / "k1" / "checkpoint" / "offsets").glob("[0-9]*")]
    assert max(batches) >= 4 and len(batches) < 5
    expected = in_reach(spans).where("of is not null").groupBy(
        F.unix_seconds(F.window("c_ts", "60 seconds").start).alias("window_start")).agg(
        F.count(F.lit(1)).alias("request_count"), F.count_if(F.col("status_code") == S.ERROR).alias("error_count"))
    assert sorted(got.select(*expected.columns).collect()) == sorted(expected.collect())
    got = S.run_available(S.stream_unmatched_clients(rows), str(tmp_path / "k2"), given=given)
    assert sorted(r.span_id for r in got.collect()) == sorted(
        r.span_id for r in in_reach(spans).where("of is null").collect())
    assert spark.conf.get("spark.sql.shuffle.partitions") == partitions


def test_files_without_order_are_one_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FILE_ROWS", 100)
    monkeypatch.setattr(S, "put_in_order", lambda *_: 0)
    rows = S.stream_by_time(day_of_spans(spark), str(tmp_path / "in"))
    got = S.run_available(S.stream_unmatched_clients(rows), str(tmp_path / "k2"), given=S.in_batches(spark))
    assert got.count() == in_reach(day_of_spans(spark)).where("of is null").count()


def test_a_store_writes_one_file_a_batch_unless_the_caller_says_more(spark, tmp_path):
    name = "spark.sql.streaming.checkpoint.fileChecksum.enabled"
    rows = stream(spark, tmp_path, SPAN, [client(10, "a"), server(11, "a")], END)
    assert S.run_available(S.stream_call_edges(rows), str(tmp_path / "out")).count() == 1
    state = [f.name for f in (tmp_path / "out" / "checkpoint" / "state").rglob("*.delta*") if f.name[0] != "."]
    assert state and all(n.endswith(".delta") for n in state)
    given = spark.newSession()
    given.conf.set(name, "true")
    assert configure(given).conf.get(name) == "true"


SAMPLE = "ts timestamp, metric string, value double"


def test_duplicates_across_batches(spark, tmp_path):
    rows = stream(
        spark, tmp_path, SAMPLE,
        [(at(1), "m", 1.0), (at(2), "n", 1.0)], [(at(3), "m", 2.0)],
    )
    kept = S.run_available(
        S.stream_distinct_samples(rows, ["metric"], "1 hour"), str(tmp_path / "out")).collect()
    assert sorted((r.metric, r.value) for r in kept) == [("m", 1.0), ("n", 1.0)]


def test_transitions_are_reported_once(spark, tmp_path):
    boundary = int((at(100) - dt.datetime(1970, 1, 1)).total_seconds())
    rows = stream(
        spark, tmp_path, SAMPLE,
        [(at(1), "good", 1.0), (at(1), "noisy", 9.0), (at(101), "good", 9.0)],
        [(at(102), "good", 9.0), (at(102), "noisy", 9.0), (at(103), "noisy", 9.0)],
        [(at(104), "good", 9.0), (at(105), "unseen", 9.0), (at(106), "unseen", 9.0)],
    )
    got = S.detect_transitions(rows, ["metric"], boundary, 5.0, str(tmp_path / "out"),
                               (boundary - 100, boundary + 100)).collect()
    assert [r.metric for r in got] == ["good"]


def test_transitions_after_a_restart(spark, tmp_path):
    """State and reports survive a restart; nothing is told twice, and the case's end drops what is known."""
    boundary = int((at(100) - dt.datetime(1970, 1, 1)).total_seconds())
    first = [[(at(1), "good", 1.0), (at(1), "slow", 1.0), (at(101), "good", 9.0), (at(101), "good", 9.0), (at(101), "slow", 9.0)]]
    later = [[(at(105), "good", 9.0), (at(106), "slow", 9.0)], [(at(9_000), "end", 0.0)],
             [(at(2), "late", 1.0), (at(110), "late", 9.0), (at(111), "late", 9.0)]]
    case, out = (boundary - 100, boundary + 100), str(tmp_path / "out")
    rows = stream(spark, tmp_path, SAMPLE, *first)
    got = S.detect_transitions(rows, ["metric"], boundary, 5.0, out, case, "1 minute").collect()
    assert [r.metric for r in got] == ["good"]
    for i, batch in enumerate(later, start=1):
        part = tmp_path / f"more-{i}"
        spark.createDataFrame(batch, SAMPLE).coalesce(1).write.parquet(str(part))
        (tmp_path / "stream" / f"{i:03d}.parquet").write_bytes(next(part.glob("part-*.parquet")).read_bytes())
    got = S.detect_transitions(rows, ["metric"], boundary, 5.0, out, case, "1 minute").collect()
    # Rows that come after the watermark has passed the case are late.
    assert sorted(r.metric for r in got) == ["good", "slow"]


def test_token_windows(spark, tmp_path):
    rows = stream(
        spark, tmp_path, "ts timestamp, provider string, tokens long",
        [(at(5), "p", 1_000_000)], [(at(55), "p", 900_000)], [(at(9000), "end", 0)],
    )
    used = S.run_available(
        S.stream_token_use(rows, "provider", "tokens"), str(tmp_path / "out")).collect()
    second = int((at(0) - dt.datetime(1970, 1, 1)).total_seconds())
    over = {r.window_start - second for r in used if r.provider == "p" and r.over_budget}
    assert over == {0}
    assert len([r for r in used if r.provider == "p"]) == 11


def test_exact_end_belongs_to_the_next_window(spark, tmp_path):
    rows = stream(
        spark, tmp_path, SAMPLE, [(at(0), "m", 1.0), (at(3600), "m", 1.0)], [(at(90_000), "end", 0.0)])
    got = S.run_available(
        S.stream_period_counts(rows, ["metric"], "1 hour", "1 minute"), str(tmp_path / "out"))
    assert sorted(r.rows for r in got.where("metric = 'm'").collect()) == [1, 1]


def test_late_rows_are_counted(spark, tmp_path):
    rows = stream(
        spark, tmp_path, SAMPLE,
        [(at(10_000), "m", 1.0)],
        [(at(9_000), "m", 1.0), (at(9_950), "m", 1.0), (at(20_000), "m", 1.0)],
        [(at(15_000), "m", 1.0), (at(19_999), "m", 1.0)],
    )
    ledger = S.count_late_rows(rows, 600, str(tmp_path / "late")).orderBy("batch").collect()
    assert [(r.rows, r.late_rows) for r in ledger] == [(1, 0), (3, 1), (2, 1)]
