"""Readers over small archives with known content: a harbour with cranes, gates and tide gauges."""

import json
import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from faultline.functions import windows as W
from faultline.operators import collapse as C
from faultline.operators.reporting import result_sizes
from faultline.sources import case_files, csv_archive, node_archive, responses, sinks, wide_archive

NOON = 1_720_000_000
NS = pa.timestamp("ns", tz="UTC")
TEXT = pa.large_string()


def parquet(path, kinds, *rows):
    """A file with the columns of `kinds` and one tuple per row."""
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())]
    pq.write_table(pa.table(columns, names=list(kinds)), path)
    return str(path)


# Fixed column names of the wide archives; `attr.*` names are free.
POINT = {"time": NS, "metric": TEXT, "value": pa.float64(), "service_name": TEXT, "attr.berth": TEXT}
HISTOGRAM = {"time": NS, "metric": TEXT, "service_name": TEXT, "count": pa.float64(), "sum": pa.float64(),
             "min": pa.float64(), "max": pa.float64(), "attr.berth": TEXT}
SPAN = {"time": NS, "trace_id": TEXT, "span_id": TEXT, "parent_span_id": TEXT, "span_name": TEXT,
        "attr.span_kind": TEXT, "service_name": TEXT, "duration": pa.uint64(),
        "attr.status_code": TEXT, "attr.cargo": TEXT}


def test_points_of_one_millisecond_collapse_to_the_last_period(spark, tmp_path):
    start = NOON * 10**9 + 250
    calm = parquet(tmp_path / "normal_tide.parquet", POINT,
                   (start, "tide.level", 0.5, "gauge", "north"), (start + 7, "tide.level", 0.75, "gauge", "north"))
    storm = parquet(tmp_path / "abnormal_tide.parquet", POINT, (start + 90, "tide.level", 6.25, "gauge", "north"))
    rows = wide_archive.read_numbers(spark, [calm, storm])
    assert {(r.ts_ns - start, r.value): r.period for r in rows.collect()} == {
        (0, 0.5): "normal", (7, 0.75): "normal", (90, 6.25): "abnormal"}
    labelled = wide_archive.point_labels(rows)
    assert labelled.first().labels == {"service_name": "gauge", "berth": "north", "job": "gauge"}
    keyed = labelled.select("*", W.floor_div("ts_ns", 1_000_000).alias("ts_ms"), F.to_json("labels").alias("series"))
    last = C.last_observation(keyed, ["metric", "series", "ts_ms"], "value", wide_archive.SOURCE_ORDER).collect()
    assert [(r.value, r.observations, r.ambiguous) for r in last] == [(6.25, 3, True)]


@pytest.mark.parametrize("value", [math.nan, -math.inf])
def test_a_point_must_be_finite(spark, tmp_path, value):
    path = parquet(tmp_path / "normal_tide.parquet", POINT, (NOON, "tide.level", value, "gauge", "north"))
    with pytest.raises(Exception, match="non-finite metric value"):
        wide_archive.read_numbers(spark, [path]).collect()


def test_histogram_points_become_three_samples(spark, tmp_path):
    point = (NOON, "crane.lift", "crane", 12.0, 30.5, 0.25, 9.0, "south")
    path = parquet(tmp_path / "normal_lifts.parquet", HISTOGRAM, point)
    points = wide_archive.point_labels(wide_archive.read_histograms(spark, [path]))
    got = sorted((r.metric, r.value, r.labels.get("le") or "") for r in C.histogram_samples(points).collect())
    assert got == [("crane.lift_bucket", 12.0, "inf"), ("crane.lift_count", 12.0, ""), ("crane.lift_sum", 30.5, "")]


@pytest.mark.parametrize("count", [0.3, -4.0])
def test_histogram_counts_are_whole(spark, tmp_path, count):
    path = parquet(tmp_path / "normal_lifts.parquet", HISTOGRAM,
                   (NOON, "crane.lift", "crane", count, 30.5, 0.25, 9.0, "south"))
    with pytest.raises(Exception, match="invalid histogram count"):
        wide_archive.read_histograms(spark, [path]).collect()


def span(kind="Producer", service="gate"):
    return (NOON * 10**9, "ab" * 16, "cd" * 8, "", "open", kind, service, 4_321, "Error", "timber")


def test_spans_have_end_kind_and_attributes(spark, tmp_path):
    row = wide_archive.read_spans(spark, [parquet(tmp_path / "abnormal_gate.parquet", SPAN, span())]).first()
    assert (row.end_ns - row.ts_ns, row.span_kind, row.status_code, row.attributes) == (
        4_321, "SPAN_KIND_PRODUCER", "STATUS_CODE_ERROR", {"cargo": "timber"})


@pytest.mark.parametrize("broken, message", [
    (span(kind="Diagonal"), "unknown span kind: Diagonal"), (span(service=""), "no service_name")])
def test_broken_spans_end_the_job(spark, tmp_path, broken, message):
    path = parquet(tmp_path / "abnormal_gate.parquet", SPAN, broken)
    with pytest.raises(Exception, match=message):
        wide_archive.read_spans(spark, [path]).collect()


def csv(path, header, *rows):
    path.write_text("\n".join([header, *rows, ""]), encoding="utf-8")
    return str(path)


# Fixed headers of the CSV archives.
BANK_APP = "timestamp,rr,sr,cnt,mrt,tc"
KPI = "timestamp,cmdb_id,kpi_name,value"


def test_bank_windows_include_both_ends(spark, tmp_path):
    app = csv(tmp_path / "metric_app.csv", BANK_APP,
              f"{NOON},7,6,5,4.5,Ferry", f"{NOON + 61},1,1,1,1,Ferry")
    kpi = csv(tmp_path / "metric_container.csv", KPI, f"{NOON + 60},Quay7,FuelLeft,33.25", f"{NOON - 1},Quay7,FuelLeft,1")
    rows = csv_archive.read_bank_metrics(spark, app, kpi, (NOON, NOON + 60)).collect()
    assert {r.metric: r.value for r in rows} == {"rr": 7.0, "sr": 6.0, "cnt": 5.0, "mrt": 4.5, "FuelLeft": 33.25}


def test_files_are_read_under_their_own_header(spark, tmp_path):
    service = csv(tmp_path / "metric_service.csv", "service,timestamp,rr,sr,mrt,count", f"tug-grpc,{NOON},1,2,3,4")
    first = csv(tmp_path / "metric_node.csv", KPI, f"{NOON},Quay7,wind.speed,12.5")
    turned = csv(tmp_path / "metric_mesh.csv", "value,kpi_name,cmdb_id,timestamp", f"99.5,fog.depth,Quay8,{NOON + 1}")
    rows = csv_archive.read_market_metrics(spark, service, [first, turned]).collect()
    kpis = {(r.metric, r.value, r.labels["cmdb_id"], r.labels["metric_source"], r.ts_ms) for r in rows
            if "cmdb_id" in r.labels}
    assert kpis == {("wind_speed", 12.5, "Quay7", "metric_node", NOON * 1000),
                    ("fog_depth", 99.5, "Quay8", "metric_mesh", NOON * 1000 + 1000)}
    assert len(rows) == 6


def test_part_files_must_agree_on_the_header(spark, tmp_path):
    folder = tmp_path / "metric_node.csv"
    folder.mkdir()
    csv(folder / "part-0.csv", KPI, f"{NOON},Quay7,wind.speed,12.5")
    csv(folder / "part-1.csv", "value,kpi_name,cmdb_id,timestamp", f"99.5,fog.depth,Quay8,{NOON}")
    app = csv(tmp_path / "metric_app.csv", BANK_APP, f"{NOON},7,6,5,4,Ferry")
    with pytest.raises(Exception, match="header|Header"):
        csv_archive.read_bank_metrics(spark, app, str(folder)).collect()


def test_a_cell_that_is_no_number_ends_the_job(spark, tmp_path):
    app = csv(tmp_path / "metric_app.csv", BANK_APP, f"{NOON},7,6,5,nan,Ferry")
    kpi = csv(tmp_path / "metric_container.csv", KPI, f"{NOON},Quay7,FuelLeft,plenty")
    with pytest.raises(Exception, match="not a number: plenty"):
        csv_archive.read_bank_metrics(spark, app, kpi).collect()
    kpi = csv(tmp_path / "metric_other.csv", KPI, f"{NOON},Quay7,FuelLeft,-inf")
    rows = csv_archive.read_bank_metrics(spark, app, kpi).collect()
    assert sorted(r.metric for r in rows) == ["cnt", "rr", "sr"]


def test_names_that_fold_to_one_end_the_job(spark, tmp_path):
    app = csv(tmp_path / "metric_app.csv", BANK_APP, f"{NOON},7,6,5,4,Ferry")
    kpi = csv(tmp_path / "metric_container.csv", KPI, f"{NOON},Quay7,wind.speed,1", f"{NOON},Quay8,wind/speed,2")
    with pytest.raises(Exception, match="name collision after folding, wind.speed, wind/speed"):
        csv_archive.read_bank_metrics(spark, app, kpi).select("ts_ms").collect()


def test_messages_keep_quotes_and_line_breaks(spark, tmp_path):
    path = csv(tmp_path / "log_quay.csv", "log_id,timestamp,cmdb_id,log_name,value",
               f'9,{NOON},Quay7,radio,"say ""ahoy"",\nthen wait"')
    row = csv_archive.read_csv_logs(spark, path, with_source=True, multiline=True).first()
    assert (row.message, row.labels["log_source"]) == ('say "ahoy",\nthen wait', "log_quay")


def test_bank_spans_have_no_length_and_no_service(spark, tmp_path):
    path = csv(tmp_path / "trace_span.csv", "timestamp,cmdb_id,parent_id,span_id,trace_id,duration",
               f"{NOON}123,Quay7,,s9,t9,88")
    row = csv_archive.read_csv_spans(spark, path, "bank", (NOON, NOON + 1)).first()
    assert (row.parent_span_id, row.service_name, row.span_kind, row.end_ns - row.ts_ns) == (
        "", "", "SPAN_KIND_UNSPECIFIED", 0)
    assert row.ts_ns == (NOON * 1000 + 123) * 10**6


def test_telecom_spans_spell_a_missing_parent(spark, tmp_path):
    head = "callType,startTime,elapsedTime,success,traceId,id,pid,cmdb_id,dsName,serviceName"
    path = csv(tmp_path / "trace_span.csv", head,
               f"Radio,{NOON}000,7,True,t9,s1,null,ship_3,,harbour", f"Radar,{NOON}000,7,False,t9,s2,s1,ship_3,map,")
    rows = csv_archive.read_csv_spans(spark, path, "telecom").orderBy("span_id").collect()
    assert [(r.parent_span_id, r.span_name) for r in rows] == [("", "harbour"), ("s1", "Radar")]


def test_task_windows_are_local_times(spark):
    texts = ["A gate jammed on June 30, 2022 (seen from 06:15 until 07:45).", "Some time after 06:15."]
    df = spark.createDataFrame([(t,) for t in texts], "instruction string")
    row = csv_archive.task_windows(df.limit(1)).first()
    # 06:15 in the archives' zone is 22:15 of the day before in UTC.
    assert (row.window_start, row.window_end) == (1656540900, 1656546300)
    with pytest.raises(Exception, match="cannot parse task window"):
        csv_archive.task_windows(df).collect()


def test_events_take_their_first_time(spark, tmp_path):
    at = "2023-11-05T09:30:{:02d}Z".format
    documents = [{"lastTimestamp": at(11), "eventTime": at(40)}, {"eventTime": at(22)},
                 {"metadata": {"creationTimestamp": at(33)}, "lastTimestamp": None}]
    kinds = {"eventId": pa.string()}
    path = parquet(tmp_path / "events.parquet", kinds, *[(json.dumps(d),) for d in documents])
    seconds = sorted(r.ts_ns // 10**9 % 60 for r in node_archive.read_events(spark, path).collect())
    assert seconds == [11, 22, 33]
    timeless = parquet(tmp_path / "timeless.parquet", kinds, (json.dumps({"reason": "Docked"}),))
    with pytest.raises(Exception, match="event has no timestamp"):
        node_archive.read_events(spark, timeless).collect()


NODE_SPAN = {c: pa.string() for c in (
    "traceId", "spanId", "parentSpanId", "spanName", "kind", "statusCode", "statusMessage", "startTime",
    "endTime", "serviceName", "resources", "attributes", "events")}


@pytest.mark.parametrize("events, found", [
    (None, 0), ("", 0), ("[]", 0), ('[{"name": "moored"}, {"name": "left"}]', 2),
    ('{"name": "moored"}', None), ("[moored", None), ("[3]", None)])
def test_span_events_are_lists_of_objects(spark, tmp_path, events, found):
    row = ("t", "s", "", "dock", "2", "0", "", "5", "9", "quay", "{}", "", events)
    read = node_archive.read_json_spans(spark, parquet(tmp_path / "spans.parquet", NODE_SPAN, row))
    if found is None:
        with pytest.raises(Exception, match="list of JSON objects"):
            read.collect()
    else:
        assert len(read.first().events) == found


def test_topology_documents_of_both_kinds(spark, tmp_path):
    document = {"entities": [{"id": "q7", "type": "quay", "name": "Seven"}, {"id": "", "type": "quay", "name": "lost"}],
                "edges": [{"src": "q7", "dst": "q8", "relation": "feeds"}, {"src": "q8", "dst": "q7", "relation": "feeds"}]}
    for name, pretty in (("long.json", 4), ("lines.json", None)):
        (tmp_path / name).write_text(json.dumps(document, indent=pretty))
        entities, edges = case_files.read_topology(spark, str(tmp_path / name), one_per_file=bool(pretty))
        assert [r.id for r in entities.collect()] == ["q7"] and edges.count() == 2


def test_entry_metadata_joins_the_stream_labels(spark):
    stream = {"stream": {"quay": "seven"}, "values": [["31", "gate shut"], ["30", "gate open", {"crew": "blue"}]]}
    body = json.dumps({"data": {"resultType": "streams", "result": [stream]}})
    rows = responses.flatten_log_streams(spark.createDataFrame([(body,)], "body string"), "body").collect()
    assert {r.line: r.labels for r in rows} == {
        "gate shut": {"quay": "seven"}, "gate open": {"quay": "seven", "crew": "blue"}}


def test_digests_see_rows_and_not_their_order(spark, tmp_path):
    ships = spark.range(257).select("id", F.concat(F.lit("ship "), F.col("id") % 11).alias("name"))

    def digest(name, df):
        return sinks.write_report(df, str(tmp_path / name), ["id"]).first()

    once, shuffled = digest("a", ships), digest("b", ships.orderBy(F.desc("id")).repartition(5))
    assert (once.digest, once.rows) == (shuffled.digest, 257)
    assert digest("c", ships.unionByName(ships.where("id = 3"))).digest != once.digest


def test_signals_are_folders_of_their_own(spark, tmp_path):
    root = str(tmp_path / "store")
    sinks.write_telemetry(spark.createDataFrame([(3.5, 1)], "level double, ts_ns long"), root, "metrics")
    sinks.write_telemetry(spark.createDataFrame([("fog", 1), ("rain", 2)], "note string, ts_ns long"), root, "logs")
    assert sinks.read_telemetry(spark, root, "logs").select("note").count() == 2
    assert [r.level for r in sinks.read_telemetry(spark, root, "metrics").collect()] == [3.5]


def test_result_sizes_are_the_bytes_of_the_document(spark):
    rows = [(1, "plain", 2.5, True), (-20, 'say "ho"\\\n\t', 1e-7, None), (None, "Größe 😀 \x7f\x01", 1.25e20, False),
            (7, None, -120000000.0, True), (8, "", 0.0005, None), (9, "é", 1e16, False), (10, "x", 123456789.125, True)]
    df = spark.createDataFrame([("q", *r) for r in rows], "q string, n long, s string, d double, b boolean")
    document = {"columns": ["n", "s", "d", "b"], "rows": [list(r) for r in rows]}
    want = len(json.dumps(document, separators=(",", ":"), ensure_ascii=True))
    got = result_sizes(df, ["q"], ["n", "s", "d", "b"]).first()
    assert (got.returned_items, got.result_bytes) == (len(rows), want)
