import dataclasses
import json
import os
import statistics
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from runloom import streaming
from runloom.constants import ARTIFACTS_CHANNEL, ERROR_CODES, SUMMARY_CHANNEL
from runloom.streaming import serving, status
from runloom.streaming.outbox import Outbox, caused_by_a_row


def payload(step, args, dataset="d1", ptype="inference"):
    part = {"type": ptype, "parameters": {"selected_user_parameters": [{"step": step, "args": args}]}, "dataset_uri": dataset}
    return json.dumps({"solution_metadata": {"pipeline": [part]}})


def request(number, text, plan=1):
    return {"request_id": number, "seq": number, "plan_id": plan, "ts": f"2024-01-01T00:{number:02}:00Z", "payload": text}


def land(folder, name, requests):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in requests)


def parsed(spark, *texts):
    data = [(i, i, 1, None, text) for i, text in enumerate(texts)]
    return streaming.parse_requests(spark.createDataFrame(data, streaming.REQUEST_ENVELOPE))


def test_bad_requests_become_rows(spark):
    df = parsed(
        spark,
        payload("s", {}),
        '{"solution_meta',
        None,
        '{"solution_metadata": {}}',
        payload("s", {}, dataset=None),
        payload("s", {}, dataset=""),
        payload("s", {}, ptype="train"),
    )
    assert [r["error_code"] for r in df.orderBy("seq").collect()] == [None, "E111", "E111", "E111", "E122", "E122", None]


@pytest.mark.parametrize(
    ("value", "wanted"),
    [("7", "7"), (7, "7"), (1.5, "1.5"), (True, "true"), (" a , b ", "a,b"), (["a", "b"], "a,b"), ([], None), ({}, None), ("", None), (None, None)],
)
def test_argument_values(spark, value, wanted):
    df = parsed(spark, payload("s", {"k": value}))
    assert df.select(streaming.request_arguments("s", "k").alias("v")).first()["v"] == wanted


def test_failures_go_to_open_channels(spark):
    df = spark.createDataFrame([(1, "init", "x"), (2, "summary", "y"), (3, "artifacts", "z")], "request_id bigint, state string, message string")
    assert rows(streaming.route_failures(df), "request_id", "channel") == [
        (1, ARTIFACTS_CHANNEL),
        (1, SUMMARY_CHANNEL),
        (2, ARTIFACTS_CHANNEL),
    ]


def service(spark, root):
    base = spark.createDataFrame(
        [(1, "s", "a", "1"), (1, "s", "b", "2"), (1, "bare", None, None), (2, "s", "a", "50")],
        "plan_id bigint, step string, name string, value string",
    )
    datasets = spark.createDataFrame([("d1", 100), ("d2", 200)], "dataset_uri string, amount bigint")

    def score(df):
        total = F.col("amount") + F.coalesce(F.col("s__a").try_cast("int"), F.lit(0)) + F.coalesce(F.col("bare__c").try_cast("int"), F.lit(0))
        return df.withColumn("score", F.when(F.coalesce("s__b", F.lit("")) != "fail", total))

    return streaming.Service(base, datasets, {"s": ["a", "b"], "bare": ["c"]}, score, ["score"], root)


def summary(spark, root, channel=SUMMARY_CHANNEL):
    got = streaming.read_channel(spark, root, channel).collect()
    assert len({r["request_id"] for r in got}) == len(got)
    return {r["request_id"]: json.loads(r["message"])["score"] if r["status"] == "success" else r["message"] for r in got}


def serve_all(spark, source, root):
    stream = streaming.request_stream(spark, source)
    streaming.drain(streaming.serve(stream, service(spark, f"{root}/out"), f"{root}/checkpoint"))


def served_batch(spark, batch, answering, batch_id=0):
    """One batch without a stream before it."""
    rows = serving.read_requests(batch, answering).withColumn("is_state", F.lit(False))
    serving.serve_batch(rows, batch_id, answering, serving._plan_columns(answering))


def test_overlays_add_up_over_requests_and_restarts(spark, tmp_path):
    source, root = f"{tmp_path}/in", str(tmp_path)
    expected = {}

    land(source, "0", [request(1, payload("s", {"a": "7"})), request(2, payload("s", {"b": "x"})), request(3, "{broken")])
    serve_all(spark, source, root)
    expected |= {1: 107, 2: 107, 3: "E111"}
    assert summary(spark, f"{root}/out") == expected

    # the parameter of request 1 still counts; empty ones and steps without arguments do not
    land(source, "1", [request(4, payload("s", {"a": ""}, "d2")), request(5, payload("bare", {"c": "9"})), request(6, payload("t", {"a": "9"}))])
    serve_all(spark, source, root)
    expected |= {4: 207, 5: 107, 6: 107}

    land(source, "2", [request(7, payload("s", {"a": "8"}, "nowhere")), request(8, payload("s", {"b": "fail"})), request(9, payload("s", {"b": "1"}))])
    serve_all(spark, source, root)
    expected |= {7: "E141", 8: "E161", 9: 108}

    # another plan has its own parameters; a request that comes again is answered once
    land(source, "3", [request(10, payload("s", {"b": "1"}), plan=2), request(9, payload("s", {"a": "1000"}))])
    serve_all(spark, source, root)
    land(source, "4", [request(11, payload("s", {}, None)), request(12, payload("s", {}))])
    serve_all(spark, source, root)
    expected |= {10: 150, 11: "E122", 12: 108}

    # a restart without new requests adds nothing
    serve_all(spark, source, root)
    assert summary(spark, f"{root}/out") == expected
    assert summary(spark, f"{root}/out", ARTIFACTS_CHANNEL) == expected
    assert os.listdir(f"{root}/out/work") == []


def sections(*parts, ptype="inference"):
    return json.dumps({"solution_metadata": {"pipeline": [{"type": ptype, **part} for part in parts]}})


def chosen(step, args):
    return {"parameters": {"selected_user_parameters": [{"step": step, "args": args}]}}


def test_every_section_counts(spark):
    df = parsed(spark, sections({**chosen("s", {"a": "1"}), "dataset_uri": "d1"}, {**chosen("s", {"b": "2"})}, {**chosen("s", {"a": "3"})}))
    got = df.select("request.dataset_uri", streaming.request_arguments("s", "a").alias("a"), streaming.request_arguments("s", "b").alias("b"))
    assert tuple(got.first()) == ("d1", "3", "2")


def test_a_payload_is_parsed_twice_whatever_is_read_of_it(spark, tmp_path):
    asked = spark.createDataFrame([(1, 1, 1, None, payload("s", {"a": "3"}))], streaming.REQUEST_ENVELOPE)
    plan = serving.read_requests(asked, service(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(solution_metadata") == 2


@pytest.mark.parametrize("buckets", [1, 3])
def test_plans_of_a_bucket_keep_apart(spark, tmp_path, monkeypatch, buckets):
    monkeypatch.setattr(serving, "BUCKETS", buckets)
    source, root = f"{tmp_path}/in", str(tmp_path)
    base = spark.createDataFrame([(n, "s", "b", "1") for n in range(9)], "plan_id bigint, step string, name string, value string")
    answering = dataclasses.replace(service(spark, f"{root}/out"), base=base)
    for name, numbers in (("0", range(6)), ("1", range(3, 9))):
        sets = {"a": "7"} if name == "0" else {}
        land(source, name, [request(10 * int(name) + n, payload("s", sets and {"a": str(n)}), plan=n) for n in numbers])
        streaming.drain(streaming.serve(streaming.request_stream(spark, source), answering, f"{root}/checkpoint"))
    first, second = {n: 100 + n for n in range(6)}, {10 + n: 100 + (n if n < 6 else 0) for n in range(3, 9)}
    assert summary(spark, f"{root}/out") == first | second


def test_late_requests_and_kept_datasets(spark, tmp_path):
    source, root = f"{tmp_path}/in", str(tmp_path)
    for name, (number, month, text) in enumerate(
        [
            (1, 6, sections(chosen("s", {}))),  # no dataset yet
            (2, 6, sections({**chosen("s", {}), "dataset_uri": "d2"})),
            (3, 1, sections(chosen("s", {}))),  # months late, and the dataset of request 2 holds
            (4, 6, sections({"dataset_uri": ""})),
            (5, 6, sections({})),
            (2, 6, sections({**chosen("s", {"a": "9"}), "dataset_uri": "d2"})),  # delivered again
        ]
    ):
        land(source, str(name), [{**request(number, text), "ts": f"2024-{month:02}-01T00:00:00Z"}])
        serve_all(spark, source, root)
    expected = {1: "E122", 2: 201, 3: 201, 4: "E122", 5: 201}
    assert summary(spark, f"{root}/out") == expected == summary(spark, f"{root}/out", ARTIFACTS_CHANNEL)


def test_a_request_that_raises_fails_alone(spark, tmp_path):
    answering = service(spark, str(tmp_path))

    def score(df):
        raised = F.when(F.col("s__b") == "boom", F.raise_error(F.lit("no"))).otherwise(F.col("amount"))
        return df.withColumn("score", raised.cast("bigint"))

    asked = [(n, n, 10 + n, None, payload("s", {"b": "boom" if n == 2 else "x"})) for n in range(1, 4)]
    base = spark.createDataFrame([(10 + n, "s", "b", "1") for n in range(1, 4)], "plan_id bigint, step string, name string, value string")
    answering = serving.Service(base, answering.datasets, answering.parameters, score, answering.summary, answering.root)
    batch = spark.createDataFrame(asked, streaming.REQUEST_ENVELOPE)
    served_batch(spark, batch, answering)
    assert summary(spark, str(tmp_path)) == {1: 100, 2: "E152", 3: 100}


def test_queue_records_become_requests(spark):
    data = [(bytearray(b"7"), bytearray(b"{}"), 0, 5, None), (bytearray(b"8"), None, 1, 5, None)]
    records = spark.createDataFrame(data, "key binary, value binary, partition int, offset bigint, timestamp timestamp")
    got = streaming.queued_requests(records)
    found = {(r["request_id"], r["seq"], r["plan_id"], r["payload"]) for r in got.collect()}
    assert found == {(5, 5, 7, "{}"), ((1 << 48) + 5, 5, 8, None)}
    assert [name for name, _ in got.dtypes] == ["request_id", "seq", "plan_id", "ts", "payload"]


def test_progress(spark, tmp_path):
    schema = "request_id bigint, status string, message string"
    first = spark.createDataFrame([(1, "success", "x"), (2, "success", "y")], schema)
    first.write.parquet(f"{tmp_path}/{SUMMARY_CHANNEL}/batch_id=0")
    first.filter("request_id = 1").write.parquet(f"{tmp_path}/{ARTIFACTS_CHANNEL}/batch_id=0")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "request_id bigint")
    assert rows(streaming.progress(asked, str(tmp_path))) == [(1, "artifacts"), (2, "summary"), (3, "init")]


def test_a_replayed_batch_leaves_the_same_rows(spark, tmp_path):
    batch = spark.createDataFrame([(1, 1, 1, None, payload("s", {"a": "3"}))], streaming.REQUEST_ENVELOPE)
    answering = service(spark, str(tmp_path))
    for _ in range(2):
        served_batch(spark, batch, answering)
    assert summary(spark, str(tmp_path)) == {1: 103}


def test_latest_status(spark, tmp_path):
    source, root = f"{tmp_path}/in", str(tmp_path)
    schema = "run bigint, seq bigint, status string"

    def run(name, events):
        os.makedirs(source, exist_ok=True)
        with open(f"{source}/{name}.json", "w") as f:
            f.writelines(json.dumps(dict(zip(("run", "seq", "status"), e))) + "\n" for e in events)
        stream = streaming.request_stream(spark, source, schema=schema)
        streaming.drain(streaming.status_stream(stream, f"{root}/rows", f"{root}/checkpoint"))
        return rows(streaming.current_status(spark, f"{root}/rows"), "run", "status")

    assert run("0", [(1, 1, "setup"), (1, 2, "load"), (2, 1, "booting")]) == [(1, "load"), (2, "booting")]
    assert run("1", [(1, 5, "save"), (1, 4, "run.train")]) == [(1, "save"), (2, "booting")]
    assert run("2", [(1, 3, "run")]) == [(1, "save"), (2, "booting")]


def test_state_of_runs_that_ended_goes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(status, "FOLD_EVERY", 4)
    source, root, schema = f"{tmp_path}/in", str(tmp_path), "run bigint, seq bigint, status string"
    os.makedirs(source)
    for n, events in enumerate([[(r, 1, "run") for r in range(40)], [(r, 2, "save") for r in range(30)], [(99, 1, "load"), (3, 1, "setup")], *[[(99, 2 + k, "run")] for k in range(7)]]):
        with open(f"{source}/{n:03}.json", "w") as f:
            f.writelines(json.dumps(dict(zip(("run", "seq", "status"), e))) + "\n" for e in events)
        os.utime(f"{source}/{n:03}.json", (n + 10**9, n + 10**9))
    stream = streaming.request_stream(spark, source, max_files=1, schema=schema)
    query = streaming.drain(streaming.status_stream(stream, f"{root}/rows", f"{root}/checkpoint"))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    # Run 3 ended; what came late for it is state again until it times out.
    assert held[0] == 40 and held[1] == 10 and held[-1] == 12
    found = {r["run"]: (r["status"], r["seq"]) for r in streaming.current_status(spark, f"{root}/rows").collect()}
    assert found == {r: ("save", 2) if r < 30 else ("run", 1) for r in range(40)} | {99: ("run", 8)}
    assert os.listdir(f"{root}/rows/table") == ["upto=7"] and sorted(os.listdir(f"{root}/rows/changes")) == ["batch_id=8", "batch_id=9"]


def test_state_of_silent_runs_goes(spark, tmp_path):
    source, root, schema = f"{tmp_path}/in", str(tmp_path), "run bigint, seq bigint, status string"

    def run(name, events):
        os.makedirs(source, exist_ok=True)
        with open(f"{source}/{name}.json", "w") as f:
            f.writelines(json.dumps(dict(zip(("run", "seq", "status"), e))) + "\n" for e in events)
        stream = streaming.request_stream(spark, source, schema=schema)
        query = streaming.drain(streaming.status_stream(stream, f"{root}/rows", f"{root}/checkpoint", keep="1 second"))
        return query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]

    assert run("0", [(r, 1, "run") for r in range(20)]) == 20
    time.sleep(1.5)
    assert run("1", [(50, 1, "run")]) == 1


def test_error_codes(spark):
    events = spark.createDataFrame([(1, "E141"), (2, "E000"), (3, None)], "request_id bigint, code string")
    got = rows(streaming.enrich_errors(events), "request_id", "error_name")
    assert got == [(1, "PipelineDataLoadError"), (2, None), (3, None)]
    assert streaming.error_table(spark).count() == len(ERROR_CODES) == 11
    assert "BroadcastHashJoin" in streaming.enrich_errors(events)._jdf.queryExecution().executedPlan().toString()


def answering_with(spark, root, score, artifacts=None):
    plain = service(spark, root)
    return streaming.Service(plain.base, plain.datasets, plain.parameters, score, plain.summary, root, artifacts)


def asked(spark, values):
    """Requests of plan 1 that set s.a."""
    data = [(n, n, 1, None, payload("s", {"a": value})) for n, value in enumerate(values)]
    return spark.createDataFrame(data, streaming.REQUEST_ENVELOPE)


def test_errors_are_values(spark, tmp_path):
    calls = []

    def score(frame):
        if (frame["s__a"] == "boom").any():
            raise ValueError("no")
        return frame["s__a"].astype(float).astype(int).to_frame("score")

    values = ["boom" if n in (3, 77) else str(n) for n in range(100)]
    answering = answering_with(spark, str(tmp_path), streaming.guarded(score, "score bigint"))
    isolated = Outbox.isolated
    Outbox.isolated = lambda self, step, rows, make, *rest: isolated(self, step, rows, lambda r: calls.append(1) or make(r), *rest)
    try:
        served_batch(spark, asked(spark, values), answering)
    finally:
        Outbox.isolated = isolated
    wanted = {n: "E152" if value == "boom" else n for n, value in enumerate(values)}
    assert summary(spark, str(tmp_path)) == wanted == summary(spark, str(tmp_path), ARTIFACTS_CHANNEL)
    # The scoring was planned for all requests at once, and no job was spent on finding the bad ones.
    assert len(calls) == 1


@pytest.mark.parametrize("error", [MemoryError("full"), OSError(28, "No space left on device")])
def test_a_failing_machine_ends_the_batch(spark, tmp_path, error):
    state = tmp_path / "broken"
    state.touch()

    def score(frame):
        if os.path.exists(state):
            raise error
        return frame["amount"].to_frame("score")

    answering = answering_with(spark, f"{tmp_path}/out", streaming.guarded(score, "score bigint"))
    with pytest.raises(Exception, match=type(error).__name__):
        served_batch(spark, asked(spark, ["1", "2"]), answering)
    state.unlink()
    served_batch(spark, asked(spark, ["1", "2"]), answering)
    assert summary(spark, f"{tmp_path}/out") == {0: 100, 1: 100}


def test_whose_fault(spark):
    def error(column):
        with pytest.raises(Exception) as caught:
            spark.range(3).select(column).collect()
        return caught.value

    def raising(problem):
        @F.pandas_udf("long")
        def fail(values):
            raise problem

        return fail("id")

    assert caused_by_a_row(error(F.lit(1) / F.col("id")))
    assert caused_by_a_row(error(F.concat(F.lit("a"), "id").cast("int")))
    assert caused_by_a_row(error(F.raise_error(F.lit("no"))))
    assert caused_by_a_row(error(raising(ValueError("no"))))
    assert not caused_by_a_row(error(raising(MemoryError())))
    assert not caused_by_a_row(error(raising(OSError(28, "No space left on device"))))
    assert not caused_by_a_row(error("missing"))
    assert not caused_by_a_row(RuntimeError("22"))


def test_artifacts_come_after_the_summary(spark, tmp_path):
    def artifacts(df):
        bad = F.when(F.col("score") == 103, "not made").alias("error")
        return df.filter("score <> 102").select("request_id", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("name"), bad)

    plain = service(spark, str(tmp_path))
    answering = answering_with(spark, str(tmp_path), plain.score, artifacts)
    served_batch(spark, asked(spark, ["1", "2", "3"]), answering)
    assert summary(spark, str(tmp_path)) == {0: 101, 1: 102, 2: 103}
    assert summary(spark, str(tmp_path), ARTIFACTS_CHANNEL) == {0: 101, 1: "E162", 2: "E162"}
    assert rows(streaming.read_artifacts(spark, str(tmp_path)).filter("error IS NULL"), "request_id", "name") == [(0, "x"), (0, "y")]
    assert all(name.endswith(".gz.parquet") for _, _, names in os.walk(tmp_path / "artifacts") for name in names if name.endswith(".parquet"))
    assert rows(streaming.progress(spark.range(4).toDF("request_id"), str(tmp_path))) == [(0, "artifacts"), (1, "artifacts"), (2, "artifacts"), (3, "init")]


def test_an_artifact_that_raises_fails_alone(spark, tmp_path):
    def artifacts(df):
        return df.select("request_id", F.when(F.col("score") == 102, F.raise_error(F.lit("no"))).otherwise(F.col("score")).cast("bigint").alias("size"))

    answering = answering_with(spark, str(tmp_path), service(spark, "").score, artifacts)
    served_batch(spark, asked(spark, ["1", "2", "3"]), answering)
    assert summary(spark, str(tmp_path), ARTIFACTS_CHANNEL) == {0: 101, 1: "E162", 2: 103}


def test_a_stopped_batch_goes_on_where_it_was(spark, tmp_path):
    broken, scored = tmp_path / "broken", []
    broken.touch()

    def artifacts(df):
        if os.path.exists(broken):
            raise RuntimeError("the store is gone")
        return df.select("request_id")

    def score(df):
        scored.append(1)
        return service(spark, "").score(df).withColumn("score", F.col("score") + F.floor(F.rand() * 1000))

    root = str(tmp_path / "out")
    answering = answering_with(spark, root, score, artifacts)
    with pytest.raises(RuntimeError):
        served_batch(spark, asked(spark, ["1", "2"]), answering)
    sent = summary(spark, root)
    assert len(sent) == 2 and not os.path.exists(f"{root}/{ARTIFACTS_CHANNEL}")
    broken.unlink()
    served_batch(spark, asked(spark, ["1", "2"]), answering)
    # The summary that was sent stays, and the second message repeats it.
    assert summary(spark, root) == sent == summary(spark, root, ARTIFACTS_CHANNEL)
    served_batch(spark, asked(spark, ["1", "2"]), answering)
    assert summary(spark, root) == sent


def test_a_batch_costs_the_same_after_many(spark, tmp_path):
    """SERVED_BATCHES=200 runs it for longer."""
    count = int(os.environ.get("SERVED_BATCHES", "24"))
    source, root = f"{tmp_path}/in", str(tmp_path)
    for n in range(count):
        land(source, f"{n:04}", [request(n, payload("s", {"a": str(n)} if n % 2 == 0 else {})), request(0, payload("s", {"a": "1000"}))])
        os.utime(f"{source}/{n:04}.json", (n + 10**9, n + 10**9))
    seconds, listed = [], []
    inner = serving.serve_batch

    def timed(batch, batch_id, answering, plans):
        begin = time.monotonic()
        inner(batch, batch_id, answering, plans)
        seconds.append(time.monotonic() - begin)
        listed.append(sum(len(names) for folder, _, names in os.walk(f"{root}/out") if f"batch_id={batch_id}" in folder or "batch_id" not in folder))

    stream = streaming.request_stream(spark, source, max_files=1)
    answering = service(spark, f"{root}/out")
    serving.serve_batch = timed
    try:
        streaming.drain(streaming.serve(stream, answering, f"{root}/checkpoint"))
    finally:
        serving.serve_batch = inner
    assert len(seconds) == count
    # Request 0 came with every file and was answered once; each plan's last value holds.
    assert summary(spark, f"{root}/out") == {n: 100 + n - n % 2 for n in range(count)}
    print(f"{count} batches: median seconds {statistics.median(seconds[2 : count // 2]):.2f}, {statistics.median(seconds[count // 2 :]):.2f}")
    assert statistics.median(seconds[count // 2 :]) < 2 * statistics.median(seconds[2 : count // 2])
    assert max(listed[2:]) <= 1.5 * min(listed[2:])
    assert os.listdir(f"{root}/out/work") == []
