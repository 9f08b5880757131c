"""Keyed state: restarts, late rows, ties, and the agent's loop against a plain one."""

import datetime
import json
import os
from collections import defaultdict

from pyspark.sql import functions as F

from pageguard.operators import agent
from pageguard.plans import sessions as plans
from pageguard.streaming import agents, sessions

SF = "/root/testdata/sf0.001"
STEPS = "user_id long, ts long, event_id long, state string"


def add(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_checks_go_on_after_a_restart(spark, tmp_path):
    steps = [(1, "TASK_RECEIVED"), (1, "PAGE_ANALYSIS"), (2, "EXECUTING"), (2, "ERROR"), (1, "DOM_EXTRACTED"), (2, "IDLE"), (1, "IDLE"), (3, "TASK_RECEIVED")]
    rows = [(u, n, n, s) for n, (u, s) in enumerate(steps)]
    source, at = f"{tmp_path}/steps", f"{tmp_path}/run"
    heard = []
    tell = lambda df: heard.extend((r["event_id"], r["previous"]) for r in df.collect())
    for part in (rows[:4], rows[4:6], rows[6:]):
        add(spark, source, part, STEPS)
        # Nothing but the folder is known to this run: neither the query nor any list of batches lives on.
        out = sessions.run_checks(spark.readStream.schema(STEPS).parquet(source), (tell,), at)
    assert sorted(map(tuple, out.collect())) == [(1, "IDLE", 1, 4), (2, "IDLE", 1, 3), (3, "TASK_RECEIVED", 0, 1)]
    assert sorted(heard) == [(0, "IDLE"), (1, "TASK_RECEIVED"), (3, "EXECUTING"), (4, "PAGE_ANALYSIS"), (5, "ERROR"), (7, "IDLE")]
    # A micro-batch writes the tasks that it has seen, not all of them.
    by_batch = {r["batch"]: r["n"] for r in spark.read.parquet(f"{at}/states").groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert by_batch == {0: 2, 1: 2, 2: 2}
    assert any("rocksdb" in name.lower() or name.endswith(".zip") for _, _, names in os.walk(f"{at}/checkpoint/state") for name in names)


def test_state_goes_some_time_after_the_last_step(spark, tmp_path):
    schema = "user_id long, ts timestamp, event_id long, state string"
    t0 = datetime.datetime(2024, 1, 1)
    late = lambda minutes: t0 + datetime.timedelta(minutes=minutes)
    source, at = f"{tmp_path}/steps", f"{tmp_path}/run"
    parts = [[(1, late(0), 1, "TASK_RECEIVED"), (2, late(0), 2, "TASK_RECEIVED")], [(2, late(50), 3, "PAGE_ANALYSIS")], [(3, late(90), 4, "ERROR")], [(1, late(95), 5, "PAGE_ANALYSIS"), (2, late(95), 6, "DOM_EXTRACTED")]]
    for part in parts:
        add(spark, source, part, schema)
        stream = spark.readStream.schema(schema).parquet(source).withWatermark("ts", "1 minute")
        out = sessions.run_checks(stream, (), at, kept_ms=60 * 60_000)
    got = {r["user_id"]: (r["state"], r["n_invalid"], r["n_steps"]) for r in out.collect()}
    assert got == {1: ("PAGE_ANALYSIS", 1, 1), 2: ("DOM_EXTRACTED", 0, 3), 3: ("ERROR", 0, 1)}


def test_latest_of_late_rows_and_ties(spark, tmp_path):
    schema = "user_id long, ts long, event_id long, value string"
    source, at = f"{tmp_path}/rows", f"{tmp_path}/run"
    parts = [[(1, 5, 1, "a"), (2, 5, 2, "b"), (1, 4, 9, "early")], [(1, 3, 10, "late"), (2, 5, 3, "tie"), (3, None, 1, "no time")], [(2, 5, 1, "lower id"), (1, 6, 0, "new"), (1, 6, 0, "new2")], [(4, 1, 1, "x")]]
    for part in parts:
        add(spark, source, part, schema)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        out = agents.latest_stream(stream, "user_id", ["ts", "event_id"], ["ts", "event_id", "value"], at)
    assert sorted((r["user_id"], r["value"]) for r in out.collect()) == [(1, "new2"), (2, "tie"), (3, "no time"), (4, "x")]


def plain_loop(events, decide, most):
    """The loop as one would write it for a single run at a time: a list of rows, driven by an iterator of events."""
    out = []
    todo = list(events)

    def told(event, step, status, action=None, element=None, value=None, reason=None):
        out.append((*event[:2], step, status, action, element, value, reason))

    def wait(kinds, step, status):
        """The next event of one of these kinds; others are out of turn, a reset ends the run."""
        while todo:
            event = todo.pop(0)
            if event[2] == "reset":
                told(event, 0, "IDLE")
                return None
            if event[2] in kinds:
                return event
            told(event, step, status, reason="out of turn")
        return None

    step, status = 0, "IDLE"
    while todo:
        event = wait(["start"], step, status)
        if event is None:
            step, status = 0, "IDLE"
            continue
        task, history, step, status = event[3], [], 0, "PAGE_ANALYSIS"
        told(event, 0, status)
        while status == "PAGE_ANALYSIS":
            event = wait(["snapshot", "failed"], step, status)
            if event is None:
                step, status = 0, "IDLE"
                break
            if event[2] == "failed":
                status = "ERROR"
                told(event, step, status, reason=event[3])
                break
            step += 1
            elements = json.loads(event[3])["elements"]
            d = decide({"task": task, "elements": elements, "viewport": None, "history": history})
            act, element = d["action"], d.get("elementId")
            if act == "done":
                status = "COMPLETED"
                told(event, step, status, act)
                break
            if act == "ask_user" and not d["fields"]:
                status = "ERROR"
                told(event, step, status, reason="ask_user with no fields")
                break
            if act == "ask_user":
                keys = [f["key"] for f in d["fields"]]
                told(event, step, "WAITING_FOR_USER", act, value=",".join(keys))
                event = wait(["answer"], step, "WAITING_FOR_USER")
                entry = {"action": act, "fields": keys}
            else:
                entry = {"action": act, "elementId": element, "value": "[REDACTED]" if act == "type" else d.get("value")}
                if act != "scroll" and element not in [e["id"] for e in elements]:
                    history.append({**entry, "result": {"success": False, "reason": "unknown element"}})
                    status = "PAGE_ANALYSIS" if step < most else "STEP_CAP"
                    told(event, step, status, act, element, reason="unknown element")
                    continue
                told(event, step, "EXECUTING", act, element, d.get("value"))
                event = wait(["result"], step, "EXECUTING")
            if event is None:
                step, status = 0, "IDLE"
                break
            status = "PAGE_ANALYSIS" if step < most else "STEP_CAP"
            reason = None
            if event[2] == "result":
                entry["result"] = json.loads(event[3])
                reason = None if entry["result"]["success"] else entry["result"]["reason"]
            history.append(entry)
            told(event, step, status, reason=reason)
    return out


def by_hand(rows, decide, most):
    runs = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["ts"], r["seq"])):
        runs[r["task"]].append((r["ts"], r["seq"], r["kind"], r["body"]))
    return sorted((task, *row) for task, events in runs.items() for row in plain_loop(events, decide, most))


def shown(rows, key):
    return sorted((r[key], r["ts"], r["seq"], r["step"], r["status"], r["action"], r["element_id"], r["value"], r["reason"]) for r in rows)


def test_loops_of_recorded_runs(spark):
    want = by_hand(plans.recorded_runs(spark, SF).collect(), plans.rule_backend, agent.MOST_STEPS)
    got = plans.agent_loop(spark, SF).collect()
    assert shown(got, "user_id") == want
    assert {"COMPLETED", "ERROR", "EXECUTING", "WAITING_FOR_USER", "PAGE_ANALYSIS", "IDLE"} <= {w[4] for w in want}
    assert {"unknown element", "ask_user with no fields", "element_not_visible", "out of turn", "no tab"} <= {w[8] for w in want}
    assert all("Typing into" in r["message"] for r in got if r["action"] == "type" and r["status"] == "EXECUTING")


def test_loops_of_a_table_keep_no_state(spark):
    """A state store's calls for each task took most of the time; tasks go through in order, also over the edges of batches."""
    runs = plans.recorded_runs(spark, SF).where("task < 40").withColumn("task", F.expr("nullif(task, 7)"))
    out = agents.agent_loops(runs, plans.rule_backend)
    assert "TransformWithState" not in out._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = out.withColumn("task", F.coalesce("task", F.lit(7))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert shown(got, "task") == by_hand(runs.fillna(7, ["task"]).collect(), plans.rule_backend, agent.MOST_STEPS)
    assert out.columns == ["task", "ts", "seq", "step", "status", "action", "element_id", "value", "message", "reason"]


def test_loops_as_a_stream_that_is_started_again(spark, tmp_path):
    source, at = f"{tmp_path}/events", f"{tmp_path}/run"
    rows = plans.recorded_runs(spark, SF).where("task % 3 = 0").orderBy("ts", "seq").collect()
    schema = plans.recorded_runs(spark, SF).schema
    third = len(rows) // 3
    for part in (rows[:third], rows[third : 2 * third], rows[2 * third :]):
        add(spark, source, part, schema)
        stream = spark.readStream.schema(schema).parquet(source).withWatermark("ts", "10 minutes")
        out = sessions.looped_stream(stream, plans.rule_backend, at)
    assert shown(out.collect(), "task") == by_hand(rows, plans.rule_backend, agent.MOST_STEPS)


def test_the_loop_stops_after_its_steps_and_keeps_no_typed_text():
    asked = []

    def typing(request):
        asked.append(json.dumps(request))
        return {"action": "type", "elementId": 1, "value": "s3cret"}

    loop, rows = agent.advance(agent.Loop(), "start", "log in", typing)
    page = json.dumps({"elements": [{"id": 1, "type": "input:text", "placeholder": "Name"}]})
    for _ in range(agent.MOST_STEPS):
        loop, rows = agent.advance(loop, "snapshot", page, typing)
        assert rows[0]["value"] == "s3cret" and rows[0]["message"] == 'Typing into "Name"…'
        loop, rows = agent.advance(loop, "result", '{"success": true}', typing)
    assert loop.status == "STEP_CAP" == rows[0]["status"] and len(asked) == agent.MOST_STEPS == len(loop.history)
    assert "s3cret" not in "".join(asked) and "s3cret" not in str(loop)
    assert agent.advance(loop, "snapshot", page, typing)[1][0]["reason"] == "out of turn"
    assert agent.advance(loop, "start", "again", typing)[0] == agent.Loop("PAGE_ANALYSIS", "again")

    def broken(request):
        raise OSError("offline")

    ready = agent.Loop("PAGE_ANALYSIS", "t")
    assert agent.advance(ready, "snapshot", page, broken)[1][0]["reason"] == "backend: offline"
    assert agent.advance(ready, "snapshot", page, lambda r: {"action": "eval"})[0].status == "ERROR"
    assert agent.advance(ready, "snapshot", "no json", typing)[1][0]["reason"] == "snapshot is no JSON object"
    assert agent.advance(ready, "failed", None, typing)[0].status == "ERROR"
