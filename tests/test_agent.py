"""Token pieces, spans, states, scrubbing and the streams."""

import datetime
import random

from pyspark.sql import functions as F

from pageguard.functions import urls
from pageguard.operators import agent, boxes, layout, ner
from pageguard.streaming import sessions


def test_bio_merge(spark):
    rows = [("B", "NAME", 0.9), ("I", "NAME", 0.95), ("I", "NAME", 0.5), ("I", "NAME", 0.99), ("O", "O", 0.99), ("B", "EMAIL", 0.9), ("I", "CARD", 0.9)]
    df = spark.createDataFrame([(1, i, i, i, p, t, c) for i, (p, t, c) in enumerate(rows)], "d int, pos int, start int, end int, prefix string, entity_type string, confidence double")
    got = sorted((r["start"], r["end"], r["entity_type"], round(r["confidence"], 6)) for r in ner.merge_spans(df, "d").collect())
    assert got == [(0, 1, "NAME", 0.925), (3, 3, "NAME", 0.99), (5, 5, "EMAIL", 0.9), (6, 6, "CARD", 0.9)]


def test_softmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0],), ([3.0, 3.0],)], "x array<double>")
    got = df.select(ner.best_label(F.col("x")), ner.best_share(F.col("x"))).collect()
    assert got[0][0] == 1 and abs(got[0][1] - 0.66524) < 1e-5 and got[1][0] == 0


def test_word_pieces():
    vocab = {w: i for i, w in enumerate(["un", "##aff", "##able", "a"])}
    assert ner.word_pieces("unaffable", vocab) == ["un", "##aff", "##able"]
    assert ner.word_pieces("unx", vocab) == ["[UNK]"] and ner.word_pieces("", vocab) == []


def test_nms(spark):
    rows = [(0, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (0, 1, 1.0, 1.0, 10.0, 10.0, 0.8), (0, 2, 50.0, 50.0, 5.0, 5.0, 0.7)]
    df = spark.createDataFrame(rows, "g int, i int, x double, y double, width double, height double, confidence double")
    assert [r["i"] for r in boxes.suppress(df, "g").orderBy("rank").collect()] == [0, 2]
    assert [(r["a"], r["b"]) for r in boxes.overlapping_pairs(df, "g").collect()] == [(0, 1)]


def test_states(spark):
    steps = ["TASK_RECEIVED", "PAGE_ANALYSIS", "ERROR", "IDLE", "READY_FOR_AGENT", "PAGE_ANALYSIS"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(steps)], "t int, n int, state string")
    valid = lambda **k: [r["valid"] for r in agent.validate_states(df, "t", ["n"], **k).orderBy("n").collect()]
    assert valid() == [True, True, True, True, False, False] and valid(resume_fix=True)[-1]


def test_scrub():
    assert agent.scrub({"a": 1, "email": "x", "b": [{"text": "y", "c": None}]}) == {"a": 1, "email": "[omitted-by-logger]", "b": [{"text": "[omitted-by-logger]", "c": None}]}


def test_debounce(spark):
    t0 = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t0 + datetime.timedelta(milliseconds=m)) for m in (0, 399, 799)], "k int, ts timestamp")
    row = sessions.debounce(df, "k").collect()
    assert len(row) == 1 and row[0]["fires_us"] - row[0]["first_us"] == 1_199_000


def test_stream_has_the_sessions_that_the_watermark_closed(spark):
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = {tuple(r) for r in sessions.debounce(events, "user_id", "30 minutes").collect()}
    stream = {tuple(r) for r in sessions.debounced_stream(spark, sf, "30 minutes").collect()}
    last = events.agg(F.unix_micros(F.max("ts"))).first()[0]
    assert stream <= batch and all(r[2] > last - 600_000_000 for r in batch - stream)


def test_streams_read_a_folder_of_part_files(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/events.parquet").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    rows = lambda f, *more: sorted(tuple(r) for r in f(spark, *more).collect())
    for f, more in ((sessions.once_stream, ()), (sessions.checked_stream, ()), (sessions.debounced_stream, ("30 minutes",))):
        one, many = rows(f, sf, *more), rows(f, str(tmp_path), *more)
        assert many and [r[0] for r in many] == [r[0] for r in one] and (f is sessions.once_stream or many == one)


def test_checks_fold_batch_by_batch(spark, tmp_path):
    steps = [(1, "TASK_RECEIVED"), (1, "PAGE_ANALYSIS"), (2, "EXECUTING"), (1, "ERROR"), (1, "EXECUTING"), (2, "COMPLETED"), (2, "TASK_RECEIVED"), (3, "TASK_RECEIVED")]
    schema = "user_id long, ts long, event_id long, state string"
    for i, (a, b) in enumerate(((0, 2), (2, 4), (4, 6), (6, 8))):
        part = [(u, n, n, s) for n, (u, s) in enumerate(steps)][a:b]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/steps")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/steps")
    got = sorted(tuple(r) for r in sessions.run_checks(stream).collect())
    assert got == [(1, "EXECUTING", 1, 4), (2, "TASK_RECEIVED", 0, 1), (3, "TASK_RECEIVED", 0, 1)]


def test_scrubbed_json(spark):
    rows = {'{"a":[{"email":"x@y.z","n":1}],"value":{"b":2}}': '{"a":[{"email":"[omitted-by-logger]","n":1}],"value":"[omitted-by-logger]"}', "[1,\"ü\"]": "[1,\"ü\"]", "not json": agent.HIDDEN, None: None}
    df = spark.createDataFrame([(k,) for k in rows], "t string")
    assert [r[0] for r in df.select(agent.scrub_json(F.col("t"))).collect()] == list(rows.values())


def test_answers_do_not_outlive_a_completion(spark):
    answers = spark.createDataFrame([(1, 1, "name", "old"), (1, 5, "city", "new"), (2, 1, "name", "kept")], "task int, at int, k string, v string")
    wipes = spark.createDataFrame([(1, 2), (1, 3), (3, 9)], "task int, at int")
    assert {r["task"]: r["info"] for r in agent.merge_answers(answers, "task", "at", "k", "v", wipes).collect()} == {1: {"city": "new"}, 2: {"name": "kept"}}


def test_screenshot_messages(spark):
    url = "data:image/png;base64,QUJD"
    rows = [url, f'{{"dataURL": "{url}"}}', f'{{"image": "{url}", "dataUrl": null}}', '{"other": 1}', None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in df.select(urls.data_url_of(F.col("t"))).collect()] == [url, url, url, None, None]


def test_listeners_hear_valid_changes(spark, tmp_path):
    schema = "user_id long, ts long, event_id long, state string"
    for i, (user, state) in enumerate([(1, "TASK_RECEIVED"), (1, "PAGE_ANALYSIS"), (2, "EXECUTING"), (1, "ERROR")]):
        spark.createDataFrame([(user, i, i, state)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/steps")
    heard = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/steps")
    sessions.run_checks(stream, (lambda df: heard.extend((r["user_id"], r["previous"], r["state"]) for r in df.collect()),))
    assert heard == [(1, "IDLE", "TASK_RECEIVED"), (1, "TASK_RECEIVED", "PAGE_ANALYSIS"), (1, "PAGE_ANALYSIS", "ERROR")]


def _backend(frame):
    """Answers by rule: the payload is the action, task 6 is left out and task 7 answered twice."""
    out = frame[frame["task"] != 6].assign(action=frame["payload"], value=None)
    out["element_id"] = out["task"].map({1: 10, 2: 99, 3: None, 4: 10, 5: None, 7: 10})
    return out.loc[out.index.repeat((out["task"] == 7) + 1)]


def test_backend_decisions(spark, tmp_path):
    asks = [(1, "click"), (2, "click"), (3, "scroll"), (4, "eval"), (5, "type"), (6, "click"), (7, "click")]
    payloads = spark.createDataFrame(asks, "task long, payload string")
    elements = spark.createDataFrame([(t, 10) for t in range(1, 8)], "task long, element_id long")
    want = {1: None, 2: "unknown element", 3: None, 4: "unknown action", 5: "unknown element", 6: "no decision", 7: "several decisions"}
    assert {r["task"]: r["reason"] for r in agent.decisions(payloads, elements, "task", _backend).collect()} == want
    assert {r["reason"] for r in agent.decisions(payloads, elements, "task").collect()} == {"no backend"}
    payloads.write.parquet(f"{tmp_path}/asks")
    stream = spark.readStream.schema(payloads.schema).parquet(f"{tmp_path}/asks")
    assert {r["task"]: r["reason"] for r in sessions.decided_stream(stream, elements, "task", _backend).collect()} == want


def test_top_box_beyond_the_viewport(spark):
    rows = [(1, 1, 10.0, 10.0, 20.0, 20.0), (1, 2, -1e9, -1e9, 2e9, 2e9), (1, 3, 5000.0, 5000.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "page long, z long, x double, y double, width double, height double")
    assert sorted(tuple(r) for r in layout.topmost(df, "page", "z", 1280.0, 720.0).collect()) == [(1, 1, 2, False), (1, 2, 2, True), (1, 3, 2, False)]


def test_overlaps_of_boxes_of_all_sizes(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        size = 10.0 ** rng.uniform(0, 9)
        rows.append((1, i, rng.uniform(-0.2, 0.2) * size, rng.uniform(-0.2, 0.2) * size, size, size * rng.uniform(0.5, 2)))

    def overlap(a, b):
        w = max(0.0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
        h = max(0.0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
        return w * h / (a[4] * a[5] + b[4] * b[5] - w * h)

    df = spark.createDataFrame(rows, "page long, i long, x double, y double, width double, height double")
    for least in (0.3, 0.01):
        want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and overlap(a, b) >= least}
        got = [(r["a"], r["b"]) for r in boxes.overlapping_pairs(df, "page", least).collect()]
        assert len(want) > 10 and sorted(got) == sorted(want)
