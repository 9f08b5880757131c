"""Agent sessions as keyed state: state checks, and the loop of a backend's decisions.

State lives in RocksDB beside the checkpoint, one value a task, and goes some time after a task's last event. A run that is
given the folder of an earlier one goes on from there.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pageguard.operators.agent import MOST_STEPS, NEXT_STATES, Loop, advance
from pageguard.sources.tables import run_folder

#: Milliseconds of event time after a task's last event at which its state goes.
KEPT_MS = 7 * 24 * 3600 * 1000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PAIRS = {f"{a}>{b}" for a, after in NEXT_STATES.items() for b in after}


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def timed(df: DataFrame, column: str) -> bool:
    """Whether event time, and so the end of a state's life, can follow from the column."""
    return isinstance(df.schema[column].dataType, T.TimestampType)


class _Expiring(StatefulProcessor):
    """One value a key, cleared kept_ms after the last event (None: kept for ever)."""

    schema = ""

    def __init__(self, kept_ms: int | None):
        self.kept_ms = kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def keep(self, value: tuple, last: Any) -> None:
        self.state.update(value)
        if self.kept_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(int(pd.Timestamp(last).value // 1_000_000) + self.kept_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


class _Checks(_Expiring):
    """Steps of a task in order of time within a micro-batch, each against the one before it."""

    schema = "state string, n_invalid long, n_steps long"

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state, bad, n = self.state.get() if self.state.exists() else ("IDLE", 0, 0)
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable").reset_index(drop=True)
        new["previous"] = new["state"].shift(1, fill_value=state)
        pair = new["previous"].fillna("") + ">" + new["state"].fillna("")
        new["valid"] = (new["state"] == "ERROR") | pair.isin(_PAIRS)
        new["n_invalid"], new["n_steps"] = bad + (~new["valid"]).cumsum(), n + new.index + 1
        new["last"] = new.index == len(new) - 1
        end = new.iloc[-1]
        # A task that ends a micro-batch completed starts anew.
        over = end["state"] == "COMPLETED"
        self.keep(("IDLE", 0, 0) if over else (end["state"], int(end["n_invalid"]), int(end["n_steps"])), end["ts"])
        yield new[["user_id", "ts", "event_id", "previous", "state", "valid", "n_invalid", "n_steps", "last"]]


Listener = Callable[[DataFrame], None]


def _newest(spark: SparkSession, folder: str, schema: str, key: str, what: list[str]) -> DataFrame:
    """Of rows that each micro-batch has written into a folder of its own, the newest of each key."""
    rows = spark.read.schema(f"{schema}, batch int").parquet(folder)
    return rows.groupBy(key).agg(F.max_by(F.struct(*what), "batch").alias("n")).select(key, "n.*")


def _empty(spark: SparkSession, folder: str, schema: str) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/batch=-1")


def run_checks(steps: DataFrame, listeners: tuple[Listener, ...] = (), at: str | None = None, kept_ms: int = KEPT_MS) -> DataFrame:
    """The last state and counts of every task of a stream of steps: user_id, state, n_invalid, n_steps.

    A micro-batch touches the states of its own tasks only, and writes one row for each of them. Listeners get the valid
    changes (user_id, ts, event_id, previous, state) of each micro-batch as a DataFrame, in the order in which they are
    given; invalid ones are counted only. A batch that is run again writes its folder again, and reaches listeners again.
    at: the folder of checkpoint and results; with that of an earlier run, this one goes on where it ended.
    Where ts is a timestamp (behind a watermark), a task's state goes kept_ms after its last step.
    """
    spark = steps.sparkSession
    at = at or run_folder(spark)
    kind = {f.name: f.dataType.simpleString() for f in steps.schema}
    by_time = timed(steps, "ts")
    made = f"user_id {kind['user_id']}, ts {kind['ts']}, event_id {kind['event_id']}, previous string, state string, valid boolean, n_invalid long, n_steps long, last boolean"
    kept, what = f"user_id {kind['user_id']}, state string, n_invalid long, n_steps long", ["state", "n_invalid", "n_steps"]

    def write(batch: DataFrame, n: int) -> None:
        batch = batch.persist() if listeners else batch
        batch.where("last").select("user_id", *what).write.mode("overwrite").parquet(f"{at}/states/batch={n}")
        changed = batch.where("valid").select("user_id", "ts", "event_id", "previous", "state")
        for tell in listeners:
            tell(changed)
        if listeners:
            batch.unpersist()

    _empty(spark, f"{at}/states", kept)
    with rocksdb(spark):
        checked = steps.groupBy("user_id").transformWithStateInPandas(_Checks(kept_ms if by_time else None), made, "Append", "EventTime" if by_time else "None")
        query = checked.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return _newest(spark, f"{at}/states", kept, "user_id", what)


def latest_stream(events: DataFrame, key: str, order: list[str], what: list[str], at: str | None = None) -> DataFrame:
    """The row of each key that is last by `order`, kept up to date by a stream; at: as in run_checks.

    Spark keeps one row a key as state. Rows may come late and out of turn: a micro-batch changes a key only by a row
    that lies after the one it has (equal ones: the greater by all columns of `what`).
    """
    spark = events.sparkSession
    at = at or run_folder(spark)
    last = events.groupBy(key).agg(F.max(F.struct(*order, *[c for c in what if c not in order])).alias("last")).select(key, "last.*").select(key, *what)
    schema = last.schema.simpleString().removeprefix("struct<").removesuffix(">")
    _empty(spark, f"{at}/latest", last.schema)
    with rocksdb(spark):
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/latest/batch={n}")
        query = last.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return _newest(spark, f"{at}/latest", schema.replace(":", " "), key, what)


Decide = Callable[[dict], dict]
LOOP_ROWS = "step int, status string, action string, element_id long, value string, message string, reason string"
_TOLD = [c.split()[0] for c in LOOP_ROWS.split(", ")]


class _Loops(_Expiring):
    """Events of a task in order, each moving the loop on by operators.agent.advance."""

    schema = "loop string"

    def __init__(self, kept_ms: int | None, decide: Decide, most: int, at: str):
        super().__init__(kept_ms)
        self.decide, self.most, self.at = decide, most, at

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        loop = Loop(**json.loads(self.state.get()[0])) if self.state.exists() else Loop()
        new = pd.concat(list(rows)).sort_values([self.at, "seq"], kind="stable")
        out = []
        for event in new.itertuples(index=False):
            loop, told = advance(loop, event.kind, event.body, self.decide, self.most)
            out += [{"task": key[0], self.at: getattr(event, self.at), "seq": event.seq, **row} for row in told]
        self.keep((json.dumps(asdict(loop)),), new[self.at].iloc[-1])
        if out:
            yield pd.DataFrame(out)[["task", self.at, "seq", "step", "status", "action", "element_id", "value", "message", "reason"]].astype({"element_id": "Int64"})


def _table_loops(events: DataFrame, decide: Decide, at: str, most: int, made: str) -> DataFrame:
    """A table holds whole runs, so no state outlives a partition: tasks are dealt to tasks of Spark and lie in order there."""
    whole = events.select("task", at, "seq", "kind", "body").repartition("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, loop = None, Loop()
        for batch in batches:
            places, told = [], []
            for i, (own, kind, body) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("task", "kind", "body")))):
                if own != task:
                    task, loop = own, Loop()
                loop, rows = advance(loop, kind, body, decide, most)
                places += [i] * len(rows)
                told += rows
            key = [batch.column(c).take(pa.array(places, pa.int64())) for c in ("task", at, "seq")]
            number = pa.array(pd.Series([r["element_id"] for r in told], dtype=object).astype("Int64"), pa.int64())
            cols = {n: number if n == "element_id" else pa.array([r[n] for r in told], pa.int32() if n == "step" else pa.string()) for n in _TOLD}
            yield pa.RecordBatch.from_arrays([*key, *cols.values()], names=["task", at, "seq", *cols])

    return whole.sortWithinPartitions("task", F.asc_nulls_last(at), F.asc_nulls_last("seq")).mapInArrow(run, made)


def agent_loops(events: DataFrame, decide: Decide, at: str = "ts", most: int = MOST_STEPS, kept_ms: int = KEPT_MS) -> DataFrame:
    """What an agent's loop does at each event of a stream (or a table) of recorded runs.

    events: task, a column of time, seq, kind (start, snapshot, failed, result, answer, reset) and body. Rows out: task, time
    and seq of the event, step, status, the action to carry out (element_id, value), a message, and a reason where
    something was refused. decide is the backend: from a redacted request to a decision, called in the workers.
    On a stream, start the query within rocksdb(spark); a table's loops begin and end with it and keep no state.
    """
    kind = {f.name: f.dataType.simpleString() for f in events.schema}
    made = f"task {kind['task']}, {at} {kind[at]}, seq {kind['seq']}, {LOOP_ROWS}"
    if not events.isStreaming:
        return _table_loops(events, decide, at, most, made)
    by_time = timed(events, at)
    return events.groupBy("task").transformWithStateInPandas(_Loops(kept_ms if by_time else None, decide, most, at), made, "Append", "EventTime" if by_time else "None")
