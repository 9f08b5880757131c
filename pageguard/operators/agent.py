"""Recorded agent sessions: state machine, actions, reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageguard.functions.patterns import LOG_KEYS, REDACTED

MOST_STEPS = 15
SCROLL_BY = 400
#: What a backend may ask for; all but the last need an element of the page.
ACTIONS = ["click", "type", "select", "scroll"]

# The states that may follow each state. ERROR may follow any.
NEXT_STATES = {
    "IDLE": ["TASK_RECEIVED"],
    "TASK_RECEIVED": ["PAGE_ANALYSIS"],
    "PAGE_ANALYSIS": ["DOM_EXTRACTED"],
    "DOM_EXTRACTED": ["PII_DETECTED"],
    "PII_DETECTED": ["SCREENSHOT_CAPTURED"],
    "SCREENSHOT_CAPTURED": ["SCREENSHOT_REDACTED"],
    "SCREENSHOT_REDACTED": ["READY_FOR_AGENT"],
    "READY_FOR_AGENT": ["WAITING_FOR_USER", "EXECUTING", "COMPLETED"],
    "WAITING_FOR_USER": ["READY_FOR_AGENT", "PAGE_ANALYSIS"],
    "EXECUTING": ["READY_FOR_AGENT", "COMPLETED", "WAITING_FOR_USER", "PAGE_ANALYSIS"],
    "COMPLETED": ["IDLE"],
    "ERROR": ["IDLE"],
}
STATES = list(NEXT_STATES)
# What a controller's verbs lead to.
VERB_STATES = {
    "startTask": "TASK_RECEIVED",
    "beginPageAnalysis": "PAGE_ANALYSIS",
    "onDomExtracted": "DOM_EXTRACTED",
    "onPiiDetected": "PII_DETECTED",
    "onScreenshotCaptured": "SCREENSHOT_CAPTURED",
    "onScreenshotRedacted": "SCREENSHOT_REDACTED",
    "evaluateReadiness": "READY_FOR_AGENT",
    "submitUserInfo": "READY_FOR_AGENT",
    "markExecuting": "EXECUTING",
    "markWaitingForUser": "WAITING_FOR_USER",
    "markCompleted": "COMPLETED",
    "markError": "ERROR",
    "reset": "IDLE",
}


def allowed(previous: Column, state: Column, resume_fix: bool = False) -> Column:
    """Whether state may follow previous; resume_fix also lets a session go on after a user's answer."""
    ok = state == "ERROR"
    for before, after in NEXT_STATES.items():
        more = ["PAGE_ANALYSIS"] if resume_fix and before == "READY_FOR_AGENT" else []
        ok = ok | ((previous == before) & state.isin(after + more))
    return F.coalesce(ok, F.lit(False))


def validate_states(steps: DataFrame, task: str, order: list[str], state: str = "state", resume_fix: bool = False) -> DataFrame:
    """steps with previous (IDLE at first) and valid: whether each recorded state may follow the one before it."""
    w = Window.partitionBy(task).orderBy(*order)
    out = steps.withColumn("previous", F.coalesce(F.lag(state).over(w), F.lit("IDLE")))
    return out.withColumn("valid", allowed(F.col("previous"), F.col(state), resume_fix))


def run_status(steps: DataFrame, task: str, order: list[str], most: int = MOST_STEPS) -> DataFrame:
    """task, steps taken, actions and final status: done, ask_user left open, error, or STEP_CAP after `most` steps."""
    w = Window.partitionBy(task).orderBy(*order)
    taken = steps.withColumn("step", F.row_number().over(w)).where(F.col("step") <= most + 1)
    ended = F.min(F.when(F.col("action").isin("done", "error"), F.col("step"))).over(Window.partitionBy(task))
    taken = taken.withColumn("ended", ended).where(F.col("step") <= F.coalesce("ended", F.lit(most + 1)))
    last = F.max_by("action", "step")
    runs = taken.groupBy(task).agg(F.least(F.max("step"), F.lit(most)).cast("long").alias("n_steps"), F.sum(F.when(F.col("step") <= most, F.col("action").isin("click", "type", "scroll").cast("long")).otherwise(0)).alias("n_actions"), last.alias("last"), F.max("step").alias("m"))
    status = F.when((F.col("m") <= most) & (F.col("last") == "done"), "COMPLETED").when((F.col("m") <= most) & (F.col("last") == "error"), "ERROR").when(F.col("m") > most, "STEP_CAP").when(F.col("last") == "ask_user", "WAITING_FOR_USER").otherwise("OPEN")
    return runs.select(task, "n_steps", "n_actions", status.alias("status"))


def element_label(text: Column, placeholder: Column, aria: Column, kind: Column, element_id: Column) -> Column:
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(blank(text), blank(placeholder), blank(aria), F.concat(kind, F.lit(" #"), element_id.cast("string")), F.concat(F.lit("element #"), element_id.cast("string")))


def describe(action: Column, label: Column, value: Column) -> Column:
    return (
        F.when(action == "click", F.concat(F.lit('Clicking "'), label, F.lit('"…')))
        .when(action == "type", F.concat(F.lit('Typing into "'), label, F.lit('"…')))
        .when(action == "scroll", F.concat(F.lit("Scrolling "), F.coalesce(F.nullif(value, F.lit("")), F.lit("down")), F.lit("…")))
        .otherwise(F.concat(F.lit("Performing "), action, F.lit("…")))
    )


def history_value(action: Column, value: Column) -> Column:
    """Typed text is never kept."""
    return F.when(action == "type", F.lit(REDACTED)).otherwise(value)


def action_outcome(action: Column, tag: Column, visible: Column) -> Column:
    """Null for an action that can run on the element (tag null: none), else the reason why not."""
    return (
        F.when(action == "scroll", F.lit(None))
        .when((action == "select") & (tag.isNull() | (tag != "select")), "element_not_found_or_not_select")
        .when(action == "select", F.lit(None))
        .when(tag.isNull(), "element_not_found")
        .when(~visible, "element_not_visible")
        .when((action == "type") & ~tag.isin("input", "textarea"), "element_not_typeable")
    )


Backend = Callable[[pd.DataFrame], pd.DataFrame]
DECISION = "action string, element_id long, value string"


def decisions(payloads: DataFrame, elements: DataFrame, task: str, backend: Backend | None = None) -> DataFrame:
    """What a backend decides for each task: action, element_id, value, and reason (null: may be carried out).

    backend maps frames of (task, payload), payloads being redacted ones, to frames of (task, action, element_id, value);
    it is called once for each Arrow batch. Without one every task has the reason "no backend". Actions outside ACTIONS
    and elements that the task's page does not have are refused, as are answers for tasks that were not asked about and
    tasks that a backend leaves out or answers twice. Works on batches and on streams of payloads.
    """
    asked = payloads.select(F.col(task).alias("task"), "payload")
    kind = asked.schema["task"].dataType.simpleString()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["action", "element_id", "value"]
        for batch in batches:
            if backend is None:
                yield batch[["task"]].assign(action=None, element_id=None, value=None, n=-1)
                continue
            made = backend(batch).reindex(columns=["task", *names])
            n = made.groupby("task").size()
            first = made.drop_duplicates("task").set_index("task")
            out = batch[["task"]].join(first, on="task")
            yield out.assign(element_id=out["element_id"].astype("Int64"), n=out["task"].map(n).fillna(0).astype(int))

    got = asked.mapInPandas(ask, f"task {kind}, {DECISION}, n int")
    known = elements.select(F.col(task).alias("task"), "element_id").distinct().withColumn("known", F.lit(True))
    no_element = F.col("known").isNull() & ((F.col("action") != "scroll") | F.col("element_id").isNotNull())
    reason = (
        F.when(F.col("n") < 0, "no backend").when(F.col("n") == 0, "no decision").when(F.col("n") > 1, "several decisions")
        .when(~F.coalesce(F.col("action").isin(ACTIONS), F.lit(False)), "unknown action").when(no_element, "unknown element")
    )
    out = got.join(known, ["task", "element_id"], "left")
    return out.select(F.col("task").alias(task), "action", "element_id", "value", reason.alias("reason"))


@dataclass(frozen=True)
class Loop:
    """Where a task's loop stands: status, the task's text, steps taken, what was done so far, and the action under way."""

    status: str = "IDLE"
    task: str = ""
    step: int = 0
    history: list[dict] = field(default_factory=list)
    pending: dict | None = None


#: What a loop can take in each status; a reset is taken in all.
TAKES = {"IDLE": ["start"], "COMPLETED": ["start"], "ERROR": ["start"], "STEP_CAP": ["start"], "PAGE_ANALYSIS": ["snapshot", "failed"], "EXECUTING": ["result"], "WAITING_FOR_USER": ["answer"]}


def _label(elements: list[dict], element_id: object) -> str:
    e = next((e for e in elements if e.get("id") == element_id), None)
    return f"element #{element_id}" if e is None else e.get("text") or e.get("placeholder") or e.get("ariaLabel") or f"{e.get('type')} #{element_id}"


def _next_step(loop: Loop, done: dict, most: int) -> Loop:
    """loop with what was done in its history, ready for the next snapshot, or stopped after `most` steps."""
    status = "PAGE_ANALYSIS" if loop.step < most else "STEP_CAP"
    return replace(loop, status=status, history=[*loop.history, done], pending=None)


def advance(loop: Loop, kind: str, body: str | None, decide: Callable[[dict], dict], most: int = MOST_STEPS) -> tuple[Loop, list[dict]]:
    """The loop after an event, and the rows that tell of it.

    start takes a task; a snapshot (JSON with elements and viewport, redacted) asks the backend what to do, which counts as
    a step; result tells how an action went, answer what the user has filled in; failed ends a task whose page could not be
    analysed, and reset forgets it. Typed text is in the row that asks for it to be typed, never in the history that goes
    back to the backend, and answers are there by key only. Events out of turn change nothing.
    """

    def row(loop: Loop, reason: str | None = None, action: str | None = None, element_id: object = None, value: str | None = None, message: str | None = None) -> dict:
        return {"step": loop.step, "status": loop.status, "action": action, "element_id": element_id, "value": value, "message": message, "reason": reason}

    def failed(reason: str, loop: Loop = loop) -> tuple[Loop, list[dict]]:
        end = replace(loop, status="ERROR", pending=None)
        return end, [row(end, reason)]

    if kind == "reset":
        return Loop(), [row(Loop())]
    if kind not in TAKES[loop.status]:
        return loop, [row(loop, "out of turn")]
    if kind == "start":
        new = Loop("PAGE_ANALYSIS", body or "")
        return new, [row(new)]
    if kind == "failed":
        return failed(body or "page analysis failed")
    try:
        given = json.loads(body or "{}")
    except ValueError:
        given = None
    if not isinstance(given, dict):
        return failed(f"{kind} is no JSON object")
    if kind == "result":
        new = _next_step(loop, {**(loop.pending or {}), "result": given}, most)
        return new, [row(new, None if given.get("success") else str(given.get("reason") or "no response"))]
    if kind == "answer":
        new = _next_step(loop, loop.pending or {}, most)
        return new, [row(new)]
    elements = given.get("elements") or []
    asked = replace(loop, step=loop.step + 1)
    try:
        decision = decide({"task": loop.task, "elements": elements, "viewport": given.get("viewport"), "history": loop.history})
        action, element_id, value = decision["action"], decision.get("elementId"), decision.get("value")
    except Exception as e:  # a backend that fails ends the task, not the stream
        return failed(f"backend: {e}"[:200], asked)
    if action == "done":
        new = replace(asked, status="COMPLETED")
        return new, [row(new, action=action)]
    if action == "ask_user":
        keys = [f["key"] for f in decision.get("fields") or [] if isinstance(f, dict) and f.get("key")]
        if not keys:
            return failed("ask_user with no fields", asked)
        new = replace(asked, status="WAITING_FOR_USER", pending={"action": action, "fields": keys})
        return new, [row(new, action=action, value=",".join(keys))]
    if action not in ACTIONS:
        return failed(f"unknown action {action}", asked)
    done = {"action": action, "elementId": element_id, "value": REDACTED if action == "type" else value}
    if action != "scroll" and not any(e.get("id") == element_id for e in elements):
        new = _next_step(asked, {**done, "result": {"success": False, "reason": "unknown element"}}, most)
        return new, [row(new, "unknown element", action, element_id)]
    label = _label(elements, element_id)
    message = {"click": f'Clicking "{label}"…', "type": f'Typing into "{label}"…', "scroll": f"Scrolling {value or 'down'}…"}.get(action, f"Performing {action}…")
    new = replace(asked, status="EXECUTING", pending=done)
    return new, [row(new, None, action, element_id, value, message)]


def scroll_delta(direction: Column, amount: int = SCROLL_BY) -> Column:
    return F.when(direction == "up", -amount).when(direction == "down", amount).otherwise(0)


HIDDEN = "[omitted-by-logger]"


def scrub(obj: object) -> object:
    """obj with the values of sensitive keys replaced, at any depth."""
    if isinstance(obj, dict):
        return {k: HIDDEN if k in LOG_KEYS else scrub(v) for k, v in obj.items()}
    return [scrub(x) for x in obj] if isinstance(obj, list) else obj


@F.pandas_udf(T.StringType())
def scrub_json(objects: pd.Series) -> pd.Series:
    """JSON texts with the values of sensitive keys replaced, at any depth; what is no JSON is hidden as a whole."""

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(scrub(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return HIDDEN

    return objects.map(clean)


def verb_state(verb: Column) -> Column:
    """The state that a controller's verb leads to; null for an unknown verb."""
    return F.create_map(*[F.lit(x) for pair in VERB_STATES.items() for x in pair])[verb]


def form_input(field: Column) -> Column:
    """What a requested field (key, label, type) becomes in a form: text unless typed, required, never auto-filled."""
    kind = F.coalesce(F.nullif(field["type"], F.lit("")), F.lit("text"))
    return F.struct(field["key"].alias("name"), field["label"].alias("label"), kind.alias("type"), F.lit(True).alias("required"), F.lit("off").alias("autocomplete"))


def submitted(inputs: Column, values: Column) -> Column:
    """Answers by key, in the order of the form's inputs."""
    return F.map_from_entries(F.zip_with(inputs, values, lambda i, v: F.struct(i["name"], v)))


def merge_answers(answers: DataFrame, task: str, order: str, key: str, value: str, wipes: DataFrame | None = None) -> DataFrame:
    """task and info: a map of the last answer to each key. wipes: task and order of completions and resets, which answers before do not outlive."""
    if wipes is not None:
        answers = answers.join(wipes.groupBy(task).agg(F.max(order).alias("_wiped")), task, "left").where(F.col("_wiped").isNull() | (F.col(order) > F.col("_wiped"))).drop("_wiped")
    last = answers.groupBy(task, key).agg(F.max_by(value, order).alias("v"))
    return last.groupBy(task).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "v")))).alias("info"))
