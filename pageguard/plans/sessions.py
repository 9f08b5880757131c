"""Queries on recorded agent sessions, derived from events by rule, and on the event table itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageguard.operators import agent
from pageguard.sources.tables import table
from pageguard.streaming import sessions as streams

GAP = "30 minutes"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as steps through the states, some of them out of turn."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    slip = F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    n = (F.row_number().over(w) + slip) % 12
    return _events(spark, sf_dir).select("user_id", "ts", "event_id", F.element_at(F.array(*map(F.lit, agent.STATES)), (n + 1).cast("int")).alias("state"))


def fsm_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent.validate_states(_states(spark, sf_dir), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "previous", "state", "valid")


def fsm_resume_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent.validate_states(_states(spark, sf_dir), "user_id", ["ts", "event_id"], resume_fix=True).groupBy("previous", "state").agg(F.count("*").alias("n"), F.bool_and("valid").alias("valid"))


def state_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _states(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "state"))).alias("h"))
    return steps.select("user_id", F.array_join(F.transform("h", lambda x: x["state"]), ">").alias("history"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 23
    action = F.when(m == 0, "done").when(m == 1, "error").when(m < 4, "ask_user").when(m < 10, "type").when(m < 16, "click").when(m < 19, "select").otherwise("scroll")
    value = F.when(m < 10, F.concat(F.lit("secret "), F.col("event_id").cast("string"))).when(m >= 19, F.when(m % 2 == 0, "up").otherwise(F.lit("")))
    return _events(spark, sf_dir).select("user_id", "ts", "event_id", action.alias("action"), (F.col("event_id") % 30).alias("element_id"), value.alias("value"))


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the page's elements."""
    k = F.col("n_nationkey")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select(k.alias("element_id"), pick(["button", "a", "input", "select", "textarea"]).alias("tag"), pick(["button", "link", "input:text", "select", "textarea"]).alias("kind"), F.when(k % 3 == 0, F.col("n_name")).otherwise("").alias("text"), F.when(k % 3 == 1, F.col("n_name")).alias("placeholder"), F.lit("").alias("aria"), (k % 7 != 0).alias("visible"))


def agent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent.run_status(_decisions(spark, sf_dir), "user_id", ["ts", "event_id"])


def describe_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decisions(spark, sf_dir).join(_elements(spark, sf_dir), "element_id", "left")
    label = agent.element_label(F.col("text"), F.col("placeholder"), F.col("aria"), F.col("kind"), F.col("element_id"))
    return d.select("event_id", agent.describe(F.col("action"), label, F.col("value")).alias("message"), agent.history_value(F.col("action"), F.col("value")).alias("kept_value"))


def validate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decisions(spark, sf_dir).where(F.col("action").isin("click", "type", "scroll", "select")).join(_elements(spark, sf_dir), "element_id", "left")
    reason = agent.action_outcome(F.col("action"), F.col("tag"), F.col("visible"))
    delta = F.when(F.col("action") == "scroll", agent.scroll_delta(F.coalesce(F.nullif("value", F.lit("")), F.lit("down"))))
    return d.select("event_id", reason.isNull().alias("success"), reason.alias("reason"), delta.cast("long").alias("scroll_by"))


def agent_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be asked next for each user: task, page elements and history, as JSON text."""
    # All users look at one page here; a page's elements are gathered into its row, and rows of tasks join their page's.
    elements = _elements(spark, sf_dir).groupBy(F.lit(0).alias("page")).agg(F.sort_array(F.collect_list(F.struct("element_id", "kind"))).alias("elements"))
    kept = agent.history_value(F.col("action"), F.col("value")).alias("value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    history = _decisions(spark, sf_dir).withColumn("n", F.row_number().over(w)).where(F.col("n") <= agent.MOST_STEPS)
    history = history.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("n", "action", "element_id", kept))).alias("h"))
    steps = F.transform("h", lambda x: F.struct(x["action"].alias("action"), x["element_id"].alias("element_id"), x["value"].alias("value")))
    task = F.concat(F.lit("task "), F.col("user_id").cast("string"))
    return history.withColumn("page", F.lit(0)).join(elements, "page").select("user_id", F.to_json(F.struct(task.alias("task"), "elements", steps.alias("history")), {"ignoreNullFields": "false"}).alias("payload"))


def recorded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as those of agent runs: a start now and then, snapshots in turn with results or answers."""
    n, e = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.col("event_id")
    kind = (
        F.when(n % 45 == 1, "start").when(e % 97 == 0, "failed").when(e % 89 == 0, "reset").when(n % 2 == 0, "snapshot")
        .when(e % 5 == 0, "answer").otherwise("result")
    )
    element = lambda i: F.struct((e % 30 + i).alias("id"), F.lit("button").alias("type"), F.when(e % 3 == 0, "Go").otherwise("").alias("text"))
    body = (
        F.when(kind == "start", F.concat(F.lit("task "), e.cast("string"))).when(kind == "snapshot", F.to_json(F.struct(F.array(element(0), element(1)).alias("elements"))))
        .when(kind == "result", F.to_json(F.struct((e % 7 != 0).alias("success"), F.lit("element_not_visible").alias("reason")))).when(kind == "answer", F.lit('{"k0":"x"}')).when(kind == "failed", "no tab")
    )
    return _events(spark, sf_dir).select(F.col("user_id").alias("task"), "ts", e.alias("seq"), kind.alias("kind"), body.alias("body"))


def rule_backend(request: dict) -> dict:
    """A stand-in for a backend: its decision follows from the task's number, the history's length and the elements."""
    k = int(request["task"].split()[-1]) + 3 * len(request["history"])
    at = request["elements"][k % 2]["id"]
    return [
        {"action": "click", "elementId": at}, {"action": "type", "elementId": at, "value": f"secret {k}"}, {"action": "scroll", "value": "up" if k % 2 else None},
        {"action": "ask_user", "fields": [{"key": "k0", "label": "City"}] if k % 3 else []}, {"action": "click", "elementId": at + 5}, {"action": "select", "elementId": at, "value": "x"},
        {"action": "click", "elementId": at}, {"action": "done"} if k % 5 == 0 else {"action": "scroll"},
    ][k % 8]


def agent_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the agent's loop does at each event of the recorded runs."""
    return streams.agent_loops(recorded_runs(spark, sf_dir), rule_backend).withColumnRenamed("task", "user_id")


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user from a stream over the event files."""
    return streams.latest_events(spark, sf_dir)


def collected_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last answer to each key of each user."""
    answers = _decisions(spark, sf_dir).where("action = 'ask_user'").select("user_id", F.struct("ts", "event_id").alias("o"), F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")).alias("key"), F.col("value").alias("answer"))
    return agent.merge_answers(answers, "user_id", "o", "key", "answer").select("user_id", F.explode("info").alias("key", "answer"))


def latest_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id"))
    return _events(spark, sf_dir).groupBy("user_id").agg(last.alias("e")).select("user_id", "e.*")


def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.debounce(_events(spark, sf_dir), "user_id", GAP)


def top_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 parts of each brand, as a details list shows its first rows."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 25")


def scrub_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties with some sensitive keys added, scrubbed by name."""
    props = _events(spark, sf_dir).select("event_id", F.from_json("props", T.StructType([T.StructField("k", T.LongType())])).alias("p"), "event_type")
    raw = F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("name"), F.struct(F.lit("a@b.co").alias("email"), F.col("event_type").alias("kind")).alias("inner"))
    return props.select("event_id", agent.scrub_json(F.to_json(raw)).alias("logged"))


def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions from a stream over the event files; those that the watermark has not closed are not out yet."""
    return streams.debounced_stream(spark, sf_dir, GAP)


def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid transitions by user, counted by a stateful stream."""
    return streams.checked_stream(spark, sf_dir)


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose run was started, once each."""
    return streams.once_stream(spark, sf_dir).select("user_id")


def controller_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States that controllers' verbs lead to, and whether they may follow one another."""
    verb = F.element_at(F.array(*map(F.lit, agent.VERB_STATES)), (F.col("event_id") % 13 + 1).cast("int"))
    steps = _events(spark, sf_dir).select("user_id", "ts", "event_id", agent.verb_state(verb).alias("state"))
    return agent.validate_states(steps, "user_id", ["ts", "event_id"]).groupBy("state").agg(F.count("*").alias("n"), F.sum(F.col("valid").cast("long")).alias("n_valid"))


def user_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for each nation as a requested field, and what submitting it collects."""
    k = F.col("n_nationkey")
    field = F.struct(F.concat(F.lit("f"), k.cast("string")).alias("key"), F.initcap("n_name").alias("label"), F.when(k % 2 == 0, "email").when(k % 4 == 1, "").alias("type"))
    form = table(spark, sf_dir, "nation").select("n_nationkey", F.array(agent.form_input(field)).alias("form"), "n_name")
    return form.select("n_nationkey", F.to_json(F.get("form", F.lit(0))).alias("input"), F.to_json(agent.submitted(F.col("form"), F.array("n_name"))).alias("collected"))


def elements_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements as indented JSON text."""
    e = F.to_json(F.struct("element_id", "kind", "text"), {"pretty": "true"})
    return _elements(spark, sf_dir).select("element_id", e.alias("shown"))


QUERIES = {f.__name__: f for f in (fsm_validate, fsm_resume_fix, state_history, agent_runs, describe_actions, validate_actions, agent_payload, collected_answers, latest_extraction, debounce_sessions, top_elements, scrub_props, stream_debounce, stream_states, stream_once, stream_latest, agent_loop, controller_verbs, user_form, elements_json)}

_LIST = "[" + ", ".join(f"'{s}'" for s in agent.STATES) + "]"
_STATES = f"""st as (select user_id, ts, event_id, {_LIST}[(row_number() over (partition by user_id order by ts, event_id) + case when event_id % 7 = 0 then 1 else 0 end) % 12 + 1] as state from events),
  pr as (select *, coalesce(lag(state) over (partition by user_id order by ts, event_id), 'IDLE') as previous from st)"""
_VALID = """(state = 'ERROR' or previous || '>' || state in ('IDLE>TASK_RECEIVED', 'TASK_RECEIVED>PAGE_ANALYSIS', 'PAGE_ANALYSIS>DOM_EXTRACTED', 'DOM_EXTRACTED>PII_DETECTED', 'PII_DETECTED>SCREENSHOT_CAPTURED',
  'SCREENSHOT_CAPTURED>SCREENSHOT_REDACTED', 'SCREENSHOT_REDACTED>READY_FOR_AGENT', 'READY_FOR_AGENT>WAITING_FOR_USER', 'READY_FOR_AGENT>EXECUTING', 'READY_FOR_AGENT>COMPLETED', 'WAITING_FOR_USER>READY_FOR_AGENT',
  'WAITING_FOR_USER>PAGE_ANALYSIS', 'EXECUTING>READY_FOR_AGENT', 'EXECUTING>COMPLETED', 'EXECUTING>WAITING_FOR_USER', 'EXECUTING>PAGE_ANALYSIS', 'COMPLETED>IDLE', 'ERROR>IDLE'{more}))"""
_DECIDED = """d as (select user_id, ts, event_id, event_id % 30 as element_id,
    case when event_id % 23 = 0 then 'done' when event_id % 23 = 1 then 'error' when event_id % 23 < 4 then 'ask_user' when event_id % 23 < 10 then 'type' when event_id % 23 < 16 then 'click' when event_id % 23 < 19 then 'select' else 'scroll' end as action,
    case when event_id % 23 < 10 then 'secret ' || event_id when event_id % 23 >= 19 then case when event_id % 23 % 2 = 0 then 'up' else '' end end as value from events),
  el as (select n_nationkey as element_id, ['button', 'a', 'input', 'select', 'textarea'][n_nationkey % 5 + 1] as tag, ['button', 'link', 'input:text', 'select', 'textarea'][n_nationkey % 5 + 1] as kind,
    case when n_nationkey % 3 = 0 then n_name else '' end as text, case when n_nationkey % 3 = 1 then n_name end as placeholder, n_nationkey % 7 <> 0 as visible from nation),
  de as (select d.*, el.tag, el.kind, el.visible, coalesce(nullif(text, ''), nullif(placeholder, ''), kind || ' #' || d.element_id, 'element #' || d.element_id) as label from d left join el using (element_id))"""

_SESSIONS = """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minutes then 0 else 1 end as fresh from events),
      s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from g),
      d as (select user_id, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) + 1800000000 as fires_us, count(*) as n_events from s group by user_id, n)"""
ORACLE_SQL = {
    "fsm_validate": f"with {_STATES} select user_id, event_id, previous, state, {_VALID.format(more='')} as valid from pr",
    "fsm_resume_fix": f"with {_STATES} select previous, state, count(*) as n, bool_and({_VALID.format(more=", 'READY_FOR_AGENT>PAGE_ANALYSIS'")}) as valid from pr group by all",
    "state_history": f"with {_STATES} select user_id, string_agg(state, '>' order by ts, event_id) as history from st group by user_id",
    "agent_runs": f"""with {_DECIDED}, n as (select *, row_number() over (partition by user_id order by ts, event_id) as step from d),
      e as (select user_id, min(step) filter (action in ('done', 'error')) as stop, max(step) as total from n where step <= 16 group by user_id),
      c as (select n.*, coalesce(least(stop, 16), 16) as lim from n join e using (user_id)),
      r as (select user_id, least(max(step), 15) as n_steps, count(*) filter (action in ('click', 'type', 'scroll') and step <= 15) as n_actions, arg_max(action, step) as last, max(step) as m from c where step <= lim group by user_id)
      select user_id, n_steps::bigint as n_steps, n_actions, case when m > 15 then 'STEP_CAP' when last = 'done' then 'COMPLETED' when last = 'error' then 'ERROR' when last = 'ask_user' then 'WAITING_FOR_USER' else 'OPEN' end as status from r""",
    "describe_actions": f"""with {_DECIDED} select event_id, case action when 'click' then 'Clicking "' || label || '"…' when 'type' then 'Typing into "' || label || '"…' when 'scroll' then 'Scrolling ' || coalesce(nullif(value, ''), 'down') || '…' else 'Performing ' || action || '…' end as message,
      case when action = 'type' then '[REDACTED]' else value end as kept_value from de""",
    "validate_actions": f"""with {_DECIDED}, r as (select event_id, action, value, case when action = 'scroll' then null when action = 'select' then case when tag = 'select' then null else 'element_not_found_or_not_select' end
      when tag is null then 'element_not_found' when not visible then 'element_not_visible' when action = 'type' and tag not in ('input', 'textarea') then 'element_not_typeable' end as reason from de where action in ('click', 'type', 'scroll', 'select'))
      select event_id, reason is null as success, reason, case when action = 'scroll' then case when value = 'up' then -400 else 400 end end::bigint as scroll_by from r""",
    "agent_payload": f"""with {_DECIDED}, n as (select *, row_number() over (partition by user_id order by ts, event_id) as step from d), e as (select list({{'element_id': element_id, 'kind': kind}} order by element_id) as elements from el),
      h as (select user_id, list({{'action': action, 'element_id': element_id, 'value': case when action = 'type' then '[REDACTED]' else value end}} order by step) as history from n where step <= 15 group by user_id)
      select user_id, to_json({{'task': 'task ' || user_id, 'elements': elements, 'history': history}})::varchar as payload from h, e""",
    "collected_answers": f"with {_DECIDED} select user_id, 'k' || event_id % 3 as key, arg_max(value, (ts, event_id)) as answer from d where action = 'ask_user' group by all",
    "latest_extraction": "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "stream_latest": "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "debounce_sessions": f"{_SESSIONS} select * from d",
    "stream_debounce": f"{_SESSIONS} select * from d where fires_us <= (select epoch_ms(max(ts)) * 1000 - 600000000 from events)",
    "top_elements": "select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) as rank from part qualify rank <= 25",
    "scrub_props": """select event_id, to_json({'k': (props->>'k')::bigint, 'name': '[omitted-by-logger]', 'inner': {'email': '[omitted-by-logger]', 'kind': event_type}})::varchar as logged from events""",
    "stream_states": f"""with st as (select user_id, ts, event_id, {_LIST}[event_id % 12 + 1] as state from events),
      pr as (select *, coalesce(lag(state) over (partition by user_id order by ts, event_id), 'IDLE') as previous from st)
      select user_id, arg_max(state, (ts, event_id)) as state, count(*) filter (not {_VALID.format(more="")}) as n_invalid, count(*) as n_steps from pr group by user_id""",
    "stream_once": "select distinct user_id from events",
    "controller_verbs": f"""with st as (select user_id, ts, event_id, ['TASK_RECEIVED', 'PAGE_ANALYSIS', 'DOM_EXTRACTED', 'PII_DETECTED', 'SCREENSHOT_CAPTURED', 'SCREENSHOT_REDACTED', 'READY_FOR_AGENT',
        'READY_FOR_AGENT', 'EXECUTING', 'WAITING_FOR_USER', 'COMPLETED', 'ERROR', 'IDLE'][event_id % 13 + 1] as state from events),
      pr as (select *, coalesce(lag(state) over (partition by user_id order by ts, event_id), 'IDLE') as previous from st)
      select state, count(*) as n, count(*) filter ({_VALID.format(more="")}) as n_valid from pr group by state""",
    "user_form": """with n as (select n_nationkey as k, n_name, array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') as label from nation)
      select k as n_nationkey, to_json({'name': 'f' || k, 'label': label, 'type': case when k % 2 = 0 then 'email' else 'text' end, 'required': true, 'autocomplete': 'off'})::varchar as input,
      '{"f' || k || '":"' || n_name || '"}' as collected from n""",
    "elements_json": """select element_id, '{' || chr(10) || '  "element_id" : ' || element_id || ',' || chr(10) || '  "kind" : "' || kind || '",' || chr(10) || '  "text" : "' || text || '"' || chr(10) || '}' as shown
      from (select n_nationkey as element_id, ['button', 'link', 'input:text', 'select', 'textarea'][n_nationkey % 5 + 1] as kind, case when n_nationkey % 3 = 0 then n_name else '' end as text from nation)""",
}
