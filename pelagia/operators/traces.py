"""Batch operators over sessions, messages, traces and spans."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.cluster import broadcast_if_light, broadcast_if_small, settle
from pelagia.contracts import SPAN_KINDS
from pelagia.functions.text import millis_between, safe_text
from pelagia.operators.ordering import lookup, numbered, page, page_summary

CHUNK = 4096
MAX_NAME = 200


def _desc(*columns: str) -> list[Column]:
    return [F.desc_nulls_last(c) for c in columns]


# -- sessions and messages ---------------------------------------------------------------------

def session_list(sessions: DataFrame, user_id, offset: int = 0, limit: int = 30) -> DataFrame:
    """One user's sessions: pinned first, then latest, then by id."""
    return page(own_sessions(sessions, user_id), _desc("pinned_at", "updated_at", "session_id"), offset, limit)


def own_sessions(sessions: DataFrame, user_id) -> DataFrame:
    return sessions.filter(F.col("user_id") == F.lit(user_id))


def session_list_summary(sessions: DataFrame, user_id, offset: int = 0, limit: int = 30) -> DataFrame:
    """The page's place among all of the user's sessions."""
    return page_summary(own_sessions(sessions, user_id), offset, limit)


def message_sequence(turns: DataFrame, session: str = "session_id", order: str = "turn",
                     hot_rows: int | None = None) -> DataFrame:
    """Number messages per session from 0; an answer's parent is the question just before it."""
    extra = {} if hot_rows is None else {"hot_rows": hot_rows}
    rows = numbered(turns, [session], [order], "sequence_no", **extra)
    asked = rows.filter("role = 'user'").select(
        F.col(session).alias("_session"), (F.col("sequence_no") + 1).alias("_next"),
        F.col("sequence_no").alias("parent_sequence_no"))
    return rows.join(asked, [F.col("role") == "assistant", F.col(session) == F.col("_session"),
                             F.col("sequence_no") == F.col("_next")], "left").drop("_session", "_next")


def append_runs(messages: DataFrame, runs: DataFrame) -> DataFrame:
    """Messages of new runs: a question and a pending answer, numbered after the last one.

    ``runs`` holds session_id, trace_id, question and started_at.
    """
    last = messages.groupBy("session_id").agg(F.max("sequence_no").alias("_last"))
    placed = numbered(runs, ["session_id"], ["started_at", "trace_id"], "_run")
    first = F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("_run") * 2
    pair = F.array(
        F.struct(first.alias("sequence_no"), F.lit("user").alias("role"),
                 F.lit("completed").alias("status"), F.col("question").alias("content"),
                 F.lit(None).cast("long").alias("parent_sequence_no")),
        F.struct((first + 1).alias("sequence_no"), F.lit("assistant").alias("role"),
                 F.lit("streaming").alias("status"), F.lit("").alias("content"),
                 first.alias("parent_sequence_no")))
    return placed.join(last, "session_id", "left").select("session_id", "trace_id", F.inline(pair))


def first_tool_output(spans: DataFrame) -> DataFrame:
    """Per trace, the output of its first tool span that has one."""
    tools = spans.filter("span_kind = 'tool' and output_data is not null")
    return tools.groupBy("trace_id").agg(F.min_by("output_data", "sequence_no").alias("tool_output"))


def session_messages(messages: DataFrame, traces: DataFrame, spans: DataFrame) -> DataFrame:
    """Messages with the trace's response on answers; a missing result comes from the tool span."""
    responses = traces.filter("output_data is not null").select(
        "trace_id", F.col("output_data").alias("response"),
        F.get_json_object("output_data", "$.result").alias("_result"))
    full = responses.join(first_tool_output(spans), "trace_id", "left").select(
        F.col("trace_id").alias("_trace"), "response",
        F.coalesce("_result", "tool_output").alias("result"))
    on = [F.col("role") == "assistant", F.col("trace_id") == F.col("_trace")]
    return messages.join(full, on, "left").drop("_trace")


# -- traces ------------------------------------------------------------------------------------

def owned_traces(traces: DataFrame, sessions: DataFrame, user_id, session_id=None) -> DataFrame:
    own = sessions.filter(F.col("user_id") == F.lit(user_id))
    if session_id is not None:
        own = own.filter(F.col("session_id") == F.lit(session_id))
    return traces.join(broadcast_if_small(own.select("session_id")), "session_id")


def question_of(column: str = "input_data") -> Column:
    return F.get_json_object(column, "$.question")


def trace_list(traces: DataFrame, sessions: DataFrame, user_id, session_id=None,
               offset: int = 0, limit: int = 30) -> DataFrame:
    """Latest traces of one user, optionally of one session."""
    own = owned_traces(traces, sessions, user_id, session_id).withColumn("question", question_of())
    return page(own.select("trace_id", "session_id", "status", "started_at", "ended_at", "question"),
                _desc("started_at", "trace_id"), offset, limit)


def trace_list_summary(traces: DataFrame, sessions: DataFrame, user_id, session_id=None,
                       offset: int = 0, limit: int = 30) -> DataFrame:
    """The page's place among all of the user's traces."""
    return page_summary(owned_traces(traces, sessions, user_id, session_id), offset, limit)


def trace_detail(traces: DataFrame, sessions: DataFrame, spans: DataFrame, user_id,
                 trace_id: str | None = None) -> DataFrame:
    """One row per span of the user's traces; sort by trace and sequence to read them."""
    own = owned_traces(traces, sessions, user_id)
    if trace_id is not None:
        own = own.filter(F.col("trace_id") == F.lit(trace_id))
        spans = spans.filter(F.col("trace_id") == F.lit(trace_id))
    head = own.select("trace_id", F.col("status").alias("trace_status"),
                      question_of().alias("question"))
    return spans.join(broadcast_if_light(head), "trace_id")


def trace_tree(spans: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Depth, root and reading order of every span below a root; a null or unknown parent makes a root.

    Ancestors are found by doubling: each round a span jumps to its ancestor's ancestor, so
    a depth of d takes about log2(d) joins.  Spans on or below a cycle have no root and are
    left out. ``position`` numbers a trace's spans from 0 as they are read, parents before their children and siblings by
    ``sequence_no``; a span's subtree is the range from its ``position`` to its ``last``.
    """
    extra = {} if hot_rows is None else {"hot_rows": hot_rows}
    nodes = spans.select("trace_id", "span_id", "parent_span_id", "sequence_no")
    known = nodes.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"),
                         F.col("parent_span_id").isNotNull().alias("_higher"))
    linked = lookup(nodes, known, [("trace_id", "_t"), ("parent_span_id", "_s")], **extra)
    found = F.col("_s").isNotNull()
    first = settle(linked.select(
        "trace_id", "span_id", F.col("_s").alias("parent_span_id"), "sequence_no",
        F.coalesce("_s", "span_id").alias("root_span_id"),
        F.when(found, 1).otherwise(0).cast("long").alias("depth"),
        (found & F.coalesce("_higher", F.lit(False))).alias("open")))
    # Rows that reached their root are kept aside and written once; only the others go on.
    closed, waiting = [first.filter("not open")], first.filter("open")
    rounds = math.ceil(math.log2(first.count() + 1)) + 1
    for _ in range(rounds):
        if waiting.isEmpty():
            break
        ends = [r.select("trace_id", "span_id", "root_span_id", "depth", "open") for r in (*closed, waiting)]
        jumps = reduce(DataFrame.unionByName, ends).select(
            F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"), F.col("root_span_id").alias("_r"),
            F.col("depth").alias("_d"), F.col("open").alias("_o"))
        moved = settle(lookup(waiting, jumps, [("trace_id", "_t"), ("root_span_id", "_s")], **extra).select(
            "trace_id", "span_id", "parent_span_id", "sequence_no",
            F.col("_r").alias("root_span_id"), (F.col("depth") + F.col("_d")).alias("depth"),
            F.col("_o").alias("open")))
        closed.append(moved.filter("not open"))
        waiting = moved.filter("open")
    return reading_order(reduce(DataFrame.unionByName, closed).drop("open"), hot_rows)


def reading_order(tree: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """``tree`` with ``position`` and ``last``, by ranking each trace's tour in distributed rounds.

    A tour enters every span, goes through its children, and leaves it. Each stop knows the next one and how many
    spans are entered up to it; jumping to the next one's next doubles the reach, so a trace of n spans takes about
    log2(2 n) rounds. What has reached the end is kept aside.
    """
    extra = {} if hot_rows is None else {"hot_rows": hot_rows}
    own = tree.select("trace_id", "span_id", "parent_span_id", "sequence_no")
    placed = settle(numbered(own, ["trace_id", "parent_span_id"], ["sequence_no", "span_id"], "_place", **extra))
    # The span at each place below a parent; roots stand below none.
    at = placed.select(F.col("trace_id").alias("_t"), F.coalesce("parent_span_id", F.lit("")).alias("_p"),
                       F.col("parent_span_id").isNull().alias("_top"), F.col("_place").alias("_n"), F.col("span_id").alias("_to"))
    top = F.col("parent_span_id").isNull()
    child = placed.join(at, [F.col("trace_id") == F.col("_t"), ~F.col("_top"), F.col("span_id") == F.col("_p"), F.col("_n") == 0], "left")
    enters = child.select("trace_id", "span_id", F.lit(False).alias("leaves"), F.coalesce("_to", "span_id").alias("next"),
                          F.col("_to").isNull().alias("next_leaves"), F.lit(1).cast("long").alias("entered"))
    sibling = placed.join(at, [F.col("trace_id") == F.col("_t"), top == F.col("_top"), F.coalesce("parent_span_id", F.lit("")) == F.col("_p"),
                               F.col("_place") + 1 == F.col("_n")], "left")
    leaves = sibling.select("trace_id", "span_id", F.lit(True).alias("leaves"), F.coalesce("_to", "parent_span_id").alias("next"),
                            F.col("_to").isNull().alias("next_leaves"), F.lit(0).cast("long").alias("entered"))
    first = settle(enters.unionByName(leaves))
    done, waiting = [first.filter("next is null")], first.filter("next is not null")
    for _ in range(math.ceil(math.log2(first.count() + 1)) + 1):
        if waiting.isEmpty():
            break
        jumps = reduce(DataFrame.unionByName, [*done, waiting]).select(
            F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"), F.col("leaves").alias("_l"),
            F.col("next").alias("_next"), F.col("next_leaves").alias("_next_leaves"), F.col("entered").alias("_entered"))
        moved = settle(waiting.join(jumps, [F.col("trace_id") == F.col("_t"), F.col("next") == F.col("_s"), F.col("next_leaves") == F.col("_l")]).select(
            "trace_id", "span_id", "leaves", F.col("_next").alias("next"), F.col("_next_leaves").alias("next_leaves"),
            (F.col("entered") + F.col("_entered")).alias("entered")))
        done.append(moved.filter("next is null"))
        waiting = moved.filter("next is not null")
    after = reduce(DataFrame.unionByName, done).groupBy("trace_id", "span_id").agg(
        F.max(F.when(~F.col("leaves"), F.col("entered"))).alias("_from"), F.max(F.when(F.col("leaves"), F.col("entered"))).alias("_behind"))
    total = own.groupBy("trace_id").agg(F.count("*").alias("_all"))
    return tree.join(after, ["trace_id", "span_id"]).join(total, "trace_id").select(
        *tree.columns, (F.col("_all") - F.col("_from")).alias("position"), (F.col("_all") - F.col("_behind") - 1).alias("last"))


def running_span(spans: DataFrame) -> DataFrame:
    """Per trace, the last span in order that is still running."""
    return spans.filter("status = 'running'").groupBy("trace_id").agg(
        F.max_by("span_id", "sequence_no").alias("span_id"),
        F.max("sequence_no").alias("sequence_no"))


def _said(path: str) -> Column:
    """Text of the output document at a path; blank text counts as none."""
    said = F.get_json_object("output_data", path)
    return F.when(F.trim(said) != F.lit(""), said)


def trace_overview(traces: DataFrame, spans: DataFrame) -> DataFrame:
    """What a trace did, one row per entry: understanding, source files, filters, methods and
    conclusion.

    Filters come from the tool spans; a trace without any falls back to those in its response.
    The understanding is the response's tool summary, else what the first model span that has
    a rationale or summary says.
    """
    tool = F.coalesce((F.col("span_kind") == "tool") | F.col("tool_name").isNotNull(), F.lit(False))
    said = F.when(F.col("span_kind") == "llm", F.coalesce(_said("$.rationale"), _said("$.summary")))
    of_spans = spans.withColumn("_said", said).groupBy("trace_id").agg(
        F.max(tool & (F.coalesce(F.size("filters"), F.lit(0)) > 0)).alias("_used"),
        F.expr("min_by(_said, sequence_no) filter (where _said is not null)").alias("_meant"))

    def entry(kind: str, value: Column, key: Column | None = None, span: Column | None = None) -> Column:
        nothing = F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("entry"), (nothing if span is None else span).alias("span_id"),
                        (nothing if key is None else key).alias("key"), value.alias("value"))

    def filters_of(filters: Column, span: str) -> Column:
        return F.transform(F.map_entries(filters), lambda e: entry("filter", e["value"], e["key"], F.col(span)))

    def listed(*parts: Column) -> Column:
        return F.concat(*[F.coalesce(p, F.array()) for p in parts])

    def files_of(frame: DataFrame) -> Column:
        files = F.col("source_files") if "source_files" in frame.columns else F.array().cast("array<string>")
        return F.transform(F.filter(files, lambda f: f != ""), lambda f: entry("source", f))

    def one(kind: str, value: Column) -> Column:
        return F.when(value != "", F.array(entry(kind, value)))

    from_spans = spans.filter(tool).select("trace_id", F.inline(listed(
        files_of(spans), filters_of(F.col("filters"), "span_id"), one("method", F.col("tool_name")))))
    stated = F.from_json(F.get_json_object("output_data", "$.result.metadata.provenance.filters"), "map<string,string>")
    known = traces.join(of_spans, "trace_id", "left")
    from_traces = known.select("trace_id", F.inline(listed(
        files_of(traces), F.when(~F.coalesce("_used", F.lit(False)), filters_of(stated, "trace_id")),
        one("method", F.get_json_object("output_data", "$.tool.name")), one("conclusion", _said("$.answer")),
        one("understanding", F.coalesce(_said("$.tool.summary"), F.col("_meant"))))))
    return from_spans.unionByName(from_traces).distinct()


def _glue(value: Column) -> Column:
    ordered = F.array_sort(F.collect_list(value))
    return F.array_join(F.transform(ordered, lambda d: d["text"]), "")


def glue_chunks(deltas: DataFrame, *also: Column) -> DataFrame:
    """Text of up to ``CHUNK`` neighbouring deltas per trace and kind."""
    return deltas.groupBy("trace_id", "kind", F.expr(f"seq div {CHUNK}").alias("_part"), *also).agg(
        F.min("seq").alias("chunk"),
        _glue(F.struct("seq", F.col("content").alias("text"))).alias("text")).select(
        "trace_id", "kind", "chunk", "text")


def glue_texts(chunks: DataFrame) -> DataFrame:
    """Trimmed reasoning and answer text per trace."""
    texts = chunks.groupBy("trace_id").agg(*[
        _glue(F.when(F.col("kind") == kind, F.struct("chunk", "text"))).alias(kind)
        for kind in ("reasoning", "answer")])
    return texts.select("trace_id", *[
        F.regexp_replace(k, r"(?U)^\s+|\s+$", "").alias(k) for k in ("reasoning", "answer")])


def glue_neighbours(pieces: DataFrame) -> DataFrame:
    """Pieces of answers (trace_id, seq, kind, content, deltas) with those that follow one another joined.

    A piece holds ``deltas`` deltas from ``seq`` on. Pieces are joined inside ranges of ``CHUNK`` numbers,
    so that no window holds more; usage is left as it is.
    """
    chunk = Window.partitionBy("trace_id", "kind", F.expr(f"seq div {CHUNK}")).orderBy("seq")
    follows = F.coalesce((F.lag(F.col("seq") + F.col("deltas")).over(chunk) == F.col("seq")) & (F.col("kind") != "usage"), F.lit(False))
    islands = pieces.withColumn("_new", (~follows).cast("int")).withColumn("_island", F.sum("_new").over(chunk))
    return islands.groupBy("trace_id", "kind", F.expr(f"seq div {CHUNK}").alias("_part"), "_island").agg(
        F.min("seq").alias("seq"), _glue(F.struct("seq", F.coalesce("content", F.lit("")).alias("text"))).alias("content"),
        F.sum("deltas").alias("deltas")).select("trace_id", "seq", "kind", "content", "deltas")


def answer_assembly(deltas: DataFrame) -> DataFrame:
    """Reasoning and answer text of each trace from ordered deltas, and its last usage.

    Deltas (trace_id, seq, kind, content) are joined in chunks first, so that no task holds a
    trace's deltas one by one; the text itself is one value per trace by definition.
    """
    texts = glue_texts(glue_chunks(deltas.filter("kind <> 'usage'")))
    usage = deltas.filter("kind = 'usage'").groupBy("trace_id").agg(
        F.max_by("content", "seq").alias("usage"))
    return texts.join(usage, "trace_id", "full").select(
        "trace_id", F.coalesce("reasoning", F.lit("")).alias("reasoning"),
        F.coalesce("answer", F.lit("")).alias("answer"), "usage")


# -- checks and rewrites -------------------------------------------------------------------------

def span_violations(spans: DataFrame) -> DataFrame:
    """One row per broken rule and span; rules over a whole trace name no span."""
    name = F.trim("name")
    rules = {
        "unknown_kind": ~F.col("span_kind").isin(*SPAN_KINDS),
        "blank_name": name == "",
        "long_name": F.char_length(name) > MAX_NAME,
        "negative_sequence": F.col("sequence_no") < 0,
        "negative_duration": F.col("duration_ms") < 0,
    }
    for column in ("sample_count", "input_tokens", "output_tokens", "total_tokens",
                   "context_length", "retry_count"):
        if column in spans.columns:
            rules[f"negative_{column}"] = F.col(column) < 0
    broken = F.filter(F.array(*[F.when(rule, F.lit(label)) for label, rule in rules.items()]),
                      lambda v: v.isNotNull())
    own = spans.select("trace_id", "span_id", F.explode(broken).alias("violation"))
    ids = spans.select("trace_id", F.col("span_id").alias("parent_span_id"))
    orphans = (spans.filter("parent_span_id is not null")
               .join(ids, ["trace_id", "parent_span_id"], "left_anti")
               .select("trace_id", "span_id", F.lit("unknown_parent").alias("violation")))
    # Numbers first, traces second: a long trace is already reduced when its rows meet.
    numbers = spans.groupBy("trace_id", "sequence_no").agg(
        F.count("*").alias("n"), F.count_if(F.col("parent_span_id").isNull()).alias("roots"))
    whole = numbers.groupBy("trace_id").agg(F.count_if(F.col("n") > 1).alias("doubled"),
                                            F.sum("roots").alias("roots"))
    labels = F.concat(
        F.when(F.col("roots") > 1, F.array(F.lit("several_roots"))).otherwise(F.array()),
        F.array_repeat(F.lit("duplicate_sequence"), F.col("doubled").cast("int")))
    of_trace = whole.select("trace_id", F.lit(None).cast("string").alias("span_id"),
                            F.explode(labels).alias("violation"))
    return own.unionByName(orphans).unionByName(of_trace)


def span_merge(updates: DataFrame, keys: list[str], order: str, values: list[str],
               maps: list[str]) -> DataFrame:
    """Fold updates: the latest non-null value per field; maps merge key by key, later wins."""
    merged = updates.groupBy(*keys).agg(*[
        F.expr(f"max_by({v}, {order}) filter (where {v} is not null)").alias(v) for v in values])
    for name in maps:
        entries = updates.select(*keys, order, F.explode(name).alias("_k", "_v"))
        latest = entries.groupBy(*keys, "_k").agg(F.max_by("_v", order).alias("_v"))
        folded = latest.groupBy(*keys).agg(
            F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias(name))
        merged = merged.join(folded, keys, "left")
    return merged


def close_open_spans(spans: DataFrame, failures: DataFrame) -> DataFrame:
    """Spans still running in a failed trace fail with it; finished ones stay as they are.

    ``failures`` holds trace_id, failed_at, error_code and error_message.
    """
    ends = failures.select("trace_id", "failed_at", F.col("error_code").alias("_code"),
                           safe_text(F.col("error_message")).alias("_message"))
    rows = spans.join(broadcast_if_light(ends), "trace_id", "left")
    hit = (F.col("status") == "running") & F.col("failed_at").isNotNull()
    changes = {
        "status": F.lit("failed"), "ended_at": F.col("failed_at"),
        "duration_ms": millis_between(F.col("started_at"), F.col("failed_at")),
        "error_code": F.col("_code"), "error_message": F.col("_message")}
    return rows.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes
                         else F.col(c) for c in spans.columns])


def cascade_delete(sessions: DataFrame, messages: DataFrame, traces: DataFrame, spans: DataFrame,
                   requested: DataFrame, user_id) -> dict[str, DataFrame]:
    """Tables without the user's requested sessions and all that hangs on them.

    ``requested`` holds position and session_id; ``deleted`` lists the ids in request order.
    """
    own = sessions.filter(F.col("user_id") == F.lit(user_id)).select("session_id")
    deleted = requested.join(own, "session_id", "left_semi")
    gone = broadcast_if_small(deleted.select("session_id").distinct())
    kept_traces = traces.join(gone, "session_id", "left_anti")
    gone_traces = broadcast_if_small(traces.join(gone, "session_id", "left_semi").select("trace_id"))
    return {
        "deleted": deleted.orderBy("position"),
        "sessions": sessions.join(gone, "session_id", "left_anti"),
        "messages": messages.join(gone, "session_id", "left_anti"),
        "traces": kept_traces,
        "spans": spans.join(gone_traces, "trace_id", "left_anti"),
    }


# -- finished runs -----------------------------------------------------------------------------

def provenance(document: Column, key: str, kind: str = "string") -> Column:
    """A value under ``metadata.provenance`` of a parsed result, or null."""
    return F.try_variant_get(document, f"$.metadata.provenance.{key}", kind)


def whole_number(document: Column, path: str) -> Column:
    """A JSON integer that is not negative; text, booleans and fractions give null."""
    raw = F.try_variant_get(document, path, "variant")
    value = F.try_variant_get(document, path, "long")
    return F.when((F.schema_of_variant(raw) == "BIGINT") & (value >= 0), value)


def trace_finalise(runs: DataFrame) -> DataFrame:
    """Final trace and message state of finished runs.

    ``runs`` holds trace_id, started_at, ended_at, response (JSON text, null when the run
    failed), error_code and error_message.
    """
    doc = F.col("_doc")
    text = lambda path: F.nullif(F.try_variant_get(doc, path, "string"), F.lit(""))
    done = F.col("response").isNotNull()
    sources = F.try_variant_get(doc, "$.sources", "array<string>")
    return runs.withColumn("_doc", F.try_parse_json("response")).select(
        "trace_id", F.when(done, "completed").otherwise("failed").alias("status"), "ended_at",
        millis_between(F.col("started_at"), F.col("ended_at")).alias("duration_ms"),
        F.coalesce(text("$.result.metadata.provenance.marker"),
                   text("$.tool.arguments.query.marker"),
                   text("$.tool.arguments.marker")).alias("marker"),
        whole_number(doc, "$.result.metadata.provenance.sample_count").alias("sample_count"),
        F.array_join(sources, ",").alias("source_files"),
        F.when(~done, F.col("error_code")).alias("error_code"),
        F.when(~done, safe_text(F.col("error_message"))).alias("error_message"),
        F.when(done, "completed").otherwise("failed").alias("message_status"),
        F.when(done, F.try_variant_get(doc, "$.answer", "string")).alias("message_content"))


# -- life cycle --------------------------------------------------------------------------------

#: What is known of a span, one row for each thing: its start, its end, a field, or a key of a map field.
ENTRY = ("trace_id string, span_id string, field string, key string, "
         "kept struct<at: struct<occurred_at: timestamp, event_no: bigint>, value: array<string>>")
START, END = "<start>", "<end>"


def entry_rows(events: DataFrame, values: tuple[str, ...] = (), maps: tuple[str, ...] = ()) -> DataFrame:
    """What each event tells, as ``ENTRY`` rows.

    ``events`` holds trace_id, span_id, parent_span_id, phase (started, updated, completed, failed),
    occurred_at, name, span_kind and error_code, and may hold error_message, the fields ``values`` and
    the string maps ``maps``. ``event_no``, if there is one, orders events of one instant. A failure tells its error only.
    """
    has = lambda name: F.col(name) if name in events.columns else F.lit(None)
    phase, message = F.col("phase"), safe_text(has("error_message").cast("string"))

    def told(field: str, *value: Column, key: Column = F.lit("")) -> Column:
        return F.struct(F.lit(field).alias("field"), key.alias("key"), F.array(*[v.cast("string") for v in value]).alias("value"))

    name = F.regexp_replace("name", r"(?U)^\s+|\s+$", "")
    single = [F.when(phase == "started", told(START, F.col("parent_span_id"), name, F.col("span_kind"))),
              F.when(phase.isin("completed", "failed"), told(END, phase, F.col("error_code"), message)),
              F.when((phase == "updated") & F.col("error_code").isNotNull(), told("error_code", F.col("error_code"))),
              F.when((phase == "updated") & message.isNotNull(), told("error_message", message))]
    single += [F.when((phase != "failed") & F.col(v).isNotNull(), told(v, F.col(v))) for v in values]

    def keyed(field: str) -> Column:
        pairs = F.map_entries(F.when(phase != "failed", F.col(field)))
        return F.coalesce(F.transform(pairs, lambda e: told(field, e["value"], key=e["key"])), F.array())

    every = F.concat(F.filter(F.array(*single), lambda e: e.isNotNull()), *map(keyed, maps))
    at = F.struct(F.col("occurred_at"), F.coalesce(has("event_no").cast("long"), F.lit(0).cast("long")).alias("event_no"))
    return events.select("trace_id", "span_id", at.alias("_at"), F.inline(every)).select(
        "trace_id", "span_id", "field", "key", F.struct(F.col("_at").alias("at"), "value").alias("kept"))


def folded_entries(entries: DataFrame) -> DataFrame:
    """The first start and end, and the last value of all else; folds of folds are folds."""
    life = F.col("field").isin(START, END)
    return entries.groupBy("trace_id", "span_id", "field", "key").agg(
        F.when(life, F.min("kept")).otherwise(F.max("kept")).alias("kept"))


def span_rows(folded: DataFrame, values: dict[str, str] | None = None, maps: tuple[str, ...] = ()) -> DataFrame:
    """One row per started span; one without an end is still running.

    The error is that of the failure, or of a later update.
    """
    values = values or {}
    of = lambda field: F.max(F.when(F.col("field") == field, F.col("kept")))
    pairs = lambda field: F.collect_list(F.when(
        F.col("field") == field, F.struct("key", F.col("kept.value")[0].alias("value"))))
    named = {"_start": START, "_end": END, "_code": "error_code", "_message": "error_message"}
    rows = folded.groupBy("trace_id", "span_id").agg(
        *[of(field).alias(name) for name, field in named.items()], *[of(v).alias(f"_value_{v}") for v in values],
        *[pairs(m).alias(f"_map_{m}") for m in maps])
    began, ended = F.col("_start.at.occurred_at"), F.col("_end.at.occurred_at")

    def error(update: str, place: int) -> Column:
        own = F.col("_end.value")[place]
        later = F.col(f"{update}.at") > F.col("_end.at")
        return F.when(later | own.isNull(), F.coalesce(F.col(f"{update}.value")[0], own)).otherwise(own)

    return rows.filter("_start is not null").select(
        "trace_id", "span_id", F.col("_start.value")[0].alias("parent_span_id"), F.col("_start.value")[1].alias("name"),
        F.col("_start.value")[2].alias("span_kind"), F.coalesce(F.col("_end.value")[0], F.lit("running")).alias("status"),
        began.alias("started_at"), ended.alias("ended_at"),
        F.when(ended.isNotNull(), millis_between(began, ended)).alias("duration_ms"),
        error("_code", 1).alias("error_code"), error("_message", 2).alias("error_message"),
        *[F.col(f"_value_{v}.value")[0].cast(kind).alias(v) for v, kind in values.items()],
        *[F.map_from_entries(f"_map_{m}").alias(m) for m in maps])


def span_fold(events: DataFrame, values: dict[str, str] | None = None, maps: tuple[str, ...] = ()) -> DataFrame:
    """Span rows from started / updated / completed / failed events; the stream folds the same way.

    The first start opens a span and its first end closes it. Details are merged from all events, also
    those after the end: the last value of each of ``values`` (name and type), and of each key of ``maps``.
    """
    return span_rows(folded_entries(entry_rows(events, tuple(values or ()), maps)), values, maps)


def fold_violations(events: DataFrame) -> DataFrame:
    """Finishes and updates without a start, repeated starts or finishes, and parents not open in time."""
    start, end = F.col("phase") == "started", F.col("phase").isin("completed", "failed")
    counts = events.groupBy("trace_id", "span_id").agg(
        F.count_if(start).alias("starts"), F.count_if(end).alias("ends"),
        F.min(F.when(start, F.col("occurred_at"))).alias("opened"),
        F.min(F.when(end, F.col("occurred_at"))).alias("closed"),
        F.min_by("parent_span_id", F.when(start, F.col("occurred_at"))).alias("parent_span_id"))
    broken = F.filter(F.array(
        F.when(F.col("starts") == 0, F.lit("missing_start")),
        F.when(F.col("starts") > 1, F.lit("duplicate_start")),
        F.when((F.col("starts") > 0) & (F.col("ends") > 1), F.lit("repeated_finish"))),
        lambda v: v.isNotNull())
    own = counts.select("trace_id", "span_id", F.explode(broken).alias("violation"))
    lives = counts.filter("starts > 0").select(
        F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"), F.col("opened").alias("_from"),
        F.col("closed").alias("_to"))
    children = counts.filter("starts > 0 and parent_span_id is not null")
    placed = lookup(children, lives, [("trace_id", "_t"), ("parent_span_id", "_s")])
    in_time = (F.col("_from") <= F.col("opened")) & (
        F.col("_to").isNull() | (F.col("_to") >= F.col("opened")))
    late = placed.filter(~F.coalesce(in_time, F.lit(False))).select(
        "trace_id", "span_id", F.lit("parent_not_open").alias("violation"))
    return own.unionByName(late)
