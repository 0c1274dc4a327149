from datetime import datetime, timedelta
from types import SimpleNamespace

from pelagia.operators import traces
from pelagia.plans.queries import in_batches
from pelagia.streaming import spans as streams
from pelagia.streaming.log import LevelLog

EVENT = ("trace_id string, span_id string, parent_span_id string, phase string, occurred_at timestamp, "
         "name string, span_kind string, error_code string")
T0 = datetime(2026, 1, 1, 10, 0, 0)


def event(span, parent, phase, second, code=None, trace="t"):
    return (trace, span, parent, phase, T0 + timedelta(seconds=second), f"n{span}", "node", code)


# Two branches whose operations interleave, as a run with parallel tasks reports them.
BRANCHES = [
    event("root", None, "started", 0), event("task-1", "root", "started", 1),
    event("op-1", "task-1", "started", 2), event("task-2", "root", "started", 3),
    event("op-2", "task-2", "started", 4), event("op-2", "task-2", "completed", 5),
    event("task-2", "root", "completed", 6), event("op-1", "task-1", "failed", 7, "OperationError"),
    event("task-1", "root", "completed", 8), event("root", None, "completed", 9)]


def test_interleaved_branches_keep_parents_and_order(spark):
    events = spark.createDataFrame(BRANCHES, EVENT)
    rows = {r.span_id: r for r in traces.span_fold(events).collect()}
    assert {k: v.parent_span_id for k, v in rows.items()} == {
        "root": None, "task-1": "root", "op-1": "task-1", "task-2": "root", "op-2": "task-2"}
    assert rows["op-1"].status == "failed" and rows["op-1"].error_code == "OperationError"
    assert rows["root"].duration_ms == 9000
    assert traces.fold_violations(events).count() == 0


def test_bad_transitions_are_reported(spark):
    events = spark.createDataFrame([
        event("a", None, "started", 0), event("a", None, "started", 1), event("b", None, "completed", 2),
        event("c", "nowhere", "started", 3), event("a", None, "completed", 4),
        event("d", "a", "started", 5), event("e", None, "started", 6), event("e", None, "completed", 7),
        event("e", None, "completed", 8)], EVENT)
    got = {(r.span_id, r.violation) for r in traces.fold_violations(events).collect()}
    assert got == {("a", "duplicate_start"), ("b", "missing_start"), ("c", "parent_not_open"),
                   ("d", "parent_not_open"), ("e", "repeated_finish")}
    assert {r.span_id for r in traces.span_fold(events).collect()} == {"a", "c", "d", "e"}


def feed(spark, folder, batches, schema):
    """One file per batch, read one file per micro-batch in order of writing."""
    import os
    for i, rows in enumerate(batches):
        part = f"{folder}/part{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        for name in os.listdir(part):
            if name.endswith(".parquet"):
                os.utime(f"{part}/{name}", (1_700_000_000 + i * 10,) * 2)
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(str(folder)))


def test_stream_equals_batch_whatever_a_span_lasts(spark, tmp_path):
    late = [event("op-3", "root", "started", 10), event("lost", None, "started", 10, trace="u")]
    days = [event("op-3", "root", "completed", 5 * 86_400), event("op-3", "root", "failed", 6 * 86_400, "Late")]
    batches = [BRANCHES[:4], late, BRANCHES[4:], days, [event("z", None, "completed", 7 * 86_400)]]
    log = streams.SpanLog(str(tmp_path / "log"))
    log.run(feed(spark, tmp_path / "in", batches, EVENT), str(tmp_path / "progress"))
    got = {r.span_id: r for r in log.spans(spark).collect()}
    want = {r.span_id: r for r in traces.span_fold(spark.createDataFrame(sum(batches, []), EVENT)).collect()}
    assert got == want
    assert (got["lost"].status, got["lost"].ended_at) == ("running", None)
    assert (got["op-3"].status, got["op-3"].duration_ms) == ("completed", (5 * 86_400 - 10) * 1000)
    log.log(traces.folded_entries(traces.entry_rows(spark.createDataFrame(batches[4], EVENT))), 4)  # a repeat
    assert {r.span_id: r for r in log.spans(spark).collect()} == want


DETAILED = EVENT + ", error_message string, event_no int, tool_name string, input_tokens long, attributes map<string,string>"


def told(*row, message=None, no=0, tool=None, tokens=None, attributes=None):
    return (*event(*row), message, no, tool, tokens, attributes)


def test_updates_merge_before_and_after_the_end(spark, tmp_path):
    """Field by field and key by key, later wins; an end after the end changes nothing but details."""
    rows = [
        told("a", None, "started", 0, attributes={"x": "1", "y": "1"}, tool="first"),
        told("b", "a", "started", 1),
        told("a", None, "updated", 2, attributes={"y": "2"}, tokens=5),
        told("b", "a", "failed", 3, "Broken", message="password=abc", attributes={"never": "told"}),
        told("a", None, "completed", 4, attributes={"z": "4"}, tokens=None),
        told("b", "a", "completed", 5, attributes={"after": "5"}, tool="late"),
        told("a", None, "failed", 6, "TooLate", message="no", tool="never"),
        told("a", None, "updated", 7, attributes={"x": "7"}, tokens=9), told("a", None, "updated", 7, no=1, attributes={"x": "8"}),
        told("b", "a", "updated", 8, "Renamed"), told("c", "a", "updated", 9, tool="of a span that never starts")]
    want = {"a": ("completed", None, None, "first", 9, {"x": "8", "y": "2", "z": "4"}),
            "b": ("failed", "Renamed", "password=[REDACTED]", "late", None, {"after": "5"})}

    def seen(spans):
        return {r.span_id: (r.status, r.error_code, r.error_message, r.tool_name, r.input_tokens, r.attributes) for r in spans.collect()}

    values, maps = {"tool_name": "string", "input_tokens": "long"}, ("attributes",)
    assert seen(traces.span_fold(spark.createDataFrame(rows, DETAILED), values, maps)) == want
    assert seen(traces.span_fold(spark.createDataFrame(rows[::-1], DETAILED), values, maps)) == want
    log = streams.SpanLog(str(tmp_path / "log"), values, maps)
    log.run(feed(spark, tmp_path / "in", [[r] for r in rows[::-1]], DETAILED), str(tmp_path / "progress"))
    assert seen(log.spans(spark)) == want
    assert seen(traces.span_fold(spark.createDataFrame([], DETAILED), values, maps)) == {}


def test_names_lose_blanks_around_them(spark):
    rows = [("t", "s", None, "started", T0, "\u2003 a name\t\n", "node", None)]
    assert traces.span_fold(spark.createDataFrame(rows, EVENT)).first().name == "a name"


def test_a_batch_costs_what_it_holds_and_a_restart_goes_on(spark, tmp_path):
    """Sixty batches of two traces each: state and files that a batch touches don't grow with the history."""
    starts = "trace_id string, span_id string, occurred_at timestamp"
    batches = [[(f"t{i % 20}", f"{i}a", T0 + timedelta(seconds=i)), (f"only{i}", f"{i}b", T0)] for i in range(60)]
    source = feed(spark, tmp_path / "in", batches[:40], starts)
    log = streams.SequenceLog(str(tmp_path / "log"))
    first = log.run(source, str(tmp_path / "progress"))
    for i, rows in enumerate(batches[40:]):
        feed(spark, tmp_path / "in" / f"later{i}", [rows], starts)
    later = streams.SequenceLog(str(tmp_path / "log")).run(source, str(tmp_path / "progress"))
    for query, n in ((first, 40), (later, 20)):
        done = [p for p in query.recentProgress if p["numInputRows"]]
        assert len(done) == n
        assert all(p["stateOperators"][0]["numRowsUpdated"] == 2 for p in done)
    assert later.lastProgress["stateOperators"][0]["numRowsTotal"] == 80
    live, absorbed = log.log.segments(spark)
    assert len(live) <= 7 and live[0].low == 0 and live[-1].high == 60
    assert all(a.high == b.low for a, b in zip(live, live[1:]))
    got = {r.span_id: r.sequence_no for r in log.rows(spark).collect()}
    assert got == {**{f"{i}a": i // 20 for i in range(60)}, **{f"{i}b": 0 for i in range(60)}}


def test_level_log_rewrites_a_row_seldom(spark, tmp_path, monkeypatch):
    """Two hundred batches: few folders, and a row is written about log2(batches) times."""
    written = []
    monkeypatch.setattr(LevelLog, "_write", lambda self, spark, rows, segment, real=LevelLog._write: (written.append(segment), real(self, spark, rows, segment)))
    log = LevelLog(str(tmp_path / "log"), "n long")
    for i in range(200):
        log(spark.range(i, i + 1, 1, 1).toDF("n"), i)
        if i % 50 == 49:
            live, absorbed = log.segments(spark)
            assert len(live) <= 8 and len(live) + len(absorbed) <= 16
    assert sum(s.high - s.low for s in written) <= 200 * 9
    assert sorted(r.n for r in log.read(spark).collect()) == list(range(200))
    log(spark.range(5).toDF("n"), 199)
    assert log.read(spark).count() == 200


def test_level_log_after_a_crash(spark, tmp_path):
    """A segment without its marker doesn't count, and absorbed ones that are still there aren't read."""
    log = LevelLog(str(tmp_path / "log"), "n long")
    assert log.read(spark).count() == 0
    for i in range(3):
        log(spark.range(i, i + 1).toDF("n"), i)
    spark.range(100, 105).toDF("n").write.parquet(str(tmp_path / "log" / "000000000000-000000000004"))
    assert sorted(r.n for r in log.read(spark).collect()) == [0, 1, 2]
    log(spark.range(3, 4).toDF("n"), 3)
    assert [s.name for s in log.segments(spark)[0]] == ["000000000000-000000000004"]
    assert sorted(r.n for r in log.read(spark).collect()) == [0, 1, 2, 3]


def test_numbers_go_on_after_days_of_silence(spark, tmp_path):
    starts = "trace_id string, span_id string, occurred_at timestamp"
    row = lambda t, s, day: (t, s, T0 + timedelta(days=day))
    batches = [[row("a", "1", 0)], [row("a", "2", 1), row("b", "3", 1)], [row("b", "4", 9)], [row("c", "5", 20)], [row("a", "6", 90)]]
    source = feed(spark, tmp_path / "in", batches, starts)
    rows = streams.number_available(source, str(tmp_path / "out"), str(tmp_path / "progress"))
    assert {r.span_id: r.sequence_no for r in rows.collect()} == {"1": 0, "2": 1, "3": 0, "4": 1, "5": 0, "6": 2}


def test_numbers_continue_over_batches_and_survive_a_repeat(spark, tmp_path):
    starts = "trace_id string, span_id string, occurred_at timestamp"
    row = lambda t, s, sec: (t, s, T0 + timedelta(seconds=sec))
    batches = [[row("a", "1", 0), row("a", "2", 1), row("b", "3", 2)], [row("a", "4", 5), row("b", "5", 4)],
               [row("c", "6", 6), row("a", "7", 7)]]
    source = feed(spark, tmp_path / "in", batches, starts)
    path = str(tmp_path / "out")
    rows = streams.number_available(source, path, str(tmp_path / "progress"))
    want = {"1": 0, "2": 1, "3": 0, "4": 2, "5": 1, "6": 0, "7": 3}
    assert {r.span_id: r.sequence_no for r in rows.collect()} == want
    # A restart repeats the last batch at most: its commit is lost, its rows are there.
    (tmp_path / "progress" / "commits" / "2").unlink()
    (tmp_path / "progress" / "commits" / ".2.crc").unlink(missing_ok=True)
    again = streams.number_available(source, path, str(tmp_path / "progress"))
    assert {r.span_id: r.sequence_no for r in again.collect()} == want


def test_answers_keep_usage_and_the_order_of_seq(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(traces, "CHUNK", 2)
    parts = [("t", i, "answer", f"{i} ") for i in range(7)] + [("t", 7, "usage", "{1}"), ("t", 9, "usage", "{2}")]
    batches = [parts[::2], parts[1::2], [("z", 0, "reasoning", "x")]]
    log = streams.AnswerLog(str(tmp_path / "log"))
    log.run(feed(spark, tmp_path / "in", batches, "trace_id string, seq long, kind string, content string"), str(tmp_path / "progress"))
    got = {r.trace_id: tuple(r)[1:] for r in log.answers(spark).collect()}
    assert got == {"t": ("", "0 1 2 3 4 5 6", "{2}"), "z": ("x", "", None)}


def test_neighbouring_deltas_become_one_piece(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(traces, "CHUNK", 8)
    batches = [[("t", i, "answer", f"{i}.", 1), ("u", 2 * i, "answer", f"{i}.", 1)] for i in range(16)]
    log = streams.AnswerLog(str(tmp_path / "log"))
    for i, rows in enumerate(batches):
        log._take(spark.createDataFrame(rows, streams.DELTA), i)
    pieces = sorted((r.trace_id, r.seq, r.content, r.deltas) for r in log.log.read(spark).collect())
    whole = "".join(f"{i}." for i in range(16))
    assert pieces[:2] == [("t", 0, whole[:16], 8), ("t", 8, whole[16:], 8)] and len(pieces) == 18
    assert {r.answer for r in log.answers(spark).collect()} == {whole}


def test_payloads_are_safe_before_they_are_stored(spark, tmp_path):
    source = feed(spark, tmp_path / "in", [[('{"password":"x"}',)], [('{"q":"secret=1"}',)]], "payload string")
    rows = streams.run_available(streams.safe_stream(source, ["payload"]), "s")
    assert sorted(r.payload for r in rows.collect()) == ['{"password":"[REDACTED]"}', '{"q":"secret=[REDACTED]"}']


def test_a_part_of_many_files_is_one_batch(spark, tmp_path):
    """A large file is written by several tasks, whose files of one part come together."""
    spark.range(3000).coalesce(1).write.parquet(str(tmp_path / "one"))
    table = SimpleNamespace(spark=spark, raw=lambda name: spark.read.parquet(str(tmp_path / name)).repartition(8))
    seen = []
    streams.take_in(in_batches(table, "one", "id long", "id"), lambda batch, i: seen.append({r.id for r in batch.collect()}), str(tmp_path / "progress"))
    assert len(seen) == 3 and set.union(*seen) == set(range(3000))
    assert all(max(a) < min(b) for a, b in zip(seen, seen[1:]))


def test_spans_are_kept_once_in_the_log(spark, tmp_path, monkeypatch):
    """No state store holds the log's values again, and the shuffles of a segment go as soon as it is written."""
    import time
    from pyspark.sql import DataFrameWriter
    left = []

    def write(writer, path, *rest, real=DataFrameWriter.parquet):
        before = shuffle_bytes(spark)
        real(writer, path, *rest)
        for _ in range(50):  # files are removed beside the query
            if shuffle_bytes(spark) <= before:
                break
            time.sleep(0.1)
        left.append(max(0, shuffle_bytes(spark) - before))

    batches = [BRANCHES[:4], BRANCHES[4:7], BRANCHES[7:]]
    source = feed(spark, tmp_path / "in", batches, EVENT)
    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    log = streams.SpanLog(str(tmp_path / "log"))
    query = log.run(source, str(tmp_path / "progress"))
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [4, 3, 3]
    assert all(not p["stateOperators"] for p in query.recentProgress) and not (tmp_path / "progress" / "state").exists()
    assert len(left) == 4 and not any(left)
    assert len(log.log.segments(spark)[0]) == 2
    want = {r.span_id: r for r in traces.span_fold(spark.createDataFrame(BRANCHES, EVENT)).collect()}
    assert {r.span_id: r for r in log.spans(spark).collect()} == want


def shuffle_bytes(spark):
    """Bytes of all shuffle files that the session has at present."""
    from pathlib import Path
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(f.stat().st_size for d in manager.localDirs() for f in Path(d.toString()).rglob("shuffle_*"))
