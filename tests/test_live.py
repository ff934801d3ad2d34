"""Live detectors: event sequences, and the stream equal to the batch."""

import pytest

from plumbline.streaming import live


def run(state, step, frames):
    return [e for f in frames for e in step(state, *f)]


def test_line_is_said_once_and_lost_after_a_gap():
    frames = [(i / 10, True, True) for i in range(8)] + [(0.8, True, False), (1.1, True, False), (1.3, True, False)]
    assert run(live.LineState(), live.line_step, frames) == [("up", 0.5), ("line_achieved", 0.5), ("line_lost", pytest.approx(0.7))]


def test_short_gaps_keep_the_clock_and_marks_follow():
    frames = [(i / 4, True, i % 5 != 1 or i > 30) for i in range(48)]
    got = [e for e, _ in run(live.LineState(), live.line_step, frames)]
    assert got == ["up", "line_achieved", "time_mark", "time_mark"]


def test_form_faults_are_spaced():
    frames = [(i / 10, True, "arch") for i in range(60)]
    got = run(live.FormState(), live.form_step, frames)
    assert [e for e, _ in got] == ["fault_arch"] * 3 and got[0][1] == pytest.approx(1.0)


def test_rate_halves_to_the_floor():
    s = live.RateState()
    got = [v for i in range(40) for _, v in live.rate_step(s, i / 10, 100.0)]
    assert got[:2] == [5.0, 4.0] and s.fps == 4.0


def test_cues_by_priority():
    s = live.CueState()
    assert live.cue_step(s, 0.0, ["form", "line", "up"]) == "line"
    assert live.cue_step(s, 0.5, ["time_mark"]) is None
    assert live.cue_step(s, 3.1, ["hint"]) == "time_mark"


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s1", i / 10, i % 40 > 4, i % 40 > 10) for i in range(200)] + [("s2", i / 5, True, i > 20) for i in range(80)]
    df = spark.createDataFrame(rows, "session string, t double, up boolean, line boolean")
    for part in range(4):
        df.where(f"t >= {part * 5} and t < {part * 5 + 5}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    args = ("session", "t", ["up", "line"], live.LineState, live.line_step)
    batch = {tuple(r) for r in live.events(df, *args).collect()}
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = live.events(stream, *args).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select * from live").collect()} == batch and batch


def test_hints_are_spaced_and_ready_is_an_edge():
    s = live.HintState()
    off = ("tooSmall", [], False, False)
    got = [(e, t) for i in range(20) for e, t in live.hint_step(s, float(i), *off)]
    assert got == [("hint_come_closer", 0.0), ("hint_come_closer", 8.0), ("hint_come_closer", 16.0)]
    assert live.hint_step(s, 20.0, "multiplePeople", [], False, False) == [("hint_only_you", 20.0)]
    assert live.hint_step(s, 21.0, "ok", [], False, False) == [("ready", 21.0)] and live.hint_step(s, 22.0, "ok", [], False, False) == []
    live.hint_step(s, 30.0, "tooSmall", [], True, False)
    assert live.hint_step(s, 31.0, "tooSmall", [], False, False) == [] and live.hint_step(s, 33.0, "tooSmall", [], False, False)
    assert [live.framing_hint("partlyOutOfFrame", e, True) for e in (["left"], ["top"], ["top", "bottom"], [])] == ["move_to_middle", "raise_phone", "step_back", "step_back"]


def test_late_rows_change_nothing_and_silent_sessions_go(spark, tmp_path):
    import datetime as dt

    stamp = lambda t: dt.datetime.fromtimestamp(1_000_000 + t, dt.timezone.utc)
    schema = "session string, t double, at timestamp, up boolean, line boolean"
    parts = [
        [("a", i / 10, stamp(i / 10), True, True) for i in range(30)],
        [("a", 1.05, stamp(1.05), False, False), ("a", 3.0, stamp(3.0), True, True)],
        [("b", 9_000.0, stamp(9_000.0), True, True)],
        [("b", 9_001.0, stamp(9_001.0), True, True)],
        [("a", 9_002.0, stamp(9_002.0), True, True), ("a", 9_002.6, stamp(9_002.6), True, True)],
    ]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = live.events(stream, "session", "t", ["up", "line"], live.LineState, live.line_step, delay="10 seconds", event_time="at", idle="1 minute")
    q = out.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    got = [(r.session, round(r.t, 2), r.event) for r in spark.sql("select * from late order by t, event").collect()]
    # the last stretch of a begins anew: nothing is known of the first
    assert got == [("a", 0.5, "line_achieved"), ("a", 0.5, "up"), ("a", 1.05, "late"), ("b", 9_001.0, "line_achieved"), ("b", 9_001.0, "up"), ("a", 9_002.6, "line_achieved"), ("a", 9_002.6, "up")]
