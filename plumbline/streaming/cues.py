"""Cues of a live session: detectors chained behind each other, in order of event time, on a stream or a batch.

A chain is a list of links. For every frame each link gets its state, the frame and what the links before said of
it, and says events of its own. On a stream the frames of a session wait in state until the watermark has passed
them, so they are taken in order however they arrive within the delay; a frame behind what was already taken is given out as ``late``
and changes nothing; a session that stays silent is given out as ``closed`` and its state is dropped.
"""

from __future__ import annotations

import dataclasses
import re
from collections import namedtuple
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from plumbline.streaming import live

Said = list[tuple[str, float]]


@dataclass(frozen=True)
class Link:
    """A detector: a name, a state (a dataclass whose fields name their SQL types) and ``step(state, t, frame, said)``."""

    name: str
    state: type
    step: Callable[[object, float, object, Said], Said]


def typed(sql: str, default: object = None) -> object:
    """A state's field of a SQL type."""
    make = {"default_factory": list} if default == [] else {"default": default}
    return field(metadata={"sql": sql}, **make)


def _schema(state: type) -> str:
    return ", ".join(f"`{f.name}` {f.metadata['sql']}" for f in dataclasses.fields(state))


# --- detectors ------------------------------------------------------------------------------------------


@dataclass
class Line:
    """LIV1-4 with typed fields."""

    up_since: float | None = typed("double")
    down_since: float | None = typed("double")
    up_said: bool = typed("boolean", False)
    line_since: float | None = typed("double")
    last_line: float | None = typed("double")
    line_said: bool = typed("boolean", False)
    marks: int = typed("int", 0)
    at: float = typed("double", float("-inf"))


@dataclass
class Form:
    """LIV9, LIV10 with typed fields."""

    attempt_since: float | None = typed("double")
    out_since: float | None = typed("double")
    red_since: float | None = typed("double")
    last_red: float | None = typed("double")
    fault: str | None = typed("string")
    said_at: float | None = typed("double")


@dataclass
class Rate:
    """LIV18, LIV19: durations in the window, when it began, and the rate in force."""

    at: list = typed("array<double>", [])
    ms: list = typed("array<double>", [])
    since: float | None = typed("double")
    fps: float = typed("double", 10.0)


# Seconds of the window, milliseconds of the budget, and the least rate.
WINDOW_S, BUDGET_MS, LEAST_FPS = 2.0, 80.0, 4.0


def elapsed(now: float, then: float) -> float:
    """Seconds between two times of whole milliseconds."""
    return round((now - then) * 1000) / 1000


def rate_step(s: Rate, t: float, ms: float) -> Said:
    """Halves the rate once a whole window of more than one frame took more than the budget on average; the window then begins anew."""
    s.since = t if s.since is None else s.since
    kept = [(a, m) for a, m in (*zip(s.at, s.ms, strict=True), (t, ms)) if elapsed(t, a) <= WINDOW_S]
    s.at, s.ms = [a for a, _ in kept], [m for _, m in kept]
    if elapsed(t, s.since) < WINDOW_S or len(kept) < 2 or sum(s.ms) / len(kept) <= BUDGET_MS:
        return []
    s.at, s.ms, s.since = [], [], None
    if s.fps <= LEAST_FPS:
        return []
    s.fps = max(LEAST_FPS, s.fps / 2)
    return [("rate", s.fps)]


@dataclass
class Cues:
    """LIV13-15: what waits in each slot, and when what was last said."""

    in_line: bool = typed("boolean", False)
    line: bool = typed("boolean", False)
    up: bool = typed("boolean", False)
    mark: float | None = typed("double")
    form: str | None = typed("string")
    spoken_at: float | None = typed("double")
    hint: str | None = typed("string")
    hint_at: float | None = typed("double")
    inverted: bool = typed("boolean", False)
    ended_at: float | None = typed("double")
    was_off: bool | None = typed("boolean")


# Seconds since the last cue that a cue needs, after an inversion, between hints, and before the same hint again.
GAP_S, LINE_GAP_S, FORM_GAP_S, AFTER_INVERSION_S, HINT_GAP_S, HINT_REPEAT_S = 3.0, 1.0, 2.0, 1.5, 4.0, 8.0


@dataclass(frozen=True)
class Settings:
    voice: bool = True
    marks: bool = True
    hints: bool = True
    form: bool = True


def decide(s: Cues, t: float, said: Said, framing: str | None, edges: list[str] | None, inverted: bool, up: bool, recording: bool, settings: Settings = Settings()) -> Said:
    """At most one cue a frame, by priority: line, up, time mark, ready, framing hint, form.

    Line, up and a time mark wait until their gap is over and hold the rest back meanwhile. A line silences up and form;
    form waits only while the body is up and out of line. Ready is the step from wrong framing to right; hints
    come before an attempt only.
    """
    free = lambda gap: s.spoken_at is None or elapsed(t, s.spoken_at) >= gap

    def speak(event: str, value: float) -> Said:
        s.spoken_at = t
        return [(event, value)]

    if not settings.voice:
        s.line = s.up = False
        s.mark = None
    if not (settings.voice and settings.form and up):
        s.form = None
    if inverted:
        s.ended_at = None
    elif s.inverted:
        s.ended_at = t
    s.inverted = inverted
    faults = []
    for event, value in said:
        if event == "up":
            s.up = s.up or settings.voice
        elif event == "line_achieved":
            s.in_line = True
            if settings.voice:
                s.line, s.up, s.form = True, False, None
        elif event == "line_lost":
            s.in_line = False
        elif event == "time_mark" and settings.voice and settings.marks:
            s.mark = value
        elif event.startswith("fault_"):
            faults.append(event.removeprefix("fault_"))
    if faults and settings.voice and settings.form and up and not s.in_line:
        s.form = faults[-1]
    if s.line:
        if not free(LINE_GAP_S):
            return []
        s.line = s.up = False
        return speak("cue_line", t)
    if s.up:
        if not free(LINE_GAP_S):
            return []
        s.up = False
        return speak("cue_up", t)
    if s.mark is not None:
        if not settings.marks or not free(GAP_S):
            s.mark = s.mark if settings.marks else None
            return []
        mark, s.mark = s.mark, None
        return speak("cue_mark", mark)
    if framing is not None:
        was_off, s.was_off = s.was_off is True, framing != "ok"
        if settings.voice and not recording and not inverted and framing == "ok" and was_off and free(GAP_S):
            return speak("cue_ready", t)
        hint = live.framing_hint(framing, edges, not inverted)
        cooled = s.ended_at is None or elapsed(t, s.ended_at) >= AFTER_INVERSION_S
        since = float("inf") if s.hint_at is None else elapsed(t, s.hint_at)
        if hint and settings.hints and not recording and not inverted and not s.in_line and cooled and free(GAP_S) and since >= (HINT_REPEAT_S if hint == s.hint else HINT_GAP_S):
            s.hint, s.hint_at = hint, t
            return speak(f"cue_{hint}", t)
    if s.form is not None and free(FORM_GAP_S):
        fault, s.form = s.form, None
        return speak(f"cue_form_{fault}", t)
    return []


#: Columns of a frame that the whole chain reads.
FRAME = ("up", "line", "fault", "framing", "edges", "inverted", "recording", "inference_ms")


def _flag(x: object) -> bool:
    return x is not None and x == x and bool(x)


def _text(x: object) -> str | None:
    return x if isinstance(x, str) else None


CHAIN = (
    Link("line", Line, lambda s, t, f, said: live.line_step(s, t, _flag(f.up), _flag(f.line))),
    Link("form", Form, lambda s, t, f, said: live.form_step(s, t, _flag(f.up), _text(f.fault))),
    Link("cues", Cues, lambda s, t, f, said: decide(s, t, said, _text(f.framing), None if f.edges is None else list(f.edges), _flag(f.inverted), _flag(f.up), _flag(f.recording))),
    Link("rate", Rate, lambda s, t, f, said: [] if f.inference_ms is None or f.inference_ms != f.inference_ms else rate_step(s, t, f.inference_ms)),
)


# --- running a chain --------------------------------------------------------------------------------------


def fresh(chain: tuple[Link, ...]) -> dict[str, object]:
    return {x.name: x.state() for x in chain}


def walk(chain: tuple[Link, ...], states: dict[str, object], at: int | None, frames: list, idle_ms: int) -> tuple[dict[str, object], int | None, list[tuple[float, str, float]]]:
    """(states, time of the last frame, (t, event, value)) after frames in order, which begin with their time in milliseconds; a silence closes the session and begins another."""
    out = []
    for f in frames:
        if at is not None and f[0] >= at + idle_ms:
            out.append(_closed(at, idle_ms))
            states = fresh(chain)
        at, t, said = int(f[0]), f[0] / 1000.0, []
        for link in chain:
            said = said + link.step(states[link.name], t, f, said)
        out += [(t, e, float(v)) for e, v in said]
    return states, at, out


def _closed(at: int, idle_ms: int) -> tuple[float, str, float]:
    return at / 1000.0, "closed", (at + idle_ms) / 1000.0


def _ordered(rows: pd.DataFrame, order: list[str]) -> list:
    return list(rows.sort_values(order, kind="stable").itertuples(index=False, name="Frame"))


def _plain(v: object) -> object:
    """What state can hold: lists for arrays, None for NaN."""
    if hasattr(v, "tolist"):
        return v.tolist()
    return None if isinstance(v, float) and v != v else v


class Session(StatefulProcessor):
    """A session's frames in order of time, through a chain."""

    def __init__(self, session: str, columns: list[str], shape: str, chain: tuple[Link, ...], idle_ms: int, order: list[str]):
        self.session, self.columns, self.shape, self.chain, self.idle_ms, self.order = session, columns, shape, chain, idle_ms, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.shape)
        self.clock = handle.getValueState("clock", "at bigint")
        self.links = {x.name: handle.getValueState(x.name, _schema(x.state)) for x in self.chain}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = pd.concat(list(rows))[["frame_ms", *self.columns]]
        at = self.clock.get()[0] if self.clock.exists() else None
        late = fresh[fresh["frame_ms"] < at] if at is not None else fresh.iloc[:0]
        fresh = fresh.drop(late.index) if len(late) else fresh
        out = [(t / 1000.0, "late", t / 1000.0) for t in sorted(late["frame_ms"])]
        if len(fresh):
            self.waiting.appendList([tuple(map(_plain, r)) for r in fresh.astype(object).itertuples(index=False, name=None)])
        yield from self.take(key, timerValues.getCurrentWatermarkInMs(), out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self.take(key, timerValues.getCurrentWatermarkInMs(), [])

    def take(self, key, until: int, out: list[tuple[float, str, float]]) -> Iterator[pd.DataFrame]:
        """Walks what the watermark has passed; keeps the rest; asks to be woken for it, or to close."""
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] <= until]
        rest = [r for r in rows if r[0] > until]
        at = self.clock.get()[0] if self.clock.exists() else None
        if ready:
            states = {x.name: x.state(*(list(v) if isinstance(v, tuple) else v for v in self.links[x.name].get())) if self.links[x.name].exists() else x.state() for x in self.chain}
            frames = _ordered(pd.DataFrame(ready, columns=["frame_ms", *self.columns]).astype({"frame_ms": "int64"}), self.order)
            states, at, said = walk(self.chain, states, at, frames, self.idle_ms)
            out = out + said
            for x in self.chain:
                self.links[x.name].update(dataclasses.astuple(states[x.name]))
            self.clock.update((at,))
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not rest and at is not None and until >= at + self.idle_ms:
            out = out + [_closed(at, self.idle_ms)]
            self.clock.clear()
            for link in self.links.values():
                link.clear()
        else:
            wake = min([r[0] for r in rest] + ([at + self.idle_ms] if at is not None else []), default=None)
            if wake is not None:
                self.handle.registerTimer(int(wake))
        if out:
            yield _table(self.session, key[0], out)

    def close(self) -> None:
        pass


def _table(session: str, key: object, out: list[tuple[float, str, float]]) -> pd.DataFrame:
    found = pd.DataFrame(out, columns=["t", "event", "value"]).astype({"t": float, "value": float})
    found.insert(0, session, key)
    return found


def session_events(frames: DataFrame, session: str, event_time: str, chain: tuple[Link, ...] = CHAIN, columns: tuple[str, ...] = FRAME, delay: str = "10 seconds", idle_s: float = 60.0, tie: str | None = None) -> DataFrame:
    """LIV13-15, LIV18, LIV19: session, t, event and value of a chain over frames with a timestamp.

    A stream (which needs the RocksDB state store) waits ``delay`` for frames; a session closes ``idle_s`` after its last
    frame. A batch gives the same events, and ``closed`` at the end of each stretch without a longer silence. Frames of one millisecond
    go in order of ``tie``, else as they come on a stream and in order of their columns in a batch.
    """
    if frames.isStreaming:
        frames = frames.withWatermark(event_time, delay)
    rows = frames.withColumn("frame_ms", F.unix_millis(event_time)).where("frame_ms is not null")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = f"`{session}` {kinds[session]}, t double, event string, value double"
    idle_ms = int(idle_s * 1000)
    order = ["frame_ms", *([tie] if tie else [])]
    columns = (*columns, *(c for c in order[1:] if c not in columns))
    if frames.isStreaming:
        shape = ", ".join(f"`{c}` {kinds[c]}" for c in ("frame_ms", *columns))
        return rows.select(session, event_time, "frame_ms", *columns).groupBy(session).transformWithStateInPandas(Session(session, list(columns), shape, chain, idle_ms, order), out, "append", "eventTime")

    schema = StructType([StructField(session, rows.schema[session].dataType)] + [StructField(n, t()) for n, t in (("t", DoubleType), ("event", StringType), ("value", DoubleType))])
    ties = [c for c in columns if not re.search(r"\b(map|variant)\b", kinds[c])]
    dealt = rows.select(session, "frame_ms", *columns).repartition(session).sortWithinPartitions(session, *order, *(c for c in ties if c not in order))
    return dealt.mapInArrow(lambda batches: _walked(batches, chain, idle_ms), schema)


def _walked(batches: Iterator[pa.RecordBatch], chain: tuple[Link, ...], idle_ms: int) -> Iterator[pa.RecordBatch]:
    """Session, t, event and value of rows (session, frame_ms and more) that lie in order of session and time; a session may go on in the next batch."""
    states, at, key, frame, said = fresh(chain), None, None, None, []
    alike = lambda a, b: a == b or (a != a and b != b)

    def table(like: pa.Schema) -> pa.RecordBatch:
        keys, t, event, value = zip(*said, strict=True)
        said.clear()
        return pa.record_batch([pa.array(keys, like.field(0).type), pa.array(t, pa.float64()), pa.array(event, pa.string()), pa.array(value, pa.float64())], names=[like.field(0).name, "t", "event", "value"])

    like = None
    for batch in batches:
        like = batch.schema
        frame = frame or namedtuple("Frame", like.names[1:], rename=True)
        keys, *values = (c.to_pylist() for c in batch.columns)
        frames = list(map(frame._make, zip(*values, strict=True)))
        ends = [i for i in range(1, len(keys)) if not alike(keys[i - 1], keys[i])]
        for a, b in pairwise([0, *ends, len(keys)] if keys else []):
            if at is not None and not alike(key, keys[a]):
                said.append((key, *_closed(at, idle_ms)))
                states, at = fresh(chain), None
            key = keys[a]
            states, at, found = walk(chain, states, at, frames[a:b], idle_ms)
            said += [(key, *x) for x in found]
        if said:
            yield table(like)
    if at is not None:
        said.append((key, *_closed(at, idle_ms)))
        yield table(like)
