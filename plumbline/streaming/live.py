"""Live detectors: state by session, events as they happen.

A detector is a small step function over its state; ``events`` runs it on a stream by session.
Rows of a micro-batch are put in time order; time never goes back within a session.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass
class LineState:
    """LIV1-4: when the body came up and into line, and what was said of it."""

    up_since: float | None = None
    down_since: float | None = None
    up_said: bool = False
    line_since: float | None = None
    last_line: float | None = None
    line_said: bool = False
    marks: int = 0
    at: float = float("-inf")


def line_step(s: LineState, t: float, up: bool, line: bool, onset: float = 0.5, loss: float = 0.4, up_onset: float = 0.5, up_end: float = 1.0, mark_every: float = 5.0) -> list[tuple[str, float]]:
    """Events of one frame: up once a stretch, line achieved and lost, and marks of whole times in line.

    A stretch of up ends after ``up_end`` of not up; line is lost after ``loss`` of no line, and
    the time held runs to the last frame in line.
    """
    if t < s.at:
        raise ValueError(f"time goes back from {s.at} to {t}")
    s.at = t
    out: list[tuple[str, float]] = []
    if up:
        s.down_since = None
        s.up_since = t if s.up_since is None else s.up_since
        if not s.up_said and t - s.up_since >= up_onset:
            s.up_said = True
            out.append(("up", t))
    elif s.up_since is not None:
        s.down_since = t if s.down_since is None else s.down_since
        if t - s.down_since >= up_end:
            s.up_since, s.down_since, s.up_said = None, None, False
    if line:
        s.line_since = t if s.line_since is None else s.line_since
        s.last_line = t
        if not s.line_said and t - s.line_since >= onset:
            s.line_said = True
            out.append(("line_achieved", t))
        while s.line_said and t - s.line_since >= mark_every * (s.marks + 1):
            s.marks += 1
            out.append(("time_mark", mark_every * s.marks))
    elif s.line_since is not None and t - s.last_line >= loss:
        if s.line_said:
            out.append(("line_lost", s.last_line - s.line_since))
        s.line_since, s.last_line, s.line_said, s.marks = None, None, False, 0
    return out


@dataclass
class FormState:
    """LIV9, LIV10: the attempt, the fault in progress and the last event."""

    attempt_since: float | None = None
    out_since: float | None = None
    red_since: float | None = None
    last_red: float | None = None
    fault: str | None = None
    said_at: float | None = None


def form_step(s: FormState, t: float, in_shape: bool, fault: str | None, red_hold: float = 1.0, gap: float = 0.3, gate: float = 0.5, spacing: float = 2.0, end: float = 1.0) -> list[tuple[str, float]]:
    """A fault that lasted, within an attempt and while in shape; at most one event a spacing."""
    if in_shape:
        s.out_since = None
        s.attempt_since = t if s.attempt_since is None else s.attempt_since
    elif s.attempt_since is not None:
        s.out_since = t if s.out_since is None else s.out_since
        if t - s.out_since >= end:
            s.attempt_since = s.out_since = s.red_since = s.last_red = s.fault = None
    if s.attempt_since is None:
        return []
    if fault is None:
        if s.last_red is not None and t - s.last_red >= gap:
            s.red_since = s.last_red = s.fault = None
        return []
    s.red_since = t if s.red_since is None else s.red_since
    s.last_red, s.fault = t, fault
    ready = s.said_at is None or t - s.said_at >= spacing
    if in_shape and t - s.red_since >= red_hold and t - s.attempt_since >= gate and ready:
        s.said_at = t
        return [(f"fault_{fault}", t - s.red_since)]
    return []


@dataclass
class RateState:
    """LIV18, LIV19: recent durations and the rate in force."""

    recent: list | None = None
    fps: float = 10.0


def rate_step(s: RateState, t: float, ms: float, window: float = 2.0, budget: float = 80.0, least: float = 4.0) -> list[tuple[str, float]]:
    """Halves the rate when the mean duration over the window is above the budget."""
    s.recent = [x for x in (s.recent or []) if t - x[0] < window] + [[t, ms]]
    if s.fps > least and sum(x[1] for x in s.recent) / len(s.recent) > budget:
        s.fps, s.recent = max(s.fps / 2, least), []
        return [("rate", s.fps)]
    return []


@dataclass
class CueState:
    """LIV13: when cues of each kind were last given, and what waits."""

    last: dict | None = None
    waiting: dict | None = None


# Kinds of cue by priority, and the least time since the last cue.
CUE_GAPS = {"line": 1.0, "up": 1.0, "time_mark": 3.0, "ready": 3.0, "hint": 3.0, "form": 2.0}


def cue_step(s: CueState, t: float, kinds: list[str]) -> str | None:
    """The cue to give now, if any: the first by priority; one of line, up or time mark that is not due yet holds the others back."""
    s.last, s.waiting = s.last or {}, s.waiting or {}
    for k in kinds:
        s.waiting[k] = t
    if "line" in kinds:
        s.waiting.pop("up", None)
        s.waiting.pop("form", None)
    for kind, gap in CUE_GAPS.items():
        if kind not in s.waiting:
            continue
        if t - max(s.last.values(), default=float("-inf")) >= gap:
            s.waiting.pop(kind)
            s.last[kind] = t
            return kind
        if kind in ("line", "up", "time_mark"):
            return None
        s.waiting.pop(kind)
    return None


def events(
    frames: DataFrame, session: str, time: str, inputs: list[str], new_state: type, step: Callable, delay: str = "10 minutes", event_time: str | None = None, idle: str = "1 hour"
) -> DataFrame:
    """LIV1, LIV9: session, t, event and value as the step function says, on a stream or a batch.

    ``time`` is in seconds; ``event_time``, a timestamp column of a stream, bounds how late rows may come and lets go of sessions that were
    silent for ``idle``. A row behind its session's last one is given out as ``late`` and changes nothing.
    """
    timed = frames.isStreaming and event_time is not None
    if timed:
        frames = frames.withWatermark(event_time, delay)
    schema = f"{session} {frames.schema[session].dataType.simpleString()}, t double, event string, value double"

    def of_rows(state, last: float, rows: pd.DataFrame) -> tuple[float, list[tuple[float, str, float]]]:
        out = []
        for r in rows.sort_values(time)[[time, *inputs]].itertuples(index=False):
            if r[0] < last:
                out.append((r[0], "late", r[0]))
                continue
            last = r[0]
            out += [(r[0], e, v) for e, v in step(state, *r)]
        return last, out

    def table(key: tuple, found: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *x) for x in found], columns=[session, "t", "event", "value"]).astype({"t": float, "value": float})

    if not frames.isStreaming:
        return frames.groupBy(session).applyInPandas(lambda key, rows: table(key, of_rows(new_state(), float("-inf"), rows)[1]), schema)
    idle_ms = int(pd.Timedelta(idle) / pd.Timedelta(milliseconds=1))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, held = json.loads(state.get[0]) if state.exists else (float("-inf"), None)
        s = new_state() if held is None else new_state(**held)
        rows = pd.concat(list(batches))
        last, found = of_rows(s, last, rows)
        state.update((json.dumps([last, asdict(s)]),))
        if timed:
            latest = int(pd.Timestamp(rows[event_time].max()).timestamp() * 1000)
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)
        if found:
            yield table(key, found)

    return frames.groupBy(session).applyInPandasWithState(update, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout)


@dataclass
class HintState:
    """LIV14, LIV15: the last hint and when, when the inversion ended, and whether framing was not ok."""

    last: str | None = None
    last_at: float | None = None
    inverted: bool = False
    ended_at: float | None = None
    was_off: bool = False


def framing_hint(status: str | None, edges: list[str] | None, upright: bool) -> str | None:
    """LIV16: what to say of a framing status."""
    if status == "tooSmall":
        return "come_closer"
    if status == "multiplePeople":
        return "only_you"
    if status != "partlyOutOfFrame":
        return None
    if {"left", "right"} & set(edges or []):
        return "move_to_middle"
    return "raise_phone" if list(edges or []) == ["top"] and upright else "step_back"


def hint_step(s: HintState, t: float, status: str | None, edges: list[str] | None, inverted: bool, in_line: bool, after_inversion: float = 1.5, gap: float = 4.0, repeat: float = 8.0) -> list[tuple[str, float]]:
    """LIV14, LIV15: ready when framing becomes ok; hints spaced, the same one farther apart, none just after an inversion."""
    if s.inverted and not inverted:
        s.ended_at = t
    s.inverted = inverted
    if status is None:
        return []
    was_off, s.was_off = s.was_off, status != "ok"
    if inverted:
        return []
    if status == "ok":
        return [("ready", t)] if was_off else []
    hint = framing_hint(status, edges, True)
    if hint is None or in_line or (s.ended_at is not None and t - s.ended_at < after_inversion):
        return []
    if s.last_at is not None and t - s.last_at < (repeat if hint == s.last else gap):
        return []
    s.last, s.last_at = hint, t
    return [(f"hint_{hint}", t)]
