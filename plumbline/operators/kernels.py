"""Folds in which every row depends on the result of the one before.

The rows of a series (a clip and joint, or a clip) lie behind one another in Arrow batches; a step of the fold is made
for all series of some batches at once. Everything that can be a window expression is one elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

#: Rows whose series are folded in one go.
FOLDED = 200_000
#: What a fold returns.
TYPES = {"boolean": BooleanType, "int": IntegerType, "double": DoubleType, "string": StringType}


def folded(df: DataFrame, keys: list[str], time: str, tie: str, fold: Callable[..., dict[str, np.ndarray]], inputs: list[str], returns: str, *scalars: float | str, most: int | None = None) -> DataFrame:
    """``df`` with the columns ``returns`` (in place of any of these names): what ``fold`` makes of lengths, inputs and scalars (doubles) of many series, which lie behind one another.

    A series' rows are in order of time, unknown times last. A scalar is a number, or a column of which the series' first row counts.
    ``most``: rows whose series are folded in one go, where it is not ``FOLDED``.
    """
    kinds = [f.split() for f in returns.split(", ")]
    new = [n for n, _ in kinds]
    sent = [f for f in df.schema.fields if f.name not in new or f.name in inputs]
    kept = [f.name for f in sent if f.name not in new]
    columns = {*inputs, *(s for s in scalars if isinstance(s, str))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_series(batches, most):
            values = {c: _numbers(rows.column(c).chunk(0)) for c in columns}
            firsts = np.flatnonzero(rows.column("_begins").to_numpy())
            single = (values[s][firsts] if isinstance(s, str) else np.full(len(firsts), float(s)) for s in scalars)
            found = fold(np.diff(firsts, append=rows.num_rows), *(values[c] for c in inputs), *single)
            fields = [_column(found[n], k) for n, k in kinds]
            yield from pa.Table.from_arrays([*(rows.column(c) for c in kept), *fields], names=[*kept, *new]).to_batches()

    # the window puts a series' rows behind one another where its keys put them already, and marks its first
    w = Window.partitionBy(*keys).orderBy(F.col(time).asc_nulls_last(), F.col(tie).asc_nulls_last())
    rows = df.select(*(f.name for f in sent), (F.row_number().over(w) == 1).alias("_begins"))
    fields = [StructField(f.name, f.dataType) for f in sent if f.name in kept] + [StructField(n, TYPES[k]()) for n, k in kinds]
    return rows.mapInArrow(run, StructType(fields))


def _whole_series(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.Table]:
    """The rows of batches as tables of one chunk, cut where a series begins; a series that is longer waits until it is whole."""
    most = most or FOLDED
    held, n, due = [], 0, most
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= due:
            rows = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.flatnonzero(rows.column("_begins").to_numpy())[-1])
            if cut:
                yield rows.slice(0, cut)
            held, n = rows.slice(cut).to_batches(), rows.num_rows - cut
            due = max(most, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def computed(df: DataFrame, keep: list[str], compute: Callable[..., dict[str, np.ndarray]], inputs: list[str], returns: str) -> DataFrame:
    """The columns ``keep`` of ``df`` and ``returns``: what ``compute`` makes of the inputs, each row by itself, of an Arrow batch at once. An input that is a struct of numbers comes as a dict."""
    kinds = [f.split() for f in returns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = compute(*(_fields(rows.column(c)) if pa.types.is_struct(rows.column(c).type) else _numbers(rows.column(c)) for c in inputs))
            fields = [_column(found[n], k) for n, k in kinds]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), *fields], names=[*keep, *(n for n, _ in kinds)])

    types = {f.name: f.dataType for f in df.schema.fields}
    fields = [StructField(c, types[c]) for c in keep] + [StructField(n, TYPES[k]()) for n, k in kinds]
    return df.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(run, StructType(fields))


def _column(values: np.ndarray | pa.Array, kind: str) -> pa.Array:
    """NaN is null; strings come as an Arrow array."""
    return values if kind == "string" else pa.array(values, {"boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64()}[kind], from_pandas=True)


def _fields(values: pa.StructArray) -> dict[str, np.ndarray]:
    return {f.name: _numbers(v) for f, v in zip(values.type, values.flatten(), strict=True)}


def _numbers(values: pa.Array) -> np.ndarray:
    """Doubles, NaN where a value is not known; truth values, false where not known."""
    if pa.types.is_boolean(values.type):
        return values.fill_null(False).to_numpy(zero_copy_only=False)
    return values.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)


def _steps(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Step by step, the series that have a row there and the places of these rows."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    shorter = -lengths[order]
    for i in range(int(lengths.max(initial=0))):
        which = order[: np.searchsorted(shorter, -i)]
        yield which, starts[which] + i


def slow_enough(lengths: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray, ok: np.ndarray, size: np.ndarray, max_speed: float) -> np.ndarray:
    """The valid rows that are not faster than max_speed from the last one of these."""
    kept = np.zeros(len(t), bool)
    last = np.full((3, len(lengths)), np.nan)
    with np.errstate(all="ignore"):
        for s, r in _steps(lengths):
            lt, lx, ly = last[:, s]
            # nothing is later, or faster, than what there is not
            fast = (t[r] > lt) & (np.hypot(x[r] - lx, y[r] - ly) / (size[s] * (t[r] - lt)) > max_speed)
            keep = ok[r] & ~fast
            kept[r] = keep
            on, at = s[keep], r[keep]
            last[0, on], last[1, on], last[2, on] = t[at], x[at], y[at]
    return kept


def between(lengths: np.ndarray, t: np.ndarray, values: list[np.ndarray], ok: np.ndarray, max_gap: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows lie between valid neighbours at most a gap apart, and the values with linear ones there."""
    n, ends = len(t), np.cumsum(lengths)
    place = np.arange(n)
    start, end = np.repeat(ends - lengths, lengths), np.repeat(ends, lengths)
    before = np.maximum.accumulate(np.where(ok, place, -1)) if n else place
    after = np.minimum.accumulate(np.where(ok, place, n)[::-1])[::-1] if n else place
    open_ = ~ok & (before >= start) & (after < end)
    before, after = np.where(open_, before, place), np.where(open_, after, place)
    with np.errstate(all="ignore"):
        gap = t[after] - t[before]
        filled = open_ & (gap > 0) & (gap <= max_gap)
        share = (t - t[before]) / gap
        return filled, [np.where(filled, v[before] + (v[after] - v[before]) * share, v) for v in values]


def smoothed(lengths: np.ndarray, t: np.ndarray, values: np.ndarray, ok: np.ndarray, size: np.ndarray, min_cutoff: float = 1.0, beta: float = 0.3, d_cutoff: float = 1.0, least_dt: float = 1e-3) -> np.ndarray:
    """The valid values after an adaptive low-pass, begun anew after every invalid row."""

    def alpha(cutoff: float | np.ndarray, dt: np.ndarray) -> np.ndarray:
        return 1 / (1 + 1 / (2 * math.pi * cutoff * dt))

    wide = np.repeat(size, lengths)
    speed, fresh = np.zeros(len(lengths)), np.ones(len(lengths), bool)
    with np.errstate(all="ignore"):
        raw = values / wide
        out = raw.copy()
        for s, r in _steps(lengths):
            good = ok[r]
            begun = fresh[s]
            speed[s[good & begun]] = 0.0
            go = good & ~begun
            on, at = s[go], r[go]
            dt = np.maximum(t[at] - t[at - 1], least_dt)
            a = alpha(d_cutoff, dt)
            speed[on] = a * (raw[at] - out[at - 1]) / dt + (1 - a) * speed[on]
            a = alpha(min_cutoff + beta * np.abs(speed[on]), dt)
            out[at] = a * raw[at] + (1 - a) * out[at - 1]
            fresh[s] = ~good
        return out * wide


def quantiles(lengths: np.ndarray, values: np.ndarray, q: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each series, the quantile of the known values by linear interpolation, and how many these are."""
    known = ~np.isnan(values)
    series, v = np.repeat(np.arange(len(lengths)), lengths)[known], values[known]
    v = np.append(v[np.lexsort((v, series))], np.nan)
    n = np.bincount(series, minlength=len(lengths))
    start, place = np.cumsum(n) - n, np.maximum(n - 1, 0) * q
    low = np.floor(place).astype(np.int64)
    below, above = v[start + low], v[np.minimum(start + low + 1, start + np.maximum(n - 1, 0))]
    return np.where(n > 0, (low + 1 - place) * below + (place - low) * above, np.nan), n


def hold_ids(lengths: np.ndarray, t: np.ndarray, holding: np.ndarray, event: np.ndarray, min_hold: float, max_break: float) -> np.ndarray:
    """SEG1, as ``runs.hold_runs`` says it in windows: the number of each row's hold, -1 for none."""
    starts = np.cumsum(lengths) - lengths
    begun, other = np.full(len(lengths), -1), np.full(len(lengths), -1)
    first, last = [], []
    for s, r in _steps(lengths):
        on, since, gap = holding[r], begun[s], other[s]
        late = (gap >= 0) & (t[r] - t[gap] > max_break)
        broke = ~on & (since >= 0) & (event[r] | late)
        if broke.any():
            first.append(since[broke])
            last.append((np.where(event[r], r, gap) - 1)[broke])
        begun[s] = np.where(on, np.where(since >= 0, since, r), np.where(broke, -1, since))
        other[s] = np.where(on | broke | (since < 0), -1, np.where(gap >= 0, gap, r))
    held = begun >= 0
    first = np.concatenate([*first, begun[held]]).astype(np.int64)
    last = np.concatenate([*last, np.where(other >= 0, other - 1, starts + lengths - 1)[held]]).astype(np.int64)
    order = np.argsort(first)
    order = order[t[last[order]] - t[first[order]] >= min_hold]
    first, size = first[order], (last - first + 1)[order] if len(order) else np.zeros(0, np.int64)
    series = np.searchsorted(starts, first, "right") - 1
    nth = np.arange(len(first)) - np.searchsorted(series, series)
    out = np.full(len(t), -1)
    out[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())] = np.repeat(nth, size)
    return out


#: The phases by their number in ``phase_states``, and that of rows which are not known.
PHASES = ("pre", "kickup", "hold", "exit", "post", "unknown")


def phase_states(lengths: np.ndarray, hold: np.ndarray, known: np.ndarray, kicks: np.ndarray, low: np.ndarray) -> np.ndarray:
    """SEG2, as ``runs.phases`` says it in windows: each row's place in ``PHASES``. ``hold``: whether a row is in one, ``kicks``: whether its hands are down and its legs rise."""
    state, out = np.zeros(len(lengths), np.int64), np.zeros(len(hold), np.int64)
    for s, r in _steps(lengths):
        was = state[s]
        now = np.where(hold[r], 2, np.where(was == 2, 3, np.where(kicks[r], 1, np.where(low[r], was, np.where(was == 0, 0, 4)))))
        state[s] = out[r] = np.where(known[r], now, was)
    return np.where(hold, 2, np.where(known, out, 5))


def majority(group: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """GEO19: the sign that most rows of the group have, its own where they tie; a row whose group is below 0 has its own."""
    inside = group >= 0
    count = lambda which: np.bincount(group[inside & which], minlength=group.max(initial=0) + 1)
    most = np.sign(count(sign > 0) - count(sign < 0))[np.maximum(group, 0)]
    return np.where(inside & (most != 0), most, sign)


def remove_speed_outliers(df: DataFrame, keys: list[str], time: str, tie: str, x: str, y: str, valid: str, scale: float | str, max_speed: float) -> DataFrame:
    """PP5: ``df`` with ``kept``: samples not faster than max_speed from the last kept one.

    ``scale`` is a number, or a column that holds one value for each series.
    """

    def fold(lengths, t, px, py, ok, size):
        return {"kept": slow_enough(lengths, t, px, py, ok, size, max_speed)}

    return folded(df, keys, time, tie, fold, [time, x, y, valid], "kept boolean", scale)


def one_euro(df: DataFrame, keys: list[str], time: str, tie: str, values: list[str], valid: str, scale: float | str, min_cutoff: float = 1.0, beta: float = 0.3, d_cutoff: float = 1.0, least_dt: float = 1e-3) -> DataFrame:
    """PP7, PP8: ``df`` with the valid values smoothed by an adaptive low-pass, begun anew after every invalid row."""
    names = [f"{c}_smooth" for c in values]

    def fold(lengths, t, ok, *rest):
        return {n: smoothed(lengths, t, v, ok, rest[-1], min_cutoff, beta, d_cutoff, least_dt) for n, v in zip(names, rest[:-1], strict=True)}

    return folded(df, keys, time, tie, fold, [time, valid, *values], ", ".join(f"{n} double" for n in names), scale)


def switch_with_hysteresis(df: DataFrame, keys: list[str], time: str, tie: str, margin: str, start: str, threshold: float, hold: float) -> DataFrame:
    """ORI8: ``df`` with ``rotated``, which changes once the margin has spoken against it, beyond the threshold, for ``hold``."""

    def fold(lengths, t, m, begins):
        firsts = np.cumsum(lengths) - lengths
        state, since = begins[firsts], np.full(len(lengths), np.nan)
        out = np.zeros(len(t), bool)
        for s, r in _steps(lengths):
            against = np.isfinite(m[r]) & (np.abs(m[r]) > threshold) & ((m[r] > 0) != state[s])
            turn = against & (t[r] - since[s] >= hold)
            since[s] = np.where(against & ~turn, np.where(np.isnan(since[s]), t[r], since[s]), np.nan)
            state[s] ^= turn
            out[r] = state[s]
        return {"rotated": out}

    return folded(df, keys, time, tie, fold, [time, margin, start], "rotated boolean")


def thin(df: DataFrame, keys: list[str], time: str, tie: str, spacing: float) -> DataFrame:
    """SRC30, SMP6: the first row and every row at least ``spacing`` after the last one kept."""

    def fold(lengths, t):
        kept, last = np.zeros(len(t), bool), np.full(len(lengths), -math.inf)
        for s, r in _steps(lengths):
            keep = t[r] - last[s] >= spacing
            kept[r] = keep
            last[s[keep]] = t[r[keep]]
        return {"_kept": kept}

    return folded(df, keys, time, tie, fold, [time], "_kept boolean").where("_kept").drop("_kept")
