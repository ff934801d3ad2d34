"""Repair of conversation structure by cheapest edits, as a time-major tensor program.

A conversation's rows are taken by turn (nulls first), then role, then text. A row's first fault
counts: blank, duplicate (role and text seen earlier in it), truncated (last visible character ends no
sentence). Edits are Keep (0), Rerole to user or assistant (2), Delete (3, the only one for blank and
duplicate rows) and Insert of an empty text anywhere (2); a truncated row that stays adds 1. The result
has role initials ``(s?(ua)+)?``; of equally cheap edit sequences the one whose initials are least in ASCII is taken.

Four states say what stands before a row: nothing, a system turn, a user turn, an assistant
turn. Conversations are bucketed by length, laid out time by conversation, and the costs to the end of all
of them are updated a turn at a time, from the last to the first; the stored costs then steer all traces
forward together, taking the least letter that keeps the cost.

A conversation of more than ``LONG`` rows is dealt as stretches: each stretch's costs from every state to every
state are a 4 x 4 min-plus matrix, made in parallel; their products from the end give each stretch its costs
to the end. Then one task streams the conversation stretch by stretch with the state carried over, since its
digest and its audit are sequences; it holds one stretch and the audit's letters. What a conversation hands to
a single task is 16 numbers a stretch, less than the audit, which is one cell of the result.

Defined results: null role or text is one space, a null id is a conversation of its own, a null turn stands
first and is no turn for ``gaps``. A role other than those beginning with s, u or a can only be changed or
deleted. Repeated rows are duplicates; other columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import SPACES, read, stored

#: Rows beyond which a conversation is dealt as stretches; rows of a stretch as a power of two.
LONG, STRETCH_BITS = 1024, 9
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
FAR = 1 << 28
#: States: nothing, system, user, assistant. What follows a state; what a kept letter (s, u, a, other) leads to.
FOLLOWS = np.array([2, 2, 3, 2])
KEEPS = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: Costs from each state once no row is left.
END = np.array([0, 2 * INSERT, INSERT, 0])
#: What a row allows: anything, anything at a cost, deletion; no row.
SOUND, TRUNCATED, LOST, NONE = range(4)
LETTERS = {"s": 0, "u": 1, "a": 2}
ROLES = ("", "user", "assistant")


def costs(kind: np.ndarray, letter: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """(T + 1, 4, N) least costs to the end from each state before each row, for rows (T, N) and costs ``leave`` (4, N) after the last."""
    steps, lanes = kind.shape
    back = np.empty((steps + 1, 4, lanes), np.int64)
    back[steps] = leave
    for t in reversed(range(steps)):
        after, k, a = back[t + 1], kind[t], letter[t]
        stay = np.where(k == LOST, FAR, np.where(k == TRUNCATED, CUT, 0))
        best = np.minimum(after + DELETE, after[FOLLOWS] + REROLE + stay)
        to = KEEPS[:, a]
        kept = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 0), FAR) + stay
        best = np.minimum(best, kept)
        user = np.minimum(best[2], best[3] + INSERT)
        assistant = np.minimum(best[3], best[2] + INSERT)
        first = np.minimum(best[:2], user + INSERT)
        back[t] = np.where(k == NONE, after, np.stack([*first, user, assistant]))
    return back


def trace(kind: np.ndarray, letter: np.ndarray, back: np.ndarray, entry: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, roles, exit states): letters of edits and indices of given roles in (T + 1, 3, N), of which the third slot is the row's own edit."""
    steps, lanes = kind.shape
    edits, given = np.zeros((steps + 1, 3, lanes), np.uint8), np.zeros((steps + 1, 3, lanes), np.uint8)
    lane, q = np.arange(lanes), entry.copy()

    def insert(t: int, slot: int, on: np.ndarray) -> None:
        nonlocal q
        edits[t, slot, on], given[t, slot, on] = ord("I"), FOLLOWS[q[on]] - 1
        q = np.where(on, FOLLOWS[q], q)

    for t in range(steps):
        here, after, k = back[t], back[t + 1], kind[t]
        live = k != NONE
        for slot in (0, 1):
            drop = after[q, lane] + DELETE == here[q, lane]
            insert(t, slot, live & ~drop & (here[FOLLOWS[q], lane] + INSERT == here[q, lane]))
        drop = live & (after[q, lane] + DELETE == here[q, lane])
        to = KEEPS[q, letter[t]]
        keep = live & ~drop & (k != LOST) & (to >= 0) & (after[np.maximum(to, 0), lane] + np.where(k == TRUNCATED, CUT, 0) == here[q, lane])
        change = live & ~drop & ~keep
        for on, name in ((drop, "D"), (keep, "K"), (change, "R")):
            edits[t, 2, on] = ord(name)
        given[t, 2, change] = FOLLOWS[q[change]] - 1
        q = np.where(keep, to, np.where(change, FOLLOWS[q], q))
    for slot in (0, 1):
        insert(steps, slot, last & ((q == 1) | (q == 2)))
    return edits, given, q


def laid_out(values: np.ndarray, bounds: np.ndarray, lanes: np.ndarray, steps: int, fill: int) -> np.ndarray:
    """(steps, lanes) of the values between each lane's bounds."""
    out = np.full((steps, len(lanes)), fill, np.uint8)
    n = bounds[lanes + 1] - bounds[lanes]
    lane = np.repeat(np.arange(len(lanes)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[at, lane] = values[np.repeat(bounds[lanes], n) + at]
    return out


def buckets(bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Lanes of like length: up to the same power of two."""
    power = np.ceil(np.log2(np.maximum(np.diff(bounds), 1))).astype(int)
    for p in np.unique(power):
        yield np.flatnonzero(power == p)


def repaired(kind: np.ndarray, letter: np.ndarray, bounds: np.ndarray, entry: np.ndarray, leave: np.ndarray, last: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each lane of rows ``bounds[i]:bounds[i + 1]``: (cost, exit state, edits, their rows, roles they give)."""
    out: list = [None] * (len(bounds) - 1)
    for lanes in buckets(bounds):
        steps = int((bounds[lanes + 1] - bounds[lanes]).max())
        k, a = laid_out(kind, bounds, lanes, steps, NONE), laid_out(letter, bounds, lanes, steps, 3)
        back = costs(k, a, leave[:, lanes])
        edits, given, q = trace(k, a, back, entry[lanes], last[lanes])
        flat = edits.transpose(2, 0, 1).reshape(len(lanes), -1)
        roles = given.transpose(2, 0, 1).reshape(len(lanes), -1)
        for i, lane in enumerate(lanes):
            some = np.flatnonzero(flat[i])
            out[lane] = (int(back[0][entry[lane], i]), int(q[i]), flat[i][some], bounds[lane] + some // 3, roles[i][some])
    return out


def matrices(kind: np.ndarray, letter: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(lanes, 4, 4): costs from each state before a lane to each state after it."""
    out = np.empty((len(bounds) - 1, 4, 4), np.int64)
    unit = np.full((4, 4), FAR)
    np.fill_diagonal(unit, 0)
    for lanes in buckets(bounds):
        steps = int((bounds[lanes + 1] - bounds[lanes]).max())
        k, a = (np.repeat(laid_out(x, bounds, lanes, steps, fill), 4, axis=1) for x, fill in ((kind, NONE), (letter, 3)))
        back = costs(k, a, np.tile(unit, len(lanes)))[0]
        out[lanes] = np.minimum(back.reshape(4, len(lanes), 4).transpose(1, 0, 2), FAR)
    return out


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys, with the runs' bounds, from batches in which equal keys are neighbours."""

    def bounds(table: pa.Table) -> np.ndarray:
        rows = list(zip(*(table.column(k).to_pylist() for k in keys), strict=True))
        return np.array([0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)])

    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b])
        cut = int(bounds(table)[-2])
        if held and any(held[-1].column(k)[-1].as_py() != table.column(k)[0].as_py() for k in keys):
            done, held = pa.concat_tables(held), []
            yield done, bounds(done)
        if cut:
            done, held = pa.concat_tables([*held, table.slice(0, cut)]), []
            yield done, bounds(done)
        held.append(table.slice(cut))
    if held:
        done = pa.concat_tables(held)
        yield done, bounds(done)


class Conversation:
    """What is known of a conversation while its stretches pass by."""

    def __init__(self, key: object):
        self.key, self.state, self.cost, self.n_out, self.audit, self.digest = key, 0, None, 0, [], hashlib.sha256()
        self.faults, self.illegal, self.letter, self.turns, self.turn, self.low = np.zeros(3, np.int64), 0, None, 0, None, None

    def pass_by(self, fault: np.ndarray, letter: np.ndarray, turns: list) -> None:
        self.faults += np.bincount(fault, minlength=4)[1:4]
        seen = letter if self.letter is None else np.concatenate([[self.letter], letter])
        pair = seen[:-1] * 4 + seen[1:]
        self.illegal += int((~np.isin(pair, (1, 6, 9))).sum())  # su, ua, au
        self.letter = letter[-1]
        for t in turns:
            if t is not None and t != self.turn:
                self.low, self.turn, self.turns = t if self.low is None else self.low, t, self.turns + 1

    def edit(self, edits: np.ndarray, at: np.ndarray, given: np.ndarray, roles: list[str], texts: list[str]) -> list[tuple[int, str, str, str]]:
        """The turns that stay or come, as (place, role, text, edit)."""
        self.audit.append(edits.tobytes())
        turns = []
        for e, i, g in zip(edits.tobytes().decode(), at, given, strict=True):
            if e != "D":
                role, text = ROLES[g] or roles[i], "" if e == "I" else texts[i]
                self.digest.update(f"{chr(10) if self.n_out else ''}{role}:{text}".encode())
                turns.append((self.n_out, role, text, e))
                self.n_out += 1
        return turns

    def summary(self) -> tuple:
        gaps = self.turn - self.low + 1 - self.turns if self.turns else 0
        return (self.key, gaps, *map(int, self.faults), self.illegal, self.cost, b"".join(self.audit).decode(), self.digest.hexdigest())


SUMMARY = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
TURNS = ("conv_id", "place", "role", "text", "edit")


def _walk(batches: Iterator[pa.RecordBatch], schema: pa.Schema, streamed: bool, turns: bool) -> Iterator[pa.RecordBatch]:
    """Repairs whole conversations, or the stretches of long ones one after another."""
    now: Conversation | None = None
    for table, bounds in whole_runs(batches, ["conv_id", "stretch"] if streamed else ["conv_id"]):
        keys, roles, texts, when = (table.column(c).to_pylist() for c in ("conv_id", "role", "text", "turn"))
        letter = np.array([LETTERS.get(r[:1], 3) for r in roles], np.int64)
        lane = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        twice = table.column("twice").to_numpy() if streamed else pd.DataFrame({"l": lane, "r": roles, "t": texts}).duplicated().to_numpy()
        blank, cut = table.column("blank").to_numpy(), table.column("cut").to_numpy()
        fault = np.where(blank, 1, np.where(twice, 2, np.where(cut, 3, 0)))
        kind = np.array([SOUND, LOST, LOST, TRUNCATED])[fault]
        out = []
        if not streamed:
            n = len(bounds) - 1
            got = repaired(kind, letter, bounds, np.zeros(n, np.int64), np.repeat(END[:, None], n, 1), np.ones(n, bool))
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            own = slice(a, b)
            if now is None or not streamed or keys[a] != now.key:
                if now is not None and streamed and not turns:
                    out.append(now.summary())
                now = Conversation(keys[a])
            if streamed:
                leave = np.array(table.column("leave")[int(a)].as_py(), np.int64)[:, None]
                last = np.array([table.column("last")[int(a)].as_py()])
                (found,) = repaired(kind[own], letter[own], np.array([0, b - a]), np.array([now.state]), leave, last)
                cost, now.state, edits, at, given = found
                at = at + a
            else:
                cost, _, edits, at, given = got[i]
            now.cost = cost if now.cost is None else now.cost
            now.pass_by(fault[own], letter[own], when[own])
            kept = now.edit(edits, at, given, roles, texts)
            if turns:
                out += [(now.key, *t) for t in kept]
            elif not streamed:
                out.append(now.summary())
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)
    if now is not None and streamed and not turns:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, now.summary(), strict=True))], schema=schema)


def _faults(rows: DataFrame) -> DataFrame:
    """Null roles and texts as one space, and what shows in a row by itself."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    ending = F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), (ending == "").alias("blank"), (~ending.isin(".", "!", "?")).alias("cut"))


def _stretches(rows: DataFrame) -> DataFrame:
    """Rows of long conversations with their place and stretch, whether they repeat an earlier row, and the costs after their stretch."""
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(at, at + b.num_rows, dtype=np.int64))], names=[*b.schema.names, "place"])
            at += b.num_rows

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges by the head of a text, so that no whole text is a bound; sorted by whole texts
    ranges = rows.repartitionByRange(parts, *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    placed = stored(ranges.mapInArrow(number, f"{fields}, place long").withColumn("stretch", F.shiftright("place", STRETCH_BITS)), "long-conversations")
    narrow = placed.select("conv_id", "stretch", "place", "role", F.sha2("text", 256).alias("said"), "blank", "cut")
    first = stored(narrow.groupBy("conv_id", "role", "said").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("conv_id", "_conv").drop("n"), "long-repeats")
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    marked = narrow.join(first, same & (narrow.role == first.role) & (narrow.said == first.said), "left")
    twice = F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("twice")
    marked = stored(marked.select("conv_id", "stretch", "place", narrow.role, "blank", "cut", twice), "long-marks")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_runs(batches, ["conv_id", "stretch"]):
            letter = np.array([LETTERS.get(r[:1], 3) for r in table.column("role").to_pylist()], np.int64)
            lost = table.column("blank").to_numpy() | table.column("twice").to_numpy()
            kind = np.where(lost, LOST, np.where(table.column("cut").to_numpy(), TRUNCATED, SOUND))
            m = matrices(kind, letter, bounds)
            heads = table.select(["conv_id", "stretch"]).take(bounds[:-1]).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*heads.columns, pa.array(list(m.reshape(len(m), 16)), pa.list_(pa.int64()))], names=["conv_id", "stretch", "m"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    shape = f"conv_id {kind}, stretch long, m array<bigint>"
    by = ["conv_id", "stretch", "place"]
    measured = marked.repartition("conv_id", "stretch").sortWithinPartitions(*by).mapInArrow(measure, shape)

    def leave(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("stretch")
        after, out = END, []
        for m in reversed(group["m"].tolist()):
            out.append(after)
            after = (np.array(m).reshape(4, 4) + after[None, :]).min(1)
        return pd.DataFrame({"_conv": group["conv_id"], "_stretch": group["stretch"], "leave": out[::-1], "last": np.arange(len(group)) == len(group) - 1})

    left = stored(measured.groupBy("conv_id").applyInPandas(leave, f"_conv {kind}, _stretch long, leave array<bigint>, last boolean"), "long-costs")
    marks = stored(marked.join(left, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("stretch") == F.col("_stretch"))).select(F.col("place").alias("_place"), "twice", "leave", "last"), "long-leaves")
    return placed.join(marks, F.col("place") == F.col("_place")).drop("_place")


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", turns: bool = False) -> DataFrame:
    """A row for each conversation (``SUMMARY``), or with ``turns`` its repaired turns (``TURNS``)."""
    rows = _faults(rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")))
    kind = rows.schema["conv_id"].dataType.simpleString()
    fields = ["place long", "role string", "text string", "edit string"] if turns else [*(f"{c} long" for c in SUMMARY[1:7]), "audit string", "repaired_sha256 string"]
    shape = ", ".join([f"conv_id {kind}", *fields])
    schema = pa.schema([pa.field("conv_id", pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()), *(pa.field(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in fields)])
    long = stored(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LONG).select(F.col("conv_id").alias("_conv")), "long")
    some = long.limit(1).count() > 0
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    short = rows.join(long, same, "left_anti") if some else rows
    out = short.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").mapInArrow(lambda batches: _walk(batches, schema, False, turns), shape)
    if some:
        dealt = _stretches(rows.join(long, same, "left_semi")).repartition("conv_id").sortWithinPartitions("conv_id", "place")
        out = out.unionByName(dealt.mapInArrow(lambda batches: _walk(batches, schema, True, turns), shape))
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with faults that a hash of conversation and turn chooses."""
    space = F.lit(" ")
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    chance = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))) % 20
    text = F.when(chance == 1, F.lit("")).when(chance == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(chance == 4, F.lit("user")).otherwise(role)
    copies = F.when(chance == 0, 0).when(chance == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_")).drop("_")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    got = repair(damaged(rows)).withColumnRenamed("conv_id", "_conv")
    ids = rows.select("conv_id").distinct()
    found = ids.join(got, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in SUMMARY[1:7]]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
