"""The chain of live detectors: rules, and the stream equal to the batch in any order of arrival."""

import random

import pytest

from plumbline.streaming import cues

SCHEMA = "session string, at timestamp, up boolean, line boolean, fault string, framing string, edges array<string>, inverted boolean, recording boolean, inference_ms double"


def ask(s, t, said=(), framing=None, inverted=True, up=True, recording=False, edges=None, **settings):
    return [e for e, _ in cues.decide(s, t, list(said), framing, edges, inverted, up, recording, cues.Settings(**settings))]


def test_line_outranks_and_up_waits_its_turn():
    s = cues.Cues()
    assert ask(s, 0.0, [("up", 0.0)]) == ["cue_up"]
    assert ask(s, 0.4, [("line_achieved", 0.4), ("fault_bent", 1.0)]) == []
    assert ask(s, 1.0) == ["cue_line"] and s.form is None
    assert ask(s, 5.0, [("time_mark", 5.0)]) == ["cue_mark"]
    assert ask(s, 5.5, [("time_mark", 10.0)]) == [] and ask(s, 8.0) == ["cue_mark"]
    assert ask(s, 12.0, [("line_lost", 7.0), ("fault_bent", 1.0)]) == ["cue_form_bent"]
    assert ask(s, 12.5, [("fault_hips", 1.0)]) == [] and ask(s, 13.0, up=False) == [] and ask(s, 20.0) == []


def test_hints_wait_after_an_inversion_and_repeat_slowly():
    s = cues.Cues()
    off = {"framing": "tooSmall", "inverted": False, "up": False}
    assert ask(s, 0.0, **off) == ["cue_come_closer"]
    assert ask(s, 5.0, **off) == [] and ask(s, 8.0, **off) == ["cue_come_closer"]
    assert ask(s, 12.0, framing="multiplePeople", inverted=False, up=False) == ["cue_only_you"]
    assert ask(s, 14.0, framing="ok", inverted=False, up=False) == []
    ask(s, 15.0, framing="tooSmall", inverted=True)
    assert ask(s, 20.0, **off) == [] and ask(s, 21.4, **off) == [] and ask(s, 21.5, **off) == ["cue_come_closer"]
    assert ask(s, 24.5, framing="ok", inverted=False, up=False) == ["cue_ready"]
    assert ask(s, 40.0, framing="tooSmall", inverted=False, up=False, recording=True) == []


def test_what_is_switched_off_leaves_nothing_behind():
    s = cues.Cues()
    ask(s, 0.0, [("up", 0.0)])
    ask(s, 0.2, [("line_achieved", 0.2), ("time_mark", 5.0)])
    assert ask(s, 2.0, voice=False) == [] and ask(s, 3.0) == []
    ask(s, 3.1, [("time_mark", 5.0)], marks=False)
    assert ask(s, 9.0) == []


def test_rate_halves_after_a_whole_window():
    s = cues.Rate()
    got = [(t / 10, v) for t in range(100) for _, v in cues.rate_step(s, t / 10, 100.0)]
    assert got == [(2.0, 5.0), (4.1, 4.0)] and s.fps == 4.0
    s = cues.Rate()
    assert [x for t in range(100) for x in cues.rate_step(s, t / 10, 80.0)] == []


def frames(seed):
    r = random.Random(seed)
    rows = []
    for name, start in (("s1", 1_000), ("s2", 1_004), ("s1", 1_200)):
        for i in range(200):
            up, line = i % 90 > 20, i % 90 > 40
            framing = r.choice(["ok", "tooSmall", None]) if not up else None
            rows.append((name, start + i / 5, up, line, "bent" if up and not line and i % 3 else None, framing, [], up, False, r.choice([70.0, 150.0, None])))
    return rows


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_equals_batch_in_any_order(spark, tmp_path, shuffled):
    import datetime as dt

    stamp = lambda t: dt.datetime.fromtimestamp(t, dt.timezone.utc)
    rows = [(n, stamp(t), *rest) for n, t, *rest in frames(3)]
    df = spark.createDataFrame(rows, SCHEMA).cache()
    batch = sorted(tuple(x) for x in cues.session_events(df, "session", "at", idle_s=60.0).collect())
    assert sum(x[2] == "closed" for x in batch) == 3 and {"cue_line", "cue_up", "cue_mark", "rate"} <= {x[2] for x in batch}
    # parts of eight seconds; shuffled ones hold rows that are up to eight seconds early or late
    r = random.Random(1)
    part = lambda x: int((x[1].timestamp() + (r.uniform(-4, 4) if shuffled else 0)) // 8)
    parts = {}
    for x in rows:
        parts.setdefault(part(x), []).append(x)
    end = [("z", stamp(5_000.0), False, False, None, None, [], False, False, None), ("z", stamp(5_100.0), False, False, None, None, [], False, False, None)]
    late = [("s2", stamp(1_010.0), True, True, None, None, [], True, False, None)]
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        (tmp_path / "in").mkdir()
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = cues.session_events(stream, "session", "at", delay="10 seconds", idle_s=60.0)
        q = out.writeStream.format("memory").queryName(f"cues_{shuffled}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        for k in sorted(parts):
            spark.createDataFrame(parts[k], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            if k % 12 == 0:
                q.processAllAvailable()
        q.processAllAvailable()
        for x in end:
            spark.createDataFrame([x], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q.processAllAvailable()
        spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.unset(provider)
    got = sorted(tuple(x) for x in spark.sql(f"select * from cues_{shuffled} where session <> 'z'").collect())
    assert got == batch


def test_a_batch_is_walked_without_a_pandas_group_a_session(spark, monkeypatch):
    import datetime as dt

    from pyspark.sql import GroupedData

    monkeypatch.setattr(GroupedData, "applyInPandas", None)
    r = random.Random(2)
    # neighbours have one time; the number says which goes first
    rows = [(n, dt.datetime.fromtimestamp(int(t / 0.4) * 0.4, dt.timezone.utc), *rest, i) for i, (n, t, *rest) in enumerate(frames(7))]
    rows += [(None, *x[1:-1], len(rows) + i) for i, x in enumerate(rows[:50])] + [("s3", None, *rows[0][2:])]
    df = spark.createDataFrame(r.sample(rows, len(rows)), f"{SCHEMA}, i long").repartition(3)
    found = sorted(map(tuple, cues.session_events(df, "session", "at", idle_s=60.0, tie="i").collect()), key=str)
    frame = type("Frame", (tuple,), {c: property(lambda f, k=k: f[k]) for k, c in enumerate(("frame_ms", *cues.FRAME))})
    want = []
    for s in ("s1", "s2", None):
        own = [frame((round(x[1].timestamp() * 1000), *x[2:])) for x in sorted((x for x in rows if x[0] == s and x[1]), key=lambda x: (x[1], x[-1]))]
        _, at, said = cues.walk(cues.CHAIN, cues.fresh(cues.CHAIN), None, own, 60_000)
        want += [(s, *x) for x in (*said, cues._closed(at, 60_000))]
    assert found == sorted(want, key=str) and sum(x[2] == "closed" for x in found) == 4


@pytest.mark.parametrize("size", [1, 3, 70])
def test_sessions_go_on_from_batch_to_batch(size):
    import pyarrow as pa

    rows = sorted(((n, int(t * 1000), *rest) for n, t, *rest in frames(5)), key=lambda x: x[:2])
    table = pa.table(dict(zip(("session", "frame_ms", *cues.FRAME), zip(*rows, strict=True), strict=True)))
    walked = lambda n: pa.Table.from_batches(cues._walked(iter(table.to_batches(max_chunksize=n)), cues.CHAIN, 60_000)).combine_chunks()
    assert walked(size).equals(walked(10_000)) and walked(size)["event"].to_pylist().count("closed") == 3
