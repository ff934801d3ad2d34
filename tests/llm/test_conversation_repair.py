"""Conversation repair against a search over all edit sequences."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from plumbline.llm import conversation_repair as cr

SEEN = re.compile(r"[^ \t\n\x0b\x0c\r]")
SCHEMA = "conv_id long, turn long, role string, text string"


def search(rows):
    """(cost, audit, repaired turns) by exhaustive recursion over edits; rows are (role, text, fault)."""

    @cache
    def best(i, state):
        if i == len(rows):
            found = [(0, "", ())] if state in ("", "a") else []
        else:
            role, text, fault = rows[i]
            cost, audit, turns = best(i + 1, state)
            found = [(cost + 3, "D" + audit, turns)]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                for name, said, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if legal(state, said[:1]):
                        cost, audit, turns = best(i + 1, said[:1])
                        found.append((cost + price + extra, name + audit, ((said, text), *turns)))
        return min(found + inserted(i, state), key=lambda f: f[:2], default=(10**9, "", ()))

    def inserted(i, state, depth=0):
        """Up to two inserts before row i, then what the row allows."""
        if depth == 2:
            return []
        out = []
        for said in ("user", "assistant"):
            if legal(state, said[0]):
                for cost, audit, turns in base(i, said[0]) + inserted(i, said[0], depth + 1):
                    out.append((cost + 2, "I" + audit, ((said, ""), *turns)))
        return out

    def base(i, state):
        if i == len(rows):
            return [(0, "", ())] if state in ("", "a") else []
        role, text, fault = rows[i]
        cost, audit, turns = best(i + 1, state)
        found = [(cost + 3, "D" + audit, turns)]
        if fault not in ("blank", "duplicate"):
            for name, said, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                if legal(state, said[:1]):
                    cost, audit, turns = best(i + 1, said[:1])
                    found.append((cost + price + (fault == "truncated"), name + audit, ((said, text), *turns)))
        return found

    return best(0, "")


def legal(state, to):
    return (state, to) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def plain(rows):
    """Summaries by conversation, in Python."""
    out = {}
    for key in {r[0] for r in rows}:
        own = [(t, r if r is not None else " ", x if x is not None else " ") for k, t, r, x in rows if k == key]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in own:
            ending = SEEN.findall(text)
            faults.append("blank" if not ending else "duplicate" if (role, text) in seen else "truncated" if ending[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        initials = [role[:1] for _, role, _ in own]
        cost, audit, kept = search(tuple((role, text, f) for (_, role, text), f in zip(own, faults, strict=True)))
        out[key] = (key, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def conversations(r, n):
    rows = []
    for key in range(n):
        for turn in range(r.randint(1, 9)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", None])
            rows.append((key, r.choice([turn, turn, turn, None, turn // 2]), role, r.choice(["Yes.", "No!", "Why?", "so", " \t", "", None, f"Text {turn}.", "half a line\n"])))
    return rows


@pytest.mark.parametrize("long, bits", [(1024, 9), (3, 1), (1, 2)])
def test_repair_equals_a_search_over_all_edits(spark, monkeypatch, long, bits):
    monkeypatch.setattr(cr, "LONG", long)
    monkeypatch.setattr(cr, "STRETCH_BITS", bits)
    rows = [*conversations(random.Random(1), 120), *((None, t, role, "Same.") for t, role in enumerate(["user", "assistant", "user"]))]
    frame = spark.createDataFrame([(*x, 1, 2) for x in rows], f"{SCHEMA}, place long, twice long").repartition(5)
    got = {x.conv_id: tuple(x) for x in cr.repair(frame).collect()}
    assert got == plain(rows)


def test_turns_hash_to_the_digest(spark, monkeypatch):
    rows = conversations(random.Random(2), 40)
    frame = spark.createDataFrame(rows, SCHEMA)
    digest = {x.conv_id: x.repaired_sha256 for x in cr.repair(frame).collect()}
    for long in (1024, 2):
        monkeypatch.setattr(cr, "LONG", long)
        turns = {}
        for x in sorted(cr.repair(frame, turns=True).collect(), key=lambda x: (x.conv_id, x.place)):
            turns.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
            assert x.edit in "IKR"
        assert digest == {k: hashlib.sha256("\n".join(turns.get(k, [])).encode()).hexdigest() for k in digest}


def test_damage_and_query(spark, tmp_path):
    rows = conversations(random.Random(4), 200)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    hurt = []
    for k, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        c = zlib.crc32(f"{k}:{' ' if t is None else t}".encode()) % 20
        text = "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text
        hurt += [(k, t, "user" if c == 4 else role, text)] * {0: 0, 3: 2}.get(c, 1)
    want = plain(hurt)
    nothing = hashlib.sha256(b"").hexdigest()
    for key in {x[0] for x in rows} - set(want):
        want[key] = (key, 0, 0, 0, 0, 0, 0, "", nothing)
    got = {x.conv_id: tuple(x) for x in cr.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == want and any(v[-1] == nothing for v in want.values())


def test_a_hot_conversation_is_dealt_in_stretches(spark, monkeypatch):
    r = random.Random(6)
    rows = [(1, t, r.choice(["user", "assistant"]), f"Turn {t}.") for t in range(700)] + [(2, 0, "user", "x" * 300_000), (2, 1, "assistant", "Fine.")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    whole = {tuple(x) for x in cr.repair(frame).collect()}
    monkeypatch.setattr(cr, "LONG", 100)
    monkeypatch.setattr(cr, "STRETCH_BITS", 4)
    assert whole == {tuple(x) for x in cr.repair(frame).collect()}


def test_empty_table(spark):
    assert cr.repair(spark.createDataFrame([], SCHEMA)).collect() == []
