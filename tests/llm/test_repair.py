"""Conversation repair: the search against every sequence of edits, and rows of every odd kind."""

import hashlib
import itertools
import random
import zlib

import pytest

from emberstream.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, there string, fault int"


def damage(rows):
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 1:
            text = ""
        elif code == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif code == 4:
            role = "user"
        if code:
            yield from [(conv, turn, role, text)] * (2 if code == 3 else 1)


def brute(rows):
    """Dijkstra over the rows' whole lattice, kept simple: the best (cost, audit, said) of each state."""
    best = {0: (0, "", ())}

    def put(into, state, value):
        if state not in into or value < into[state]:
            into[state] = value

    def insert(states):
        for _ in range(3):
            for s, (c, a, t) in list(states.items()):
                for letter, name in (("u", "user:"), ("a", "assistant:")):
                    if (s, letter) in repair.STEP:
                        put(states, repair.STEP[s, letter], (c + 3, a + "I", (*t, name)))
        return states

    for role, text, fault in rows:
        after = {}
        for s, (c, a, t) in insert(best).items():
            put(after, s, (c + 4, a + "D", t))
            if fault in ("ok", "truncated"):
                more = 3 if fault == "truncated" else 0
                if (s, role[:1]) in repair.STEP:
                    put(after, repair.STEP[s, role[:1]], (c + more, a + "K", (*t, f"{role}:{text}")))
                for letter, name in (("u", "user"), ("a", "assistant")):
                    if (s, letter) in repair.STEP:
                        put(after, repair.STEP[s, letter], (c + more + 3, a + "R", (*t, f"{name}:{text}")))
        best = after
    return min((c, a, t) for s, (c, a, t) in insert(best).items() if s in (0, 3))


def wanted(rows):
    talks = {r[0]: [] for r in rows}
    for r in damage(rows):
        talks[r[0]].append(r[1:])
    out = {}
    for conv, turns in talks.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            core = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "ok")
            seen.add((role, text))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, said = brute([(role, text, f) for (_, role, text), f in zip(turns, faults, strict=True)])
        count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def talk(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)


def got(spark, rows):
    return {r[0]: tuple(r[1:]) for r in repair.audits(repair.damaged(talk(spark, rows))).collect()}


def test_against_every_path(spark, monkeypatch):
    random.seed(11)
    said = ["Yes.", "no", "", " \t", "what?", "so it is", None, "é ü!", "a. \n"]
    roles = ["user", "assistant", "system", "tool", "", None, "umpire", "s"]
    rows = [(conv, turn, random.choice(roles[: random.choice((2, 3, 8))]), random.choice(said)) for conv in range(150) for turn in range(random.randrange(9))]
    rows += [(None, t, "user", "hi.") for t in range(4)] + [(400, None, "user", "first."), (400, None, "assistant", "then"), (400, 2, "user", "x")]
    rows += [(500, t, random.choice(roles[:3]), random.choice(said[:6])) for t in range(400)]  # several blocks
    rows += [(501, t, "system", f"{t}.") for t in range(300)] + [(502, t, "user", "same.") for t in range(300)] + [(503, 3, "user", "x.")] * 5
    assert got(spark, rows) == wanted(rows)
    monkeypatch.setattr(repair, "BLOCK", 3)
    assert got(spark, rows[:900]) == wanted(rows[:900])


def test_turns_are_those_of_the_digest(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("system", "Be brief."), ("user", "Hello?"), ("user", "Again?"), ("assistant", "cut off"), ("assistant", "")] * 3)]
    frame = repair.damaged(talk(spark, rows))
    turns = sorted(repair.repaired(frame).collect(), key=lambda r: r["place"])
    audit = repair.audits(frame).first()
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in turns).encode()).hexdigest() == audit["repaired_sha256"]
    assert [r["edit"] for r in turns] == [c for c in audit["audit"] if c != "D"]
    assert [r["place"] for r in turns] == list(range(len(turns)))


def test_nothing(spark):
    assert got(spark, []) == {} and repair.repaired(repair.damaged(talk(spark, []))).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    assert got(spark, [(9, gone, "user", "Hi.")]) == {9: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_memory_does_not_hold_what_is_decided():
    held = []
    now = repair._Conversation(lambda *turn: held.append(turn))
    for t in range(20_000):
        now.add(t, ("user", "assistant")[t % 2], f"{t}.", repair.OK)
        assert len(now.held) <= 3 * repair.BLOCK
    now.end()
    assert len(held) == 20_000 and now.cost == 0


@pytest.mark.parametrize("seed", range(3))
def test_states_that_are_dropped_are_never_better(seed):
    random.seed(seed)
    for _ in range(300):
        rows = [(random.choice("suax"), random.choice((0, 0, 0, 1, 2))) for _ in range(10)]
        one = repair.search(rows, {0: (0, "", "")}, True)
        half = repair.useful(repair.search(rows[:5], {0: (0, "", "")}, False))
        assert repair.search(rows[5:], half, True) == one
