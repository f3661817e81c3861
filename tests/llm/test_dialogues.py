"""Repair of conversations against a plain search over edits, in one block and in many."""

import hashlib
import heapq
import random
import zlib

import pytest

from lexiflow.llm import dialogues

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, k string, block int"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(rows):
    """Dijkstra over (cost, audit): the first end reached is the cheapest with the least audit."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        to = NEXT[state]
        for c, role in (("u", "user"), ("a", "assistant")):
            if c in to:
                heapq.heappush(heap, (cost + 3, audit + "I", i, to[c], out + ((role, ""),)))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] in to:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to[role[:1]], out + ((role, text),)))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if c in to:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, to[c], out + ((name, text),)))


def plain(table):
    result = []
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r[:4] for r in table if r[0] == conv):
            code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
            rows += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            end = text.rstrip(SPACE)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen
                          else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[0] for r in rows} - {None}
        cost, audit, out = cheapest([(r[1], r[2], f) for r, f in zip(rows, faults)])
        result.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                       *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                       sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit,
                       hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()))
    return sorted(result, key=repr)


def made(seed, conversations=120, longest=14):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "Agent", "ubuntu"])
            text = rng.choice(["Fine.", "Why?", "so", "", None, " \n", "No! ", "x" * rng.randint(1, 4) + "."])
            rows.append((conv, rng.choice([turn, turn, turn, turn // 2, None, turn * 3]), role, text, "z", 1))
    return rows


def got(spark, rows):
    return sorted(map(tuple, dialogues.digest(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def test_short(spark):
    rows = made(1) + [(None, None, None, None, None, None), (None, 3, "user", "Null id.", "z", 1),
                      (-5, 2, "user", "Long " * 300_000 + "end.", "z", 1)] + [(777, 1, "user", "Again.", "z", 1)] * 5
    assert got(spark, rows) == plain(rows)


def test_all_dropped(spark):
    conv = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(conv, 0, "user", "Gone.", "z", 1), (conv + 1, 0, "user", "x", "z", 1)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []


@pytest.mark.parametrize("block", [1, 2, 5])
def test_long(spark, monkeypatch, block):
    """Conversations of many blocks give what they give in one."""
    rng = random.Random(block)
    rows = [(c, *r[1:]) for c in range(12) for r in made(c + 50, 1, 40)]
    rng.shuffle(rows)
    rows += [(99, t, rng.choice(["user", "assistant"]), "Same.", "z", 1) for t in range(60)]     # a hot text
    monkeypatch.setattr(dialogues, "BLOCK", block)
    assert got(spark, rows) == plain(rows)


def test_real_rows(spark):
    """The operator's own output: the repaired turns with their texts."""
    from lexiflow.llm.scratch import Scratch

    rows = [(1, 0, "user", "Hi.", "z", 1), (1, 1, "user", "You there?", "z", 1), (1, 2, "assistant", "Yes", "z", 1)]
    with Scratch() as scratch:
        (piece,) = dialogues.repair(spark.createDataFrame(rows, SCHEMA), scratch).collect()
    assert [(e["edit"], e["role"], e["text"]) for e in piece["edits"]] in (
        [("D", None, None), ("K", "user", "You there?"), ("K", "assistant", "Yes")],
        [("K", "user", "Hi."), ("I", "assistant", ""), ("K", "user", "You there?"), ("K", "assistant", "Yes")])
