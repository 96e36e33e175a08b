"""Conversation repair against an exhaustive search over edits."""

import hashlib
import random
import re
import zlib

import pytest

from lumenframe.llm import turns

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        r = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if r == 0:
            continue
        text = "" if r == 1 else re.sub("[.!?]", "", text) if r == 2 else text
        out += [(conv, turn, "user" if r == 4 else role, text)] * (2 if r == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, lines) by trying all edits that cost no more than to delete everything; rows are (role, text, fault)."""
    best = [(4 * len(rows), "D" * len(rows), [])]
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}

    def go(k, last, cost, audit, lines):
        if cost > best[0][0]:
            return
        if k == len(rows) and last in ("", "a"):
            best[0] = min(best[0], (cost, audit, lines), key=lambda b: b[:2])
        for letter, name in (("u", "user"), ("a", "assistant")):
            if letter in allowed[last]:
                go(k, letter, cost + 3, audit + "I", [*lines, f"{name}:"])
        if k == len(rows):
            return
        role, text, fault = rows[k]
        go(k + 1, last, cost + 4, audit + "D", lines)
        if fault in ("blank", "duplicate"):
            return
        more = 3 if fault == "truncated" else 0
        if role[:1] and role[:1] in allowed[last]:
            go(k + 1, role[:1], cost + more, audit + "K", [*lines, f"{role}:{text}"])
        for letter, name in (("u", "user"), ("a", "assistant")):
            if letter in allowed[last]:
                go(k + 1, letter, cost + 3 + more, audit + "R", [*lines, f"{name}:{text}"])

    go(0, "", 0, "", [])
    return best[0]


def plain(rows):
    out = {}
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, flagged, n = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in mine:
            body = text.rstrip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            flagged.append((role, text, fault))
        t = [r[0] for r in mine if r[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = cheapest(flagged)
        out[conv] = (max(t) - min(t) + 1 - len(set(t)) if t else 0, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    r = turns.repair(turns.damaged(df))
    return {x.conv_id: (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit, hashlib.sha256("\n".join(x.repaired).encode()).hexdigest()) for x in r.collect()}


SCHEMA = "conv_id long, turn long, role string, text string, gone int, place int, initial string, turns string, r int, fault string, best string"


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, seed):
    r = random.Random(seed)
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", None, "", "tool", "User", "ua", "é"]
    texts = ["Hello there.", "yes!", "no", "", " \n\t", None, "A. B? C!", "x. \n", "é日本.", "a\nb.", "¿", "Hello there. "]
    rows = [(c if c else None, r.choice([None, 0, 1, 2, 3, 4, 9, -3]) if r.random() < 0.5 else k, r.choice(roles), r.choice(texts)) for c in range(150) for k in range(r.randint(1, 5))]
    rows += rows[:20]
    got = found(spark.createDataFrame([(*x, 1, 1, "x", "x", 1, "x", "x") for x in rows], SCHEMA).repartition(3))
    want = plain(rows)
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_empty_dropped_and_long(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = found(spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string"))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    rows = [(1, k, ("user", "assistant")[k % 2], f"{'long text ' * 50}{k}.") for k in range(1500)] + [(2, 0, "user", "w " * 500_000 + ".")]
    got = found(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    n = len(damage([x for x in rows if x[0] == 1]))
    assert sum(c != "I" for c in got[1][6]) == n and got[1][5] > 0
    assert got[2] == plain([x for x in rows if x[0] == 2])[2]
