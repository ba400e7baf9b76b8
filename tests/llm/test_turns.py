import functools
import hashlib
import itertools
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from memstrata.llm import turns
from suite.check import compare, connect

from .helpers import FOLDER, LONG

CODES = [i + 4 * f for i in range(4) for f in range(3)]


def least(codes):
    """(cost, audit) by trying every edit at every turn and state of the grammar."""
    @functools.lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == len(codes) and state in "0a" else []

        def go(cost, letter, then):
            if then is not None:
                found.append((cost + then[0], letter + then[1]))

        want = "a" if state == "u" else "u"
        if i < len(codes):
            initial, fault = "_sua"[codes[i] & 3], codes[i] >> 2
            go(2, "D", best(i + 1, state, 0))
            if fault != 2:
                extra = 5 * (fault == 1)
                if initial == "s" and state == "0":
                    go(extra, "K", best(i + 1, "s", 0))
                go(extra + (initial != want), "K" if initial == want else "R", best(i + 1, want, 0))
        if inserted < 4:
            go(5, "I", best(i, want, inserted + 1))
        return min(found, default=None)
    return best(0, "0", 0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(CODES), max_size=9))
def test_alignment_is_the_least(codes):
    assert turns.align(bytes(codes)) == least(tuple(codes))


def test_all_short_conversations():
    for codes in itertools.chain.from_iterable(itertools.product(CODES, repeat=n) for n in range(4)):
        assert turns.align(bytes(codes)) == least(codes)


def test_long_conversation():
    rng = random.Random(3)
    codes = bytes(rng.choices(range(4), (1, 1, 8, 8))[0] + 4 * rng.choices(range(3), (8, 1, 1))[0] for _ in range(150))
    assert turns.align(codes) == least(tuple(codes))
    held = np.frombuffer(codes, np.uint8)
    assert turns.incumbent(held & 3, held >> 2) >= turns.align(codes)[0]


ROWS = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Why?"), (1, 2, "assistant", "So."), (1, 2, "assistant", "So."), (1, 2, "assistant", "So."), (1, 9, "user", "And"),
    (2, None, None, None), (2, None, "user", "a."), (2, 5, "tool", "b."), (2, 5, "tool", "c."), (2, 7, "", "d!"),
    (3, 0, "assistant", "x?  \n"), (3, 1, "user", " \t\n"), (3, 2, "user", " "), (3, 3, "assistant", "y.\u0085"), (None, 4, "user", "z."), (None, None, "assistant", "z."),
    (-5, 1, "user", LONG), (-5, 2, "assistant", LONG + "."), (6, 3, "ärger", "ü."), (6, 4, "user", "é"), (7, None, "user", "q."), (7, None, "assistant", "r."),
    *[(8, t, "user" if t % 2 else "assistant", f"line {t}.") for t in range(60)],
]
NAMES = ["code", "content", "fault", "initial", "place", "i", "fate", "copy", "cost"]


def table(spark, rows):
    schema = "conv_id long, turn long, role string, text string, " + ", ".join(f"{n} string" for n in NAMES)
    return spark.createDataFrame([(*r, *["x"] * len(NAMES)) for r in rows], schema)


def plain(rows):
    out, by = [], {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        row = (turn is not None, turn or 0, "user" if fate == 4 else role, text)
        by[conv] += [row] * (2 if fate == 3 else 1)
    for conv, held in by.items():
        digest = lambda r: hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).digest()
        held.sort(key=lambda r: (*r[:2], r[2].encode(), digest(r)))
        seen, codes, counts = set(), [], [0, 0, 0, 0]
        for _, _, role, text in held:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            counts[fault] += 1
            codes.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 0) + 4 * (0, 2, 2, 1)[fault])
        known = [r[1] for r in held if r[0]]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        cost, audit = least(tuple(codes))
        lines, i, state = [], 0, "0"
        for letter in audit:
            role, text = ("", "") if letter == "I" else held[i][2:]
            i += letter != "I"
            if letter == "D":
                continue
            want = "assistant" if state == "u" else "user"
            role = role if letter == "K" else want
            state = role[0]
            lines.append(f"{role}:{text}")
        out.append((conv, gaps, *counts[1:], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_awkward_rows(spark):
    given_rows = table(spark, ROWS)
    got = turns.repair_report(given_rows, turns.damage(given_rows)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain(ROWS)


def test_everything_dropped_and_empty(spark):
    lost = next(t for t in range(1000) if zlib.crc32(f"4:{t}".encode()) % 20 == 0)
    rows = [(4, lost, "user", "gone.")]
    given_rows = table(spark, rows)
    assert [tuple(r) for r in turns.repair_report(given_rows, turns.damage(given_rows)).collect()] == plain(rows)
    nothing = given_rows.limit(0)
    assert turns.repair_report(nothing, turns.damage(nothing)).count() == 0


def test_query(spark):
    assert compare(turns.op12(spark, FOLDER), connect(FOLDER), turns.OP12_SQL) is None
