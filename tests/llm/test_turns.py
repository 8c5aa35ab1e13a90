import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from waterspark.llm import turns


def cheapest(rows):
    """(cost, audit, lines) by trying all edits from every state, row by row."""
    ways = {"": (0, "", [])}
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    long = {"u": "user", "a": "assistant"}

    def grown(ways):
        for _ in range(2):
            for state, (cost, audit, lines) in list(ways.items()):
                new = follow[state]
                made = (cost + 3, audit + "I", lines + [long[new] + ":"])
                ways[new] = min(ways.get(new, made), made)
        return ways

    for role, text, fault in rows:
        new = {}
        for state, (cost, audit, lines) in grown(dict(ways)).items():
            options = [(state, 4, "D", [])]
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                letter = role[:1]
                if letter == follow[state] or (state == "" and letter == "s"):
                    options.append((letter, extra, "K", [f"{role}:{text}"]))
                options.append((follow[state], 3 + extra, "R", [f"{long[follow[state]]}:{text}"]))
            for to, more, edit, line in options:
                made = (cost + more, audit + edit, lines + line)
                new[to] = min(new.get(to, made), made)
        ways = new
    return min(way for state, way in grown(ways).items() if state in ("", "a"))


def brute(given, damaged=True):
    convs = defaultdict(list)
    for conv, turn, role, text in given:
        convs[conv]
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        role, text = " " if role is None else role, " " if text is None else text
        if fate:
            role = "user" if fate == 4 else role
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            convs[conv] += [(turn, role, text)] * (2 if fate == 3 else 1)
    out = Counter()
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        known = {t for t, *_ in rows if t is not None}
        seen, marked = set(), []
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        count = Counter(f for *_, f in marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = cheapest(marked)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[(conv, max(known) - min(known) + 1 - len(known) if known else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha)] += 1
    return out


def run(spark, given, damaged=True, **how):
    made = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS pos", "'x' AS fate", "2 AS kind").repartition(3)
    return Counter(tuple(r) for r in turns.repair_conversations(turns.damage(made) if damaged else made, made, **how).collect())


def given(n, seed, longest):
    random.seed(seed)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", "sys", "u", None], ["Fine.", "Well!", "cut", " ", "", "No?\n", "Yes. ", "a.b", "x", None]
    rows = []
    for conv in range(n):
        for turn in range(random.randrange(1, longest)):
            role = random.choice(roles) if random.random() < 0.4 else ["user", "assistant"][turn % 2]
            text = random.choice(texts) if random.random() < 0.4 else f"Text {turn} of {conv}."
            rows.append((conv, turn if random.random() < 0.9 else None, role, text))
    return rows + rows[5:9] + [(None, 0, "user", "Hi."), (None, None, None, None), (None, 1, "assistant", "Ho."), (n + 1, None, "user", None), (n + 2, 7, "user", "éa 中 😀!")]


@pytest.mark.parametrize("damaged", [True, False])
def test_as_row_by_row(spark, damaged):
    rows = given(150, 1, 14)
    assert run(spark, rows, damaged) == brute(rows, damaged)


@pytest.mark.parametrize("bits", [0, 2])
def test_pieces_change_nothing(spark, bits):
    rows = given(40, 2, 40) + [(900, i, random.choice(["user", "assistant", "system"]), f"{i % 90}.") for i in range(300)] + [(901, 0, "user", "Again.")] * 90
    assert run(spark, rows, piece_bits=bits) == brute(rows)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.repair_conversations(empty).collect() == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert run(spark, [(dropped, 0, "user", "Hi.")]) == brute([(dropped, 0, "user", "Hi.")])


def test_least_audit_among_all():
    """Against every string of edits, for short conversations."""
    from itertools import product

    random.seed(3)
    for _ in range(150):
        kinds = np.array([random.randrange(16) for _ in range(random.randrange(1, 5))])
        zero = np.zeros(1, dtype=np.int64)
        after = turns.crossings(turns.ROWS, kinds, zero, zero + len(kinds), zero, zero + turns.END)
        before = np.append(0, after[:-1])
        audit = "".join(turns.EDITS[turns.ROWS.order[k, s, t]] for k, s, t in zip(kinds, before, after)) + "I" * len(turns.TAIL[after[-1]])
        spent = int(turns.ROWS.cost[kinds, before, after].sum() + turns.AT_END[after[-1]])
        found = []
        for edits in product(turns.EDITS, repeat=len(kinds)):
            for tail in range(3):
                state, cost, fits = 0, 3 * tail, True
                for k, e in zip(kinds, edits):
                    _, state = turns.inserted(state, len(e) - 1)
                    cost += 3 * (len(e) - 1)
                    letter, fault = "sua?"[k & 3], k >> 2
                    if e[-1] == "D":
                        cost += 4
                        continue
                    to = turns.LEADS.get((state, letter if e[-1] == "K" else turns.FOLLOWS[state][0]))
                    if to is None or fault in (1, 2):
                        fits = False
                        break
                    state, cost = to, cost + (3 if e[-1] == "R" else 0) + (3 if fault == 3 else 0)
                if fits and turns.inserted(state, tail)[1] in (0, 3):
                    found.append((cost, "".join(edits) + "I" * tail))
        assert min(found) == (spent, audit)
