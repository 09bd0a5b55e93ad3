import binascii
import collections
import functools
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripmart.llm import queries, repair

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
KEEP = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
NAMES = {"u": "user", "a": "assistant"}


def damage(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]  # noqa: B018
        cell = lambda x: " " if x is None else str(x)
        role, text = cell(role), cell(text)
        kind = binascii.crc32(f"{cell(conv)}:{cell(turn)}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain(conv, rows):
    """The digest of one conversation by a recursion over whole strings of edits."""
    known = "" if conv is None else str(conv)
    tie = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(known)}:{known}{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    rows = sorted(rows, key=tie)
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(k: int, state: str, inserted: int) -> tuple:
        """(cost, audit, lines) of what follows."""
        ways = [(0, "", ())] if k == len(rows) and state in ("", "a") else []
        if inserted < 2:
            cost, audit, lines = best(k, NEXT[state], inserted + 1)
            ways.append((cost + 2, "I" + audit, (NAMES[NEXT[state]] + ":", *lines)))
        if k < len(rows):
            cost, audit, lines = best(k + 1, state, 0)
            ways.append((cost + 3, "D" + audit, lines))
            if faults[k] not in ("blank", "duplicate"):
                more, (_, role, text) = faults[k] == "truncated", rows[k]
                if (state, role[:1]) in KEEP:
                    cost, audit, lines = best(k + 1, role[0], 0)
                    ways.append((cost + more, "K" + audit, (f"{role}:{text}", *lines)))
                cost, audit, lines = best(k + 1, NEXT[state], 0)
                ways.append((cost + more + 2, "R" + audit, (f"{NAMES[NEXT[state]]}:{text}", *lines)))
        return min(ways, key=lambda w: w[:2], default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    n = collections.Counter(faults)
    return (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def made(seed: int, n: int = 60):
    rng = random.Random(seed)
    texts = ["yes.", "no!", "Why?", "and then", "  ", "", None, "x. \n", "ÉTÉ ", "\U0001f600.", ".", "a:b\nuser:c."]
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "system", None, "", "User", "tool", "ace", "umbrella"]
    rows = []
    for conv in range(n):
        good = [(conv, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(rng.randint(0, 10))]
        bad = [(conv, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(0, 6))]
        rows += good + bad
    rows += [(None, k, "user", "null id.") for k in range(3)] + [(7000, None, None, None), (7001, None, "user", "a."), (7001, None, "user", "a.")]
    rows += [(7002, k, "user" if k % 2 == 0 else "assistant", f"{'so ' * 400}{k}.") for k in range(40)]
    rows += [(-9, k // 3, rng.choice(roles), rng.choice(texts + [f"own {k}."] * 9)) for k in range(300)]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn int, role string, text string"


def test_search_of_edits_against_all_strings():
    """Codes of short conversations: cost and least string against the recursion, and any split into blocks gives the same."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        codes = rng.choice(10, rng.integers(1, 14), p=[0.05, 0.25, 0.25, 0.05, 0.05, 0.1, 0.1, 0.05, 0.07, 0.03])
        n = len(codes)
        tail = repair._TAIL[None]
        before, edit = repair.solve(codes, np.array([0]), np.array([n]), np.array([0]), tail)

        @functools.cache
        def best(k, state):
            ways = [(2 * len(repair.TAILS[state]), repair.TAILS[state])] if k == n else []
            if k < n and codes[k] == repair.ABSENT:
                ways.append(best(k + 1, state))
            elif k < n:
                for name in repair.EDITS:
                    end = repair._after(name, state, "sua?"[codes[k] % 4])
                    if end and (codes[k] != repair.MUST_GO or name[-1] == "D"):
                        cost, rest = best(k + 1, end[1])
                        ways.append((cost + end[0] + (4 <= codes[k] < 8 and name[-1] != "D"), name + rest))
            return min(ways)

        state, audit = 0, ""
        for c, b, e in zip(codes.tolist(), before.tolist(), edit.tolist()):
            assert b == state
            for letter, state in repair.steps(c, b, e):
                audit += letter
        assert audit + repair.TAILS[state] == best(0, 0)[1]
        edges = sorted({0, n, *rng.integers(0, n + 1, 3).tolist()})
        blocks = list(itertools.pairwise(edges))
        square = [repair.forward(codes[a:b], np.zeros(4, np.int64), np.full(4, b - a), np.arange(4)) for a, b in blocks]
        for (a, b), (first, end) in zip(blocks, repair._crossings(square)):
            part = repair.solve(codes[a:b], np.array([0]), np.array([b - a]), np.array([first]), np.array([end]))
            assert part[0].tolist() == before[a:b].tolist() and part[1].tolist() == edit[a:b].tolist()


@pytest.mark.parametrize("block,partitions", [(16_384, 1), (16_384, 5), (7, 4), (1, 3)])
def test_against_brute_force(spark, block, partitions, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = made(block + partitions)
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", first int, `a.b` string, block int")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.conv_id: tuple(r)[1:] for r in repair.repair(queries.damaged(docs), F.col("there")).collect()}
        turns = collections.defaultdict(list)
        for r in repair.repaired_turns(queries.damaged(docs), F.col("there")).orderBy("block", "place").collect():
            turns[r.conv_id].append(r)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {conv: plain(conv, r) for conv, r in damage(rows).items()}
    assert {k: v[0] for k, v in want.items()} == got
    for conv, (digest, lines) in want.items():
        assert "".join(r.edit for r in turns[conv]) == digest[6]
        assert tuple(f"{r.role}:{r.text}" for r in turns[conv] if r.edit != "D") == lines


def test_empty_and_whole(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair(none).count() == repair.repaired_turns(none).count() == 0
    good = spark.createDataFrame([("c", 0, "system", "Be kind."), ("c", 1, "user", "Hi!"), ("c", 2, "assistant", "Hello."), ("d", 5, "user", "Hi?")], "conv_id string, turn long, role string, text string")
    got = {r.conv_id: (r.cost, r.audit, r.gaps) for r in repair.repair(good).collect()}
    assert got == {"c": (0, "KKK", 0), "d": (2, "KI", 0)}
