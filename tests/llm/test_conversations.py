"""Operator 13 against a plain search over all edits."""
import functools
import hashlib
import random
import re
import zlib

import pytest

from lakesonar.llm.conversations import REPORT, damaged, repaired, report

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
NAME = {"u": "user", "a": "assistant"}


def best(rows):
    """(cost, audit, turns) of the cheapest, then least, edits; rows: (role, text, must go, truncated)."""
    @functools.lru_cache(None)
    def go(i, state, inserted):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def way(cost, letter, turn, at, to, ins):
            rest = go(at, to, ins)
            if rest:
                ways.append((cost + rest[0], letter + rest[1], turn + rest[2]))
        if inserted < 3:
            for to in "ua":
                if (state, to) in NEXT:
                    way(2, "I", ((NAME[to], ""),), i, to, inserted + 1)
        if i < len(rows):
            role, text, gone, cut = rows[i]
            way(3, "D", (), i + 1, state, 0)
            if not gone:
                if (state, role[:1]) in NEXT:
                    way(cut, "K", ((role, text),), i + 1, role[:1], 0)
                for to in "ua":
                    if (state, to) in NEXT:
                        way(2 + cut, "R", ((NAME[to], text),), i + 1, to, 0)
        return min(ways) if ways else None
    return go(0, "", 0)


def brute(rows, ids):
    out = {}
    for c in ids:
        mine = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for k, t, r, x in rows if k == c))
        turns = [t for known, t, _, _ in mine if known]
        seen, faults = set(), []
        for _, _, role, text in mine:
            chars = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not chars else "dup" if (role, text) in seen else "cut" if chars[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, got = best(tuple((m[2], m[3], f in ("blank", "dup"), f == "cut") for m, f in zip(mine, faults)))
        bad = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in got).encode()).hexdigest()
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("dup"),
                  faults.count("cut"), bad, cost, audit, digest, got)
    return out


def made(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2, 3, None, 4, 5]), rng.choice([None, *range(60)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None]),
             rng.choice(["Hi.", "Why? ", "no end", "", " \t", None, "ok!", "x" * 2000 + ".", *(f"t{i}." for i in range(40))])) for _ in range(n)]


@pytest.mark.parametrize("rows_per_range", [200_000, 7])
def test_equals_search_over_all_edits(spark, rows_per_range):
    rows = made(rows_per_range, 150)
    ids = [1, 2, 3, None, 4, 5, 99]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, ids)
    got = report(df, spark.createDataFrame([(i,) for i in ids], "conv_id long"), rows_per_range)
    assert got.columns == list(REPORT)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {c: w[:8] for c, w in want.items()}
    turns = repaired(df, rows_per_range).collect()
    for c in ids:
        assert tuple((r.role, r.text) for r in sorted((t for t in turns if t.conv_id == c), key=lambda t: t.position)) == want[c][8]


def test_one_repeated_row_over_many_ranges_and_clashing_columns(spark):
    rows = [(1, 3, "user", "Go on.")] * 60 + [(1, None, "system", "Be kind.")] + [(1, 5, "assistant", f"{i}.") for i in range(30)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", ck string, num int")
    want = brute(rows, [1])
    (got,) = report(df, df, 5).collect()
    assert tuple(got)[1:] == want[1][:8]


def test_empty_table_and_no_rows_left(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert report(none, none).count() == 0 and repaired(none).count() == 0
    (r,) = report(none, spark.createDataFrame([(7,)], "conv_id long")).collect()
    assert tuple(r) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage(spark):
    rows = made(3, 200)
    got = sorted(map(tuple, damaged(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)
        want += [row] * (0 if d == 0 else 2 if d == 3 else 1)
    assert got == sorted(want, key=str)
