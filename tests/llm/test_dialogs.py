import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from botlog.llm import dialogs as D

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def brute_damage(rows):
    """(conv, turn, role, text) after the damage, and all conversation ids."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def brute(rows, ids):
    """By whole conversations: every way of repairing, least (cost, edits)."""
    out = {}
    for conv in set(ids):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(),
                                                                         hashlib.sha256(r[3].encode()).digest()))
        faults, seen = [], set()
        for _, _, role, text in mine:
            solid = BLANK.findall(text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[2][:1] for r in mine]

        def follows(state, c):
            return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, c))

        @lru_cache(None)
        def best(i, state, inserts):
            ways = []
            if i == len(mine):
                if state in ("", "a"):
                    ways.append((0, "", ()))
            else:
                c, e, t = best(i + 1, state, 0)
                ways.append((c + 3, "D" + e, t))
                if faults[i] not in ("blank", "duplicate"):
                    late = int(faults[i] == "truncated")
                    to = follows(state, initials[i])
                    if to:
                        c, e, t = best(i + 1, to, 0)
                        ways.append((c + late, "K" + e, (f"{mine[i][2]}:{mine[i][3]}", *t)))
                    for name in ("user", "assistant"):
                        to = follows(state, name[0])
                        if to:
                            c, e, t = best(i + 1, to, 0)
                            ways.append((c + late + 2, "R" + e, (f"{name}:{mine[i][3]}", *t)))
            if inserts < 3:
                for name in ("user", "assistant"):
                    to = follows(state, name[0])
                    if to:
                        c, e, t = best(i, to, inserts + 1)
                        ways.append((c + 2, "I" + e, (f"{name}:", *t)))
            return min(ways, default=(10 ** 9, "~", ()))

        cost, audit, text = best(0, "", 0)
        turns = {r[1] for r in mine if r[1] is not None}
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: tuple(r[1:]) for r in rows}


def made(seed, convs, most):
    rng = random.Random(seed)
    words = ["Fine.", "Why?", "No", "Go on!", "  ", "", "\n\t", "Hm. \n", "ok .", None, "é ", "a. ", "a.\x0b", "x\x85"]
    roles = ["system", "user", "assistant", "user", "assistant", "user", "assistant", "tool", "", None, "usher", "System"]
    out = []
    for c in convs:
        for t in range(rng.randint(1, most)):
            turn = None if rng.random() < 0.1 else t + rng.randint(0, 2)
            out.append((c, turn, rng.choice(roles), f"{rng.choice(words) or ''}" if rng.random() < 0.5 else f"turn {t}{rng.choice(['.', '', '!'])}"))
            if rng.random() < 0.1:
                out[-1] = (*out[-1][:3], None)
            if rng.random() < 0.15:
                out.append(rng.choice(out[-3:])[:1] + out[-1][1:])
    return out


@pytest.mark.parametrize("size", [2, 5, 1024])
def test_equals_brute_force(spark, size):
    rows = made(size, [*range(60), None], 9) + made(size + 1, [1000, 1001], 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    damaged = brute_damage(rows)
    got = found(D.repair(D.damage(df), block_rows=size))
    want = brute(damaged, [r[0] for r in rows])
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k], (k, [r for r in damaged if r[0] == k])


def test_one_conversation_of_most_rows_and_equal_rows(spark):
    rng = random.Random(3)
    hot = [(7, t, rng.choice(["user", "assistant", "tool"]), f"t {t % 150}{rng.choice(['.', ''])}") for t in range(700)]
    rows = hot + [(7, 5, "user", "same text.")] * 90 + [(8, 1, "user", "hi.")] * 40 + [(i, t, r, f"{t}.") for i in range(100, 130)
                                                                                   for t, r in enumerate(["user", "assistant"])]
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).cast("long").alias("copies")).repartition(6)
    import sys
    sys.setrecursionlimit(20_000)
    want = brute(rows, [r[0] for r in rows])
    for size in (16, 100):
        assert found(D.repair(df, block_rows=size)) == want


def test_walk_and_matrix_agree():
    rng = random.Random(1)
    for _ in range(300):
        codes = bytes(rng.randrange(9) for _ in range(rng.randint(1, 30)))
        cut = rng.randint(0, len(codes))
        v = list(D.END)
        for c in reversed(codes):
            v = list(D.back(c, tuple(v)))
        if 0 < cut < len(codes):
            a, b = D.matrix(codes[:cut]), D.matrix(codes[cut:])
            mid = [min(b[4 * s + t] + D.END[t] for t in range(4)) for s in range(4)]
            ends = [min(a[4 * s + t] + mid[t] for t in range(4)) for s in range(4)]
            # a matrix starts before the inserts of its first row, a border may insert too
            assert ends[0] == v[0]
            first, state = D.walk(codes[:cut], 0, tuple(mid))
            second, _ = D.walk(codes[cut:], state, D.END)
            assert first + second == D.walk(codes, 0, D.END)[0]


def test_dropped_empty_and_clashing(spark):
    gone = [(c, t, "user", "Hi.") for c in range(40) for t in range(20) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    got = found(D.repair(D.damage(spark.createDataFrame(gone, SCHEMA))))
    assert got and set(got.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    none = D.repair(D.damage(spark.createDataFrame([], SCHEMA)))
    assert none.count() == 0
    rows = made(9, range(20), 6)
    df = spark.createDataFrame(rows, SCHEMA)
    extra = df.withColumns({c: F.lit("x") for c in ("copies", "digest", "kind", "code", "pid", "seq", "audit", "late", "c", "first")})
    assert found(D.repair(D.damage(extra))) == found(D.repair(D.damage(df))) == brute(brute_damage(rows), [r[0] for r in rows])


def test_long_text_and_plain_cases(spark):
    long = "word " * 200_000
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello."), (2, 0, "system", "Alone."),
            (3, 0, "user", long), (3, 1, "user", "More."), (4, 0, "assistant", "First.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("copies", F.lit(1).cast("long"))
    got = found(D.repair(df))
    assert got[1][5:7] == (0, "KKK") and got[2][5:7] == (3, "D") and got[4][5:7] == (2, "IK")
    assert got == brute(rows, [r[0] for r in rows])


def test_query_on_the_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(D.op12_conversation_repair(spark, sf)) == brute(brute_damage(rows), [r[0] for r in rows])
