"""Conversation repair: the Viterbi against exhaustive search and a cost-to-go oracle, the query against the contract."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pagetrawl.llm import conversation_repair as c
from pagetrawl.llm import queries

NEXT, WANTS, NAMES = c.NEXT, c.WANTS, c.NAMES
COST = {"D": 4, "K": 0, "R": 3, "I": 3}


def options(state, role, text, fault):
    """(letters, cost, next state, lines) of one row's edits from ``state``, inserts first (at most two)."""
    out = [("D", 4, state, ())]
    if fault in "bd" and fault:
        return out
    extra = 3 if fault == "t" else 0
    firsts = [("", 0, state, ())]
    s1 = NEXT[state, WANTS[state]]
    firsts.append(("I", 3, s1, ((NAMES[WANTS[state]], ""),)))
    firsts.append(("II", 6, NEXT[s1, WANTS[s1]], ((NAMES[WANTS[state]], ""), (NAMES[WANTS[s1]], ""))))
    for pre, cost, at, lines in firsts:
        if (at, role[:1]) in NEXT:
            out.append((pre + "K", cost + extra, NEXT[at, role[:1]], lines + ((role, text),)))
        out.append((pre + "R", cost + 3 + extra, NEXT[at, WANTS[at]], lines + ((NAMES[WANTS[at]], text),)))
    return out


TAILS = {0: [("", 0, ())], 3: [("", 0, ())], 2: [("I", 3, ("a",))], 1: [("II", 6, ("u", "a"))]}


def digest(lines):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def exhaustive(rows):
    best = None

    def go(i, state, cost, audit, lines):
        nonlocal best
        if i == len(rows):
            for letters, add, roles in TAILS[state]:
                cand = (cost + add, audit + letters, lines + tuple((NAMES[r], "") for r in roles))
                if best is None or cand[:2] < best[:2]:
                    best = cand
            return
        for letters, add, to, more in options(state, *rows[i]):
            go(i + 1, to, cost + add, audit + letters, lines + more)

    go(0, 0, 0, "", ())
    return best[0], best[1], digest(best[2])


def oracle(rows):
    """Cost to go from each (row, state), then the least option at each step: exact for least audits."""
    n = len(rows)
    to_go = [dict() for _ in range(n + 1)]
    for s in range(4):
        to_go[n][s] = TAILS[s][0][1]
    for i in range(n - 1, -1, -1):
        for s in range(4):
            to_go[i][s] = min(cost + to_go[i + 1][to] for _, cost, to, _ in options(s, *rows[i]))
    state, audit, lines = 0, "", []
    for i in range(n):
        choice = min((letters, to, more) for letters, cost, to, more in options(state, *rows[i]) if cost + to_go[i + 1][to] == to_go[i][state])
        audit += choice[0]
        lines += choice[2]
        state = choice[1]
    letters, _, roles = TAILS[state][0]
    return to_go[0][0], audit + letters, digest(lines + [(NAMES[r], "") for r in roles])


ROLES = ["system", "user", "assistant", " ", "umpire", "agent"]


def random_rows(rng, n):
    return [(rng.choice(ROLES), rng.choice(["a.", "b", ""]), rng.choice(["", "", "t", "b", "d"])) for _ in range(n)]


def test_viterbi_against_exhaustive_search():
    rng = random.Random(7)
    for _ in range(400):
        rows = random_rows(rng, rng.randint(0, 6))
        assert c.repair_rows(rows)[:3] == exhaustive(rows), rows


def test_long_conversation_memory_is_bounded():
    rng = random.Random(1)
    rows = []
    for k in range(20_000):
        role = ("user", "assistant")[k % 2] if rng.random() > 0.05 else rng.choice(ROLES)
        rows.append((role, "x.", rng.choice(["", "", "", "", "t", "d"])))
    v, most = c.Viterbi(), 0
    for r in rows:
        v.row(*r)
        most = max(most, v.live)
    assert v.finish() == oracle(rows)
    assert most < 200


def damage(conv, turn, role, text):
    d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    role, text = role if role is not None else " ", text if text is not None else " "
    if d == 0:
        return []
    if d == 1:
        text = ""
    if d == 2:
        text = re.sub(r"[.!?]", "", text)
    if d == 4:
        role = "user"
    return [(turn, role, text, 0), (turn, role, text, 1)] if d == 3 else [(turn, role, text, 0)]


def contract(rows):
    """The query's rows by the contract, in plain Python."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).extend(damage(conv, turn, role, text))
    out = []
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[3]))
        turns = [r[0] for r in found if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, marked, counts, illegal = set(), [], {"b": 0, "d": 0, "t": 0}, 0
        for k, (_, role, text, _) in enumerate(found):
            if not re.search(r"[^\x20\x09-\x0D]", text):
                fault = "b"
            elif (role, text) in seen:
                fault = "d"
            elif not re.search(r"[.!?][\x20\x09-\x0D]*$", text):
                fault = "t"
            else:
                fault = ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            if k and (found[k - 1][1][:1] + role[:1]) not in ("su", "ua", "au"):
                illegal += 1
            marked.append((role, text, fault))
        cost, audit, sha = oracle(marked) if marked else (0, "", c.EMPTY_SHA)
        out.append((conv, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, sha))
    return sorted(out, key=str)


COLS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_the_contract(spark, sf):
    got = queries.op13_conversation_repair(spark, sf).select(*COLS)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == contract(rows)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "hi."), (None, 1, "user", "hi."), (5, None, "assistant", "x"),
        (5, 3, "user", "a."), (5, 3, "user", "a."), (5, 9, None, "b."), (6, 1, "system", "s."), (7, 2, "user", "z" * 50_000 + "."),
        *[(8, t, ("user", "assistant")[t % 2], f"t{t % 7}.") for t in range(300)],
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_ck", F.lit(1)).withColumn("copy", F.lit("x"))
    got = c.repair(df).select(*COLS)
    assert sorted((tuple(r) for r in got.collect()), key=str) == contract(rows)
    assert c.repair(df.limit(0)).count() == 0
