"""Conversation repair: audits against all edit scripts, texts against plain Python, odd rows."""

import hashlib
import itertools
import random
import re

import pytest

from squigspark.llm import conversations
from squigspark.llm.conversations import BLANK, DUPLICATE, SOUND, TRUNCATED


def cheapest(rows):
    """(cost, audit) of rows (initial, fault): all scripts of edits with at most two insertions at each place."""
    best = None
    choices = [["D"] if f in (BLANK, DUPLICATE) else ["D", "K", "Ru", "Ra"] for _, f in rows]
    inserts = ["", "u", "a", "uu", "ua", "au", "aa"]
    for edits in itertools.product(*choices):
        for extra in itertools.product(inserts, repeat=len(rows) + 1):
            roles, cost, text = extra[0], 5 * len("".join(extra)), "I" * len(extra[0])
            for (initial, fault), e, x in zip(rows, edits, extra[1:], strict=True):
                cost += {"D": 2, "K": 0}.get(e, 1) + (5 if e != "D" and fault == TRUNCATED else 0)
                roles += "" if e == "D" else initial if e == "K" else e[1]
                text += e[0] + "I" * len(x)
                roles += x
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, text) < best):
                best = cost, text
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_audit_is_the_least_of_all_scripts(n):
    rnd = random.Random(n)
    for _ in range(25):
        rows = [(rnd.choice("suax"), rnd.choice([SOUND, SOUND, BLANK, DUPLICATE, TRUNCATED])) for _ in range(n)]
        assert conversations.audit(bytes(4 * "suax".index(i) + f for i, f in rows)) == cheapest(rows), rows


def stepwise(rows):
    """The same by a table from the end, for long conversations."""
    states = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    none = (10**9, "")
    best = {0: (0, ""), 1: none, 2: none, 3: (0, "")}

    def relaxed(t):
        for _ in range(3):
            t = {q: min([t[q], *((5 + t[to][0], "I" + t[to][1]) for r, to in states[q].items() if r != "s")]) for q in t}
        return t

    best = relaxed(best)
    for initial, fault in reversed(rows):
        out = {}
        for q in states:
            ways = [(2 + best[q][0], "D" + best[q][1])]
            if fault in (SOUND, TRUNCATED):
                more = 5 if fault == TRUNCATED else 0
                ways += [(more + best[to][0], "K" + best[to][1]) for r, to in states[q].items() if r == initial]
                ways += [(1 + more + best[to][0], "R" + best[to][1]) for r, to in states[q].items() if r != "s"]
            out[q] = min(ways)
        best = relaxed(out)
    return best[0]


def test_long_conversations():
    rnd = random.Random(8)
    for n in (5, 40, 300):
        for _ in range(10):
            rows = [(rnd.choice("suuaaax"), rnd.choice([SOUND] * 4 + [BLANK, DUPLICATE, TRUNCATED])) for _ in range(n)]
            assert conversations.audit(bytes(4 * "suax".index(i) + f for i, f in rows)) == stepwise(rows)


def repaired(rows):
    """All result columns of a conversation (turn, role, text) in plain Python."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    seen, coded = set(), []
    for _, role, text in rows:
        inner = text.rstrip(" \t\n\x0b\f\r")
        fault = BLANK if not inner else DUPLICATE if (role, text) in seen else TRUNCATED if inner[-1] not in ".!?" else SOUND
        seen.add((role, text))
        coded.append((role[:1] or "x", fault))
    cost, plan = stepwise(coded)
    out, at = [], 0
    for letter in plan:
        due = "user" if not out or out[-1][0][:1] in "sa" else "assistant"
        if letter == "I":
            out.append((due, ""))
            continue
        _, role, text = rows[at]
        at += 1
        if letter != "D":
            out.append((role if letter == "K" else due, text))
    turns = [t for t, _, _ in rows if t is not None]
    count = lambda f: sum(1 for _, x in coded if x == f)
    illegal = sum(1 for (a, _), (b, _) in zip(coded, coded[1:], strict=False) if a + b not in ("su", "ua", "au"))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, count(BLANK), count(DUPLICATE), count(TRUNCATED), illegal, cost, plan), out


def odd_rows():
    rnd = random.Random(4)
    texts = ["Yes.", "No!", "why?", "cut off", "cut off \t\n", "", " \x0b", None, "é", "end. ", "done.\n\n", "x" * 50_000 + ".", "\x00"]
    rows = []
    for conv in [*range(40), None]:
        for k in range(rnd.randrange(1, 9)):
            rows.append((conv, rnd.choice([k, k, k, 2 * k, None, -5]), rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "u2"]), rnd.choice(texts)))
    return rows + [(100, None, "user", "Only.")] + [(101, 3, "user", "Same.")] * 4


def test_rows_of_all_kinds(spark):
    rows = odd_rows()
    turns = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(3)
    audits = conversations.conversation_audits(turns).cache()
    got = {r.conv_id: tuple(r)[1:] for r in audits.collect()}
    out: dict = {}
    for r in conversations.repaired_turns(turns, audits, held_bytes=1000).orderBy("conv_id", "place").collect():
        out.setdefault(r.conv_id, []).append((r.role, r.text))
    digests = {r.conv_id: r.repaired_sha256 for r in conversations.repaired_digests(turns, audits).collect()}
    ids = {r[0] for r in rows}
    assert set(got) == set(digests) == ids
    for i in ids:
        row, turned = repaired([r[1:] for r in rows if r[0] == i])
        assert got[i] == row and out.get(i, []) == turned
        assert digests[i] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turned).encode()).hexdigest()
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in turned))


def test_other_ids_and_empty_table(spark):
    turns = spark.createDataFrame([("b", 1, "user", "Hi."), ("a", 1, "assistant", "Oh.")], "thread string, turn int, role string, text string")
    audits = conversations.conversation_audits(turns, "thread")
    assert sorted((r.conv_id, r.audit, r.cost) for r in audits.collect()) == [("a", "D", 2), ("b", "D", 2)]
    none = turns.filter("false").withColumnRenamed("thread", "conv_id")
    audits = conversations.conversation_audits(none)
    assert audits.count() == conversations.repaired_turns(none, audits).count() == conversations.repaired_digests(none, audits).count() == 0


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "A. B! C?") for c in range(30) for t in [*range(8), None]] + [(None, 1, None, None)]
    got = sorted(map(str, conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    expected = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if lot == 4 else role, "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text)
        expected += [row] * (0 if lot == 0 else 2 if lot == 3 else 1)
    assert got == sorted(str(r) for r in spark.createDataFrame(expected, "conv_id long, turn long, role string, text string").collect())
