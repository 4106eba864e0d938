"""Repair of conversations: the cheapest edits that give one optional system turn, then user and assistant in turn.

A conversation's rows stand in the order of turn (null first), role and the SHA-256 of the text.  A row is blank
(no character but white space), else a duplicate (role and text stand earlier in the conversation), else
truncated (the last character that is no white space is none of ``.!?``), else sound.  Edits, by their initials:
Delete costs 2, Insert (an empty user or assistant turn) 5, Keep 0, Rerole (to user or assistant) 1; a truncated
row that stays costs 5 more, blank rows and duplicates must go.  Roles count by their initials s, u and a.

1. Rows are judged and given a code by DataFrame functions; texts stay behind.  One shuffle by conversation
   serves the search for duplicates and the order of the rows.
2. Tasks stream the codes, a byte a row.  Places between rows and states of the pattern are the nodes of
   a graph whose arcs cost 0 to 6.  Dial's buckets give each node's distance to the end: seven lists used in turn
   replace a heap.  Distances are recorded; a walk from the start over tight arcs, of the arcs that lie on a
   cheapest way the one of the ASCII-least initial, writes the audit.
3. For repaired turns and their digests the texts are streamed once more, behind their conversation's audit.

A conversation is met in one task, as its audit and digest are single values, but only its codes, distances and
audit are held (four distances of eight bytes a row, and what the search's buckets hold), never its texts.

Defined results: null role and text are one space.  Rows with a null conversation are one conversation.  Gaps count
missing turns between the least and the greatest, nulls aside.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

SPACE = " \t\n\x0b\f\r"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, after system, after user, after assistant.  By state: where each initial leads.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: By state: the role that an inserted or renamed turn gets.
NEXT_ROLE = ("user", "user", "assistant", "user")
INITIALS = "sua"
DELETE, INSERT, RENAME, STAYS_TRUNCATED = 2, 5, 1, 5
BUCKETS = 1 + RENAME + STAYS_TRUNCATED
REMEMBERED = 64  # rows of a conversation whose audit a worker may remember


def arcs(codes: bytes, place: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(initial, cost, next place, next state) of each edit, in the order of initials."""
    onward = MOVES[state][NEXT_ROLE[state][0]]
    row = codes[place] if place < len(codes) else None
    if row is not None:
        yield "D", DELETE, place + 1, state
    yield "I", INSERT, place, onward
    if row is not None and row % 4 in (SOUND, TRUNCATED):
        more = STAYS_TRUNCATED if row % 4 == TRUNCATED else 0
        kept = MOVES[state].get(INITIALS[row // 4 : row // 4 + 1])
        if kept is not None:
            yield "K", more, place + 1, kept
        yield "R", RENAME + more, place + 1, onward


def reverse_arcs(codes: bytes, place: int, state: int) -> Iterator[tuple[int, int, int]]:
    """(cost, place, state) from which an edit leads here."""
    sources = [q for q in range(4) if MOVES[q][NEXT_ROLE[q][0]] == state]
    for q in sources:
        yield INSERT, place, q
    if place:
        row = codes[place - 1]
        yield DELETE, place - 1, state
        if row % 4 in (SOUND, TRUNCATED):
            more = STAYS_TRUNCATED if row % 4 == TRUNCATED else 0
            initial = INITIALS[row // 4 : row // 4 + 1]
            for q in range(4):
                if MOVES[q].get(initial) == state:
                    yield more, place - 1, q
            for q in sources:
                yield RENAME + more, place - 1, q


def distances(codes: bytes) -> array:
    """Cost from each node (4 * place + state) to the end, by Dial's buckets."""
    n = len(codes)
    found = array("q", [-1]) * (4 * (n + 1))
    buckets: list[list[int]] = [[] for _ in range(BUCKETS)]
    buckets[0] = [4 * n + q for q in ENDS]
    held, at = len(ENDS), 0
    while held:
        bucket = buckets[at % BUCKETS]
        while bucket:
            node = bucket.pop()
            held -= 1
            if found[node] >= 0:
                continue
            found[node] = at
            for cost, place, state in reverse_arcs(codes, *divmod(node, 4)):
                if found[4 * place + state] < 0:
                    buckets[(at + cost) % BUCKETS].append(4 * place + state)
                    held += 1
        at += 1
    return found


def audit(codes: bytes) -> tuple[int, str]:
    """Least cost, and of the cheapest edits' initials the ASCII-least."""
    far = distances(codes)
    place, state, out = 0, 0, bytearray()
    while place < len(codes) or far[4 * place + state]:
        letter, _, place, state = next(a for a in arcs(codes, place, state) if far[4 * place + state] == a[1] + far[4 * a[2] + a[3]])
        out += letter.encode()
    return far[0], out.decode()


@lru_cache(1 << 16)
def remembered_audit(codes: bytes) -> tuple[int, str]:
    return audit(codes)


def _plain(turns: DataFrame, key: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select(F.col(key).alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text")).withColumn("digest", F.sha2("text", 256))


def _maker(turns: DataFrame, key: str, columns: str) -> tuple[Callable[[list[tuple]], pa.RecordBatch], str]:
    """Batches of rows that begin with the conversation's id, and their schema."""
    ddl = f"conv_id {turns.schema[key].dataType.simpleString()}, {columns}"
    names = [c.split()[0] for c in ddl.split(", ")]
    kinds = [to_arrow_type(turns.schema[key].dataType), *[{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in columns.split(", ")]]
    return lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names), ddl


def conversation_audits(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row for each conversation of ``turns``."""
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    cut_off = ~F.right(end, F.lit(1)).isin(".", "!", "?")
    rows = _plain(turns, key).select("conv_id", "turn", "role", "digest", (F.length(end) == 0).alias("blank"), cut_off.alias("cut_off")).repartition("conv_id")
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("turn")) > 1
    fault = F.when(F.col("blank"), BLANK).when(earlier, DUPLICATE).when(F.col("cut_off"), TRUNCATED).otherwise(SOUND)
    kind = F.pmod(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - F.lit(1), F.lit(4))
    kind = F.when(F.length("role") == 0, 3).otherwise(kind)
    coded = rows.withColumn("code", (4 * kind + fault).cast("byte")).sortWithinPartitions("conv_id", "turn", "role", "digest").select("conv_id", "turn", "code")
    batch_of, ddl = _maker(turns, key, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")

    def finished(own: object, codes: bytes, least: int | None, most: int | None, distinct: int) -> tuple:
        faults, kinds = codes.translate(_FAULTS), codes.translate(_KINDS)
        legal = sum(1 for p in zip(kinds, kinds[1:], strict=False) if p in _LEGAL)
        cost, text = (remembered_audit if len(codes) <= REMEMBERED else audit)(codes)
        gaps = most - least + 1 - distinct if distinct else 0
        return own, gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), len(codes) - 1 - legal, cost, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, codes, least, most, distinct, out = None, bytearray(), None, None, 0, []
        for batch in batches:
            for conv, turn, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if codes and conv != own:
                    out.append(finished(own, bytes(codes), least, most, distinct))
                    codes.clear()
                    least, most, distinct = None, None, 0
                    if len(out) == 10_000:
                        yield batch_of(out)
                        out = []
                own = conv
                codes.append(code)
                if turn is not None and turn != most:
                    least, most, distinct = turn if least is None else least, turn, distinct + 1
        if codes:
            out.append(finished(own, bytes(codes), least, most, distinct))
        if out:
            yield batch_of(out)

    return coded.mapInArrow(run, ddl)


_FAULTS = bytes(i % 4 for i in range(256))
_KINDS = bytes(ord("suax"[i // 4 % 4]) for i in range(256))
_LEGAL = {tuple(p) for p in (b"su", b"ua", b"au")}


def _behind_audits(turns: DataFrame, audits: DataFrame, key: str) -> DataFrame:
    """Each conversation's audit, then its rows in order."""
    rows = _plain(turns, key).select("conv_id", F.lit(1).alias("part"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "digest")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("digest", "string"))]
    heads = audits.select("conv_id", F.lit(0).alias("part"), "audit", *none)
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "digest").select("conv_id", "audit", "role", "text")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, str | None, str | None, str | None]]:
    """(0, conversation, ...) where one begins, then (1, conversation, role, text, initial) for each turn that it has in the end."""
    own, todo, at, state = None, "", 0, 0

    def put(role: str, text: str, letter: str) -> tuple:
        nonlocal state
        state = MOVES[state][role[0]]
        return 1, own, role, text, letter

    def inserted(until: int) -> Iterator[tuple]:
        nonlocal at
        while at < until and todo[at] == "I":
            at += 1
            yield put(NEXT_ROLE[state], "", "I")

    for batch in batches:
        for conv, plan, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if plan is not None:
                yield from inserted(len(todo))
                own, todo, at, state = conv, plan, 0, 0
                yield 0, own, None, None, None
                continue
            yield from inserted(len(todo))
            letter = todo[at]
            at += 1
            if letter != "D":
                yield put(role if letter == "K" else NEXT_ROLE[state], text, letter)
    yield from inserted(len(todo))


def repaired_turns(turns: DataFrame, audits: DataFrame, key: str = "conv_id", held_bytes: int = 4 << 20) -> DataFrame:
    """(conv_id, place, role, text, edit): the turns that each conversation has after its audit's edits."""
    batch_of, ddl = _maker(turns, key, "place long, role string, text string, edit string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, place = [], 0, 0
        for part, conv, role, text, letter in _repaired(batches):
            if part == 0:
                place = 0
                continue
            rows.append((conv, place, role, text, letter))
            place += 1
            held += 32 + len(text)
            if held > held_bytes:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return _behind_audits(turns, audits, key).mapInArrow(run, ddl)


def repaired_digests(turns: DataFrame, audits: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, repaired_sha256): of ``role:text`` of the repaired turns, joined by line feeds."""
    batch_of, ddl = _maker(turns, key, "repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, own, digest, first = [], None, None, True
        for part, conv, role, text, _ in _repaired(batches):
            if part == 0:
                if digest is not None:
                    rows.append((own, digest.hexdigest()))
                if len(rows) == 10_000:
                    yield batch_of(rows)
                    rows = []
                own, digest, first = conv, hashlib.sha256(), True
                continue
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        if digest is not None:
            rows.append((own, digest.hexdigest()))
        if rows:
            yield batch_of(rows)

    return _behind_audits(turns, audits, key).mapInArrow(run, ddl)


def damaged(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) with faults by the CRC-32 of ``conv_id:turn``, nulls written as a space.

    Of twenty remainders, 0 drops a row, 1 empties its text, 2 takes out its ``.!?``, 3 repeats it and 4 makes it the user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(space(key), F.lit(":"), space("turn"))) % 20
    rows = turns.select(F.col(key).alias("conv_id"), "turn", space("role").alias("role"), space("text").alias("text"), lot.alias("lot")).filter("lot <> 0")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("lot") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")
