"""Removal of repeated passages, and the run-length index below it, by brute force."""

import hashlib
import random

import numpy as np
import pytest

from squigspark.llm import runindex
from squigspark.llm.runindex import PassageConfig, RunIndex


def made(rnd, letters, base):
    a = rnd.randrange(len(base))
    t = bytearray(base[a : a + rnd.randrange(1, 60)])
    for _ in range(rnd.randrange(3)):
        t[rnd.randrange(len(t))] = rnd.choice(letters)
    return bytes(t)


@pytest.mark.parametrize("window", [3, 7, 8, 20, 50])
@pytest.mark.parametrize("letters", [b"ab", b"abc\0", b"\xc3\xa9\xff\x00"])
def test_matching_statistics(window, letters):
    rnd = random.Random(window)
    for _ in range(15):
        base = bytes(rnd.choice(letters) for _ in range(80))
        texts = list({made(rnd, letters, base) for _ in range(rnd.randrange(1, 8))})
        owners = np.array([rnd.randrange(4) for _ in texts])
        index = RunIndex(texts, owners, window)
        patterns = [made(rnd, letters, base) + b"z" * rnd.randrange(2) for _ in range(5)]
        got = [[None] * len(p) for p in patterns]
        for step, which, length, row in index.matches(patterns):
            for k, n, r in zip(which, length, row, strict=True):
                rest = patterns[k][len(patterns[k]) - step :]
                got[k][len(patterns[k]) - step] = int(n)
                if n >= window:
                    assert index.least(np.array([r]))[0] == min(o for o, t in zip(owners, texts, strict=True) if rest[:window] in t)
        for p, g in zip(patterns, got, strict=True):
            assert g == [max(n for n in range(min(window, len(p) - i) + 1) if any(p[i : i + n] in t for t in texts)) for i in range(len(p))]


def test_runs_are_few_in_repetitive_texts():
    rnd = random.Random(5)
    base = bytes(rnd.randrange(97, 123) for _ in range(2000))
    texts = [base[:i] + b"#" + base[i:] for i in range(0, 2000, 40)]
    index = RunIndex(texts, np.arange(len(texts)), 50)
    assert len(index.starts) < sum(map(len, texts)) / 10


def expected(rows, window):
    """(n_bytes, n_removed, n_spans, digest) of each row, by comparing all strings."""
    first: dict[bytes, float] = {}
    for i, t in rows:
        for a in range(len(t) - window + 1):
            s = t[a : a + window]
            first[s] = min(first.get(s, float("inf")), float("inf") if i is None else i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for a in range(len(t) - window + 1):
            if first[t[a : a + window]] < (float("inf") if i is None else i):
                gone[a : a + window] = b"\1" * window
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((-1 if i is None else i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def corpus():
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdeéü") for _ in range(rnd.randrange(1, 8))) for _ in range(300)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 120))) for _ in range(120)]
    texts += [t[: len(t) // 2] + passage + t[len(t) // 2 :] for t in texts[:30]] + texts[:10] + [None, "", "x", passage, "ab" * 300, "ba" * 200, passage[:49], passage[:50], passage[1:51]]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    return rows + rows[:5] + [(None, texts[3]), (None, "only here, in rows without an id: a text of more than fifty bytes"), (None, "only here, in rows without an id: a text of more than fifty bytes"), (500, "own " * 40)]


@pytest.mark.parametrize("changed", [{}, {"chunk_bytes": 700, "shard_bytes": 900, "leader_bytes": 64}, {"chunk_bytes": 2000, "region_windows": 5, "shard_bytes": 3000}, {"crowded": 3, "chunk_bytes": 900, "shard_bytes": 500}, {"window": 20, "gram": 9, "chunk_bytes": 1500}, {"window": 24, "gram": 24}])
def test_same_as_brute_force(spark, changed):
    """Whatever the chunks, shards, leaders and crowded anchors."""
    rows = corpus()
    cfg = PassageConfig(**changed)
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, chunk string").repartition(3)
    found = runindex.without_repeats(docs, cfg).cache()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in runindex.digests(found).collect())
    assert got == expected([(i, (t or "").encode()) for i, t in rows], cfg.window)
    for r in found.collect():
        assert len(r.kept) == r.n_bytes - sum(s.end - s.start for s in r.spans) and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def sent_regions(spark, monkeypatch, rows, cfg):
    """Rows and bytes of text that chunks send to shards; the result is held against brute force."""
    seen, covered = [], runindex.covered
    monkeypatch.setattr(runindex, "covered", lambda regions, cfg: seen.append(regions.cache()) or covered(seen[0], cfg))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in runindex.digests(runindex.without_repeats(docs, cfg)).collect())
    assert got == expected([(i, t.encode()) for i, t in rows], cfg.window)
    return seen[0].selectExpr("count(*)", "sum(length(texts))", "count(distinct chunk)").first()


def test_neighbours_of_a_crowded_line_are_not_sent(spark, monkeypatch):
    """Windows that hold a part of a common line and what stands beside it in one document only."""
    rnd = random.Random(4)
    say = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    line = say(76)
    rows = [(i, say(300) + line + say(300)) for i in range(200)]
    _, sent, _ = sent_regions(spark, monkeypatch, rows, PassageConfig(crowded=50, chunk_bytes=20_000))
    # Anchors at the line's edges win in some documents only, and are not crowded.
    assert 27 * 50 <= sent < 200 * 6 * 50


def test_many_shards_are_sent_in_groups(spark, monkeypatch):
    """A chunk's rows grow with the groups, not with the shards, whose number grows with the input."""
    rows = [(i, t) for i, t in enumerate(t for _, t in corpus() if t)]
    n, _, chunks = sent_regions(spark, monkeypatch, rows, PassageConfig(shard_bytes=900, chunk_bytes=4000, groups=2))
    assert 0 < n <= 8 * chunks


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert runindex.digests(runindex.without_repeats(docs)).collect() == []
    assert [tuple(r)[:4] for r in runindex.digests(runindex.without_repeats(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))).orderBy("doc_id").collect()] == [(1, 0, 0, 0), (2, 0, 0, 0)]
