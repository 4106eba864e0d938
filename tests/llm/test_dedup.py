import itertools

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from squigspark.llm import embeddings, simhash
from squigspark.llm.components import connected_components


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(1, 2), (2, 1), (3, 3), (4, 5), (5, 6), (9, 6)], []])
def test_components(spark, edges):
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges or [], "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    want = roots(nodes, [(a, b) for a, b in edges if a != b])
    assert set(got) == nodes
    for x, y in itertools.combinations(nodes, 2):
        assert (got[x] == got[y]) == (want[x] == want[y])


def test_masks_cover():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for a, b in itertools.combinations(range(64), 2):
        assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aBÄé \t\n\x0b\x1c\x85\xa0x", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_is_sparks_hash(spark):
    assert simhash.signed(xxhash.xxh64_intdigest("zwei Wörter hier".encode(), 42)) == spark.sql("SELECT xxhash64('zwei Wörter hier') h").first().h


def linked(fps):
    edges = [(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    return roots(fps, edges)


@pytest.mark.parametrize("limit", [1, 3, 64])
def test_links_against_brute_force(spark, limit):
    rng = np.random.default_rng(limit)
    centres = rng.integers(0, 1 << 63, 6).tolist()
    fps = set(centres) | {0}
    for c in centres[:4]:
        for _ in range(40):  # walks away in steps of one or two bits: long chains and crowded buckets
            for b in rng.integers(0, 64, int(rng.integers(1, 3))).tolist():
                c ^= 1 << b
            fps.add(c)
    fps = sorted(simhash.signed(x) for x in fps)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(fps)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.fingerprint_components(rows, limit).collect()}
    want = linked(fps)
    least = {}
    for i, x in enumerate(fps):
        least[want[x]] = min(least.get(want[x], i), i)
    assert got == {x: least[want[x]] for x in fps}


def test_near_duplicates_and_odd_rows(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (3, base.upper()), (9, base + "  \n"), (7, "other text here entirely"), (1, None), (2, ""), (4, " \t "), (8, "x " * 200_000), (7, "other text here entirely"), (None, "other text here entirely"), (None, "lonely words stand alone"), (7, "second text of id seven")]
    docs = spark.createDataFrame([(i, t, i, "c") for i, t in rows], "doc_id long, text string, fp long, component_id string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[5] == by[3] == by[9] == {3}
    assert by[1] == by[2] == by[4] == {1}
    assert by[None] == {7, None} and by[8] == {8}
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "")[:6]) for r in kept.collect())
    assert ids == sorted([(3, "WORD0 "), (1, ""), (7, "other "), (8, "x x x "), (-1, "lonely"), (7, "second")])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def vectors(seed=0, dim=16, n=300):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n // 2, 3):
        x[i + 1] = x[i] + rng.normal(size=dim) * 0.05
        x[i + 2] = x[i] * 3 + rng.normal(size=dim) * rng.choice([0.1, 0.3, 0.4])
    return x


def brute(x, threshold=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return (u @ u.T >= threshold) & ~np.eye(len(x), dtype=bool)


@pytest.mark.parametrize("cfg", [embeddings.NearVectorsConfig(), embeddings.NearVectorsConfig(bucket=4, block=16, step=4, miss=1e-4)])
def test_near_vectors_against_brute_force(spark, cfg):
    x = vectors()
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_vectors(rows, cfg).collect()}
    links = brute(x)
    found, true = sum(r.n_links for r in got.values()), int(links.sum())
    assert 0.9 * true <= found <= true
    assert all(got[i].n_links <= links[i].sum() for i in got)
    if found == true:
        want = roots(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(links), strict=True)])
        for i in got:
            assert got[i].component_id == min(j for j in want if want[j] == want[i])


def test_one_crowded_group(spark):
    rng = np.random.default_rng(5)
    c = rng.normal(size=16)
    x = c + rng.normal(size=(200, 16)) * 0.02
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embeddings.near_vectors(rows, embeddings.NearVectorsConfig(bucket=8, block=32, step=16)).collect()
    assert {r.n_links for r in got} == {199} and {r.component_id for r in got} == {0}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, -0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (9, []), (2, [1.0, 0.0]), (None, [1.0, 0.01]), (10, [1e300, 1e300]), (11, [3.0, 3.0])]
    df = spark.createDataFrame([(*r, "n") for r in rows], "vec_id long, embedding array<double>, node string")
    got = embeddings.near_vectors(df).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id) for r in got}
    for i in (3, 4, 5, 6, 7, 8, 9):
        assert by[i] == (0, i)
    for i in (0, 1, 2, None):
        assert by[i] == (4, 0)
    assert by[10] == by[11] == (1, 10)
    assert embeddings.near_vectors(df.limit(0)).count() == 0
    assert embeddings.near_vectors(df.filter("vec_id = 3")).first().component_id == 3


def test_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    d = 64
    turn = embeddings.rotations(d, d, 1)
    assert np.allclose(turn @ turn.T, np.eye(d))
    errors = []
    q, v = embeddings.unit(rng.normal(size=(2, d)))
    for s in range(200):
        t = v @ embeddings.rotations(d, d, s)
        code = np.where(t >= 0, 1, -1) / np.sqrt(d)
        errors.append((q @ embeddings.rotations(d, d, s)) @ code / (code @ t) - q @ v)
    assert abs(np.mean(errors)) < 4 * np.std(errors) / np.sqrt(200)


def test_vectors_of_every_dimension_link(spark):
    x, y = vectors(1, 16, 90), vectors(2, 5, 60)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v.tolist()) for i, v in enumerate(y)]
    rows += [(2000, [1.0, 2.0, 3.0]), (2001, x[0].tolist()), (2002, [4.0]), (2003, [9.0])]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), embeddings.NearVectorsConfig(miss=1e-9)).collect()}
    assert len(got) == len(rows)
    for first, part in ((0, np.concatenate([x, x[:1]])), (1000, y)):
        links = brute(part).sum(axis=1)
        ids = [first + i if i < 90 else 2001 for i in range(len(part))]
        assert [got[i].n_links for i in ids] == links.tolist() and links.sum() > 0
    assert got[2000].n_links == 0 and got[2001].component_id == 0 and got[2003].component_id == 2002
