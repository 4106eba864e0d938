import numpy as np
import pytest

import corpus_pipeline
from squigspark.llm import jaccard, simhash

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def kept_ids(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (True, 0)), (d is None, d or 0))
    return sorted(-1 if no else d for no, d in best.values())


def corpus():
    """Originals with copies in which few or many words are replaced, a chain, and odd rows."""
    rng = np.random.default_rng(3)
    say = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    texts = []
    for n in (30, 60, 150, 400, 900):
        for _ in range(6):
            base = say(n)
            texts.append(base)
            for share in (0.005, 0.02, 0.03, 0.05, 0.1):
                copy = list(base)
                for at in rng.choice(n, max(1, int(share * n)), replace=False):
                    copy[at] = say(1)[0]
                texts.append(copy)
    words = say(200)
    for _ in range(25):
        words = words[8:] + say(8)
        texts.append(words)
    rows = [(int(i), " ".join(t)) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    base = rows[0][1]
    return [*rows, (1000, base.upper()), (1001, base), (1001, base), (None, base + " more"), (None, "alone here"), (1002, None), (1003, ""), (1004, "Alone  HERE"), (1005, "one two three")]


@pytest.mark.parametrize("cfg", [jaccard.JaccardConfig(), jaccard.JaccardConfig(block=700, block_sets=4, most_broadcast=0, most_collected=0)])
def test_against_brute_force(spark, cfg):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "aa", "s", 1) for i, t in rows], KIND)
    got = jaccard.deduplicate(docs, cfg)
    assert got.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == kept_ids(rows)


def test_the_stage_has_no_similar_documents_left(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "aa", "s", 1) for i, t in rows], KIND)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == kept_ids(rows)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_simhash_proposes_pairs_by_itself(spark):
    """Without any MinHash key, texts whose fingerprints are equal or two bits apart are still compared, and only similar ones merged."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 300)) for _ in range(40)]
    far = lambda a, b: (simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count()
    near = next((t, f"{t} end") for t in texts if 0 < far(t, f"{t} end") <= 2)
    twice = f"{texts[0]} {texts[0]}"  # nearly the same set, each shingle twice
    rows = [(1, near[0]), (2, near[1]), (3, texts[0]), (4, twice), *[(10 + i, t) for i, t in enumerate(texts[1:]) if t != near[0]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in jaccard.deduplicate(docs, jaccard.JaccardConfig(bands=0)).collect()}
    linked = {(3, 4)} if far(texts[0], twice) <= 2 else set()
    assert got == {i for i, _ in rows} - {2} - {b for _, b in linked}


def test_few_rounds_before_the_driver_ends_them(spark, monkeypatch):
    """Edges beyond what the driver may hold are contracted only until it can hold them, not to the last one."""
    from squigspark.llm import components

    rounds = []
    monkeypatch.setattr(components, "cut", lambda df: rounds.append(1) or df.localCheckpoint())
    path = [(i, i + 1) for i in range(400)]
    stars = [(1000 * k, 1000 * k + i) for k in range(1, 9) for i in range(1, 30)]
    edges = spark.createDataFrame(path + stars, "a long, b long")
    got = {r.node: r.root for r in jaccard.components(edges, jaccard.JaccardConfig(most_collected=400)).collect()}
    assert len(got) == 401 + 8 * 30
    groups = {}
    for node, root in got.items():
        groups.setdefault(root, set()).add(node)
    assert sorted(map(sorted, groups.values())) == sorted([list(range(401)), *[list(range(1000 * k, 1000 * k + 30)) for k in range(1, 9)]])
    assert all(root in members for root, members in groups.items())
    assert 3 <= len(rounds) <= 7
