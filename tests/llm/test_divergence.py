"""Source divergence against plain arithmetic in Python's whole numbers."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from squigspark.llm import divergence
from squigspark.llm.divergence import DivergenceConfig


def expected(rows, cfg):
    words = {}
    docs = {}
    for text, lang, source in rows:
        t = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        words.setdefault((lang or "", source or ""), Counter()).update(t)
        docs.setdefault(lang or "", Counter()).update(set(t))
    out = []
    for lang in docs:
        kept = {t for t, n in docs[lang].items() if n >= cfg.least_documents}
        groups = {s: Counter({t: n for t, n in c.items() if t in kept}) for (g, s), c in words.items() if g == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, cfg.top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(ranked)]
    return sorted(out)


def corpus():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abÀéZY日") for _ in range(rnd.randrange(1, 4))) for _ in range(60)]
    rows = [(" ".join(rnd.choices(words, weights=range(1, 61), k=rnd.randrange(0, 80))) + rnd.choice(["!", "", "_x1y", "'"]), rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "S3", "é", None, "s10"])) for _ in range(150)]
    return rows + rows[:10] + [(None, "en", "empty"), ("", "only", "a"), ("rare words here", "only", "b"), (None, None, None), ("é" * 3000 + " " + "aB " * 3000, "en", "s1")]


@pytest.mark.parametrize("changed", [{}, {"least_documents": 3, "block_terms": 5, "band_groups": 2, "held_terms": 10, "piece_bytes": 7}, {"least_documents": 1, "top": 2, "block_terms": 7, "band_groups": 1}, {"band_groups": 3}])
def test_same_as_plain(spark, changed):
    """Whatever the blocks, bands, pieces and dictionaries."""
    cfg = DivergenceConfig(**changed)
    docs = spark.createDataFrame([(*r, "own", 7) for r in corpus()], "text string, lang string, source string, term string, n int")
    got = sorted(tuple(r) for r in divergence.source_divergence(docs, cfg).collect())
    assert got == expected(corpus(), cfg)


def test_exact_division():
    rnd = random.Random(1)
    whole = [rnd.randrange(3, 9 * 10**15) for _ in range(2000)] + [1, 2, 3, 10**9]
    count = [rnd.randrange(0, w) for w in whole]
    assert divergence.scaled(np.array(count), np.array(whole)).tolist() == [1 + 10**9 * (c + 2) // w for c, w in zip(count, whole, strict=True)]


def test_pieces_cut_no_term():
    data = "ab é cde,f".encode() * 50 + b"x" * 100
    for most in (1, 3, 10, 64):
        parts = list(divergence.pieces(data, most))
        assert b"".join(parts) == data and sum((divergence.TERM.findall(p) for p in parts), []) == divergence.TERM.findall(data)


def test_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_terms_that_no_group_of_the_bands_holds():
    """Absent terms of a block count with the p of no occurrence."""
    cfg = DivergenceConfig(band_groups=1)
    row = {"lang": "x", "block": 0, "first": 0, "second": 1, "term": "", "n": 0, "total": 0, "kept": 5, "kept_n": 40, "block_terms": 5}
    table = pa.Table.from_pylist([row | {"i": 0, "own": 3}, row | {"i": 1, "own": 9}, row | {"i": 0, "own": 0, "kept": 0, "kept_n": 0, "block_terms": 0, "term": "t", "n": 3, "total": 30}])
    p = lambda c, n: 1 + 10**9 * (c + 2) // (n + 10)
    f = lambda a, b: (a - b) ** 2 // (a + b)
    assert divergence.tile(table, cfg).to_pylist() == [{"lang": "x", "kind": 0, "i": 0, "j": 1, "term": "", "value": f(p(3, 3), p(0, 9)) + 4 * f(p(0, 3), p(0, 9))}]
