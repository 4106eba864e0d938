import numpy as np
import pytest

import corpus_pipeline
from squigspark.llm import decontaminate, jaccard, langid, queries, secrets

KIND = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"aa": ["the", "thing", "with", "and", "other"], "bb": ["der", "und", "schein", "nicht", "immer"]}
ITEM = "which river flows past the old mill near the green hill. the slow one"


def documents():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        lang = "ab"[i % 2] * 2
        rows.append((i, " ".join(rng.choice(WORDS[lang], int(rng.integers(20, 60)))), lang))
    base = rows[4][1]
    rows += [(200, base, "aa"), (201, base.upper(), None), (202, "12345 !!", "aa"), (203, None, "aa"), (204, "", None)]
    rows += [(205, f"{rows[6][1]} {ITEM} {rows[8][1]}", "aa"), (206, rows[10][1] + ' and token = "abc123xyz789"', "aa"), (None, rows[12][1] + " und", "bb"), (207, rows[5][1], "bb"), (207, rows[5][1], "bb")]
    rows.append((208, " ".join(rows[14][1].split()[::-1]) + ' and token = "qqq123xyz789"', "aa"))
    return [(i, t, lang, "s", len(t) if t else 0) for i, t, lang in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(documents(), KIND).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d)


def stages(spark, docs, sf_dir, tmp_path):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out.append(docs)
    return out


def test_every_stage(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = stages(spark, docs, folder, tmp_path)
    assert all(f.columns == docs.columns for f in found[:-1])
    rows = [[tuple(r) for r in f.collect()] for f in [docs, *found]]
    # Language: what has no letter goes; the model says what else does.
    model = queries.langid_model(docs)
    kept = [r for r in rows[0] if (p := model.predict(r[1] or "")) and p[0] != langid.UNDETERMINED and p[1] >= corpus_pipeline.LEAST_SCORE]
    assert sorted(map(str, rows[1])) == sorted(map(str, kept))
    assert {202, 203, 204} & {r[0] for r in rows[1]} == set()
    # Near-duplicates: one of each group that five-word shingles link at 0.8, by brute force.
    sets = [jaccard.shingle_set(r[1], 5) for r in rows[1]]
    group = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(a):
                common = len(np.intersect1d(sets[a], sets[b]))
                if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                    group[a] = group[b] = min(group[a], group[b])
    best = {}
    for g, r in zip(group, rows[1], strict=True):
        k = (r[0] is None, r[0] or 0)
        best[g] = min(best.get(g, (k, r[0])), (k, r[0]), key=lambda x: x[0])
    assert sorted(str(r[0]) for r in rows[2]) == sorted(str(b[1]) for b in best.values())
    assert 200 not in {r[0] for r in rows[2]} and 201 not in {r[0] for r in rows[2]}
    # Decontamination.
    words = decontaminate.words_of(ITEM)
    leaks = [r for r in rows[2] if " ".join(words) in " ".join(decontaminate.words_of(r[1]))]
    assert [r[0] for r in leaks] == [205] and sorted(map(str, rows[3])) == sorted(str(r) for r in rows[2] if r not in leaks)
    # Secrets: document 206 is a near-duplicate of 10, which stays.
    want = [(r[0], t := secrets.redact_text(r[1], secrets.find_secrets(r[1])), *r[2:4], len(t)) for r in rows[3]]
    assert sorted(map(str, rows[4])) == sorted(map(str, want)) and not any("123xyz789" in r[1] for r in rows[4])
    assert [r[0] for r in rows[4] if r[1].endswith("and [assign]\"")] == [208]
    # Packing: every document's pieces cover its tokens.
    total: dict = {}
    for r in found[4].collect():
        total.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.length
    assert set(total) == {r[0] for r in rows[4]} and all(a == b for a, b in total.values())


def test_run_is_the_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    last = stages(spark, docs, folder, tmp_path)[-1]
    assert sorted(map(str, corpus_pipeline.run(spark, folder).drop("sequence_id", "offset").collect())) == sorted(map(str, last.drop("sequence_id", "offset").collect()))
    assert corpus_pipeline.ORACLE_SQL is None


def test_an_empty_table(spark, folder, tmp_path):
    docs = spark.createDataFrame([], KIND)
    assert [f.count() for f in stages(spark, docs, folder, tmp_path)] == [0] * 5
