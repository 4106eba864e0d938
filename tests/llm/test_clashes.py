"""Every operator and stage on tables whose other columns have the names that operators use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from squigspark.llm import decontaminate, embeddings, htmltext, jaccard, langid, packing, queries, secrets, simhash, toxicity, urlfilter, warc

NAMES = """__h __id __hash __lang __score __row __deal __hot __cold __value __name __rank h row kept_id kept_hash lang_pred lang_score score findings title
fp root node text_hash component_id held_out n tokens ids digest name number path records sketch keys best deal y at host rule verdict item_id kind""".split()


def clashing(df):
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES if n not in df.columns])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"the quick word{i} and then some more text number{i % 7} token = abc123{i}def", "ab"[i % 2], "s", 1) for i in range(40)] + [(None, None, None, None, None), (3, "", "a", "s", 0), (3, "", "a", "s", 0)]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("clash")
    items = spark.createDataFrame([(1, "which river flows past the old mill. the slow one"), (None, "an item without any id has words of its own. this answer")], "item_id long, text string")
    clashing(items).write.parquet(str(d / "benchmark.parquet"))
    return str(d)


def kept(out, docs, gone=()):
    """All other columns are there with their values."""
    rows = out.select([n for n in NAMES if n not in gone and n in docs.columns]).distinct().collect()
    assert all(v == f"own {n}" for r in rows for n, v in r.asDict().items())


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, docs, folder, stage):
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, folder)
    assert out.count() > 0
    if stage != "packing":
        assert out.columns == docs.columns
        kept(out, docs)


def test_operators(spark, docs, tmp_path):
    n = docs.count()
    model = langid.fit_langid(docs, F.lit(True))
    out = langid.with_language(docs, model)
    kept(out, docs, ("lang_pred", "score"))
    assert out.count() == n and {r.lang_pred for r in out.select("lang_pred").collect()} <= {"a", "b", "und"}
    labels = clashing(docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).filter("doc_id is not null"))
    out = toxicity.with_toxicity(docs, toxicity.fit_toxicity(docs, labels, F.lit(True)))
    kept(out, docs, ("score",))
    assert out.count() == n and all(0 <= r.score <= 1 for r in out.select("score").collect())
    out = secrets.scan(docs)
    kept(out, docs, ("findings",))
    assert out.filter("size(findings) > 0").count() == 40
    assert secrets.redact(docs).columns == docs.columns and secrets.digests(docs).count() == n
    for unique in (simhash.deduplicate(docs), jaccard.deduplicate(docs)):
        assert unique.columns == docs.columns and unique.count() <= n - 2
        kept(unique, docs)
    assert simhash.near_duplicates(docs).count() == n
    assert packing.pack(docs, queries.packing_config()).count() == n
    assert decontaminate.matches(docs, docs.select("text", F.col("doc_id").alias("item"), *NAMES).withColumn("item_id", F.lit(1))).count() >= 0


def test_pages_and_vectors(spark, tmp_path):
    rows = [(1, "http://a.org/x", "<p>one", [1.0, 0.0]), (2, None, None, None), (None, "nourl", "<p>one", [1.0, 0.0])]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string, embedding array<double>")).withColumns({"text": F.lit("own"), "vec_id": F.col("page_id")})
    out = htmltext.extract(pages)
    assert "html" not in out.columns and sorted(r.text for r in out.collect()) == ["", "one", "one"]
    kept(out, pages, ("title",))
    assert urlfilter.judge(pages, [0.0] * 8193).count() == 3
    assert warc.read_archives(warc.write_archives(pages, str(tmp_path))).count() == 3
    assert sorted(r.n_links for r in embeddings.near_vectors(pages).collect()) == [0, 1, 1]


def test_null_item_ids_stay_null(spark):
    items = spark.createDataFrame([(None, "which river flows past the old mill. the slow one"), (4, "another question about the tall green hill. a short answer")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so which river flows past the old mill the slow one"), (2, "nothing")], "doc_id long, text string")
    for cfg in (decontaminate.DecontaminationConfig(), decontaminate.DecontaminationConfig(shard_chars=10, shards_held=1)):
        assert [(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items, cfg).collect()] == [(1, None)]
        assert [r.doc_id for r in decontaminate.without_matches(docs, items, cfg).collect()] == [2]


def test_samples_are_capped_though_ids_repeat(spark):
    from squigspark.llm.common import sample_of_each

    same = spark.range(5000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 1000).alias("text"), F.lit("x").alias("lang"))
    other = spark.range(30).select(F.lit(2).alias("doc_id"), F.concat(F.lit("u"), F.col("id")).alias("text"), F.lit("y").alias("lang"))
    got = sample_of_each(same.unionByName(other), "lang", ["doc_id", "text"], {"x": 5000, "y": 30}, 50, "s").groupBy("lang").count().collect()
    counts = {r["lang"]: r["count"] for r in got}
    assert 5 <= counts["x"] <= 50 and counts["y"] == 30
