import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from squigspark.llm import ftrl, langid, toxicity, urlfilter
from squigspark.llm.common import id_bucket

WORDS = {"aa": ["the", "thing", "with", "and"], "bb": ["der", "und", "schein", "nicht"], "cc": ["que", "los", "cion", "mente"]}


def corpus(n=240, seed=0):
    rng = np.random.default_rng(seed)
    langs = list(WORDS)
    return [(i, " ".join(rng.choice(WORDS[langs[i % 3]], int(rng.integers(3, 40)))), langs[i % 3]) for i in range(n)]


def test_ftrl_is_sparse_and_right():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 20))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    rows = [(np.arange(20), v) for v in x]
    w, b = ftrl.fit_ftrl(rows, y, 20, 2, ftrl.FtrlConfig(l1=3.0, epochs=3))
    assert ((x @ w + b).argmax(axis=1) == y).mean() > 0.95
    assert (w == 0).all(axis=1).sum() >= 5
    w2, _ = ftrl.fit_ftrl(rows, y, 20, 2, ftrl.FtrlConfig(l1=3.0, epochs=3))
    assert np.array_equal(w, w2)


def test_temperature_lowers_loss():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 500)
    logits = np.eye(2)[y] * 8 * (rng.random(500) < 0.8)[:, None] + rng.normal(size=(500, 2)) * 6
    t = ftrl.fit_temperature(logits, y)
    nll = lambda t: -np.log(ftrl.softmax(logits / t)[np.arange(500), y]).mean()
    assert t > 1 and nll(t) <= min(nll(1.0), nll(t * 1.1), nll(t * 0.9)) + 1e-9
    assert ftrl.fit_temperature(np.zeros((0, 2)), np.zeros(0, int)) == 1.0


def test_language_held_out(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = langid.fit_langid(docs, id_bucket("doc_id", 4) != 2)
    assert model.languages == ["aa", "bb", "cc"]
    got = langid.with_language(docs, model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 30 and np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark):
    rows = [*corpus(60), (None, None, None), (1, "", "aa"), (2, "123 !!", "aa"), (3, "the and thing " * 30000, None), (3, "the and thing", "aa"), (3, "the and thing", "aa")]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred2 string, at double")
    model = langid.fit_langid(docs, F.lit(True))
    got = langid.with_language(docs, model).collect()
    assert len(got) == len(rows) and got[0].lang_pred2 == "x"
    by = [(r.text, r.lang_pred) for r in got[60:]]
    assert [p for _, p in by] == ["und", "und", "und", "aa", "aa", "aa"]
    nothing = langid.fit_langid(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.with_language(docs, nothing).collect()} == {"und"}
    assert langid.with_language(docs.limit(0), model).count() == 0


def test_every_label_is_learned(spark):
    rng = np.random.default_rng(4)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 140)]
    rows = [(i, " ".join("".join(rng.choice(letters[2 * (i % 70) : 2 * (i % 70) + 2], 3)) for _ in range(12)), f"l{i % 70:02}") for i in range(70 * 12)]
    rows += [(10_000 + i, t, lang) for i, (_, t, lang) in enumerate(rows) if int(lang[1:]) < 64]  # the last six are the rarer ones
    model = langid.fit_langid(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.languages == [f"l{i:02}" for i in range(70)]
    assert np.mean([model.predict(t)[0] == lang for _, t, lang in rows if int(lang[1:]) >= 64]) > 0.9


def toxic_corpus(n=400):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        words = list(rng.choice(["green", "fields", "morning", "walk", "slow", "river", "bread"], 30))
        bad = i % 4 == 0
        if bad:
            words.insert(int(rng.integers(30)), str(rng.choice(["zorkface", "zorkhead"])))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, id_bucket("doc_id", 5) != 0)
    got = {r.doc_id: r.score for r in toxicity.with_toxicity(docs, model).collect()}
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 40 and np.mean(held) > 0.97


def test_toxicity_of_odd_rows(spark):
    rows = toxic_corpus(120)
    docs = spark.createDataFrame([*[(i, t, 9.0) for i, t, _ in rows], (None, None, 1.0), (5, "", 1.0), (6, "x" * 300_000, None), (7, "walk", 1.0), (7, "walk", 1.0)], "doc_id long, text string, y double")
    labels = spark.createDataFrame([*[(i, y) for i, _, y in rows], (None, 1), (3, None), (0, 0)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, F.lit(True))
    got = toxicity.with_toxicity(docs, model).collect()
    assert len(got) == 125 and all(0 <= r.score <= 1 for r in got)
    assert got[120].score == got[121].score < 0.5
    one_class = toxicity.fit_toxicity(docs, labels.filter("toxic = 0"), F.lit(True))
    assert max(r.score for r in toxicity.with_toxicity(docs, one_class).collect()) < 1e-6
    assert toxicity.with_toxicity(docs.limit(0), model).count() == 0
    assert max(r.score for r in toxicity.with_toxicity(docs, toxicity.fit_toxicity(docs, labels.limit(0), F.lit(True))).collect()) < 1e-6


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def rule_of(host, path):
    fits = [(len(r), r, v) for v, r in urlfilter.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


@pytest.fixture(scope="module")
def weights(spark):
    return urlfilter.fit_weights(urlfilter.labelled_urls(spark))


def test_urls_against_brute_force(spark, weights):
    urls = [
        "http://WWW.Example.com/en/1?q#z", "https://example.com/en/", "https://example.com/en", "https://a.example.com/fr/", "http://x.net/es/1", "http://x.net/es", "http://net/fr/2", "http://xnet/es/1", "http://com", "http://com/", "http://a.com#f",
        "http://a.com?x=/en/", "nourl", None, "", "://", "http://", "ftp://user@h.com:80/p#x://y", "http://ÄB.net/es/ü", "http://a.org/" + "z" * 5000, "http://example.com/en/1", "http://example.com/en/1",
    ]
    rows = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, score int")
    got = sorted(urlfilter.judge(rows, weights).collect(), key=lambda r: r.page_id)
    assert len(got) == len(urls)
    for r, u in zip(got, urls, strict=True):
        assert (r.host, r.path) == host_path(u)
        rule, verdict = rule_of(r.host, r.path)
        assert r.rule == rule
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert urlfilter.judge(rows.limit(0), weights).count() == 0


def test_regression_against_numpy(spark, weights):
    """The weights are those of plain gradient descent on the same features."""
    cfg = urlfilter.UrlModelConfig()
    labelled = urlfilter.labelled_urls(spark)
    host, path = urlfilter.host_and_path(F.col("url"))
    rows = labelled.select(urlfilter.features(host, path, cfg).alias("f"), "y").collect()
    x = np.zeros((len(rows), cfg.buckets))
    for i, r in enumerate(rows):
        x[i, r.f] = 1
    y = np.array([r.y for r in rows])
    w, b = np.zeros(cfg.buckets), 0.0
    for _ in range(cfg.steps):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - cfg.rate * (x.T @ e / len(y) + cfg.l2 * w), b - cfg.rate * e.mean()
    assert np.allclose(weights, [*w, b], atol=1e-9)
    assert ((x @ w + b > 0) == (y == 1)).mean() > 0.97


def test_unwanted_hosts_are_told(spark, weights):
    rows = spark.createDataFrame([(0, "http://casino-bonus-spin.org/en/win"), (1, "http://library.reading-town.org/en/books")], "page_id long, url string")
    assert [r.verdict for r in sorted(urlfilter.judge(rows, weights).collect(), key=lambda r: r.page_id)] == ["block", "allow"]


def plain_ftrl(rows, y, classes, cfg):
    """Follow the regularised leader, coordinate by coordinate; rows are dictionaries."""
    z, n = {}, {}
    get = lambda t, k: t.get(k, [0.0] * classes)

    def weight(k, c, penalised=True):
        zc, nc = get(z, k)[c], get(n, k)[c]
        if penalised:
            return 0.0 if abs(zc) <= cfg.l1 else -(np.sign(zc) * (abs(zc) - cfg.l1)) / ((cfg.beta + nc**0.5) / cfg.alpha + cfg.l2)
        return -zc / ((cfg.beta + nc**0.5) / cfg.alpha)

    rng = np.random.default_rng(cfg.seed)
    for _ in range(cfg.epochs):
        for i in rng.permutation(len(rows)):
            scores = [sum(v * weight(k, c) for k, v in rows[i].items()) + weight("bias", c, False) for c in range(classes)]
            e = [np.exp(s - max(scores)) for s in scores]
            g = [x / sum(e) - (c == y[i]) for c, x in enumerate(e)]
            for k, v in [*rows[i].items(), ("bias", 1.0)]:
                zk, nk = list(get(z, k)), list(get(n, k))
                old = [weight(k, c, k != "bias") for c in range(classes)]
                for c in range(classes):
                    grad = v * g[c]
                    zk[c] += grad - ((nk[c] + grad**2) ** 0.5 - nk[c] ** 0.5) / cfg.alpha * old[c]
                    nk[c] += grad**2
                z[k], n[k] = zk, nk
    return {k: [weight(k, c) for c in range(classes)] for k in z if k != "bias"}, [weight("bias", c, False) for c in range(classes)]


def test_ftrl_against_plain():
    rng = np.random.default_rng(3)
    rows = [{int(k): float(v) for k, v in zip(rng.choice(15, 6, replace=False), rng.random(6), strict=True)} for _ in range(60)]
    y = rng.integers(0, 3, 60)
    cfg = ftrl.FtrlConfig(l1=0.1, epochs=2)
    w, b = ftrl.fit_ftrl([(np.array(sorted(r)), np.array([r[k] for k in sorted(r)])) for r in rows], y, 15, 3, cfg)
    plain_w, plain_b = plain_ftrl(rows, y, 3, cfg)
    assert np.allclose(w, [plain_w.get(k, [0.0] * 3) for k in range(15)], atol=1e-9) and np.allclose(b, plain_b, atol=1e-9)


def test_language_features_and_scores_against_plain(spark):
    """Document frequencies, TF-IDF and the probabilities of a fitted model, n-gram by n-gram."""
    rows = corpus(90)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_langid(docs, F.lit(True))
    df = {}
    for _, t, _ in rows:
        for k in {int(k) for k in langid.ngram_counts(t, 16)[0]}:
            df[k] = df.get(k, 0) + 1
    for k in range(0, 1 << 16, 7):
        assert abs(model.idf[k] - (np.log((1 + len(rows)) / (1 + df.get(k, 0))) + 1)) < 1e-6
    out = {r.doc_id: r for r in langid.with_language(docs, model).collect()}
    for i, t, _ in rows:
        x = {int(k): (1 + np.log(n)) * (np.log((1 + len(rows)) / (1 + df[int(k)])) + 1) for k, n in zip(*langid.ngram_counts(t, 16), strict=True)}
        norm = sum(v * v for v in x.values()) ** 0.5
        scores = [(sum(v / norm * float(model.weights[model.rows[k]][c]) for k, v in x.items()) + model.bias[c]) / model.temperature for c in range(3)]
        p = [float(np.exp(s - max(scores))) for s in scores]
        best = int(np.argmax(p))
        assert out[i].lang_pred == model.languages[best] and abs(out[i].score - p[best] / sum(p)) < 1e-5


def test_many_languages(spark):
    """200 labels: the sample, the n-grams of long documents and the fitted matrix keep their bounds."""
    rows = [(200 * k + i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{w}" for w in ("ka", "lo", "mi") * (1 + k)), f"l{i:03d}") for i in range(200) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    cfg = langid.LangIdConfig(sample=1600, sample_grams=20, cells=200 * 500)
    model = langid.fit_langid(docs, F.lit(True), cfg)
    assert len(model.languages) == 200 and len(model.weights) <= 501
    got = langid.with_language(docs, model).select((F.col("lang_pred") == F.col("lang")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert got > 0.8


def test_most_frequent():
    at, n = np.array([2, 5, 7, 9]), np.array([1, 3, 1, 3])
    assert [x.tolist() for x in langid.most_frequent(at, n, 3)] == [[2, 5, 9], [1, 3, 3]]
    assert [x.tolist() for x in langid.most_frequent(at, n, 4)] == [at.tolist(), n.tolist()]
