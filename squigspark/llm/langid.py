"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character 1- to 3-grams of the lower-cased whole text.  Document frequencies
cover every row that may be learned from; the regression itself is fitted with FTRL and an
elastic-net penalty on a sample of at most ``per_class`` documents of each language and some ``sample`` of all, and a
quarter of that sample is set aside for the temperature that calibrates the probabilities.  Every
label that occurs is learned; what the driver holds does not grow with their number, beyond four documents of each.  Only buckets that occur in the sample have weights while fitting, and
the model keeps those that the penalty leaves: one row of weights for each bucket that has any.

Defined results: a null text, or one without a letter, is ``und`` with score 0.  If there is
nothing to learn from (empty table, no labels), every text is ``und``.  Repeated rows each get
their own result, a null id is scored like any other (it is neither learned from nor held out).
Rows that repeat id and text count once in the sample.  Columns of the input that are named as a
result is are replaced by it; all others are carried through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_of_each, slices, texts, without
from .ftrl import FtrlConfig, fit_ftrl, fit_temperature, softmax

UNDETERMINED = "und"


@dataclass(frozen=True)
class LangIdConfig:
    bits: int = 16
    per_class: int = 1000  # bound of the fitting sample: documents of each language
    sample: int = 4000  # and of all languages together, but for four of each
    sample_grams: int = 4096  # of a sampled document the most frequent so many n-grams count in the fit
    cells: int = 1 << 24  # bound of the fitted matrix (n-grams x languages); with many languages the n-grams of most documents take part
    ftrl: FtrlConfig = field(default_factory=FtrlConfig)


@dataclass
class LangIdModel:
    languages: list[str]
    idf: np.ndarray
    rows: np.ndarray  # of each bucket in weights; the last row, of zeros, for those without
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        at, x = tfidf(*ngram_counts(text, self.bits), self.idf)
        p = softmax((x @ self.weights[self.rows[at]] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


#: ASCII letters stand for themselves; digits, punctuation and controls count as a space.
_ASCII = np.array([i if chr(i).isalpha() else 32 for i in range(128)], dtype="<u4")


def ngram_counts(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's character 1-, 2- and 3-grams, and how often each occurs.

    Runs of ASCII characters that aren't letters count as one space: numbers, addresses and markup
    tell nothing about the language.
    """
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = np.where(c < 128, _ASCII[np.minimum(c, 127)], c)
    if len(c):
        c = c[~((c == 32) & (np.concatenate([c[:1] * 0, c[:-1]]) == 32))]
    shift = np.uint32(32 - bits)
    one = c * np.uint32(0x9E3779B1)
    grams = [one]
    if len(c) > 1:
        two = (one[:-1] ^ np.uint32(0x7FEB352D)) * np.uint32(0x85EBCA6B) + c[1:] * np.uint32(0xC2B2AE35)
        grams.append(two * np.uint32(0x9E3779B1))
        if len(c) > 2:
            grams.append(((two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1)) * np.uint32(0x9E3779B1))
    count = np.bincount(np.concatenate(grams) >> shift, minlength=1 << bits)
    at = np.flatnonzero(count)
    return at, count[at]


def most_frequent(at: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` buckets that occur most often, in order; of equals the lower one."""
    if len(at) <= most:
        return at, count
    kept = np.sort(np.argsort(-count, kind="stable")[:most])
    return at[kept], count[kept]


def tfidf(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = (1 + np.log(count)) * idf[at]
    return at, x / max(1e-12, float(np.sqrt(x @ x)))


def document_frequencies(docs: DataFrame, text: str, bits: int) -> tuple[int, np.ndarray]:
    """Rows, and in how many of them each bucket occurs; each task sends one row for a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((1 << bits) + 1, dtype=np.int64), 0
        for batch in slices(batches, text):
            for t in texts(batch, text):
                rows += 1
                total[ngram_counts(t, bits)[0]] += 1
        total[-1] = rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    found = docs.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((1 << bits) + 1, dtype=np.int64)
    total[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return int(total[-1]), total[:-1]


def fit_langid(docs: DataFrame, learn: Column, cfg: LangIdConfig = LangIdConfig(), text: str = "text", lang: str = "lang", key: str = "doc_id") -> LangIdModel:
    """Fit on the rows of ``docs`` for which ``learn`` holds; ``key`` only deals rows into the sample."""
    known = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = known.groupBy(lang).agg(F.count("*").alias("n")).collect()
    languages = sorted(r[lang] for r in sizes)
    if not languages:
        return LangIdModel([], np.zeros(1 << cfg.bits), np.zeros(1 << cfg.bits, dtype=np.int32), np.zeros((1, 0)), np.zeros(0), 1.0, cfg.bits)
    rows, df = document_frequencies(known, text, cfg.bits)
    idf = np.log((1 + rows) / (1 + df)) + 1

    chosen = sample_of_each(known.select(lang, text, key), lang, [key, text], {r[lang]: r["n"] for r in sizes}, min(cfg.per_class, max(4, cfg.sample // len(languages))), "langid")
    bits, most = cfg.bits, cfg.sample_grams

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            got = [most_frequent(*ngram_counts(t, bits), most) for t in texts(batch, text)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a for a, _ in got], pa.list_(pa.int32())), pa.array([n for _, n in got], pa.list_(pa.int32())), batch.column(2)],
                ["lang", "at", "count", "deal"],
            )

    # In a fixed order, so that the fit does not depend on which task ended first.
    deal = F.xxhash64(F.lit("order"), F.col(key), F.col(text))
    sample = chosen.select(F.col(lang).alias("lang"), F.col(text), deal.alias("deal")).mapInArrow(extract, "lang string, at array<int>, count array<int>, deal long").toArrow().sort_by("deal")
    row = {x: i for i, x in enumerate(languages)}
    y = np.array([row[x] for x in sample.column("lang").to_pylist()])
    at, count = (sample.column(k).combine_chunks() for k in ("at", "count"))
    x = [tfidf(np.asarray(a.values), np.asarray(n.values), idf) for a, n in zip(at, count, strict=True) if len(a.values)]
    y = y[[i for i, a in enumerate(at) if len(a.values)]]
    aside = np.arange(len(x)) % 4 == 3
    fit = np.flatnonzero(~aside)
    used = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *[a for a, _ in x]]))
    wide = max(1, cfg.cells // len(languages))
    if len(used) > wide:
        used = np.sort(used[np.argsort(-df[used], kind="stable")[:wide]])
        x = [(a[kept], v[kept]) for a, v in x for kept in [np.isin(a, used)]]
    x = [(np.searchsorted(used, a), v) for a, v in x]
    w, b = fit_ftrl([x[i] for i in fit], y[fit], len(used), len(languages), cfg.ftrl)
    held = np.flatnonzero(aside)
    logits = np.array([x[i][1] @ w[x[i][0]] + b for i in held]).reshape(len(held), len(languages))
    some = np.flatnonzero((w != 0).any(axis=1))
    place = np.full(1 << bits, len(some), dtype=np.int32)
    place[used[some]] = np.arange(len(some))
    weights = np.concatenate([w[some], np.zeros((1, len(languages)))]).astype(np.float32)
    return LangIdModel(languages, idf.astype(np.float32), place, weights, b, fit_temperature(logits, y[held]), bits)


def with_language(docs: DataFrame, model: LangIdModel, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its calibrated probability as two more columns."""
    docs = without(docs, pred, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most (2^bits + 1) x languages floats
    kinds = docs.select(F.lit("").alias(pred), F.lit(0.0).alias(score)).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, text):
            got = [m.predict(t) for t in texts(batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*batch.schema.names, pred, score])

    out = docs.schema.__class__([*docs.schema.fields, *kinds.fields])
    return docs.mapInArrow(predict, out)
