"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Presence of hashed character 3- to 5-grams of the lower-cased whole text; each feature is scaled
by the logarithm of the ratio of its smoothed shares among toxic and other training texts, and a
logistic regression is fitted on the scaled features (Wang & Manning 2012).  Features whose ratio is
within ``significance`` standard errors of none take no part; there is no bound on how many do.

The classifier is fitted on a sample of at most ``per_class`` labelled documents of each
class; the intercept is moved back to the class shares among all labelled rows.

Defined results: null and empty texts have no features and get the intercept's score.  Without
usable labels of both classes every score is the share of toxic labels (0 if there are none).
Labels with a null id or value are not used; an id labelled more than once is toxic if any row
says so.  Repeated documents each get their own result, and count once in the sample.  A column of the
input that is named as the result is is replaced by it; all others are carried through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, sample_of_each, slices, texts, without
from .ftrl import FtrlConfig, fit_ftrl


@dataclass(frozen=True)
class ToxicityConfig:
    bits: int = 20
    orders: tuple[int, ...] = (3, 4, 5)
    per_class: int = 2000  # bound of the fitting sample: labelled documents of each class
    significance: float = 3.0  # standard errors that a feature's ratio must be away from 0
    smoothing: float = 1.0
    ftrl: FtrlConfig = field(default_factory=lambda: FtrlConfig(alpha=0.1, l1=1.0, l2=0.1, epochs=10))


@dataclass
class ToxicityModel:
    scaled: np.ndarray  # weight x ratio of each bucket
    intercept: float
    bits: int
    orders: tuple[int, ...]

    def scores(self, batch: list[str]) -> np.ndarray:
        seen = np.zeros(1 << self.bits, dtype=np.int32)
        margin = [self.intercept + float(self.scaled[ngrams(t, self.bits, self.orders, seen)].sum()) for t in batch]
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def ngrams(text: str, bits: int, orders: tuple[int, ...], seen: np.ndarray) -> np.ndarray:
    """Distinct buckets of the character n-grams.  ``seen`` is scratch space; its contents don't matter."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4") if text else np.zeros(0, "<u4")
    shift, found = np.uint32(32 - bits), []
    h = c * np.uint32(0x9E3779B1)
    for k in range(2, max(orders) + 1):
        if len(c) < k:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[k - 1 :] * np.uint32(0xC2B2AE35)
        if k in orders:
            found.append((h * np.uint32(0x9E3779B1)) >> shift)
    if not found:
        return np.zeros(0, dtype=np.uint32)
    b = np.concatenate(found)
    order = np.arange(len(b), dtype=np.int32)
    seen[b] = order  # of equal buckets the last stays
    return b[seen[b] == order]


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, cfg: ToxicityConfig = ToxicityConfig(), text: str = "text", label: str = "toxic", key: str = "doc_id") -> ToxicityModel:
    """Fit on the labelled rows for which ``learn`` (over ``labels``) holds."""
    spark = docs.sparkSession
    known = labels.filter(learn & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max((F.col(label) == 1).cast("int")).alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.0
    prior = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    empty = ToxicityModel(np.zeros(1 << cfg.bits, dtype=np.float32), prior, cfg.bits, cfg.orders)
    if len(sizes) < 2:
        return empty
    picked = sample_of_each(known, "y", [key], sizes, cfg.per_class, "toxicity")  # bounded, whatever the labels table holds
    labelled = docs.select(key, text).join(F.broadcast(picked), key)
    n_rows = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n_rows) < 2:
        return empty
    # An id may stand for very many documents.
    labelled = sample_of_each(labelled, "y", [key, text], n_rows, cfg.per_class, "documents")
    bits, orders = cfg.bits, cfg.orders

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, dtype=np.int32)
        for batch in slices(batches, text):
            got = [ngrams(t, bits, orders, seen).astype(np.int32) for t in texts(batch, text)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.int32()))], ["deal", "y", "at"])

    deal = F.xxhash64(F.lit("order"), F.col(key), F.col(text)).alias("deal")
    sample = cut(labelled.select(deal, "y", text).mapInArrow(extract, "deal long, y int, at array<int>"))
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return empty
    # Naive Bayes: smoothed shares of the class's texts that hold the feature.
    toxic, other = F.sum("y"), F.sum(1 - F.col("y"))
    a = cfg.smoothing
    ratio = F.log((F.col("toxic") + a) / (n[1] + 2 * a)) - F.log((F.col("other") + a) / (n[0] + 2 * a))
    error = F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("other") + a))
    counts = sample.select("y", F.explode("at").alias("bucket")).groupBy("bucket").agg(toxic.alias("toxic"), other.alias("other"))
    kept = counts.withColumn("ratio", ratio).filter(F.abs("ratio") >= cfg.significance * error).orderBy("bucket").toPandas()  # 2^bits rows at most
    place = np.full(1 << bits, -1, dtype=np.int32)
    place[kept["bucket"].to_numpy()] = np.arange(len(kept))
    shared = spark.sparkContext.broadcast(place)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(x := shared.value[np.asarray(a.values)])[x >= 0] for a in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.int32()))], ["deal", "y", "at"])

    rows = sample.mapInArrow(narrow, "deal long, y int, at array<int>").toArrow().sort_by("deal")
    scale = kept["ratio"].to_numpy()
    x = [(np.asarray(a.values), scale[np.asarray(a.values)]) for a in rows.column("at").combine_chunks()]
    y = rows.column("y").to_numpy()
    w, b = fit_ftrl(x, y, len(kept), 2, cfg.ftrl)
    scaled = np.zeros(1 << bits, dtype=np.float32)
    scaled[kept["bucket"].to_numpy()] = (w[:, 1] - w[:, 0]) * scale
    return ToxicityModel(scaled, float(b[1] - b[0]) + prior - float(np.log(n[1] / n[0])), bits, orders)


def with_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the probability of the toxic label as one more column."""
    docs = without(docs, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits floats

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(texts(batch, text)), pa.float64())], [*batch.schema.names, score])

    return docs.mapInArrow(predict, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))
