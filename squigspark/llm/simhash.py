"""Near-duplicate detection by SimHash fingerprints and covering locality-sensitive hashing.

Fingerprint: A-Z lower-cased, words between ASCII white space, shingles of ``words`` words with
repeats; each bit is set if it is set in over half of the shingles' XXH64 values.

Linking: fingerprints at ``radius`` (2) or fewer differing bits.  Equal fingerprints are merged
first, so copies cost one row.  Covering masks (Pagh 2016): every bit position gets a non-zero
vector of radius+1 bits, and the mask of a non-zero vector v keeps the positions whose inner
product with v is odd.  For any set of at most ``radius`` positions some v is orthogonal to all of
them, so every pair within the radius agrees on all bits of at least one of the 7 masks: no link
is missed.  Tables with at most ``pair_limit`` fingerprints in a bucket are compared pair by pair.
Larger buckets take a route that is as exact but linear: each fingerprint announces itself and its
64 one-bit neighbours, and two fingerprints within two bits always share an announced value, while
two that share one are within two bits; at most 65 fingerprints can meet at a value.

Defined results: null and empty texts have fingerprint zero and are linked like any other; repeated
rows keep one result each.  A null id belongs to its fingerprint's component, whose id is the
smallest non-null one (null if there is none).  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, join_skewed, slices, texts
from .components import connected_components

BITS, RADIUS, SEED = 64, 2, 42


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """One mask for each non-zero vector of radius+1 bits."""
    vectors = [1 + i % ((1 << radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 1 << radius + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str, words: int = 3) -> np.ndarray:
    """XXH64 values of a text's shingles, repeats included; none for a text without words."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype="<u8")
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=max(1, len(w) - words + 1))


def fingerprint_of(h: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint of shingles' hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    return fingerprint_of(shingle_hashes(text, words))


def with_fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, text_hash, fp): one row for each of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            fp = [signed(fingerprint(t, words)) for t in texts(batch, text)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64())], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias(text))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def hex_fingerprint(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def fingerprint_links(distinct: DataFrame, pair_limit: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect whatever is within the radius."""
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(covering_masks())])
    placed = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.mask", "k.bits")
    sizes = placed.groupBy("mask", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(placed.join(sizes, ["mask", "bits"]))  # buckets of one fingerprint, nearly all, are gone
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= RADIUS

    small = shared.filter(F.col("n") <= pair_limit).groupBy("mask", "bits").agg(F.collect_list("fp").alias("fps"))
    pairs = small.select(F.explode("fps").alias("a"), "fps").select("a", F.explode(F.filter("fps", lambda y: (y > F.col("a")) & near(F.col("a"), y))).alias("b"))

    crowded = shared.filter(F.col("n") > pair_limit).select("fp").distinct()
    values = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(BITS)])
    announced = crowded.select("fp", F.explode(values).alias("z"))
    stars = announced.groupBy("z").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return pairs.unionByName(stars.select("a", F.explode("fps").alias("b")).filter("a <> b")).distinct()


def fingerprint_components(rows: DataFrame, pair_limit: int = 64) -> DataFrame:
    """(fp, n, root, component_id): of each fingerprint its rows, a name of its component, and that one's smallest doc_id.

    ``rows``: (doc_id, fp).
    """
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = connected_components(fingerprint_links(distinct.select("fp"), pair_limit))
    linked = cut(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    ids = cut(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    return join_skewed(linked.select("fp", "n", "root"), ids, "root", "members", "fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id): one row for each of ``docs``."""
    rows = cut(with_fingerprint(docs, key, text, words))
    found = join_skewed(rows, cut(fingerprint_components(rows)), "fp", "n", "text_hash")
    return found.select("doc_id", "text_hash", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One document of each component: that with the smallest id (then the smallest text hash).

    Texts are shuffled once, by id, so a huge component does not meet in one task.
    """
    found = near_duplicates(docs, key, text, words)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("best")
    h, own, name = fresh(docs, "h"), fresh(docs, "kept_id"), fresh(docs, "kept_hash")
    kept = found.groupBy("root").agg(best).select(F.col("best.doc_id").alias(own), F.col("best.text_hash").alias(name))
    keyed = docs.withColumn(h, F.xxhash64(F.col(text)))
    same = F.col(key).eqNullSafe(F.col(own)) & (F.col(h) == F.col(name))
    return keyed.join(kept.distinct(), same, "left_semi").dropDuplicates([key, h]).select(*docs.columns)
