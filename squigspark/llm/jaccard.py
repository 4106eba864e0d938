"""Near-duplicates by SimHash and the exact Jaccard similarity of sets of word shingles.

Shingles: A-Z lower-cased, words between ASCII white space, every run of ``words`` words (all words
of a shorter text), as XXH64 values.  Two texts are linked if their sets' similarity is at least
``threshold``; one document of each connected group is kept.

Candidates: SimHash fingerprints of the same shingles, repeats included, that differ in two bits at
most, by the covering masks of ``simhash``.  A pair at the threshold may differ in more bits than a
cover can reach; for these, ``rows`` MinHash values make a key and every set has ``bands`` keys.  A
pair at the threshold shares none with probability (1 - threshold^rows)^bands, 5e-7 by default; nearer
pairs are missed far more seldom still.  Sets that share a fingerprint or a key are joined to its least
set, which costs one row for each set and key however many meet, and the components of these edges and
of the fingerprints' links are clusters.

Verification: each set goes once to its cluster, where all pairs are counted exactly over an
inverted index.  Clusters of over ``block`` shingles or ``block_sets`` sets are cut into blocks, and
pairs of blocks go to different tasks.  Only the edges of a spanning forest leave a task.

Defined results: null and empty texts have the empty set and are linked to each other.  Equal sets
are one set.  The smallest id of a group is kept (then the smallest text hash); a null id only where
there is no other.  Rows that repeat an id and a text are one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, join_skewed, slices, texts
from .components import connected_components
from .embeddings import spanning
from .simhash import SEED, fingerprint_links, fingerprint_of, shingle_hashes, signed


@dataclass(frozen=True)
class JaccardConfig:
    threshold: float = 0.8
    words: int = 5
    bands: int = 48
    rows: int = 6
    block: int = 1 << 20  # shingles
    block_sets: int = 4096
    most_broadcast: int = 1 << 16  # narrow rows; larger tables are joined by shuffles
    most_collected: int = 1 << 19  # edges whose components are found on the driver; more are contracted by Spark first
    seed: int = 20240301


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return np.unique(shingle_hashes(text, words))


def minhash_keys(s: np.ndarray, factors: np.ndarray, rows: int) -> np.ndarray:
    """One key for each band; the bands' numbers are part of the keys."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, np.multiply.outer(factors, x[at : at + 512]).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(-1, rows))], dtype=np.uint64).view(np.int64)


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """All (place in left, place in right) at or above the threshold; only left < right if both are the ``same``."""
    size = np.array([len(s) for s in right], dtype=np.int64)
    flat = np.concatenate([*right, np.zeros(0, dtype=np.uint64)])
    order = np.argsort(flat, kind="stable")
    value, owner = flat[order], np.repeat(np.arange(len(right)), size)[order]
    a, b = [], []
    for i, s in enumerate(left):
        lo, hi = np.searchsorted(value, s, "left"), np.searchsorted(value, s, "right")
        n = hi - lo
        at = np.arange(int(n.sum())) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(s) else np.zeros(0, dtype=np.int64)
        common = np.bincount(owner[at], minlength=len(right))
        hit = np.flatnonzero((common > 0) & (common >= threshold * (size + len(s) - common) - 1e-9))
        hit = hit[hit > i] if same else hit
        a.append(np.full(len(hit), i))
        b.append(hit)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([*a, none]), np.concatenate([*b, none])


def with_sets(docs: DataFrame, cfg: JaccardConfig, key: str, text: str) -> DataFrame:
    """(doc_id, row, node, n, fp, keys): ``row`` names id and text, ``node`` the set of ``n`` shingles, ``fp`` is the text's fingerprint."""
    factors = np.random.default_rng(cfg.seed).integers(0, 1 << 31, cfg.bands * cfg.rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            hashes = [shingle_hashes(t, cfg.words) for t in texts(batch, text)]
            fp = [signed(fingerprint_of(h)) for h in hashes]
            sets = [np.unique(h) for h in hashes]
            node = [signed(xxhash.xxh64_intdigest(s.tobytes(), SEED)) for s in sets]
            keys = [minhash_keys(s, factors, cfg.rows) if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "row", "text_hash", "node", "n", "fp", "keys"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), row_name(key, text).alias("row"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias(text))
    return rows.mapInArrow(run, "doc_id long, row long, text_hash long, node long, n long, fp long, keys array<long>")


def row_name(key: str, text: str):
    return F.xxhash64(F.col(key).isNull(), F.col(key).cast("long"), F.col(text).isNull(), F.col(text))


def small(df: DataFrame, cfg: JaccardConfig) -> DataFrame:
    return F.broadcast(df) if df.count() <= cfg.most_broadcast else df


def components(edges: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """(node, root) of every node of an edge, wherever they are found."""
    return connected_components(edges, most_collected=cfg.most_collected)


def distinct_sets(rows: DataFrame) -> DataFrame:
    """(node, row, n, fps, keys, best): one row for each set, however many documents have it; ``best`` is the one to keep.

    Texts of one set may repeat its shingles differently, so ``fps`` holds the least and the greatest of their fingerprints.
    """
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "row")).alias("best")
    return rows.groupBy("node").agg(F.min("row").alias("row"), F.min("n").alias("n"), F.array_distinct(F.array(F.min("fp"), F.max("fp"))).alias("fps"), F.any_value("keys").alias("keys"), best)


def simhash_edges(sets: DataFrame) -> DataFrame:
    """Edges (a, b) between sets whose fingerprints are equal or linked.

    Equal fingerprints are joined to their least set; links are between such sets.
    """
    marked = cut(sets.select("node", F.explode("fps").alias("fp")))
    hubs = cut(marked.groupBy("fp").agg(F.min("node").alias("hub"), F.count("*").alias("sharing")))
    equal = join_skewed(marked, hubs.filter("sharing > 1"), "fp", "sharing", "node").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    links = fingerprint_links(hubs.select("fp"))
    ends = [hubs.select(F.col("fp").alias(side), F.col("hub").alias(f"{side}_hub")) for side in ("a", "b")]
    near = links.join(ends[0], "a").join(ends[1], "b").select(F.col("a_hub").alias("a"), F.col("b_hub").alias("b"))
    return equal.unionByName(near)


def clusters(sets: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """(node, root) of the sets that SimHash links or that share a MinHash key with another one."""
    slim = sets.select("node", F.explode("keys").alias("k"))
    shared = slim.groupBy("k").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("sharing")).filter("hub < last")
    edges = join_skewed(slim, cut(shared.drop("last")), "k", "sharing", "node").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return components(simhash_edges(sets).unionByName(edges), cfg)


def similar_links(docs: DataFrame, distinct: DataFrame, cfg: JaccardConfig, key: str, text: str) -> DataFrame:
    """Edges (a, b) between sets, each verified, that connect whatever candidates are similar."""
    member = cut(distinct.select("node", "row", "n").join(small(cut(clusters(distinct, cfg)), cfg), "node"))
    of = F.greatest(F.ceil(F.sum("n") / cfg.block), F.ceil(F.count("*") / cfg.block_sets)).cast("int").alias("of")
    parts = cut(member.groupBy("root").agg(of, F.count("*").alias("members")))
    wanted = cut(join_skewed(member, parts, "root", "members", "node").select("row", "node", "root", "of"))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            sets = [shingle_set(t, cfg.words).view(np.int64) for t in texts(batch, text)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sets, pa.list_(pa.int64()))], ["node", "root", "of", "s"])

    # One text of each set: rows that repeat an id and a text are one document.
    named = docs.select(row_name(key, text).alias("row"), F.col(text).alias(text))
    chosen = named.join(small(wanted, cfg), "row").dropDuplicates(["row"]).select("node", "root", "of", text)
    sets = chosen.mapInArrow(to_sets, "node long, root long, of int, s array<long>").withColumn("block", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    meets = sets.select("*", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other")).select("node", "s", "block", "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(key_: tuple, group: pa.Table) -> pa.Table:
        _, i, j = (x.as_py() for x in key_)
        node, block = group["node"].to_numpy(), group["block"].to_numpy()
        s = [np.asarray(x.values).view(np.uint64) for c in group["s"].chunks for x in c]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = similar_pairs([s[x] for x in left], [s[x] for x in right], cfg.threshold, i == j)
        edges = spanning(left[a], right[b], len(s))
        x, y = (np.array([e[side] for e in edges], dtype=np.int64) for side in (0, 1))
        return pa.table({"a": pa.array(node[x], pa.int64()), "b": pa.array(node[y], pa.int64())})

    return meets.groupBy("root", "i", "j").applyInArrow(compare, "a long, b long")


def deduplicate(docs: DataFrame, cfg: JaccardConfig = JaccardConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, unchanged.  Texts are shuffled once, by id and text."""
    distinct = cut(distinct_sets(with_sets(docs, cfg, key, text)))
    roots = components(similar_links(docs, distinct, cfg, key, text), cfg)
    named = distinct.select("node", "best").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    name = fresh(docs, "row")
    kept = named.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(name)).distinct()
    return docs.withColumn(name, row_name(key, text)).join(kept, name, "left_semi").dropDuplicates([name]).select(*docs.columns)
