"""Near-duplicate embeddings with randomised-rotation binary codes (RaBitQ).

Unit vectors are turned by a random orthogonal matrix.  The signs of the turned vector are its code; the
inner product of code and vector, f, is stored with it as correction factor, and so is the turned vector
itself in four bits for each component.  For any query q, <code, q>/f estimates the inner product without
bias; with the four-bit query it is a sum of popcounts.  If the true cosine is at least the threshold c,
the estimate misses it by at most sqrt(1-c^2) * sqrt(1-f^2)/f times min(1, e0/sqrt(D-1)), and by what four
bits leave out: always for the 1, and with a probability that falls exponentially in e0^2 for the other.

All of that, the sketch, is made once for each vector and is what is shuffled (at 64 dimensions 64 bytes
for 256 to 512).  Pairs whose bound stays below c are done.  The vectors themselves follow, in a second
shuffle, only to the buckets where they have an undecided partner, and those pairs are recomputed exactly
in double precision.

Which pairs are estimated at all: the signs of another turned vector are random-hyperplane hashes,
so vectors that agree on ``k`` of them, in any of several tables, meet in a bucket.  k follows the
number of vectors, which keeps buckets near ``bucket`` rows at any size, and the number of tables
follows k, so that a pair at the threshold is missed with probability ``miss`` at most.  A pair is
counted only in the first table in which it meets, which either side can tell from the sketches alone;
so nothing is emitted for each pair.  Buckets over ``block`` rows are cut into blocks and pairs of
blocks go to different tasks.  Equal vectors are merged first and weigh as many as they are.

Vectors of every dimension are compared with those of the same dimension: the dimension is part of
a bucket's name, and each has rotations, k and a number of tables of its own.

Defined results: vectors that are null, empty, zero, or that hold null or non-finite components link
with nothing, and vectors of different dimensions don't link.  Equal vectors link.  Repeated rows
count as vectors of their own, rows with a null id too (they are never a component's name).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_skewed
from .components import connected_components


@dataclass(frozen=True)
class NearVectorsConfig:
    threshold: float = 0.95
    bucket: int = 128  # vectors aimed at for each bucket
    miss: float = 0.01  # chance that a pair at the threshold meets in no table; nearer ones are missed far more seldom
    block: int = 1024  # larger buckets are cut into blocks; a group holds two at most
    step: int = 512  # rows whose estimates are held at once
    e0: float = 6.0
    seed: int = 20240229


def usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def rotations(dim: int, bits: int, seed: int) -> np.ndarray:
    """Random orthogonal matrices, side by side, for at least ``bits`` signs."""
    rng = np.random.default_rng(seed)
    out = []
    while sum(q.shape[1] for q in out) < max(bits, dim):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out, axis=1)


def tables_for(n: int, cfg: NearVectorsConfig) -> tuple[int, int]:
    """Signs of a key, and tables."""
    k = max(1, min(48, ceil(log2(max(2, n / cfg.bucket)))))
    agree = (1 - np.arccos(cfg.threshold) / pi) ** k
    return k, ceil(log(cfg.miss) / log(1 - agree))


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # first, lest squares overflow
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


#: Bits that a component of the query is kept in.
LEVELS = 4


class Sketches:
    """The sketches of vectors of one dimension, as arrays: made from vectors, or read from their bytes."""

    def __init__(self, dim: int, k: int, tables: int):
        self.dim, self.k, self.tables, self.words = dim, k, tables, -(-dim // 64)
        self.key_bytes = -(-k * tables // 8)
        self.size = 12 + 8 * self.words * (1 + LEVELS) + self.key_bytes

    def pack(self, x: np.ndarray, turn: np.ndarray, planes: np.ndarray) -> pa.Array:
        """Of unit vectors.  ``turn`` (dim x dim) is the code's rotation, ``planes`` (dim x k tables) the keys' one."""
        turned = x @ turn
        low = turned.min(axis=1).astype(np.float32)
        step = np.maximum((turned.max(axis=1) - low) / ((1 << LEVELS) - 1), 1e-12).astype(np.float32)
        # A fixed dither in place of a random one: a retried task makes the same sketch.
        dither = np.random.default_rng(self.dim).random(self.dim)
        level = np.clip((turned - low[:, None]) / step[:, None] + dither, 0, (1 << LEVELS) - 1).astype(np.uint8)
        bits = [turned >= 0, *[(level >> j) & 1 for j in range(LEVELS)]]
        out = np.zeros((len(x), self.size), dtype=np.uint8)
        out[:, :12] = np.stack([np.abs(turned).sum(axis=1) / np.sqrt(self.dim), low, step], axis=1).astype("<f4").view(np.uint8)
        for i, b in enumerate(bits):
            packed = np.packbits(b, axis=1, bitorder="little")
            out[:, 12 + 8 * self.words * i :][:, : packed.shape[1]] = packed
        out[:, self.size - self.key_bytes :] = np.packbits(x @ planes >= 0, axis=1, bitorder="little")
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(self.size), len(x), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())

    def read(self, column: pa.ChunkedArray) -> Sketches:
        raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, self.size)
        at = 12 + 8 * self.words
        self.f, self.low, self.step = raw[:, :12].copy().view("<f4").astype(np.float64).T
        self.code = raw[:, 12:at].copy().view("<u8")
        self.query = raw[:, at : at + 8 * self.words * LEVELS].copy().view("<u8").reshape(len(raw), LEVELS, self.words)
        signs = np.unpackbits(raw[:, self.size - self.key_bytes :], axis=1, bitorder="little", count=self.k * self.tables)
        self.keys = (signs.reshape(len(raw), self.tables, self.k).astype(np.int64) << np.arange(self.k)).sum(axis=2)
        return self

    def undecided(self, rows: np.ndarray, others: np.ndarray, table: int, same: bool, cfg: NearVectorsConfig) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``rows`` and ``others`` of the pairs that first meet in this table and may reach the threshold."""
        d, f = self.dim, np.maximum(self.f[others], 1e-9)
        inner, mass = np.zeros((len(rows), len(others))), np.zeros(len(rows))
        for j in range(LEVELS):
            q = self.query[rows, j]
            mass += np.bitwise_count(q).sum(axis=1, dtype=np.int64) << j
            for w in range(self.words):
                inner += np.bitwise_count(q[:, w, None] & self.code[others, w]).astype(np.float64) * (1 << j)
        ones = np.bitwise_count(self.code[others]).sum(axis=1, dtype=np.int64)
        low, step = self.low[rows, None], self.step[rows, None]
        estimate = (low * (2 * ones - d) + step * (2 * inner - mass[:, None])) / np.sqrt(d) / f
        slack = min(1.0, cfg.e0 / np.sqrt(max(1, d - 1))) * np.sqrt(1 - cfg.threshold**2) * np.sqrt(np.maximum(0, 1 - f * f)) / f
        rounding = min(np.sqrt(d), cfg.e0 / 2) * step / f
        a, b = np.nonzero(estimate + slack + rounding >= cfg.threshold - 1e-5)
        if same:
            a, b = a[a < b], b[a < b]
        if table and len(a):
            fresh = (self.keys[rows[a], :table] != self.keys[others[b], :table]).all(axis=1)
            a, b = a[fresh], b[fresh]
        return a, b


def block_steps(block: np.ndarray, i: int, j: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of at most ``step`` rows of block i and of block j; whether both are the same rows."""
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for at in range(0, len(left), step):
        for to in range(at if i == j else 0, len(right), step):
            yield left[at : at + step], right[to : to + step], i == j and at == to


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a forest with the same components."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        u, v = find(i), find(j)
        if u != v:
            root[v] = u
            out.append((i, j))
    return out


def near_vectors(vectors: DataFrame, cfg: NearVectorsConfig = NearVectorsConfig(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id): one row for each row of ``vectors``.

    A pair exactly at the threshold is missed with probability ``cfg.miss`` at most; no pair below it links.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v"))
    good = usable("v")
    # -0.0 and 0.0 are one value.
    positive = F.transform("v", lambda x: x + F.lit(0.0)).cast(kind)
    clean = rows.filter(good).withColumn("v", positive)
    # Numbers name the distinct vectors; they are fixed by the checkpoint.
    distinct = cut(clean.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    # A dimension with one distinct vector has nothing to compare.
    counted = distinct.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).filter("n > 1").collect()
    plan = {r["dim"]: tables_for(r["n"], cfg) for r in counted}
    shared = {}  # of each dimension: dim x (dim + k x tables) numbers
    for dim, (k, tables) in plan.items():
        shared[dim] = spark.sparkContext.broadcast((rotations(dim, dim, cfg.seed), rotations(dim, k * tables, cfg.seed + 1)[:, : k * tables]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(size).tolist():
                part = batch.take(pa.array(np.flatnonzero(size == dim)))
                x = unit(np.asarray(part.column(1).flatten(), dtype=np.float64).reshape(-1, dim))
                sketch = Sketches(dim, *plan[dim])
                packed = sketch.pack(x, *shared[dim].value)
                keys = sketch.read(pa.chunked_array([packed])).keys
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(x), dim, np.int32)), packed, lists], ["node", "dim", "sketch", "keys"])

    several = distinct.filter(F.size("v").isin(list(plan))).select("node", "v")
    placed = cut(several.mapInArrow(place, "node long, dim int, sketch binary, keys array<long>"))
    bucket = ["dim", "table", "bits"]
    sizes = placed.select("dim", F.posexplode("keys").alias("table", "bits")).groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1")
    met = placed.select("node", "dim", "sketch", F.posexplode("keys").alias("table", "bits")).join(sizes, bucket)
    own = met.withColumn("of", F.ceil(F.col("n") / cfg.block).cast("int")).withColumn("block", F.pmod(F.xxhash64("node", "table"), F.col("of")).cast("int"))
    # Every pair of blocks (i <= j) of a bucket is one group of two blocks at most.
    meets = own.select("*", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other")).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    group = [*bucket, "i", "j"]

    def estimate(key_: tuple, rows_: pa.Table) -> pa.Table:
        dim, table, bits, i, j = (x.as_py() for x in key_)
        sketch = Sketches(dim, *plan[dim]).read(rows_["sketch"])
        block, open_ = rows_["block"].to_numpy(), np.zeros(rows_.num_rows, dtype=bool)
        for p, q, same in block_steps(block, i, j, cfg.step):
            a, b = sketch.undecided(p, q, table, same, cfg)
            open_[p[a]] = open_[q[b]] = True
        n = int(open_.sum())
        named = [pa.array([v] * n, t) for v, t in zip((dim, table, bits, i, j), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
        return pa.table([*named, pa.array(rows_["node"].to_numpy()[open_]), pa.array(block[open_], pa.int32())], names=[*group, "node", "block"])

    narrow = meets.select("node", "sketch", *group, "block")
    wanted = cut(narrow.groupBy(*group).applyInArrow(estimate, "dim int, table int, bits long, i int, j int, node long, block int"))

    def compare(key_: tuple, rows_: pa.Table) -> pa.Table:
        dim, table, _, i, j = (x.as_py() for x in key_)
        x = unit(np.asarray(rows_["v"].combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim))
        sketch = Sketches(dim, *plan[dim]).read(rows_["sketch"])
        node, copies = rows_["node"].to_numpy(), rows_["copies"].to_numpy()
        links, edges = np.zeros(len(node), dtype=np.int64), []
        for p, q, same in block_steps(rows_["block"].to_numpy(), i, j, cfg.step):
            a, b = sketch.undecided(p, q, table, same, cfg)
            near = np.einsum("ij,ij->i", x[p[a]], x[q[b]]) >= cfg.threshold
            a, b = a[near], b[near]
            np.add.at(links, p[a], copies[q[b]])
            np.add.at(links, q[b], copies[p[a]])
            edges += [(p[u], q[w - len(p)]) for u, w in spanning(a, b + len(p), len(p) + len(q))]
        hit = np.flatnonzero(links)
        a, b = (np.array([e[s] for e in edges], dtype=np.int64) for s in (0, 1))
        none = pa.nulls(len(hit), pa.int64())
        counts = pa.chunked_array([pa.array(links[hit]), pa.array(np.zeros(len(a), dtype=np.int64))])
        return pa.table({"node": np.concatenate([node[hit], node[a]]), "links": counts, "other": pa.chunked_array([none, pa.array(node[b])])})

    full = wanted.join(distinct.select("node", "v", "copies"), "node").join(placed.select("node", "sketch"), "node")
    found = cut(full.groupBy(*group).applyInArrow(compare, "node long, links long, other long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.filter(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b")))
    state = distinct.select("node", "v", "least", "copies").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    state = cut(state)
    names = cut(state.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    named = join_skewed(state, names, "root", "members", "node")
    links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    named = cut(named.select("v", links, "component_id", "copies"))
    known = rows.withColumn("v", F.when(good, positive))
    done = join_skewed(known, named, "v", "copies", "vec_id")
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
