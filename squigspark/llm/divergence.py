"""How far the sources of a language differ in their words: exact triangular discrimination over dense tiles.

Terms are maximal runs of ASCII letters and non-ASCII characters, only A-Z lower-cased.  A language keeps
the terms that ``least_documents`` of its documents hold.  Every (language, source) group gives each kept term
p = 1 + floor(10^9 * (count + 2) / (N + 2 V)), with N the group's kept occurrences and V the language's kept
terms; two groups differ at a term by f = floor((p - q)^2 / (p + q)).

1. Tasks count terms of whole texts, by group, in bounded dictionaries; two aggregations (by group and term,
   then by term) give counts and document frequencies, so no word meets in one task more often than there are
   sources and tasks.
2. A language's kept terms are dealt to blocks of about ``block_terms``, its groups to bands of
   ``band_groups``; a task gets a block and a pair of bands, as int64 tiles (groups x terms).
3. Pairs are broadcast against each other, a group of the first band at a time: partial sums of f for each pair,
   added up over the blocks by Spark.  The tile of a band with itself also gives each group's highest terms
   against the language, as heaps of ``top`` that are merged.  Terms of the block that neither band holds have
   one p a group and count as often as there are of them.

All arithmetic is in integers: quotients are built by long division in steps of 1000, exact while N + 2 V stays
below 9 * 10^15.

Defined results: null text, language and source are ''.  A group without terms takes part, with the p of count
0.  A language without kept terms has pairs of value 0 and no terms.  Repeated rows count as documents of
their own; an empty table gives an empty result.  Equal values are ranked by the item's UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, slices

#: What a term is not made of, and the scale of p.
BETWEEN = rb"[\x00-\x40\x5B-\x60\x7B-\x7F]"
TERM = re.compile(BETWEEN.replace(b"[", b"[^", 1) + b"+")
SCALE_STEPS, STEP = 3, 1000  # 10^9


@dataclass(frozen=True)
class DivergenceConfig:
    least_documents: int = 10
    top: int = 10
    block_terms: int = 1024
    band_groups: int = 128
    held_terms: int = 400_000  # entries of a task's dictionaries
    piece_bytes: int = 1 << 20  # of a long text at a time
    broadcast_groups: int = 100_000  # some ten MB


def pieces(data: bytes, most: int) -> Iterator[bytes]:
    """``data`` in parts of about ``most`` bytes that no term crosses."""
    at, between = 0, re.compile(BETWEEN)
    while len(data) - at > most:
        found = between.search(data, at + most)
        end = found.end() if found else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def term_counts(docs: DataFrame, cfg: DivergenceConfig) -> DataFrame:
    """(lang, source, term, n, docs), partial; the empty term stands for the group itself.  ``docs``: (text, lang, source)."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}
        documents: dict[tuple, Counter] = {}
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in counts.items():
                terms = list(own)
                cols = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64()), pa.array([documents[lang, source][t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names)
            counts.clear()
            documents.clear()

        for batch in slices(batches):
            for text, lang, source in zip(batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = counts.setdefault((lang, source), Counter({b"": 0}))
                before, seen = len(own), set()
                for part in pieces(text.lower(), cfg.piece_bytes):
                    found = TERM.findall(part)
                    own.update(found)
                    seen.update(found)
                documents.setdefault((lang, source), Counter()).update(seen)
                held += len(own) - before
                if held > cfg.held_terms:
                    yield from rows()
                    held = 0
        yield from rows()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(empty("text"), empty("lang"), empty("source")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def scaled(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / whole), exactly."""
    rest = count + 2
    out = rest // whole
    rest = rest % whole
    for _ in range(SCALE_STEPS):
        rest = rest * STEP
        out = out * STEP + rest // whole
        rest = rest % whole
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def tile(table: pa.Table, cfg: DivergenceConfig) -> pa.Table:
    """Partial results of one block of terms and one pair of bands: kind 0 pairs (i, j, value), kind 1 terms (i, term, value).

    Rows of the empty term list the groups, with their N, the block's terms and the language's V and N.
    """
    kinds = pa.schema([("lang", pa.string()), ("kind", pa.int8()), ("i", pa.int64()), ("j", pa.int64()), ("term", pa.string()), ("value", pa.int64())])
    lang, first, second = (table[c][0].as_py() for c in ("lang", "first", "second"))
    column = {c: table[c].to_numpy() for c in ("i", "n", "total", "own", "kept", "kept_n", "block_terms")}
    names = np.array(table["term"].to_pylist(), dtype=object)
    heads = np.flatnonzero(names == "")
    groups = np.unique(column["i"][heads])
    own = np.zeros(len(groups), np.int64)
    own[np.searchsorted(groups, column["i"][heads])] = column["own"][heads]
    kept, kept_n, in_block = (int(column[c][heads[0]]) for c in ("kept", "kept_n", "block_terms"))
    rows = np.flatnonzero(names != "")
    terms, of = np.unique(names[rows], return_inverse=True) if len(rows) else (np.zeros(0, object), np.zeros(0, np.int64))
    counts = np.zeros((len(groups), len(terms)), np.int64)
    counts[np.searchsorted(groups, column["i"][rows]), of] = column["n"][rows]
    out: dict[str, list] = {n: [] for n in kinds.names}

    def put(kind: int, i: int, j: np.ndarray, term: list, value: np.ndarray) -> None:
        for n, x in zip(kinds.names, ([lang] * len(value), [kind] * len(value), [i] * len(value), j.tolist(), term, value.tolist()), strict=True):
            out[n] += x

    whole = np.maximum(own + 2 * kept, 1)
    p, none = scaled(counts, whole[:, None]), scaled(np.zeros(len(groups), np.int64), whole)
    absent = in_block - len(terms)
    band = groups // cfg.band_groups
    left, right = np.flatnonzero(band == first), np.flatnonzero(band == second)
    for g in left:
        to = right[right > g] if first == second else right
        value = apart(p[g], p[to]).sum(axis=1) + absent * apart(none[g], none[to]) if kept else np.zeros(len(to), np.int64)
        put(0, int(groups[g]), groups[to], [""] * len(to), value)
    if first == second and len(terms):
        total = np.zeros(len(terms), np.int64)
        total[of] = column["total"][rows]
        q = scaled(total, np.int64(kept_n + 2 * kept))
        for g in left:
            at = np.flatnonzero((counts[g] > 0) & (p[g] > q))
            value = apart(p[g][at], q[at])
            best = heapq.nsmallest(cfg.top, zip((-value).tolist(), terms[at].tolist(), strict=True))
            put(1, int(groups[g]), np.zeros(len(best), np.int64), [t for _, t in best], -np.array([v for v, _ in best], np.int64))
    return pa.table(out, kinds)


def source_divergence(docs: DataFrame, cfg: DivergenceConfig | None = None, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): every pair of sources, and the ``top`` terms of each source."""
    cfg = cfg or DivergenceConfig()
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    by_group = term_counts(rows, cfg).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    held = by_group.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("total"))
    kept = cut(held.filter((F.col("docs") >= cfg.least_documents) | (F.col("term") == "")).select("lang", "source", "term", "n", "total"))

    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - F.lit(1)
    langs = groups.groupBy("lang").agg(F.sum("own").alias("kept_n"), F.count("*").alias("groups"))
    terms = kept.filter("term <> ''").groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("kept"))
    sized = langs.join(terms, "lang", "left").select("lang", "kept_n", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), F.ceil(F.col("groups") / cfg.band_groups).alias("bands"))
    sized = sized.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") / cfg.block_terms)))
    numbered = cut(groups.withColumn("i", place.cast("long")).join(sized, "lang"))

    # Rows of a hot source stay where they are, unless there are so many sources that none has a large share.
    known = numbered.select("lang", "source", "i", "blocks", "bands")
    known = F.broadcast(known) if numbered.count() <= cfg.broadcast_groups else known
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("long").alias("block")
    placed = kept.filter("term <> ''").join(known, ["lang", "source"]).select("lang", "i", "bands", "term", "n", "total", block)
    in_blocks = placed.groupBy("lang", "block", "term").agg(F.lit(1).alias("one")).groupBy("lang", "block").agg(F.count("*").alias("block_terms"))
    heads = numbered.select("lang", "i", "own", "kept", "kept_n", "bands", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    heads = heads.join(in_blocks, ["lang", "block"], "left").select("lang", "block", "i", F.lit("").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"), "own", "kept", "kept_n", F.coalesce("block_terms", F.lit(0)).cast("long").alias("block_terms"), "bands")
    none = [F.lit(0).cast("long").alias(c) for c in ("own", "kept", "kept_n", "block_terms")]
    body = placed.select("lang", "block", "i", "term", "n", "total", *none, "bands")
    band = F.floor(F.col("i") / cfg.band_groups)
    both = heads.unionByName(body).withColumn("band", band).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bands") - 1)))
    dealt = both.select("lang", "block", F.least("band", "other").alias("first"), F.greatest("band", "other").alias("second"), "i", "term", "n", "total", "own", "kept", "kept_n", "block_terms")
    found = cut(dealt.groupBy("lang", "block", "first", "second").applyInArrow(lambda t: tile(t, cfg), "lang string, kind byte, i long, j long, term string, value long"))

    sums = found.filter("kind = 0").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e")
    pairs = sums.select("lang", "value", ends).select("lang", "value", "e.i", "e.j")
    named = pairs.join(numbered.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), ["lang", "j"]).select("lang", "i", F.lit("pair").alias("part"), "item", "value")
    tops = found.filter("kind = 1").select("lang", "i", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "i", "part").orderBy(F.desc("value"), "item"))
    best = tops.withColumn("rank", rank).filter(F.col("rank") <= cfg.top).unionByName(named.withColumn("rank", rank))
    return best.join(numbered.select("lang", "i", "source"), ["lang", "i"]).select("lang", "source", "part", "item", "value", "rank")
