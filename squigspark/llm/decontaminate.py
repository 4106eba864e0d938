"""Benchmark decontamination: BM25 retrieval of test items with block-max pruning, then verification.

Index: an inverted index of the test items.  A posting holds the term's BM25 contribution to the
item, divided by the contribution of all the item's terms together: an item's score for a passage
is the weighted share of the item that the passage holds, and one threshold fits all items.  Items
are ordered by id and stand in blocks; each term keeps its largest contribution for every block.

Query: every whole document is cut into half-overlapping passages, twice as long as the longest
item (or ``least_passage``), so an item's words lie within one passage.  The block maxima of a passage's terms bound the
score of all items of a block.  Only where a bound reaches the threshold does a block-max WAND
traversal of the block's postings follow: it aligns cursors at the pivot, the first item whose
terms' maxima could reach the threshold, and scores what remains.  Every item at or above the
threshold is retrieved; there is no top-k cut.  The bounds are sums over arrays: first over half
passages, where a term in both halves counts twice, then over the terms of the passages left.

Verification: items are split into question and answer (the last sentence; the last quarter of the
words if there is one sentence only).  Both must share at least ``overlap`` of their distinct
five-word shingles with the passage (all words in order for fewer than five).

Terms are words between ASCII white space, lower-cased, without the punctuation at their ends.

The index goes to the executors as a broadcast of bounded size: items are dealt to as many shards as
keep each below ``shard_chars`` characters, and each shard is one pass over the documents.  Where
documents are filtered, at most ``shards_held`` passes are chained before a checkpoint, so a worker never
holds more indexes than that.  Item count, mean length, longest item and document frequencies are those
of all items in every shard, so results do not depend on the number of shards.

Defined results: null and empty texts, and items without a word, match nothing.  Repeated rows match
each on their own; null ids are carried through.  Empty tables give no match.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

SPACE = re.compile(r"[ \t\n\v\f\r]+")
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


@dataclass(frozen=True)
class DecontaminationConfig:
    threshold: float = 0.6  # of an item's BM25 weight
    overlap: float = 0.8
    shingle: int = 5
    k1: float = 1.2
    b: float = 0.75
    block_items: int = 4  # at least; larger where a shard would have more than most_blocks
    most_blocks: int = 256
    least_passage: int = 16  # words of half a passage at least, however short the items are
    bounded_passages: int = 1 << 14  # whose bounds are held at once
    shard_chars: int = 1 << 20
    shards_held: int = 8


def normal_forms(chunks: pa.Array) -> pa.Array:
    """The term of each chunk; empty for chunks without a letter or digit."""
    return pc.replace_substring_regex(pc.utf8_lower(chunks), EDGES, "")


def words_of(text: str) -> list[str]:
    return [w for w in normal_forms(pa.array(SPACE.split(text), pa.string())).to_pylist() if w]


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of question and answer."""
    parts = [w for s in re.split(r"(?<=[.?!:])\s+|\n+", text.strip()) if (w := words_of(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    whole = parts[0] if parts else []
    at = len(whole) - max(1, len(whole) // 4) if len(whole) > 1 else len(whole)
    return whole[:at], whole[at:]


def shingles(words: list[str], k: int) -> set[tuple[str, ...]]:
    if not words:
        return set()
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)}


def held_share(wanted: list[str], passage: list[str], k: int) -> float:
    """Share of the wanted words' shingles that the passage holds; 1 for no words."""
    want = shingles(wanted, k)
    have = shingles(passage, min(k, len(wanted)) or 1) if want else set()
    return len(want & have) / len(want) if want else 1.0


class Statistics(NamedTuple):
    """Of all items with a word, whatever shard they are in."""

    items: int
    mean: float
    longest: int
    df: dict[str, int]  # of a shard's terms at least


class Index:
    """Inverted index of test items with block maxima.  Items without a word are left out.

    Without ``stats`` the items are taken as all there are.
    """

    def __init__(self, items: list[tuple[int | None, str]], cfg: DecontaminationConfig, stats: Statistics | None = None):
        self.cfg = cfg
        kept = [(i, q, a) for i, t in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])) for q, a in [split_item(t or "")] if q or a]
        self.ids = [i for i, _, _ in kept]
        self.question, self.answer = [q for _, q, _ in kept], [a for _, _, a in kept]
        bags = []
        for q, a in zip(self.question, self.answer, strict=True):
            bag: dict[str, int] = defaultdict(int)
            for w in q + a:
                bag[w] += 1
            bags.append(bag)
        lengths = [len(q) + len(a) for _, q, a in kept]
        own_df: dict[str, int] = defaultdict(int)
        for bag in bags:
            for w in bag:
                own_df[w] += 1
        if stats is None:
            stats = Statistics(len(kept), sum(lengths) / max(1, len(lengths)), max(lengths, default=1), own_df)
        total, mean, self.longest, df = stats
        self.terms = {w: i for i, w in enumerate(sorted(own_df))}
        self.postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for item, (bag, n) in enumerate(zip(bags, lengths, strict=True)):
            own = {w: log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) * tf * (cfg.k1 + 1) / (tf + cfg.k1 * (1 - cfg.b + cfg.b * n / mean)) for w, tf in bag.items()}
            whole = sum(own.values())
            for w, x in own.items():
                self.postings[self.terms[w]].append((item, x / whole))
        size = max(cfg.block_items, -(-len(kept) // cfg.most_blocks))
        self.block_max = np.zeros((len(self.terms), max(1, -(-len(kept) // size))), dtype=np.float32)
        self.in_block: dict[tuple[int, int], list[tuple[int, float]]] = defaultdict(list)
        for t, posting in enumerate(self.postings):
            for item, x in posting:
                b = item // size
                self.block_max[t, b] = max(self.block_max[t, b], x * (1 + 1e-6))
                self.in_block[t, b].append((item, x))
        self.in_block = dict(self.in_block)

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All (item, score) at or above the threshold, over the distinct terms."""
        need = self.cfg.threshold - 1e-9
        out = []
        for b in np.flatnonzero(self.block_max[terms].sum(axis=0) >= need - 1e-5).tolist():
            # A cursor: item, place in the block's posting, the term's block maximum, the posting.
            cursors = [[p[0][0], 0, float(self.block_max[t, b]), p] for t in terms if (p := self.in_block.get((t, b)))]
            while cursors:
                cursors.sort(key=lambda c: c[0])
                bound, pivot = 0.0, None
                for c in cursors:
                    bound += c[2]
                    if bound >= need:
                        pivot = c[0]
                        break
                if pivot is None:
                    break
                score = 0.0
                for c in cursors:
                    if c[0] > pivot:
                        break
                    posting, i = c[3], c[1]
                    while i < len(posting) and posting[i][0] < pivot:
                        i += 1
                    if i < len(posting) and posting[i][0] == pivot:
                        score += posting[i][1]
                        i += 1
                    c[0], c[1] = (posting[i][0], i) if i < len(posting) else (-1, i)
                if score >= need:
                    out.append((pivot, score))
                cursors = [c for c in cursors if c[0] >= 0]
        return out


class Matcher:
    """Matches of whole texts."""

    def __init__(self, index: Index):
        self.index = index
        self.vocabulary = pa.array(index.terms, pa.string())

    def match(self, column: pa.Array) -> list[list[tuple[int, float, float, float, int]]]:
        """For each text: (item's place, score, question overlap, answer overlap, first word of the passage)."""
        index, step = self.index, max(self.index.longest, self.index.cfg.least_passage)
        out: list[list[tuple[int, float, float, float, int]]] = [[] for _ in range(len(column))]
        if not index.ids:
            return out
        split = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        counted = split.flatten().dictionary_encode()
        distinct = normal_forms(counted.dictionary)
        # Number of each chunk's term; -1 for words that no item holds, -2 for chunks without a word.
        known = pc.fill_null(pc.index_in(distinct, value_set=self.vocabulary), -1).to_numpy()
        known = np.where(pc.equal(distinct, "").to_numpy(zero_copy_only=False), -2, known)
        chunk = counted.indices.to_numpy()
        term = known[chunk]
        doc = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
        word = np.flatnonzero(term != -2)
        term, doc = term[word], doc[word]
        if not (term >= 0).any():
            return out
        first = np.searchsorted(doc, np.arange(len(split)))  # each text's first word
        half = (np.arange(len(doc)) - first[doc]) // step  # half passages, numbered within the text
        base = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(split)) // step + 2)])
        slot = base[doc] + half  # a free slot after each text: passages never reach into the next one
        hit = np.flatnonzero(term >= 0)
        pair = np.unique(slot[hit] * len(index.terms) + term[hit])
        at, t = pair // len(index.terms), pair % len(index.terms)
        best: list[dict[int, tuple]] = [{} for _ in range(len(column))]
        for s in self.reaching(at, t, int(base[-1])):
            lo, hi = np.searchsorted(at, [s, s + 2])
            found = index.search(np.unique(t[lo:hi]).tolist())
            if not found:
                continue
            d = int(np.searchsorted(base, s, side="right")) - 1
            begin = int(first[d]) + (s - int(base[d])) * step
            end = min(begin + 2 * step, int(np.searchsorted(doc, d, side="right")))
            passage: list[str] = []
            known_best = best[d]
            for item, score in found:
                old, score = known_best.get(item), round(score, 9)
                # Of an item the best passage counts, the first of equals: most others needn't be verified.
                if old is not None and (score < old[1] or score == old[1] and old[2] == old[3] == 1.0):
                    continue
                passage = passage or distinct.take(pa.array(chunk[word[begin:end]])).to_pylist()
                q = held_share(index.question[item], passage, index.cfg.shingle)
                a = held_share(index.answer[item], passage, index.cfg.shingle)
                if q >= index.cfg.overlap and a >= index.cfg.overlap and (old is None or (score, q, a) > old[1:4]):
                    known_best[item] = (item, score, q, a, begin - int(first[d]))
        return [[m[i] for i in sorted(m)] for m in best]

    def reaching(self, at: np.ndarray, t: np.ndarray, slots: int) -> Iterator[int]:
        """First halves of the passages that some block's bound lets reach the threshold, a bounded number of passages at a time."""
        index = self.index
        for begin in range(0, slots, index.cfg.bounded_passages):
            n = min(index.cfg.bounded_passages, slots - begin)
            lo, hi = np.searchsorted(at, [begin, begin + n + 1])
            if lo == hi:
                continue
            own = at[lo:hi] - begin
            bounds = np.zeros((n + 1, index.block_max.shape[1]), dtype=np.float32)
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            # Terms of many passages are looked up in parts, too.
            for k in range(0, len(starts), 1 << 12):
                part = starts[k : k + (1 << 12)]
                end = starts[k + (1 << 12)] if k + (1 << 12) < len(starts) else len(own)
                bounds[own[part]] = np.add.reduceat(index.block_max[t[lo + part[0] : lo + end]], part - part[0], axis=0)
            reach = (bounds[:-1] + bounds[1:]).max(axis=1) >= index.cfg.threshold - 1e-4
            yield from (begin + np.flatnonzero(reach)).tolist()


def with_terms(rows: DataFrame) -> DataFrame:
    """(i, t, n, terms): words and distinct terms of each row of (i, t) that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            words = [[w for side in split_item(t) for w in side] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))], ["i", "t", "n", "terms"])

    return rows.mapInArrow(run, "i long, t string, n long, terms array<string>").filter("n > 0")


def index_shards(benchmark: DataFrame, cfg: DecontaminationConfig, item: str = "item_id", text: str = "text") -> Iterator[Index]:
    """Indexes of at most about ``shard_chars`` characters each; read one shard at a time."""
    rows = benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).filter("t is not null")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    shards = max(1, -(-total // cfg.shard_chars))
    listed = lambda part: [(r.i, r.t) for r in part.select("i", "t").collect()]
    if shards == 1:
        yield Index(listed(rows), cfg)
        return
    parsed = cut(with_terms(rows).withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(shards))))
    items, words, longest = parsed.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    term = parsed.select("shard", F.explode("terms").alias("term"))
    df = cut(term.groupBy("term").agg(F.count("*").alias("n")))
    for s in range(shards):
        own = df.join(term.filter(F.col("shard") == s), "term", "left_semi")  # only the shard's terms come to the driver
        stats = Statistics(items, (words or 0) / max(1, items), longest or 1, {r["term"]: r["n"] for r in own.collect()})
        yield Index(listed(parsed.filter(F.col("shard") == s)), cfg, stats)


def matches(docs: DataFrame, benchmark: DataFrame, cfg: DecontaminationConfig = DecontaminationConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, passage_start): one row for each verified match."""
    kind = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("passage_start", pa.int64())])
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias(text))
    out = None
    for index in index_shards(benchmark, cfg):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = Matcher(shared.value)
            for batch in slices(batches, text, 2 << 20):
                ids = batch.column(0).to_pylist()
                rows = [(d, m.index.ids[i], *rest) for d, found in zip(ids, m.match(batch.column(batch.schema.get_field_index(text))), strict=True) for i, *rest in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

        part = source.mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_start long")
        out = part if out is None else out.unionByName(part)
    return out


def without_matches(docs: DataFrame, benchmark: DataFrame, cfg: DecontaminationConfig = DecontaminationConfig(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a verified match, unchanged; no shuffle."""
    for number, index in enumerate(index_shards(benchmark, cfg)):
        if number and number % cfg.shards_held == 0:
            docs = cut(docs)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = Matcher(shared.value)
            for batch in slices(batches, text, 2 << 20):
                yield batch.filter(pa.array([not found for found in m.match(batch.column(batch.schema.get_field_index(text)))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
