"""Packing of tokenised documents into windows of fixed size: best-fit decreasing.

Each document is its tokens by ``tokenizers`` plus an end id.  Overlong documents are first cut
into full windows; what remains is packed, longest first, into the open window of least sufficient
room.  A segment tree over the remaining capacities finds that room in logarithmic time.  The
pieces (three integers each, no text) are dealt at random to shards of about ``shard_pieces``, and
every shard is packed on its own, so at most one window in a shard is poorly filled.

Tokenising: vocabulary and merges are the tokenizer's own.  It separates tokens at white space, so
texts are cut at spaces and line feeds, and each worker remembers the ids of the chunks that it
has met (bounded; emptied when full).  Unknown chunks go to the tokenizer.

Defined results: a null text counts as empty and still gives one piece, its end id.  Repeated rows
give pieces of their own, a null id is carried through, an empty table gives no piece.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

WINDOW, END_ID = 4096, 2


@dataclass(frozen=True)
class PackingConfig:
    tokenizer_path: str
    window: int = WINDOW
    end_id: int = END_ID
    remembered: int = 1_000_000  # chunks kept by a worker
    shard_pieces: int = 50_000


class ChunkTokenizer:
    """Ids of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Known chunks stand in one Arrow column (some 15 bytes each, where a dictionary takes 200); each has
    a code, its place in a table of (offset, length) into one flat array of ids.
    """

    #: Letters that lower-case to one letter of their own wherever they stand, then plain punctuation.
    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([^\w\s'<|>\u0080-\U0010ffff]*)")
    GATHERED = 1 << 18  # chunks whose ids are copied at once
    ENCODED = 1 << 12  # chunks that the tokenizer is given at once

    def __init__(self, path: str, remembered: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        self.closes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.closes[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.known, self.code = pa.array([""], pa.string()), np.zeros(1, dtype=np.int32)
        self.flat = np.zeros(1 << 20, dtype="<u4")
        self.off, self.len = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int32)
        self.used, self.stored = 0, 1

    def _store(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Keep the ids of new chunks, one after the other; their codes."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.stored + len(lengths) > len(self.off):
            self.off, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.off, self.len))
        new = slice(self.stored, self.stored + len(lengths))
        self.flat[self.used : self.used + len(ids)] = ids
        self.off[new] = self.used + np.cumsum(lengths) - lengths
        self.len[new] = lengths
        self.used, self.stored = self.used + len(ids), new.stop
        return np.arange(new.start, new.stop, dtype=np.int32)

    def _gather(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks in a row, and how many each has."""
        n = self.len[code]
        end = np.cumsum(n, dtype=np.int64)
        at = np.repeat(self.off[code] - (end - n), n)
        at += np.arange(len(at))
        return self.flat[at], n

    def _look_up(self, chunks: pa.Array) -> np.ndarray:
        """Codes; -1 for unknown chunks."""
        at = pc.fill_null(pc.index_in(chunks, value_set=self.known), -1).to_numpy()
        return np.where(at < 0, np.int32(-1), self.code[at])

    def _encode(self, chunks: list[str]) -> np.ndarray:
        # The tokenizer's own records of a chunk take far more than its ids, so they are made some at a time.
        parts = (chunks[at : at + self.ENCODED] for at in range(0, len(chunks), self.ENCODED))
        found = [np.array(e.ids, dtype="<u4") for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return self._store(np.concatenate(found), np.array([len(x) for x in found]))

    def _encode_words(self, words: list[str]) -> np.ndarray:
        # A word's last token closes it, so the ids of a joined list of words can be told apart.
        parts = (" ".join(words[at : at + self.ENCODED]) for at in range(0, len(words), self.ENCODED))
        ids = np.concatenate([np.array(self.tokenizer.encode_batch_fast([part], add_special_tokens=False)[0].ids, dtype="<u4") for part in parts])
        ends = np.flatnonzero(self.closes[ids]) + 1
        return self._store(ids, np.diff(ends, prepend=0)) if len(ends) == len(words) else self._encode(words)

    def _learn(self, chunks: pa.Array) -> np.ndarray:
        """Codes of unknown chunks, which are known from now on."""
        code = np.full(len(chunks), -1, dtype=np.int32)
        place, words, tails, other, joined = {}, [], [], [], []  # place: of each distinct word and tail
        word_of = np.full(len(chunks), -1, dtype=np.int32)
        names = chunks.to_pylist()
        for i, c in enumerate(names):
            if m := self.PLAIN.fullmatch(c):
                word, tail = m.groups()
                word_of[i] = place.setdefault(word.lower(), len(place))
                if tail:
                    joined.append(i)
                    tails.append(tail)
            else:
                other.append(i)
        words = pa.array(place, pa.string())
        words_code = self._look_up(words)
        fresh = np.flatnonzero(words_code < 0)
        if len(fresh):
            words_code[fresh] = self._encode_words(words.take(pa.array(fresh)).to_pylist())
        plain = word_of >= 0
        code[plain] = words_code[word_of[plain]]
        if other:
            code[other] = self._encode([names[i] for i in other])
        if joined:
            kinds = list(dict.fromkeys(tails))
            tail_code = dict(zip(kinds, self._encode(kinds).tolist(), strict=True))
            ids, n = self._gather(np.stack([code[joined], [tail_code[t] for t in tails]], axis=1).ravel())
            code[joined] = self._store(ids, n.reshape(-1, 2).sum(axis=1))
        # Words stand for their other forms too; those that are chunks of this batch are listed already.
        more = words.take(pa.array(fresh))
        apart = pc.invert(pc.is_in(more, value_set=chunks))
        self.known = pa.concat_arrays([self.known, chunks, more.filter(apart)])
        self.code = np.concatenate([self.code, code, words_code[fresh][apart.to_numpy(zero_copy_only=False)]])
        return code

    def encode_many(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a string column; a null text has none."""
        chunks = pc.split_pattern(pc.replace_substring(pc.fill_null(column, ""), "\n", " "), " ")
        counted = chunks.flatten().dictionary_encode()
        code = self._look_up(counted.dictionary)
        unknown = code < 0
        if unknown.any():
            if len(self.known) + int(unknown.sum()) > self.remembered:
                self.forget()
                unknown = self._look_up(counted.dictionary) < 0
                code = np.zeros(len(code), dtype=np.int32)
            code[unknown] = self._learn(counted.dictionary.filter(pa.array(unknown)))
        bounds = chunks.offsets.to_numpy()
        code = code[counted.indices.to_numpy()]
        first = 0
        while first < len(chunks):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + self.GATHERED, side="right")) - 1)
            ids, n = self._gather(code[bounds[first] - bounds[0] : bounds[last] - bounds[0]])
            done = np.concatenate([[0], np.cumsum(n)])[bounds[first : last + 1] - bounds[first]]
            for i in range(last - first):
                yield ids[done[i] : done[i + 1]]
            first = last


@lru_cache(maxsize=2)
def _tokenizer(path: str, remembered: int) -> ChunkTokenizer:
    return ChunkTokenizer(path, remembered)


def document_pieces(docs: DataFrame, cfg: PackingConfig, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Full windows and the remainder of every document, with the checksum of each piece's ids."""
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = _tokenizer(cfg.tokenizer_path, cfg.remembered), np.array([cfg.end_id], dtype="<u4")
        for batch in slices(batches, text):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), tokenizer.encode_many(batch.column(1)), strict=True):
                ids = np.concatenate([ids, end])
                rows += [(doc, at, len(p := ids[at : at + cfg.window]), zlib.crc32(p.tobytes()), len(ids)) for at in range(0, len(ids), cfg.window)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class RoomTree:
    """Segment tree over remaining capacities 0..window-1: the least non-empty one that suffices."""

    def __init__(self, window: int):
        self.leaves = 1 << (window - 1).bit_length()
        self.open = [0] * (2 * self.leaves)  # open windows below each node
        self.windows: list[list[int]] = [[] for _ in range(self.leaves)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.open[i] += by
            i >>= 1

    def put(self, window: int, room: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (window, room) of the tightest open window with at least that room."""
        i = least + self.leaves
        if i >= 2 * self.leaves:
            return None
        while not self.open[i]:
            while i & 1:  # a right child: climb until something lies to the right
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return self.windows[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; ``lengths`` descend."""
    tree, at, offset, opened = RoomTree(window), np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        w, room = tree.take(n) or (opened, window)
        opened += w == opened
        at[i], offset[i] = w, window - room
        if room > n:
            tree.put(w, room - n)
    return at, offset


def pack(docs: DataFrame, cfg: PackingConfig, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece."""
    pieces = cut(document_pieces(docs, cfg, key, text))
    shards = max(1, -(-pieces.count() // cfg.shard_pieces))

    def pack_shard(shard: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["shard"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        at, offset = best_fit_decreasing(rows["length"].to_numpy(), cfg.window)
        return rows.append_column("sequence_id", pa.array((shard[0].as_py() << 40) + at)).append_column("offset", pa.array(offset))

    # Full windows take part like any other piece: each fills a window of its own.
    dealt = pieces.withColumn("shard", F.floor(F.rand(17) * shards))  # repeatable: the checkpoint fixes the rows' order
    return dealt.groupBy("shard").applyInArrow(pack_shard, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
