"""Removal of long passages that stand in an earlier document already: run-length Burrows-Wheeler indexes.

A byte goes if it lies in a string of ``window`` bytes that also begins in a document with a smaller id.
Matches never cross documents; strings are judged on the input, so what is removed still counts as a source.

1. Documents are packed into chunks of some megabytes, written to the shared folder once.
2. Every window has an anchor: the k-gram of least hash in it, so equal windows have equal anchors.  A chunk
   sends each of its anchors once, whatever the number of its documents that hold it.  An anchor of two
   documents is shared; its leader is the place (two kilobytes of a chunk) where it stands first.
3. Runs of neighbouring windows whose shared anchors have one leader are regions.  All windows of an anchor
   go to the leader's shard, so equal windows meet, and a passage of any length is sent about once.  A
   chunk sends equal regions once.  Windows of an anchor that is too common for one shard (``crowded``)
   go to shards of their own bytes instead, one by one; as most of them hold a common line's neighbours and stand
   nowhere else, hashes of them all are compared first, and only those that two documents share are sent.
4. A shard's distinct regions are indexed: suffixes are sorted, the Burrows-Wheeler transform is kept as
   runs with the suffix of each run's first and last row, and for rows that agree in ``window`` bytes the
   least document id, run by run.  All regions are streamed against it backwards, in step: a letter
   that the run of the current row has is a last-to-first step, any other goes to the nearer end of a run of
   that letter, and the sampled suffixes say how much still matches (Bannai, Gagie and I, 2020).
5. Where the match reaches ``window`` bytes and the rows' least id is smaller, the window is covered.  The
   intervals return to the chunks, which are cut accordingly.

Defined results: a null text is empty.  A null id counts as larger than all others; rows of one id are not
earlier than each other.  Repeated rows each give a row.  An empty table gives an empty result.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, slices

NO_ID = np.iinfo(np.int64).max
#: Odd multipliers of the anchors' hash.
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class PassageConfig:
    window: int = 50
    gram: int = 16  # bytes of an anchor
    chunk_bytes: int = 4 << 20
    shard_bytes: int = 1 << 20  # text for which there is one shard; a table of anchors has sixteen times as much
    leader_bytes: int = 2048
    region_windows: int = 512  # longer regions are cut; the parts overlap by a window less one byte
    crowded: int = 65_536  # occurrences, counted up to 255 in a chunk
    groups: int = 1024  # shards beyond this number are sent several together, 16 at most

    def __post_init__(self) -> None:
        if not 8 <= self.gram <= min(24, self.window):
            raise ValueError("an anchor has 8 to 24 bytes and fits a window")


def words_at_bytes(raw: bytes) -> np.ndarray:
    """The eight bytes from each place on, first byte lowest."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))


class RunIndex:
    """Run-length Burrows-Wheeler index of texts; the end of each text is a letter of its own, earlier texts first.

    ``owners``: the document of each text.  ``least``: of rows that agree in ``window`` bytes the least owner.
    """

    def __init__(self, texts: list[bytes], owners: np.ndarray, window: int):
        self.window = window
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = b"\0".join([*texts, bytes(self.window + 16)])
        self.data, self.words = np.frombuffer(raw, np.uint8), words_at_bytes(raw)
        n = int(sizes.sum()) + len(texts)
        ends = np.cumsum(sizes + 1) - 1
        text_of = np.repeat(np.arange(len(texts)), sizes + 1)
        self.left = ends[text_of] - np.arange(n)  # bytes up to the end of the text
        before = np.r_[np.int64(0), self.data[: n - 1].astype(np.int64) + 1]
        before[ends - sizes] = 0  # nothing stands before a text
        order, same = self._sorted(n, text_of, before)
        before = before[order]
        heads = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        self.letters = before[heads]
        lengths = np.diff(np.r_[heads, n])
        self.ends = heads + lengths - 1
        self.first, self.last = order[heads], order[self.ends]
        by = np.argsort(self.letters, kind="stable")
        passed = np.empty(len(heads), np.int64)
        passed[by] = np.cumsum(lengths[by]) - lengths[by]  # with all smaller letters: where the first row of the run leads to
        # Rows that begin with a text's end come first: as many as rows that nothing stands before.
        self.starts, self.shift = heads, passed - heads
        self.run_of = np.repeat(np.arange(len(heads), dtype=np.int32), lengths)
        self.by_letter = self.letters[by] * len(heads) + by
        classes = np.flatnonzero(~same)
        least = np.minimum.reduceat(np.where(self.left[order] >= window, owners[text_of[order]], NO_ID), classes)
        change = np.r_[True, least[1:] != least[:-1]]
        self.tags = least[change]
        self.tag_of = np.repeat(np.arange(len(self.tags), dtype=np.int32), np.diff(np.r_[classes[change], n]))

    def _sorted(self, n: int, text_of: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order, by doubling; and which rows agree with the row before in ``window`` bytes.

        Only the first ``window`` bytes or more are sorted.  A step from any row of a class of equal beginnings
        ends in the right class, and matches count up to ``window``, so what follows doesn't matter; there
        the letter before decides if it fits the key, which makes runs longer.
        """
        present = np.zeros(257, np.int64)
        present[1 + np.flatnonzero(np.bincount(self.data[:n], minlength=256))] = 1
        codes, base = np.cumsum(present), int(present.sum()) + 1
        symbols = np.r_[codes[1:][self.data[:n]], np.zeros(64, np.int64)]
        key, depth = np.zeros(n, np.int64), 0
        while depth < 7 and base ** (depth + 1) * n < 1 << 63:
            key *= base
            key += np.where(self.left > depth, symbols[depth : depth + n], 0)
            depth += 1
        ranks: dict[int, np.ndarray] = {}

        def ranked(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
            """Order and ranks of keys below ``most``.  Where key and place fit one number, plain numbers are sorted, which is much faster."""
            if most * n < 1 << 63:
                sorted_key, order = np.divmod(np.sort(key * n + np.arange(n)), n)
            else:
                order = np.argsort(key)
                sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[False, sorted_key[1:] != sorted_key[:-1]])
            return order, rank

        order, rank = ranked(key, base**depth)
        if depth <= self.window:
            ranks[depth] = rank
        done = False
        while not done and rank.max() < n - 1:
            second = text_of.copy()
            inside = np.flatnonzero(self.left >= depth)
            second[inside] = text_of[-1] + 1 + rank[inside + depth]
            depth *= 2
            done = depth > self.window
            most = int(second.max()) + 1
            key, most = rank * most + second, (int(rank.max()) + 1) * most
            if done and most * 257 * n < 1 << 63:
                key, most = key * 257 + before, most * 257
            order, rank = ranked(key, most)
            if not done:
                ranks[depth] = rank
        return order, self._same(order, ranks)

    def _same(self, order: np.ndarray, ranks: dict[int, np.ndarray]) -> np.ndarray:
        a, b = order[:-1], order[1:]
        same = (self.left[a] >= self.window) & (self.left[b] >= self.window)
        at = np.flatnonzero(same)
        depth = max([d for d in ranks if d <= self.window], default=0)  # of what ranks tell
        if depth:  # two overlapping stretches make up the window
            steps = [*range(0, self.window - depth, depth), self.window - depth]
            for s in steps:
                at = at[ranks[depth][a[at] + s] == ranks[depth][b[at] + s]]
        else:
            for s in range(self.window):
                at = at[self.data[a[at] + s] == self.data[b[at] + s]]
        out = np.zeros(len(order), bool)
        out[at + 1] = True
        return out

    def _common(self, places: np.ndarray, words: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes, up to ``most``, that the index's text has at ``places`` as the texts whose ``words`` are given have ``at``.

        Eight bytes are compared at a time, all stretches together.
        """
        steps = 8 * np.arange(-(-self.window // 8))
        differ = self.words[places[:, None] + steps] ^ words[at[:, None] + steps]
        first = np.argmax(differ != 0, axis=1)
        d = differ[np.arange(len(places)), first]
        lowest = np.where(d == 0, 8 * len(steps), 8 * first + np.log2((d & (~d + np.uint64(1))).astype(np.float64), where=d != 0, out=np.zeros(len(d))).astype(np.int64) // 8)
        return np.minimum(lowest, np.minimum(most, self.left[places]))

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of all texts, streamed from their ends.

        At each step: how far from the end (1 first), which texts are that long, how many bytes match there
        (up to ``window``), and a row of the index that begins with them.
        """
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        by = np.argsort(-sizes, kind="stable")
        raw = b"".join([*texts, bytes(self.window + 16)])
        data, words = np.frombuffer(raw, np.uint8), words_at_bytes(raw)
        ends = np.cumsum(sizes)[by]
        sizes = sizes[by]
        row, length = np.zeros(len(by), np.int64), np.zeros(len(by), np.int64)
        runs = len(self.starts)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            n = int(np.searchsorted(-sizes, -step, "right"))  # texts that long
            row, length = row[:n], length[:n]
            at = ends[:n] - step
            letter = data[at].astype(np.int64) + 1
            run = self.run_of[row]
            other = np.flatnonzero(self.letters[run] != letter)
            length = np.minimum(length + 1, self.window)
            if len(other):
                want, here = letter[other], run[other].astype(np.int64)
                place = np.searchsorted(self.by_letter, want * runs + here)
                best, target = np.full(len(other), -1), np.zeros(len(other), np.int64)
                for step_to, sample in ((-1, self.last), (0, self.first)):
                    spot = place + step_to
                    found = self.by_letter[np.clip(spot, 0, runs - 1)]
                    ok = np.flatnonzero((spot >= 0) & (spot < runs) & (found // runs == want))
                    there = found[ok] % runs
                    l = self._common(sample[there], words, at[other[ok]] + 1, length[other[ok]] - 1)  # noqa: E741
                    ok_better = l > best[ok]
                    better = ok[ok_better]
                    best[better] = l[ok_better]
                    target[better] = there[ok_better] if step_to == 0 else -1 - there[ok_better]
                # A row in the run before is its last one, in the run after its first one.
                up = target < 0
                to = np.where(up, -1 - target, target)
                run[other] = to
                row[other] = np.where(up, self.ends[to], self.starts[to])
                length[other] = best + 1
            row = row + self.shift[run]
            if len(other):
                row[length == 0] = 0  # a letter that the index doesn't have
            yield step, by[:n], length, row

    def least(self, row: np.ndarray) -> np.ndarray:
        return self.tags[self.tag_of[row]]


def earlier_windows(texts: list[bytes], owners: np.ndarray, window: int) -> list[np.ndarray]:
    """For each text, which of its windows stand in a text of a smaller owner."""
    index = RunIndex(texts, owners, window)
    out = [np.zeros(max(0, len(t) - window + 1), bool) for t in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.cumsum(sizes) - sizes
    flat = np.zeros(int(sizes.sum()), bool)
    for step, which, length, row in index.matches(texts):
        if step >= window:
            long = np.flatnonzero(length >= window)
            hit = long[index.least(row[long]) < owners[which[long]]]
            flat[offsets[which[hit]] + sizes[which[hit]] - step] = True
    for o, at in zip(out, offsets, strict=True):
        o[:] = flat[at : at + len(o)]
    return out


@dataclass
class Chunk:
    number: int
    ids: list
    sizes: np.ndarray
    data: bytes

    @property
    def owners(self) -> np.ndarray:
        return np.array([NO_ID if i is None else i for i in self.ids], np.int64)


def write_chunks(docs: DataFrame, cfg: PassageConfig, key: str, text: str, path: str) -> None:
    """Documents packed into rows (chunk, ids, sizes, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, packer = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(3)
        ids, parts, held = [], [], 0

        def row() -> pa.RecordBatch:
            columns = [[number], [ids], [list(map(len, parts))], [packer.compress(b"".join(parts))]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["chunk", "ids", "sizes", "blob"])

        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        for batch in slices(batches, "text"):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                t = t or b""
                if parts and held + len(t) > cfg.chunk_bytes:
                    yield row()
                    number, ids, parts, held = number + 1, [], [], 0
                ids.append(i)
                parts.append(t)
                held += len(t)
        if parts:
            yield row()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows.mapInArrow(run, "chunk long, ids array<long>, sizes array<long>, blob binary").write.parquet(path)


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, dict]]:
    """Chunks one at a time, with the row's other columns."""
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(batch.num_rows):
            r = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
            sizes = np.array(r.pop("sizes").as_py(), np.int64)
            yield Chunk(r.pop("chunk").as_py(), r.pop("ids").as_py(), sizes, unpacker.decompress(r.pop("blob").as_py(), max(1, int(sizes.sum())))), r


def gram_hashes(data: bytes, begin: int, end: int, gram: int) -> np.ndarray:
    """A hash of each k-gram that begins in the range; what lies behind the data counts as zeros."""
    raw = data[begin : end + gram] + b"\0" * max(8, end + gram - len(data) + 8)
    words = np.ndarray((end - begin + gram - 8,), "<u8", raw, strides=(1,)).copy()
    n = end - begin
    h = words[:n] * MIX[0]
    h ^= h >> np.uint64(31)
    if gram > 16:
        h = (h + words[8 : 8 + n]) * MIX[1]
        h ^= h >> np.uint64(29)
    h = (h + words[gram - 8 : gram - 8 + n]) * MIX[1]
    h ^= h >> np.uint64(32)
    h *= MIX[2]
    return h ^ h >> np.uint64(29)


PART, PLACE = 1 << 18, np.uint64((1 << 20) - 1)


def anchored(chunk: Chunk, cfg: PassageConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with one anchor: first window, end (exclusive), hash of the anchor, document's place in the chunk.

    Ties of the hash's upper bits go to the anchor that stands first.
    """
    total, span = len(chunk.data), cfg.window - cfg.gram + 1
    document = np.repeat(np.arange(len(chunk.sizes), dtype=np.int32), chunk.sizes)
    found = []
    for begin in range(0, max(0, total - cfg.window + 1), PART):
        n = min(PART, total - cfg.window + 1 - begin)
        h = gram_hashes(chunk.data, begin, begin + n + span - 1, cfg.gram)
        least = h & ~PLACE | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        anchor = (least & PLACE).astype(np.int64)
        own = document[begin : begin + n]
        anchor[own != document[begin + cfg.window - 1 : begin + cfg.window - 1 + n]] = -1
        edge = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])])
        stop = np.r_[edge[1:], n]
        keep = anchor[edge] >= 0
        edge, stop = edge[keep], stop[keep]
        found.append((edge + begin, stop + begin, h[anchor[edge]], own[edge].astype(np.int64)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))  # type: ignore[return-value]


def anchor_keys(hashes: np.ndarray, tables: int) -> np.ndarray:
    """The anchor's table and its 32 bits there, as one number.  Clashes only send more text."""
    return (hashes >> np.uint64(32)) % np.uint64(tables) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


def _rows(names: list[str], rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def shared_anchors(chunks: DataFrame, cfg: PassageConfig, tables: int, shards: int) -> DataFrame:
    """(chunk, part, shared, shards, crowded): which of a chunk's distinct anchors two documents hold, by table.

    ``shared`` has a bit for each of the chunk's anchors in that table, in order, and ``shards`` their leaders' shards;
    -1 marks a crowded anchor.  ``crowded`` has the keys of such anchors, in one row of each table.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in chunk_rows(batches):
            first, _, hashes, document = anchored(chunk, cfg)
            keys, at, inverse, counts = np.unique(anchor_keys(hashes, tables), return_index=True, return_inverse=True, return_counts=True)
            owner = chunk.owners[document]
            several = np.zeros(len(keys), bool)
            several[inverse[owner != owner[at][inverse]]] = True
            block = (first[at] // cfg.leader_bytes).astype("<u4")
            part = (keys >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
            rows = []
            for a, b in zip(cuts, [*cuts[1:], len(keys)][: len(cuts)], strict=True):
                s = slice(a, b)
                rows.append((int(part[a]), chunk.number, keys[s].astype("<u4").tobytes(), np.minimum(counts[s], 255).astype(np.uint8).tobytes(), np.packbits(several[s]).tobytes(), block[s].tobytes()))
            if rows:
                yield _rows(["part", "chunk", "grams", "counts", "several", "blocks"], rows, [pa.int32(), pa.int64(), *[pa.binary()] * 4])

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        grams = [np.frombuffer(x, "<u4") for x in table["grams"].to_pylist()]
        sizes = np.array(list(map(len, grams)))
        chunk = np.array(table["chunk"].to_pylist(), np.int64)
        row = np.repeat(np.arange(len(grams)), sizes)
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table["counts"].to_pylist()]).astype(np.int64)
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table["several"].to_pylist(), sizes, strict=True)])
        block = np.concatenate([np.frombuffer(x, "<u4") for x in table["blocks"].to_pylist()]).astype(np.int64)
        gram = np.concatenate(grams)
        by = np.argsort(gram, kind="stable")
        head = np.flatnonzero(np.r_[True, gram[by][1:] != gram[by][:-1]])
        held = np.diff(np.r_[head, len(by)])
        shared = (held > 1) | (np.maximum.reduceat(several[by], head) > 0)
        leader = chunk[row[by[head]]] * 1_000_003 + block[by[head]]
        crowded = shared & (np.add.reduceat(counts[by], head) > cfg.crowded)
        shard = np.where(crowded, -1, spread_number(leader & 0x7FFFFFFFFFFFFFFF, shards)).astype("<i4")
        part = int(table["part"][0].as_py())
        named = (part << 32 | gram[by[head[crowded]]].astype(np.int64)).astype("<i8").tobytes() if crowded.any() else None
        of = np.empty(len(by), np.int64)
        of[by] = np.repeat(np.arange(len(head)), held)
        at = np.cumsum(sizes) - sizes
        rows = []
        for i in range(len(grams)):
            own = of[at[i] : at[i] + sizes[i]]
            if shared[own].any():
                rows.append((int(chunk[i]), part, np.packbits(shared[own]).tobytes(), shard[own[shared[own]]].tobytes(), named))
                named = None
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3]
        return pa.Table.from_batches([_rows(names, rows, kinds)] if rows else [], pa.schema(list(zip(names, kinds, strict=True))))

    names = ["chunk", "part", "shared", "shards", "crowded"]
    sent = chunks.mapInArrow(send, "part int, chunk long, grams binary, counts binary, several binary, blocks binary")
    return sent.groupBy("part").applyInArrow(answer, "chunk long, part int, shared binary, shards binary, crowded binary")


def spread_number(x: np.ndarray, shards: int) -> np.ndarray:
    h = x.astype(np.uint64) * MIX[0]
    return ((h ^ h >> np.uint64(29)) * MIX[1] >> np.uint64(33)).astype(np.int64) % shards


def crowded_windows(data: bytes, first: np.ndarray, end: np.ndarray, document: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, document) of each window in stretches of windows."""
    n = end - first
    places = np.arange(int(n.sum())) + np.repeat(first - np.cumsum(n) + n, n)
    words, h = words_at_bytes(data) if len(data) >= 8 else np.zeros(0, "<u8"), np.zeros(len(places), np.uint64)
    for step in [*range(0, window - 8, 8), window - 8]:
        h = (h ^ words[places + step]) * MIX[step // 8 % 3]
        h ^= h >> np.uint64(29)
    return places, h, np.repeat(document, n)


def window_tables(hashes: np.ndarray, tables: int) -> np.ndarray:
    """Tables of windows' hashes, in the hashes' order."""
    return ((hashes >> np.uint64(32)) * np.uint64(tables) >> np.uint64(32)).astype(np.int64)


def table_cuts(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each table with the stretch that is its own."""
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=False):
        yield int(part[a]), slice(a, b)


def shared_windows(chunks: DataFrame, crowded: np.ndarray, cfg: PassageConfig, tables: int) -> DataFrame:
    """(chunk, part, shared): which of a chunk's distinct windows with a crowded anchor two documents hold, by table.

    ``crowded``: sorted keys of the crowded anchors.  Windows are told apart by hashes; clashes only send more text.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in chunk_rows(batches):
            first, end, hashes, document = anchored(chunk, cfg)
            keep = np.isin(anchor_keys(hashes, tables).view(np.int64), crowded)
            _, h, document = crowded_windows(chunk.data, first[keep], end[keep], document[keep], cfg.window)
            known, at, inverse = np.unique(h, return_index=True, return_inverse=True)
            owner = chunk.owners[document]
            several = np.zeros(len(known), bool)
            several[inverse[owner != owner[at][inverse]]] = True
            rows = [(part, chunk.number, known[s].tobytes(), np.packbits(several[s]).tobytes()) for part, s in table_cuts(window_tables(known, tables))]
            if rows:
                yield _rows(["part", "chunk", "hashes", "several"], rows, [pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    def answer(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, "<u8") for x in table["hashes"].to_pylist()]
        sizes = np.array(list(map(len, hashes)))
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table["several"].to_pylist(), sizes, strict=True)])
        _, of, held = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        shared = ((held > 1) | (np.bincount(of, several) > 0))[of]
        rows = [(c, p, np.packbits(x).tobytes()) for c, p, x in zip(table["chunk"].to_pylist(), table["part"].to_pylist(), np.split(shared, np.cumsum(sizes)[:-1]), strict=True) if x.any()]
        kinds = [pa.int64(), pa.int32(), pa.binary()]
        return pa.Table.from_batches([_rows(names, rows, kinds)] if rows else [], pa.schema(list(zip(names, kinds, strict=True))))

    names = ["chunk", "part", "shared"]
    sent = chunks.mapInArrow(send, "part int, chunk long, hashes binary, several binary")
    return sent.groupBy("part").applyInArrow(answer, "chunk long, part int, shared binary")


def shared_regions(chunks: DataFrame, shared: DataFrame, windows: DataFrame | None, cfg: PassageConfig, tables: int, shards: int) -> DataFrame:
    """(group, chunk, shards, texts_in, sizes, texts, counts, owners, places): a chunk's distinct regions for a group of shards, each with its occurrences.

    ``texts_in`` says how many of the regions are for each of the ``shards``.
    """
    groups = min(shards, max(cfg.groups, -(-shards // 16)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, more in chunk_rows(batches):
            yield from regions(chunk, more["found"].as_py())

    def regions(chunk: Chunk, found: list[dict]) -> Iterator[pa.RecordBatch]:
        first, end, hashes, document = anchored(chunk, cfg)
        keys, inverse = np.unique(anchor_keys(hashes, tables), return_inverse=True)
        shard_of = np.full(len(keys), -2, np.int32)
        cuts = dict(table_cuts((keys >> np.uint64(32)).astype(np.int64)))
        for f in found:
            if f["shards"] is not None:
                own = shard_of[cuts[f["part"]]]
                own[np.unpackbits(np.frombuffer(f["shared"], np.uint8), count=len(own)).astype(bool)] = np.frombuffer(f["shards"], "<i4")
        shard = shard_of[inverse]
        owners = chunk.owners
        known: dict[int, dict[bytes, list]] = {}
        crowded = shard == -1
        if crowded.any():
            places, h, own = crowded_windows(chunk.data, first[crowded], end[crowded], document[crowded], cfg.window)
            unique, which = np.unique(h, return_inverse=True)
            twice = np.zeros(len(unique), bool)
            cuts = dict(table_cuts(window_tables(unique, tables)))
            for f in found:
                if f["shards"] is None:
                    part = twice[cuts[f["part"]]]
                    part[:] = np.unpackbits(np.frombuffer(f["shared"], np.uint8), count=len(part))
            keep = twice[which]
            for at, to, d in zip(places[keep].tolist(), spread_number(h[keep], shards).tolist(), own[keep].tolist(), strict=True):
                known.setdefault(to, {}).setdefault(chunk.data[at : at + cfg.window], []).append((int(owners[d]), at))
        keep = np.flatnonzero(shard >= 0)
        first, end, document, shard = first[keep], end[keep], document[keep], shard[keep]
        joins = (first[1:] == end[:-1]) & (document[1:] == document[:-1]) & (shard[1:] == shard[:-1])
        head = np.flatnonzero(np.r_[True, ~joins]) if len(first) else np.zeros(0, np.int64)
        width = cfg.window - 1
        for a, b, s, d in zip(first[head].tolist(), end[np.r_[head[1:] - 1, len(end) - 1]].tolist() if len(head) else [], shard[head].tolist(), document[head].tolist(), strict=True):
            for at in range(a, b, cfg.region_windows):
                known.setdefault(s, {}).setdefault(chunk.data[at : min(at + cfg.region_windows, b) + width], []).append((int(owners[d]), at))
        together: dict[int, list[int]] = {}
        for to in known:
            together.setdefault(to % groups, []).append(to)
        rows = []
        for group, own in together.items():
            texts = [t for to in own for t in known[to]]
            held = [ps for to in own for ps in known[to].values()]
            pairs = [p for ps in held for p in ps]
            numbers = ((own, "<i4"), ([len(known[to]) for to in own], "<i4"), ([*map(len, texts)], "<i4"), ([*map(len, held)], "<i4"), ([p[0] for p in pairs], "<i8"), ([p[1] for p in pairs], "<i4"))
            to, texts_in, sizes, *rest = (np.array(x, k).tobytes() for x, k in numbers)
            rows.append((group, chunk.number, to, texts_in, sizes, b"".join(texts), *rest))
        for i in range(0, len(rows), 10_000):
            yield _rows(names, rows[i : i + 10_000], [pa.int32(), pa.int64(), *[pa.binary()] * 7])

    names = ["group", "chunk", "shards", "texts_in", "sizes", "texts", "counts", "owners", "places"]
    marks = shared.select("chunk", "part", "shared", "shards")
    if windows is not None:
        marks = marks.unionByName(windows.withColumn("shards", F.lit(None).cast("binary")))
    asked = marks.groupBy("chunk").agg(F.collect_list(F.struct("part", "shared", "shards")).alias("found"))
    rows = chunks.join(asked, "chunk").select("chunk", "ids", "sizes", "blob", "found")
    return rows.mapInArrow(send, "group int, chunk long, shards binary, texts_in binary, sizes binary, texts binary, counts binary, owners binary, places binary")


def covered(regions: DataFrame, cfg: PassageConfig) -> DataFrame:
    """(chunk, spans): byte ranges of chunks that stand in earlier documents; pairs of 32-bit numbers."""

    def answer(table: pa.Table) -> pa.Table:
        #: Of each shard: row of the table, sizes of its regions, their bytes, their numbers of occurrences, and owners and places of these.
        parts: dict[int, list[tuple]] = {}
        for row, (to, texts_in, sizes, texts, counts, owners, places) in enumerate(zip(*(table[n].to_pylist() for n in ("shards", "texts_in", "sizes", "texts", "counts", "owners", "places")), strict=True)):
            sizes, counts = np.frombuffer(sizes, "<i4").astype(np.int64), np.frombuffer(counts, "<i4").astype(np.int64)
            owners, places = np.frombuffer(owners, "<i8"), np.frombuffer(places, "<i4").astype(np.int64)
            edge = np.cumsum(np.r_[0, np.frombuffer(texts_in, "<i4")]).tolist()
            byte, occurrence = np.cumsum(np.r_[0, sizes]).tolist(), np.cumsum(np.r_[0, counts]).tolist()
            for s, a, b in zip(np.frombuffer(to, "<i4").tolist(), edge[:-1], edge[1:], strict=True):
                o = slice(occurrence[a], occurrence[b])
                parts.setdefault(s, []).append((row, sizes[a:b], texts[byte[a] : byte[b]], counts[a:b], owners[o], places[o]))
        spans: dict[int, list[np.ndarray]] = {}
        for pieces in parts.values():
            for row, found in of_shard(pieces):
                spans.setdefault(row, []).extend(found)
        chunk = table["chunk"].to_pylist()
        rows = [(chunk[row], np.concatenate(found).astype("<i4").tobytes()) for row, found in spans.items()]
        kinds = [pa.int64(), pa.binary()]
        return pa.Table.from_batches([_rows(["chunk", "spans"], rows, kinds)] if rows else [], pa.schema([("chunk", kinds[0]), ("spans", kinds[1])]))

    def of_shard(pieces: list[tuple]) -> Iterator[tuple[int, list[np.ndarray]]]:
        known: dict[bytes, int] = {}
        least: list[int] = []
        held = []
        for _, sizes, texts, counts, owners, _ in pieces:
            own = np.minimum.reduceat(owners, np.cumsum(counts) - counts).tolist()
            at, numbers = 0, []
            for n, o in zip(sizes.tolist(), own, strict=True):
                k = known.setdefault(texts[at : at + n], len(known))
                at += n
                if k == len(least):
                    least.append(o)
                else:
                    least[k] = min(least[k], o)
                numbers.append(k)
            held.append(np.repeat(numbers, counts))
        first, all_texts = np.array(least, np.int64), list(known)
        windows = earlier_windows(all_texts, first, cfg.window)
        length = np.array([*map(len, all_texts)])
        for (row, _, _, _, owners, places), which in zip(pieces, held, strict=True):
            later = owners > first[which]
            spans = [np.stack([places[later], places[later] + length[which[later]]], 1)]
            for k, place in zip(which[~later].tolist(), places[~later].tolist(), strict=True):
                if windows[k].any():
                    edge = np.flatnonzero(np.diff(np.r_[False, windows[k], False]))
                    spans.append(np.stack([edge[::2], edge[1::2] + cfg.window - 1], 1) + place)
            if sum(map(len, spans)):
                yield row, spans

    return regions.groupBy("group").applyInArrow(answer, "chunk long, spans binary")


def without_repeats(docs: DataFrame, cfg: PassageConfig | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): one row for each of ``docs``; maximal removed byte ranges, and the bytes that stay."""
    cfg = cfg or PassageConfig()
    spark = docs.sparkSession
    total = docs.select(F.octet_length(F.col(text).cast("string")).alias("n")).agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // cfg.shard_bytes))
    tables = max(1, -(-total // (16 * cfg.shard_bytes)))
    path = posixpath.join(shared_dir(spark), f"chunks-{uuid.uuid4().hex}")
    write_chunks(docs, cfg, key, text, path)
    chunks = spark.read.schema("chunk long, ids array<long>, sizes array<long>, blob binary").parquet(path)
    shared_anchors(chunks, cfg, tables, shards).write.parquet(f"{path}-anchors")
    shared = spark.read.schema("chunk long, part int, shared binary, shards binary, crowded binary").parquet(f"{path}-anchors")
    # One key for each ``crowded`` occurrences at least.
    crowded = np.sort(np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r.crowded, "<i8") for r in shared.select("crowded").filter("crowded is not null").collect()]]))
    windows = shared_windows(chunks, crowded, cfg, tables) if len(crowded) else None
    marks = covered(shared_regions(chunks, shared, windows, cfg, tables, shards), cfg)

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for chunk, more in chunk_rows(batches):
            gone = np.zeros(len(chunk.data) + 1, np.int32)
            for x in more["found"].as_py() or []:
                spans = np.frombuffer(x, "<i4").reshape(-1, 2)
                np.add.at(gone, spans[:, 0], 1)
                np.add.at(gone, spans[:, 1], -1)
            gone_bytes = np.cumsum(gone)[:-1] > 0
            data, rows, held, at = np.frombuffer(chunk.data, np.uint8), [], 0, 0
            for i, n in zip(chunk.ids, chunk.sizes.tolist(), strict=True):
                off = gone_bytes[at : at + n]
                edge = np.flatnonzero(np.diff(np.r_[False, off, False])).tolist()
                rows.append((i, n, [{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)], data[at : at + n][~off].tobytes()))
                at += n
                held += n
                if held > cfg.chunk_bytes:
                    yield _rows(names, rows, [pa.int64(), pa.int64(), kind, pa.binary()])
                    rows, held = [], 0
            if rows:
                yield _rows(names, rows, [pa.int64(), pa.int64(), kind, pa.binary()])

    names = ["doc_id", "n_bytes", "spans", "kept"]
    asked = marks.groupBy("chunk").agg(F.collect_list("spans").alias("found"))
    rows = chunks.join(asked, "chunk", "left").select("chunk", "ids", "sizes", "blob", "found")
    return rows.mapInArrow(cut_texts, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def digests(found: DataFrame) -> DataFrame:
    """The rows of ``without_repeats`` with counts and a digest in place of spans and bytes."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
