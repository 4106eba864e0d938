"""Mapping of reads: events, query window, alignment to all references, best hits.

Reads stay where they were scanned: every step is a narrow projection or an Arrow-batched pass, and
the references go to the tasks.  Samples end at the event detection, events where the query is taken from
them.  The references' levels are made once and stored as tiles.  Tiles above ``reference_bytes`` are split into blocks, one pass over the
queries for each, and the candidates of a read are merged as the passes go: no shuffle, and no broadcast above a checked
size.  A reference of several tiles is walked by carrying the border of its cost matrix along with the read.
At most ``BLOCKS_HELD`` passes are chained before a checkpoint, so a task never holds more blocks, and the
driver holds one at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import picoamp_scale, to_picoamps, zscore
from ..functions.text import mapping_quality, residue_count
from ..options import LEAST_EVENTS, MapOptions
from ..scratch import scratch
from . import dtw, segments
from .events import DNA, RNA, with_events

CANDIDATE = "struct<score:float,seq:bigint,ref_idx:int,strand:string,pos_st:int,pos_end:int,name:string,ref_len:int,seq_len:int,st_offset:int>"
_ITEM = pa.struct([("score", pa.float32()), ("seq", pa.int64()), ("ref_idx", pa.int32()), ("strand", pa.string()), ("pos_st", pa.int32()), ("pos_end", pa.int32()), ("name", pa.string()), ("ref_len", pa.int32()), ("seq_len", pa.int32()), ("st_offset", pa.int32())])


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _array(x: pa.Scalar, kind: type) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False).astype(kind) if x.is_valid and x.values is not None else np.zeros(0, kind)


def with_signal(reads: DataFrame) -> DataFrame:
    """Reads with their current in picoamperes (``pa``) and their ``events``."""
    return reads.withColumn("pa", to_picoamps("raw_signal", "digitisation", "offset", "range"))


def with_found_start(reads: DataFrame, opt: MapOptions) -> DataFrame:
    """Reads with ``found``: the first event after adaptor and poly-A tail, or -1."""
    adaptor = segments.ADAPTOR_RNA004 if opt.pore == "rna004" else segments.ADAPTOR_R9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw, x, events in zip(_column(batch, "raw_signal"), _column(batch, "pa"), _column(batch, "events"), strict=True):
                starts = events.values.field("start").to_numpy(zero_copy_only=False) if events.is_valid else np.zeros(0)
                found.append(segments.query_start(_array(raw, np.float32), _array(x, np.float32), starts, adaptor))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*batch.schema.names, "found"])

    return reads.mapInArrow(run, T.StructType([*reads.schema.fields, T.StructField("found", T.IntegerType())]))


def with_query(reads: DataFrame, opt: MapOptions) -> DataFrame:
    """Reads with the query window [q0, q1) of their events, its z-scored means ``query`` and a ``status``.

    Status: ok, too_short (the window is cut at the read's end), prefix_fail (the default prefix was
    taken), ignored (no query), no_signal.
    """
    n = F.size("events")
    if opt.from_end:
        q0, q1 = n - opt.prefix - opt.query, n - opt.prefix
        ignored, short, failed = q1 <= 0, q0 < 0, F.lit(False)
        q0 = F.greatest(q0, F.lit(0))
    else:
        start = F.lit(opt.prefix) if opt.prefix >= 0 else F.when(F.col("found") >= 0, F.col("found")).otherwise(MapOptions.prefix)
        failed = F.lit(False) if opt.prefix >= 0 else F.col("found") < 0
        q0, q1 = start, start + opt.query
        ignored, short = start + LEAST_EVENTS > n, q1 > n
        q1 = F.least(q1, n)
    status = F.when(n == 0, "no_signal").when(ignored, "ignored").when(short, "too_short").when(failed, "prefix_fail").otherwise("ok")
    framed = reads.withColumns({"status": status, "q0": q0.cast("int"), "q1": q1.cast("int")})
    means = F.transform(F.slice("events", F.col("q0") + 1, F.col("q1") - F.col("q0")), lambda e: e["mean"])
    usable = ~F.col("status").isin("no_signal", "ignored")
    query = zscore(means)
    if opt.rna and not opt.invert:
        query = F.reverse(query)
    return framed.withColumn("query", F.when(usable, query))


def stored_tiles(refs: DataFrame, opt: MapOptions) -> DataFrame:
    """The references written to the shared folder once, in order, as tiles of ``tile_columns`` levels: (seq, column, its reference's columns, levels).

    ``seq`` counts contigs and strands.  Whatever is asked later reads this table: sizes without levels, blocks by their range.
    """
    spark = refs.sparkSession
    path = scratch(spark, "references")
    seq = 2 * F.col("ref_idx").cast("long") + (F.col("strand") == "-").cast("long")
    column = F.explode(F.sequence(F.lit(0), F.greatest(F.size("levels") - 1, F.lit(0)), F.lit(opt.tile_columns)))
    rows = refs.select("*", seq.alias("seq")).select("*", column.alias("column"))
    rows = rows.withColumn("levels", F.slice("levels", F.col("column") + 1, F.lit(opt.tile_columns))).withColumn("width", F.size("levels"))
    rows.sortWithinPartitions("seq", "column").write.parquet(path)
    return spark.read.parquet(path)


def reference_blocks(tiles: DataFrame, most_bytes: int) -> Iterator[list[dict]]:
    """The tiles in their order, in blocks of at most ``most_bytes`` of levels (one tile at least).

    Sizes are looked at before any levels are read; a block is fetched when it is asked for.
    """
    bounds: list[list[tuple]] = []
    held = 0
    for r in tiles.select("seq", "column", "width").orderBy("seq", "column").toLocalIterator():
        if not bounds or held + 4 * r["width"] > most_bytes:
            bounds.append([(r["seq"], r["column"])] * 2)
            held = 0
        bounds[-1][1] = (r["seq"], r["column"])
        held += 4 * r["width"]
    for (first, first_column), (last, last_column) in bounds:
        inside = F.col("seq").between(first, last) & ((F.col("seq") > first) | (F.col("column") >= first_column)) & ((F.col("seq") < last) | (F.col("column") <= last_column))
        rows = tiles.filter(inside).toArrow().sort_by([("seq", "ascending"), ("column", "ascending")])
        levels = [np.asarray(x.values, dtype=np.float32) for x in rows["levels"]]
        yield [r | {"levels": x} for r, x in zip(rows.drop_columns(["levels"]).to_pylist(), levels, strict=True)]


#: Reference blocks whose passes are chained without a checkpoint.
BLOCKS_HELD = 4


def _passes(rows: DataFrame, tiles: DataFrame, opt: MapOptions, one: Callable[[DataFrame, list[dict]], DataFrame]) -> DataFrame:
    """``one`` pass over the rows for each block of the references."""
    for number, block in enumerate(reference_blocks(tiles, opt.reference_bytes)):
        if number and number % BLOCKS_HELD == 0:
            if rows.isStreaming:
                raise ValueError("streams are mapped to references of few blocks only: raise reference_bytes")
            sc = rows.sparkSession.sparkContext
            if sc.getCheckpointDir() is None:
                sc.setCheckpointDir(rows.sparkSession.conf.get("spark.checkpoint.dir"))
            rows = rows.checkpoint(eager=True)
        rows = one(rows, block)
    return rows


#: What a read carries from one tile of a reference to the next: the border of its matrix, and the best cell of the chunk that the border cuts.
_CARRY = pa.struct([("costs", pa.binary()), ("starts", pa.binary()), ("chunk", pa.int64()), ("score", pa.float32()), ("pos_end", pa.int32()), ("pos_st", pa.int32())])
CARRY = "struct<costs:binary,starts:binary,chunk:bigint,score:float,pos_end:int,pos_st:int>"


def whole(tile: dict) -> bool:
    return tile["column"] == 0 and tile["width"] == tile["ref_len"]


def align_tile(queries: list[np.ndarray], carried: list[dict | None], tile: dict, opt: MapOptions) -> tuple[list[list[dict]], list[dict | None]]:
    """Best candidates that end in a tile of a reference, each with its start, and what is carried to the next tile."""
    out: list[list[dict]] = [[] for _ in queries]
    carry: list[dict | None] = [None] * len(queries)
    first, m = tile["column"], tile["width"]
    last = first + m == tile["ref_len"]
    usable = sorted((i for i, q in enumerate(queries) if len(q) and np.isfinite(q).all()), key=lambda i: len(queries[i]))
    for part in _parts(usable, m):
        table, lengths = _padded([queries[i] for i in part])
        border = None
        if first:
            border = dtw.Border(np.full(table.shape[::-1], np.inf, np.float32), np.zeros(table.shape[::-1], np.int32))
            for k, i in enumerate(part):
                border.costs[: lengths[k], k] = np.frombuffer(carried[i]["costs"], np.float32)
                border.starts[: lengths[k], k] = np.frombuffer(carried[i]["starts"], np.int32)
        row, began, right = dtw.tile_row(table, tile["levels"], not opt.standard, True, lengths, border, first, not last)
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            edges = np.unique([0, *range(-first % int(n), m, int(n)), m])  # of the chunks, as far as they lie in this tile
            at = np.stack([a + row[own, a:b].argmin(axis=1) for a, b in zip(edges[:-1], edges[1:], strict=True)], axis=1)
            score, start = np.take_along_axis(row[own], at, axis=1), np.take_along_axis(began[own], at, axis=1)
            chunk = (first + edges[:-1]) // int(n)
            for j, k in enumerate(own):
                i = part[k]
                cells = [(float(v), int(c), first + int(e), int(b)) for v, c, e, b in zip(score[j], chunk, at[j], start[j], strict=True)]
                if first and first % int(n) and carried[i]["score"] <= cells[0][0]:  # of equals in a chunk the first
                    cells[0] = (carried[i]["score"], carried[i]["chunk"], carried[i]["pos_end"], carried[i]["pos_st"])
                open_chunk = cells.pop() if not last and (first + m) % int(n) else (float("inf"), -1, -1, -1)
                if not last:
                    carry[i] = {"costs": right.costs[: int(n), k].tobytes(), "starts": right.starts[: int(n), k].tobytes(), "score": open_chunk[0], "chunk": open_chunk[1], "pos_end": open_chunk[2], "pos_st": open_chunk[3]}
                if opt.standard:
                    cells = [(float(row[k, -1]), 0, first + m - 1, int(began[k, -1]))] if last else []
                found = [{x: tile[x] for x in _OF_REFERENCE} | {"score": v, "seq": (tile["seq"] << 32) + c, "pos_end": e, "pos_st": b} for v, c, e, b in cells if np.isfinite(v)]
                out[i] = best(found, opt.candidates)
    return out, carry


def align(queries: list[np.ndarray], refs: list[dict], opt: MapOptions) -> list[list[dict]]:
    """Best candidates of each query; many queries share the walk over a reference.

    Only the best one has its start, which takes a second walk over that reference alone.
    """
    out: list[list[dict]] = [[] for _ in queries]
    by_number = {ref["seq"]: ref for ref in refs}
    usable = [i for i, q in enumerate(queries) if len(q) and np.isfinite(q).all()]
    usable.sort(key=lambda i: len(queries[i]))  # little padding
    walks = _joined(refs, opt)
    longest = max((len(y) for y, _ in walks), default=1)
    winners: dict[int, list[int]] = {}
    for part in _parts(usable, longest):
        for i, hits in zip(part, _best_chunks(*_padded([queries[i] for i in part]), walks, opt), strict=True):
            out[i] = [{k: by_number[s >> 32][k] for k in _OF_REFERENCE} | {"score": score, "seq": s, "pos_st": None, "pos_end": e} for score, s, e in hits]
            if hits:
                winners.setdefault(hits[0][1] >> 32, []).append(i)
    for number, won in winners.items():
        for part in _parts(won, len(by_number[number]["levels"])):
            levels = by_number[number]["levels"][: max(out[i][0]["pos_end"] for i in part) + 1]
            table, lengths = _padded([queries[i] for i in part])
            _, starts = dtw.last_row(table, levels, not opt.standard, lengths=lengths)
            for i, start in zip(part, starts, strict=True):
                out[i][0]["pos_st"] = int(start[out[i][0]["pos_end"]])
    return out


def _padded(queries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(q) for q in queries])
    table = np.zeros((len(queries), int(lengths.max())), np.float32)
    for row, q in zip(table, queries, strict=True):
        row[: len(q)] = q
    return table, lengths


#: Columns of short references that are walked as one.
JOINED = 1 << 12


def _joined(refs: list[dict], opt: MapOptions) -> list[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """References in their order, short ones end to end: levels, and (number, first column, width) of each reference in them.

    An infinite level stands between two of them.  No path crosses it, so every cell is what it is for a reference by itself.
    """
    groups: list[list[dict]] = []
    held = 0
    for ref in refs:
        n = len(ref["levels"]) + 1
        alone = opt.standard or not np.isfinite(ref["levels"]).all()
        if not groups or alone or held + n > JOINED:
            groups.append([])
            held = 0
        groups[-1].append(ref)
        held = JOINED if alone else held + n
    out = []
    for group in groups:
        firsts = np.cumsum([0, *(len(ref["levels"]) + 1 for ref in group)]).tolist()
        levels = np.full(firsts[-1] - 1, np.inf, np.float32)
        for ref, at in zip(group, firsts, strict=False):
            levels[at : at + len(ref["levels"])] = ref["levels"]
        out.append((levels, [(ref["seq"], at, len(ref["levels"])) for ref, at in zip(group, firsts, strict=False)]))
    return out


def _best_chunks(queries: np.ndarray, lengths: np.ndarray, walks: list[tuple[np.ndarray, list[tuple[int, int, int]]]], opt: MapOptions) -> list[list[tuple[float, int, int]]]:
    """(score, number, end) of each query's best candidates: least score first, of equals the later one.

    A chunk is as wide as the query is long.
    """
    k = opt.candidates
    score, number, end = (np.full((len(queries), k), v, t) for v, t in ((np.inf, np.float32), (-1, np.int64), (-1, np.int64)))
    groups = [(int(n), np.flatnonzero(lengths == n)) for n in np.unique(lengths)]
    for levels, held in walks:
        rows, _ = dtw.last_row(queries, levels, not opt.standard, starts=False, lengths=lengths)
        rows = np.ascontiguousarray(rows)
        for n, own in groups:
            if opt.standard:  # one reference; its last cell
                begin, chunk, first = (np.array([x]) for x in (len(levels) - 1, held[0][0] << 32, 0))
            else:
                begin = np.concatenate([at + np.arange(0, m, n) for _, at, m in held])
                chunk = np.concatenate([(seq << 32) + np.arange(-(-m // n), dtype=np.int64) for seq, _, m in held])
                first = np.repeat([at for _, at, _ in held], [-(-m // n) for _, _, m in held])
            # A reference's last chunk may have the infinite cell after it, which is never the least.
            least = np.minimum.reduceat(rows[own], begin, axis=1)
            # References and chunks come in order, so what is later stands first and the sort keeps that.
            best_of = len(begin) - 1 - np.argsort(least[:, ::-1], axis=1, kind="stable")[:, :k]
            upto = np.append(begin[1:], len(levels))
            at = np.array([[begin[c] - first[c] + rows[i, begin[c] : upto[c]].argmin() for c in row] for i, row in zip(own, best_of, strict=True)], np.int64)
            both = [np.concatenate([new, old[own]], axis=1) for new, old in ((np.take_along_axis(least, best_of, axis=1), score), (chunk[best_of], number), (at, end))]
            order = np.argsort(both[0], axis=1, kind="stable")[:, :k]
            score[own], number[own], end[own] = (np.take_along_axis(x, order, axis=1) for x in both)
    return [[(s, c, e) for s, c, e in zip(*row, strict=True) if np.isfinite(s)] for row in zip(score.tolist(), number.tolist(), end.tolist(), strict=True)]


_OF_REFERENCE = ("ref_idx", "strand", "name", "ref_len", "seq_len", "st_offset")


def _parts(members: list[int], columns: int) -> list[list[int]]:
    """Members in parts whose last rows take some 8 MB at most."""
    step = max(1, (1 << 21) // max(1, columns))
    return [members[at : at + step] for at in range(0, len(members), step)]


def best(candidates: list[dict], k: int) -> list[dict]:
    """The k of least score; of equals the later one is better."""
    return sorted(candidates, key=lambda c: (c["score"], -c["seq"]))[:k]


#: Reads whose candidates are Python objects at once.
READS_HELD = 1024


def few_reads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, READS_HELD) for batch in batches for at in range(0, batch.num_rows, READS_HELD))


def with_candidates(queries: DataFrame, refs: DataFrame | None, opt: MapOptions, tiles: DataFrame | None = None) -> DataFrame:
    """Reads with ``candidates``, best first, of which the best has its start.

    Blocks of whole references are walked by many queries at once.  A reference longer than a tile is walked tile by tile,
    over as many passes as it takes; what lies at the border goes along with the read.
    """
    tiles = stored_tiles(refs, opt) if tiles is None else tiles

    def one(rows: DataFrame, block: list[dict]) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in few_reads(batches):
                asked = [_array(q, np.float32) for q in _column(batch, "query")]
                names = batch.schema.names
                found = [c or [] for c in _column(batch, "candidates").to_pylist()]
                carried = _column(batch, "carry").to_pylist()
                complete = [t for t in shared.value if whole(t)]
                steps = [align(asked, complete, opt)] if complete else []
                for tile in shared.value:
                    if not whole(tile):
                        new, carried = align_tile(asked, carried, tile, opt)
                        steps.append(new)
                for new in steps:
                    found = [best(old + more, opt.candidates) for old, more in zip(found, new, strict=True)]
                found = [[c if k == 0 else c | {"pos_st": None} for k, c in enumerate(cs)] for cs in found]
                columns = {"candidates": pa.array(found, pa.list_(_ITEM)), "carry": pa.array(carried, _CARRY)}
                yield pa.RecordBatch.from_arrays([columns.get(n, c) for n, c in zip(names, batch.columns, strict=True)], names)

        return rows.mapInArrow(run, rows.schema)

    begun = queries.withColumns({"candidates": F.array().cast(f"array<{CANDIDATE}>"), "carry": F.lit(None).cast(CARRY)})
    return _passes(begun, tiles, opt, one).drop("carry")


def with_span(queries: DataFrame) -> DataFrame:
    """Reads with the samples that the query's events span, as ``query_start`` and ``query_end``."""
    first, last = F.get("events", F.col("q0")), F.get("events", F.col("q1") - 1)
    return queries.withColumns({"query_start": first["start"].cast("int"), "query_end": (last["start"] + last["length"].cast("long")).cast("int")})


def mapped_rows(found: DataFrame) -> DataFrame:
    """PAF rows from candidates: strand lift-over, offsets, quality.  Reads without a query give none.

    ``found`` has the samples' number, ``qlen``, and the query's span.
    """
    hit, rival = F.get("candidates", F.lit(0)), F.get("candidates", F.lit(1))
    rows = found.filter(F.size("candidates") > 0).withColumns({"hit": hit, "score2": rival["score"]})
    minus = F.col("hit.strand") == "-"
    st = F.when(minus, F.col("hit.ref_len") - F.col("hit.pos_end")).otherwise(F.col("hit.pos_st")) + F.col("hit.st_offset")
    end = F.when(minus, F.col("hit.ref_len") - F.col("hit.pos_st")).otherwise(F.col("hit.pos_end")) + F.col("hit.st_offset")
    placed = rows.withColumns({
        "rid": F.col("read_id"),
        "strand": F.col("hit.strand"), "tid": F.col("hit.name"), "tlen": F.col("hit.seq_len"), "target_start": st.cast("int"), "target_end": end.cast("int"),
        "mapq": mapping_quality(F.col("hit.score").cast("double"), F.col("score2").cast("double")), "tp": F.lit("P"), "d1": F.col("hit.score"), "d2": F.col("score2"), "n_events": F.col("q1") - F.col("q0"),
    })
    block = F.col("target_end") - F.col("target_start")
    return placed.withColumns({"block_len": block, "n_residue": residue_count(block, F.col("d1"), F.col("n_events"))})


PAF_COLUMNS = ["rid", "qlen", "query_start", "query_end", "strand", "tid", "tlen", "target_start", "target_end", "n_residue", "block_len", "mapq", "tp", "d1", "d2"]


def with_signal_string(rows: DataFrame, refs: DataFrame | None, opt: MapOptions, tiles: DataFrame | None = None) -> DataFrame:
    """Mapped rows with ``ss``: how the signal maps to the bases.

    Only the winning pair's matrix is made, of the columns from the hit's start to its end; those of several tiles
    are gathered as the passes go.
    """
    tiles = stored_tiles(refs, opt) if tiles is None else tiles

    def one(rows: DataFrame, block: list[dict]) -> DataFrame:
        held: dict[tuple, list[dict]] = {}
        for t in block:
            held.setdefault((t["ref_idx"], t["strand"]), []).append(t)
        shared = rows.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.schema.names
                texts, parts = _column(batch, "ss").to_pylist(), _column(batch, "part").to_pylist()
                for i, (q, hit, q0) in enumerate(zip(_column(batch, "query"), _column(batch, "hit").to_pylist(), _column(batch, "q0").to_pylist(), strict=True)):
                    for tile in shared.value.get((hit["ref_idx"], hit["strand"]), []):
                        first = tile["column"]
                        if first > hit["pos_end"] or first + tile["width"] <= hit["pos_st"]:
                            continue
                        levels = np.concatenate([np.frombuffer(parts[i] or b"", np.float32), tile["levels"][max(0, hit["pos_st"] - first) : hit["pos_end"] + 1 - first]])
                        parts[i] = levels.tobytes()
                        if first + tile["width"] <= hit["pos_end"]:
                            continue
                        parts[i] = None
                        events = _column(batch, "events")[i].values
                        # The path begins at the hit's start, so no column before it matters.
                        cost = dtw.cost_matrix(_array(q, np.float32), levels, not opt.standard)
                        bases = dtw.base_map(dtw.warp_path(cost, len(levels) - 1, not opt.standard))
                        texts[i] = dtw.signal_string(bases, events.field("start").to_numpy(), events.field("length").to_numpy(), q0, opt.rna and not opt.invert)
                columns = {"ss": pa.array(texts, pa.string()), "part": pa.array(parts, pa.binary())}
                yield pa.RecordBatch.from_arrays([columns.get(n, c) for n, c in zip(names, batch.columns, strict=True)], names)

        return rows.mapInArrow(run, rows.schema)

    return _passes(rows.withColumns({"ss": F.lit(None).cast("string"), "part": F.lit(None).cast("binary")}), tiles, opt, one).drop("part")


def counters() -> list[Column]:
    """What a mapping counts of its reads as they pass: all, those that came to each status, and the bytes of their samples."""
    of = lambda status: F.coalesce(F.sum((F.col("status") == status).cast("long")), F.lit(0)).alias(status)
    return [F.count(F.lit(1)).alias("reads"), *map(of, ("prefix_fail", "ignored", "too_short", "no_signal")), F.coalesce(2 * F.sum("qlen"), F.lit(0)).alias("bytes")]


def map_reads(reads: DataFrame, refs: DataFrame | None, opt: MapOptions = MapOptions(), observation: Observation | None = None, tiles: DataFrame | None = None) -> DataFrame:
    """PAF rows (and ``ss`` for SAM) of ``reads`` against synthetic references, whole ones or stored ``tiles``.

    An ``observation`` gets the ``counters`` when the rows are first computed, without a pass of its own.
    """
    fields = ["read_id", "digitisation", "offset", "range", "raw_signal"]
    detector, sized = RNA if opt.rna else DNA, reads.select(*fields).withColumn("qlen", F.size("raw_signal"))
    if opt.prefix < 0:
        staged = with_found_start(with_events(with_signal(sized), opt=detector), opt)
    else:
        # From the read's start on, no event beyond the query matters; from its end all do.
        most = None if opt.from_end else opt.prefix + max(opt.query, LEAST_EVENTS)
        scaled = sized.withColumn("scale", picoamp_scale("digitisation", "range"))
        staged = with_events(scaled, "raw_signal", opt=detector, drop=("raw_signal", "scale"), most=most, scaled_by=("offset", "scale"))
    framed = with_query(staged, opt)
    if observation is not None:
        framed = framed.observe(observation, *counters())
    queries = with_span(framed).select("read_id", "qlen", "q0", "q1", "query", "query_start", "query_end", *["events"] * opt.sam)
    tiles = stored_tiles(refs, opt) if tiles is None else tiles
    rows = mapped_rows(with_candidates(queries, refs, opt, tiles))
    if opt.sam:
        return with_signal_string(rows, refs, opt, tiles).select(*PAF_COLUMNS, "n_events", "ss")
    return rows.select(*PAF_COLUMNS, "n_events")


def status_counts(queries: DataFrame) -> DataFrame:
    """How many reads came to what, and the samples that they hold."""
    return queries.groupBy("status").agg(F.count("*").alias("reads"), F.sum(F.size("raw_signal")).alias("samples"))
