"""Dynamic time warping of query events against reference levels.

``last_row`` keeps three anti-diagonals of the cost matrix only.  The cells of an anti-diagonal don't
depend on each other, so each is a handful of array operations, which many queries share: shorter ones
are padded, as no row depends on those below it.  With ``starts`` each cell also carries where the best
path to it began, by the same tie order as backtracking (diagonal, then the column before, then the row before); that costs as much again as
the costs do, so the mapper asks for it only where the best hit lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass
class Border:
    """A column of the cost matrices: (query rows, reads) of costs and of the columns that their paths begin in."""

    costs: np.ndarray
    starts: np.ndarray


def last_row(queries: np.ndarray, y: np.ndarray, subsequence: bool = True, starts: bool = True, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Costs of each query's last matrix row, and the start column of each cell's path.

    queries: (reads, n), padded at the end where ``lengths`` says that they are shorter.
    """
    return tile_row(queries, y, subsequence, starts, lengths)[:2]


def tile_row(
    queries: np.ndarray, y: np.ndarray, subsequence: bool = True, starts: bool = True, lengths: np.ndarray | None = None, left_border: Border | None = None, column: int = 0, keep_border: bool = False
) -> tuple[np.ndarray, np.ndarray | None, Border | None]:
    """``last_row`` for columns ``column`` and on of a reference, next to the border of the tile before them; and this tile's border.

    Cells don't depend on how a reference is cut: a tile begins with the costs that the one before it ended with.
    """
    queries = np.atleast_2d(queries).astype(np.float32)
    backwards = y.astype(np.float32)[::-1, None]
    r, n = queries.shape
    m = len(y)
    # Reads lie side by side in memory, so what an operation covers of an anti-diagonal is one piece.
    x = np.ascontiguousarray(queries.T)
    # Cells of an anti-diagonal are indexed by query row; slot 0 is a border above the matrix.  What an
    # anti-diagonal reads of the two before it was written by them, or is still infinite.
    before, last, fresh = (np.full((n + 1, r), np.inf, np.float32) for _ in range(3))
    from_before, from_last, from_fresh = (np.zeros((n + 1, r) if starts else (0, 0), np.int32) for _ in range(3))
    out, began = np.empty((m, r), np.float32), np.empty((m, r), np.int32) if starts else None
    scratch = np.empty((n, r), np.float32)
    last_of = np.full(r, n - 1) if lengths is None else np.asarray(lengths) - 1
    each, mixed = np.arange(r), bool(r) and int(last_of.min()) < n - 1
    right = Border(np.empty((n, r), np.float32), np.zeros((n, r), np.int32)) if keep_border else None
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1), min(n - 1, d)
        if left_border is not None and d < n:
            last[d + 1] = left_border.costs[d]
            if starts:
                from_last[d + 1] = left_border.starts[d]
        diag, left, up = before[lo : hi + 1], last[lo + 1 : hi + 2], last[lo : hi + 1]
        total, cost = fresh[lo + 1 : hi + 2], scratch[: hi - lo + 1]
        np.subtract(x[lo : hi + 1], backwards[m - 1 - d + lo : m - d + hi], out=cost)
        np.abs(cost, out=cost)
        np.minimum(diag, left, out=total)
        np.minimum(total, up, out=total)
        if starts:
            came = np.where(diag == total, from_before[lo : hi + 1], np.where(left == total, from_last[lo + 1 : hi + 2], from_last[lo : hi + 1]))
            if hi == d and left_border is None:
                came[-1] = 0
            if lo == 0:
                came[0] = column + d if subsequence else 0
            from_fresh[lo + 1 : hi + 2] = came
        if lo == 0:  # the first query row: a free start, or sums along it
            total[0] = 0 if subsequence or not d and left_border is None else left[0]
        np.add(total, cost, out=total)
        if right is not None and d >= m - 1:
            right.costs[lo] = total[0]
            if starts:
                right.starts[lo] = came[0]
        if mixed:
            ends = each[(last_of >= lo) & (last_of <= hi)]
            at = last_of[ends]
            out[d - at, ends] = fresh[at + 1, ends]
            if starts:
                began[d - at, ends] = from_fresh[at + 1, ends]
        elif hi == n - 1:
            out[d - n + 1] = total[-1]
            if starts:
                began[d - n + 1] = came[-1]
        before, last, fresh = last, fresh, before
        from_before, from_last, from_fresh = from_last, from_fresh, from_before
    return out.T, None if began is None else began.T, right


def cost_matrix(x: np.ndarray, y: np.ndarray, subsequence: bool = True) -> np.ndarray:
    """The whole matrix, for the one winning pair whose path is wanted."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    c = np.abs(x[:, None] - y[None, :])
    if not subsequence:
        c[0] = np.add.accumulate(c[0])
    c[:, 0] = np.add.accumulate(c[:, 0])
    for d in range(2, len(x) + len(y) - 1):
        i = np.arange(max(1, d - len(y) + 1), min(len(x) - 1, d - 1) + 1)
        j = d - i
        c[i, j] += np.minimum(np.minimum(c[i - 1, j - 1], c[i, j - 1]), c[i - 1, j])
    return c


def warp_path(cost: np.ndarray, column: int, subsequence: bool = True) -> list[tuple[int, int]]:
    """Cells (query, reference) of the best path that ends in the last row at ``column``."""
    i, j = len(cost) - 1, column
    out = [(i, j)]
    while i or j:
        if i == 0:
            if subsequence:
                break
            j -= 1
        elif j == 0:
            i -= 1
        else:
            best = min(cost[i - 1, j - 1], cost[i, j - 1], cost[i - 1, j])
            if cost[i - 1, j - 1] == best:
                i, j = i - 1, j - 1
            elif cost[i, j - 1] == best:
                j -= 1
            else:
                i -= 1
        out.append((i, j))
    return out[::-1]


def chunk_minima(rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First minimum of each ``width`` consecutive cells of every row: values and positions."""
    starts = np.arange(0, rows.shape[1], width)
    at = np.stack([s + rows[:, s : s + width].argmin(axis=1) for s in starts.tolist()], axis=1)
    return np.take_along_axis(rows, at, axis=1), at


def base_map(path: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """First and last query index of each reference index on the path; (-1, -1) for a deletion.

    A step along the reference that stays at a query index leaves the new reference index without one.
    """
    first = path[0][1]
    out = [(-1, -1)] * (path[-1][1] - first + 1)
    previous = -1
    for q, r in path:
        k = r - first
        if q == previous:
            out[k] = (-1, -1)
        else:
            out[k] = (out[k][0] if out[k][0] >= 0 else q, q)
        previous = q
    return out


def signal_string(bases: list[tuple[int, int]], start: np.ndarray, length: np.ndarray, q0: int, rna: bool = False) -> str:
    """Run-length description of how the signal maps to bases: ``n,`` samples of a base, ``nD`` bases
    without signal, ``nI`` samples between bases."""
    spans = [(a, b) for a, b in bases]
    if rna:  # the query was reversed: turn indices and order around
        last = next((b for a, b in reversed(spans) if a >= 0), -1)
        spans = [(last - b, last - a) if a >= 0 else (-1, -1) for a, b in reversed(spans)]
    out, missing, begun = [], 0, False
    at = int(start[q0 + spans[0][0]]) if spans and spans[0][0] >= 0 else 0
    for a, b in spans:
        if a < 0:
            missing += begun
            continue
        lo = int(start[q0 + a])
        hi = int(start[q0 + b]) + int(length[q0 + b])
        if missing:
            out.append(f"{missing}D")
            missing = 0
        if lo > at:
            out.append(f"{lo - at}I")
        out.append(f"{hi - lo},")
        at, begun = hi, True
    return "".join(out)


def with_last_row(rows: DataFrame, query: str, levels: list[float], subsequence: bool = True, out: str = "row", step: int = 512) -> DataFrame:
    """``rows`` with the last row of the cost matrix of each query (an array) against one reference, ``step`` queries at a time."""
    y = np.array(levels, dtype=np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x = [np.asarray(q or [], dtype=np.float32) for q in batch.column(batch.schema.get_field_index(query)).to_pylist()]
                lengths = np.array([len(q) for q in x])
                used = np.flatnonzero(lengths)
                found: list[np.ndarray | None] = [None] * len(x)
                if len(used):
                    table = np.zeros((len(used), int(lengths.max())), dtype=np.float32)
                    for row, i in zip(table, used, strict=True):
                        row[: lengths[i]] = x[i]
                    for i, row in zip(used, last_row(table, y, subsequence, starts=False, lengths=lengths[used])[0], strict=True):
                        found[i] = row
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float32()))], [*batch.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def with_path(rows: DataFrame, query: str, levels: list[float], subsequence: bool = True, out: str = "path") -> DataFrame:
    """``rows`` with the cells (i, j) of the warp path that ends where the last row is least (first of equals)."""
    y = np.array(levels, dtype=np.float32)
    cell = pa.struct([("i", pa.int32()), ("j", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for q in batch.column(batch.schema.get_field_index(query)).to_pylist():
                cost = cost_matrix(np.array(q, dtype=np.float32), y, subsequence) if q else None
                end = None if cost is None else int(cost[-1].argmin()) if subsequence else len(y) - 1
                found.append([{"i": i, "j": j} for i, j in warp_path(cost, end, subsequence)] if q else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(cell))], [*batch.schema.names, out])

    kind = T.ArrayType(T.StructType().add("i", "integer").add("j", "integer"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, kind)]))
