"""Segmentation of raw signals: adaptor and poly-A stretches, and where the query begins.

Rules are over runs of samples (below a level, within a band), which are found by array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import LEAST_SAMPLE, MOST_SAMPLE
from ..schemas import SEGMENT


@dataclass(frozen=True)
class PlateauOptions:
    """Fixed values of the low-plateau segmenter."""

    scale: float = 0.5
    seg_dist: int = 1500
    window: int = 2000
    most: int = 200000
    least: int = 2000


ADAPTOR_R9 = PlateauOptions()
ADAPTOR_RNA004 = PlateauOptions(scale=0.7, least=500)


@dataclass(frozen=True)
class BandOptions:
    """Parameters of the error-tolerant band segmenter."""

    corrector: int = 50
    seg_dist: int = 200
    window: int = 250
    stall_len: float = 1.0
    error: int = 30


POLYA = BandOptions()


def clamp(x: np.ndarray) -> np.ndarray:
    return np.clip(x, LEAST_SAMPLE, MOST_SAMPLE)


def moving_mean(x: np.ndarray, width: int) -> np.ndarray:
    """n - width means, by a running single-precision sum."""
    x = x.astype(np.float32)
    steps = np.empty(2 * (len(x) - width) - 1, dtype=np.float32)
    first = np.add.accumulate(x[:width])[-1]
    steps[0] = first
    steps[1::2] = -x[: len(x) - width - 1]
    steps[2::2] = x[width : len(x) - 1]
    return np.add.accumulate(steps)[::2] / np.float32(width)


def low_plateau(signal: np.ndarray, opt: PlateauOptions = ADAPTOR_R9) -> tuple[int, int]:
    """First run of low moving means whose length fits; (0, 0) without one, (-1, -1) for short signals."""
    if len(signal) <= opt.window:
        return -1, -1
    t = moving_mean(clamp(signal), opt.window)
    mean = np.add.accumulate(t)[-1] / np.float32(len(t))
    dev = np.float32(np.sqrt(np.add.accumulate((t - mean) ** 2)[-1] / np.float32(len(t))))
    bottom = np.float32(mean - dev * np.float32(opt.scale))
    runs: list[list[int]] = []
    start, end = -1, 0
    # Only places where the sign of t - bottom is set matter; equality neither opens nor closes a run.
    below = t < bottom
    change = np.flatnonzero(np.diff(np.where(below, 1, np.where(t > bottom, -1, 0)), prepend=0) != 0)
    for i in change.tolist():
        if below[i] and start < 0:
            start = i
        elif t[i] > bottom and start >= 0:
            end = i - 1
            if runs and start - runs[-1][1] < opt.seg_dist:
                runs[-1][1] = end
            else:
                runs.append([start, end])
            start = -1
    for x, y in runs:
        if opt.least <= y - x <= opt.most:
            return x + opt.window // 2 - 1, y + opt.window // 2 - 1
    return 0, 0


def refunds(length: int, width: int, n: int, window: int) -> int:
    """Outliers that a stretch of ``n`` samples within the band buys back.

    One for each sample at which the run's length, ``window`` at least, is a multiple of the correction
    width.  Both grow by one with each sample, so the width has to divide what the length is ahead by.
    """
    ahead = length - width
    if ahead < 0:
        return 0
    if not ahead:
        return max(0, n - max(0, window - length - 1))
    return sum(ahead % w == 0 and w + ahead >= window for w in range(width + 1, min(width + n, ahead) + 1))


def band_segments(signal: np.ndarray, bottom: float, top: float, opt: BandOptions = POLYA) -> list[tuple[int, int]]:
    """Runs of samples within (bottom, top) that put up with a few outliers.

    Stretches within the band are joined over the gaps between them for as long as there are outliers
    left to spend.  The run's length buys outliers back: one whenever it is a multiple of the correction
    width, which grows with every sample in the band and is never reset.  A run that is open at the end
    is dropped.
    """
    inside = (signal > bottom) & (signal < top)
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False)).tolist()
    out: list[tuple[int, int]] = []
    start, length, spent, width = -1, 0, 0, opt.corrector
    for begin, end, after in zip(edges[::2], edges[1::2], [*edges[2::2], len(inside)], strict=False):
        if start < 0:
            start, length, spent = begin, 0, 0
        n = end - begin
        spent -= refunds(length, width, n, opt.window)
        length, width = length + n, width + n
        gap, bridged = after - end, 0
        if length + gap < width:  # no refund in the gap
            bridged = min(gap, max(0, opt.error - spent))
            length, spent = length + bridged, spent + bridged
        while bridged < gap and spent < opt.error:
            bridged, length, spent = bridged + 1, length + 1, spent + 1
            spent -= length >= max(opt.window, width) and length % width == 0
        if bridged == gap:
            continue
        if length >= opt.window or not out and length >= opt.window * opt.stall_len:
            if out and start - out[-1][1] < opt.seg_dist:
                start = out.pop()[0]
            out.append((start, end))
        start = -1
    return out


def query_start(raw: np.ndarray, pa_signal: np.ndarray, event_starts: np.ndarray, adaptor: PlateauOptions = ADAPTOR_R9) -> int:
    """First event after the poly-A tail that follows the adaptor; -1 where either isn't found."""
    x, y = low_plateau(raw.astype(np.float32), adaptor)
    if y <= 0:
        return -1
    m = np.add.accumulate(pa_signal[x:y].astype(np.float32))[-1] / np.float32(max(1, y - x))
    tails = band_segments(clamp(pa_signal[y:]), float(m) + 10, float(m) + 50)
    if not tails:
        return -1
    at = int(np.searchsorted(event_starts, y + tails[0][1], side="left"))
    return at if at < len(event_starts) else -1


def with_segments(reads: DataFrame, signal: str, out: str = "segments", kind: str = "adaptor", bottom: float = 0.0, top: float = 0.0, options: PlateauOptions | BandOptions | None = None) -> DataFrame:
    """``reads`` with the segments of each signal as array of (x, y): the adaptor, or all runs in a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for s in batch.column(batch.schema.get_field_index(signal)):
                x = s.values.to_numpy(zero_copy_only=False).astype(np.float32) if s.is_valid else np.zeros(0, np.float32)
                if kind == "adaptor":
                    got = [low_plateau(x, options or ADAPTOR_R9)]
                    got = [g for g in got if g[1] > 0]
                else:
                    got = band_segments(clamp(x), bottom, top, options or POLYA)
                found.append([{"x": a, "y": b} for a, b in got])
            item = pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, item)], [*batch.schema.names, out])

    return reads.mapInArrow(run, T.StructType([*reads.schema.fields, T.StructField(out, T.ArrayType(SEGMENT))]))


def segment_text(segments: Column | str) -> Column:
    """``n<TAB>x,y;x,y;``"""
    s = F.col(segments) if isinstance(segments, str) else segments
    return F.concat(F.size(s).cast("string"), F.lit("\t"), F.array_join(F.transform(s, lambda p: F.concat(p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit(";"))), ""))
