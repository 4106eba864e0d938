"""Functions of one array of samples, as Catalyst expressions.

Sums go from left to right in the element type, as the mapping's definition asks for: an
``array<float>`` is summed in single precision.  Null arrays give null, empty ones null or empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Samples outside these bounds are clamped before segmentation.
LEAST_SAMPLE, MOST_SAMPLE = 0, 1200
#: Fixed value: scale of the median absolute deviation.
MAD_SCALE = 1.4826


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def picoamp_scale(digitisation: Column | str, range_: Column | str) -> Column:
    return _col(range_).cast("float") / _col(digitisation).cast("float")


def to_picoamps(raw: Column | str, digitisation: Column | str, offset: Column | str, range_: Column | str) -> Column:
    """Current in picoamperes of raw samples, in single precision."""
    scale = picoamp_scale(digitisation, range_)
    return F.transform(_col(raw), lambda x: ((x.cast("float") + _col(offset).cast("float")) * scale.cast("float")).cast("float"))


def clamp_outliers(x: Column | str, low: float = LEAST_SAMPLE, high: float = MOST_SAMPLE) -> Column:
    return F.transform(_col(x), lambda v: F.greatest(F.lit(low), F.least(F.lit(high), v)))


def _sum(x: Column, kind: str) -> Column:
    return F.aggregate(x, F.lit(0).cast(kind), lambda a, v: (a + v.cast(kind)).cast(kind))


def mean(x: Column | str, kind: str = "float") -> Column:
    x = _col(x)
    return F.when(F.size(x) > 0, (_sum(x, kind) / F.size(x).cast(kind)).cast(kind))


def stdev_pop(x: Column | str, kind: str = "float") -> Column:
    """Population standard deviation, in two passes."""
    x = _col(x)
    squares = lambda m: F.aggregate(x, F.lit(0).cast(kind), lambda a, v: (a + (v.cast(kind) - m) * (v.cast(kind) - m)).cast(kind))
    with_mean = F.get(F.transform(F.array(mean(x, kind)), lambda m: F.sqrt(squares(m) / F.size(x).cast(kind)).cast(kind)), F.lit(0))
    return F.when(F.size(x) > 0, with_mean)


def kth_smallest(x: Column | str, k: Column | int) -> Column:
    """k counts from 0."""
    return F.get(F.array_sort(_col(x)), F.lit(k) if isinstance(k, int) else k)


def upper_median(x: Column | str) -> Column:
    """The element of rank n/2: no averaging for even n."""
    return kth_smallest(x, F.floor(F.size(_col(x)) / 2).cast("int"))


def mad(x: Column | str) -> Column:
    """Scaled median absolute deviation from the upper median; 0 for one sample."""
    x = _col(x)
    deviations = lambda m: F.transform(x, lambda v: F.abs(v - m))
    return F.get(F.transform(F.array(upper_median(x)), lambda m: upper_median(deviations(m)) * MAD_SCALE), F.lit(0))


def quantile(x: Column | str, p: float) -> Column:
    """Linear interpolation at p*(n-1)."""
    x = F.array_sort(_col(x))
    at = F.lit(p) * (F.size(x) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(x, low), F.get(x, F.least(low + 1, F.size(x) - 1))
    return a + (b - a) * (at - low)


def zscore(x: Column | str, kind: str = "float") -> Column:
    """Each sample less the mean, over the population standard deviation; null samples where that is 0."""
    x = _col(x)
    scaled = lambda p: F.transform(x, lambda v: F.when(p["s"] != 0, ((v.cast(kind) - p["m"]) / p["s"]).cast(kind)))
    return F.get(F.transform(F.array(F.struct(mean(x, kind).alias("m"), stdev_pop(x, kind).alias("s"))), scaled), F.lit(0))


def prefix_sums(x: Column | str) -> Column:
    """Exclusive prefix sums, one longer than the input, in double precision.

    One pass: the state is (sums so far, last).  For arrays of thousands of samples use the row form
    in ``operators.windows``, which does not copy the growing array.
    """
    return F.aggregate(_col(x), F.array(F.lit(0.0)), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v.cast("double"))))


def distance(x: Column | str, y: Column | str, squared: bool = False) -> Column:
    d = _col(x) - _col(y)
    return d * d if squared else F.abs(d)


def least_of_three(a: Column | str, b: Column | str, c: Column | str) -> Column:
    return F.least(_col(a), _col(b), _col(c))


def in_band(i: Column | str, j: Column | str, n: Column | str, m: Column | str, r: int) -> Column:
    """Whether cell (i, j) of an n x m matrix lies within r of the diagonal."""
    return F.abs(_col(i) - _col(j) * _col(n) / _col(m)) <= r


def chunk_minima(row: Column | str, width: Column | int) -> Column:
    """array of struct(score, pos): the first minimum of every consecutive chunk; null for an empty row."""
    row = _col(row)
    width = F.lit(width) if isinstance(width, int) else width
    chunks = F.sequence(F.lit(0), (F.ceil(F.size(row) / width) - 1).cast("int"))
    ranked = lambda c: F.transform(F.slice(row, c * width + 1, width), lambda v, i: F.struct(v.alias("score"), (c * width + i).cast("int").alias("pos")))
    return F.when(F.size(row) > 0, F.transform(chunks, lambda c: F.array_min(ranked(c))))


def dtw_last_row(x: Column | str, y: Column | str, subsequence: bool = True) -> Column:
    """Last row of the dynamic-time-warping cost matrix of query x and reference y.

    ``subsequence``: the match may start anywhere in y at no cost; else row 0 accumulates.  For short
    arrays; whole reads against genomes go through ``operators.dtw``.
    """
    # Bound once: an expression that is named in a lambda is evaluated again at each of its uses.
    bound = F.array(F.struct(_col(x).alias("x"), _col(y).alias("y")))
    return F.get(F.transform(bound, lambda p: _last_row(p["x"], p["y"], subsequence)), F.lit(0))


def _last_row(x: Column, y: Column, subsequence: bool) -> Column:
    first = F.get(x, F.lit(0))
    free = F.transform(y, lambda b: F.abs(first - b))
    summed = F.aggregate(F.slice(free, 2, F.greatest(F.size(y) - 1, F.lit(0))), F.slice(free, 1, 1), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))
    columns = F.sequence(F.lit(1), F.size(y) - 1)

    def next_row(row: Column, v: Column) -> Column:
        start = F.array(F.abs(v - F.get(y, F.lit(0))) + F.get(row, F.lit(0)))
        cell = lambda a, j: F.abs(v - F.get(y, j)) + F.least(F.get(row, j), F.get(row, j - 1), F.element_at(a, -1))
        return F.when(F.size(y) > 1, F.aggregate(columns, start, lambda a, j: F.concat(a, F.array(cell(a, j))))).otherwise(start)

    return F.aggregate(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), free if subsequence else summed, next_row)
