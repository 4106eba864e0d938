"""Functions over the sample axis, in row form: one row for each sample, windows ordered by its place.

A table of samples has the columns ``read`` (key), ``i`` (place from 0) and a value.  Every function
needs the same distribution, by read, so a chain of them costs one shuffle and one sort; a read is one
window partition, whose size is the length of one read (10^3 to 10^6 samples).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def by_read(read: str = "read", i: str = "i") -> WindowSpec:
    return Window.partitionBy(read).orderBy(i)


def whole_read(read: str = "read") -> WindowSpec:
    return Window.partitionBy(read)


def with_prefix_sums(samples: DataFrame, value: str, read: str = "read", i: str = "i") -> DataFrame:
    """Exclusive prefix sums of the value and of its square: columns ``sum`` and ``sumsq``."""
    w = by_read(read, i).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(dict(samples.dtypes)[value])
    return samples.withColumns({"sum": F.coalesce(F.sum(value).over(w), zero), "sumsq": F.coalesce(F.sum(F.col(value) * F.col(value)).over(w), zero)})


def rolling_mean(samples: DataFrame, value: str, width: int, out: str = "mean", read: str = "read", i: str = "i") -> DataFrame:
    """Mean of ``width`` samples from each place on; the last ``width`` places of a read have none and go."""
    w = by_read(read, i).rowsBetween(0, width - 1)
    n = F.count("*").over(whole_read(read))
    return samples.withColumns({out: F.sum(value).over(w) / width, "__n": n}).filter(F.col(i) < F.col("__n") - width).drop("__n")


#: Fixed value: least positive normal single-precision number, the floor of a window's variance.
LEAST_VARIANCE = 1.1754943508222875e-38


def with_tstat(samples: DataFrame, value: str, width: int, out: str = "tstat", read: str = "read", i: str = "i") -> DataFrame:
    """Two-window t-statistic between the ``width`` samples before each place and those from it on.

    0 where either window leaves the read, and for reads shorter than two windows.
    """
    if width < 2:
        return samples.withColumn(out, F.lit(0.0))
    before, after = by_read(read, i).rowsBetween(-width, -1), by_read(read, i).rowsBetween(0, width - 1)
    x = F.col(value).cast("double") if dict(samples.dtypes)[value] not in ("bigint", "int", "smallint") else F.col(value)
    n = F.count("*").over(whole_read(read))
    sums = {"__n": n, "__s1": F.sum(x).over(before), "__q1": F.sum(x * x).over(before), "__s2": F.sum(x).over(after), "__q2": F.sum(x * x).over(after)}
    m1, m2 = F.col("__s1") / width, F.col("__s2") / width
    var = F.greatest(F.lit(LEAST_VARIANCE), F.col("__q1") / width - m1 * m1 + F.col("__q2") / width - m2 * m2)
    inside = (F.col("__n") >= 2 * width) & (F.col(i) >= width) & (F.col(i) <= F.col("__n") - width)
    return samples.withColumns(sums).withColumn(out, F.when(inside, F.abs(m2 - m1) / F.sqrt(var / width)).otherwise(0.0)).drop(*sums)


def with_zscore(samples: DataFrame, value: str, out: str = "z", read: str = "read") -> DataFrame:
    """Value less the read's mean, over its population deviation; null where that is 0."""
    w = whole_read(read)
    n, s, q = F.count(value).over(w), F.sum(value).over(w), F.sum(F.col(value) * F.col(value)).over(w)
    var = (F.col("__q") * F.col("__n") - F.col("__s") * F.col("__s")) / (F.col("__n") * F.col("__n"))
    scaled = F.when(var > 0, (F.col(value) - F.col("__s") / F.col("__n")) / F.sqrt(var))
    return samples.withColumns({"__n": n, "__s": s, "__q": q}).withColumn(out, scaled).drop("__n", "__s", "__q")


def global_zscore(levels: DataFrame, value: str, out: str = "z") -> DataFrame:
    """As ``with_zscore``, over all rows: two aggregates, joined back as one broadcast row."""
    stats = levels.agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__d")).withColumn("__one", F.lit(1))
    return levels.withColumn("__one", F.lit(1)).join(F.broadcast(stats), "__one").withColumn(out, F.when(F.col("__d") > 0, (F.col(value) - F.col("__m")) / F.col("__d"))).drop("__one", "__m", "__d")


def chunk_argmin(cells: DataFrame, width: Column | int, keys: list[str], pos: str = "pos", score: str = "score") -> DataFrame:
    """First minimum of every ``width`` consecutive positions: keys, chunk, score, pos.  Map-side combined."""
    chunk = F.floor(F.col(pos) / width).cast("int").alias("chunk")
    return cells.groupBy(*keys, chunk).agg(F.min(F.struct(score, pos)).alias("m")).select(*keys, "chunk", F.col(f"m.{score}").alias(score), F.col(f"m.{pos}").alias(pos))


def top_hits(candidates: DataFrame, k: int, keys: list[str], score: str = "score", seq: str = "seq") -> DataFrame:
    """The k best candidates of each read with their ``rank``; of equal scores the later one is better.

    ``min_by``-like aggregates would do for k = 1; the window keeps k rows for each read and drops the rest
    before the shuffle's output is materialised (Catalyst pushes the rank limit below it).
    """
    w = Window.partitionBy(*keys).orderBy(F.col(score).asc(), F.col(seq).desc())
    return candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def event_rows(boundaries: DataFrame, samples: DataFrame, value: str, read: str = "read", i: str = "i", at: str = "at") -> DataFrame:
    """Events between boundaries, from prefix sums alone: read, start, length, mean, stdv.

    ``boundaries`` (read, at) are places where a new event begins; 0 and the read's end are implied.
    """
    sums = with_prefix_sums(samples.select(read, i, value), value, read, i)
    ends = sums.withColumn("__last", F.lead(i).over(by_read(read, i)).isNull())
    last = ends.filter("__last").select(read, (F.col(i) + 1).alias("at"), (F.col("sum") + F.col(value)).alias("sum"), (F.col("sumsq") + F.col(value) * F.col(value)).alias("sumsq"))
    cuts = boundaries.select(read, F.col(at).alias(i)).distinct()
    starts = sums.join(cuts, [read, i], "left_semi").unionByName(sums.filter(F.col(i) == 0)).distinct().select(read, F.col(i).alias("at"), "sum", "sumsq")
    edges = starts.unionByName(last)
    w = Window.partitionBy(read).orderBy("at")
    nxt = {c: F.lead(c).over(w) for c in ("at", "sum", "sumsq")}
    spans = edges.withColumns({f"__{c}": x for c, x in nxt.items()}).filter(F.col("__at").isNotNull())
    n = F.col("__at") - F.col("at")
    m = (F.col("__sum") - F.col("sum")) / n
    var = F.greatest(F.lit(0.0), (F.col("__sumsq") - F.col("sumsq")) / n - m * m)
    return spans.select(read, F.col("at").alias("start"), n.alias("length"), m.alias("mean"), F.sqrt(var).alias("stdv"))
