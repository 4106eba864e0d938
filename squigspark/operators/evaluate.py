"""Accuracy of mappings against a truth set: an equi-join with a residual predicate, and counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EvalOptions:
    secondary: bool = True  # any truth row counts; else only one with the same tp
    tid_only: bool = False  # the target is enough
    threshold: int = 100  # of the nearer end's distance


def _near(truth: DataFrame, keys: list[str], position: str, width: int) -> DataFrame:
    """For every stretch of ``width`` positions: whether a truth row lies in it, the last one in the
    stretch before and the first one in the stretch after.

    Two positions of one stretch are nearer than ``width``, and of the neighbouring stretches only the
    nearest position matters, so this table answers "is any truth row near" exactly, in one row.
    """
    at = F.floor(F.col(position) / width)
    least = truth.filter(F.col(position).isNotNull()).groupBy(*keys, at.alias("at")).agg(F.min(position).alias("low"), F.max(position).alias("high"))
    none = F.lit(None).cast(dict(truth.dtypes)[position])
    row = lambda step, here, before, after: F.struct((F.col("at") + step).alias("at"), F.lit(here).alias("here"), before.alias("before"), after.alias("after"))
    served = F.explode(F.array(row(-1, False, none, F.col("low")), row(0, True, none, none), row(1, False, F.col("high"), none)))
    spread = least.select(*keys, served.alias("s")).select(*keys, "s.*")
    return spread.groupBy(*keys, "at").agg(F.bool_or("here").alias("here"), F.max("before").alias("before"), F.min("after").alias("after"))


#: Truth rows of a read up to which they are gathered beside it, and reads beyond that which are set apart.
GATHERED, MOST_SET_APART = 64, 10_000


def classify(truth: DataFrame, test: DataFrame, opt: EvalOptions = EvalOptions()) -> DataFrame:
    """Every test row with ``outcome``: correct, incorrect or only_in_test.  Repeated rows count each.

    The truth rows of a read are gathered and joined to its test rows by one key, which takes a shuffle of each side.  Reads with
    more than ``GATHERED`` of them, or all if very many reads are such, are looked up by stretches of positions instead.
    A null read id, target, strand or position matches nothing.
    """
    crowded = truth.filter("rid is not null").groupBy("rid").agg(F.count("*").alias("n")).filter(F.col("n") > GATHERED).select("rid").limit(MOST_SET_APART + 1).collect()
    if not crowded:
        return _by_read(truth, test, opt)
    if len(crowded) > MOST_SET_APART:
        return _by_stretches(truth, test, opt)
    apart = truth.sparkSession.createDataFrame([(r["rid"],) for r in crowded], "__apart string")
    split = lambda df, how: df.join(F.broadcast(apart), F.col("rid") == F.col("__apart"), how)
    return _by_read(split(truth, "left_anti"), split(test, "left_anti"), opt).unionByName(_by_stretches(split(truth, "left_semi"), split(test, "left_semi"), opt))


def _by_read(truth: DataFrame, test: DataFrame, opt: EvalOptions) -> DataFrame:
    """``classify`` for reads whose truth rows fit beside them."""
    row = F.struct("tid", "strand", *([] if opt.secondary else ["tp"]), *([] if opt.tid_only else ["target_start", "target_end"]))
    gathered = truth.filter("rid is not null").groupBy(F.col("rid").alias("__rid")).agg(F.collect_set(row).alias("__truth"))
    near = lambda t, position: F.abs(F.col(position) - t[position]) < opt.threshold

    def fits(t: Column) -> Column:
        same = (t["tid"] == F.col("tid")) & (t["strand"] == F.col("strand"))
        same = same if opt.secondary else same & (t["tp"] == F.col("tp"))
        placed = same if opt.tid_only else same & (F.coalesce(near(t, "target_start"), F.lit(False)) | F.coalesce(near(t, "target_end"), F.lit(False)))
        return F.coalesce(placed, F.lit(False))

    outcome = F.when(F.col("__truth").isNull(), "only_in_test").when(F.exists("__truth", fits), "correct").otherwise("incorrect")
    return test.join(gathered, F.col("rid") == F.col("__rid"), "left").withColumn("outcome", outcome).drop("__rid", "__truth")


def _by_stretches(truth: DataFrame, test: DataFrame, opt: EvalOptions) -> DataFrame:
    """``classify`` whatever the number of truth rows that a read has.

    Truth is aggregated to unique keys before each join, so no join multiplies test rows, and a read
    that very many rows share is neither gathered nor paired with itself.
    """
    keys = ["rid", "tid", "strand"] + ([] if opt.secondary else ["tp"])
    known = truth.filter("rid is not null").select(F.col("rid").alias("__rid")).distinct().withColumn("__known", F.lit(True))
    out = test.join(known, F.col("rid") == F.col("__rid"), "left").drop("__rid")
    hits = []
    if opt.tid_only:
        places = truth.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct().withColumn("__hit", F.lit(True))
        out = out.join(places, [F.col(k) == F.col(f"__{k}") for k in keys], "left").drop(*[f"__{k}" for k in keys])
        hits.append("__hit")
    elif opt.threshold > 0:
        for position in ("target_start", "target_end"):
            names = {c: f"__{position}_{c}" for c in (*keys, "at", "here", "before", "after")}
            near = _near(truth, keys, position, opt.threshold).select(*[F.col(c).alias(n) for c, n in names.items()])
            on = [F.col(k) == F.col(names[k]) for k in keys] + [F.floor(F.col(position) / opt.threshold) == F.col(names["at"])]
            out = out.join(near, on, "left")
            x = F.col(position)
            hit = F.col(names["here"]) | (F.col(names["before"]) > x - opt.threshold) | (F.col(names["after"]) < x + opt.threshold)
            out = out.withColumn(f"__hit_{position}", hit).drop(*names.values())
            hits.append(f"__hit_{position}")
    any_hit = F.lit(False)
    for h in hits:
        any_hit = any_hit | F.coalesce(F.col(h), F.lit(False))
    outcome = F.when(F.col("__known").isNull(), "only_in_test").when(any_hit, "correct").otherwise("incorrect")
    return out.withColumn("outcome", outcome).drop("__known", *hits)


def summary(truth: DataFrame, test: DataFrame, opt: EvalOptions = EvalOptions()) -> DataFrame:
    """One row of counts and percentages.  Rows that only the test has stay in the denominators."""
    of = lambda s: F.count(F.when(F.col("outcome") == s, 1))
    b = classify(truth, test, opt).agg(F.count("*").alias("test_mapped"), of("correct").alias("correct"), of("incorrect").alias("incorrect"), of("only_in_test").alias("only_in_test"))
    a = truth.agg(F.count("*").alias("truth_rec"), F.count_distinct("rid").alias("truth_mapped"))
    both = a.withColumn("one", F.lit(1)).join(F.broadcast(b.withColumn("one", F.lit(1))), "one").drop("one")
    share = lambda x, y: F.when(F.col(y) > 0, F.col(x) * 100.0 / F.col(y))
    return both.select(
        "truth_rec", "truth_mapped", "test_mapped", "correct", "incorrect", "only_in_test",
        share("test_mapped", "truth_mapped").alias("mapped_pct"), share("correct", "test_mapped").alias("correct_pct"), share("incorrect", "test_mapped").alias("incorrect_pct"),
    )


def mapq_histogram(truth: DataFrame, test: DataFrame, opt: EvalOptions = EvalOptions()) -> DataFrame:
    """(mapq, n_correct, n_incorrect), for reads that the truth has; qualities above 60 fall in the null row."""
    known = classify(truth, test, opt).filter("outcome <> 'only_in_test'")
    quality = F.when(F.col("mapq").between(0, 60), F.col("mapq"))
    of = lambda s: F.count(F.when(F.col("outcome") == s, 1))
    return known.groupBy(quality.alias("mapq")).agg(of("correct").alias("n_correct"), of("incorrect").alias("n_incorrect"))


def report_lines(stats: DataFrame, histogram: DataFrame) -> DataFrame:
    """The report as ordered lines of text (place, value): the summary, then qualities from high to low."""
    s = stats.select(
        F.posexplode(
            F.array(
                F.concat(F.lit("Number of records in truth set\t"), F.col("truth_rec")),
                F.concat(F.lit("Reads mapped in truth set\t"), F.col("truth_mapped")),
                F.format_string("Mappings in test set\t%d\t%.2f%%", "test_mapped", F.coalesce("mapped_pct", F.lit(0.0))),
                F.format_string("Correct\t%d\t%.2f%%", "correct", F.coalesce("correct_pct", F.lit(0.0))),
                F.format_string("Incorrect\t%d\t%.2f%%", "incorrect", F.coalesce("incorrect_pct", F.lit(0.0))),
                F.concat(F.lit("Only in test set\t"), F.col("only_in_test")),
                F.lit("MAPQ\tcorrect\tincorrect"),
            )
        ).alias("place", "value")
    )
    # Qualities are 0..60, so the places after the summary are known without a sort of all rows.
    rows = histogram.select((F.lit(100) + F.coalesce(60 - F.col("mapq"), F.lit(61))).cast("int").alias("place"), F.concat_ws("\t", F.coalesce(F.col("mapq").cast("string"), F.lit("other")), F.col("n_correct"), F.col("n_incorrect")).alias("value"))
    return s.unionByName(rows).orderBy("place")
