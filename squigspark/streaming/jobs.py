"""The same work over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import EvalOptions, classify
from ..operators.mapping import map_reads
from ..options import MapOptions


def map_stream(reads: DataFrame, refs: DataFrame, opt: MapOptions = MapOptions()) -> DataFrame:
    """A stream of reads mapped: no state, so rows leave with the micro-batch that brought them."""
    return map_reads(reads, refs, opt)


def accuracy_stream(truth: DataFrame, mappings: DataFrame, opt: EvalOptions = EvalOptions()) -> DataFrame:
    """Running outcome counts by mapping quality, for output mode complete: a stream-static join.

    After the last batch they equal the batch histogram; reads that the truth lacks are counted too.
    """
    quality = F.when(F.col("mapq").between(0, 60), F.col("mapq"))
    return classify(truth, mappings, opt).groupBy(quality.alias("mapq"), "outcome").count()
