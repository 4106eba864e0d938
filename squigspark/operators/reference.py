"""Synthetic references: the current level that each k-mer of a contig should give.

The model is a table of at most 4^9 rows, broadcast after that check; k-mers are ranked and looked up in
Arrow batches, so contigs never shuffle.  Levels are z-scored for each contig and strand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.arrays import zscore
from ..functions.bases import MOST_KMERS, rank_lists, reverse_complement, u_to_t
from ..scratch import scratch


def model_levels(model: DataFrame) -> np.ndarray:
    """The model's levels by rank; an error for more rows than a model may have, or for a gap."""
    rows = model.select("rank", F.col("level_mean").cast("float").alias("level")).limit(MOST_KMERS + 1).toArrow().sort_by("rank")
    if rows.num_rows > MOST_KMERS:
        raise ValueError(f"a k-mer model has at most {MOST_KMERS} rows")
    if rows["rank"].to_pylist() != list(range(rows.num_rows)):
        raise ValueError("a k-mer model has one row for each rank")
    return rows["level"].to_numpy()


#: Letters whose levels are made at once; their ranks take eight bytes each, several times over.
LETTERS_HELD = 1 << 18


def few_letters(batches: Iterator[pa.RecordBatch], letters: str) -> Iterator[pa.RecordBatch]:
    """Batches in slices of some ``LETTERS_HELD`` letters, or of one longer sequence."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(letters))), 0).to_numpy()
        total, at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(total, total[at] + LETTERS_HELD, side="right")) - 1)
            yield batch.slice(at, upto - at)
            at = upto


def with_levels(rows: DataFrame, model: DataFrame, k: int, letters: str = "letters", out: str = "levels") -> DataFrame:
    """``rows`` with the model's level of every k-mer of a sequence.  Narrow: the model, 4^9 numbers at most, goes to the tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(model_levels(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_letters(batches, letters):
            at, ranks = rank_lists(batch.column(batch.schema.get_field_index(letters)), k)
            levels = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(shared.value[ranks], pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, levels], [*batch.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def rna_part(length: Column, k: int, query_size: int, from_end: bool) -> tuple[Column, Column, Column]:
    """For RNA only a stretch is kept: its number of k-mers, its first base (from 0), and the offset to lift by.

    A query from the read's start meets the 3' end of the transcript; one from its end meets the 5' end.
    """
    n = F.least(F.floor(F.lit(1.5) * query_size).cast("int"), length + 1 - k)
    start = F.lit(0) if from_end else length - n - (k - 1)
    return n, start, start


def synthetic_references(
    contigs: DataFrame, model: DataFrame, k: int, rna: bool = False, full: bool = False, query_size: int = 250, from_end: bool = False, invert: bool = False, normalise: str = "strand", rna_letters: bool = False
) -> DataFrame:
    """One row for each contig (and strand, for DNA) with its z-scored levels; contigs shorter than k go.

    ``normalise``: "strand" scores each row on its own, "global" all levels of all rows together, "none" keeps the model's levels.
    """
    seq = u_to_t("seq") if rna_letters else F.col("seq")
    known = contigs.select("ref_idx", "name", F.length("seq").alias("seq_len"), seq.alias("seq")).filter(F.col("seq_len") >= k)
    n, start, offset = rna_part(F.col("seq_len"), k, query_size, from_end) if rna and not full else (F.col("seq_len") + 1 - k, F.lit(0), F.lit(0))
    known = known.select("*", n.cast("int").alias("ref_len"), offset.cast("int").alias("st_offset")).withColumn("part", F.substring("seq", (start + 1).cast("int"), F.col("ref_len") + (k - 1)))
    strand = lambda s, x: F.struct(F.lit(s).alias("strand"), x.alias("letters"))
    strands = [strand("+", F.col("part"))] + ([] if rna else [strand("-", reverse_complement("part"))])
    rows = known.select("ref_idx", "name", "ref_len", "seq_len", "st_offset", F.explode(F.array(*strands)).alias("s")).select("*", "s.strand", "s.letters").drop("s")
    out = with_levels(rows, model, k).drop("part", "letters")
    if invert:
        out = out.withColumn("levels", F.reverse("levels"))
    if normalise == "global":
        return with_global_score(out)
    return out.withColumn("levels", zscore("levels")) if normalise == "strand" else out


def moments(x: str) -> Column:
    """(n, m, m2) of an array: its length, mean and sum of squared deviations, in double precision."""
    n = F.size(x).cast("double")
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.when(n > 0, n)
    squares = lambda m: F.aggregate(x, F.lit(0.0), lambda a, v: a + (v.cast("double") - m) * (v.cast("double") - m))
    return F.get(F.transform(F.array(mean), lambda m: F.struct(n.alias("n"), m.alias("m"), squares(m).alias("m2"))), F.lit(0))


def with_global_score(refs: DataFrame) -> DataFrame:
    """References scored by the mean and the population deviation of all their levels; null levels where that is 0.

    Each row's moments are merged in one aggregate, whose single row goes back to all rows.
    """
    own = refs.select(moments("levels").alias("p")).select("p.n", "p.m", "p.m2")
    joined = refs.withColumn("__one", F.lit(1)).join(F.broadcast(merged_moments(own.groupBy()).withColumn("__one", F.lit(1))), "__one", "left")  # one row
    return joined.withColumn("levels", scored_levels()).select(*refs.columns)


def merged_moments(own: GroupedData) -> DataFrame:
    """``__mean`` and ``__deviation`` of each group of rows (n, m, m2)."""
    sums = own.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum("m2").alias("m2"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"))
    mean = F.col("nm") / F.col("n")
    deviation = F.sqrt(F.greatest((F.col("m2") + F.col("nmm") - F.col("n") * mean * mean) / F.col("n"), F.lit(0.0)))
    return sums.withColumns({"__mean": mean, "__deviation": deviation}).drop("n", "nm", "m2", "nmm")


def scored_levels() -> Column:
    return F.transform("levels", lambda v: F.when(F.col("__deviation") > 0, ((v.cast("double") - F.col("__mean")) / F.col("__deviation")).cast("float")))


#: Moments of so many contigs and strands are broadcast; those of more are joined.
MOST_BROADCAST = 200_000
#: Letters of a contig whose parts pass one window group.
BLOCK_LETTERS = 1 << 20


def tiles_of_parts(parts: DataFrame, model: DataFrame, k: int, both_strands: bool = True, invert: bool = False, normalise: str = "strand", rna_letters: bool = False) -> DataFrame:
    """Contigs in parts (ref_idx, name, part, start, seq) as tiles of levels, stored once: (seq, ref_idx, strand, name, ref_len, seq_len, st_offset, column, width, levels).

    The parts are stored first, so that they are made once.  A part's k-mers reach k - 1 letters into those after it.  Parts
    are shuffled once, by contig and block of ``BLOCK_LETTERS``, to where their last letter is followed; the first letters of a
    part go to the blocks before it too, where these differ, and the contig's length to all its blocks.
    Levels are made part by part, and scored by moments in double precision that are merged over a contig's (or all) tiles
    as tiles are read, so no task holds a contig.
    """
    spark = parts.sparkSession
    seq = u_to_t("seq") if rna_letters else F.col("seq")
    stored = scratch(spark, "parts")
    parts.filter("seq != ''").select("ref_idx", "name", F.col("start").cast("long").alias("start"), seq.alias("seq")).write.parquet(stored)
    known = spark.read.parquet(stored)
    block = lambda at: F.floor(at / BLOCK_LETTERS)
    places = [F.col("start") + F.length("seq"), F.col("start"), F.greatest(F.col("start") - (k - 1), F.lit(0))]
    placed = known.select("*", F.posexplode(F.array_distinct(F.array(*map(block, places)))).alias("copy", "block"))
    placed = placed.withColumn("seq", F.when(F.col("copy") == 0, F.col("seq")).otherwise(F.substring("seq", 1, k - 1)))
    sizes = known.groupBy("ref_idx").agg(F.sum(F.length("seq")).alias("bases"))
    sizes = sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), block(F.col("bases")))).alias("block"))
    after = Window.partitionBy("ref_idx", "block").orderBy("start")
    heads = [F.coalesce(F.lead(F.substring("seq", 1, k - 1), i).over(after), F.lit("")) for i in range(1, k)]
    rows = placed.join(sizes, ["ref_idx", "block"]).withColumn("tail", F.substring(F.concat(F.lit(""), *heads), 1, k - 1)).filter("copy = 0")
    rows = rows.withColumn("letters", F.concat("seq", "tail")).withColumn("width", (F.length("letters") - (k - 1)).cast("int")).filter("width > 0")
    ref_len = F.col("bases") - (k - 1)
    mirrored = ref_len - F.col("start") - F.col("width")
    strand = lambda s, x, column: F.struct(F.lit(s).alias("strand"), x.alias("letters"), column.alias("column"))
    strands = [strand("+", F.col("letters"), mirrored if invert else F.col("start"))] + ([strand("-", reverse_complement("letters"), mirrored)] if both_strands else [])
    fixed = [F.col("ref_idx").cast("int").alias("ref_idx"), "name", ref_len.cast("int").alias("ref_len"), F.col("bases").cast("int").alias("seq_len"), F.lit(0).alias("st_offset"), "width"]
    placed = rows.select(*fixed, F.explode(F.array(*strands)).alias("s")).select("*", "s.strand", "s.letters", F.col("s.column").cast("int").alias("column")).drop("s")
    leveled = with_levels(placed, model, k).drop("letters").withColumn("seq", 2 * F.col("ref_idx").cast("long") + (F.col("strand") == "-").cast("long"))
    leveled = leveled.withColumn("levels", F.reverse("levels")) if invert else leveled
    path = scratch(spark, "tiles")
    leveled.sortWithinPartitions("seq", "column").write.parquet(path)
    tiles = spark.read.parquet(path)
    if normalise == "none":
        return tiles
    by = ["seq"] if normalise == "strand" else []
    own = tiles.select("seq", moments("levels").alias("p")).select("seq", "p.n", "p.m", "p.m2")
    scale = merged_moments(own.groupBy(*by)).withColumn("__one", F.lit(1))
    scale = F.broadcast(scale) if scale.count() <= MOST_BROADCAST else scale
    joined = tiles.withColumn("__one", F.lit(1)).join(scale, [*by, "__one"], "left")
    return joined.withColumn("levels", scored_levels()).select(*tiles.columns)


def model_from_rule(spark, k: int) -> DataFrame:
    """A stand-in model: levels from a rule, where no measured one is at hand."""
    rank = F.col("id")
    digits = F.lpad(F.conv(rank, 10, 4), k, "0")
    return spark.range(4**k).select(rank.cast("int").alias("rank"), F.translate(digits, "0123", "ACGT").alias("kmer"), (60 + (rank * 37) % 101).cast("float").alias("level_mean"), F.lit(2).cast("float").alias("level_stdv"))
