"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` on as many partitions as there are cores, if its scan has fewer; else as it is.

    Only inputs of a few small files are dealt anew; what is large enough to matter isn't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset a temporary folder is taken
    in local mode (tests); on a cluster executors would not see it, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends in the shared folder and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that a result of these names replaces, whatever their case."""
    gone = {n.lower() for n in names}
    kept = [c for c in df.columns if c.lower() not in gone]
    return df if len(kept) == len(df.columns) else df.select(*[F.col(f"`{c}`") for c in kept])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_skewed(large: DataFrame, small: DataFrame, key: str, weight: str, deal: str, most: int = 50_000) -> DataFrame:
    """``large`` left-joined with ``small``, whose ``key`` is unique and whose ``weight`` is the rows of ``large`` with it.

    Keys that hold more than one in ``most`` of all rows (so fewer than ``most`` of them) are broadcast;
    their rows, and those with a null key, are dealt over all partitions of the join for the other keys
    by a hash of ``deal``, so no task has all rows of one key.  ``small`` should be cut, as it is read three times.
    """
    total = small.agg(F.sum(weight)).first()[0] or 0
    limit = max(1000, total // most)
    rest = [c for c in small.columns if c not in (key, weight)]
    value = F.struct(*rest).alias("__value")
    hot = small.filter(F.col(weight) > limit).select(key, value.alias("__hot"))
    cold = small.filter(F.col(weight) <= limit).select(key, F.lit(0).alias("__deal"), value.alias("__cold"))
    found = large.join(F.broadcast(hot), key, "left")
    found = found.withColumn("__deal", F.when(F.col("__hot").isNull() & F.col(key).isNotNull(), 0).otherwise(1 + F.pmod(F.xxhash64(deal), F.lit(1 << 16))).cast("int"))
    both = found.join(cold, [key, "__deal"], "left").withColumn("__value", F.coalesce("__hot", "__cold"))
    return both.select(*large.columns, *[F.col(f"__value.{c}").alias(c) for c in rest])


def sample_of_each(rows: DataFrame, label: str, keys: list[str], sizes: dict, most: int, seed: str) -> DataFrame:
    """At most ``most`` rows of each label, chosen by the hash of ``keys``; rows that repeat all keys count once.

    ``sizes`` says how many rows each label has.  A share by hash comes first, so that only about twice
    ``most`` rows are ranked.  Only labels and hashes are ranked; the rows themselves are fetched by the chosen hashes,
    of which there are ``most`` times the labels, and those that repeat are merged where they lie first.
    """
    spark = rows.sparkSession
    kind = rows.select(label).schema
    shares = spark.createDataFrame([(v, min(1.0, 2.0 * most / n)) for v, n in sizes.items()], kind.add("__share", "double"))
    named = rows.withColumn("__name", F.xxhash64(F.lit(seed), *keys))
    narrow = named.select(label, "__name").join(F.broadcast(shares), label)
    near = narrow.filter(F.pmod("__name", F.lit(1 << 40)) < (F.col("__share") * (1 << 40)).cast("long")).select(label, "__name").distinct()
    ranked = near.withColumn("__rank", F.row_number().over(Window.partitionBy(label).orderBy("__name"))).filter(F.col("__rank") <= most)
    return named.join(F.broadcast(ranked.select(label, "__name")), [label, "__name"], "left_semi").dropDuplicates([label, "__name"]).drop("__name").select(*rows.columns)


def id_bucket(doc_id: str | Column, buckets: int) -> Column:
    """crc32 of the id's decimal text, modulo ``buckets``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % buckets


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column of a batch as Python strings; null becomes empty."""
    return ["" if x is None else x for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that none holds much more than ``most_bytes`` of the named column (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(name))
        rows = max(1, int(batch.num_rows * most_bytes / max(1, column.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
