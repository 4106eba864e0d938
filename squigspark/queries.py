"""Queries of the driver contract: every operator over whole tables, with DuckDB SQL where it can be said.

The driver's tables hold no nanopore reads, so each query derives its input by a fixed rule: the
values of a user's events are a signal, the letters A, C, G and T of a document are a contig, order
lines and orders are true and tested mappings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .functions import arrays, bases, text
from .operators import dtw, evaluate, events, mapping, reference, segments, windows
from .options import MapOptions
from .schemas import READ
from .scratch import scratch, spread
from .sources import codecs, container
from .sources.tables import parse_paf


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Derived inputs

def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read, i, raw: one row for each event of a user."""
    e = table(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("read"), place.cast("long").alias("i"), F.floor(F.col("value") * 100).cast("long").alias("raw"))


SAMPLES = "samples AS (SELECT user_id AS read, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CAST(floor(value * 100) AS BIGINT) AS raw FROM events)"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read, x: the samples of a read as an array."""
    packed = samples(spark, sf_dir).groupBy("read").agg(F.array_sort(F.collect_list(F.struct("i", "raw"))).alias("p"))
    return packed.select("read", F.transform("p", lambda p: p["raw"]).alias("x"))


SIGNALS = SAMPLES + ", signals AS (SELECT read, list(raw ORDER BY i) AS x FROM samples GROUP BY read)"
K = 5


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    seq = F.regexp_replace(F.upper("text"), "[^ACGT]+", "")
    return d.select(F.col("doc_id").cast("int").alias("ref_idx"), F.concat(F.lit("c"), F.col("doc_id")).alias("name"), seq.alias("seq"))


CONTIGS = "contigs AS (SELECT CAST(doc_id AS INT) AS ref_idx, 'c' || doc_id AS name, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"


def truth_paf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("r"), F.col("l_orderkey")).alias("rid"), F.concat(F.lit("t"), F.col("l_suppkey") % 7).alias("tid"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        F.col("l_partkey").alias("target_start"), (F.col("l_partkey") + F.col("l_quantity").cast("int") * 10).alias("target_end"), F.when(F.col("l_linenumber") == 1, "P").otherwise("S").alias("tp"),
    )


def tested_paf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("r"), F.col("o_orderkey") + 100).alias("rid"), F.concat(F.lit("t"), F.col("o_custkey") % 7).alias("tid"), F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.col("o_custkey").alias("target_start"), (F.col("o_custkey") + 250).alias("target_end"), F.lit("P").alias("tp"), (F.col("o_custkey") % 61).cast("int").alias("mapq"), F.col("o_orderkey"), F.col("o_custkey"),
    )


PAFS = """
truth AS (SELECT 'r' || l_orderkey AS rid, 't' || (l_suppkey % 7) AS tid, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_partkey AS target_start,
                 l_partkey + CAST(l_quantity AS INT) * 10 AS target_end, CASE WHEN l_linenumber = 1 THEN 'P' ELSE 'S' END AS tp FROM lineitem),
tested AS (SELECT 'r' || (o_orderkey + 100) AS rid, 't' || (o_custkey % 7) AS tid, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, o_custkey AS target_start,
                  o_custkey + 250 AS target_end, 'P' AS tp, CAST(o_custkey % 61 AS INT) AS mapq, o_orderkey, o_custkey FROM orders)"""


def _classified(extra: str) -> str:
    return f"""{PAFS},
known AS (SELECT DISTINCT rid FROM truth),
right_ones AS (SELECT DISTINCT s.o_orderkey FROM tested s JOIN truth t ON s.rid = t.rid AND s.tid = t.tid AND s.strand = t.strand {extra}),
outcome AS (SELECT s.*, CASE WHEN k.rid IS NULL THEN 'only_in_test' WHEN r.o_orderkey IS NOT NULL THEN 'correct' ELSE 'incorrect' END AS outcome
            FROM tested s LEFT JOIN known k ON s.rid = k.rid LEFT JOIN right_ones r ON s.o_orderkey = r.o_orderkey)"""


_NEAR = "AND least(abs(s.target_start - t.target_start), abs(s.target_end - t.target_end)) < 100"
_SUMMARY = """
SELECT a.*, b.*, test_mapped * 100.0::DOUBLE / truth_mapped AS mapped_pct, correct * 100.0::DOUBLE / test_mapped AS correct_pct, incorrect * 100.0::DOUBLE / test_mapped AS incorrect_pct
FROM (SELECT count(*) AS truth_rec, count(DISTINCT rid) AS truth_mapped FROM truth) a,
     (SELECT count(*) AS test_mapped, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'incorrect') AS incorrect, count(*) FILTER (outcome = 'only_in_test') AS only_in_test FROM outcome) b"""


# Evaluation

def paf_eval_summary(spark, d):
    return evaluate.summary(truth_paf(spark, d), tested_paf(spark, d))


def paf_eval_tid_only(spark, d):
    return evaluate.summary(truth_paf(spark, d), tested_paf(spark, d), evaluate.EvalOptions(tid_only=True))


def paf_eval_primary_only(spark, d):
    return evaluate.summary(truth_paf(spark, d), tested_paf(spark, d), evaluate.EvalOptions(secondary=False))


def paf_eval_mapq_hist(spark, d):
    return evaluate.mapq_histogram(truth_paf(spark, d), tested_paf(spark, d))


def paf_eval_only_in_test(spark, d):
    return tested_paf(spark, d).join(truth_paf(spark, d), "rid", "left_anti").select("rid", "mapq")


def paf_eval_outcomes(spark, d):
    return evaluate.classify(truth_paf(spark, d), tested_paf(spark, d)).select("o_orderkey", "rid", "outcome")


def truth_dup_reads(spark, d):
    return truth_paf(spark, d).groupBy("rid").agg(F.count("*").alias("n")).filter("n > 1")


# Lookup

def batch_lookup(spark, d):
    """Reads by a list of ids (the customers'), and which ids have none."""
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("read"))
    reads = samples(spark, d).groupBy("read").agg(F.count("*").alias("n"), F.sum("raw").alias("total"))
    return ids.join(reads, "read", "left").select("read", F.col("n").isNotNull().alias("found"), "n", "total")


# Scalar and array functions

OFFSET, RANGE, DIGITISATION = 10.0, 1467.61, 8192.0


def raw_to_pa(spark, d):
    x = signals(spark, d).select("read", arrays.to_picoamps("x", F.lit(DIGITISATION), F.lit(OFFSET), F.lit(RANGE)).alias("pa"))
    return x.select("read", F.posexplode("pa").alias("i", "pa")).select("read", "i", F.col("pa").cast("double").alias("pa"))


def clamp_outliers(spark, d):
    return signals(spark, d).select("read", F.posexplode(arrays.clamp_outliers("x")).alias("i", "v"))


def array_stats(spark, d):
    r = lambda c: F.round(c, 6)
    return signals(spark, d).select(
        "read", r(arrays.mean("x", "double")).alias("mean"), r(arrays.stdev_pop("x", "double")).alias("stdv"), arrays.upper_median("x").alias("median"), arrays.kth_smallest("x", 2).alias("third"),
        r(arrays.mad("x")).alias("mad"), r(arrays.quantile("x", 0.1)).alias("q10"), r(arrays.quantile("x", 0.75)).alias("q75"),
    )


def array_prefix_sums(spark, d):
    return signals(spark, d).select("read", F.posexplode(arrays.prefix_sums("x")).alias("i", "total"))


def array_zscore(spark, d):
    return signals(spark, d).select("read", F.posexplode(arrays.zscore("x", "double")).alias("i", "z")).select("read", "i", F.round("z", 6).alias("z"))


def number_texts(spark, d):
    return table(spark, d, "events").select("event_id", text.number_text("value").alias("value_text"), text.number_text(F.col("event_id") * F.lit(0.5)).alias("half_text"))


def mapping_qualities(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", text.mapping_quality(F.col("o_custkey").cast("double"), (F.col("o_custkey") + F.col("o_orderkey") % 40).cast("double")).alias("mapq"))


# Window functions

def prefix_sums(spark, d):
    return windows.with_prefix_sums(samples(spark, d), "raw")


def rolling_mean(spark, d):
    return windows.rolling_mean(samples(spark, d), "raw", 5)


def tstat_short(spark, d):
    return windows.with_tstat(samples(spark, d), "raw", 3).withColumn("tstat", F.round("tstat", 6))


def tstat_long(spark, d):
    return windows.with_tstat(samples(spark, d), "raw", 6).withColumn("tstat", F.round("tstat", 6))


def window_zscore(spark, d):
    return windows.with_zscore(samples(spark, d), "raw").withColumn("z", F.round("z", 6))


def global_zscore(spark, d):
    return windows.global_zscore(samples(spark, d), "raw").withColumn("z", F.round("z", 6))


def chunk_argmin(spark, d):
    return windows.chunk_argmin(samples(spark, d), 10, ["read"], "i", "raw")


def top_hits(spark, d):
    return windows.top_hits(samples(spark, d), 5, ["read"], "raw", "i")


def event_stats(spark, d):
    s = samples(spark, d)
    jump = F.abs(F.col("raw") - F.lag("raw").over(windows.by_read())) > 5000
    cuts = s.withColumn("jump", jump).filter("jump").select("read", F.col("i").alias("at"))
    return windows.event_rows(cuts, s, "raw").select("read", "start", "length", F.round("mean", 6).alias("mean"), F.round("stdv", 6).alias("stdv"))


# References

def contig_complements(spark, d):
    return contigs(spark, d).select("ref_idx", bases.complement("seq").alias("complement"), bases.reverse_complement("seq").alias("reverse_complement"))


def kmer_ranks(spark, d):
    return bases.with_kmer_ranks(contigs(spark, d), "seq", K).select("ref_idx", F.posexplode("ranks").alias("i", "rank"))


def _levels(spark, d, **options) -> DataFrame:
    return reference.synthetic_references(contigs(spark, d), reference.model_from_rule(spark, K), K, **options)


def ref_levels(spark, d):
    return _levels(spark, d, normalise="none").select("ref_idx", "strand", "ref_len", "seq_len", F.posexplode("levels").alias("i", "level")).withColumn("level", F.col("level").cast("int"))


def ref_zscore(spark, d):
    z = arrays.zscore("levels", "double")
    return _levels(spark, d, normalise="none").select("ref_idx", "strand", F.posexplode(z).alias("i", "z")).withColumn("z", F.round("z", 6))


def rna_segment(spark, d):
    return _levels(spark, d, rna=True, query_size=40, normalise="none").select("ref_idx", "ref_len", "st_offset", F.posexplode("levels").alias("i", "level")).withColumn("level", F.col("level").cast("int"))


# Query windows

def _framed(spark, d, opt: MapOptions) -> DataFrame:
    event = lambda v, i: F.struct(i.cast("long").alias("start"), F.lit(1).cast("float").alias("length"), v.cast("float").alias("mean"), F.lit(0).cast("float").alias("stdv"))
    reads = signals(spark, d).select("read", F.transform("x", event).alias("events"), F.col("x").alias("raw_signal"))
    return mapping.with_query(reads, opt)


def query_window_start(spark, d):
    return _framed(spark, d, MapOptions(prefix=20, query=45)).select("read", "status", "q0", "q1")


def query_window_end(spark, d):
    return _framed(spark, d, MapOptions(prefix=10, query=55, from_end=True)).select("read", "status", "q0", "q1")


def read_status_counts(spark, d):
    return mapping.status_counts(_framed(spark, d, MapOptions(prefix=20, query=45)))


# Alignment

DTW_COLUMNS, DTW_CHUNK = 40, 12
DTW_LEVELS = [(j * 37) % 101 * 5 - 250 for j in range(DTW_COLUMNS)]


def _dtw(spark, d, subsequence: bool) -> DataFrame:
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000).cast("long"))
    vectors = table(spark, d, "embeddings").select("vec_id", x.alias("x"))
    vectors = spread(vectors)  # few rows, much work for each
    rows = dtw.with_last_row(vectors, "x", DTW_LEVELS, subsequence)
    return rows.select("vec_id", F.transform("row", lambda c: c.cast("long")).alias("row"))  # whole numbers below 2^24: exact


def dtw_cost_sub(spark, d):
    return _dtw(spark, d, True).select("vec_id", F.posexplode("row").alias("j", "cost"))


def dtw_cost_std(spark, d):
    return _dtw(spark, d, False).select("vec_id", F.posexplode("row").alias("j", "cost"))


def dtw_chunk_minima(spark, d):
    return _dtw(spark, d, True).select("vec_id", F.explode(arrays.chunk_minima("row", DTW_CHUNK)).alias("m")).select("vec_id", "m.score", "m.pos")


def dtw_best_hit(spark, d):
    hits = windows.top_hits(dtw_chunk_minima(spark, d), 2, ["vec_id"], "score", "pos")
    pair = hits.groupBy("vec_id").agg(F.min("score").alias("score"), F.max(F.when(F.col("rank") == 1, F.col("pos"))).alias("pos"), F.max("score").alias("score2"))
    return pair.select("vec_id", "score", "pos", "score2", text.mapping_quality(F.col("score").cast("double"), F.col("score2").cast("double")).alias("mapq"))


# Formats

def _paf_rows(spark, d) -> DataFrame:
    t = tested_paf(spark, d)
    n = F.col("o_orderkey")
    return t.select(
        "rid", (n % 5000 + 300).cast("int").alias("qlen"), (n % 50).cast("int").alias("query_start"), (n % 50 + 250).cast("int").alias("query_end"), "strand", "tid", F.lit(30000).alias("tlen"), F.col("target_start").cast("int").alias("target_start"),
        F.col("target_end").cast("int").alias("target_end"), (n % 240).cast("int").alias("n_residue"), F.lit(250).alias("block_len"), "mapq", "tp", (n % 400 / 4).cast("float").alias("d1"), (n % 800 / 4).cast("float").alias("d2"), F.lit(250).alias("n_events"),
    )


def paf_format(spark, d):
    return _paf_rows(spark, d).select(text.paf_line().alias("line"))


def sam_format(spark, d):
    return _paf_rows(spark, d).select(text.sam_line(F.lit("250,"), rna=True).alias("line"))


def paf_roundtrip(spark, d):
    return parse_paf(_paf_rows(spark, d).select(text.paf_line().alias("value"))).select("rid", "qlen", "strand", "tid", "target_start", "target_end", "mapq", "tp", F.col("d1").cast("double").alias("d1"))


# Signals through Arrow-batched helpers

def _reads(spark, d) -> DataFrame:
    """Signals as rows of the container; raw values are brought into the range of samples."""
    x = F.transform("x", lambda v: (v % 1000).cast("smallint"))
    fixed = {"read_id": F.concat(F.lit("u"), F.col("read")), "read_group": F.lit(0).cast("long"), "digitisation": F.lit(DIGITISATION), "offset": F.lit(OFFSET), "range": F.lit(RANGE), "sampling_rate": F.lit(4000.0), "len_raw_signal": F.size("x").cast("long"), "raw_signal": x}
    return signals(spark, d).select(*[c.alias(n) for n, c in fixed.items()], F.col("read").alias("user"), F.when(F.col("read") % 3 > 0, F.col("read") * 0.5).alias("median_before"))


def events_detect(spark, d):
    e = events.with_events(mapping.with_signal(_reads(spark, d)))
    rows = e.select("read_id", F.explode("events").alias("e"))
    return rows.select("read_id", "e.start", *[F.col(f"e.{c}").cast("double").alias(c) for c in ("length", "mean", "stdv")])


def adaptor_segments(spark, d):
    opt = segments.PlateauOptions(scale=0.1, seg_dist=3, window=6, most=1000, least=3)
    return segments.with_segments(_reads(spark, d), "raw_signal", options=opt).select("read_id", segments.segment_text("segments").alias("line"))


def band_segments(spark, d):
    opt = segments.BandOptions(corrector=5, seg_dist=4, window=8, stall_len=1.0, error=3)
    return segments.with_segments(_reads(spark, d), "raw_signal", kind="band", bottom=100.0, top=700.0, options=opt).select("read_id", segments.segment_text("segments").alias("line"))


def codec_roundtrip(spark, d):
    """Every signal packed and unpacked again by each codec."""

    def run(batches):
        for batch in batches:
            ok = []
            for x in batch.column(1):
                raw = x.values.to_numpy().astype("<i2")
                ok.append(all(codecs.decompress(codecs.compress(raw.tobytes(), c), c) == raw.tobytes() for c in ("none", "zlib", "zstd", "svb-zd")) and bool(np.array_equal(codecs.unpack_signal(codecs.pack_signal(raw)), raw)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_())], ["read_id", "raw_signal", "ok"])

    done = _reads(spark, d).select("read_id", "raw_signal").mapInArrow(run, "read_id string, raw_signal array<smallint>, ok boolean")
    total = F.aggregate("raw_signal", F.lit(0).cast("long"), lambda a, v: a + v)
    return done.select("read_id", F.size("raw_signal").alias("n"), total.alias("total"), "ok")


def _scratch(spark: SparkSession) -> str:
    return scratch(spark, "signals")


def _roundtrip(spark, d, kind: str) -> DataFrame:
    container.register(spark)
    path = _scratch(spark)
    source = _reads(spark, d).select(*READ.names, "user", "median_before")
    source.write.format("signal").mode("append").option("container", kind).option("attr.experiment_type", "genomic_dna").save(path)
    total = F.aggregate("raw_signal", F.lit(0).cast("long"), lambda a, v: a + v)
    return spark.read.format("signal").load(path).select("read_id", "len_raw_signal", total.alias("total"), "user", "median_before")


def container_binary(spark, d):
    return _roundtrip(spark, d, "binary")


def container_text(spark, d):
    return _roundtrip(spark, d, "text")


def with_steady_signal(rows: DataFrame, levels: str, out: str) -> DataFrame:
    """``rows`` with eight samples for each level, a little above and below it, in place of the levels."""
    around = (np.arange(8, dtype=np.float32) * 7) % 5 - 2
    kept = [f for f in rows.schema.fields if f.name != levels]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                column = batch.column(batch.schema.get_field_index(levels))
                raw = (column.flatten().to_numpy(zero_copy_only=False)[:, None] * np.float32(5) + around).astype(np.int16).ravel()
                ends = (column.offsets.to_numpy() - column.offsets[0].as_py()) * 8
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(raw))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), lists], [*(f.name for f in kept), out])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.ArrayType(T.ShortType()))]))


def map_paf(spark, d):
    """Documents as reads, mapped to the benchmark's items as contigs: the whole chain."""
    letters = lambda c: F.regexp_replace(F.upper(c), "[^ACGT]", "")
    model = reference.model_from_rule(spark, K)
    items = table(spark, d, "benchmark").select(F.col("item_id").cast("int").alias("ref_idx"), F.concat(F.lit("b"), F.col("item_id")).alias("name"), letters("text").alias("seq"))
    refs = reference.synthetic_references(items, model, K)
    docs = spread(table(spark, d, "documents").select(F.col("doc_id"), letters("text").alias("seq")))
    levels = reference.with_levels(docs, model, K, "seq", "l").filter(F.size("l") > 0)
    steady = with_steady_signal(levels.select("doc_id", "l"), "l", "raw_signal")
    reads = steady.select(F.concat(F.lit("d"), F.col("doc_id")).alias("read_id"), F.lit(1.0).alias("digitisation"), F.lit(0.0).alias("offset"), F.lit(0.2).alias("range"), "raw_signal")
    return mapping.map_reads(reads, refs, MapOptions(prefix=0, query=60)).drop("n_events")


FUNCTIONS = [
    paf_eval_summary, paf_eval_tid_only, paf_eval_primary_only, paf_eval_mapq_hist, paf_eval_only_in_test, paf_eval_outcomes, truth_dup_reads, batch_lookup, raw_to_pa, clamp_outliers, array_stats, array_prefix_sums,
    array_zscore, number_texts, mapping_qualities, prefix_sums, rolling_mean, tstat_short, tstat_long, window_zscore, global_zscore, chunk_argmin, top_hits, event_stats, contig_complements, kmer_ranks, ref_levels, ref_zscore,
    rna_segment, query_window_start, query_window_end, read_status_counts, dtw_cost_sub, dtw_cost_std, dtw_chunk_minima, dtw_best_hit, paf_format, sam_format, paf_roundtrip, events_detect, adaptor_segments,
    band_segments, codec_roundtrip, container_binary, container_text, map_paf,
]
QUERIES = {f.__name__: f for f in FUNCTIONS}


# Oracles

def _tstat_sql(w: int) -> str:
    return f"""WITH {SAMPLES},
s AS (SELECT *, count(*) OVER (PARTITION BY read) AS n,
             sum(raw) OVER b AS s1, sum(raw * raw) OVER b AS q1, sum(raw) OVER a AS s2, sum(raw * raw) OVER a AS q2 FROM samples
      WINDOW b AS (PARTITION BY read ORDER BY i ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), a AS (PARTITION BY read ORDER BY i ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)),
v AS (SELECT *, s1::DOUBLE / {w} AS m1, s2::DOUBLE / {w} AS m2 FROM s)
SELECT read, i, raw, CASE WHEN n >= {2 * w} AND i >= {w} AND i <= n - {w}
  THEN round(abs(m2 - m1) / sqrt(greatest(1.1754943508222875e-38, q1::DOUBLE / {w} - m1 * m1 + q2::DOUBLE / {w} - m2 * m2) / {w}), 6) ELSE 0.0::DOUBLE END AS tstat FROM v"""


_RANK = " + ".join(f"(greatest(instr('ACGT', substr({{s}}, {{i}} + {j}, 1)) - 1, 0)) * {4 ** (K - j)}" for j in range(1, K + 1))
_KMERS = f"""WITH {CONTIGS},
strands AS (SELECT ref_idx, '+' AS strand, seq FROM contigs UNION ALL SELECT ref_idx, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM contigs),
kmers AS (SELECT ref_idx, strand, length(seq) AS seq_len, length(seq) + 1 - {K} AS ref_len, CAST(i AS INT) AS i, CAST({_RANK.format(s="seq", i="i")} AS INT) AS rank
          FROM (SELECT *, unnest(range(0, length(seq) + 1 - {K})) AS i FROM strands WHERE length(seq) >= {K})),
levels AS (SELECT *, CAST(60 + (rank * 37) % 101 AS INT) AS level FROM kmers)"""


def _window_sql(framed: str) -> str:
    return f"WITH {SAMPLES}, n AS (SELECT read, CAST(count(*) AS INT) AS n FROM samples GROUP BY read), f AS ({framed}) "


_START = "SELECT read, n, CASE WHEN n = 0 THEN 'no_signal' WHEN 20 + 25 > n THEN 'ignored' WHEN 65 > n THEN 'too_short' ELSE 'ok' END AS status, 20 AS q0, CAST(least(65, n) AS INT) AS q1 FROM n"
_END = "SELECT read, n, CASE WHEN n = 0 THEN 'no_signal' WHEN n - 10 <= 0 THEN 'ignored' WHEN n - 65 < 0 THEN 'too_short' ELSE 'ok' END AS status, CAST(greatest(n - 65, 0) AS INT) AS q0, CAST(n - 10 AS INT) AS q1 FROM n"


def _dtw_sql(subsequence: bool) -> str:
    first = "abs(x[1] - y[j + 1])" if subsequence else "list_sum(list_transform(range(0, j + 1), lambda k: abs(x[1] - y[k + 1])))"
    return f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(e::DOUBLE * 1000) AS BIGINT)) AS x, list_transform(range(0, {DTW_COLUMNS}), lambda j: CAST((j * 37) % 101 * 5 - 250 AS BIGINT)) AS y FROM embeddings),
r AS (SELECT vec_id, x, y, 1 AS i, list_transform(range(0, {DTW_COLUMNS}), lambda j: CAST({first} AS BIGINT)) AS cost FROM v
      UNION ALL
      SELECT vec_id, x, y, i + 1, list_reduce(list_transform(range(1, {DTW_COLUMNS}), lambda j: [CAST(j AS BIGINT)]), lambda a, j: list_append(a, abs(x[i + 1] - y[j[1] + 1]) + least(cost[j[1] + 1], cost[j[1]], a[-1])), [abs(x[i + 1] - y[1]) + cost[1]])
      FROM r WHERE i < len(x)),
last AS (SELECT vec_id, cost FROM r WHERE i = len(x)),
cells AS (SELECT vec_id, CAST(j AS INT) AS j, cost[j + 1] AS cost FROM (SELECT *, unnest(range(0, {DTW_COLUMNS})) AS j FROM last)),
minima AS (SELECT vec_id, min(cost) AS score, CAST(arg_min(j, cost * 1000 + j) AS INT) AS pos FROM cells GROUP BY vec_id, j // {DTW_CHUNK})"""


_MAPQ = "CASE WHEN {s} = 0 AND {t} > 0 THEN 60 WHEN {s} = 0 THEN 0 ELSE CAST(least(60, round(500.0::DOUBLE * ({t} - {s}) / {s})) AS INT) END"
_FIELDS = """'r' || (o_orderkey + 100) AS rid, CAST(o_orderkey % 5000 + 300 AS INT) AS qlen, CAST(o_orderkey % 50 AS INT) AS query_start, CAST(o_orderkey % 50 + 250 AS INT) AS query_end,
CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 't' || (o_custkey % 7) AS tid, CAST(o_custkey AS INT) AS target_start, CAST(o_custkey + 250 AS INT) AS target_end, CAST(o_orderkey % 240 AS INT) AS n_residue,
CAST(o_custkey % 61 AS INT) AS mapq, 'P' AS tp, (o_orderkey % 400)::DOUBLE / 4 AS d1, (o_orderkey % 800)::DOUBLE / 4 AS d2"""
_READS = SIGNALS + ", reads AS (SELECT 'u' || read AS read_id, read, list_transform(x, lambda v: v % 1000) AS x FROM signals)"

ORACLE = {
    "paf_eval_summary": f"WITH {_classified(_NEAR)} {_SUMMARY}",
    "paf_eval_tid_only": f"WITH {_classified('')} {_SUMMARY}",
    "paf_eval_primary_only": f"WITH {_classified(_NEAR + ' AND s.tp = t.tp')} {_SUMMARY}",
    "paf_eval_mapq_hist": f"WITH {_classified(_NEAR)} SELECT mapq, count(*) FILTER (outcome = 'correct') AS n_correct, count(*) FILTER (outcome = 'incorrect') AS n_incorrect FROM outcome WHERE outcome <> 'only_in_test' GROUP BY mapq",
    "paf_eval_only_in_test": f"WITH {PAFS} SELECT rid, mapq FROM tested WHERE rid NOT IN (SELECT rid FROM truth)",
    "paf_eval_outcomes": f"WITH {_classified(_NEAR)} SELECT o_orderkey, rid, outcome FROM outcome",
    "truth_dup_reads": f"WITH {PAFS} SELECT rid, count(*) AS n FROM truth GROUP BY rid HAVING count(*) > 1",
    "batch_lookup": f"WITH {SAMPLES}, r AS (SELECT read, count(*) AS n, CAST(sum(raw) AS BIGINT) AS total FROM samples GROUP BY read) SELECT c_custkey AS read, r.n IS NOT NULL AS found, n, total FROM customer LEFT JOIN r ON r.read = c_custkey",
    "raw_to_pa": f"WITH {SAMPLES} SELECT read, CAST(i AS INT) AS i, CAST((raw::FLOAT + {OFFSET}::FLOAT) * ({RANGE}::FLOAT / {DIGITISATION}::FLOAT) AS DOUBLE) AS pa FROM samples",
    "clamp_outliers": f"WITH {SAMPLES} SELECT read, CAST(i AS INT) AS i, greatest(0, least(1200, raw)) AS v FROM samples",
    "array_stats": f"""WITH {SIGNALS}, s AS (SELECT read, x, list_sort(x) AS o, len(x) AS n, list_sum(x)::DOUBLE / len(x) AS m FROM signals),
t AS (SELECT *, o[n // 2 + 1] AS med FROM s)
SELECT read, round(m, 6) AS mean, round(sqrt(list_sum(list_transform(x, lambda v: (v - m) * (v - m))) / n), 6) AS stdv, med AS median, o[3] AS third,
       round(list_sort(list_transform(x, lambda v: abs(v - med)))[n // 2 + 1] * 1.4826::DOUBLE, 6) AS mad,
       round(o[CAST(floor(0.1::DOUBLE * (n - 1)) AS INT) + 1] + (o[least(CAST(floor(0.1::DOUBLE * (n - 1)) AS INT) + 2, n)] - o[CAST(floor(0.1::DOUBLE * (n - 1)) AS INT) + 1]) * (0.1::DOUBLE * (n - 1) - floor(0.1::DOUBLE * (n - 1))), 6) AS q10,
       round(o[CAST(floor(0.75::DOUBLE * (n - 1)) AS INT) + 1] + (o[least(CAST(floor(0.75::DOUBLE * (n - 1)) AS INT) + 2, n)] - o[CAST(floor(0.75::DOUBLE * (n - 1)) AS INT) + 1]) * (0.75::DOUBLE * (n - 1) - floor(0.75::DOUBLE * (n - 1))), 6) AS q75 FROM t""",
    "array_prefix_sums": f"WITH {SIGNALS} SELECT read, CAST(i AS INT) AS i, CAST(coalesce(list_sum(x[1:i]), 0) AS DOUBLE) AS total FROM (SELECT *, unnest(range(0, len(x) + 1)) AS i FROM signals)",
    "array_zscore": f"WITH {SAMPLES} SELECT read, CAST(i AS INT) AS i, CASE WHEN stddev_pop(raw) OVER w > 0 THEN round((raw - avg(raw) OVER w) / stddev_pop(raw) OVER w, 6) END AS z FROM samples WINDOW w AS (PARTITION BY read)",
    "number_texts": """SELECT event_id, CASE WHEN value IS NULL THEN '.' WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.6f', value), '\\.?0+$', '') END AS value_text,
CASE WHEN event_id % 2 = 0 THEN CAST(event_id // 2 AS VARCHAR) ELSE CAST(event_id // 2 AS VARCHAR) || '.5' END AS half_text FROM events""",
    "mapping_qualities": f"SELECT o_orderkey, {_MAPQ.format(s='o_custkey', t='(o_custkey + o_orderkey % 40)')} AS mapq FROM orders",
    "prefix_sums": f"WITH {SAMPLES} SELECT read, i, raw, CAST(coalesce(sum(raw) OVER w, 0) AS BIGINT) AS sum, CAST(coalesce(sum(raw * raw) OVER w, 0) AS BIGINT) AS sumsq FROM samples WINDOW w AS (PARTITION BY read ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "rolling_mean": f"WITH {SAMPLES}, s AS (SELECT *, count(*) OVER (PARTITION BY read) AS n, sum(raw) OVER (PARTITION BY read ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)::DOUBLE / 5 AS mean FROM samples) SELECT read, i, raw, mean FROM s WHERE i < n - 5",
    "tstat_short": _tstat_sql(3),
    "tstat_long": _tstat_sql(6),
    "window_zscore": f"""WITH {SAMPLES}, s AS (SELECT *, count(*) OVER w AS n, sum(raw) OVER w AS s, sum(raw * raw) OVER w AS q FROM samples WINDOW w AS (PARTITION BY read)),
v AS (SELECT *, (q * n - s * s)::DOUBLE / (n * n)::DOUBLE AS var FROM s) SELECT read, i, raw, CASE WHEN var > 0 THEN round((raw - s::DOUBLE / n) / sqrt(var), 6) END AS z FROM v""",
    "global_zscore": f"WITH {SAMPLES} SELECT read, i, raw, round((raw - avg(raw) OVER ()) / stddev_pop(raw) OVER (), 6) AS z FROM samples",
    "chunk_argmin": f"WITH {SAMPLES} SELECT read, CAST(i // 10 AS INT) AS chunk, min(raw) AS raw, arg_min(i, raw * 10000 + i) AS i FROM samples GROUP BY read, i // 10",
    "top_hits": f"WITH {SAMPLES} SELECT * FROM (SELECT read, i, raw, CAST(row_number() OVER (PARTITION BY read ORDER BY raw, i DESC) AS INT) AS rank FROM samples) WHERE rank <= 5",
    "event_stats": f"""WITH {SAMPLES}, j AS (SELECT *, i = 0 OR abs(raw - lag(raw) OVER (PARTITION BY read ORDER BY i)) > 5000 AS cut FROM samples),
g AS (SELECT *, sum(cut::INT) OVER (PARTITION BY read ORDER BY i) AS e FROM j)
SELECT read, min(i) AS start, count(*) AS length, round(sum(raw)::DOUBLE / count(*), 6) AS mean,
       round(sqrt(greatest(0.0::DOUBLE, sum(raw * raw)::DOUBLE / count(*) - (sum(raw)::DOUBLE / count(*)) * (sum(raw)::DOUBLE / count(*)))), 6) AS stdv FROM g GROUP BY read, e""",
    "contig_complements": f"WITH {CONTIGS} SELECT ref_idx, translate(seq, 'ACGT', 'TGCA') AS complement, reverse(translate(seq, 'ACGT', 'TGCA')) AS reverse_complement FROM contigs",
    "kmer_ranks": _KMERS + " SELECT ref_idx, i, rank FROM kmers WHERE strand = '+'",
    "ref_levels": _KMERS + " SELECT ref_idx, strand, CAST(ref_len AS INT) AS ref_len, CAST(seq_len AS INT) AS seq_len, i, level FROM levels",
    "ref_zscore": _KMERS + " SELECT ref_idx, strand, i, CASE WHEN stddev_pop(level) OVER w > 0 THEN round((level - avg(level) OVER w) / stddev_pop(level) OVER w, 6) END AS z FROM levels WINDOW w AS (PARTITION BY ref_idx, strand)",
    "rna_segment": _KMERS + " SELECT ref_idx, CAST(least(60, ref_len) AS INT) AS ref_len, CAST(ref_len - least(60, ref_len) AS INT) AS st_offset, CAST(i - (ref_len - least(60, ref_len)) AS INT) AS i, level FROM levels WHERE strand = '+' AND i >= ref_len - least(60, ref_len)",
    "query_window_start": _window_sql(_START) + "SELECT read, status, q0, q1 FROM f",
    "query_window_end": _window_sql(_END) + "SELECT read, status, q0, q1 FROM f",
    "read_status_counts": _window_sql(_START) + "SELECT status, count(*) AS reads, CAST(sum(n) AS BIGINT) AS samples FROM f GROUP BY status",
    "dtw_cost_sub": _dtw_sql(True) + " SELECT vec_id, j, cost FROM cells",
    "dtw_cost_std": _dtw_sql(False) + " SELECT vec_id, j, cost FROM cells",
    "dtw_chunk_minima": _dtw_sql(True) + " SELECT vec_id, score, pos FROM minima",
    "dtw_best_hit": _dtw_sql(True) + f""", k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score, pos DESC) AS rank FROM minima)
SELECT a.vec_id, a.score, a.pos, b.score AS score2, {_MAPQ.format(s='a.score', t='b.score')} AS mapq FROM k a JOIN k b ON a.vec_id = b.vec_id AND a.rank = 1 AND b.rank = 2""",
    "paf_format": f"""WITH p AS (SELECT {_FIELDS} FROM orders)
SELECT concat_ws(chr(9), rid, qlen, query_start, query_end, strand, tid, 30000, target_start, target_end, n_residue, 250, mapq, 'tp:A:' || tp, printf('d1:f:%.2f', d1), printf('d2:f:%.2f', d2)) AS line FROM p""",
    "sam_format": f"""WITH p AS (SELECT {_FIELDS} FROM orders)
SELECT concat_ws(chr(9), rid, CASE WHEN strand = '+' THEN '0' ELSE '16' END, tid, target_start + 1, mapq, '249M', '*', '0', '0', '*', '*', 'si:Z:' || concat_ws(',', query_start, query_end, target_end, target_start), 'ss:Z:250,') AS line FROM p""",
    "paf_roundtrip": f"WITH p AS (SELECT {_FIELDS} FROM orders) SELECT rid, qlen, strand, tid, target_start, target_end, mapq, tp, d1 FROM p",
    "codec_roundtrip": f"WITH {_READS} SELECT read_id, CAST(len(x) AS INT) AS n, CAST(list_sum(x) AS BIGINT) AS total, true AS ok FROM reads",
    "container_binary": f"WITH {_READS} SELECT read_id, len(x) AS len_raw_signal, CAST(list_sum(x) AS BIGINT) AS total, read AS user, CASE WHEN read % 3 > 0 THEN read * 0.5::DOUBLE END AS median_before FROM reads",
}
ORACLE["container_text"] = ORACLE["container_binary"]
