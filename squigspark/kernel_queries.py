"""More queries of the driver contract: the code that the mapper and the container run, over the driver's tables.

Same derived inputs as in ``queries``; SQL states the same rules step by step.
"""

from __future__ import annotations

import posixpath

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import queries as base
from .functions import arrays, bases, text
from .operators import dtw, evaluate, events, mapping, reference, segments
from .options import MapOptions, is_rna, model_choice, pore_of
from .plans.jobs import convert_job, detect_options, map_job
from .queries import DIGITISATION, OFFSET, RANGE, table
from .schemas import READ
from .scratch import spread
from .sources import container
from .sources.tables import read_bed, read_fasta, read_fasta_parts, read_kmer_model


def _total(column: str):
    return F.aggregate(column, F.lit(0).cast("long"), lambda a, v: a + v)


# Containers

def _written(spark, d, kind: str = "binary", **options: str) -> str:
    container.register(spark)
    path = base._scratch(spark)
    source = base._reads(spark, d).select(*READ.names, "user")
    source.write.format("signal").mode("append").options(container=kind, **options).save(path)
    return path


def _summed(reads: DataFrame) -> DataFrame:
    return reads.select("read_id", "len_raw_signal", _total("raw_signal").alias("total"), "user")


def container_fetch(spark, d):
    """Records of a list of ids (the customers'), read by place from the index of a container."""
    path = _written(spark, d)
    ids = table(spark, d, "customer").select(F.concat(F.lit("u"), F.col("c_custkey")).alias("read_id")).distinct()
    index = container.record_index(spark, path).join(ids, "read_id", "left_semi")
    return _summed(container.fetch(index, spark.read.format("signal").load(path).schema))


def container_ids(spark, d):
    """All read ids of a container, from its index; ids that are held twice would be counted."""
    return container.record_index(spark, _written(spark, d)).groupBy("read_id").agg(F.count("*").alias("records"))


def container_split(spark, d):
    """A scan cut at the places that index files name."""
    path = _written(spark, d)
    container.write_index_files(spark, path).count()
    return _summed(spark.read.format("signal").option("split_bytes", "600").load(path))


def container_convert(spark, d):
    """Text to binary, records and header attributes alike."""
    path, out = _written(spark, d, "text", **{"attr.run": "r1"}), base._scratch(spark)
    convert_job(spark, path, out, "binary", record_press="zstd")
    return _summed(spark.read.format("signal").load(out))


def container_pruned(spark, d):
    """Two columns only, and one read only: no other column or record is decoded."""
    path = _written(spark, d)
    return spark.read.format("signal").option("columns", "read_id,user").load(path).filter("read_id = 'u1'")


def container_attributes(spark, d):
    """Header attributes by read group: one group for each region, every other one without a kit."""
    names = [r["r_name"] for r in table(spark, d, "region").orderBy("r_regionkey").collect()]
    given = {"attr.run": "\t".join(names), "attr.kit": "\t".join(n if i % 2 == 0 else "" for i, n in enumerate(names))}
    groups = container.read_groups(spark, _written(spark, d, **given))
    return groups.select("read_group", F.explode("attrs").alias("name", "value")).distinct()


def container_columns(spark, d):
    """Files with different columns in one folder: each file's columns are there, null where a file lacks them."""
    container.register(spark)
    path, reads = base._scratch(spark), base._reads(spark, d)
    even, half = F.col("user") % 2 == 0, F.col("median_before").alias("half")
    for kind, rows in (("text", reads.filter(even).select(*READ.names, "user")), ("binary", reads.filter(~even).select(*READ.names, half, "user")), ("binary", reads.filter(~even).select(*READ.names, F.concat(F.lit("n"), "user").alias("name")))):
        rows.write.format("signal").mode("append").option("container", kind).save(path)
    return container.read_signal(spark, path).select("read_id", "len_raw_signal", "user", "half", "name")


def container_copied(spark, d):
    """Records moved undecoded: a list of ids (the customers'), dealt to three files, packed by another codec."""
    path, out = _written(spark, d), base._scratch(spark)
    ids = table(spark, d, "customer").select(F.concat(F.lit("u"), F.col("c_custkey")).alias("read_id"))
    container.copy_records(spark, path, out, ids=ids, files=3, record_press="zstd")
    return _summed(spark.read.format("signal").load(out))


def container_blocks(spark, d):
    """A scan cut at the blocks that the writers' own index names."""
    return _summed(spark.read.format("signal").option("split_bytes", str(1 << 27)).load(_written(spark, d, block_bytes="2000")))


def container_lookup(spark, d):
    """Records of some ids: files and blocks that can't hold them are not opened."""
    path = _written(spark, d, block_bytes="2000")
    return _summed(spark.read.format("signal").load(path).filter(F.col("read_id").isin("u1", "u17", "u33", "none")))


def container_header(spark, d):
    """Header attributes set, replaced and extended to more read groups while records are moved undecoded."""
    names = [r["r_name"] for r in table(spark, d, "region").orderBy("r_regionkey").collect()]
    out = base._scratch(spark)
    container.copy_records(spark, _written(spark, d, **{"attr.run": "r1\tr2", "attr.kit": "k"}), out, kit="new", site="\t".join(names))
    return container.read_groups(spark, out).select("read_group", F.explode("attrs").alias("name", "value")).distinct()


_SCALARS = {"int8_t": "tinyint", "int16_t": "smallint", "int32_t": "int", "int64_t": "bigint", "uint8_t": "smallint", "uint16_t": "int", "uint32_t": "bigint", "uint64_t": "decimal(20,0)", "float": "float", "double": "double"}


def container_types(spark, d):
    """Every auxiliary type, single and as an array, written and read again."""
    container.register(spark)
    path = base._scratch(spark)
    value = F.when(F.col("user") % 4 > 0, F.col("user") % 100)
    columns = []
    for kind, cast in _SCALARS.items():
        columns.append(value.cast(cast).alias(f"one_{kind}", metadata={"kind": kind}))
        columns.append(F.array(value, F.col("user") % 50).cast(f"array<{cast}>").alias(f"all_{kind}", metadata={"kind": kind + "*"}))
    columns.append(F.when(F.col("user") % 4 > 0, F.substring("read_id", 2, 1)).alias("one_char", metadata={"kind": "char"}))
    columns.append(F.when(F.col("user") % 4 > 0, F.col("read_id")).alias("all_char", metadata={"kind": "char*"}))
    columns.append((F.col("user") % 3).cast("smallint").alias("one_enum", metadata={"kind": "enum{low,mid,high}"}))
    source = base._reads(spark, d).select(*READ.names, "user", *columns)
    source.write.format("signal").mode("append").option("container", "binary").save(path)
    back = spark.read.format("signal").load(path)
    labels = F.array(*[F.lit(x) for x in back.schema["one_enum"].metadata["labels"]])
    numbers = [F.col(f"one_{k}").cast("double").alias(f"one_{k}") for k in _SCALARS]
    sums = [F.aggregate(f"all_{k}", F.lit(0.0), lambda a, v: a + F.coalesce(v.cast("double"), F.lit(1000.0))).alias(f"all_{k}") for k in _SCALARS]
    return back.select("user", *numbers, *sums, "one_char", "all_char", F.get(labels, F.col("one_enum")).alias("one_enum"))


# Text sources

def fasta_records(spark, d):
    path = base._scratch(spark)
    line = F.concat(F.lit(">"), F.col("name"), F.lit(" of a document\n"), F.substring("seq", 1, 20), F.lit("\n"), F.substring("seq", 21, 1 << 30))
    base.contigs(spark, d).select(line.alias("value")).write.text(path)
    return read_fasta(spark, path).select("name", "comment", "seq")


def fasta_parts(spark, d):
    """Contigs read by byte ranges, in parts of 500 bases, put together by the places that the parts say they begin at."""
    path = base._scratch(spark)
    lines = F.array_join(F.regexp_extract_all("seq", F.lit("(.{1,60})"), F.lit(1)), "\n")
    rows = base.contigs(spark, d).select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), lines).alias("value"))
    rows.write.text(path)
    parts = read_fasta_parts(spark, path, 500)
    sizes = parts.groupBy("name").agg(F.sum(F.length("seq")).alias("bases"), F.sum(F.length(F.regexp_replace("seq", "[^G]", ""))).alias("g"), F.array_sort(F.collect_list(F.struct("start", "seq"))).alias("p"))
    return sizes.select("name", "bases", "g", F.md5(F.concat_ws("", F.transform("p", lambda p: p["seq"]))).alias("digest"))


def kmer_model_file(spark, d):
    """A model file and its reading; a k-mer's level counts the parts that fall to its rank."""
    path = base._scratch(spark)
    parts = table(spark, d, "part").groupBy((F.col("p_partkey") % 4**base.K).cast("int").alias("rank")).agg(F.count("*").alias("n"))
    model = reference.model_from_rule(spark, base.K).join(parts, "rank", "left")
    level = F.col("level_mean").cast("double") + F.coalesce("n", F.lit(0)) * 0.25
    rows = model.select(F.concat_ws("\t", "kmer", F.format_string("%.2f", level), F.format_string("%.2f", "level_stdv")).alias("value"), "rank")
    head = spark.createDataFrame([(f"#k\t{base.K}", -2), ("kmer\tlevel_mean\tlevel_stdv", -1)], "value string, rank int")
    head.unionByName(rows).repartition(1).sortWithinPartitions("rank").select("value").write.text(path)
    return read_kmer_model(spark, path).select("rank", "kmer", F.col("level_mean").cast("double").alias("level_mean"), F.col("level_stdv").cast("double").alias("level_stdv"))


def bed_regions(spark, d):
    path = base._scratch(spark)
    begin = F.col("l_partkey") + F.col("l_linenumber") * 1000
    rows = table(spark, d, "lineitem").select(F.concat_ws("\t", F.concat(F.lit("t"), F.col("l_suppkey")), begin, begin + F.col("l_quantity").cast("int")).alias("value"))
    rows.write.text(path)
    return read_bed(spark, path)


def sam_header_lines(spark, d):
    items = base.contigs(spark, d).filter("length(seq) >= 5").select("ref_idx", "name", (F.length("seq") + 1 - base.K).alias("ref_len"))
    return text.sam_header(items)


def eval_report(spark, d):
    a, b = base.truth_paf(spark, d), base.tested_paf(spark, d)
    return evaluate.report_lines(evaluate.summary(a, b), evaluate.mapq_histogram(a, b)).select("place", "value")


def numbers_from_text(spark, d):
    o = table(spark, d, "orders")
    whole = F.when(F.col("o_orderkey") % 5 == 0, ".").otherwise((F.col("o_orderkey") - 100).cast("string"))
    part = F.when(F.col("o_orderkey") % 7 == 0, ".").otherwise(F.format_string("%.2f", "o_totalprice"))
    return o.select("o_orderkey", text.checked_integer(whole).alias("whole"), text.checked_float(part).alias("part"))


# Functions

def base_functions(spark, d):
    """Ranks of all letters of a text, summed; of its 6-letter stretches, end to end, the greatest; its letters replaced."""
    return table(spark, d, "documents").select(
        "doc_id", bases.rank_sum("text").alias("ranks"), bases.greatest_kmer_rank("text", 6).alias("greatest"), F.length(bases.replace_char("text", "e", "E")).alias("n"),
        bases.replace_char("text", "e", "E").alias("replaced"), bases.kmer_count((F.col("doc_id") % 12).cast("int")).alias("kmers"),
    )


def small_functions(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 97).alias("a"), (F.col("o_orderkey") % 89).alias("b"), "o_custkey")
    version = F.concat_ws(".", F.col("a") % 3, F.col("b") % 5, F.col("o_orderkey") % 7)
    name = F.concat(F.when(F.col("a") % 2 == 0, "x_").otherwise("1"), F.col("b"))
    return o.select(
        "o_orderkey", arrays.distance("a", "b").alias("distance"), arrays.distance("a", "b", squared=True).alias("squared"), arrays.least_of_three("a", "b", "o_custkey").alias("least"), arrays.in_band("a", "b", F.lit(97), F.lit(89), 10).alias("near"),
        text.version_at_least(version, (1, 2, 3)).alias("recent"), text.is_identifier(name).alias("named"),
    )


def experiment_kinds(spark, d):
    """Experiment type and pore as headers would give them."""
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("rna", "genomic_dna", "RNA", "")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    kits = F.element_at(F.array(*[F.lit(x) for x in ("sqk-lsk109", "SQK-LSK114", "sqk-rna004", "sqk-rna002", "")]), (F.col("o_custkey") % 5 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", is_rna(kinds).alias("rna"), pore_of(kits).alias("pore"))


def model_choices(spark, d):
    """The model table for every pair of kit and experiment type that headers would give; null where there is none."""
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("rna", "genomic_dna")]), (F.col("o_orderkey") % 2 + 1).cast("int"))
    kits = F.element_at(F.array(*[F.lit(x) for x in ("sqk-lsk109", "SQK-LSK114", "sqk-rna004")]), (F.col("o_custkey") % 3 + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", is_rna(kinds).alias("rna"), pore_of(kits).alias("pore"))
    return rows.select("o_orderkey", "rna", "pore", model_choice("pore", "rna").alias("model"))


# References and alignment

def ref_zscore_global(spark, d):
    """Levels scored over all contigs and strands together."""
    levels = base._levels(spark, d, normalise="global").select("ref_idx", "strand", F.posexplode("levels").alias("i", "z"))
    return levels.withColumn("z", F.round(F.col("z").cast("double"), 3))


def ref_tiles(spark, d):
    """Levels made from contigs in parts of 40 letters, both strands, at their columns."""
    cut = F.posexplode(F.regexp_extract_all("seq", F.lit("(.{1,40})"), F.lit(1))).alias("part", "letters")
    parts = base.contigs(spark, d).select("ref_idx", "name", cut).select("ref_idx", "name", "part", (F.col("part") * 40).alias("start"), F.col("letters").alias("seq"))
    tiles = reference.tiles_of_parts(parts, reference.model_from_rule(spark, base.K), base.K, normalise="none")
    rows = tiles.select("ref_idx", "strand", "ref_len", "seq_len", "column", F.posexplode("levels").alias("at", "level"))
    return rows.select("ref_idx", "strand", "ref_len", "seq_len", (F.col("column") + F.col("at")).alias("i"), F.col("level").cast("int").alias("level"))


def ref_inverted(spark, d):
    levels = base._levels(spark, d, rna=True, full=True, invert=True, normalise="none")
    return levels.select("ref_idx", F.posexplode("levels").alias("i", "level")).withColumn("level", F.col("level").cast("int"))


def query_reversed(spark, d):
    """The z-scored query of RNA runs against the reference's direction."""
    framed = base._framed(spark, d, MapOptions(rna=True, prefix=5, query=30))
    return framed.filter("query is not null").select("read", F.posexplode("query").alias("i", "z")).select("read", "i", F.round(F.col("z").cast("double"), 3).alias("z"))


def _vectors(spark, d) -> DataFrame:
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000).cast("float"))
    return spread(table(spark, d, "embeddings").select("vec_id", x.alias("query")))


MAP_COLUMNS = 150


def _made_references(spark, strands: tuple[str, ...]) -> DataFrame:
    """Two contigs whose levels follow a rule; the other strand has them backwards."""
    rows = []
    for ref, (times, add) in enumerate([(37, 250), (53, 240)]):
        levels = [float((j * times) % 101 * 5 - add) for j in range(MAP_COLUMNS)]
        rows += [(ref, f"c{ref}", MAP_COLUMNS, MAP_COLUMNS + 4, 7 * ref, s, levels if s == "+" else levels[::-1]) for s in strands]
    kind = T.StructType.fromDDL("ref_idx int, name string, ref_len int, seq_len int, st_offset int, strand string, levels array<float>")
    return spark.createDataFrame(rows, kind)


def map_candidates(spark, d):
    """The mapper's candidates for vectors as queries: chunk minima over all references and strands, the five best."""
    found = mapping.with_candidates(_vectors(spark, d), _made_references(spark, ("+", "-")), MapOptions())
    rows = found.select("vec_id", F.posexplode("candidates").alias("place", "c"))
    return rows.select("vec_id", "place", F.col("c.score").cast("long").alias("score"), "c.ref_idx", "c.strand", "c.pos_end", "c.pos_st")


def map_candidates_tiled(spark, d):
    """The same with references cut into tiles, each of which is a pass of its own."""
    found = mapping.with_candidates(_vectors(spark, d), _made_references(spark, ("+", "-")), MapOptions(tile_columns=47, reference_bytes=400))
    rows = found.select("vec_id", F.posexplode("candidates").alias("place", "c"))
    return rows.select("vec_id", "place", F.col("c.score").cast("long").alias("score"), "c.ref_idx", "c.strand", "c.pos_end", "c.pos_st")


def map_candidates_std(spark, d):
    """The same by standard alignment: one candidate for each reference."""
    found = mapping.with_candidates(_vectors(spark, d), _made_references(spark, ("+",)), MapOptions(rna=True, standard=True))
    rows = found.select("vec_id", F.posexplode("candidates").alias("place", "c"))
    return rows.select("vec_id", "place", F.col("c.score").cast("long").alias("score"), "c.ref_idx")


def map_rows(spark, d):
    """Candidates to mapping rows: strands lifted over, offsets, quality from the two best, residues; and their lines."""
    found = mapping.with_candidates(_vectors(spark, d), _made_references(spark, ("+", "-")), MapOptions())
    begin = (F.col("vec_id") % 50).cast("int")
    spans = found.withColumns({"read_id": F.concat(F.lit("v"), F.col("vec_id")), "qlen": F.lit(900), "q0": F.lit(0), "q1": F.size("query"), "query_start": begin, "query_end": begin + 640})
    rows = mapping.mapped_rows(spans).select(*mapping.PAF_COLUMNS)
    return rows.select(*[F.col(c).cast("double").alias(c) if c in ("d1", "d2") else F.col(c) for c in mapping.PAF_COLUMNS], text.paf_line().alias("line"))


def map_job_lines(spark, d):
    """The whole job from files to files: documents as reads of a container, items as a FASTA file, a model file; mapping lines and what was counted."""
    folder, k = base._scratch(spark), 6
    letters = lambda c: F.regexp_replace(F.upper(c), "[^ACGT]", "")
    items = table(spark, d, "benchmark").select(F.concat(F.lit(">b"), F.col("item_id"), F.lit("\n"), letters("text")).alias("value"))
    items.write.text(f"{folder}/contigs")
    model = reference.model_from_rule(spark, k)
    lines = model.select(F.concat_ws("\t", "kmer", F.format_string("%.2f", "level_mean"), F.format_string("%.2f", "level_stdv")).alias("value"), "rank")
    head = spark.createDataFrame([(f"#k\t{k}", -1)], "value string, rank int")
    head.unionByName(lines).repartition(1).sortWithinPartitions("rank").select("value").write.text(f"{folder}/model")
    docs = spread(table(spark, d, "documents").select("doc_id", letters("text").alias("seq")))
    levels = reference.with_levels(docs, model, k, "seq", "l").filter(F.size("l") > 0)
    steady = base.with_steady_signal(levels.select("doc_id", "l"), "l", "raw_signal")
    fixed = {"read_id": F.concat(F.lit("d"), F.col("doc_id")), "read_group": F.lit(0).cast("long"), "digitisation": F.lit(1.0), "offset": F.lit(0.0), "range": F.lit(0.2), "sampling_rate": F.lit(4000.0), "len_raw_signal": F.size("raw_signal").cast("long"), "raw_signal": F.col("raw_signal")}
    container.register(spark)
    steady.select(*[c.alias(n) for n, c in fixed.items()]).write.format("signal").mode("append").option("attr.experiment_type", "genomic_dna").save(f"{folder}/reads")
    opt = detect_options(spark, f"{folder}/reads", prefix=0, query=60)
    seen = map_job(spark, f"{folder}/contigs", f"{folder}/reads", f"{folder}/model", f"{folder}/out", opt)
    return spark.read.text(f"{folder}/out").select("value", F.lit(seen["reads"]).alias("reads"), F.lit(seen["ignored"]).alias("ignored"))


def warp_paths(spark, d):
    return dtw.with_path(_vectors(spark, d), "query", base.DTW_LEVELS).select("vec_id", F.explode("path").alias("p")).select("vec_id", "p.i", "p.j")


def warp_paths_std(spark, d):
    return dtw.with_path(_vectors(spark, d), "query", base.DTW_LEVELS, subsequence=False).select("vec_id", F.explode("path").alias("p")).select("vec_id", "p.i", "p.j")


def signal_strings(spark, d, rna: bool = False):
    """How the samples of a query map to the reference's bases; every event is ten samples long."""

    def run(batches):
        import numpy as np

        for batch in batches:
            lines = []
            for path in batch.column(1).to_pylist():
                spans = dtw.base_map([(p["i"], p["j"]) for p in path])
                n = path[-1]["i"] + 1
                lines.append(dtw.signal_string(spans, np.arange(n) * 10, np.full(n, 10), 0, rna))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string())], ["vec_id", "ss"])

    paths = dtw.with_path(_vectors(spark, d), "query", base.DTW_LEVELS).select("vec_id", "path")
    return paths.mapInArrow(run, "vec_id long, ss string")


def signal_strings_rna(spark, d):
    """The same for RNA, whose queries are reversed: samples and bases are described from the read's start."""
    return signal_strings(spark, d, rna=True)


def events_detect_rna(spark, d):
    """Events by the detectors' settings for RNA."""
    e = events.with_events(mapping.with_signal(base._reads(spark, d)), opt=events.RNA).select("read_id", F.explode("events").alias("e"))
    return e.select("read_id", "e.start", *[F.col(f"e.{c}").cast("double").alias(c) for c in ("length", "mean", "stdv")])


FUNCTIONS = [
    container_fetch, container_ids, container_split, container_convert, container_pruned, container_attributes, container_columns, container_copied, container_blocks, container_lookup, container_header, container_types, fasta_records, fasta_parts, kmer_model_file, bed_regions, sam_header_lines, eval_report, numbers_from_text,
    base_functions, small_functions, experiment_kinds, model_choices, ref_zscore_global, ref_tiles, ref_inverted, query_reversed, map_candidates, map_candidates_tiled, map_candidates_std, map_rows, map_job_lines, warp_paths, warp_paths_std, signal_strings, signal_strings_rna, events_detect_rna,
]
QUERIES = {f.__name__: f for f in FUNCTIONS}


# Oracles

_READ_ROWS = base._READS + ", summed AS (SELECT read_id, len(x) AS len_raw_signal, CAST(list_sum(x) AS BIGINT) AS total, read AS user FROM reads)"

_PA = f"((raw % 1000)::FLOAT + {OFFSET}::FLOAT) * ({RANGE}::FLOAT / {DIGITISATION}::FLOAT)"


def _window(width: int) -> str:
    """The two-window statistic of every place, in single precision from prefix sums in double precision."""
    m = lambda a, b, c: f"(({b}.{c} - {a}.{c})::FLOAT / {width}::FLOAT)"
    m1, m2 = m("a", "p", "t"), m("p", "b", "t")
    v1, v2 = f"({m('a', 'p', 'q')} - {m1} * {m1})", f"({m('p', 'b', 'q')} - {m2} * {m2})"
    return f"""(SELECT p.read, p.i, abs({m2} - {m1}) / sqrt(greatest({v1} + {v2}, 1.1754943508222875e-38::FLOAT) / {width}::FLOAT)::FLOAT AS s
               FROM sums p JOIN sums a ON a.read = p.read AND a.i = p.i - {width} JOIN sums b ON b.read = p.read AND b.i = p.i + {width})"""


def _step(v: str, top: str, peak: str, good: str, level: float, width: int, rise: float, at: str = "i") -> dict[str, str]:
    """One sample of one detector: the next top, peak and goodness, and whether a boundary leaves."""
    seek = f"{top} < 0"
    new_peak = f"greatest({peak}, {v})"
    new_top = f"CASE WHEN {v} > {peak} THEN {at} ELSE {top} END"
    now_good = f"({good} OR ({new_peak} - {v} > {rise}::FLOAT AND {new_peak} > {level}::FLOAT))"
    out = f"(NOT ({seek}) AND {now_good} AND {at} - ({new_top}) > {width // 2})"
    return {
        "out": f"CASE WHEN {out} THEN {new_top} END",
        "top": f"CASE WHEN {seek} THEN CASE WHEN {v} >= {peak} AND {v} - {peak} > {rise}::FLOAT THEN {at} ELSE {top} END WHEN {out} THEN -1 ELSE {new_top} END",
        "peak": f"CASE WHEN {seek} THEN CASE WHEN {v} < {peak} OR {v} - {peak} > {rise}::FLOAT THEN {v} ELSE {peak} END WHEN {out} THEN {v} ELSE {new_peak} END",
        "good": f"CASE WHEN {seek} OR {out} THEN false ELSE {now_good} END",
        "silent": f"(NOT ({seek}) AND {new_peak} > {level}::FLOAT)",
        "new_top": new_top,
    }


def _events_sql(o: events.DetectorOptions) -> str:
    """The two detectors, sample by sample.  ``k``: the short one's state, ``m``: the long one's."""
    w1, w2 = o.short_width, o.long_width
    _S, _L = _step("s3", "ktop", "kpeak", "kgood", o.short_threshold, w1, o.peak_height), _step("s6", "mtop2", "mpeak2", "mgood2", o.long_threshold, w2, o.peak_height)
    return f"""WITH RECURSIVE {base.SAMPLES},
x AS (SELECT read, i, {_PA} AS v, count(*) OVER (PARTITION BY read) AS n FROM samples),
sums AS (SELECT read, 0::BIGINT AS i, 0::DOUBLE AS t, 0::DOUBLE AS q FROM x WHERE i = 0
         UNION ALL SELECT s.read, s.i + 1, s.t + x.v::DOUBLE, s.q + (x.v * x.v)::DOUBLE FROM sums s JOIN x ON x.read = s.read AND x.i = s.i),
w3 AS {_window(w1)}, w6 AS {_window(w2)},
st AS (SELECT x.read, x.i, x.n, CASE WHEN n >= {2 * w1} THEN coalesce(w3.s, 0::FLOAT) ELSE 0::FLOAT END AS s3, CASE WHEN n >= {2 * w2} THEN coalesce(w6.s, 0::FLOAT) ELSE 0::FLOAT END AS s6
       FROM x LEFT JOIN w3 ON w3.read = x.read AND w3.i = x.i LEFT JOIN w6 ON w6.read = x.read AND w6.i = x.i),
run AS (SELECT read, 0::BIGINT AS i, -1::BIGINT AS ktop, 'infinity'::FLOAT AS kpeak, false AS kgood, -1::BIGINT AS mtop, 'infinity'::FLOAT AS mpeak, false AS mgood, 0::BIGINT AS blocked, NULL::BIGINT AS cut1, NULL::BIGINT AS cut2 FROM x WHERE i = 0
        UNION ALL
        SELECT read, i, ktop2, kpeak2, kgood2, CASE WHEN i <= blocked2 THEN mtop2 ELSE {_L['top']} END, CASE WHEN i <= blocked2 THEN mpeak2 ELSE {_L['peak']} END,
               CASE WHEN i <= blocked2 THEN mgood2 ELSE {_L['good']} END, blocked2, cut1, CASE WHEN i > blocked2 THEN {_L['out']} END
        FROM (SELECT read, i, s6, {_S['top']} AS ktop2, {_S['peak']} AS kpeak2, {_S['good']} AS kgood2, {_S['out']} AS cut1, CASE WHEN {_S['silent']} THEN {_S['new_top']} + {w1} ELSE blocked END AS blocked2,
                     CASE WHEN {_S['silent']} THEN -1 ELSE mtop END AS mtop2, CASE WHEN {_S['silent']} THEN 'infinity'::FLOAT ELSE mpeak END AS mpeak2, CASE WHEN {_S['silent']} THEN false ELSE mgood END AS mgood2
              FROM (SELECT r.read, r.i + 1 AS i, st.s3, st.s6, r.ktop, r.kpeak, r.kgood, r.mtop, r.mpeak, r.mgood, r.blocked FROM run r JOIN st ON st.read = r.read AND st.i = r.i + 1))),
edges AS (SELECT read, 0::BIGINT AS place FROM x WHERE i = 0 UNION SELECT read, n FROM x UNION SELECT read, cut1 FROM run WHERE cut1 > 0 UNION SELECT read, cut2 FROM run WHERE cut2 > 0),
spans AS (SELECT read, place, lead(place) OVER (PARTITION BY read ORDER BY place) AS upto FROM edges),
e AS (SELECT a.read, s.place AS start, (s.upto - s.place)::FLOAT AS length, (b.t - a.t)::FLOAT / (s.upto - s.place)::FLOAT AS mean, (b.q - a.q)::FLOAT / (s.upto - s.place)::FLOAT AS sq
      FROM spans s JOIN sums a ON a.read = s.read AND a.i = s.place JOIN sums b ON b.read = s.read AND b.i = s.upto)
SELECT 'u' || read AS read_id, start, length::DOUBLE AS length, mean::DOUBLE AS mean, (sqrt(greatest(sq - mean * mean, 0::FLOAT))::FLOAT)::DOUBLE AS stdv FROM e"""


_BAND = f"""WITH RECURSIVE {base.SAMPLES}, x AS (SELECT read, i, greatest(0, least(1200, raw % 1000)) AS v FROM samples),
run AS (SELECT read, -1::BIGINT AS i, -1::BIGINT AS start, 0 AS length, 0 AS spent, 0 AS trail, 5 AS width, []::BIGINT[] AS xs, []::BIGINT[] AS ys FROM x WHERE i = 0
        UNION ALL
        SELECT read, i, CASE WHEN closes THEN -1 WHEN inside AND start < 0 THEN i ELSE start END,
               CASE WHEN closes THEN 0 WHEN counts THEN length + 1 ELSE length END,
               CASE WHEN closes THEN 0 ELSE spent + CASE WHEN counts AND NOT inside THEN 1 ELSE 0 END - CASE WHEN counts AND length + 1 >= greatest(8, width2) AND (length + 1) % width2 = 0 THEN 1 ELSE 0 END END,
               CASE WHEN closes OR inside THEN 0 WHEN counts THEN trail + 1 ELSE trail END, width2,
               CASE WHEN keeps AND NOT merges THEN list_append(xs, start) ELSE xs END,
               CASE WHEN keeps AND merges THEN list_append(ys[1:len(ys) - 1], i - trail) WHEN keeps THEN list_append(ys, i - trail) ELSE ys END
        FROM (SELECT *, start >= 0 AND NOT inside AND spent >= 3 AS closes, inside OR start >= 0 AND spent < 3 AS counts, start >= 0 AND NOT inside AND spent >= 3 AND length >= 8 AS keeps, len(ys) > 0 AND start - ys[-1] < 4 AS merges, width + inside::INT AS width2
              FROM (SELECT r.*  EXCLUDE (i), r.i + 1 AS i, x.v > 100 AND x.v < 700 AS inside FROM run r JOIN x ON x.read = r.read AND x.i = r.i + 1))),
last AS (SELECT r.* FROM run r JOIN (SELECT read, max(i) AS i FROM x GROUP BY read) m ON m.read = r.read AND m.i = r.i)
SELECT 'u' || read AS read_id, len(xs) || chr(9) || coalesce(array_to_string(list_transform(range(1, len(xs) + 1), lambda k: xs[k] || ',' || ys[k] || ';'), ''), '') AS line FROM last"""

_ADAPTOR = f"""WITH RECURSIVE {base.SAMPLES}, x AS (SELECT read, i, greatest(0, least(1200, raw % 1000)) AS v, count(*) OVER (PARTITION BY read) AS n FROM samples),
t AS (SELECT read, i, n - 6 AS m, (sum(v) OVER (PARTITION BY read ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))::FLOAT / 6::FLOAT AS t FROM x QUALIFY i < n - 6),
s AS (SELECT read, i, m, t AS total FROM t WHERE i = 0 UNION ALL SELECT s.read, t.i, s.m, s.total + t.t FROM s JOIN t ON t.read = s.read AND t.i = s.i + 1),
mean AS (SELECT read, m, total / m::FLOAT AS mean FROM s WHERE i = m - 1),
q AS (SELECT t.read, t.i, t.m, (t.t - mean) * (t.t - mean) AS total FROM t JOIN mean USING (read) WHERE t.i = 0
      UNION ALL SELECT q.read, t.i, q.m, q.total + (t.t - mean.mean) * (t.t - mean.mean) FROM q JOIN t ON t.read = q.read AND t.i = q.i + 1 JOIN mean ON mean.read = q.read),
low AS (SELECT q.read, mean - sqrt(q.total / q.m::FLOAT)::FLOAT * 0.1::FLOAT AS low FROM q JOIN mean ON mean.read = q.read WHERE q.i = q.m - 1),
sides AS (SELECT read, i, t < low AS below FROM t JOIN low USING (read) WHERE t <> low),
turns AS (SELECT read, i, below FROM sides QUALIFY below IS DISTINCT FROM lag(below) OVER (PARTITION BY read ORDER BY i)),
runs AS (SELECT read, i AS x, lead(i) OVER (PARTITION BY read ORDER BY i) - 1 AS y, below FROM turns),
whole AS (SELECT * FROM runs WHERE below AND y IS NOT NULL),
grouped AS (SELECT *, sum(CASE WHEN x - py < 3 THEN 0 ELSE 1 END) OVER (PARTITION BY read ORDER BY x) AS g FROM (SELECT *, coalesce(lag(y) OVER (PARTITION BY read ORDER BY x), -1000000) AS py FROM whole)),
merged AS (SELECT read, min(x) AS x, max(y) AS y FROM grouped GROUP BY read, g),
hit AS (SELECT read, arg_min(x, x) AS x, arg_min(y, x) AS y FROM merged WHERE y - x BETWEEN 3 AND 1000 GROUP BY read)
SELECT 'u' || r.read AS read_id, CASE WHEN hit.read IS NULL THEN '0' || chr(9) ELSE '1' || chr(9) || (x + 2) || ',' || (y + 2) || ';' END AS line FROM (SELECT DISTINCT read FROM samples) r LEFT JOIN hit ON hit.read = r.read"""


def _paths_sql(subsequence: bool) -> str:
    end = "CAST(list_position(cost, list_min(cost)) - 1 AS INT)" if subsequence else f"{base.DTW_COLUMNS - 1}"
    stop = "AND a.i > 0" if subsequence else "AND (a.i > 0 OR a.j > 0)"
    near = "CASE WHEN a.i = 0 THEN 2 WHEN a.j = 0 THEN 3 WHEN up.cost[a.j] = least(up.cost[a.j], own.cost[a.j], up.cost[a.j + 1]) THEN 1 WHEN own.cost[a.j] = least(up.cost[a.j], own.cost[a.j], up.cost[a.j + 1]) THEN 2 ELSE 3 END"
    return (
        base._dtw_sql(subsequence)
        + f""", matrix AS (SELECT vec_id, CAST(i - 1 AS INT) AS i, cost FROM r),
path AS (SELECT vec_id, i, {end} AS j FROM matrix m WHERE i = (SELECT max(i) FROM matrix)
         UNION ALL
         SELECT vec_id, CASE WHEN way = 2 THEN i ELSE i - 1 END, CASE WHEN way = 3 THEN j ELSE j - 1 END
         FROM (SELECT a.vec_id, a.i, a.j, {near} AS way FROM path a JOIN matrix own ON own.vec_id = a.vec_id AND own.i = a.i LEFT JOIN matrix up ON up.vec_id = a.vec_id AND up.i = a.i - 1 WHERE true {stop}))"""
    )


_REFERENCES = f"""refs AS (SELECT ref, strand, list_transform(range(0, {MAP_COLUMNS}), lambda j: CAST(((CASE WHEN strand = '+' THEN j ELSE {MAP_COLUMNS - 1} - j END) * t) % 101 * 5 - a AS BIGINT)) AS y
                 FROM (VALUES (0, 37, 250), (1, 53, 240)) AS c(ref, t, a), (VALUES ('+'), ('-')) AS s(strand))"""


def _candidates_sql(subsequence: bool) -> str:
    """All rows of all matrices; a cell is its cost and, for the best path's start, the column it began in."""
    first = "abs(x[1] - y[j + 1])" if subsequence else "list_sum(list_transform(range(0, j + 1), lambda k: abs(x[1] - y[k + 1])))"
    better = "CASE WHEN row[j].c <= row[j + 1].c AND row[j].c <= a[-1].c THEN row[j].b WHEN a[-1].c <= row[j + 1].c THEN a[-1].b ELSE row[j + 1].b END"
    cell = f"{{'c': abs(x[i + 1] - y[j + 1]) + least(row[j + 1].c, row[j].c, a[-1].c), 'b': {better}}}"
    cell = cell.replace("[j]", "[z[1].c]").replace("[j + 1]", "[z[1].c + 1]")
    return f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(e::DOUBLE * 1000) AS BIGINT)) AS x FROM embeddings), {_REFERENCES},
r AS (SELECT vec_id, ref, strand, x, y, 1 AS i, list_transform(range(0, {MAP_COLUMNS}), lambda j: {{'c': CAST({first} AS BIGINT), 'b': CAST({'j' if subsequence else '0'} AS BIGINT)}}) AS row FROM v, refs {'' if subsequence else "WHERE strand = '+'"}
      UNION ALL
      SELECT vec_id, ref, strand, x, y, i + 1, list_reduce(list_transform(range(1, {MAP_COLUMNS}), lambda j: [{{'c': CAST(j AS BIGINT), 'b': 0::BIGINT}}]), lambda a, z: list_append(a, {cell}), [{{'c': abs(x[i + 1] - y[1]) + row[1].c, 'b': row[1].b}}])
      FROM r WHERE i < len(x)),
last AS (SELECT vec_id, ref, strand, len(x) AS n, row FROM r WHERE i = len(x))"""


_SPANS = """, steps AS (SELECT vec_id, i, j, lag(i) OVER w AS before FROM path WINDOW w AS (PARTITION BY vec_id ORDER BY i, j)),
spans AS (SELECT vec_id, j, min(i) FILTER (before IS NULL OR before <> i) AS a, max(i) FILTER (before IS NULL OR before <> i) AS b, bool_or(before = i) AS stays FROM steps GROUP BY vec_id, j),
-- A base that is entered without a new event has none, unless events follow at it.
held AS (SELECT vec_id, j, a, b, row_number() OVER (PARTITION BY vec_id ORDER BY j) AS k FROM spans WHERE a IS NOT NULL),
gaps AS (SELECT *, j - lag(j) OVER w - 1 AS missing, a - lag(b) OVER w - 1 AS between FROM held WINDOW w AS (PARTITION BY vec_id ORDER BY j))"""

ORACLE = {
    "container_fetch": f"WITH {_READ_ROWS} SELECT * FROM summed WHERE user IN (SELECT c_custkey FROM customer)",
    "container_ids": f"WITH {_READ_ROWS} SELECT read_id, 1::BIGINT AS records FROM summed",
    "container_split": f"WITH {_READ_ROWS} SELECT * FROM summed",
    "container_convert": f"WITH {_READ_ROWS} SELECT * FROM summed",
    "container_pruned": f"WITH {_READ_ROWS} SELECT read_id, user FROM summed WHERE read_id = 'u1'",
    "container_attributes": """SELECT CAST(r_regionkey AS BIGINT) AS read_group, 'run' AS name, r_name AS value FROM region
        UNION ALL SELECT CAST(r_regionkey AS BIGINT), 'kit', CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE '' END FROM region""",
    "container_columns": f"""WITH {_READ_ROWS} SELECT read_id, len_raw_signal, user, CASE WHEN user % 2 = 1 AND user % 3 > 0 THEN user * 0.5::DOUBLE END AS half, NULL::VARCHAR AS name FROM summed
        UNION ALL SELECT read_id, len_raw_signal, NULL, NULL, 'n' || user FROM summed WHERE user % 2 = 1""",
    "container_copied": f"WITH {_READ_ROWS} SELECT * FROM summed WHERE user IN (SELECT c_custkey FROM customer)",
    "container_blocks": f"WITH {_READ_ROWS} SELECT * FROM summed",
    "container_lookup": f"WITH {_READ_ROWS} SELECT * FROM summed WHERE read_id IN ('u1', 'u17', 'u33')",
    "container_header": """SELECT CAST(r_regionkey AS BIGINT) AS read_group, 'site' AS name, r_name AS value FROM region
        UNION ALL SELECT CAST(r_regionkey AS BIGINT), 'run', CASE r_regionkey WHEN 0 THEN 'r1' WHEN 1 THEN 'r2' ELSE '' END FROM region UNION ALL SELECT CAST(r_regionkey AS BIGINT), 'kit', CASE r_regionkey WHEN 0 THEN 'new' ELSE '' END FROM region""",
    "container_types": f"WITH {_READ_ROWS}, u AS (SELECT user, read_id, CASE WHEN user % 4 > 0 THEN (user % 100)::DOUBLE END AS v, (user % 50)::DOUBLE AS w FROM summed) SELECT user, "
    + ", ".join(f"v AS one_{k}, coalesce(v, 1000) + w AS all_{k}" for k in _SCALARS)
    + ", CASE WHEN user % 4 > 0 THEN substr(read_id, 2, 1) END AS one_char, CASE WHEN user % 4 > 0 THEN read_id END AS all_char, (['low', 'mid', 'high'])[user % 3 + 1] AS one_enum FROM u",
    "fasta_records": f"WITH {base.CONTIGS} SELECT name, 'of a document' AS comment, seq FROM contigs",
    "fasta_parts": f"WITH {base.CONTIGS} SELECT name, length(seq) AS bases, length(regexp_replace(seq, '[^G]', '', 'g')) AS g, md5(seq) AS digest FROM contigs WHERE seq IS NOT NULL",
    "kmer_model_file": f"""SELECT CAST(r AS INT) AS rank, list_aggregate(list_transform(range(0, {base.K}), lambda j: substr('ACGT', CAST((r // CAST(4 ** ({base.K - 1} - j) AS BIGINT)) % 4 + 1 AS INT), 1)), 'string_agg', '') AS kmer,
        (60 + (r * 37) % 101 + coalesce(n, 0) * 0.25)::DOUBLE AS level_mean, 2::DOUBLE AS level_stdv
        FROM range(0, {4**base.K}) AS t(r) LEFT JOIN (SELECT p_partkey % {4**base.K} AS k, count(*) AS n FROM part GROUP BY k) ON k = r""",
    "bed_regions": """WITH b AS (SELECT 't' || l_suppkey AS ref, l_partkey + l_linenumber * 1000 AS beg, l_partkey + l_linenumber * 1000 + CAST(l_quantity AS INT) AS "end" FROM lineitem) SELECT *, ref || ':' || beg || '-' || "end" AS region FROM b""",
    "sam_header_lines": f"""WITH {base.CONTIGS} SELECT 0 AS part, ref_idx AS place, '@SQ' || chr(9) || 'SN:' || name || chr(9) || 'LN:' || (length(seq) - {base.K - 1}) AS line FROM contigs WHERE length(seq) >= 5
        UNION ALL SELECT 1, 0, '@PG' || chr(9) || 'ID:squigspark' || chr(9) || 'PN:squigspark'""",
    "eval_report": f"""WITH {base._classified(base._NEAR)}, sm AS ({base._SUMMARY}),
h AS (SELECT mapq, count(*) FILTER (outcome = 'correct') AS c, count(*) FILTER (outcome = 'incorrect') AS w FROM outcome WHERE outcome <> 'only_in_test' GROUP BY mapq)
SELECT 0 AS place, 'Number of records in truth set' || chr(9) || truth_rec AS value FROM sm UNION ALL SELECT 1, 'Reads mapped in truth set' || chr(9) || truth_mapped FROM sm
UNION ALL SELECT 2, printf('Mappings in test set%s%d%s%.2f%%', chr(9), test_mapped, chr(9), mapped_pct) FROM sm UNION ALL SELECT 3, printf('Correct%s%d%s%.2f%%', chr(9), correct, chr(9), correct_pct) FROM sm
UNION ALL SELECT 4, printf('Incorrect%s%d%s%.2f%%', chr(9), incorrect, chr(9), incorrect_pct) FROM sm UNION ALL SELECT 5, 'Only in test set' || chr(9) || only_in_test FROM sm
UNION ALL SELECT 6, concat_ws(chr(9), 'MAPQ', 'correct', 'incorrect') UNION ALL SELECT 160 - mapq, concat_ws(chr(9), mapq, c, w) FROM h""",
    "numbers_from_text": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey - 100 END AS whole, CASE WHEN o_orderkey % 7 <> 0 THEN printf('%.2f', o_totalprice)::DOUBLE END AS part FROM orders",
    "base_functions": """WITH t AS (SELECT doc_id, text, coalesce(text, '') AS s, doc_id % 12 AS k FROM documents),
k AS (SELECT doc_id, list_transform(regexp_extract_all(upper(s), '(?s).{6}'), lambda x: list_sum(list_transform(range(1, 7), lambda j: greatest(0, instr('ACGT', substr(x, j, 1)) - 1) * CAST(4 ** (6 - j) AS BIGINT)))) AS r FROM t)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN length(regexp_replace(s, '[^cC]', '', 'g')) + 2 * length(regexp_replace(s, '[^gG]', '', 'g')) + 3 * length(regexp_replace(s, '[^tT]', '', 'g')) END AS ranks, CAST(list_max(r) AS INT) AS greatest,
       CAST(length(text) AS INT) AS n, replace(text, 'e', 'E') AS replaced, CASE WHEN k <= 9 THEN CAST(4 ** k AS BIGINT) END AS kmers FROM t JOIN k USING (doc_id)""",
    "small_functions": """WITH o AS (SELECT o_orderkey, o_custkey, o_custkey % 97 AS a, o_orderkey % 89 AS b FROM orders)
SELECT o_orderkey, abs(a - b) AS distance, (a - b) * (a - b) AS squared, least(a, b, o_custkey) AS least, abs(a - b * 97::DOUBLE / 89) <= 10 AS near, (a % 3) * 100 + (b % 5) * 10 + o_orderkey % 7 >= 123 AS recent, a % 2 = 0 AS named FROM o""",
    "experiment_kinds": "SELECT o_orderkey, o_orderkey % 4 = 0 AS rna, CASE o_custkey % 5 WHEN 1 THEN 'r10' WHEN 2 THEN 'rna004' ELSE 'r9' END AS pore FROM orders",
    "model_choices": """SELECT o_orderkey, o_orderkey % 2 = 0 AS rna, (['r9', 'r10', 'rna004'])[o_custkey % 3 + 1] AS pore,
        CASE WHEN o_orderkey % 2 = 0 THEN (['rna_r9', NULL, 'rna_rna004'])[o_custkey % 3 + 1] ELSE (['dna_r9', 'dna_r10', 'dna_r10'])[o_custkey % 3 + 1] END AS model FROM orders""",
    "ref_zscore_global": base._KMERS + " SELECT ref_idx, strand, i, round((level - avg(level) OVER ()) / stddev_pop(level) OVER (), 3) AS z FROM levels",
    "ref_inverted": base._KMERS + " SELECT ref_idx, CAST(ref_len - 1 - i AS INT) AS i, level FROM levels WHERE strand = '+'",
    "query_reversed": f"""WITH {base.SAMPLES}, c AS (SELECT *, count(*) OVER (PARTITION BY read) AS n FROM samples), w AS (SELECT * FROM c WHERE n >= 30 AND i >= 5 AND i < least(35, n))
SELECT read, CAST(max(i) OVER p - i AS INT) AS i, CASE WHEN stddev_pop(raw) OVER p > 0 THEN round((raw - avg(raw) OVER p) / stddev_pop(raw) OVER p, 3) END AS z FROM w WINDOW p AS (PARTITION BY read)""",
    "map_candidates": _candidates_sql(True)
    + f""", cells AS (SELECT vec_id, ref, strand, n, CAST(j AS INT) AS j, row[j + 1].c AS c, row[j + 1].b AS b FROM (SELECT *, unnest(range(0, {MAP_COLUMNS})) AS j FROM last)),
chunks AS (SELECT vec_id, ref, strand, j // n AS chunk, min(c) AS score, arg_min(j, c * 1000 + j) AS pos_end, arg_min(b, c * 1000 + j) AS pos_st FROM cells GROUP BY vec_id, ref, strand, j // n),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score, ref DESC, strand DESC, chunk DESC) - 1 AS INT) AS place FROM chunks)
SELECT vec_id, place, score, CAST(ref AS INT) AS ref_idx, strand, CAST(pos_end AS INT) AS pos_end, CASE WHEN place = 0 THEN CAST(pos_st AS INT) END AS pos_st FROM ranked WHERE place < 5""",
    "map_rows": _candidates_sql(True)
    + f""", cells AS (SELECT vec_id, ref, strand, n, CAST(j AS INT) AS j, row[j + 1].c AS c, row[j + 1].b AS b FROM (SELECT *, unnest(range(0, {MAP_COLUMNS})) AS j FROM last)),
chunks AS (SELECT vec_id, ref, strand, n, j // n AS chunk, min(c) AS score, arg_min(j, c * 1000 + j) AS pe, arg_min(b, c * 1000 + j) AS ps FROM cells GROUP BY vec_id, ref, strand, n, j // n),
ranked AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second FROM chunks WINDOW w AS (PARTITION BY vec_id ORDER BY score, ref DESC, strand DESC, chunk DESC)),
lifted AS (SELECT *, CAST(CASE strand WHEN '-' THEN {MAP_COLUMNS} - pe ELSE ps END + 7 * ref AS INT) AS st, CAST(CASE strand WHEN '-' THEN {MAP_COLUMNS} - ps ELSE pe END + 7 * ref AS INT) AS en FROM ranked WHERE place = 1),
hits AS (SELECT 'v' || vec_id AS rid, 900 AS qlen, CAST(vec_id % 50 AS INT) AS query_start, CAST(vec_id % 50 + 640 AS INT) AS query_end, strand, 'c' || ref AS tid, {MAP_COLUMNS + 4} AS tlen, st AS target_start, en AS target_end,
                CAST(round((en - st) - score::DOUBLE * (en - st) / (n - 1)) AS INT) AS n_residue, en - st AS block_len,
                CAST(CASE WHEN second IS NULL OR score = 0 AND second > 0 THEN 60 WHEN score = 0 THEN 0 ELSE least(60, round(500.0::DOUBLE * (second - score) / score)) END AS INT) AS mapq, 'P' AS tp, score::DOUBLE AS d1, second::DOUBLE AS d2 FROM lifted)
SELECT *, concat_ws(chr(9), rid, qlen, query_start, query_end, strand, tid, tlen, target_start, target_end, n_residue, block_len, mapq, 'tp:A:P', printf('d1:f:%.2f', d1), printf('d2:f:%.2f', d2)) AS line FROM hits""",
    "map_candidates_std": _candidates_sql(False) + f" SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY row[{MAP_COLUMNS}].c, ref DESC) - 1 AS INT) AS place, row[{MAP_COLUMNS}].c AS score, CAST(ref AS INT) AS ref_idx FROM last",
    "warp_paths": _paths_sql(True) + " SELECT vec_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM path",
    "warp_paths_std": _paths_sql(False) + " SELECT vec_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM path",
    "signal_strings": _paths_sql(True) + _SPANS + """
SELECT vec_id, string_agg(CASE WHEN missing > 0 THEN missing || 'D' ELSE '' END || CASE WHEN between > 0 THEN between * 10 || 'I' ELSE '' END || (b - a + 1) * 10 || ',', '' ORDER BY j) AS ss FROM gaps GROUP BY vec_id""",
    # What follows a base in the reversed query stands before it in the read.
    "signal_strings_rna": _paths_sql(True) + _SPANS + """
SELECT vec_id, string_agg((b - a + 1) * 10 || ',' || CASE WHEN missing > 0 THEN missing || 'D' ELSE '' END || CASE WHEN between > 0 THEN between * 10 || 'I' ELSE '' END, '' ORDER BY j DESC) AS ss FROM gaps GROUP BY vec_id""",
}
#: SQL of queries that ``queries`` holds.
ORACLE["map_candidates_tiled"] = ORACLE["map_candidates"]
ORACLE["ref_tiles"] = base.ORACLE["ref_levels"]
ORACLE["events_detect_rna"] = _events_sql(events.RNA)
base.ORACLE["events_detect"] = _events_sql(events.DNA)
base.ORACLE["band_segments"] = _BAND
base.ORACLE["adaptor_segments"] = _ADAPTOR
