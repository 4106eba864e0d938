"""End-to-end jobs: files in, files out."""

from __future__ import annotations

import posixpath

from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import paf_line, sam_header, sam_line
from ..operators.evaluate import EvalOptions, mapq_histogram, report_lines, summary
from ..operators.mapping import map_reads
from ..operators.reference import rna_part, synthetic_references, tiles_of_parts
from ..options import MapOptions, is_rna, model_name, pore_of
from ..sources.container import copy_records, list_files, open_headers, read_groups, read_signal, register, store_of
from ..sources.tables import PART_BASES, read_fasta, read_fasta_parts, read_kmer_model, read_paf


def detect_options(spark: SparkSession, reads_path: str, **given) -> MapOptions:
    """Options for a data set: what the header says, unless given.  Checked after detection."""
    found = read_groups(spark, reads_path).agg(
        F.max(is_rna(F.element_at("attrs", "experiment_type"))).alias("rna"), F.max(pore_of(F.coalesce(F.element_at("attrs", "sequencing_kit"), F.lit("")))).alias("pore")
    ).first()
    detected = {"rna": bool(found["rna"]), "pore": found["pore"] or "r9"}
    return MapOptions(**(detected | {k: v for k, v in given.items() if v is not None}))


def references(spark: SparkSession, fasta: str, model: str, opt: MapOptions) -> DataFrame:
    return synthetic_references(
        read_fasta(spark, fasta), read_kmer_model(spark, model, opt.kmer_length), opt.kmer_length, rna=opt.rna, full=opt.full_ref, query_size=opt.query, from_end=opt.from_end, invert=opt.invert, rna_letters=opt.rna_letters
    )


def chosen_model(model: str, opt: MapOptions) -> str:
    """A model file, or a folder of its parts, as it is; of a folder of ``NAME.model`` files the one that the pore and the kind of molecule take."""
    store, at = store_of(model)
    held = store.get_file_info(FileSelector(at)) if store.get_file_info(at).type == FileType.Directory else []
    return posixpath.join(model, f"{model_name(opt.pore, opt.rna)}.model") if any(f.path.endswith(".model") for f in held) else model


def map_job(spark: SparkSession, fasta: str, reads: str, model: str, out: str, opt: MapOptions) -> dict[str, int]:
    """Map a container's reads and write PAF or SAM text, one part file for each partition; what the reads came to, counted on the way.

    SAM parts have no header; it is written beside them as ``header``, in order over its own part files.
    """
    register(spark)
    model, seen = chosen_model(model, opt), Observation("mapping")
    if opt.rna and not opt.full_ref:  # short stretches of transcripts
        rows = map_reads(read_signal(spark, reads), references(spark, fasta, model, opt), opt, seen)
    else:
        kmers = read_kmer_model(spark, model, opt.kmer_length)
        tiles = tiles_of_parts(read_fasta_parts(spark, fasta, min(PART_BASES, opt.tile_columns)), kmers, opt.kmer_length, not opt.rna, opt.invert, rna_letters=opt.rna_letters)
        rows = map_reads(read_signal(spark, reads), None, opt, seen, tiles)
    if not opt.sam:
        rows.select(paf_line().alias("value")).write.mode("overwrite").text(out)
        return seen.get
    rows.select(sam_line(F.coalesce("ss", F.lit("")), opt.rna).alias("value")).write.mode("overwrite").text(f"{out}/records")
    kmers = F.length("seq") + 1 - opt.kmer_length
    kept = rna_part(F.length("seq"), opt.kmer_length, opt.query, opt.from_end)[0] if opt.rna and not opt.full_ref else kmers
    sam_header(read_fasta(spark, fasta).filter(kmers > 0).select("ref_idx", "name", kept.alias("ref_len"))).orderBy("part", "place").select("line").write.mode("overwrite").text(f"{out}/header")
    return seen.get


def eval_job(spark: SparkSession, truth: str, test: str, opt: EvalOptions = EvalOptions()) -> DataFrame:
    """The accuracy report of two mapping files, as ordered lines."""
    a, b = read_paf(spark, truth), read_paf(spark, test)
    return report_lines(summary(a, b, opt), mapq_histogram(a, b, opt)).select("value")


def convert_job(spark: SparkSession, source: str, out: str, kind: str = "binary", **options: str) -> None:
    """Containers from one form or compression to another, records and header attributes alike.

    Where only the records' codec changes, or nothing, their bytes are moved undecoded.
    """
    register(spark)
    files = [p for p, _ in list_files(source)]
    headers = open_headers(files)
    h = headers[0]
    if all(x == h for x in headers) and set(options) <= {"record_press", "signal_press"} and h.binary == (kind == "binary") and (not h.binary or options.get("signal_press", "svb-zd") == h.signal_codec):
        copy_records(spark, source, out, record_press=options.get("record_press", "zlib") if h.binary else None)
        return
    attrs: dict[str, list[str]] = {}
    for g in read_groups(spark, source).orderBy("read_group").collect():
        for name, value in g["attrs"].items():
            attrs.setdefault(name, []).append(value)
    named = {f"attr.{name}": "\t".join(values) for name, values in attrs.items()}
    read_signal(spark, source).write.format("signal").mode("append").options(container=kind, **options, **named).save(out)
