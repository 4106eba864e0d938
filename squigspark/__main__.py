"""``python -m squigspark map | eval | events | segments``"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.arrays import to_picoamps
from .operators.evaluate import EvalOptions
from .operators.events import DNA, RNA, with_events
from .operators.segments import segment_text, with_segments
from .options import parse_size, size_text, yes_or_no
from .plans.jobs import detect_options, eval_job, map_job
from .sources.container import register


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="squigspark")
    p.add_argument("--verbose", type=int, default=4, choices=range(7), help="0 (silent) to 6")
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("map", help="map signals to references")
    m.add_argument("fasta")
    m.add_argument("reads")
    m.add_argument("--kmer-model", required=True, help="a model file, or a folder of models by pore and molecule")
    m.add_argument("-o", "--output", required=True)
    m.add_argument("--rna", action="store_const", const=True)
    m.add_argument("--pore", choices=["r9", "r10", "rna004"])
    m.add_argument("-q", "--query-size", type=int, dest="query")
    m.add_argument("-p", "--prefix-size", type=int, dest="prefix")
    m.add_argument("--dtw-std", action="store_const", const=True, dest="standard")
    m.add_argument("--invert", action="store_const", const=True)
    m.add_argument("--full-ref", action="store_const", const=True)
    m.add_argument("--from-end", action="store_const", const=True)
    m.add_argument("-a", "--sam", action="store_const", const=True)
    m.add_argument("--reference-bytes", type=parse_size)
    e = sub.add_parser("eval", help="compare mappings with a truth set")
    e.add_argument("truth")
    e.add_argument("test")
    e.add_argument("--secondary", type=yes_or_no, default=True)
    e.add_argument("--tid-only", action="store_true")
    for name in ("events", "segments"):
        s = sub.add_parser(name)
        s.add_argument("reads")
        s.add_argument("--rna", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=[60, 40, 40, 30, 20, 10, 10][args.verbose])
    spark = SparkSession.builder.appName("squigspark").getOrCreate()
    if args.command == "eval":
        for row in eval_job(spark, args.truth, args.test, EvalOptions(args.secondary, args.tid_only)).toLocalIterator():
            print(row["value"])
        return 0
    register(spark)
    if args.command == "map":
        given = {k: getattr(args, k) for k in ("rna", "pore", "query", "prefix", "standard", "invert", "full_ref", "from_end", "sam", "reference_bytes")}
        seen = map_job(spark, args.fasta, args.reads, args.kmer_model, args.output, detect_options(spark, args.reads, **given))
        logging.warning("reads: %(reads)d, prefix fail: %(prefix_fail)d, ignored: %(ignored)d, too short: %(too_short)d, no signal: %(no_signal)d", seen)
        logging.warning("bytes: %s", size_text(seen["bytes"]))
        return 0
    reads = spark.read.format("signal").load(args.reads)
    if args.command == "events":
        signal = reads.withColumn("pa", to_picoamps("raw_signal", "digitisation", "offset", "range"))
        out = with_events(signal, opt=RNA if args.rna else DNA).select("read_id", F.explode("events").alias("e")).select(F.concat_ws("\t", "read_id", "e.start", "e.length", "e.mean", "e.stdv").alias("value"))
    else:
        out = with_segments(reads, "raw_signal").select(F.concat_ws("\t", "read_id", segment_text("segments")).alias("value"))
    for row in out.toLocalIterator():
        print(row["value"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
