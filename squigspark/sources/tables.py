"""Text sources read natively: PAF, k-mer models, BED regions and FASTA/FASTQ."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bases import MOST_KMERS


def parse_paf(lines: DataFrame, value: str = "value", mode: str = "FAILFAST") -> DataFrame:
    """Mapping rows from PAF lines.  Tabs in a row count as one; of several tp tags the last one wins.

    ``mode`` "DROPMALFORMED" leaves out lines with fewer than twelve columns or another strand than + and -.
    """
    clean = F.regexp_replace(F.rtrim(F.regexp_replace(F.col(value), r"[\t\r\n]+$", "")), r"\t+", "\t")
    parts = F.split(clean, "\t")
    rows = lines.select(parts.alias("p"))
    ok = (F.size("p") >= 12) & F.get("p", F.lit(4)).isin("+", "-")
    if mode == "DROPMALFORMED":
        rows = rows.filter(ok)
    else:
        rows = rows.filter(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("malformed mapping line: "), F.array_join("p", "\t"))).cast("boolean")))
    tags = F.slice("p", 13, F.greatest(F.size("p") - 12, F.lit(0)))
    of = lambda prefix: F.element_at(F.filter(tags, lambda t: F.startswith(t, F.lit(prefix))), -1)
    last = lambda prefix: F.when(F.exists(tags, lambda t: F.startswith(t, F.lit(prefix))), F.substring(of(prefix), len(prefix) + 1, 64))
    types = F.filter(tags, lambda t: t.isin("tp:A:P", "tp:A:S"))
    tp = F.when(F.size(types) > 0, F.substring(F.element_at(types, -1), 6, 1)).otherwise("P")
    text = lambda i: F.get("p", F.lit(i))
    number = lambda i: F.get("p", F.lit(i)).cast("int")
    return rows.select(
        text(0).alias("rid"), number(1).alias("qlen"), number(2).alias("query_start"), number(3).alias("query_end"), text(4).alias("strand"), text(5).alias("tid"), number(6).alias("tlen"),
        number(7).alias("target_start"), number(8).alias("target_end"), number(9).alias("n_residue"), number(10).alias("block_len"), number(11).alias("mapq"), tp.alias("tp"),
        last("d1:f:").cast("float").alias("d1"), last("d2:f:").cast("float").alias("d2"),
    )


def read_paf(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    return parse_paf(spark.read.text(path).filter(F.trim("value") != ""), mode=mode)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(ref, beg, end, region); a malformed line or an end before its start is an error."""
    p = F.split("value", r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.get(p, F.lit(0)).alias("ref"), F.get(p, F.lit(1)).try_cast("long").alias("beg"), F.get(p, F.lit(2)).try_cast("long").alias("end"))
    ok = F.coalesce(F.col("end") >= F.col("beg"), F.lit(False))
    checked = rows.filter(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("malformed region of "), F.coalesce("ref", F.lit("?")))).cast("boolean")))
    return checked.withColumn("region", F.format_string("%s:%d-%d", "ref", "beg", "end"))


def read_kmer_model(spark: SparkSession, path: str, default_k: int = 9) -> DataFrame:
    """(rank, kmer, level_mean, level_stdv) of a k-mer table; the order of rows is the rank.

    The file has at most 4^9 rows (a few MB), so one ordered pass over it is a bounded one.
    """
    #: Header spellings that are skipped.
    heads = r"^(#|kmer\tlevel_mean|kmer\tref|contig)"
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    k_row = lines.filter(F.col("line").rlike(r"^#k\t\d+")).select(F.regexp_extract("line", r"^#k\t(\d+)", 1).cast("int").alias("k")).first()
    k = k_row["k"] if k_row else default_k
    p = F.split("line", r"\t")
    good = lines.filter((F.trim("line") != "") & ~F.col("line").rlike(heads) & (F.size(p) >= 3))
    out = good.select("at", F.get(p, F.lit(0)).alias("kmer"), F.get(p, F.lit(1)).cast("float").alias("level_mean"), F.get(p, F.lit(2)).cast("float").alias("level_stdv"))
    n = out.limit(MOST_KMERS + 1).count()
    if n != 4**k:
        raise ValueError(f"a model of {k}-mers has {4**k} rows, this file has {n}")
    return out.select((F.row_number().over(Window.orderBy("at")) - 1).cast("int").alias("rank"), "kmer", "level_mean", "level_stdv")


FASTQ = r"(?i)\.(fq|fastq)(\.gz)?$"
PART_BASES = 1 << 20


def _head(line: str) -> tuple[str, str | None]:
    """Name and comment of a header line."""
    words = line[1:].split(None, 1) if line[1:2].strip() else ["", *line[1:].split(None, 0)]
    return words[0] if words else "", words[1].rstrip() if len(words) > 1 and words[1].strip() else None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _stitched(batches: Iterator[pa.RecordBatch], part_bases: int) -> Iterator[tuple]:
    """(file, block, contig, part, start, name, comment, seq) of the lines of byte ranges, in their order.

    Contig 0 is what an earlier range has begun; its name is not known here.  Parts and starts count within the range.
    """
    key, contig, part, start, name, comment = None, 0, 0, 0, None, None
    held: list[str] = []
    size = 0

    def flush() -> tuple:
        nonlocal part, start, held, size
        row = (*key, contig, part, start, name, comment, "".join(held))
        part, start, held, size = part + 1, start + size, [], 0
        return row

    for batch in batches:
        for line, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (file, block):
                if key and (held or contig and not part):
                    yield flush()
                key, contig, part, start, name, comment, held, size = (file, block), 0, 0, 0, None, None, [], 0
            if line.startswith(">"):
                if held or contig and not part:
                    yield flush()
                name, comment = _head(line.rstrip("\r"))
                contig, part, start = contig + 1, 0, 0
                continue
            if block == 0 and contig == 0 and line.startswith("@"):
                raise ValueError(f"{file} has FASTQ records; such files are to be named .fq or .fastq")
            letters = "".join(line.split())
            held.append(letters)
            size += len(letters)
            if size >= part_bases:
                yield flush()
    if key and (held or contig and not part):
        yield flush()


def read_fasta_parts(spark: SparkSession, path: str, part_bases: int = PART_BASES) -> DataFrame:
    """(ref_idx, name, comment, part, start, seq): contigs in parts of some ``part_bases`` bases; FASTA, plain or gzipped.

    A file is read by byte ranges, by as many tasks as Spark cuts it for (gzip by one).  Of each range only the number of
    contigs and the bases behind the last header are gathered; prefix sums over the ranges say which contig
    a range goes on with and how far that has come.  No sequence is shuffled, and a contig may have any length.
    ref_idx counts in the order of files and contigs.
    """
    lines = _lines(spark, path).filter(~F.col("file").rlike(FASTQ))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for row in _stitched(batches, part_bases):
            out.append(row)
            held += len(row[-1])
            if held > 8 << 20 or len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["file", "block", "contig", "at", "from", "own_name", "own_comment", "seq"]
    kinds = [pa.string(), *[pa.int64()] * 4, *[pa.string()] * 3]
    parts = lines.mapInArrow(rows, "file string, block long, contig long, at long, `from` long, own_name string, own_comment string, seq string")
    sized = parts.withColumn("n", F.length("seq"))
    last = F.struct("contig", "at")
    blocks = sized.groupBy("file", "block").agg(F.max("contig").alias("heads"), F.sum("n").alias("bases"), F.count("*").alias("parts"), F.max_by(F.struct("own_name", "own_comment"), last).alias("named"), F.max_by(F.col("from") + F.col("n"), last).alias("tail"), (F.max_by("at", last) + 1).alias("tail_parts"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    sums = blocks.select("*", F.sum("bases").over(upto).alias("all_bases"), F.sum("parts").over(upto).alias("all_parts"))
    began = lambda all_, tail: F.last(F.when(F.col("heads") > 0, F.col(all_) - F.col(tail)), ignorenulls=True).over(before)
    carried = sums.select(
        "file", "block", "heads", (F.col("all_bases") - F.col("bases") - began("all_bases", "tail")).alias("come"), (F.col("all_parts") - F.col("parts") - began("all_parts", "tail_parts")).alias("come_parts"),
        F.last(F.when(F.col("heads") > 0, F.col("named")), ignorenulls=True).over(before).alias("open"),
    )
    # One row for each range of some 128 MB, in one ordered pass.
    first = F.coalesce(F.sum("heads").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = carried.select("file", "block", "come", "come_parts", "open", first.alias("before"))
    joined = parts.join(known, ["file", "block"])
    goes_on = F.col("contig") == 0
    return joined.filter(~goes_on | F.col("open").isNotNull()).select(
        (F.col("before") + F.col("contig") - 1).cast("int").alias("ref_idx"), F.when(goes_on, F.col("open.own_name")).otherwise(F.col("own_name")).alias("name"), F.when(goes_on, F.col("open.own_comment")).otherwise(F.col("own_comment")).alias("comment"),
        (F.col("at") + F.when(goes_on, F.col("come_parts")).otherwise(0)).alias("part"), (F.col("from") + F.when(goes_on, F.col("come")).otherwise(0)).alias("start"), "seq",
    )


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, name, comment, seq) of the files named .fq or .fastq, plain or gzipped.

    A record's quality has as many letters as its bases, so a line of it may begin with any letter.  A file is
    streamed by one task, a record at a time.
    """
    lines = _lines(spark, path).filter(F.col("file").rlike(FASTQ)).withColumn("line", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, name, comment, bases, size, left = None, -1, None, None, [], 0, None
        out, held = [], 0

        def done() -> None:
            nonlocal name, held
            if name is not None:
                out.append((own, at, name, comment, "".join(bases)))
                held += size
                name = None

        for batch in batches:
            for line, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != own:
                    done()
                    own, at, left = file, -1, None
                line = line.rstrip("\r")
                if left is not None and (left > 0 or not line):
                    left -= len(line)
                elif line[:1] in ("@", ">"):
                    done()
                    (name, comment), at, bases, size, left = _head(line), at + 1, [], 0, None
                elif line.startswith("+") and name is not None:
                    left = size
                elif name is not None:
                    letters = "".join(line.split())
                    bases.append(letters)
                    size += len(letters)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, held = [], 0
        done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names, kinds = ["file", "at", "name", "comment", "seq"], [pa.string(), pa.int64(), *[pa.string()] * 3]
    return lines.repartition("file").sortWithinPartitions("file", "block", "line").select("value", "file").mapInArrow(run, "file string, at long, name string, comment string, seq string")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(ref_idx, name, comment, seq) of FASTA and FASTQ files, plain or gzipped.

    Parts are joined to whole contigs here, so a contig has 2^31 bases at most; ``read_fasta_parts`` has no such limit.
    ref_idx counts contigs in the order of files and records, then those of FASTQ files likewise.
    """
    pieces = F.array_sort(F.collect_list(F.struct("part", "seq")))
    whole = read_fasta_parts(spark, path).groupBy("ref_idx").agg(F.max("name").alias("name"), F.max("comment").alias("comment"), F.concat_ws("", F.transform(pieces, lambda p: p["seq"])).alias("seq"))
    files = [f for f in spark.read.text(path).inputFiles() if re.search(FASTQ.removeprefix("(?i)"), f, re.IGNORECASE)]
    if not files:
        return whole.select("ref_idx", "name", "comment", "seq")
    reads = read_fastq(spark, path)
    counts = reads.groupBy("file").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    contigs = whole.agg((F.coalesce(F.max("ref_idx"), F.lit(-1)) + 1).alias("contigs")).first()["contigs"]
    placed = reads.join(counts.select("file", "first"), "file").select((F.lit(contigs) + F.col("first") + F.col("at")).cast("int").alias("ref_idx"), "name", "comment", "seq")
    return whole.select("ref_idx", "name", "comment", "seq").unionByName(placed)
