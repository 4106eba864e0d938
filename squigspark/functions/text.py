"""Text forms of numbers, names and alignment rows, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number_text(x: Column | str) -> Column:
    """At most six decimals without trailing zeros; ``-0`` becomes ``0``, null becomes ``.``."""
    s = F.regexp_replace(F.format_string("%f", _col(x).cast("double")), r"\.?0+$", "")
    whole = F.format_string("%.0f", _col(x).cast("double"))
    trimmed = F.when(_col(x).cast("double") == F.floor(_col(x).cast("double")), whole).otherwise(s)
    return F.coalesce(F.when(trimmed.isin("-0", ""), "0").otherwise(F.when(_col(x).isNotNull(), trimmed)), F.lit("."))


def checked_integer(s: Column | str, kind: str = "bigint", signed: bool = True) -> Column:
    """The integer that a text field holds; null for ``.``, an error for anything malformed or out of range."""
    s = _col(s)
    ok = s.rlike(r"^-?(0|[1-9][0-9]*)$" if signed else r"^(0|[1-9][0-9]*)$")
    value = F.when(ok, s.try_cast(kind))
    return F.when(s == ".", F.lit(None).cast(kind)).otherwise(F.coalesce(value, F.raise_error(F.concat(F.lit("not a number of this type: "), s)).cast(kind)))


def checked_float(s: Column | str, kind: str = "double") -> Column:
    """Digits, a sign and a point only: no exponent, no nan."""
    s = _col(s)
    value = F.when(s.rlike(r"^-?[0-9]*\.?[0-9]+\.?$"), s.try_cast(kind))
    return F.when(s == ".", F.lit(None).cast(kind)).otherwise(F.coalesce(value, F.raise_error(F.concat(F.lit("not a number of this type: "), s)).cast(kind)))


def is_identifier(s: Column | str) -> Column:
    return _col(s).rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")


def version_at_least(version: Column | str, least: tuple[int, int, int]) -> Column:
    """Whether a dotted version is at least the given one, compared number by number."""
    parts = F.transform(F.split(_col(version), r"\."), lambda p: p.cast("int"))
    return F.struct(*[F.get(parts, F.lit(i)) for i in range(3)]) >= F.struct(*[F.lit(x) for x in least])


def residue_count(block: Column, score: Column, query_len: Column) -> Column:
    """Matching residues as the alignment's score implies them."""
    return F.round(block.cast("double") - score.cast("double") * block / (query_len - 1)).cast("int")


def mapping_quality(score: Column | str, score2: Column | str) -> Column:
    """round(500 * (second - best) / best), between 0 and 60; 60 without a rival, 0 for two perfect hits."""
    s, s2 = _col(score), _col(score2)
    usual = F.least(F.lit(60), F.round(F.lit(500.0) * (s2 - s) / s)).cast("int")
    return F.when(s2.isNull() | (s2 == float("inf")) | ((s == 0) & (s2 > 0)), 60).when(s == 0, 0).otherwise(usual)


def paf_line(row_prefix: str = "") -> Column:
    """A mapping row as one line: twelve columns and the tags tp, d1 and d2."""
    c = lambda n: F.col(f"{row_prefix}{n}")
    fixed = ["rid", "qlen", "query_start", "query_end", "strand", "tid", "tlen", "target_start", "target_end", "n_residue", "block_len", "mapq"]
    tags = [F.concat(F.lit("tp:A:"), c("tp")), F.format_string("d1:f:%.2f", c("d1").cast("double")), F.format_string("d2:f:%.2f", c("d2").cast("double"))]
    return F.concat_ws("\t", *[c(n).cast("string") for n in fixed], *tags)


def sam_line(ss: Column | str, rna: bool = False, row_prefix: str = "") -> Column:
    """A mapping row as a SAM line with the signal tags si and ss."""
    c = lambda n: F.col(f"{row_prefix}{n}")
    flag = F.when(c("strand") == "+", "0").otherwise("16")
    ends = ("target_end", "target_start") if rna else ("target_start", "target_end")
    si = F.concat(F.lit("si:Z:"), F.concat_ws(",", c("query_start"), c("query_end"), *[c(e) for e in ends]))
    cigar = F.concat((c("n_events") - 1).cast("string"), F.lit("M"))
    return F.concat_ws("\t", c("rid"), flag, c("tid"), (c("target_start") + 1).cast("string"), c("mapq").cast("string"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), si, F.concat(F.lit("ss:Z:"), _col(ss)))


def sam_header(references: DataFrame) -> DataFrame:
    """(part, place, line), to be ordered by part and place: an @SQ line for each (ref_idx, name, ref_len), whose length is the number of k-mers, then @PG."""
    named = F.concat(F.lit("@SQ\tSN:"), F.col("name"), F.lit("\tLN:"), F.col("ref_len").cast("string"))
    lines = references.select(F.lit(0).alias("part"), F.col("ref_idx").cast("int").alias("place"), named.alias("line"))
    return lines.unionByName(references.sparkSession.createDataFrame([(1, 0, "@PG\tID:squigspark\tPN:squigspark")], "part int, place int, line string"))
