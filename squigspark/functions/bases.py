"""Functions of nucleotide strings, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The rank of a base is its place here; whatever else stands in a sequence ranks 0.
BASES = "ACGT"
MOST_KMERS = 262144


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base_rank(base: Column | str) -> Column:
    return F.greatest(F.instr(F.lit(BASES), F.translate(_col(base), "acgt", BASES)) - 1, F.lit(0))


def u_to_t(seq: Column | str) -> Column:
    """RNA letters as DNA ones, for references that are written with U."""
    return F.translate(_col(seq), "Uu", "Tt")


def rank_digits(seq: Column | str) -> Column:
    """The sequence as digits 0-3, unknown letters as 0."""
    return F.regexp_replace(F.translate(F.regexp_replace(_col(seq), "[0-9]", "A"), BASES + BASES.lower(), "01230123"), "[^0-3]", "0")


def kmer_rank(kmer: Column | str) -> Column:
    """Base-4 number of a k-mer, its first base most significant."""
    return F.conv(rank_digits(kmer), 4, 10).cast("int")


def rank_sum(seq: Column | str) -> Column:
    """``base_rank`` of every letter, summed: each rank times the letters that have it, without a visit to any single letter."""
    of = lambda i: F.length(F.regexp_replace(_col(seq), f"[^{BASES[i]}{BASES[i].lower()}]", ""))
    return sum((of(i) * i for i in range(2, len(BASES))), of(1)).cast("long")


def greatest_kmer_rank(seq: Column | str, k: int) -> Column:
    """Greatest ``kmer_rank`` of a sequence's k-letter stretches, end to end; null if it is shorter than k or null.

    Digits of one length are ordered like their numbers, so only the greatest stretch is made a number.
    """
    return F.conv(F.array_max(F.regexp_extract_all(rank_digits(seq), F.lit(f"([0-3]{{{k}}})"), F.lit(1))), 4, 10).cast("int")


def kmer_ranks(seq: Column | str, k: int) -> Column:
    """Ranks of all k-mers of a sequence, as an expression; empty for sequences shorter than k.

    Linear in the sequence: its digits are an array, read by place.  ``with_kmer_ranks`` does the same
    for whole contigs in Arrow batches, and far quicker.
    """
    digits = F.transform(F.regexp_extract_all(rank_digits(seq), F.lit("([0-3])"), F.lit(1)), lambda d: d.cast("int"))

    def ranks(d: Column) -> Column:
        rank = lambda i: sum((F.get(d, i + j) * 4 ** (k - 1 - j) for j in range(1, k)), F.get(d, i) * 4 ** (k - 1))
        starts = F.sequence(F.lit(0), F.size(d) - k)
        return F.when(F.size(d) >= k, F.transform(starts, lambda i: rank(i).cast("int"))).otherwise(F.array().cast("array<int>"))

    return F.get(F.transform(F.array(digits), ranks), F.lit(0))


#: Digit of every byte: 0-3 for the bases in either case, 0 for whatever else there is.
_DIGIT = np.zeros(256, dtype=np.int64)
for _i, _b in enumerate(BASES):
    _DIGIT[[ord(_b), ord(_b.lower())]] = _i


def rank_lists(seq: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ranks of all k-mers of each sequence: those of sequences shorter than k, and of null, are empty.

    A letter that is no base counts 0, and one place, whatever its bytes.
    """
    texts = [s or "" for s in seq.to_pylist()]
    size = np.array([len(s) for s in texts], dtype=np.int64)
    d = _DIGIT[np.frombuffer("".join(texts).encode("ascii", "replace"), dtype=np.uint8)]
    offsets = np.concatenate([[0], np.cumsum(np.maximum(0, size - k + 1))])
    n = max(0, len(d) - k + 1)
    if not n:
        return offsets, np.zeros(0, dtype=np.int64)
    ranks = sum(d[j : j + n] << 2 * (k - 1 - j) for j in range(k))
    if np.count_nonzero(size) < 2:
        return offsets, ranks
    # Sequences lie end to end: what begins in the last k - 1 letters of one reaches into the next.
    ends, own = np.cumsum(size), np.ones(len(d), dtype=bool)
    for j in range(1, k):
        own[ends[size >= j] - j] = False
    return offsets, ranks[own[:n]]


def with_kmer_ranks(rows: DataFrame, seq: str, k: int, out: str = "ranks") -> DataFrame:
    """``rows`` with the ranks of all k-mers of a sequence, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, ranks = rank_lists(batch.column(batch.schema.get_field_index(seq)), k)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ranks, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def complement(seq: Column | str) -> Column:
    """Upper-case complement; every letter but A, C, G and T gives T."""
    return F.translate(F.regexp_replace(_col(seq), "[^ACGTacgt]", "A"), BASES + BASES.lower(), "TGCATGCA")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def replace_char(s: Column | str, old: str, new: str) -> Column:
    return F.translate(_col(s), old, new)


def kmer_count(k: Column | int) -> Column:
    """4^k, or null where that is more than a model may have."""
    n = F.pow(F.lit(4), F.lit(k) if isinstance(k, int) else k).cast("long")
    return F.when(n <= MOST_KMERS, n)
