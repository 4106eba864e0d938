import pytest
from pyspark.sql import functions as F

from squigspark.functions import arrays, bases, text
from squigspark.options import MapOptions, is_rna, parse_size, pore_of, size_text, yes_or_no


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return rows.select(column.alias("r")).first()["r"]


def test_bases(spark):
    assert one(spark, bases.kmer_rank(F.lit("ACGT"))) == 27
    assert one(spark, bases.kmer_ranks(F.lit("ACGTN"), 4)) == [27, 27 * 4 % 256]
    assert one(spark, bases.kmer_ranks(F.lit("AC"), 4)) == []
    assert one(spark, bases.reverse_complement(F.lit("AACGTN"))) == "TACGTT"
    assert one(spark, bases.complement(F.lit("acgu"))) == "TGCT"
    assert one(spark, bases.base_rank(F.lit("g"))) == 2
    assert one(spark, bases.base_rank(F.lit("N"))) == 0
    assert one(spark, bases.kmer_count(9)) == 262144
    assert one(spark, bases.kmer_count(10)) is None


def test_medians_and_quantiles(spark):
    x = F.array(*map(F.lit, [5, 1, 4, 2]))
    assert one(spark, arrays.upper_median(x)) == 4
    assert one(spark, arrays.kth_smallest(x, 1)) == 2
    assert one(spark, arrays.quantile(x, 0.5)) == 3.0
    assert one(spark, arrays.mad(x)) == pytest.approx(2 * 1.4826)
    assert one(spark, arrays.mad(F.array(F.lit(7)))) == 0
    assert one(spark, arrays.mean(F.array().cast("array<float>"))) is None
    assert one(spark, arrays.stdev_pop(x, "double")) == pytest.approx((10 / 4) ** 0.5)
    assert one(spark, arrays.clamp_outliers(F.array(F.lit(-5.0), F.lit(2000.0)))) == [0.0, 1200.0]


def test_native_dtw(spark):
    x, y = ([float(v) for v in s] for s in ([1, 2, 3, 2], [0, 1, 1.5, 3, 5, 1, 2, 3, 2, 0]))
    got = one(spark, arrays.dtw_last_row("x", "y"), x=x, y=y)
    assert got == [8, 4, 2.5, 1.5, 3.5, 3.5, 1, 1, 0, 2]
    assert one(spark, arrays.dtw_last_row("x", "y", subsequence=False), x=x, y=y) == [8, 5, 3.5, 2.5, 4.5, 4.5, 4.5, 5.5, 5.5, 7.5]
    minima = one(spark, arrays.chunk_minima(F.col("row"), 4), row=got)
    assert [(m.score, m.pos) for m in minima] == [(1.5, 3), (1.0, 6), (0.0, 8)]


@pytest.mark.parametrize(("x", "want"), [(8192.0, "8192"), (1467.61, "1467.61"), (-0.0, "0"), (0.1, "0.1"), (None, "."), (100.0, "100"), (0.0000001, "0")])
def test_number_text(spark, x, want):
    assert one(spark, text.number_text(F.lit(x).cast("double"))) == want


@pytest.mark.parametrize(("s", "s2", "want"), [(42.0, 43.0, 12), (10.0, 20.0, 60), (0.0, 1.0, 60), (0.0, 0.0, 0), (5.0, None, 60)])
def test_mapping_quality(spark, s, s2, want):
    assert one(spark, text.mapping_quality(F.lit(s), F.lit(s2).cast("double"))) == want


def test_residues(spark):
    assert one(spark, text.residue_count(F.lit(250), F.lit(25.0), F.lit(250))) == 225


def test_checked_numbers(spark):
    assert one(spark, text.checked_integer(F.lit("-12"))) == -12
    assert one(spark, text.checked_integer(F.lit("."))) is None
    assert one(spark, text.checked_float(F.lit("1.5"))) == 1.5
    for bad in ("012", "1e5", "x", ""):
        with pytest.raises(Exception, match="not a number"):
            one(spark, text.checked_integer(F.concat(F.lit(bad))))
    with pytest.raises(Exception, match="not a number"):
        one(spark, text.checked_float(F.lit("1e5")))


def test_names_and_versions(spark):
    assert one(spark, text.is_identifier(F.lit("_a1")))
    assert not one(spark, text.is_identifier(F.lit("1a")))
    assert one(spark, text.version_at_least(F.lit("0.2.0"), (0, 2, 0)))
    assert not one(spark, text.version_at_least(F.lit("0.1.9"), (0, 2, 0)))


def test_options(spark):
    assert parse_size("20M") == 20_000_000
    assert parse_size("1.5k") == 1500
    assert yes_or_no("yes") and not yes_or_no("no")
    assert size_text(1500) == "1.5 kB"
    assert one(spark, pore_of(F.lit("SQK-LSK114"))) == "r10"
    assert one(spark, pore_of(F.lit("sqk-rna004"))) == "rna004"
    assert one(spark, is_rna(F.lit("rna")))
    for bad in ({"standard": True}, {"prefix": -1}, {"rna": True, "pore": "r10"}, {"rna": True, "prefix": -1, "from_end": True}, {"pore": "x"}, {"query": 0}):
        with pytest.raises(ValueError):
            MapOptions(**bad)
    assert MapOptions(rna=True, prefix=-1).kmer_length == 5


def test_sums_and_greatest_ranks_of_whole_texts(spark):
    from pyspark.sql import functions as F

    from squigspark.functions import bases

    texts = [None, "", "acgt", "ACGTAC", "tttttt", "xx\nGGTTAA99cc\U0001f600tgca", "0123gattaca" * 7, "ſé ctg\tTG" * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    ranks = F.aggregate(F.split("t", ""), F.lit(0).cast("long"), lambda a, c: a + bases.base_rank(c))
    greatest = F.array_max(F.transform(F.regexp_extract_all("t", F.lit("(?s)(.{6})"), F.lit(1)), bases.kmer_rank))
    for r in df.select("i", ranks.alias("a"), bases.rank_sum("t").alias("b"), greatest.alias("c"), bases.greatest_kmer_rank("t", 6).alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d)
