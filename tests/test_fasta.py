"""FASTA by byte ranges, FASTQ by the length of qualities."""

import gzip
import random

import pytest

from squigspark.sources.tables import read_fasta, read_fasta_parts, read_fastq


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def contigs(seed):
    rnd = random.Random(seed)
    return [(f"c{i}", rnd.choice([None, "some words", "x"]), "".join(rnd.choices("ACGTN", k=rnd.choice([0, 1, 5, 60, 400, 1500])))) for i in range(12)]


def write(path, rows, width=31, end="\n", opened=open):
    with opened(path, "wt", newline="") as f:
        for name, comment, seq in rows:
            f.write(f">{name}{' ' + comment if comment else ''}{end}")
            for i in range(0, len(seq), width):
                f.write(seq[i : i + width] + end)


@pytest.mark.parametrize("part_bases", [10, 100, 1 << 20])
def test_ranges_give_the_contigs(spark, tmp_path, small_ranges, part_bases):
    a, b, c = contigs(1), contigs(2), contigs(3)
    write(tmp_path / "a.fa", a)
    write(tmp_path / "b.fa", b, width=7, end="\r\n")
    write(tmp_path / "c.fa.gz", c, opened=gzip.open)
    parts = read_fasta_parts(spark, str(tmp_path), part_bases)
    assert parts.rdd.getNumPartitions() >= 1
    rows = parts.orderBy("ref_idx", "part").collect()
    assert len({r.ref_idx for r in rows}) == 36
    for i, (name, comment, seq) in enumerate(a + b + c):
        own = [r for r in rows if r.ref_idx == i]
        assert [r.part for r in own] == list(range(len(own))) and {(r.name, r.comment) for r in own} == {(name, comment)}
        assert "".join(r.seq for r in own) == seq
        assert [r.start for r in own] == [sum(len(q.seq) for q in own[:k]) for k in range(len(own))]
    assert [tuple(r) for r in read_fasta(spark, str(tmp_path)).orderBy("ref_idx").collect()] == [(i, *c) for i, c in enumerate(a + b + c)]


def test_a_file_uses_many_tasks(spark, tmp_path, small_ranges):
    write(tmp_path / "a.fa", [("long", None, "ACGT" * 5000)])
    lines = spark.read.text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 100
    assert sum(len(r.seq) for r in read_fasta_parts(spark, str(tmp_path)).collect()) == 20_000


def test_fastq_qualities_may_look_like_headers(spark, tmp_path, small_ranges):
    (tmp_path / "a.fq").write_text("@q1 first\nACGT\nAC\n+\n@@II\n+I\n\n@q2\nGG\n+q2\n>@\n@q3\n\n+\n\n@q4\nT\n+\n+\n")
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write("@z\r\nAAA\r\n+\r\n@>+\r\n")
    write(tmp_path / "c.fa", [("c", None, "GG")])
    got = [tuple(r)[1:] for r in read_fastq(spark, str(tmp_path)).orderBy("file", "at").collect()]
    assert got == [(0, "q1", "first", "ACGTAC"), (1, "q2", None, "GG"), (2, "q3", None, ""), (3, "q4", None, "T"), (0, "z", None, "AAA")]
    assert [tuple(r)[:2] for r in read_fasta(spark, str(tmp_path)).orderBy("ref_idx").collect()] == [(0, "c"), (1, "q1"), (2, "q2"), (3, "q3"), (4, "q4"), (5, "z")]


def test_fastq_under_another_name_is_an_error(spark, tmp_path):
    (tmp_path / "a.fa").write_text("@q1\nACGT\n+\nIIII\n")
    with pytest.raises(Exception, match="named .fq or .fastq"):
        read_fasta_parts(spark, str(tmp_path)).collect()


def test_no_contigs(spark, tmp_path):
    (tmp_path / "a.fa").write_text("")
    assert read_fasta(spark, str(tmp_path)).count() == 0
