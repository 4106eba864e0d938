"""The container over many files: merged columns, block indexes, lookups, undecoded records, refused values."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from squigspark.plans.jobs import convert_job
from squigspark.schemas import RAW_RECORD, READ
from squigspark.sources import codecs, container


def reads(spark, ids, **columns):
    rows = spark.createDataFrame([(i,) for i in ids], "read_id string")
    n = F.length("read_id") + 20
    signal = F.transform(F.sequence(F.lit(1), n), lambda i: (i * 37 % 101).cast("smallint"))
    fixed = [F.lit(0).cast("long").alias("read_group"), *[F.lit(1.5).alias(c) for c in READ.names[2:6]], F.size(signal).cast("long").alias("len_raw_signal"), signal.alias("raw_signal")]
    return rows.select("read_id", *fixed, *[c.alias(k) for k, c in columns.items()])


def save(df, path, **options):
    container.register(df.sparkSession)
    df.write.format("signal").mode("append").options(**options).save(str(path))


def test_columns_of_all_files(spark, tmp_path):
    save(reads(spark, ["a"], n=F.lit(1).cast("int")).coalesce(1), tmp_path / "d")
    save(reads(spark, ["b"], s=F.lit("x"), n=F.lit(2).cast("int")).coalesce(1), tmp_path / "d", container="text")
    for df in (spark.read.format("signal").load(str(tmp_path / "d")), container.read_signal(spark, str(tmp_path / "d"))):
        assert set(df.columns) == {*READ.names, "n", "s"}
        assert {(r.read_id, r.n, r.s) for r in df.collect()} == {("a", 1, None), ("b", 2, "x")}
    with pytest.raises(Exception, match=r"column n is .* in .*part.* and"):
        save(reads(spark, ["c"], n=F.lit("text")), tmp_path / "d")
    save(reads(spark, ["c"], n=F.lit("text")).coalesce(1), tmp_path / "e")
    other = next((tmp_path / "e").glob("*" + container.BINARY_FILE))
    other.rename(tmp_path / "d" / other.name)
    (tmp_path / "e" / (other.name + container.BLOCK_FILE)).rename(tmp_path / "d" / (other.name + container.BLOCK_FILE))
    for load in (lambda p: spark.read.format("signal").load(p), lambda p: container.read_signal(spark, p)):
        with pytest.raises(Exception, match="column n is"):
            load(str(tmp_path / "d"))


def test_a_lookup_opens_one_file_of_many(spark, tmp_path, monkeypatch):
    ids = [f"read-{i:04d}" for i in range(1000)]
    save(reads(spark, ids).repartition(40, "read_id"), tmp_path / "d", block_bytes="400")
    path, schema = str(tmp_path / "d"), spark.read.format("signal").load(str(tmp_path / "d")).schema
    files = len(container.list_files(path))
    assert files > 30
    opened = []
    plain = container.read_header
    monkeypatch.setattr(container, "read_header", lambda stream, binary: opened.append(1) or plain(stream, binary))
    for wanted, most in ((EqualTo(("read_id",), "read-0500"), 2), (In(("read_id",), ("read-0001", "read-0999", "no such")), 4), (EqualTo(("read_id",), "no such"), 1)):
        reader = container.SignalReader({"path": path}, schema)
        assert list(reader.pushFilters([wanted])) == []
        parts = reader.partitions()
        assert len(parts) <= most and all(len(p.blocks) <= 2 for p in parts)
        opened.clear()
        got = {row[0] for p in parts for b in reader.read(p) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)}
        assert got == ({wanted.value} if isinstance(wanted, EqualTo) else set(wanted.value)) - {"no such"}
        assert len(opened) == len(parts)
    assert spark.read.format("signal").load(path).filter("read_id = 'read-0500' AND read_id = 'read-0501'").count() == 0
    assert spark.read.format("signal").load(path).filter("read_id IN ('read-0500', 'read-0777')").count() == 2


def test_blocks_cut_files_by_default(spark, tmp_path):
    save(reads(spark, [f"r{i}" for i in range(300)]).coalesce(1), tmp_path / "d", block_bytes="1000")
    df = spark.read.format("signal").option("split_bytes", str(1 << 26)).load(str(tmp_path / "d"))
    assert df.rdd.getNumPartitions() == 1
    path = container.list_files(str(tmp_path / "d"))[0][0]
    blocks = container.read_blocks(path)
    assert len(blocks) > 5 and blocks[0].offset == container.open_header(path).data_at
    cuts = container.binary_ranges(path, container.list_files(path)[0][1], 2000)
    assert len(cuts) > 3 and cuts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False))
    fine = spark.read.format("signal").option("split_bytes", "2000").load(str(tmp_path / "d"))
    assert fine.rdd.getNumPartitions() == len(cuts)
    assert sorted(r.read_id for r in fine.collect()) == sorted(f"r{i}" for i in range(300))
    assert container.record_index(spark, path).count() == 300
    (tmp_path / "d" / (path.rsplit("/", 1)[1] + container.BLOCK_FILE)).unlink()
    assert sorted(map(tuple, container.record_index(spark, path).select("read_id").collect())) == sorted((f"r{i}",) for i in range(300))


@pytest.mark.parametrize("options", [{"container": "text"}, {"record_press": "none"}, {"record_press": "zlib"}, {"record_press": "zstd", "signal_press": "zlib"}])
def test_records_are_copied_undecoded(spark, tmp_path, options, monkeypatch):
    source = reads(spark, ["a", "b", "c"], n=F.lit(7).cast("int")).coalesce(1)
    save(source, tmp_path / "d", **options, **{"attr.run": "r1"})
    d = str(tmp_path / "d")
    # In one process, with all decoders of signals and records out of reach.
    for name in ("decode_binary", "decode_text", "encode_binary", "encode_text", "compress"):
        monkeypatch.setattr(container, name, lambda *a, **k: pytest.fail("a record was decoded"))
    reader = container.SignalReader({"path": d, "records": "raw"}, RAW_RECORD)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    writer = container.SignalWriter({"path": str(tmp_path / "o"), "records": "raw", "header_of": d}, RAW_RECORD, False)
    writer.commit([writer.write(iter(batches))])
    monkeypatch.undo()
    kind = container.TEXT_FILE if "container" in options else container.BINARY_FILE
    old, new = (next((tmp_path / x).glob("*" + kind)).read_bytes() for x in "do")
    assert old == new
    key = lambda r: r[0]
    load = lambda p: sorted(map(tuple, spark.read.format("signal").load(str(p)).collect()), key=key)
    container.copy_records(spark, d, str(tmp_path / "p"), ids=spark.createDataFrame([("a",), ("c",)], "read_id string"), files=2, record_press=None if "container" in options else "zstd", run="x\ty", more="z")
    assert load(tmp_path / "p") == [r for r in load(d) if r[0] != "b"]
    groups = {r.read_group: r.attrs for r in container.read_groups(spark, str(tmp_path / "p")).collect()}
    assert groups == {0: {"run": "x", "more": "z"}, 1: {"run": "y", "more": ""}}


def test_convert_moves_records_where_only_their_packing_changes(spark, tmp_path, monkeypatch):
    save(reads(spark, ["a", "b"]).coalesce(1), tmp_path / "d", record_press="none", **{"attr.run": "q"})
    from squigspark.plans import jobs

    monkeypatch.setattr(jobs, "read_signal", lambda *a: pytest.fail("records were decoded"))
    convert_job(spark, str(tmp_path / "d"), str(tmp_path / "o"), record_press="zstd")
    assert container.open_header(container.list_files(str(tmp_path / "o"))[0][0]).record_codec == "zstd"
    assert container.read_groups(spark, str(tmp_path / "o")).first().attrs == {"run": "q"}
    assert sorted(map(tuple, spark.read.format("signal").load(str(tmp_path / "o")).collect())) == sorted(map(tuple, spark.read.format("signal").load(str(tmp_path / "d")).collect()))


def test_raw_records_of_different_headers_do_not_mix(spark, tmp_path):
    save(reads(spark, ["a"]).coalesce(1), tmp_path / "d", signal_press="none")
    save(reads(spark, ["b"]).coalesce(1), tmp_path / "d", signal_press="svb-zd")
    with pytest.raises(Exception, match="another header"):
        spark.read.format("signal").option("records", "raw").load(str(tmp_path / "d")).collect()


@pytest.mark.parametrize("kind", ["text", "binary"])
def test_what_a_file_cannot_hold(spark, tmp_path, kind):
    one = reads(spark, ["a"]).coalesce(1)
    enum = {"kind": "enum{low,high}"}
    bad = [("e", F.lit(9).cast("smallint"), enum), ("e", F.array(F.lit(0), F.lit(2)).cast("array<smallint>"), {"kind": "enum{low,high}*"}), ("c", F.lit("two"), {"kind": "char"})]
    if kind == "text":
        bad += [("s", F.lit("a\tb"), {}), ("s", F.lit("a\nb"), {}), ("s", F.lit("."), {})]
    for i, (name, column, metadata) in enumerate(bad):
        with pytest.raises(Exception, match="labels|can't hold|single bytes"):
            save(one.withColumn(name, column.alias(name, metadata=metadata)), tmp_path / str(i), container=kind)
    good = one.select("*", F.lit(1).cast("smallint").alias("e", metadata=enum), F.lit("").alias("s"), F.lit("x").alias("c", metadata={"kind": "char"}), F.lit(None).cast("string").alias("t"))
    save(good, tmp_path / "g", container=kind)
    assert [tuple(r)[8:] for r in spark.read.format("signal").load(str(tmp_path / "g")).collect()] == [(1, None, "x", None)]
    with pytest.raises(Exception, match="line end"):
        save(one, tmp_path / "h", container=kind, **{"attr.run": "a\nb"})


def test_bloom_filters_have_no_false_negatives():
    ids = [f"{i:x}" for i in range(3000)]
    places = container.bloom_places(ids)
    assert places.shape == (3000, container.BLOOM_HASHES) and len(np.unique(places)) == places.size


def test_record_ids_from_the_head_of_a_record():
    h = container.Header(binary=True)
    for codec in ("none", "zlib", "zstd"):
        h.record_codec = codec
        row = ("an id", 0, 1.0, 2.0, 3.0, 4.0, 50_000, np.arange(50_000, dtype=np.int16))
        assert container.record_id(container.encode_binary(row, h)[8:], codec) == "an id"


def test_many_signals_are_packed_as_one_is():
    rng = np.random.default_rng(2)
    signals = [rng.integers(-(2**15), 2**15, int(n)).astype(np.int16) if k % 3 else np.cumsum(rng.integers(-3, 4, int(n))).astype(np.int16) for k, n in enumerate(rng.integers(0, 40, 200))]
    for some in (signals, [], [np.zeros(0, np.int16)] * 3, signals[:1]):
        packed = codecs.pack_signals(some)
        assert packed == [codecs.pack_signal(x) for x in some]
        assert all(np.array_equal(a, b) for a, b in zip(codecs.unpack_signals(packed), some, strict=True))
    with pytest.raises(ValueError, match="controls"):
        codecs.unpack_signals([codecs.pack_signal(signals[1]), codecs.pack_signal(signals[2])[:-1]])


def test_fine_cuts_give_a_bounded_number_of_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(container, "MOST_RANGES", 5)
    save(reads(spark, [f"r{i}" for i in range(400)]).coalesce(2), tmp_path / "d", block_bytes="500")
    container.write_index_files(spark, str(tmp_path / "d")).count()
    df = spark.read.format("signal").option("split_bytes", "600").load(str(tmp_path / "d"))
    reader = container.SignalReader({"path": str(tmp_path / "d"), "split_bytes": "600"}, df.schema)
    parts = reader.partitions()
    assert 4 <= len(parts) <= 8
    assert sorted(row[0] for p in parts for row in reader.rows(p)) == sorted(f"r{i}" for i in range(400))
