import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from squigspark.operators import evaluate, mapping, reference
from squigspark.options import MapOptions, model_name
from squigspark.plans.jobs import detect_options, eval_job, map_job
from squigspark.schemas import READ
from squigspark.sources import codecs, container
from squigspark.sources.tables import parse_paf, read_bed, read_fasta, read_kmer_model


def test_varbytes_golden():
    data = codecs.pack_varbytes(np.array([0, 100, 200, 300, 400, 500, 600, 700]))
    assert data[4:].hex(" ") == "40 55 00 64 c8 2c 01 90 01 f4 01 58 02 bc 02"
    assert codecs.unpack_varbytes(data).tolist() == [0, 100, 200, 300, 400, 500, 600, 700]
    with pytest.raises(ValueError):
        codecs.unpack_varbytes(data + b"x")


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_signal_codec(n):
    x = np.random.default_rng(n).integers(-32768, 32767, n).astype("<i2")
    for codec in ("none", "zlib", "zstd", "svb-zd"):
        assert codecs.decompress(codecs.compress(x.tobytes(), codec), codec) == x.tobytes()


def reads(spark):
    rows = [("a", 0, 8192.0, 6.0, 1467.61, 4000.0, 4, [430, 472, 463, 467], 1, 2.5, "x", [1, None]), ("b", 1, 1.0, 0.0, 1.0, 1.0, 0, [], None, None, None, None), ("c", 0, 2.0, -1.0, 3.0, 5.0, 2, [-5, 32767], 7, -1.25, "yz", [])]
    return spark.createDataFrame(rows, "read_id string, read_group long, digitisation double, offset double, range double, sampling_rate double, len_raw_signal long, raw_signal array<smallint>, n int, f double, s string, l array<bigint>")


@pytest.mark.parametrize("options", [{"container": "text"}, {"container": "binary"}, {"container": "binary", "record_press": "none", "signal_press": "none"}, {"container": "binary", "record_press": "zstd", "signal_press": "svb-zd"}])
def test_container_round_trip(spark, tmp_path, options):
    container.register(spark)
    path = str(tmp_path / "out")
    reads(spark).coalesce(1).write.format("signal").mode("append").options(**options).option("attr.run", "r1\tr2").save(path)
    back = spark.read.format("signal").option("split_bytes", "40").load(path)
    got = sorted(map(tuple, back.collect()), key=lambda r: r[0])
    want = [tuple(None if i == 11 and not v else v for i, v in enumerate(r)) for r in map(tuple, reads(spark).collect())]
    assert got == want
    assert [r.read_id for r in back.filter("read_id = 'c'").collect()] == ["c"]
    assert spark.read.format("signal").option("columns", "read_id,n").load(path).columns == ["read_id", "n"]
    groups = container.read_groups(spark, path).orderBy("read_group").collect()
    assert [(g.read_group, g.attrs) for g in groups] == [(0, {"run": "r1"}), (1, {"run": "r2"})]
    if options["container"] == "binary":
        index = container.record_index(spark, path)
        assert container.duplicate_ids(index).count() == 0
        found = container.fetch(index.filter("read_id = 'a'"), back.schema).collect()
        assert [tuple(r)[:8] for r in found] == [want[0][:8]]


def test_only_committed_files_are_read(spark, tmp_path):
    """Twins and lost attempts write files of their own; an aborted job leaves nothing."""
    container.register(spark)
    path = str(tmp_path / "out")
    df = reads(spark).coalesce(1)
    batch = df.toArrow().to_batches()
    for kind in ("text", "binary"):
        writer = container.SignalWriter({"path": f"{path}-{kind}", "container": kind}, df.schema, False)
        first, twin = writer.write(iter(batch)), writer.write(iter(batch))
        with pytest.raises(RuntimeError):
            writer.write(lost(batch))
        writer.commit([first])
        late = writer.write(iter(batch))  # a slow twin that ends after the commit
        assert first.rows == twin.rows == late.rows == 3
        assert sorted(r.read_id for r in spark.read.format("signal").load(f"{path}-{kind}").collect()) == ["a", "b", "c"]
        failed = container.SignalWriter({"path": f"{path}-{kind}", "container": kind}, df.schema, False)
        failed.abort([failed.write(iter(batch)), None])
        assert spark.read.format("signal").load(f"{path}-{kind}").count() == 3


def lost(batches):
    yield from batches
    raise RuntimeError("the executor is gone")


@pytest.mark.parametrize("kind", ["text", "binary"])
def test_nulls_are_written(spark, tmp_path, kind):
    container.register(spark)
    rows = [("a", None, None, None, 1.0, None, None, None), ("b", 1, 1.0, 0.0, 1.0, 1.0, 2, [1, 2])]
    df = spark.createDataFrame(rows, READ)
    df.write.format("signal").mode("append").option("container", kind).save(str(tmp_path / "o"))
    got = {r.read_id: r for r in spark.read.format("signal").load(str(tmp_path / "o")).collect()}
    assert got["a"].raw_signal == [] and got["a"].len_raw_signal == 0 and got["a"].read_group == 0
    assert np.isnan(got["a"].digitisation) and got["a"].range == 1.0 and got["b"].raw_signal == [1, 2]
    with pytest.raises(Exception, match="no id"):
        df.withColumn("read_id", F.lit(None).cast("string")).write.format("signal").mode("append").option("container", kind).save(str(tmp_path / "p"))


@pytest.mark.parametrize("options", [{"signal_press": "none"}, {"signal_press": "svb-zd", "record_press": "zstd"}])
def test_index_files_cut_binary_containers(spark, tmp_path, options):
    container.register(spark)
    path = str(tmp_path / "o")
    many = spark.range(500).select(F.concat(F.lit("r"), "id").alias("read_id"), F.lit(0).cast("long").alias("read_group"), *[F.lit(1.0).alias(c) for c in READ.names[2:6]], F.lit(2).cast("long").alias("len_raw_signal"), F.array(F.lit(1).cast("smallint"), (F.col("id") % 99).cast("smallint")).alias("raw_signal"), F.array("id").alias("ids"))
    many.coalesce(2).write.format("signal").mode("append").options(**options).save(path)
    assert spark.read.format("signal").option("split_bytes", "3000").load(path).rdd.getNumPartitions() == 2
    assert sum(r.records for r in container.write_index_files(spark, path).collect()) == 500
    back = spark.read.format("signal").option("split_bytes", "3000").load(path)
    assert back.rdd.getNumPartitions() > 6
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, many.collect()))
    one = container.list_files(path)[0][0]
    assert [r[0] for r in container.read_index_file(one)] == [r.read_id for r in container.record_index(spark, one).orderBy("offset").collect()]
    with open(one + container.INDEX_FILE, "r+b") as f:
        f.truncate(100)
    with pytest.raises(ValueError, match="cut off"):
        container.read_index_file(one)


def test_columns_that_are_not_asked_for_are_not_decoded(spark, tmp_path, monkeypatch):
    h = container.Header(aux=container.parse_aux("\t" * 8 + "int32_t*\tchar*\tdouble", "\t" * 8 + "l\ts\tf"), binary=True, signal_codec="svb-zd")
    data = container.encode_binary(("a", 0, 1.0, 2.0, 3.0, 4.0, 3, [1, 2, 3], [7, 8], "text", 2.5), h)[8:]
    row = container.decode_binary(data, h)
    assert row[7].tolist() == [1, 2, 3] and row[8:] == ([7, 8], "text", 2.5)
    monkeypatch.setattr(container, "decompress", lambda d, codec: d if codec == "none" else pytest.fail("the signal was unpacked"))
    assert container.decode_binary(data, h, None, frozenset(["read_id", "f"])) == ("a", 0, 1.0, 2.0, 3.0, 4.0, None, None, None, None, 2.5)


def test_text_container_by_hand(spark, tmp_path):
    container.register(spark)
    p = tmp_path / f"x{container.TEXT_FILE}"
    p.write_text(
        container.TEXT_HEAD.format("0.2.0", 1) + "@experiment_type\trna\n@sequencing_kit\tsqk-rna004\n" + container.FIXED_TYPES + "\tenum{A,B}\tuint8_t\n" + container.FIXED_NAMES + "\te\tu\n"
        "r0\t0\t8192\t6\t1467.61\t4000\t4\t430,472,463,467\t1\t255\n"
    )
    row = spark.read.format("signal").load(str(p)).first()
    assert (row.read_id, row.raw_signal, row.e, row.u) == ("r0", [430, 472, 463, 467], 1, None)
    assert spark.read.format("signal").load(str(p)).schema["e"].metadata["labels"] == ["A", "B"]
    opt = detect_options(spark, str(p))
    assert opt.rna and opt.pore == "rna004"
    with pytest.raises(ValueError, match="newer"):
        container.check_version((0, 3, 0))


def test_cut_off_binary(spark, tmp_path):
    container.register(spark)
    reads(spark).coalesce(1).write.format("signal").mode("append").save(str(tmp_path / "o"))
    f = next((tmp_path / "o").glob("*" + container.BINARY_FILE))
    f.write_bytes(f.read_bytes()[:-5])
    with pytest.raises(Exception, match="cut off"):
        spark.read.format("signal").load(str(f)).collect()


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first contig\r\nACGT\r\nAC\r\n>two\nGG\n")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@q1 c\nACG\n+\n@@I\n@q2\nTT\n+\nII\n")
    rows = [tuple(r) for r in read_fasta(spark, str(tmp_path)).orderBy("ref_idx").collect()]
    assert rows[:2] == [(0, "one", "first contig", "ACGTAC"), (1, "two", None, "GG")]
    assert rows[-1][1:] == ("q2", None, "TT")


def test_kmer_model(spark, tmp_path):
    (tmp_path / "m.txt").write_text("#k\t1\nkmer\tlevel_mean\tlevel_stdv\nA\t1\t2\nC\t3\t4\nG\t5\t6\nT\t7\t8\n")
    assert [(r.rank, r.kmer, r.level_mean) for r in read_kmer_model(spark, str(tmp_path / "m.txt")).orderBy("rank").collect()] == [(0, "A", 1.0), (1, "C", 3.0), (2, "G", 5.0), (3, "T", 7.0)]
    (tmp_path / "n.txt").write_text("#k\t2\nAA\t1\t2\n")
    with pytest.raises(ValueError, match="rows"):
        read_kmer_model(spark, str(tmp_path / "n.txt"))


def test_bed(spark, tmp_path):
    (tmp_path / "r.bed").write_text("chr1\t5\t10\n")
    assert read_bed(spark, str(tmp_path / "r.bed")).first().region == "chr1:5-10"
    (tmp_path / "bad.bed").write_text("chr1\t10\t5\n")
    with pytest.raises(Exception, match="malformed"):
        read_bed(spark, str(tmp_path / "bad.bed")).collect()


LINE = "r\t100\t1\t90\t{s}\tt\t500\t{a}\t{b}\t50\t60\t{q}\ttp:A:{tp}"


def pafs(spark, *rows):
    return parse_paf(spark.createDataFrame([(LINE.format(**dict(zip(("s", "a", "b", "q", "tp"), r, strict=True))),) for r in rows], "value string"))


def test_paf_parse(spark):
    rows = spark.createDataFrame([("r\t1\t2\t3\t+\t\tt\t5\t6\t7\t8\t9\t10\ttp:A:S\td1:f:1.50\ttp:A:P\r",), ("short\t1",)], "value string")
    got = parse_paf(rows, mode="DROPMALFORMED").collect()
    assert len(got) == 1 and (got[0].tid, got[0].tp, got[0].d1, got[0].mapq) == ("t", "P", 1.5, 10)
    with pytest.raises(Exception, match="malformed"):
        parse_paf(rows).collect()


def test_evaluation(spark):
    truth = pafs(spark, ("+", 100, 200, 60, "P"), ("+", 1000, 1100, 60, "S"))
    test = pafs(spark, ("+", 150, 900, 60, "P"), ("+", 1000, 1100, 255, "P"), ("-", 100, 200, 5, "P"))
    s = evaluate.summary(truth, test).first()
    assert (s.truth_rec, s.truth_mapped, s.test_mapped, s.correct, s.incorrect, s.only_in_test) == (2, 1, 3, 2, 1, 0)
    assert evaluate.summary(truth, test, evaluate.EvalOptions(secondary=False)).first().correct == 1
    assert {(r.mapq, r.n_correct, r.n_incorrect) for r in evaluate.mapq_histogram(truth, test).collect()} == {(60, 1, 0), (None, 1, 0), (5, 0, 1)}
    empty = truth.limit(0)
    assert evaluate.summary(empty, test).first().only_in_test == 3
    assert evaluate.summary(truth, empty).first().correct_pct is None


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("limits", [(64, 10_000), (0, 10_000), (0, 0), (40, 10_000)])
def test_evaluation_against_pairs(spark, seed, limits, monkeypatch):
    """Reads gathered, looked up by stretches, and both."""
    monkeypatch.setattr(evaluate, "GATHERED", limits[0])
    monkeypatch.setattr(evaluate, "MOST_SET_APART", limits[1])
    rng = np.random.default_rng(seed)
    row = lambda n: [(f"r{rng.integers(3)}", f"t{rng.integers(2)}", "+-"[rng.integers(2)], int(a), int(a + rng.integers(50, 400)), "PS"[rng.integers(2)], i) for i, a in enumerate(rng.integers(-300, 5000, n))]
    kind = "rid string, tid string, strand string, target_start int, target_end int, tp string, n int"
    a, b = row(120), [*row(120), ("r9", "t0", "+", 0, 1, "P", 500), (None, "t0", "+", 0, 1, "P", 501), ("r0", "t0", "+", None, None, "P", 502)]
    for opt in (evaluate.EvalOptions(), evaluate.EvalOptions(secondary=False, threshold=37), evaluate.EvalOptions(tid_only=True), evaluate.EvalOptions(threshold=0)):
        got = {r.n: r.outcome for r in evaluate.classify(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), opt).collect()}
        for r in b:
            same = [t for t in a if t[0] == r[0]]
            ok = [t for t in same if t[1:3] == r[1:3] and (opt.secondary or t[5] == r[5]) and (opt.tid_only or r[3] is not None and min(abs(t[3] - r[3]), abs(t[4] - r[4])) < opt.threshold)]
            assert got[r[6]] == ("correct" if ok else "incorrect" if same else "only_in_test")


def planted(spark, k=5):
    """Contigs from a fixed pattern, and reads that follow their levels."""
    rng = np.random.default_rng(3)
    contigs = spark.createDataFrame([(i, f"c{i}", "".join(rng.choice(list("ACGT"), 400))) for i in range(3)], "ref_idx int, name string, seq string")
    model = reference.model_from_rule(spark, k)
    refs = reference.synthetic_references(contigs, model, k)
    raw = {(r.ref_idx, r.strand): r.levels for r in reference.synthetic_references(contigs, model, k, normalise="none").collect()}
    rows = []
    for i in range(3):
        for s in "+-":
            x = np.repeat(np.array(raw[i, s][100:220]), 8) * 10 + rng.integers(-5, 5, 960)
            rows.append((f"{i}{s}", 0, 1.0, 0.0, 0.1, 4000.0, 960, [int(v) for v in x]))
    rows.append(("empty", 0, 1.0, 0.0, 0.1, 4000.0, 0, []))
    return spark.createDataFrame(rows, READ), refs, contigs


def test_planted_reads_map_home(spark):
    reads_, refs, _ = planted(spark)
    for opt in (MapOptions(prefix=5, query=90), MapOptions(prefix=5, query=90, reference_bytes=4000), MapOptions(prefix=5, query=80, from_end=True)):
        rows = mapping.map_reads(reads_, refs, opt).collect()
        assert len(rows) == 6
        for r in rows:
            assert r.tid == f"c{r.rid[0]}" and r.strand == r.rid[1]
            # The reads cover k-mers 100 to 219 of their strand; 396 k-mers in all.
            low, high = (100, 220) if r.strand == "+" else (396 - 220, 396 - 100)
            assert low - 3 <= r.target_start < r.target_end <= high + 3
            assert r.mapq > 0


@pytest.mark.parametrize("options", [{}, {"standard": True}, {"invert": True}, {"full_ref": True}, {"from_end": True}])
def test_rna(spark, options):
    """RNA passes the pore from its 3' end, so its signal is the reference's levels backwards."""
    k, n = 5, 60
    rng = np.random.default_rng(4)
    contigs = spark.createDataFrame([(i, f"c{i}", "".join(rng.choice(list("ACGU"), 300))) for i in range(4)], "ref_idx int, name string, seq string")
    model = reference.model_from_rule(spark, k)
    opt = MapOptions(rna=True, prefix=0, query=n, rna_letters=True, **options)
    make = lambda **o: reference.synthetic_references(contigs, model, k, rna=True, rna_letters=True, **o)
    refs = make(full=opt.full_ref, query_size=n, from_end=opt.from_end, invert=opt.invert)
    rows = []
    for r in make(full=True, normalise="none").collect():
        levels = r.levels[:70] if opt.from_end else r.levels[-70:]
        x = np.repeat(np.array(levels[::-1]), 20) * 10
        rows.append((r.name, 0, 1.0, 0.0, 0.1, 4000.0, len(x), [int(v) for v in x]))
    got = mapping.map_reads(spark.createDataFrame(rows, READ), refs, opt).collect()
    assert len(got) == 4 and all(r.strand == "+" for r in got)
    if not opt.standard:
        assert all(r.tid == r.rid for r in got)
    if not options:
        assert all(r.target_end >= 280 and r.target_start >= 200 for r in got)


def test_blocks_give_the_same(spark):
    reads_, refs, _ = planted(spark)
    a, b = (sorted(map(tuple, mapping.map_reads(reads_, refs, MapOptions(prefix=5, query=60, reference_bytes=n)).collect())) for n in (1, 1 << 28))
    assert a == b


@pytest.mark.parametrize("options", [{}, {"sam": True}, {"rna": True}, {"rna": True, "standard": True}])
@pytest.mark.parametrize("width", [37, 100, 395])
def test_tiles_give_the_same(spark, options, width):
    """Whatever the tiles' width and the blocks, ties of chunks at borders included."""
    reads_, refs, _ = planted(spark)
    if options.get("rna"):
        refs = refs.filter("strand = '+'")
    made = [mapping.map_reads(reads_, refs, MapOptions(prefix=5, query=60, **options, **cut)).drop("n_events") for cut in ({}, {"tile_columns": width, "reference_bytes": 3000})]
    a, b = (sorted(map(str, df.collect())) for df in made)
    assert a == b and len(a) == 6


@pytest.mark.parametrize("size", [3, 50, 1000])
def test_tiles_from_parts_of_contigs(spark, size):
    """Levels of parts, shorter ones than a k-mer too, are those of whole contigs; reads map alike."""
    reads_, refs, contigs = planted(spark)
    rows = [(r.ref_idx, r.name, k, at, r.seq[at : at + size]) for r in contigs.collect() for k, at in enumerate(range(0, 400, size))] + [(7, "short", 0, 0, "ACG"), (8, "none", 0, 0, ""), (9, "flat", 0, 0, "AAAAA"), (9, "flat", 1, 5, "A")]
    parts = spark.createDataFrame(rows, "ref_idx int, name string, part long, start long, seq string")
    model = reference.model_from_rule(spark, 5)
    for normalise in ("strand", "global", "none"):
        tiles = reference.tiles_of_parts(parts, model, 5, normalise=normalise).collect()
        whole = {(r.ref_idx, r.strand): r.levels for r in reference.synthetic_references(contigs.unionByName(spark.createDataFrame([(9, "flat", "AAAAAA")], "ref_idx int, name string, seq string")), model, 5, normalise=normalise).collect()}
        for key, levels in whole.items():
            own = sorted((t.column, t.levels) for t in tiles if (t.ref_idx, t.strand) == key)
            assert [c for c, _ in own] == [sum(len(x) for _, x in own[:i]) for i in range(len(own))]
            got = [v for _, x in own for v in x]
            assert [v is None for v in got] == [v is None for v in levels] and np.allclose([v or 0 for v in got], [v or 0 for v in levels], atol=1e-5)
        assert {t.ref_idx for t in tiles} == {0, 1, 2, 9}
    opt = MapOptions(prefix=5, query=60, reference_bytes=2000)
    near = ["rid", "strand", "tid", "target_start", "target_end", "query_start", "query_end"]
    if size > 3:
        tiles = reference.tiles_of_parts(parts.filter("ref_idx < 3"), model, 5)
        a, b = (sorted(map(tuple, df.select(*near).collect())) for df in (mapping.map_reads(reads_, refs, opt), mapping.map_reads(reads_, None, opt, tiles=tiles)))
        assert a == b


@pytest.mark.parametrize("block,size", [(4, 3), (8, 3), (8, 50), (64, 7), (64, 64), (1 << 20, 7)])
def test_tiles_where_parts_pass_blocks(spark, monkeypatch, block, size):
    """A part's last k-mers reach into the next ones, in whatever blocks these lie; empty parts between count nothing."""
    monkeypatch.setattr(reference, "BLOCK_LETTERS", block)
    _, _, contigs = planted(spark)
    rows = [(r.ref_idx, r.name, 2 * k, at, r.seq[at : at + size]) for r in contigs.collect() for k, at in enumerate(range(0, 400, size))]
    rows += [(r[0], r[1], r[2] + 1, r[3] + len(r[4]), "") for r in rows] + [(9, "none", 0, 0, None)]
    model = reference.model_from_rule(spark, 5)
    tiles = reference.tiles_of_parts(spark.createDataFrame(rows, "ref_idx int, name string, part long, start long, seq string"), model, 5, normalise="none").collect()
    whole = reference.synthetic_references(contigs, model, 5, normalise="none").collect()
    for r in whole:
        own = sorted((t.column, t.width, t.levels) for t in tiles if (t.ref_idx, t.strand, t.ref_len, t.seq_len) == (r.ref_idx, r.strand, r.ref_len, r.seq_len))
        assert [v for _, _, x in own for v in x] == r.levels
        assert [(c, w) for c, w, _ in own] == [(sum(len(x) for _, _, x in own[:i]), len(own[i][2])) for i in range(len(own))]
    assert len(tiles) == sum(len({t.column for t in tiles if (t.ref_idx, t.strand) == (r.ref_idx, r.strand)}) for r in whole)


def test_parts_are_made_once(spark):
    _, _, contigs = planted(spark)
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    parts = contigs.select("ref_idx", "name", F.posexplode(F.regexp_extract_all("seq", F.lit("(.{1,40})"), F.lit(1))).alias("part", "seq")).withColumn("start", F.col("part") * 40)
    parts = parts.mapInArrow(counted, parts.schema)
    assert reference.tiles_of_parts(parts, reference.model_from_rule(spark, 5), 5).count() == 60
    assert made.value == 30


def test_candidates_over_tiles_with_ties(spark):
    rng = np.random.default_rng(6)
    levels = [float(x) for x in rng.integers(0, 3, 90)]
    refs = spark.createDataFrame([(i, f"c{i}", 90, 94, 0, s, levels[::-1] if s == "-" else levels) for i in range(2) for s in "+-"], "ref_idx int, name string, ref_len int, seq_len int, st_offset int, strand string, levels array<float>")
    queries = spark.createDataFrame([(i, [float(x) for x in rng.integers(0, 3, int(n))]) for i, n in enumerate(rng.integers(1, 14, 40))] + [(99, None)], "id int, query array<float>")
    for more in ({}, {"rna": True, "standard": True}):
        got = [sorted(map(str, mapping.with_candidates(queries, refs, MapOptions(**more, **cut)).select("id", "candidates").collect())) for cut in ({}, {"tile_columns": 1, "reference_bytes": 200}, {"tile_columns": 13, "reference_bytes": 100}, {"tile_columns": 89})]
        assert all(g == got[0] for g in got)


def test_levels_are_made_once(spark, tmp_path):
    """However many blocks there are, the references' own plan runs once."""
    reads_, refs, _ = planted(spark)
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    refs = refs.mapInArrow(counted, refs.schema)
    assert mapping.map_reads(reads_, refs, MapOptions(prefix=5, query=60, reference_bytes=1)).count() == 6
    assert made.value == 6


def test_map_job_and_report(spark, tmp_path):
    container.register(spark)
    reads_, _, contigs = planted(spark)
    reads_.coalesce(1).write.format("signal").mode("append").option("attr.experiment_type", "genomic_dna").save(str(tmp_path / "reads"))
    (tmp_path / "ref.fa").write_text("".join(f">{r.name}\n{r.seq}\n" for r in contigs.orderBy("ref_idx").collect()))
    model = reference.model_from_rule(spark, 6).orderBy("rank").collect()
    (tmp_path / "model.txt").write_text("#k\t6\n" + "".join(f"{m.kmer}\t{m.level_mean}\t{m.level_stdv}\n" for m in model))
    (tmp_path / "models").mkdir()
    (tmp_path / "models" / "dna_r9.model").write_text((tmp_path / "model.txt").read_text())
    for sam in (False, True):
        opt = MapOptions(prefix=5, query=90, sam=sam, reference_bytes=3000 if sam else 1 << 28)
        seen = map_job(spark, str(tmp_path / "ref.fa"), str(tmp_path / "reads"), str(tmp_path / ("models" if sam else "model.txt")), str(tmp_path / f"out{sam}"), opt)
        staged = mapping.with_query(mapping.with_events(mapping.with_signal(spark.read.format("signal").load(str(tmp_path / "reads")))), opt)
        counted = {r.status: (r.reads, 2 * r.samples) for r in mapping.status_counts(staged).collect()}
        assert seen["reads"] == sum(n for n, _ in counted.values()) == 7 and seen["bytes"] == sum(b for _, b in counted.values())
        assert all(seen[k] == counted.get(k, (0, 0))[0] for k in ("prefix_fail", "ignored", "too_short", "no_signal"))
    with pytest.raises(ValueError, match="no RNA model"):
        model_name("r10", True)
    paf = str(tmp_path / "outFalse")
    assert spark.read.text(paf).count() == 6
    sam = [r.value for r in spark.read.text(str(tmp_path / "outTrue" / "records")).collect()]
    assert len(sam) == 6 and all("ss:Z:" in s and s.split("\t")[1] in ("0", "16") for s in sam)
    assert spark.read.text(str(tmp_path / "outTrue" / "header")).count() == 4
    lines = [r.value for r in eval_job(spark, paf, paf).collect()]
    assert "Correct\t6\t100.00%" in lines


def test_streaming(spark, tmp_path):
    from squigspark.streaming.jobs import accuracy_stream, map_stream

    reads_, refs, _ = planted(spark)
    reads_.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(READ).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    opt = MapOptions(prefix=5, query=60)
    q = map_stream(stream, refs, opt).writeStream.format("memory").queryName("mapped").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    batch = mapping.map_reads(reads_, refs, opt)
    assert sorted(map(tuple, spark.table("mapped").collect())) == sorted(map(tuple, batch.collect()))
    batch.write.parquet(str(tmp_path / "paf"))
    s = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "paf"))
    q = accuracy_stream(batch, s).writeStream.outputMode("complete").format("memory").queryName("acc").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("acc").agg(F.sum("count")).first()[0] == 6


def test_convert(spark, tmp_path):
    from squigspark.plans.jobs import convert_job

    container.register(spark)
    reads(spark).coalesce(1).write.format("signal").mode("append").option("container", "text").option("attr.run", "a").save(str(tmp_path / "t"))
    convert_job(spark, str(tmp_path / "t"), str(tmp_path / "b"), record_press="zstd")
    a, b = (sorted(map(tuple, spark.read.format("signal").load(str(tmp_path / x)).collect()), key=lambda r: r[0]) for x in "tb")
    assert a == b and container.read_groups(spark, str(tmp_path / "b")).first().attrs == {"run": "a"}
