"""Intervals, masks, planes, bitmaps, records from lines and streams, xz blocks, joins by place, block text and free names."""

import hashlib
import lzma
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from allelix import queries
from allelix.fixtures import sequence_cells
from allelix.functions import masks
from allelix.model import Alignment, samples_of
from allelix.operators import blocks, crosstable, intervals, pairs, running, select, triangle
from allelix.plans import preprocess
from allelix.sinks import block_text, files, text
from allelix.sources import lines, lists, sequences, xz
from allelix.streaming import records


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def cells_of(spark, rows):
    return sequence_cells(spark.createDataFrame(list(enumerate(rows)), "sample_id long, sequence string"))


def members(rows):
    out = {}
    for s, a, b in rows:
        out.setdefault(s, set()).update(range(a, b + 1))
    return out


def runs(sets):
    out = []
    for s, own in sorted(sets.items()):
        for v in sorted(own):
            if out and out[-1][0] == s and out[-1][2] == v - 1:
                out[-1][2] = v
            else:
                out.append([s, v, v])
    return [tuple(r) for r in out]


#: Touching, nested, equal, empty and single intervals.
FIRST = [(0, 1, 3), (0, 4, 6), (0, 10, 20), (0, 12, 13), (0, 30, 29), (0, 40, 40), (0, 40, 40), (1, 5, 2), (2, 0, 99), (4, 64, 127), (4, 0, 31)]
SECOND = [(0, 3, 4), (0, 20, 41), (1, 1, 1), (2, 20, 30), (2, 50, 49), (2, 99, 120), (3, 7, 8)]


@pytest.mark.parametrize("seed", [None, 1])
def test_intervals(spark, seed):
    r = random.Random(seed)
    a, b = (FIRST, SECOND) if seed is None else ([(r.choice([0, 0, 1, 2]), x := r.randrange(300), x + r.randrange(-2, 40)) for _ in range(n)] for n in (60, 40))
    x, y = members(a), members(b)
    a, b = (spark.createDataFrame(rows, "set_id int, first long, last long").repartition(3) for rows in (a, b))
    both = lambda f: runs({k: f(x.get(k, set()), y.get(k, set())) for k in x.keys() | y.keys()})
    assert values(intervals.fused(a)) == runs(x)
    assert values(intervals.fused(a, b)) == both(set.union)
    assert values(intervals.intersection(a, b)) == both(set.intersection)
    assert values(intervals.difference(a, b)) == both(set.difference)
    shown = intervals.hybrid_text(intervals.fused(a))
    assert values(intervals.from_hybrid_text(shown)) == runs(x)
    if seed is None:
        assert dict(values(shown))[4] == "0-20,40-80" and dict(values(shown))[2] == "0-60,60:f"
    assert intervals.fused(a.limit(0)).count() == 0 and intervals.intersection(a, b.limit(0)).count() == 0


def test_hybrid_text_of_no_set_raises(spark):
    bad = spark.createDataFrame([(0, "0:f,3x")], "set_id int, text string")
    with pytest.raises(Exception, match="no piece of a set"):
        intervals.from_hybrid_text(bad).collect()


def test_masks(spark):
    r = random.Random(2)
    rows = [[r.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 3, 3)] + [[0], [-1], [0, 1]]
    df = spark.createDataFrame([(m, k) for m in rows for k in (0, 1, 5, 31, 63, 64, 70, 191)], "m array<long>, k int")
    m, k = F.col("m"), F.col("k")
    for row in df.select("m", "k", masks.count(m).alias("n"), masks.rank(m, k).alias("rank"), masks.select(m, k).alias("at"), masks.is_set(m, k).alias("set"), masks.ones(m).alias("ones")).collect():
        ones = [64 * w + b for w, x in enumerate(row["m"]) for b in range(64) if x >> b & 1]
        assert (row["n"], row["ones"], row["set"]) == (len(ones), ones, row["k"] in ones)
        assert (row["rank"], row["at"]) == (sum(x < row["k"] for x in ones), ones[row["k"]] if row["k"] < len(ones) else None)


@pytest.mark.parametrize("length", [40, 150, 700])
def test_planes_in_blocks(spark, monkeypatch, length):
    """Alignments of one row, and of several rows, a sample, with ragged ends and holes."""
    monkeypatch.setattr(pairs, "BLOCK_WORDS", 4)
    r = random.Random(length)
    rows = ["".join(r.choices("atcg-", k=length - 30 * (k % 3 == 0))) for k in range(9)]
    cells = cells_of(spark, rows).where("sample_id <> 5 OR locus % 3 = 0 AND locus > 300 OR locus = 1")
    own = {i: {} for i in range(9)}
    for i, locus, state in values(cells, "sample_id", "locus", "state"):
        own[i][locus] = state
    want = [(i, j, sum(own[j].get(x) == s for x, s in own[i].items()), min(len(own[i]), len(own[j]))) for i in range(9) for j in range(i)]
    assert values(pairs.identities(cells, length), "i", "j", "same", "shorter") == want
    w = dict(values(pairs.sample_weights(cells, samples_of(cells), length, 0.3), "sample_id", "weight"))
    near = lambda i: 1 + sum(n >= 0.3 * m and m > 0 for a, b, n, m in want if i in (a, b))
    assert w == pytest.approx({i: 1 / near(i) for i in range(9)})


def test_long_alignment_has_a_plan_of_fixed_width(spark):
    cells = spark.range(150_000).selectExpr("explode(array(1L, 2L, 3L)) AS sample_id", "cast(id AS int) AS locus").selectExpr("sample_id", "locus", "cast(locus * sample_id % 5 AS int) AS state")
    found = values(pairs.distances(cells, 150_000, 3), "i", "j", "distance")
    assert found == [(2, 1, 120_000), (3, 1, 120_000), (3, 2, 120_000)]
    assert len(pairs.packed(cells, 10**6).columns) == len(pairs.packed(cells, 10**7).columns) == 3 + 4 * 32


def test_common_segments_are_cut_into_blocks(spark, monkeypatch):
    """All samples share most segments, and each key's rows meet in blocks of four."""
    monkeypatch.setattr(pairs, "BLOCK_SAMPLES", 4)
    r, rows = random.Random(4), []
    for _ in range(40):
        row = list("acgt" * 8)
        for _ in range(r.randint(0, 5)):
            row[r.randrange(32)] = r.choice("acgt")
        rows.append("".join(row))
    want = []
    for i in range(40):
        for j in range(i):
            same = sum(a == b for a, b in zip(rows[i], rows[j], strict=True))
            if same >= 0.9 * 32:
                want.append((i, j, same, 32))
    assert values(pairs.similar_pairs(cells_of(spark, rows), 32, 0.9), "i", "j", "same", "shorter") == want


def test_histogram_lines(spark):
    from allelix.operators import histogram

    bins = histogram.histogram(spark.createDataFrame([(x,) for x in (0.1, 0.12, 0.3, 0.3)], "x double"), "x", 0.1)
    shown = {x["bin"]: x["line"] for x in histogram.csv_lines(bins, 0.1).collect()}
    assert shown == {1: "0.110 2.000 0.000 11.000 0.050", 3: "0.300 2.000 0.000 0.000 0.050"}


def test_identical_samples_are_not_paired(spark):
    rows = ["acgt" * 5] * 30 + ["acgt" * 4 + "aaaa"] * 20 + ["tttt" * 5]
    cells = cells_of(spark, rows)
    for truncate in (False, True):
        w = values(pairs.sample_weights(cells, samples_of(cells), 20, 0.85, truncate=truncate), "sample_id", "weight")
        assert [x for _, x in w] == pytest.approx([1 / 50] * 50 + [1.0])
    odd = samples_of(cells).withColumn("multiplicity", F.col("sample_id") + 1)
    total = sum(range(1, 51))
    assert [x for _, x in values(pairs.sample_weights(cells, odd, 20, 0.85), "sample_id", "weight")] == pytest.approx([(i + 1) / total for i in range(50)] + [1.0])


@pytest.mark.parametrize("block", [512, 3])
def test_crosstable_by_bitmaps(spark, monkeypatch, block):
    monkeypatch.setattr(crosstable, "BLOCK_LOCI", block)
    r = random.Random(block)
    rows = ["".join(r.choices("atcg-", k=10 - (k % 4 == 0))) for k in range(150)]
    cells, weight = cells_of(spark, rows), [0.5 * (k % 3) + 0.25 for k in range(150)]
    weights = spark.createDataFrame(list(enumerate(weight)), "sample_id long, weight double")
    want = {}
    for row, w in zip(rows, weight, strict=True):
        for i in range(len(row)):
            for j in range(i + 1, len(row)):
                key = (i, j, "atcg-".index(row[i]), "atcg-".index(row[j]))
                want[key] = want.get(key, 0) + w
    got = crosstable.crosstable(cells, weights, dense=False, init=1.0)
    assert {tuple(x)[:4]: x["weight"] for x in got.collect()} == pytest.approx({k: v + 1 for k, v in want.items()})
    some = crosstable.crosstable(cells, weights, F.col("locus_i").isin(1, 8), F.col("locus_j") >= 4)
    assert {tuple(x)[:4]: x["weight"] for x in some.where("weight > 0").collect()} == pytest.approx({k: v for k, v in want.items() if k[0] in (1, 8) and k[1] >= 4})
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "locus" in plan and "CartesianProduct" not in some._jdf.queryExecution().toString()


FASTA = "junk\n>s1 desc > x\nACGT-\nNNac\n>s2\nacgta\nac gt>two é > z\n\nac\n>three\n>four"
RECORDS = [(0, "s1 desc > x", "ACGT-NNac"), (1, "s2", "acgtaacgt"), (2, "two é > z", "ac"), (3, "three", ""), (4, "four", "")]


def test_records_of_lines(spark):
    rows = [("a", k, v) for k, v in enumerate(FASTA.split("\n"))] + [("b", 0, "left out"), ("b", 1, "tail>n"), ("b", 2, "a>c")]
    df = spark.createDataFrame(rows, "file string, ord long, value string").repartition(4)
    assert values(lines.records_of_lines(df), "sample_id", "name", "body") == [*RECORDS, (5, "n", "a"), (6, "c", "")]


def read_stream(chunks):
    reader, out = records.Reader(), {}
    for seq, text_ in chunks:
        for record, start, name, body in reader.take(seq, text_, seq == len(chunks) - 1):
            own = out.setdefault(record, ["", ""])
            own[0] = own[0] if name is None else name
            assert not body or start == len(own[1])
            own[1] += body
    assert not reader.early
    return [(k, *v) for k, v in sorted(out.items())]


def test_stream_cut_anywhere():
    assert read_stream([(0, FASTA)]) == RECORDS and read_stream(list(enumerate(FASTA))) == RECORDS
    for i in range(len(FASTA) + 1):
        assert read_stream([(0, FASTA[:i]), (1, FASTA[i:])]) == RECORDS
        j = min(i + 7, len(FASTA))
        assert read_stream([(1, FASTA[i:j]), (2, FASTA[j:]), (0, FASTA[:i])]) == RECORDS


def test_stream_over_micro_batches(spark, tmp_path):
    cut = [FASTA[k : k + 9] for k in range(0, len(FASTA), 9)]
    rows = [(name, k, c, k == len(cut) - 1) for name in ("a", "b") for k, c in enumerate(cut)]
    df = spark.createDataFrame(rows, "stream string, seq long, chunk string, last boolean")
    for k in range(3):
        df.where(F.pmod("seq", F.lit(3)) == 2 - k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = records.assembled(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    assert len(q.recentProgress) >= 3
    back = records.records_of(spark.read.parquet(str(tmp_path / "out")))
    assert values(back, "stream", "record", "name", "body") == [(s, *r) for s in "ab" for r in RECORDS]


def test_xz_of_many_blocks_and_streams(spark, tmp_path, monkeypatch):
    """Streams one behind the other, with padding, are as many blocks; a line may go over their ends, and be longer than a piece."""
    monkeypatch.setattr(xz, "STEP", 64)
    rows = [(f"n{k}", "".join(random.Random(k).choices("acgt", k=200))) for k in range(40)]
    data = "".join(f">{n}\n{b[:150]}\n{b[150:]}\n" for n, b in rows).encode()
    path = tmp_path / "many.fasta.xz"
    path.write_bytes(b"".join(lzma.compress(data[k : k + 333]) + b"\0" * (4 * (k % 2)) for k in range(0, len(data), 333)))
    raw = path.read_bytes()
    found = xz.blocks(lambda at, n: raw[at : at + n], len(raw))
    assert len(found) == -(-len(data) // 333)
    assert b"".join(p for b in found for p in xz.unpacked(lambda at, n: raw[at : at + n], *b)) == data
    assert values(sequences.read_records(spark, str(path)), "sample_id", "name", "body") == [(k, n, b) for k, (n, b) in enumerate(rows)]
    with pytest.raises(ValueError):
        xz.blocks(lambda at, n: data[at : at + n], len(data))


def test_xz_memory_is_flat():
    """A file that unpacks to 1 GB is decoded in pieces."""
    packer = lzma.LZMACompressor(preset=0)
    line = b"acgtacgtacgtacg" * 4 + b"\n"
    part = line * (1 << 14)
    raw = bytearray()
    n = (1 << 30) // len(part)
    for _ in range(n):
        raw += packer.compress(part)
    raw = bytes(raw + packer.flush())
    (block,) = xz.blocks(lambda at, size: raw[at : at + size], len(raw))
    assert block[3] == n * len(part)
    tracemalloc.start()
    seen = 0
    for k, p in enumerate(xz.unpacked(lambda at, size: raw[at : at + size], *block)):
        seen += len(p)
        if k < 20:
            assert all(len(t) == 60 for t, ends in xz.line_pieces([p[p.index(b"\n") + 1 : p.rindex(b"\n") + 1]]) if ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == block[3] and peak < 64 << 20


def test_rows_by_place(spark):
    a, b = spark.createDataFrame([(v,) for v in (5, 1, 9)], "a int"), spark.createDataFrame([(v,) for v in (7, 3, 8)], "b int")
    assert values(running.zipped(a, ["a"], b, ["b"])) == [(0, 1, 3), (1, 5, 7), (2, 9, 8)]
    with pytest.raises(Exception, match="these differ in length"):
        running.zipped(a, ["a"], b.where("b > 3"), ["b"], "these").collect()
    assert values(running.running_chunks(spark.createDataFrame([("a", 3), ("a", 70_000), ("b", 1), ("a", 200_000)], "g string, k long"), "k", {"sum": F.col("k")}, ["g"])) == [("a", 3, 3), ("a", 70_000, 70_003), ("a", 200_000, 270_003), ("b", 1, 1)]
    big = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(5)
    assert values(running.running(big, ["v"], {"sum": F.col("v"), "n": F.lit(1)}), "v", "sum", "n") == [(v, v * (v + 1) // 2, v + 1) for v in range(1000)]


def test_lists_over_lines(spark, tmp_path):
    (tmp_path / "l").write_text("3 5-7\n\n 1-0 9\n2 4x 8\n1")
    assert values(lists.read_loci(spark, str(tmp_path / "l"), 1), "ord", "locus") == [(0, 2), (1, 4), (2, 5), (3, 6), (4, 8), (5, 1)]
    (tmp_path / "e").write_text("")
    assert lists.read_loci(spark, str(tmp_path / "e")).count() == 0 and lists.read_values(spark, str(tmp_path / "e")).count() == 0


def test_block_text(spark, tmp_path):
    r = random.Random(5)
    base = ["".join(r.choices("acgt-", k=70)) for _ in range(3)]
    cells = cells_of(spark, [r.choice(base) for _ in range(20)])
    named = samples_of(cells).withColumn("name", F.concat(F.lit('a<"&amp;>'), "name")).withColumn("weight", F.lit(0.25))
    loci = select.numbered(cells.select((F.col("locus") * 2 + F.when(F.col("locus") > 40, 100).otherwise(0)).alias("locus")).distinct())
    path = text.write_lines(block_text.lines(Alignment(cells, named, "x & y", translation=loci)), str(tmp_path / "b"), "part", "block", "first")
    back = block_text.read(spark, path)
    assert back.name == "x & y" and values(back.translation) == values(loci)
    assert values(back.cells) == values(cells) and values(back.samples, "sample_id", "name", "multiplicity", "weight") == values(named, "sample_id", "name", "multiplicity", "weight")
    first = [x[0] for x in spark.read.text(path).collect()]
    assert first[0] == '<alignment id="x &amp; y">' and first[-1] == "</alignment>" and len(first) == 22 + blocks.dictionary(blocks.words(blocks.sequences_of(cells))).count()
    with pytest.raises(ValueError):
        block_text.read(spark, str(tmp_path / "b" / "_SUCCESS"))


def test_free_names(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [spark.createDataFrame([(v,)], "line string") for v in "abc"]
    assert [files.write_free(r, path) for r in rows] == [path, f"{path}.1", f"{path}.2"]
    assert [spark.read.text(p).first()[0] for p in (path, f"{path}.1", f"{path}.2")] == ["a", "b", "c"]
    assert not [p for p in tmp_path.iterdir() if "writing" in p.name]


def fasta_file(path, rows):
    path.write_text("".join(f">n{k}\n{x}\n" for k, x in enumerate(rows)))
    return str(path)


def test_filter_sees_all_samples_before_some_are_chosen(spark, tmp_path):
    path = fasta_file(tmp_path / "in.fasta", ["a" * 10] * 10 + ["t" * 10] * 10)
    (tmp_path / "samples").write_text("1 20")
    o = preprocess.Options(sample_list=str(tmp_path / "samples"), maf=0.3)
    found = preprocess.prepare(spark, path, o)
    assert found.cells.count() == 20 and values(found.samples, "sample_id", "name") == [(0, "n0"), (1, "n19")]
    # One sample in ten has another state: common among all by no means, whatever is chosen afterwards.
    path = fasta_file(tmp_path / "rare.fasta", ["a" * 4] * 18 + ["t" * 4] * 2)
    (tmp_path / "samples").write_text("1 20")
    assert preprocess.prepare(spark, path, o).cells.count() == 0


def test_weights_of_another_length_raise(spark, tmp_path):
    path = fasta_file(tmp_path / "in.fasta", ["acgt", "tgca", "acca"])
    alignment = preprocess.prepare(spark, path, preprocess.Options(filter=False))
    (tmp_path / "w").write_text("0.5\n0.25 1")
    good = preprocess.weighed(spark, alignment, preprocess.Options(sample_weights=str(tmp_path / "w")))
    assert values(good.samples, "sample_id", "weight") == [(0, 0.5), (1, 0.25), (2, 1.0)]
    (tmp_path / "w2").write_text("0.5\n0.25")
    with pytest.raises(Exception, match="differ in length"):
        preprocess.weighed(spark, alignment, preprocess.Options(sample_weights=str(tmp_path / "w2"))).samples.collect()
    (tmp_path / "m").write_text("1-3")
    with pytest.raises(ValueError, match="3 entries, the alignment 4 loci"):
        preprocess.prepare(spark, path, preprocess.Options(mapping_list=str(tmp_path / "m")))
    (tmp_path / "m4").write_text("11 13 15 17")
    mapped = preprocess.prepare(spark, path, preprocess.Options(mapping_list=str(tmp_path / "m4"), filter=False, begin=2, end=3))
    assert values(mapped.translation, "ord", "locus") == [(0, 12), (1, 14)]


def test_command_line(spark, tmp_path, capsys):
    r = random.Random(3)
    one, two = (fasta_file(tmp_path / f"{n}.fasta", ["".join(r.choices("acgt", k=40)) for _ in range(12)]) for n in ("one", "two"))
    out = str(tmp_path / "out")
    arguments = [one, two, "--folder", out, "-v", "--output-sample-weights", "--output-block-text", "--begin", "3", "--end", "20", "--maf-threshold", "0.05"]
    names, again = preprocess.main(arguments), preprocess.main(arguments[1:])
    assert len(set(names + again)) == 6 and [n + ".1" for n in names[2:]] == again
    shown = capsys.readouterr().out
    assert "12 samples and 18 positions" in shown and "bits/variable" in shown and names[0] in shown
    assert block_text.read(spark, names[1]).translation.count() == 18
    for bad in (["--maf-threshold", "2"], ["--begin", "9", "--end", "3"], ["--input-indexing-base", "-1"]):
        with pytest.raises(SystemExit):
            preprocess.main([one, *bad])
    alignment = preprocess.prepare(spark, one, preprocess.Options(filter=False))
    edges = spark.createDataFrame([(0, 39, 1.0, False)], "i long, j long, weight double, flag boolean")
    assert [preprocess.distances(alignment, edges, preprocess.Options(linear=k)).first()["distance"] for k in (False, True)] == [1, 39]


def test_strict_maf(spark):
    cells = cells_of(spark, ["aa-", "at-", "aa-"])
    assert select.snp_filter(cells, samples_of(cells), 0.0, 1.0).count() == 3
    assert values(select.snp_filter(cells, samples_of(cells), 0.0, 1.0, maf_strict=True)) == [(1,)]


@pytest.mark.parametrize("length", [20, 300])
def test_triangle_of_blocks_is_the_triangle_of_pairs(spark, monkeypatch, length):
    """Ragged samples with wide ids in several blocks, some samples without cells: the lines of the table of pairs, and no such table in the plan."""
    r = random.Random(length)
    monkeypatch.setattr(triangle, "MOST", 4)
    monkeypatch.setattr(pairs, "BLOCK_WORDS", 4)
    rows = [(s * 7 - 30, k, r.randrange(5)) for s in range(11) for k in range(length - 3 * (s % 3))]
    cells = spark.createDataFrame(rows, "sample_id long, locus int, state int").repartition(3)
    samples = spark.createDataFrame([(s * 7 - 30,) for s in range(11)] + [(1,), (1000,)], "sample_id long")
    found = text.distance_triangle(cells, samples, length)
    assert values(found) == values(text.triangle(pairs.distances(cells, length), samples))
    query = queries.distance_triangle_text(spark, "/root/testdata/sf0.001")
    assert " distance#" not in query._jdf.queryExecution().optimizedPlan().toString()


def test_documents_as_fasta_keep_empty_and_null_texts_and_no_cells(spark, tmp_path):
    texts = [(1, "Act\ngX"), (2, ""), (3, None), (4, ">a\n>t"), (5, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.fasta_roundtrip(spark, str(tmp_path))
    want = ["act-g-", "", None, "-a--t", ""]
    digest = lambda x: x if x is None else hashlib.md5(x.encode()).hexdigest()
    assert values(found) == [(k + 1, x if x is None else len(x), digest(x)) for k, x in enumerate(want)]
    assert "posexplode(split(sequence" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["hamming_distance", "pair_diagnostics", "similar_pairs"])
def test_tiles_are_never_broadcast(spark, name):
    """The copies of packed rows look as small as the rows themselves, which would let them be broadcast through the driver."""
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_samples_are_sent_to_few_blocks(spark, monkeypatch):
    """A sample is sent once a block: 1,055 times for 540,000 samples before, 66 times now; and shares are those of plain rounding."""
    assert [pairs.n_blocks(n) for n in (1, 513, 90_000, 540_000, 10**7)] == [1, 2, 64, 66, 1221]
    monkeypatch.setattr(pairs, "BLOCK_SAMPLES", 3)
    monkeypatch.setattr(pairs, "BLOCKS", 2)
    monkeypatch.setattr(pairs, "MOST_SAMPLES", 4)
    found = pairs.identities(cells_of(spark, ["atcg-a"[: 6 - k % 3] + "at"[k % 2] for k in range(13)]), 7, 13).cache()
    share = F.round(pairs.fraction(F.col("same"), F.col("shorter")), 6)
    assert pairs.n_blocks(13) == 4 and found.count() == 78
    assert values(pairs.shares(found, 7, 6)) == values(found.select("i", "j", share.alias("identity")))


def test_bit_fields_are_read_as_runs(spark, monkeypatch):
    """A field of 31 members was 31 intervals of the sweep, now one; any field gives its members."""
    r, taken = random.Random(8), []
    plain = intervals.fused
    monkeypatch.setattr(intervals, "fused", lambda a, b=None: taken.append(a) or plain(a, b))
    fields = [0x7FFFFFFF, 0xFFFFFFFF, 1, 1 << 31, 0xAAAAAAAA, *(r.getrandbits(32) for _ in range(20))]
    texts = spark.createDataFrame([(k, f"40:{x:x}") for k, x in enumerate(fields)], "set_id int, text string")
    want = runs({k: {64 + b for b in range(32) if x >> b & 1} for k, x in enumerate(fields)})
    assert values(intervals.from_hybrid_text(texts)) == want == values(taken[0])


def test_running_sums_deal_rows_once(spark, monkeypatch):
    """Groups of null are a group, and the rows meet their carry where the window left them: one exchange for both."""
    monkeypatch.setattr(running, "CHUNK", 4)
    rows = [(g, k, k % 3) for g in (None, 1, 2) for k in range(10)]
    found = running.running_chunks(spark.createDataFrame(rows, "g int, k long, x long"), "k", {"s": F.col("x")}, ["g"])
    assert sorted((r["g"] or 0, r["k"], r["s"]) for r in found.collect()) == [(g, k, sum(i % 3 for i in range(k + 1))) for g in (0, 1, 2) for k in range(10)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "coalesce(g#" not in plan and "isnull(g#" not in plan
