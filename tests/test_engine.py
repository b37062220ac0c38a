"""Small literal cases with results worked out by hand or by brute force."""

import gzip
import itertools
import lzma
import random

import pytest
from pyspark.sql import functions as F

from allelix.fixtures import sequence_cells
from allelix.functions import labels
from allelix.functions import states as st
from allelix.functions import vectors as vec
from allelix.model import Alignment, samples_of
from allelix.operators import blocks, crosstable, frequencies, graph, histogram, pairs, select, sets
from allelix.plans import preprocess
from allelix.sinks import text
from allelix.sources import lists, sequences
from allelix.streaming import counts as streaming


def cells_of(spark, rows):
    return sequence_cells(spark.createDataFrame(list(enumerate(rows)), "sample_id long, sequence string"))


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_states(spark):
    df = spark.createDataFrame([(c,) for c in "aTcGn-é"] + [("",), (None,)], "c string")
    assert [r[0] for r in df.select(st.to_state(F.col("c"))).collect()] == [0, 1, 2, 3, 4, 4, 4, 4, 4]
    assert [r[0] for r in spark.range(6).select(st.to_symbol(F.col("id").cast("int"))).collect()] == list("atcg--")


FASTA = ">s1 desc > x\nACGT-\nNNac\n>s2\nacgta\nccgg\n"


@pytest.mark.parametrize("end", ["", ".gz", ".xz"])
def test_fasta(spark, tmp_path, end):
    path = tmp_path / f"basic.fasta{end}"
    data = FASTA.encode()
    path.write_bytes({"": data, ".gz": gzip.compress(data), ".xz": lzma.compress(data)}[end])
    found = sequences.read_alignment(spark, str(path))
    assert found.name == "basic" and found.n_original_positions == 9
    rows = blocks.sequences_of(found.cells, st.to_symbol(F.col("state"))).join(found.samples, "sample_id")
    assert values(rows, "sample_id", "name", "sequence") == [(0, "s1 desc > x", "acgt---ac"), (1, "s2", "acgtaccgg")]


def test_fasta_records(spark, tmp_path):
    path = tmp_path / "odd.fasta"
    path.write_text(">one\nac gt>two\nac\n>three\n")
    assert values(sequences.read_records(spark, str(path)), "sample_id", "name", "body") == [(0, "one", "acgt"), (1, "two", "ac"), (2, "three", "")]
    (tmp_path / "empty.fasta").write_text("")
    with pytest.raises(ValueError):
        sequences.read_alignment(spark, str(tmp_path / "empty.fasta"))
    with pytest.raises(ValueError):
        sequences.read_alignment(spark, str(path), strict=True)
    with pytest.raises(ValueError):
        sequences.read_alignments(spark, ["a", "b"])


def test_fasta_order(spark, tmp_path):
    rows = ["".join(random.Random(k).choices("acgt", k=50)) for k in range(300)]
    path = tmp_path / "many.fasta"
    path.write_text("".join(f">n{k}\n{r}\n" for k, r in enumerate(rows)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        found = values(sequences.read_records(spark, str(path)), "sample_id", "name", "body")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == [(k, f"n{k}", r) for k, r in enumerate(rows)]


def test_lists(spark, tmp_path):
    (tmp_path / "l.txt").write_text("1 3-5\n9 7 3\n6-2")
    assert values(lists.read_loci(spark, str(tmp_path / "l.txt"), 1), "ord", "locus") == list(enumerate([0, 2, 3, 4, 8, 6, 2]))
    (tmp_path / "v.txt").write_text("1 0.5\n2.5e-1")
    assert values(lists.read_values(spark, str(tmp_path / "v.txt")), "ord", "value") == [(0, 1.0), (1, 0.5), (2, 0.25)]
    df = spark.createDataFrame([('"a\'b" c',), ("'x\"y'",), ("z",)], "q string")
    assert [r[0] for r in df.select(lists.quoted(F.col("q"))).collect()] == ["a'b", 'x"y', ""]


@pytest.mark.parametrize("length", [5, 31, 32, 33, 64, 65])
def test_identities(spark, length):
    r = random.Random(length)
    rows = ["".join(r.choices("atcg-", k=length - (k % 3 == 0))) for k in range(12)]
    cells = cells_of(spark, rows)
    want = sorted((i, j, sum(x == y for x, y in zip(rows[i], rows[j], strict=False)), min(len(rows[i]), len(rows[j]))) for i in range(12) for j in range(i))
    assert values(pairs.identities(cells, length), "i", "j", "same", "shorter") == want


def test_tiles_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_SAMPLES", 5)
    rows = ["".join(random.Random(k).choices("atcg-", k=20)) for k in range(23)]
    found = values(pairs.identities(cells_of(spark, rows), 20), "i", "j")
    assert found == [(i, j) for i in range(23) for j in range(i)]


@pytest.mark.parametrize("threshold", [0.8, 0.9, 0.95])
def test_similar_pairs(spark, threshold):
    r = random.Random(3)
    base = ["".join(r.choices("atcg-", k=64)) for _ in range(4)]
    rows = []
    for k in range(40):
        x = list(r.choice(base))
        for _ in range(r.randint(0, 9)):
            x[r.randrange(64)] = r.choice("atcg")
        rows.append("".join(x)[: 64 - 3 * (k % 7 == 0)])
    rows += rows[:3]
    want = []
    for i, j in itertools.combinations(range(len(rows)), 2):
        same, n = sum(a == b for a, b in zip(rows[i], rows[j], strict=False)), min(len(rows[i]), len(rows[j]))
        if same >= threshold * n:
            want.append((j, i, same, n))
    assert values(pairs.similar_pairs(cells_of(spark, rows), 64, threshold), "i", "j", "same", "shorter") == sorted(want)


def test_weights(spark):
    cells = cells_of(spark, ["acgtacgtac"] * 3 + ["tttttttttt"])
    w = pairs.sample_weights(cells, samples_of(cells), 10, 0.9)
    assert [round(x[1], 6) for x in values(w, "sample_id", "weight")] == [0.333333] * 3 + [1.0]
    assert sum(x[0] for x in values(pairs.rescaled(w), "weight")) == pytest.approx(4)


def test_frequencies(spark):
    cells = cells_of(spark, ["aat-", "act-", "ag--"])
    found = {(r["locus"], r["state"]): r["n"] for r in frequencies.counts(cells).collect()}
    assert len(found) == 20 and found[0, 0] == 3 and found[2, 4] == 1 and found[1, 1] == 0
    sums = frequencies.frequencies(cells, samples_of(cells)).groupBy("locus").agg(F.sum("freq").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in sums)
    e = dict(values(frequencies.entropies(cells, samples_of(cells)), "locus", "entropy"))
    assert e[0] == 0 and e[1] == pytest.approx(1.0986123)
    assert values(frequencies.presence(cells), "locus", "mask", "n_states", "mask_wo_gap", "gap_bit")[2] == (2, 18, 2, 2, 16)


def test_selection(spark):
    cells = cells_of(spark, ["acgt", "tgca"])
    loci = lists.loci_from(spark, [3, 0, 3])
    assert values(select.subset(cells, loci).where("sample_id = 0"), "locus", "state") == [(0, 1), (1, 0), (2, 1)]
    kept = select.include(cells, loci).count() + select.exclude(cells, loci).count()
    assert kept == cells.count()
    order = lists.loci_from(spark, list(range(10, 14)))
    assert values(select.combine(order, loci), "ord", "locus") == [(0, 13), (1, 10), (2, 13)]
    assert values(select.numbered(spark.createDataFrame([(v,) for v in (9, 1, 5)], "locus long")), "ord", "locus") == [(0, 1), (1, 5), (2, 9)]
    assert select.filter_name(0.01, 0.15) == "filtered_ge001maf_le015gf_gt01-lt05states"


def test_crosstable(spark):
    rows = ["acg", "act", "gcg", "-ct"]
    cells = cells_of(spark, rows)
    weights = spark.createDataFrame([(k, 0.5 + k) for k in range(4)], "sample_id long, weight double")
    found = {tuple(r)[:4]: r["weight"] for r in crosstable.crosstable(cells, weights).collect()}
    assert len(found) == 75 and found[0, 1, 0, 2] == 2.0 and found[0, 2, 3, 3] == 2.5 and found[1, 2, 2, 1] == 5.0
    sparse = crosstable.crosstable(cells, weights, dense=False)
    assert sum(r["weight"] for r in sparse.collect()) == pytest.approx(sum(found.values()))


def test_histogram(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.014, 0.015, 0.02, -0.015)], "x double")
    bins = histogram.histogram(df, "x", 0.01)
    assert values(bins, "bin", "cnt") == [(-2, 1), (1, 1), (2, 2)]
    assert values(histogram.cumulative(bins), "bin", "running") == [(-2, 1), (1, 2), (2, 4)]
    assert histogram.csv_lines(bins, 0.01).count() == 3
    m = histogram.moments(bins).first()
    assert m["cnt"] == 4 and m["mean"] == pytest.approx(0.0085)


def test_sets(spark):
    df = spark.createDataFrame([([1, 2, 3, 15, 16, 17], [3, 4, 17])], "a array<int>, b array<int>")
    p = df.select(sets.split(F.col("a"), F.col("b")).alias("p")).first()["p"]
    assert (p["only_a"], p["only_b"], p["both"]) == ([1, 2, 15, 16], [4], [3, 17])
    long = spark.createDataFrame([(0, x) for x in (1, 2, 3, 15, 16, 17, 511)], "set_id int, member int")
    assert values(sets.range_text(long), "text") == [("1-3,f-11,1ff",)]
    runs = spark.createDataFrame([(0, k, v) for k, v in enumerate("aabbbа")], "g int, k int, v string")
    coded = sets.run_lengths(runs, "g", ["k"], "v")
    assert values(sets.decoded(coded, "g", "v"), "place", "v") == list(enumerate("aabbbа"))


def test_graph(spark):
    e = graph.build(spark.createDataFrame([(5, 1, 2.0), (1, 2, 2.0), (3, 4, 9.0)], "i int, j int, weight double"))
    assert [tuple(r)[:2] for r in graph.ordered(e).collect()] == [(3, 4), (1, 2), (1, 5)]
    assert values(graph.nodes(e, lambda x: x["weight"] < 5), "locus") == [(1,), (2,), (5,)]
    out = graph.output(e, spark.range(10).select(F.col("id").alias("ord"), F.col("id").alias("locus")), 6)
    assert values(out, "pos1", "pos2", "distance", "weight")[1] == (2, 6, 2, "2.000000")


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0, 2.0], 5)], "v array<double>, mask int")
    row = df.select(vec.sum_xlogx(F.col("v")), vec.total(vec.masked(F.col("v"), F.col("mask"))), vec.norm(F.col("v")), vec.circular_distance(F.lit(1), F.lit(9), F.lit(10))).first()
    assert [round(x, 6) for x in row] == [1.386294, 3.0, 2.236068, 2]


def test_labels():
    assert labels.Threshold(">=2").safe == "ge02" and labels.Threshold().safe == "gt01"
    with pytest.raises(ValueError):
        labels.Threshold("1>").safe  # noqa: B018
    assert labels.memory_string(2048) == "2KiB" and labels.time_string(5e6) == "5ms"


def test_plan(spark, tmp_path):
    r = random.Random(1)
    rows = ["".join(r.choices("acgt", k=12)) + "a" for _ in range(30)]
    (tmp_path / "in.fasta").write_text("".join(f">n{k}\n{x}\n" for k, x in enumerate(rows)))
    o = preprocess.Options(state_frequencies=True, weights=True, distance_matrix=True, alignment=True, rescale=True)
    preprocess.run(spark, str(tmp_path / "in.fasta"), str(tmp_path / "out"), o)
    name = f"in.{select.filter_name(0.01, 0.15)}"
    read = lambda end: [r[0] for r in spark.read.text(str(tmp_path / "out" / f"{name}.{end}")).collect()]
    assert [int(x) for x in read("loci")] == list(range(1, 13))  # the constant last locus is filtered
    assert sum(float(x) for x in read("weights")) == pytest.approx(30)
    assert read("distances")[0] == "n=30" and len(read("fasta")) == 60 and len(read("frequencies.txt")) == 12
    assert not [p for p in (tmp_path / "out").iterdir() if "working" in p.name]
    a = preprocess.prepare(spark, str(tmp_path / "in.fasta"), o)
    saved = str(tmp_path / "saved")
    sequences.save(a, saved)
    assert sequences.load(spark, saved).cells.count() == a.cells.count() == 360
    assert text.triangle(pairs.distances(a.cells, 12), a.samples).count() == 30


def test_streaming(spark, tmp_path):
    cells = cells_of(spark, ["acgt", "ac-t"])
    cells.write.parquet(str(tmp_path / "cells"))
    stream = spark.readStream.schema(cells.schema).parquet(str(tmp_path / "cells"))
    q = streaming.state_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "at")).start()
    q.processAllAvailable()
    q.stop()
    assert values(spark.table("counted"), "locus", "state", "n") == values(frequencies.counts(cells), "locus", "state", "n")


def test_samples_without_cells_count(spark):
    cells = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (3, 0, 0), (3, 1, 1)], "sample_id long, locus int, state int")
    samples = spark.createDataFrame([(1,), (2,), (3,)], "sample_id long")
    freq = {(r["locus"], r["state"]): r["freq"] for r in frequencies.frequencies(cells, samples).collect()}
    assert freq[0, 0] == pytest.approx(2 / 3) and freq[1, 1] == pytest.approx(1 / 3)
    assert select.snp_filter(cells, samples, 0.3, 1.0).count() == 1 and select.snp_filter(cells, samples, 0.4, 1.0).count() == 0


def test_triangle_begins_with_the_number(spark):
    distances = spark.createDataFrame([(1, 0, 2), (2, 0, 1), (2, 1, 3)], "i long, j long, distance int")
    samples = spark.createDataFrame([(0,), (1,), (2,)], "sample_id long")
    assert [r["line"] for r in text.triangle(distances, samples).orderBy("place").collect()] == ["n=3", "2 ", "1 3 "]


def test_saved_alignment_keeps_everything(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "sample_id long, locus int, state int")
    lists = spark.createDataFrame([(0, 17)], "ord long, locus long")
    sequences.save(Alignment(cells, samples_of(cells), "named", 99, lists), f"{tmp_path}/a")
    back = sequences.load(spark, f"{tmp_path}/a")
    assert (back.name, back.n_original_positions, [tuple(r) for r in back.translation.collect()]) == ("named", 99, [(0, 17)])
    sequences.save(Alignment(cells, samples_of(cells)), f"{tmp_path}/b")
    assert sequences.load(spark, f"{tmp_path}/b").translation is None


def test_ragged_samples_without_nested_loops(spark):
    rows = [(i, k, (i * 7 + k * 3) % 4 if i % 5 else k % 2) for i in range(24) for k in range(20 if i % 4 else 13)]
    cells = spark.createDataFrame(rows, "sample_id long, locus int, state int")
    near = pairs.similar_pairs(cells, 20, 0.9)
    plan = near._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    plain = pairs.identities(cells, 20).where("same >= 0.9 * shorter and shorter > 0")
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, plain.collect()))
