"""The engine's queries over the driver's tables: name -> query(spark, sf_dir)."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import masks
from .functions import states as st
from .functions import vectors as vec
from .model import Alignment, samples_of
from .operators import blocks, crosstable, frequencies, graph, histogram, intervals, pairs, running, select, sets
from .plans import preprocess
from .sinks import block_text, text
from .sources import lists, sequences
from .streaming import records

EMB_LOCI = 64


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def _loci(spark: SparkSession, values: list[int]) -> DataFrame:
    return lists.loci_from(spark, values)


#: Lists of loci that the selection queries use.
LEFT = [5, 3, 9, 3, 20, 63, 0]


def state_counts(s, d):
    return frequencies.counts(fx.embedding_cells(s, d))


def state_frequencies(s, d):
    return _round(frequencies.frequencies(fx.embedding_cells(s, d), fx.embedding_samples(s, d)), "freq")


def document_state_counts(s, d):
    return frequencies.counts(fx.document_cells(s, d))


def allele_occurrence(s, d):
    return frequencies.occurrences(fx.embedding_cells(s, d), fx.embedding_samples(s, d))


def weighted_counts(s, d):
    return _round(frequencies.weighted_counts(fx.embedding_cells(s, d), fx.embedding_samples(s, d)), "weight")


def weighted_frequencies(s, d):
    return _round(frequencies.weighted_frequencies(fx.embedding_cells(s, d), fx.embedding_samples(s, d), 0.5), "freq")


def column_entropy(s, d):
    return _round(frequencies.entropies(fx.embedding_cells(s, d), fx.embedding_samples(s, d), 0.5), "entropy")


def entropy_filter(s, d):
    cells = fx.event_cells(s, d)
    return select.entropy_filter(cells, samples_of(cells), 1.45)


def effective_size(s, d):
    return _round(frequencies.effective_size(fx.embedding_samples(s, d)), "neff")


def state_presence(s, d):
    return frequencies.presence(fx.document_cells(s, d))


def state_distribution(s, d):
    return frequencies.state_distribution(fx.document_cells(s, d))


def snp_filter(s, d):
    return select.snp_filter(fx.embedding_cells(s, d), fx.embedding_samples(s, d))


def snp_filter_loose(s, d):
    return select.snp_filter(fx.document_cells(s, d), fx.document_sequences(s, d), 0.05, 1.0)


def subset_columns(s, d):
    return select.subset(fx.embedding_cells(s, d), _loci(s, LEFT))


def include_loci(s, d):
    return select.include(fx.embedding_cells(s, d), _loci(s, LEFT))


def exclude_loci(s, d):
    return select.exclude(fx.embedding_cells(s, d), _loci(s, LEFT))


def combine_loci(s, d):
    return select.combine(select.numbered(select.snp_filter(fx.embedding_cells(s, d), fx.embedding_samples(s, d))), _loci(s, LEFT))


def loci_difference(s, d):
    """The customers of the orders, as a list with repeats, less those of five nations."""
    orders = running.numbered(fx.table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("locus")), ["o_orderkey"])
    return select.difference(orders, fx.table(s, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("locus")))


def numbered_loci(s, d):
    return select.numbered(select.snp_filter(fx.document_cells(s, d), fx.document_sequences(s, d), 0.05, 1.0))


def subsample_rows(s, d):
    chosen = s.createDataFrame([(k, v) for k, v in enumerate([7, 3, 11, 450])], "ord long, sample_id long")
    return select.subsample(fx.embedding_cells(s, d), fx.embedding_samples(s, d), chosen)[0]


def _vectors_there(s, d):
    return fx.table(s, d, "embeddings").count()


def hamming_distance(s, d):
    return pairs.distances(fx.embedding_cells(s, d), EMB_LOCI, _vectors_there(s, d))


def fract_identical(s, d):
    return pairs.shares(pairs.identities(fx.event_cells(s, d), 30), 30, 6)


def similar_pairs(s, d):
    return pairs.similar_pairs(fx.embedding_cells(s, d), EMB_LOCI, 0.35, _vectors_there(s, d))


def similar_days(s, d):
    """Users who agree on 27 of 30 days or more: by equal segments of days, of which some are very common."""
    return pairs.similar_pairs(fx.event_cells(s, d), 30, 0.9)


def similar_lines(s, d):
    """Rows of line items that agree in four of five loci, as distinct patterns with their numbers."""
    rows = fx.line_cells(s, d)
    fused = pairs.fuse(blocks.sequences_of(rows).withColumn("multiplicity", F.lit(1)))
    cells = fx.sequence_cells(fused.select("sample_id", F.translate("sequence", "01234", "atcg-").alias("sequence")))
    near = pairs.similar_pairs(cells, 5, 0.8)
    a, b = fused.alias("a"), fused.alias("b")
    named = near.join(a, F.col("i") == F.col("a.sample_id")).join(b, F.col("j") == F.col("b.sample_id"))
    return named.select(F.least("a.sequence", "b.sequence").alias("first"), F.greatest("a.sequence", "b.sequence").alias("second"), "same")


def sample_weights(s, d):
    cells = fx.embedding_cells(s, d)
    return _round(pairs.sample_weights(cells, samples_of(cells), EMB_LOCI, 0.35, _vectors_there(s, d)), "weight")


def sample_weights_multiplicity(s, d):
    return _round(pairs.sample_weights(fx.embedding_cells(s, d), fx.embedding_samples(s, d), EMB_LOCI, 0.35, _vectors_there(s, d)), "weight")


def sample_weights_truncated(s, d):
    cells = fx.event_cells(s, d)
    return _round(pairs.sample_weights(cells, samples_of(cells), 30, 0.35, truncate=True), "weight")


def sample_weights_rescaled(s, d):
    cells = fx.embedding_cells(s, d)
    return _round(pairs.rescaled(pairs.sample_weights(cells, samples_of(cells), EMB_LOCI, 0.35)), "weight")


def pair_diagnostics(s, d):
    return _round(pairs.diagnostics(fx.embedding_cells(s, d), EMB_LOCI, 0.35, _vectors_there(s, d)), "least", "greatest", "apart_ratio")


def fuse_duplicates(s, d):
    rows = fx.document_sequences(s, d).withColumn("multiplicity", F.lit(1).cast("long"))
    return pairs.fuse(rows).select("sample_id", "multiplicity", F.length("sequence").alias("n_loci"))


def crosstable_pair(s, d):
    return _round(crosstable.crosstable(fx.line_cells(s, d), fx.line_weights(s, d), F.col("locus_i") == 0, F.col("locus_j") == 1, n_loci=5), "weight")


def crosstable_tile(s, d):
    ones = fx.line_weights(s, d).withColumn("weight", F.lit(1.0))
    return _round(crosstable.crosstable(fx.line_cells(s, d), ones, dense=False, n_loci=5), "weight")


def crosstable_pseudocount(s, d):
    return _round(crosstable.crosstable(fx.embedding_cells(s, d), fx.embedding_samples(s, d), init=0.5, n_loci=EMB_LOCI), "weight")


def block_intersection_weights(s, d):
    words = blocks.words(blocks.sequences_of(fx.event_cells(s, d).where("locus < 15")))
    later = blocks.words(blocks.sequences_of(fx.event_cells(s, d).where("locus >= 15")))
    ids = fx.event_cells(s, d).select("sample_id", (F.lit(1.0) + F.col("sample_id") % 3).alias("weight")).distinct()
    left, right = (w.select(F.col("word").alias("set_id"), "sample_id") for w in (words, later))
    return _round(crosstable.overlap_weights(left, right, ids), "weight")


def gauge_zero_sum(s, d):
    table = crosstable.crosstable(fx.embedding_cells(s, d), fx.embedding_samples(s, d))
    return _round(crosstable.zero_sum(table, ["locus_i", "locus_j"]), "gauged", "weight").withColumn("gauged", F.col("gauged") + F.lit(0.0))


def block_dictionary(s, d):
    return blocks.dictionary(blocks.words(blocks.sequences_of(fx.embedding_cells(s, d))))


def block_indices(s, d):
    return blocks.word_numbers(blocks.words(blocks.sequences_of(fx.event_cells(s, d))))


def block_statistics(s, d):
    return _round(blocks.statistics(blocks.words(fx.document_sequences(s, d))), "ratio")


def freq_histogram(s, d):
    return _round(histogram.histogram(frequencies.frequencies(fx.embedding_cells(s, d), fx.embedding_samples(s, d)), "freq", 0.01), "mean", "variance")


def hist_moments(s, d):
    bins = histogram.histogram(fx.table(s, d, "lineitem"), "l_discount", 0.01)
    return _round(histogram.moments(bins), "mean", "variance", "std")


def hist_moments_compat(s, d):
    bins = histogram.histogram(fx.table(s, d, "lineitem"), "l_discount", 0.01)
    return _round(histogram.moments(bins, compat=True), "mean", "variance", "std")


def hist_cumulative(s, d):
    bins = histogram.histogram(fx.table(s, d, "lineitem"), "l_tax", 0.01, skip_zeros=False)
    return histogram.cumulative(bins).select("bin", "cnt", "running")


def _supplied(s, d):
    return fx.table(s, d, "lineitem").select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("member")).distinct()


def _neighbours(s, d):
    """Each supplier's parts beside those of the next supplier."""
    arrays = _supplied(s, d).groupBy("set_id").agg(F.array_sort(F.collect_list("member")).alias("x"))
    return arrays.join(arrays.select((F.col("set_id") - 1).alias("set_id"), F.col("x").alias("y")), "set_id")


def set_intersection(s, d):
    return _neighbours(s, d).select("set_id", F.explode(sets.intersection(F.col("x"), F.col("y"))).alias("member"))


def set_union(s, d):
    return _neighbours(s, d).select("set_id", F.explode(sets.union(F.col("x"), F.col("y"))).alias("member"))


def set_differences(s, d):
    both = _neighbours(s, d)
    a = both.select("set_id", F.lit("only_a").alias("side"), F.explode(sets.difference(F.col("x"), F.col("y"))).alias("member"))
    return a.unionAll(both.select("set_id", F.lit("only_b").alias("side"), F.explode(sets.difference(F.col("y"), F.col("x"))).alias("member")))


def set_split(s, d):
    parts = _neighbours(s, d).select("set_id", sets.split(F.col("x"), F.col("y")).alias("p"))
    return parts.select("set_id", *[F.size(f"p.{c}").alias(c) for c in ("only_a", "only_b", "both")])


def set_overlap(s, d):
    return _neighbours(s, d).select("set_id", F.arrays_overlap("x", "y").alias("overlap"), F.size(F.array_intersect("x", "y")).alias("size"), F.array_contains("x", F.element_at("y", 1)).alias("has_first"), (F.col("x") == F.col("y")).alias("equal"))


def set_union_all(s, d):
    rows = _supplied(s, d).join(fx.table(s, d, "supplier"), F.col("set_id") == F.col("s_suppkey"))
    return sets.union_all(rows.withColumnRenamed("s_nationkey", "nation"), "nation")


def set_gather(s, d):
    weights = fx.table(s, d, "part").select(F.col("p_partkey").alias("member"), F.col("p_retailprice").alias("weight"))
    return _round(sets.gather(_supplied(s, d), weights), "weight", digits=2)


def set_gather_parts(s, d):
    """The weights of what a supplier's parts and the next one's have in common, and of what only one of them has."""
    weights = fx.table(s, d, "part").select(F.col("p_partkey").alias("member"), F.col("p_retailprice").alias("weight"))
    own = _supplied(s, d)
    return _round(sets.gather_parts(own, own.withColumn("set_id", F.col("set_id") - 1), weights), "only_a", "only_b", "both", digits=2)


def range_encode(s, d):
    return sets.range_text(_supplied(s, d))


def rle_encode(s, d):
    return sets.run_lengths(fx.table(s, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "run", "event_type", "count")


def rle_decode(s, d):
    runs = sets.run_lengths(fx.table(s, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    return sets.decoded(runs, "user_id", "event_type")


def _edges(s, d):
    e = fx.table(s, d, "lineitem")
    met = e.groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.round(F.sum("l_quantity"), 2).alias("weight"))
    return graph.build(met, "a", "b", flag=F.col("weight") > 40)


def graph_build(s, d):
    return _edges(s, d)


def graph_sort(s, d):
    return graph.ordered(_edges(s, d))


def graph_nodes(s, d):
    return graph.nodes(_edges(s, d), lambda e: e["weight"] > 45)


def graph_union(s, d):
    e = _edges(s, d)
    return graph.joined(e.where("flag"), e.where("weight > 30")).groupBy("i", "j").agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 2).alias("weight"))


def _placed_edges(s, d):
    """The edges, their nodes' places, and the size of a genome that has room for them."""
    edges = _edges(s, d)
    places = graph.nodes(edges).select(F.col("locus").alias("ord"), (F.col("locus") * 3 + 2).alias("locus"))
    return edges, places, places.agg(F.max("locus") + 1).first()[0]


def graph_output(s, d):
    return graph.output(*_placed_edges(s, d))


def genome_distance(s, d):
    return graph.output(*_placed_edges(s, d), base=0, linear=True).select("pos1", "pos2", "distance")


def distance_linear(s, d):
    return fx.table(s, d, "orders").select("o_orderkey", vec.linear_distance(F.col("o_orderkey"), F.col("o_custkey")).alias("distance"))


def distance_circular(s, d):
    return fx.table(s, d, "orders").select("o_orderkey", vec.circular_distance(F.col("o_orderkey") % 1000, F.col("o_custkey") % 1000, F.lit(1000)).cast("long").alias("distance"))


def _vectors(s, d):
    return fx.table(s, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def vector_arith(s, d):
    v, w = F.col("v"), F.reverse("v")
    rows = _vectors(s, d).select("vec_id", *[F.round(vec.total(vec.elementwise(v, w, op)), 5).alias(name) for name, op in (("plus", lambda a, b: a + b), ("minus", lambda a, b: a - b + 1), ("times", lambda a, b: a * b), ("over", lambda a, b: a / (b * b + 1)))])
    return rows.withColumns({c: F.col(c) + F.lit(0.0) for c in ("plus", "minus", "times", "over")})


def vector_distance(s, d):
    v, w = F.col("v"), F.reverse("v")
    return _round(_vectors(s, d).select("vec_id", vec.squared_distance(v, w).alias("square"), vec.distance(v, w).alias("distance"), vec.norm(v).alias("norm")), "square", "distance", "norm")


def xlogx_family(s, d):
    x = F.col("l_extendedprice") / 1000
    rows = fx.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(vec.xlogx(x)).alias("xlogx"), F.sum(vec.x_plus_logx(x)).alias("xaddlogx"), F.sum(vec.guarded_xlogx(F.col("l_discount"))).alias("guarded"))
    return _round(rows, "xlogx", "xaddlogx", "guarded", digits=5)


def mask_ops(s, d):
    mask, v = F.lit(0b1011001), F.transform("v", lambda x: F.abs(x) + 0.5)
    rows = _vectors(s, d).select("vec_id", vec.total(vec.masked(v, mask)).alias("summed"), vec.total(vec.masked(v, mask, vec.guarded_xlogx)).alias("xlogx"), vec.total(vec.masked(v, mask, vec.x_plus_logx)).alias("xaddlogx"), F.bit_count(F.col("vec_id")).cast("int").alias("bits"), vec.is_set(F.col("vec_id"), F.lit(2)).alias("third"))
    return _round(rows, "summed", "xlogx", "xaddlogx")


def integer_power(s, d):
    return fx.table(s, d, "part").select("p_partkey", vec.integer_power(F.col("p_size") % 10, F.lit(5)).alias("power"))


def char_to_state(s, d):
    each = fx.table(s, d, "documents").select(F.explode(F.split("text", "")).alias("c"))
    return each.groupBy("c").agg(F.count("*").alias("n")).select(st.to_state(F.col("c")).alias("state"), "n").groupBy("state").agg(F.sum("n").alias("n"))


def state_to_char(s, d):
    return fx.document_sequences(s, d).select("sample_id", F.length("sequence").alias("n_loci"), F.md5("sequence").alias("digest"))


def merged_states(s, d):
    left = fx.event_cells(s, d)
    right = left.select((F.col("sample_id") - 1).alias("sample_id"), "locus", F.col("state").alias("other"))
    return left.join(right, ["sample_id", "locus"]).select("sample_id", "locus", st.merge_states(F.col("state"), F.col("other")).alias("state"))


def block_helpers(s, d):
    k = F.col("o_orderkey").cast("int")
    return fx.table(s, d, "orders").select("o_orderkey", st.block_of(k).alias("block"), st.place_in_block(k).alias("place"), st.first_of_block(st.block_of(k)).alias("first"), st.n_blocks(k).alias("blocks"), st.last_block_size(k).cast("int").alias("last_size"), st.size_string(k, F.col("o_custkey")).alias("size"))


def phandango_pivot(s, d):
    cells = fx.event_cells(s, d)
    loci = select.numbered(cells.select("locus").distinct())
    return text.phandango(cells, samples_of(cells), loci)


def distance_triangle_text(s, d):
    cells = fx.event_cells(s, d)
    return text.distance_triangle(cells, samples_of(cells), 30)


def fasta_lines(s, d):
    cells = fx.event_cells(s, d)
    return text.fasta(cells, samples_of(cells))


def frequency_lines(s, d):
    return text.frequency_lines(frequencies.counts(fx.event_cells(s, d)), "n")


def _folder(spark: SparkSession, name: str) -> str:
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="allelix-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{name}-{os.urandom(8).hex()}"


def fasta_roundtrip(s, d):
    """Whole documents written as FASTA and read again, as sequences and never as cells. A null text has no sequence to write; its row has nulls."""
    path = text.write_lines(text.sequence_lines(fx.document_sequences(s, d, "text IS NOT NULL")), _folder(s, "fasta"), "sample_id")
    back = sequences.normal_sequences(sequences.read_records(s, path)).select(F.col("name").cast("long").alias("sample_id"), "sequence")
    whole = back.unionByName(fx.document_sequences(s, d, "text IS NULL"))
    return whole.select("sample_id", F.length("sequence").alias("n_loci"), F.md5("sequence").alias("digest"))


def loci_list_roundtrip(s, d):
    loci = select.numbered(select.snp_filter(fx.embedding_cells(s, d), fx.embedding_samples(s, d)))
    path = text.write_lines(loci.select("ord", F.concat(F.col("locus") + 1, F.lit("-"), F.col("locus") + 2).alias("line")), _folder(s, "loci"), "ord")
    return lists.read_loci(s, path, base=1)


def value_list_roundtrip(s, d):
    path = text.write_lines(text.weight_lines(sample_weights(s, d)), _folder(s, "values"), "sample_id")
    return _round(lists.read_values(s, path), "value")


def _spans(s, d, *flags):
    """A supplier's spans of order keys: one for each line item with the flag, as long as its quantity. They overlap and lie in each other."""
    rows = fx.table(s, d, "lineitem").where(F.col("l_returnflag").isin(*flags))
    return rows.select(F.col("l_suppkey").alias("set_id"), F.col("l_orderkey").alias("first"), (F.col("l_orderkey") + F.col("l_quantity").cast("long") - 3).alias("last"))


def interval_fusion(s, d):
    return intervals.fused(_spans(s, d, "A"), _spans(s, d, "R"))


def interval_intersection(s, d):
    return intervals.intersection(_spans(s, d, "A"), _spans(s, d, "N", "R"))


def interval_difference(s, d):
    return intervals.difference(_spans(s, d, "A"), _spans(s, d, "N", "R"))


def hybrid_text(s, d):
    return intervals.hybrid_text(intervals.fused(_spans(s, d, "A", "R")))


def hybrid_roundtrip(s, d):
    path = _folder(s, "sets")
    hybrid_text(s, d).write.parquet(path)
    return intervals.from_hybrid_text(s.read.schema("set_id long, text string").parquet(path))


def zipped_rows(s, d):
    """The k-th customer by balance beside the k-th by name."""
    c = fx.table(s, d, "customer")
    left, right = c.select("c_acctbal", F.col("c_custkey").alias("rich")), c.select("c_name", F.col("c_custkey").alias("named"))
    return running.zipped(left, ["c_acctbal", "rich"], right, ["c_name", "named"]).select("ord", "rich", "named")


def equality_mask(s, d):
    """Users beside the next user: the days on which their states agree, as a mask, with a count, a rank and two selections."""
    pack = pairs.packed(fx.event_cells(s, d), 30)
    met = pack.alias("a").join(pack.alias("b"), F.col("a.sample_id") == F.col("b.sample_id") + 1)
    rows = met.select(F.col("a.sample_id").alias("i"), F.col("b.sample_id").alias("j"), pairs.equality_mask(pack).alias("mask"))
    return rows.select("i", "j", F.get("mask", F.lit(0)).alias("bits"), masks.count(F.col("mask")).cast("int").alias("same"), masks.rank(F.col("mask"), F.lit(15)).alias("early"), masks.select(F.col("mask"), F.lit(0)).alias("first"), masks.select(F.col("mask"), F.lit(4)).alias("fifth"))


def block_text_roundtrip(s, d):
    """Users' days written as block text and read again."""
    cells = fx.event_cells(s, d)
    path = text.write_lines(block_text.lines(Alignment(cells, samples_of(cells), "days <1 & 2>")), _folder(s, "blocks"), "part", "block", "first")
    back = block_text.read(s, path)
    named = blocks.sequences_of(back.cells, st.to_symbol(F.col("state"))).join(back.samples, "sample_id")
    return named.select(F.col("name").cast("long").alias("sample_id"), F.lit(back.name).alias("alignment"), "multiplicity", "weight", "sequence")


def compression_statistics(s, d):
    return _round(blocks.compression(blocks.words(blocks.sequences_of(fx.event_cells(s, d)))), "ratio", "bits_per_state")


def fasta_stream(s, d):
    """Documents as FASTA text, eight to a stream, in chunks of 1,000 characters that come in several micro-batches, read by the stateful assembler."""
    docs = fx.document_sequences(s, d).select(F.floor(F.col("sample_id") / 8).alias("stream"), F.struct("sample_id", F.concat(F.lit(">"), "sample_id", F.lit("\n"), "sequence", F.lit("\n")).alias("t")).alias("r"))
    whole = docs.groupBy("stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"]), "").alias("t"))
    last = F.floor((F.length("t") - 1) / 1000)
    cut = whole.select("stream", "t", last.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("seq"))
    chunks = cut.select(F.col("stream").cast("string").alias("stream"), "seq", F.substring(F.col("t"), (F.col("seq") * 1000 + 1).cast("int"), F.lit(1000)).alias("chunk"), (F.col("seq") == F.col("n")).alias("last"))
    path = _folder(s, "chunks")
    # Four files that each have every fourth chunk of a stream: three of four chunks wait for others.
    chunks.repartition(4, F.pmod("seq", F.lit(4))).write.parquet(f"{path}/in")
    stream = s.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    query = records.assembled(stream).writeStream.format("parquet").option("checkpointLocation", f"{path}/at").trigger(availableNow=True).start(f"{path}/out")
    query.awaitTermination()
    back = records.records_of(s.read.schema(records.PIECES).parquet(f"{path}/out"))
    return back.select(F.col("name").cast("long").alias("sample_id"), F.length("body").alias("n_loci"), F.md5("body").alias("digest"))


def prepared_alignment(s, d):
    """The whole plan on users' days as FASTA: some loci excluded, filtered at a high frequency over all users, then every third user chosen."""
    cells, path = fx.event_cells(s, d), _folder(s, "plan")
    text.write_lines(text.fasta(cells, samples_of(cells)), f"{path}/days.fasta", "sample_id")
    users = running.numbered(cells.select("sample_id").distinct(), ["sample_id"])
    text.write_lines(users.where("ord % 3 = 0").select("ord", (F.col("ord") + 1).cast("string").alias("line")), f"{path}/samples", "ord")
    text.write_lines(cells.where("locus % 7 = 2").select("locus", (F.col("locus") + 1).cast("string").alias("line")).distinct(), f"{path}/without", "locus")
    o = preprocess.Options(exclude_list=f"{path}/without", sample_list=f"{path}/samples", maf=0.16, gap=0.6)
    found = preprocess.prepare(s, f"{path}/days.fasta", o)
    named = found.cells.join(found.samples.select("sample_id", "name"), "sample_id").join(found.translation.select(F.col("ord").alias("locus"), F.col("locus").alias("position")), "locus")
    return named.select("sample_id", F.col("name").cast("long").alias("user_id"), "locus", "position", "state")


def keep_samples(s, d):
    chosen = fx.table(s, d, "embeddings").where("label = 1").select(F.col("vec_id").alias("sample_id"))
    return select.keep_samples(fx.embedding_cells(s, d), chosen)


def graph_found(s, d):
    wanted = fx.table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return graph.found(_edges(s, d), wanted)


def graph_ordered_nodes(s, d):
    return graph.ordered_nodes(_edges(s, d), lambda e: e["weight"] > 45)


def edge_lines(s, d):
    return text.edge_lines(_edges(s, d))


def loci_texts(s, d):
    """A list of each customer's orders as a text of single keys and spans, some with a bad item, read as loci."""
    key = F.col("o_orderkey")
    item = F.when(key % 40 == 0, "x").when(key % 3 == 0, key.cast("string")).otherwise(F.concat(key, F.lit("-"), key + key % 5 - 1))
    texts = fx.table(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("t")))), lambda o: o["t"]), " ").alias("value"))
    return lists.loci_of(texts, base=1, keep=("o_custkey",))


QUERIES = {
    f.__name__: f
    for f in (
        state_counts, state_frequencies, document_state_counts, allele_occurrence, weighted_counts, weighted_frequencies, column_entropy,
        entropy_filter, effective_size, state_presence, state_distribution, snp_filter, snp_filter_loose, subset_columns, include_loci,
        exclude_loci, combine_loci, loci_difference, numbered_loci, subsample_rows, hamming_distance, fract_identical, similar_pairs, similar_days, similar_lines,
        sample_weights, sample_weights_multiplicity, sample_weights_truncated, sample_weights_rescaled, pair_diagnostics, fuse_duplicates,
        crosstable_pair, crosstable_tile, crosstable_pseudocount, block_intersection_weights, gauge_zero_sum, block_dictionary, block_indices,
        block_statistics, freq_histogram, hist_moments, hist_moments_compat, hist_cumulative, set_intersection, set_union, set_differences,
        set_split, set_overlap, set_union_all, set_gather, set_gather_parts, range_encode, rle_encode, rle_decode, graph_build, graph_sort, graph_nodes,
        graph_union, graph_output, genome_distance, distance_linear, distance_circular, vector_arith, vector_distance, xlogx_family,
        mask_ops, integer_power, char_to_state, state_to_char, merged_states, block_helpers, phandango_pivot, distance_triangle_text,
        fasta_lines, frequency_lines, fasta_roundtrip, loci_list_roundtrip, value_list_roundtrip, loci_texts, interval_fusion,
        interval_intersection, interval_difference, hybrid_text, hybrid_roundtrip, zipped_rows, equality_mask, block_text_roundtrip,
        compression_statistics, fasta_stream, prepared_alignment, keep_samples, graph_found, graph_ordered_nodes, edge_lines,
    )
}
