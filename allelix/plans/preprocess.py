"""The preprocessing of one alignment from file to files, also as ``python -m allelix.plans.preprocess``."""

from __future__ import annotations

import argparse
import contextlib
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..model import Alignment
from ..operators import blocks, frequencies, graph, histogram, pairs, running, select
from ..sinks import block_text, text
from ..sources import lists, sequences

VERSION = "0.3"


@dataclass(frozen=True)
class Options:
    """begin, end: first and last locus, in the input's base; end None for the last there is. linear: the genome is no circle."""

    include_list: str | None = None
    exclude_list: str | None = None
    mapping_list: str | None = None
    sample_list: str | None = None
    sample_weights: str | None = None
    input_base: int = 1
    output_base: int = 1
    begin: int | None = None
    end: int | None = None
    filter: bool = True
    maf: float = 0.01
    gap: float = 0.15
    maf_strict: bool = False
    reweight: bool = True
    threshold: float = 0.9
    rescale: bool = False
    genome_size: int = 0
    linear: bool = False
    state_frequencies: bool = False
    weights: bool = False
    distance_matrix: bool = False
    alignment: bool = False
    block_text: bool = False

    def __post_init__(self) -> None:
        for name in ("maf", "gap", "threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} is a share, from 0 to 1: {getattr(self, name)}")
        for name in ("input_base", "output_base", "genome_size"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} is negative: {getattr(self, name)}")
        if self.begin is not None and self.end is not None and self.end < self.begin:
            raise ValueError(f"the last locus, {self.end}, is before the first, {self.begin}")


def prepare(spark: SparkSession, path: str, o: Options = Options()) -> Alignment:
    """Read, map, choose loci, filter them over all samples, and then choose samples.

    Loci are renumbered, and the translation leads to original positions.
    """
    mapping = lists.read_loci(spark, o.mapping_list, o.input_base) if o.mapping_list else None
    alignment = sequences.read_alignments(spark, [path], mapping=mapping, genome_size=o.genome_size)[0]
    cells, samples, name = alignment.cells, alignment.samples, alignment.name
    if o.begin is not None or o.end is not None:
        cells = select.between(cells, (o.input_base if o.begin is None else o.begin) - o.input_base, None if o.end is None else o.end - o.input_base)
    if o.include_list:
        cells = select.include(cells, lists.read_loci(spark, o.include_list, o.input_base))
    if o.exclude_list:
        cells = select.exclude(cells, lists.read_loci(spark, o.exclude_list, o.input_base))
    kept = cells.select("locus").distinct()
    if o.filter:
        kept, name = select.snp_filter(cells, samples, o.maf, o.gap, maf_strict=o.maf_strict), f"{name}.{select.filter_name(o.maf, o.gap)}"
    loci = select.numbered(kept)
    if o.sample_list:
        chosen = lists.read_loci(spark, o.sample_list, o.input_base).select("ord", F.col("locus").alias("sample_id"))
        cells, samples = select.subsample(cells, samples, chosen)
    translation = loci if alignment.translation is None else select.combine(alignment.translation, loci)
    return replace(alignment, cells=select.subset(cells, loci), samples=samples, name=name, translation=translation)


@contextlib.contextmanager
def settled(alignment: Alignment, folder: str) -> Iterator[Alignment]:
    """The alignment as tables in the folder while it is worked with: its outputs read these, not the files and lists it was made from."""
    spark, path = alignment.cells.sparkSession, f"{folder}/{alignment.name}.working-{uuid.uuid4().hex}"
    sequences.save(alignment, path)
    try:
        yield sequences.load(spark, path)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def weighed(spark: SparkSession, alignment: Alignment, o: Options = Options()) -> Alignment:
    """Weights from a file, of as many numbers as samples, or from similar samples; rescaled if asked for."""
    if o.sample_weights:
        values = lists.read_values(spark, o.sample_weights).withColumnRenamed("ord", "place")
        met = running.zipped(alignment.samples.select("sample_id"), ["sample_id"], values, ["place"], "the samples and their weights")
        weights = met.select("sample_id", F.col("value").alias("weight"))
    elif o.reweight:
        weights = pairs.sample_weights(alignment.cells, alignment.samples, alignment.n_loci(), o.threshold)
    else:
        return alignment
    return alignment.with_weights(pairs.rescaled(weights) if o.rescale else weights)


def distances(alignment: Alignment, edges: DataFrame, o: Options = Options()) -> DataFrame:
    """Edges between loci with their original positions, and how far apart they are on the genome, a circle unless it is linear."""
    translation = alignment.translation if alignment.translation is not None else select.numbered(alignment.cells.select("locus").distinct())
    return graph.output(edges, translation, alignment.n_original_positions or 0, o.output_base, o.linear)


def report(alignment: Alignment) -> list[str]:
    """Lines on samples, positions, states, words of blocks and sizes."""
    strips = blocks.words(blocks.sequences_of(alignment.cells))
    states = sorted((r["n_states"], r["positions"]) for r in frequencies.state_distribution(alignment.cells).collect())
    words, size = blocks.statistics(strips).first(), blocks.compression(strips).first()
    return [
        f'statistics for alignment "{alignment.name}":',
        f"{alignment.samples.count()} samples and {sum(n for _, n in states)} positions",
        "state distribution [#states:#positions] = " + " ".join(f"{k}:{n}" for k, n in states) + f" | total:{sum(n for _, n in states)} | polymorphic:{sum(n for k, n in states if k > 1)}",
        f"#stateblocks = {words['words']} (min/mean/median/max per column = {words['least']}/{words['mean']}/{words['median']}/{words['most']})",
        f"uncompressed size = {labels.memory_string(size['states'])}",
        f"compressed size = {labels.memory_string(size['word_bytes'] + size['index_bytes'])} ({labels.memory_string(size['word_bytes'])} for {words['words']} blocks and {labels.memory_string(size['index_bytes'])} for index)",
        f"compression ratio = {size['ratio']:.6g} ({size['bits_per_state']:.6g} bits/variable)",
    ]


def outputs(alignment: Alignment, o: Options) -> dict[str, tuple[DataFrame, tuple[str, ...]]]:
    """File name -> lines and their order."""
    out: dict[str, tuple[DataFrame, tuple[str, ...]]] = {}
    if o.state_frequencies:
        for prefix, freq in (("", frequencies.frequencies(alignment.cells, alignment.samples)), ("weighted_", frequencies.weighted_frequencies(alignment.cells, alignment.samples)))[: 1 + o.reweight]:
            out[f"{prefix}frequencies.txt"] = (text.frequency_lines(freq), ("locus",))
            out[f"{prefix}frequency_distribution.txt"] = (histogram.csv_lines(histogram.histogram(freq, "freq", 0.01), 0.01), ("bin",))
    if o.distance_matrix:
        out["distances"] = (text.distance_triangle(alignment.cells, alignment.samples, alignment.n_loci()), ("place",))
    if o.weights:
        out["weights"] = (text.weight_lines(alignment.samples), ("sample_id",))
    if o.alignment:
        out["fasta"] = (text.fasta(alignment.cells, alignment.samples), ("sample_id",))
        if alignment.translation is not None:
            out["loci"] = (text.loci_lines(alignment.translation, o.output_base), ("ord",))
    if o.block_text:
        out["blocks.xml"] = (block_text.lines(alignment, o.output_base), ("part", "block", "first"))
    return out


def run(spark: SparkSession, path: str, folder: str, o: Options = Options()) -> list[str]:
    """Prepares one file; its outputs stand in the folder, each under the first free name. Gives these names."""
    return _run(spark, path, folder, o, False)


def _run(spark: SparkSession, path: str, folder: str, o: Options, verbose: bool) -> list[str]:
    began = time.perf_counter_ns()
    with settled(prepare(spark, path, o), folder) as prepared:
        if verbose:
            print(*report(prepared), sep="\n")
        with settled(weighed(spark, prepared, o), folder) as alignment:
            names = [text.write_lines(lines, f"{folder}/{alignment.name}.{name}", *place) for name, (lines, place) in outputs(alignment, o).items()]
    if verbose:
        print(*(f"wrote {name}" for name in names), f"{path}: {labels.time_string(time.perf_counter_ns() - began)}", sep="\n")
    return names


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("alignmentfile", nargs="+", help="FASTA files, plain, .gz or .xz; each is prepared alone")
    p.add_argument("--folder", default=".")
    p.add_argument("--version", action="version", version=f"allelix {VERSION}")
    p.add_argument("-v", "--verbose", action="store_true", help="print statistics, times and names of outputs")
    p.add_argument("-t", "--threads", type=int, default=0, help="cores of a local session, all if less than 1; a cluster's session has its own")
    for name in ("include-list", "exclude-list", "mapping-list", "sample-list", "sample-weights"):
        p.add_argument(f"--{name}")
    p.add_argument("--input-indexing-base", type=int, default=1, dest="input_base")
    p.add_argument("--output-indexing-base", type=int, default=1, dest="output_base")
    p.add_argument("--begin", type=int)
    p.add_argument("--end", type=int)
    p.add_argument("--no-filter-alignment", action="store_false", dest="filter")
    p.add_argument("--maf-threshold", type=float, default=0.01, dest="maf")
    p.add_argument("--gap-threshold", type=float, default=0.15, dest="gap")
    p.add_argument("--maf-strict", action="store_true")
    p.add_argument("--no-sample-reweighting", action="store_false", dest="reweight")
    p.add_argument("--sample-reweighting-threshold", type=float, default=0.9, dest="threshold")
    p.add_argument("--rescale-sample-weights", action="store_true", dest="rescale")
    p.add_argument("--genome-size", type=int, default=0)
    p.add_argument("--linear-genome", action="store_true", dest="linear")
    p.add_argument("--output-state-frequencies", action="store_true", dest="state_frequencies")
    p.add_argument("--output-sample-weights", action="store_true", dest="weights")
    p.add_argument("--output-sample-distance-matrix", action="store_true", dest="distance_matrix")
    p.add_argument("--output-alignment", action="store_true", dest="alignment")
    p.add_argument("--output-block-text", action="store_true", dest="block_text")
    return p


def main(argv: list[str] | None = None) -> list[str]:
    """Prepares each file, and gives the names of all outputs."""
    p = parser()
    a = vars(p.parse_args(argv))
    paths, folder, verbose, threads = (a.pop(k) for k in ("alignmentfile", "folder", "verbose", "threads"))
    if a["mapping_list"] and len(paths) > 1:
        p.error("a mapping list belongs to one alignment file")
    a["end"] = None if a["end"] == -1 else a["end"]
    try:
        o = Options(**a)
    except ValueError as error:
        p.error(str(error))
    spark = SparkSession.getActiveSession() or SparkSession.builder.master(f"local[{threads if threads > 0 else '*'}]").getOrCreate()
    return [name for path in paths for name in _run(spark, path, folder, o, verbose)]


if __name__ == "__main__":
    main()
