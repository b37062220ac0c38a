"""The block text form of an alignment, and its reader.

Two levels: the loci are cut into blocks of 32, and each line has one distinct word of a block, with the positions of its
loci and the samples that carry it, both as ranges in hexadecimal. A line stands for itself, so files are read in
parallel whatever their size.

    <alignment id="name">
    <i id="0" w="1.0" m="1">first sample</i>
    <block p="1-20" i="0-3,7">acgtacgt...</block>
    </alignment>
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.states import to_state, to_symbol
from ..model import BLOCK, Alignment
from ..operators import select
from ..operators.blocks import sequences_of, words
from ..operators.sets import members_of_text, range_text

#: Signs that XML text writes otherwise; & comes first.
SIGNS = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"))


def _escaped(text: Column) -> Column:
    for sign, name in SIGNS:
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def _plain(text: Column) -> Column:
    for sign, name in reversed(SIGNS):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def _positions(alignment: Alignment, base: int) -> DataFrame:
    """block, p: the original positions of a block's loci, runs of ascending neighbours as one range, in order of the loci."""
    loci = alignment.translation if alignment.translation is not None else select.numbered(alignment.cells.select("locus").distinct())
    each = loci.groupBy(F.floor(F.col("ord") / BLOCK).cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("ord", (F.col("locus") + base).alias("at")))).alias("s"))
    at = F.transform("s", lambda x: x["at"])
    begins = F.filter(F.sequence(F.lit(0), F.size("at") - 1), lambda k: (k == 0) | (F.get("at", k) != F.get("at", F.greatest(k - 1, F.lit(0))) + 1))
    rows = each.select("block", at.alias("at")).select("block", "at", begins.alias("begins"))
    hexed = lambda x: F.lower(F.hex(x))

    def run(k: Column, j: Column) -> Column:
        first, last = F.get("at", k), F.get("at", F.coalesce(F.get("begins", j + 1), F.size("at")) - 1)
        return F.when(first == last, hexed(first)).otherwise(F.concat(hexed(first), F.lit("-"), hexed(last)))

    return rows.select("block", F.array_join(F.transform("begins", run), ",").alias("p"))


def lines(alignment: Alignment, base: int = 1) -> DataFrame:
    """part, block, first, line: the lines in the order of their first three columns."""
    spark = alignment.cells.sparkSession
    ends = spark.createDataFrame([(0, 0, 0), (3, 0, 0)], "part int, block long, first long")
    ends = ends.withColumn("line", F.when(F.col("part") == 0, F.concat(F.lit('<alignment id="'), _escaped(F.lit(alignment.name)), F.lit('">'))).otherwise("</alignment>"))
    facts = [F.lit('<i id="'), F.col("sample_id").cast("string"), F.lit('" w="'), F.col("weight").cast("string"), F.lit('" m="'), F.col("multiplicity").cast("string"), F.lit('">'), _escaped(F.col("name")), F.lit("</i>")]
    samples = alignment.samples.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("block"), F.col("sample_id").alias("first"), F.concat(*facts).alias("line"))
    strips = words(sequences_of(alignment.cells, to_symbol(F.col("state")))).withColumn("set_id", F.concat_ws(":", "block", "word"))
    ids = range_text(strips.select("set_id", F.col("sample_id").alias("member")))
    firsts = strips.groupBy("set_id", "block", "word").agg(F.min("sample_id").alias("first"))
    each = firsts.join(ids, "set_id").join(_positions(alignment, base), "block")
    body = each.select(F.lit(2).alias("part"), F.col("block").cast("long").alias("block"), "first", F.concat(F.lit('<block p="'), "p", F.lit('" i="'), "text", F.lit('">'), "word", F.lit("</block>")).alias("line"))
    return ends.unionByName(samples).unionByName(body)


def read(spark: SparkSession, path: str, base: int = 1) -> Alignment:
    """The alignment of block text files: loci are numbered by position, the translation leads to the positions less base."""
    text = spark.read.text(path)
    part = lambda pattern, k=1: F.regexp_extract("value", pattern, k)
    name = text.where(F.col("value").startswith("<alignment ")).select(_plain(part('^<alignment id="(.*)">$')).alias("name")).first()
    if name is None:
        raise ValueError(f"{path} has no alignment in block text form")
    sample = '^<i id="([0-9]+)" w="([^"]*)" m="([0-9]+)">(.*)</i>$'
    samples = text.where(F.col("value").startswith("<i ")).select(part(sample).cast("long").alias("sample_id"), _plain(part(sample, 4)).alias("name"), part(sample, 3).cast("long").alias("multiplicity"), part(sample, 2).cast("double").alias("weight"))
    block = '^<block p="([^"]*)" i="([^"]*)">(.*)</block>$'
    words_ = text.where(F.col("value").startswith("<block ")).select(members_of_text(part(block)).alias("p"), members_of_text(part(block, 2)).alias("ids"), part(block, 3).alias("word"))
    states = F.transform(F.split("word", ""), lambda c, k: F.named_struct(F.lit("position"), F.get("p", k) - base, F.lit("state"), to_state(c)))
    cells = words_.select(F.explode("ids").alias("sample_id"), states.alias("states")).select("sample_id", F.inline("states"))
    loci = select.numbered(words_.select(F.explode("p").alias("p")).distinct().select((F.col("p") - base).alias("locus")))
    placed = cells.join(loci, cells["position"] == loci["locus"]).select("sample_id", F.col("ord").cast("int").alias("locus"), "state")
    return Alignment(placed, samples, name["name"], translation=loci)



