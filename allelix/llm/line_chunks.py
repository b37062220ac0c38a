"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A text's lines are hashed, and a rolling hash over each line and the one before it chooses where a chunk ends, so the
same passage is cut alike wherever it stands. Chunks of two lines or more that occur again anywhere are removed, all
but the first occurrence by (id, hash of the text, place in the text).

Cuts come once in four lines, so a passage of few lines mostly shares its chunks with what stands around it and stays.
``dedup_passages`` compares every two successive lines that have words, wherever cuts would fall: any run of two such lines
or more that occurs earlier goes whole. A single line that recurs between other lines stays under both rules.

Three passes over the texts, each within the row (no line is ever shuffled alone):
1. chunk hashes are counted, with a partial aggregation before the shuffle, so a very common chunk costs a row a task;
2. the texts of chunks whose hash recurs are grouped by hash and bytes: that is the byte comparison, again after a
   partial aggregation, and it finds the first occurrence of each text;
3. every other occurrence is removed from its document.
The lists of recurring hashes and of documents to change are broadcast only while they are counted to be short,
otherwise they are joined by shuffles.

Defined results: a null text stays null (no lines), an empty one is one empty line and stays; rows with the same id and
text count as one document and keep the same lines; null ids come first in the order; an empty table gives an empty
result; other columns of docs are carried along, whatever their names (one named ``_kept`` gives way to the result's).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Mean lines of a chunk, and the rows up to which a list is broadcast.
MEAN_LINES, BROADCAST_ROWS = 4, 300_000


def line_hash(line: Column) -> Column:
    """52 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 13), 16, 10).cast("long")


def chunks(text: Column, mean_lines: int = MEAN_LINES) -> Column:
    """The text's chunks in order: array of (first line, number of lines, their text)."""
    lines = F.split(text, "\n", -1)
    hashed = F.transform(lines, line_hash)
    parts = F.struct(lines.alias("lines"), hashed.alias("hashed"))

    def cut(parts: Column) -> Column:
        h = parts["hashed"]
        last = F.size(h) - 1
        rolling = lambda i: h[i].bitwiseXOR(F.shiftright(F.when(i > 0, F.get(h, i - 1)).otherwise(F.lit(0).cast("long")), 1))
        return F.filter(F.sequence(F.lit(0), last), lambda i: (F.pmod(rolling(i), F.lit(mean_lines)) == 0) | (i == last))

    def pieces(bound: Column) -> Column:
        lines, ends = bound["lines"], bound["ends"]
        start = lambda k: F.when(k > 0, F.get(ends, k - 1) + 1).otherwise(0)
        return F.transform(
            F.sequence(F.lit(0), F.size(ends) - 1),
            lambda k: F.struct(start(k).alias("first"), (ends[k] + 1 - start(k)).alias("n"), F.array_join(F.slice(lines, start(k) + 1, ends[k] + 1 - start(k)), "\n").alias("chunk")),
        )

    # transform over an array of one element binds a value once, so that lines are hashed and cut once.
    bound = F.transform(F.array(parts), lambda p: F.struct(p["lines"].alias("lines"), cut(p).alias("ends")))
    return F.when(text.isNotNull(), F.flatten(F.transform(bound, pieces)))


def windows(text: Column) -> Column:
    """Every two successive lines with words: array of (first line, number of lines with the empty ones between, their text)."""
    lines = F.split(text, "\n", -1)
    # transform over an array of one element binds a value once.
    split = lambda lines: F.struct(lines.alias("lines"), F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: lines[i].rlike(r"[^\x20\x09-\x0D]")).alias("full"))

    def pairs(bound: Column) -> Column:
        lines, full = bound["lines"], bound["full"]
        pair = lambda k: F.struct(full[k - 1].alias("first"), (full[k] - full[k - 1] + 1).alias("n"), F.concat_ws("\n", lines[full[k - 1]], lines[full[k]]).alias("chunk"))
        return F.when(F.size(full) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(full) - 1, F.lit(1))), pair))

    return F.when(text.isNotNull(), F.flatten(F.transform(F.transform(F.array(lines), split), pairs)))


def _short(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is counted to be short."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean_lines: int = MEAN_LINES) -> DataFrame:
    """doc, tie, gone: the places of the chunks to remove from the documents with this id and hash of the text."""
    again = _repeated(docs, id_col, text_col, lambda text: chunks(text, mean_lines))
    return again.groupBy("doc", "tie").agg(F.collect_set("place").alias("gone"))


def _repeated(docs: DataFrame, id_col: str, text_col: str, cut: Callable[[Column], Column]) -> DataFrame:
    """doc, tie, place, first, n: the pieces of two lines or more, of those cut from the texts, that are not the first occurrence of their bytes."""
    rows = docs.select(docs[id_col].cast("long").alias("doc"), F.xxhash64(docs[text_col]).alias("tie"), docs[text_col].alias("text"))
    each = rows.select("doc", "tie", F.posexplode(cut(F.col("text"))).alias("place", "c")).where("c.n > 1").select("doc", "tie", "place", F.col("c.first").alias("first"), F.col("c.n").alias("n"), F.col("c.chunk").alias("chunk"), F.xxhash64("c.chunk").alias("h"))
    recurring = stored(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "recurring-chunks")
    found = each.join(_short(recurring), "h")
    texts = stored(found.groupBy("h", "chunk").agg(F.count("*").alias("n"), F.min(F.struct("doc", "tie", "first")).alias("keep")), "chunk-texts")
    clashes = texts.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h", F.lit(True).alias("clash"))
    # Where all texts of a hash are equal bytes the hash stands for the text; else the text itself is compared.
    again = texts.where("n > 1").join(clashes, "h", "left").select("h", F.when(F.col("clash"), F.col("chunk")).alias("only"), "keep")
    again = _short(stored(again, "repeated-chunks"))
    gone = found.join(again, (found["h"] == again["h"]) & (again["only"].isNull() | (again["only"] == found["chunk"]))).where(~F.struct("doc", "tie", "first").eqNullSafe(F.col("keep")))
    return gone.select("doc", "tie", "place", "first", "n")


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, but for one named ``_kept``, and the operator's own ``_kept``."""
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "_kept"], F.col("kept").alias("_kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean_lines: int = MEAN_LINES) -> DataFrame:
    """docs with ``_kept``: struct of text, n_lines, n_chunks, n_removed_chunks, n_removed_lines."""
    return _unpacked(_deduped(docs, id_col, text_col, mean_lines), docs)


def _deduped(docs: DataFrame, id_col: str, text_col: str, mean_lines: int) -> DataFrame:
    """row: the columns of docs, and kept as dedup_lines has it."""
    gone = _short(stored(repeated_chunks(docs, id_col, text_col, mean_lines), "chunks-to-remove"))
    # The row is one column here, so that its columns' names do not meet those used below.
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("own"), F.xxhash64(docs[text_col]).alias("hash"), docs[text_col].alias("text"))
    joined = keyed.join(gone, keyed["own"].eqNullSafe(gone["doc"]) & (keyed["hash"] == gone["tie"]), "left")
    changed = F.col("gone").isNotNull()
    # Kept places come from a set difference, which hashes: looking up each chunk in the list of removed ones is quadratic. transform
    # over an array of one element binds the chunks once.
    places = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), "gone")
    left = F.flatten(F.transform(F.array(F.struct("all", places.alias("places"))), lambda x: F.transform(x["places"], lambda k: x["all"][k])))
    rows = joined.withColumn("all", chunks(F.col("text"), mean_lines)).withColumn("left", F.when(changed, left).otherwise(F.col("all")))
    count = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0).cast("long"))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    kept = F.struct(
        F.when(changed, F.array_join(F.transform("left", lambda c: c["chunk"]), "\n")).otherwise(F.col("text")).alias("text"),
        count("all").alias("n_lines"),
        size("all").alias("n_chunks"),
        (size("all") - size("left")).alias("n_removed_chunks"),
        (count("all") - count("left")).alias("n_removed_lines"),
    )
    return rows.select("row", kept.alias("kept"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean_lines: int = MEAN_LINES) -> DataFrame:
    """docs with their own columns: texts without the repeated chunks; documents of which no word is left are dropped."""
    rows = _deduped(docs, id_col, text_col, mean_lines)
    emptied = (F.col("kept.n_removed_chunks") > 0) & ~F.col("kept.text").rlike(r"[^\x20\x09-\x0D]")
    return rows.where(~emptied).select(*[F.col("kept.text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``_kept``: struct of text, n_lines, n_removed_lines; runs of two lines or more that occur earlier are removed."""
    again = _repeated(docs, id_col, text_col, windows).groupBy("doc", "tie").agg(F.collect_list(F.struct("first", "n")).alias("gone"))
    gone = _short(stored(again.select("doc", "tie", F.flatten(F.transform("gone", lambda w: F.sequence(w["first"], w["first"] + w["n"] - 1))).alias("gone")), "passages-to-remove"))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("own"), F.xxhash64(docs[text_col]).alias("hash"), docs[text_col].alias("text"))
    rows = keyed.join(gone, keyed["own"].eqNullSafe(gone["doc"]) & (keyed["hash"] == gone["tie"]), "left").withColumn("all", F.split("text", "\n", -1))
    rows = rows.withColumn("left", F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("all") - 1), "gone")))
    text = F.transform(F.array(F.struct("all", "left")), lambda x: F.array_join(F.transform(x["left"], lambda i: x["all"][i]), "\n"))[0]
    n = F.when(F.col("all").isNull(), 0).otherwise(F.size("all")).cast("long")
    kept = F.struct(F.when(F.col("left").isNotNull(), text).otherwise(F.col("text")).alias("text"), n.alias("n_lines"), F.when(F.col("left").isNotNull(), n - F.size("left")).otherwise(F.lit(0)).cast("long").alias("n_removed_lines"))
    return _unpacked(rows.select("row", kept.alias("kept")), docs)
