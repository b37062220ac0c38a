"""FASTA records from lines, and from pieces of lines, wherever these come from.

A line's first > begins a record, and what follows it in the line is the record's name; what stands before it, and every line
without a >, is body of the record that is open. So a line is read without its neighbours, and the number of the record that it
belongs to is a running count of the lines with a >. No task holds a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import running_chunks

SPACES = r"[ \t\n\x0B\f\r]"


def joined(pieces: Column) -> Column:
    """The texts t of an array of (place ..., t), in order of their places."""
    return F.array_join(F.transform(F.array_sort(pieces), lambda p: p["t"]), "")


def records_of_lines(lines: DataFrame) -> DataFrame:
    """sample_id, name, body from lines (file, ord, value): records numbered in order of file and ord; lines before a file's first > are passed over."""
    at = F.instr("value", ">")
    rows = running_chunks(lines.select("file", "ord", "value"), "ord", {"record": F.when(at > 0, 1).otherwise(0)}, before=["file"])
    first = lines.where(at > 0).groupBy("file").agg(F.min("ord").alias("from"))
    rows = rows.join(first, "file").where(F.col("ord") >= F.col("from"))
    before = F.when(at > 0, F.expr("substring(value, 1, instr(value, '>') - 1)")).otherwise(F.col("value"))
    null = F.lit(None).cast("string")
    body = F.struct((F.col("record") - F.when(at > 0, 1).otherwise(0)).alias("record"), null.alias("name"), F.regexp_replace(before, SPACES, "").alias("t"), (F.col("ord") >= F.col("from")).alias("real"))
    head = F.struct(F.col("record"), F.expr("substring(value, instr(value, '>') + 1)").alias("name"), F.lit("").alias("t"), F.lit(True).alias("real"))
    # Text before the first > of a file belongs to no record.
    body = F.when((at > 0) & (F.col("ord") == F.col("from")), F.struct(*[body[c].alias(c) for c in ("record", "name", "t")], F.lit(False).alias("real"))).otherwise(body)
    each = rows.select("ord", F.inline(F.when(at > 0, F.array(body, head)).otherwise(F.array(body)))).where("real")
    found = each.groupBy("record").agg(F.max("name").alias("name"), joined(F.collect_list(F.struct("ord", "t"))).alias("body"))
    return found.select((F.col("record") - 1).alias("sample_id"), "name", "body")


def lines_of_pieces(pieces: DataFrame) -> DataFrame:
    """file, ord, value from pieces (file, block, place, text, ends): ends says whether the piece is a line's last. Texts are bytes, a character each."""
    rows = running_chunks(pieces, "place", {"upto": F.when(F.col("ends"), 1).otherwise(0)}, before=["file", "block"])
    line = F.col("upto") - F.when(F.col("ends"), 1).otherwise(0)
    found = rows.groupBy("file", line.alias("ord")).agg(joined(F.collect_list(F.struct("block", "place", F.col("text").alias("t")))).alias("text"))
    return found.select("file", "ord", F.decode(F.encode("text", "ISO-8859-1"), "UTF-8").alias("value"))
