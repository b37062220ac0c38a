"""FASTA records from streams of text: a stateful assembler that carries an unfinished record over micro-batches.

A stream is cut into chunks at any characters: rows (stream, seq, chunk, last), seq counting from 0, in any order. The state
of a stream is where reading stands (the open record, how many symbols of it have been given out, the name as far as read)
and the chunks that came before their turn. Body symbols are given out as they come, with the place of the first, so the
state does not grow with the length of a record; a record's rows are put together afterwards by ``records_of``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lines import joined

PIECES = "stream string, record long, start long, name string, body string"
STATE = "held string"


@dataclass
class Reader:
    """Where the reading of one stream stands. header: the open record's name as far as read, None in its body."""

    next: int = 0
    record: int = -1
    start: int = 0
    header: str | None = None
    early: dict[str, list] = field(default_factory=dict)

    def take(self, seq: int, chunk: str, last: bool) -> Iterator[tuple[int, int, str | None, str]]:
        """(record, start, name, body) of what this chunk, and chunks that waited for it, bring."""
        self.early[str(seq)] = [chunk, last]
        while str(self.next) in self.early:
            text, ends = self.early.pop(str(self.next))
            self.next += 1
            yield from self._read(text)
            if ends and self.header is not None:
                name, self.header = self.header, None
                yield self.record, 0, name, ""

    def _read(self, text: str) -> Iterator[tuple[int, int, str | None, str]]:
        while text:
            if self.header is not None:
                name, line_end, text = text.partition("\n")
                self.header += name
                if line_end:
                    yield self.record, 0, self.header, ""
                    self.header, self.start = None, 0
            else:
                body, begins, text = text.partition(">")
                body = re.sub(r"[ \t\n\x0B\f\r]", "", body)
                if body and self.record >= 0:
                    yield self.record, self.start, None, body
                    self.start += len(body)
                if begins:
                    self.record, self.header = self.record + 1, ""


def assembled(chunks: DataFrame) -> DataFrame:
    """PIECES from a stream (or a table) of chunks: stream, seq, chunk, last."""

    def work(key, frames, state):
        reader = Reader(**json.loads(state.get[0])) if state.exists else Reader()
        out = []
        for frame in frames:
            for seq, chunk, last in zip(frame["seq"], frame["chunk"], frame["last"], strict=True):
                out += [(key[0], *p) for p in reader.take(int(seq), chunk or "", bool(last))]
        state.update((json.dumps(vars(reader)),))
        yield pd.DataFrame(out, columns=["stream", "record", "start", "name", "body"])

    rows = chunks.select(F.col("stream").cast("string").alias("stream"), "seq", "chunk", "last")
    return rows.groupBy("stream").applyInPandasWithState(work, PIECES, STATE, "append", "NoTimeout")


def records_of(pieces: DataFrame) -> DataFrame:
    """stream, record, name, body from the pieces that a stream has given out."""
    return pieces.groupBy("stream", "record").agg(F.max("name").alias("name"), joined(F.collect_list(F.struct("start", F.col("body").alias("t")))).alias("body"))
