"""Lines of xz files, decoded in pieces: a block of a file is a task's work, and no task holds more than a piece of it.

An xz file is a row of streams; each ends with an index of its blocks (their packed and unpacked sizes) and a footer that says
how long the index is. The index is read from the file's end, so blocks are found without decoding any. A block is decoded
by giving the decoder its stream's header and then the block's bytes, in small steps. A file that was written as one block is
one task's work, in bounded memory.
"""

from __future__ import annotations

import lzma
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Bytes read and unpacked at once, and the longest piece of a line.
STEP = 1 << 20
HEADER, FOOTER = 12, 12
BLOCKS = "path string, block long, stream long, at long, packed long, unpacked long"


def opened(path: str) -> pa.NativeFile:
    store, inside = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(inside)


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, and where it ends."""
    value = shift = 0
    while True:
        value |= (data[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not data[at - 1] & 0x80:
            return value, at


def blocks(read: Callable[[int, int], bytes], size: int) -> list[tuple[int, int, int, int]]:
    """(start of the stream, start of the block, its packed size, its unpacked size) of all blocks of a file, in order; read(at, n) gives bytes."""
    out, end = [], size
    while end > 0:
        if read(end - 4, 4) == b"\0\0\0\0":  # padding between streams
            end -= 4
            continue
        footer = read(end - FOOTER, FOOTER)
        if footer[-2:] != b"YZ":
            raise ValueError("no xz file: its end is not that of a stream")
        length = (int.from_bytes(footer[4:8], "little") + 1) * 4
        index = read(end - FOOTER - length, length)
        n, at = _number(index, 1)
        sizes = []
        for _ in range(n):
            packed, at = _number(index, at)
            unpacked, at = _number(index, at)
            sizes.append((packed, unpacked))
        start = end - FOOTER - length - sum(-(-p // 4) * 4 for p, _ in sizes) - HEADER
        if start < 0:
            raise ValueError("no xz file: its index does not fit")
        place, own = start + HEADER, []
        for packed, unpacked in sizes:
            own.append((start, place, packed, unpacked))
            place += -(-packed // 4) * 4
        out, end = own + out, start
    return out


def unpacked(read: Callable[[int, int], bytes], stream: int, at: int, packed: int, size: int) -> Iterator[bytes]:
    """The bytes of one block, STEP at a time."""
    decoder = lzma.LZMADecompressor(lzma.FORMAT_XZ)
    decoder.decompress(read(stream, HEADER))
    to = at + packed
    while size > 0:
        data = b""
        if decoder.needs_input:
            if at >= to:
                raise EOFError("an xz block ends early")
            data = read(at, min(STEP, to - at))
            at += len(data)
        part = decoder.decompress(data, min(STEP, size))
        size -= len(part)
        if part:
            yield part


def line_pieces(parts: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """(text, whether the line ends with it): whole lines where they end in these parts, else pieces of STEP bytes at most."""
    rest = b""
    for part in parts:
        *whole, rest = (rest + part).split(b"\n")
        for line in whole:
            yield line, True
        while len(rest) > STEP:
            yield rest[:STEP], False
            rest = rest[STEP:]
    if rest:
        yield rest, False


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, place, text, ends: the lines of xz files in pieces, bytes as characters."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                with opened(name) as f:
                    found = blocks(lambda at, n, f=f: f.read_at(n, at), size)
                columns = [[name] * len(found), list(range(len(found))), *([b[k] for b in found] for k in range(4))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(columns)], ["path", "block", "stream", "at", "packed", "unpacked"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(name: str, block: int, held: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [name] * len(held), "block": pa.array([block] * len(held), pa.int64()), "place": pa.array([h[0] for h in held], pa.int64()), "text": [h[1].decode("latin-1") for h in held], "ends": [h[2] for h in held]})

        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["path"]) as f:
                    held, size = [], 0
                    for place, (text, ends) in enumerate(line_pieces(unpacked(lambda at, n, f=f: f.read_at(n, at), r["stream"], r["at"], r["packed"], r["unpacked"]))):
                        held.append((place, text, ends))
                        size += len(text) + 64
                        if size > STEP:
                            yield rows(r["path"], r["block"], held)
                            held, size = [], 0
                    if held:
                        yield rows(r["path"], r["block"], held)

    found = files.mapInArrow(index, BLOCKS)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(n, "path", "block").mapInArrow(decode, "file string, block long, place long, text string, ends boolean")
