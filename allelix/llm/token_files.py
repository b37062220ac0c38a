"""Token-ID / binary output: files of concatenated ids with Elias-Fano encoded document boundaries.

Texts are dealt by ranges of the id column, so that file k holds smaller ids than file k + 1; a task sorts its
range, encodes it batch by batch and writes one file. A file is::

    magic | token ids (2 or 4 bytes each, little endian) | boundaries | document ids | footer JSON | footer length | magic

Boundaries (ends of documents, counted in ids) and document ids are non-decreasing, and both are Elias-Fano
sequences: the low bits of each value packed, the high bits in unary with a count for every 512 bits of it, from
which select() starts. That is about 2 + log2(universe / n) bits a document, where a table of offsets has 64.

A file's global start is the sum of the ids in the files before it; those sums are made by two levels of windows
over the manifest. Files are written under a temporary name and renamed, and their content depends only on the
rows, so a task that is run again leaves the same file.

Defined results: a null text is empty, and its document has the end id alone; null ids come first; rows of one id
are ordered by a hash of the text, then the text; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, ids_and_text, new_dir, slices

MAGIC = b"EFIDS001"
#: White space of Unicode, and characters that some libraries count as such.
WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
MANIFEST = "shard int, path string, n_docs long, n_null_ids long, n_tokens long, n_bytes long"


class EliasFano:
    """A non-decreasing sequence of integers from 0 to below 2**63."""

    BLOCK = 512

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        pad = -len(ones) % (self.BLOCK // 8)
        self.before = np.concatenate([[0], np.cumsum(np.pad(ones, (0, pad)).reshape(-1, self.BLOCK // 8).sum(axis=1))])

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        high = np.zeros((n + (universe >> low_bits) + 8) // 8, np.uint8)
        at = (values >> low_bits) + np.arange(n)
        np.bitwise_or.at(high, at >> 3, (1 << (at & 7)).astype(np.uint8))
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), high)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        return (((self.low[at >> 3] >> (at & 7)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def select(self, i: np.ndarray | int) -> np.ndarray:
        """The values at the places i."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        block = np.searchsorted(self.before, i, "right") - 1
        width = self.BLOCK // 8
        at = np.empty(len(i), np.int64)
        for b in np.unique(block):
            ones = np.flatnonzero(np.unpackbits(self.high[b * width : (b + 1) * width], bitorder="little"))
            mine = block == b
            at[mine] = b * self.BLOCK + ones[i[mine] - self.before[b]]
        return ((at - i) << self.low_bits) | self._lows(i)

    def all(self) -> np.ndarray:
        i = np.arange(self.n)
        return ((np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - i) << self.low_bits) | self._lows(i)

    def dump(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def load(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b = struct.unpack_from("<QBQQ", data)
        return cls(n, low_bits, np.frombuffer(data, np.uint8, a, 25), np.frombuffer(data, np.uint8, b, 25 + a))


class Encoder:
    """Ids of whole texts by a byte-level BPE of the tokenizers library.

    A text is cut before each single space that stands between two characters that are no white space: there the
    byte-level pre-tokenizer starts a new piece whatever stands around, so the pieces' ids joined are the text's ids.
    The same holds around a line end that no white space touches. Each different piece of a Python worker is
    encoded once, as long as it is remembered: beyond ``most`` pieces, those that came in one batch only since the
    last time are forgotten, or all if that leaves more than half.

    For the same reason new pieces are encoded as texts of ``together`` pieces each, which costs far less than a
    text for each piece. The ids of one piece are those whose bytes are its bytes: a byte-level id stands for a
    fixed number of bytes. Where these do not end where the pieces end, each piece is encoded alone.
    """

    held: dict[str, Encoder] = {}

    @classmethod
    def at(cls, path: str) -> Encoder:
        """The worker's encoder for this file, which later tasks use again."""
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def __init__(self, path: str, most: int = 700_000, together: int = 200):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.together = most, together
        lengths = {i: len(token) for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        lengths |= {i: len(token.content.encode()) for i, token in self.tokenizer.get_added_tokens_decoder().items()}
        self.bytes = np.zeros(max(lengths) + 1, np.int64)
        self.bytes[list(lengths)] = list(lengths.values())
        # Each piece's place, and by place the end of its ids and whether it came again; arrays are longer than used.
        self.place: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)
        self.again = np.zeros(1 << 16, bool)

    def _forget(self) -> None:
        keep = np.flatnonzero(self.again[: len(self.place)])
        if len(keep) > self.most // 2:
            keep = keep[:0]
        start = self.ends[keep]
        size = self.ends[keep + 1] - start
        moved = np.cumsum(size)
        total = int(size.sum())
        self.ids[:total] = self.ids[np.repeat(start - moved + size, size) + np.arange(total)]
        self.ends[1 : len(keep) + 1] = moved
        self.again[:] = False
        pieces = list(self.place)  # in the order of their places
        self.place = {pieces[k]: place for place, k in enumerate(keep.tolist())}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        texts = pc.fill_null(texts, "")
        # Pieces carry the space before them; where white space meets a space, the text is not cut at it.
        odd = pc.match_substring_regex(texts, f" {WHITE}|{WHITE} ")
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(whole):
            return self._cut(texts)
        own = [np.asarray(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts.take(pa.array(whole)).to_pylist(), add_special_tokens=False)]
        rest, counts = self._cut(texts.filter(pc.invert(odd)))
        # Text whole[k] stands before the cut text whole[k] - k.
        cuts = np.concatenate([[0], np.cumsum(counts)])[whole - np.arange(len(whole))]
        parts, done = [], 0
        for x, cut in zip(own, cuts.tolist(), strict=True):
            parts += [rest[done:cut], x]
            done = cut
        counts = np.insert(counts, whole - np.arange(len(whole)), [len(x) for x in own])
        return np.concatenate([*parts, rest[done:]]), counts

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As encode, of texts that may be cut at each space."""
        # A single line end between other characters is a piece of its own; it gets spaces here so that one cut serves for both.
        alone = pc.invert(pc.match_substring_regex(texts, f"\n{WHITE}|{WHITE}\n"))
        lists = pc.split_pattern(pc.if_else(alone, pc.replace_substring(texts, "\n", " \n "), texts), " ")
        flat, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # not scalar by scalar
        lead = np.ones(len(flat), bool)
        line = np.flatnonzero(pc.equal(flat, "\n").to_numpy(zero_copy_only=False))
        lead[line] = False
        lead[line + 1] = False  # a text has a piece after each line end
        lead[np.concatenate([[0], ends])[:-1]] = False
        # Each word without and with the space before it.
        code = coded.indices.to_numpy(zero_copy_only=False) * 2 + lead
        used = np.zeros(2 * len(words), bool)
        used[code] = True
        used = np.flatnonzero(used)
        pieces = [" " + words[k >> 1] if k & 1 else words[k >> 1] for k in used.tolist()]
        if len(self.place) > self.most:
            self._forget()
        found = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(found < 0)
        self.again[found[found >= 0]] = True
        if len(new):
            known = len(self.place)
            found[new] = np.arange(known, known + len(new))
            new = [pieces[j] for j in new.tolist()]
            self.place.update(zip(new, range(known, known + len(new)), strict=True))
            self._learn(known, new)
        at = np.zeros(2 * len(words), np.int64)
        at[used] = found
        piece = at[code]
        start = self.ends[piece]
        size = self.ends[piece + 1] - start
        moved = np.cumsum(size)
        out = self.ids[np.repeat(start - moved + size, size) + np.arange(moved[-1] if len(moved) else 0)]
        return out, np.diff(np.concatenate([[0], moved])[np.concatenate([[0], ends])])

    def _learn(self, known: int, new: list[str]) -> None:
        """Keeps the ids of new pieces behind those of the pieces known."""
        ids, size = self._encoded(new)
        last = int(self.ends[known])
        self.ends = _longer(self.ends, known + len(new) + 1)
        self.ends[known + 1 : known + len(new) + 1] = last + np.cumsum(size)
        self.again = _longer(self.again, len(self.ends))
        self.ids = _longer(self.ids, last + len(ids))
        self.ids[last : last + len(ids)] = ids

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in order, and the number of each."""
        # A piece that has no space before it gets a line end, which is an id of its own.
        texts = [x if x[:1] == " " else "\n" + x for x in pieces]
        column = pa.array(texts, pa.large_string())
        # White space at either end of a piece might join what stands beside it.
        alone = pc.match_substring_regex(column, f"^[ \n]({WHITE}|$)|{WHITE}$").to_numpy(zero_copy_only=False)
        joint = np.flatnonzero(~alone)
        texts = [texts[k] for k in joint.tolist()] if alone.any() else texts
        ids, _ = self._plain(["".join(texts[k : k + self.together]) for k in range(0, len(texts), self.together)])
        to = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)[joint], dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(self.bytes[ids])])
        till = np.searchsorted(ends, to)
        if len(to) and (ends[-1] != to[-1] or (ends[till] != to).any()):
            return self._plain(pieces)
        own = np.diff(till, prepend=0)
        lines = np.fromiter((x[0] == "\n" for x in texts), bool, len(texts))
        drop = (till - own)[lines]
        if (self.bytes[ids[drop]] != 1).any():
            return self._plain(pieces)
        ids, own = np.delete(ids, drop), own - lines
        if len(joint) == len(pieces):
            return ids, own
        rest, size = np.empty(0, np.uint32), np.empty(len(pieces), np.int64)
        rest, size[alone] = self._plain([pieces[k] for k in np.flatnonzero(alone).tolist()])
        size[joint] = own
        mine = np.repeat(~alone, size)
        out = np.empty(len(mine), np.uint32)
        out[mine], out[~mine] = ids, rest
        return out, size

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _encoded, each text alone."""
        got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum())), size


def _longer(values: np.ndarray, n: int) -> np.ndarray:
    """The array with room for n values, twice its size at least if it grows."""
    return values if n <= len(values) else np.concatenate([values, np.zeros(max(n, 2 * len(values)) - len(values), values.dtype)])


def _write(folder: str, tokenizer: str, end_id: int | None, width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, sizes, ids, nulls = None, None, [], [], 0
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}.efids"
        system, top = file_system(folder)
        dtype = np.dtype("<u2" if width == 2 else "<u4")
        for batch in batches:
            for part in slices(batch, "text"):
                if encoder is None:
                    encoder = Encoder.at(tokenizer)
                    system.create_dir(top, recursive=True)
                    temporary = f"{top}/_{name}.{TaskContext.get().taskAttemptId()}"
                    out = system.open_output_stream(temporary)
                    out.write(MAGIC)
                tokens, count = encoder.encode(part.column("text"))
                if end_id is not None:
                    tokens, count = np.insert(tokens, np.cumsum(count), end_id), count + 1
                if len(tokens) and int(tokens.max()) > np.iinfo(dtype).max:
                    raise ValueError(f"ids need more than {width} bytes")
                out.write(tokens.astype(dtype).tobytes())
                sizes.append(count)
                nulls += part.column("doc_id").null_count
                ids.append(pc.drop_null(part.column("doc_id")).to_numpy(zero_copy_only=False))
        if out is None:
            return
        ends, ids = np.cumsum(np.concatenate(sizes)), np.concatenate(ids)
        lowest = int(ids[0]) if len(ids) else 0
        a, b = EliasFano.of(ends).dump(), EliasFano.of(ids - lowest).dump()
        footer = json.dumps({"n_docs": len(ends), "n_null_ids": nulls, "n_tokens": int(ends[-1]), "width": width, "lowest_id": lowest, "boundaries": len(a), "document_ids": len(b)}).encode()
        out.write(a + b + footer + struct.pack("<I", len(footer)) + MAGIC)
        size = out.tell()
        out.close()
        system.move(temporary, f"{top}/{name}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": [len(ends)], "n_null_ids": [nulls], "n_tokens": [int(ends[-1])], "n_bytes": [size]})

    return work


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, width: int = 2, shards: int | None = None) -> DataFrame:
    """Writes the files below folder, and returns their manifest (MANIFEST), kept beside them as Parquet."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ids_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    dealt.mapInArrow(_write(f"{folder}/files", tokenizer, end_id, width), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def with_starts(manifest: DataFrame, group: int = 4096) -> DataFrame:
    """Adds start: the ids in all files before. Sums over groups of files first, so no task holds a long manifest."""
    part = F.floor(F.col("shard") / group)
    sums = manifest.groupBy(part.alias("part")).agg(F.sum("n_tokens").alias("total"))
    above = sums.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("above"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    return manifest.withColumn("part", part).withColumn("within", within).join(above, "part").withColumn("start", F.col("above") + F.col("within")).drop("part", "within", "above")


class TokenFile:
    """One file, open for reads of any documents' ids."""

    def __init__(self, path: str):
        system, inner = file_system(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        self.file.seek(size - 12)
        (length,), magic = struct.unpack("<I", self.file.read(4)), self.file.read(8)
        if magic != MAGIC:
            raise ValueError(f"no token file: {path}")
        self.file.seek(size - 12 - length)
        self.meta = json.loads(self.file.read(length))
        a, b = self.meta["boundaries"], self.meta["document_ids"]
        self.file.seek(size - 12 - length - a - b)
        self.ends = EliasFano.load(self.file.read(a))
        self.doc_ids = EliasFano.load(self.file.read(b))

    def bounds(self, i: int, j: int) -> np.ndarray:
        """Offsets of the documents i to j - 1 and the end of the last."""
        head = np.zeros(1, np.int64) if i == 0 else self.ends.select(i - 1)
        return np.concatenate([head, self.ends.select(np.arange(i, j))])

    def ids(self, start: int, end: int) -> np.ndarray:
        width = self.meta["width"]
        self.file.seek(len(MAGIC) + start * width)
        return np.frombuffer(self.file.read((end - start) * width), f"<u{width}")

    def doc_id(self, i: int, j: int) -> list[int | None]:
        nulls = self.meta["n_null_ids"]
        known = self.doc_ids.select(np.arange(max(0, i - nulls), max(0, j - nulls))) + self.meta["lowest_id"]
        return [None] * (max(0, min(j, nulls) - i)) + known.tolist()


def read_token_files(manifest: DataFrame, docs_at_once: int = 512, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, and the ids if asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(row["path"])
                n = file.meta["n_docs"]
                for i in range(0, n, docs_at_once):
                    j = min(n, i + docs_at_once)
                    bounds = file.bounds(i, j)
                    out: dict[str, list] = {"doc_id": pa.array(file.doc_id(i, j), pa.int64()), "start": pa.array(bounds[:-1] + row["start"]), "n_tokens": pa.array(np.diff(bounds)), "ids_crc32": []}
                    if with_ids:
                        out["ids"] = []
                    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                        ids = file.ids(a, b)
                        out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                        if with_ids:
                            out["ids"].append(ids.tolist())
                    if with_ids:
                        out["ids"] = pa.array(out["ids"], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    files = with_starts(manifest).select("path", "start")
    return files.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(work, schema)


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Writes docs into files below folder (default: a new one in the shared folder) and reads them back."""
    return read_token_files(write_token_files(docs, folder or new_dir(docs.sparkSession, "token-files"), tokenizer, **options))
