"""WARC archives with a two-level capture index.

Pages are dealt by ranges of the reversed-host URL key, and a task sorts its range and writes one archive, a gzip
member for each record, with one index file beside it. The index file holds the sorted capture lines
``key page_id offset length type refers_to`` in compressed blocks of ``block_lines`` lines; for each block the
directory (a Parquet table, in key order over all archives) keeps the first key and where the block stands.
A look-up searches the directory, reads one block, searches it, and reads the record's bytes only; ``archive_pages`` looks all
its pages up so, ``read_archives`` walks all blocks instead.

Equal payloads (length and SHA-1) of ``least_bytes`` or more are stored once: the largest page_id is the response,
the others are revisits that name it. Copies are counted by a partial aggregate over (length, SHA-1) before any
shuffle, and the list of repeated payloads is joined by broadcast only while it is counted to be short.

Defined results: a null html is an empty payload; a null url has an empty key; rows of one page_id are separate
records, of which each may be the response; a group whose page_ids are all null has no revisit; an empty table gives
no archive and an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import file_system, new_dir, slices

DIRECTORY = "archive int, block int, path string, first_key string, offset long, length long, n_records int"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Blocks of the directory that one task of a look-up searches.
PART_BLOCKS = 64
TYPES = {"payload_bytes": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
#: Most repeated payloads whose list is broadcast (about 60 bytes each).
BROADCAST_ROWS = 200_000


def url_key(url: Column) -> Column:
    """Reversed host, then the rest: http://www.a.org:80/x?y -> org,a,www)/x?y, in lower case up to the bracket."""
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)"
    host, rest = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
    reversed_host = F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ",")
    key = F.when(host != "", F.concat(reversed_host, F.lit(")"), rest)).otherwise(url)
    return F.translate(F.coalesce(key, F.lit("")), " \n\r\t", "____")


def _record(kind: str, url: str, page_id: int | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record's gzip member."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _gzip(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write(folder: str, block_lines: int, level: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, system, top = task.partitionId(), *file_system(folder)
        name = f"{top}/part-{shard:06d}"
        files: list = []
        lines: list[str] = []
        found: dict[str, list] = {"archive": [], "block": [], "path": [], "first_key": [], "offset": [], "length": [], "n_records": []}
        at = index_at = 0

        def flush() -> None:
            nonlocal index_at
            data = _gzip("\n".join(lines).encode(), 6)
            files[1].write(data)
            for k, v in (("archive", shard), ("block", len(found["block"])), ("path", f"{folder}/part-{shard:06d}"), ("first_key", lines[0].split(" ", 1)[0]), ("offset", index_at), ("length", len(data)), ("n_records", len(lines))):
                found[k].append(v)
            index_at += len(data)
            lines.clear()

        for batch in batches:
            for part in slices(batch, "html"):
                if not files:
                    system.create_dir(top, recursive=True)
                    files = [system.open_output_stream(f"{name}{end}.{task.taskAttemptId()}") for end in (".warc.gz", ".cdx")]
                for row in part.to_pylist():
                    payload = (row["html"] or "").encode()
                    kind = "response" if row["refers_to"] is None else "revisit"
                    data = _gzip(_record(kind, row["url"] or "", row["page_id"], payload, row["digest"], row["refers_to"]), level)
                    files[0].write(data)
                    lines.append(f"{row['key']} {row['page_id']} {at} {len(data)} {kind} {row['refers_to']}")
                    at += len(data)
                    if len(lines) == block_lines:
                        flush()
        if files:
            if lines:
                flush()
            for file, end in zip(files, (".warc.gz", ".cdx"), strict=True):
                file.close()
                system.move(f"{name}{end}.{task.taskAttemptId()}", name + end)
            found["archive"], found["block"], found["n_records"] = (pa.array(found[k], pa.int32()) for k in ("archive", "block", "n_records"))
            yield pa.RecordBatch.from_pydict(found)

    return work


def with_referral(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Adds digest and refers_to (null for a response)."""
    data = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.withColumn("digest", F.sha1(data)).withColumn("size", F.octet_length(data))
    groups = rows.where(F.col("size") >= least_bytes).groupBy("size", "digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
    repeated = groups.where("copies > 1 AND keeper IS NOT NULL").drop("copies")
    if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(repeated), ["size", "digest"], "left")
    else:
        joined = rows.join(repeated, ["size", "digest"], "left")
    return joined.withColumn("refers_to", F.when(F.col("keeper").eqNullSafe(F.col("page_id")), None).otherwise(F.col("keeper"))).drop("keeper", "size")


def write_archives(pages: DataFrame, folder: str, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000, block_lines: int = 300, level: int = 3, shards: int | None = None) -> DataFrame:
    """Writes archives and index below folder; returns the directory (DIRECTORY), kept beside them as Parquet."""
    spark = pages.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(pages[page_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    keyed = with_referral(rows, least_bytes).withColumn("url", F.translate("url", "\r\n", "")).withColumn("key", url_key(F.col("url")))
    dealt = keyed.repartitionByRange(shards, "key", "page_id").sortWithinPartitions("key", "page_id")
    dealt.mapInArrow(_write(f"{folder}/archives", block_lines, level), DIRECTORY).write.parquet(f"{folder}/directory")
    return spark.read.schema(DIRECTORY).parquet(f"{folder}/directory")


def _lines(file, offset: int, length: int) -> list[list[str]]:
    file.seek(offset)
    return [x.split(" ") for x in zlib.decompress(file.read(length), 31).decode().split("\n")]


def _open(path: str):
    system, inner = file_system(path)
    return system.open_input_file(inner)


def _found(line: list[str], archive) -> dict:
    archive.seek(int(line[2]))
    headers, payload = parse_record(archive.read(int(line[3])))
    kind = headers["WARC-Type"]
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(headers["X-Payload-Length"])):
        raise ValueError(f"damaged record for page {line[1]}")
    number = lambda x: None if x == "None" else int(x)
    refers = headers.get("WARC-Refers-To")
    page = headers["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
    return {"page_id": number(page), "url": headers["WARC-Target-URI"], "payload_bytes": int(headers["X-Payload-Length"]), "payload_digest": digest, "record_type": kind, "refers_to": refers and number(refers.removeprefix("<urn:page:").removesuffix(">")), "payload": payload}


def read_archives(directory: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record, read through the index: a task takes blocks, and from each its lines and their bytes."""
    schema = RECORDS + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                with _open(block["path"] + ".cdx") as index, _open(block["path"] + ".warc.gz") as archive:
                    rows = [_found(line, archive) for line in _lines(index, block["offset"], block["length"])]
                yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], TYPES.get(k, pa.string())) for k in names})

    return directory.select("path", "offset", "length").repartition(int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(work, schema)


def look_up(directory: DataFrame, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The captures of each different url.

    The first key of each PART_BLOCKS blocks (one row for so many blocks) tells which parts of the directory may hold a
    key; a task then gets one part and the keys for it in order, and for each key searches that part, reads the block
    unless it is the one just read, searches its lines and reads the records' bytes.
    """
    place = F.floor(F.col("block") / PART_BLOCKS).cast("int")
    parts = directory.withColumn("part", place)
    firsts = parts.groupBy("archive", "part").agg(F.min("first_key").alias("first")).orderBy("archive", "part").collect()
    named, keys = [(r["archive"], r["part"]) for r in firsts], [r["first"] for r in firsts]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, *named[i]) for k in batch.column("key").to_pylist() for i in range(max(0, bisect.bisect_left(keys, k) - 1), bisect.bisect_right(keys, k))]
            yield pa.RecordBatch.from_pydict({"key": pa.array([x[0] for x in found], pa.string()), "archive": pa.array([x[1] for x in found], pa.int32()), "part": pa.array([x[2] for x in found], pa.int32())})

    def read(wanted: pa.Table, blocks: pa.Table) -> pa.Table:
        rows = []
        part = sorted(blocks.to_pylist(), key=lambda r: r["block"])
        starts = [r["first_key"] for r in part]
        if part and wanted.num_rows:
            held, lines = -1, []
            with _open(part[0]["path"] + ".cdx") as index, _open(part[0]["path"] + ".warc.gz") as archive:
                for key in sorted(wanted["key"].to_pylist()):
                    for at in range(max(0, bisect.bisect_left(starts, key) - 1), bisect.bisect_right(starts, key)):
                        if at != held:
                            held, lines = at, _lines(index, part[at]["offset"], part[at]["length"])
                        i = bisect.bisect_left(lines, key, key=lambda x: x[0])
                        while i < len(lines) and lines[i][0] == key:
                            found = _found(lines[i], archive)
                            del found["payload"]
                            rows.append(found)
                            i += 1
        names = [x.split()[0] for x in RECORDS.split(", ")]
        return pa.table({k: pa.array([r[k] for r in rows], TYPES.get(k, pa.string())) for k in names})

    wanted = urls.select(url_key(F.translate(F.col(url_col).cast("string"), "\r\n", "")).alias("key")).distinct()
    dealt = wanted.mapInArrow(places, "key string, archive int, part int")
    return dealt.groupBy("archive", "part").cogroup(parts.groupBy("archive", "part")).applyInArrow(read, RECORDS)


def archive_pages(pages: DataFrame, folder: str | None = None, url_col: str = "url", **options) -> DataFrame:
    """Writes pages into archives below folder (default: a new one in the shared folder) and looks every page's url up in them.

    A record stands under one key, so it comes back once.
    """
    return look_up(write_archives(pages, folder or new_dir(pages.sparkSession, "warc"), url_col=url_col, **options), pages, url_col)
