"""WARC archives with a two-level capture index.

Archives. Every row becomes one record, a gzip member of its own, in files of
bounded size in the shared folder. Of records with equal payloads of at least
``min_revisit`` bytes the one with the smallest page_id is a response; the
others are revisits, without payload. A file's name is new for every attempt of
a task and only the rows of finished tasks name it, so lost executors leave
unused files, never wrong ones.

Index. Level one: captures sorted by their key (URL with reversed host, then
page id) in files of compressed blocks of ``block_lines`` lines. Level two: per
file a sparse directory with each block's first key, offset and length. A look-
up finds the file by binary search in the files' first keys (as many as range
partitions), the block by binary search in that file's directory, and only then
reads the block's range; the captures found are read from the archives in file
and offset order, neighbouring ranges in one read.

Scale. Payloads move once, in the join that marks revisits, and only if its
other side (one short row for each repeated payload) is too large to be sent
along; the engine checks that, and splits a payload that many rows share. Keys
are dealt by range over URL and page id, so one host may have any share of them.

Null html is an empty payload, null url an empty key. A null page_id is never
the smallest; a payload that only such rows have is a response each time. Rows
that repeat the smallest page_id are all responses. Every row gives one row.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opfold.llm.common import shared_path, written

MIN_REVISIT, FILE_BYTES, BLOCK_LINES, READ_BYTES = 100, 64 << 20, 1000, 4 << 20
CAPTURES = "key string, file string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, then path and query; ASCII without spaces."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return quote(url, safe="/?&=:,)")
    at = "" if port in (None, 80, 443) else f":{port}"
    return quote(",".join(reversed(host.split("."))) + at + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), safe="/?&=%:,)~+;@!$'(*")


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{url_key(url)} {'-' if page_id is None else page_id}"


def header(name: str, value: object) -> bytes:
    return f"{name}: {value}\r\n".encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one WARC record."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + header("Content-Length", len(payload)) + b"\r\n"
    block = http if revisit else http + payload
    head = b"WARC/1.1\r\n" + header("WARC-Type", "revisit" if revisit else "response") + header("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>") + header("WARC-Date", "2024-01-01T00:00:00Z")
    if url is not None:
        head += header("WARC-Target-URI", quote(url, safe="/?&=%:,)~+;@!$'(*#[]"))
        head += header("X-Target-URI-Original", quote(url, safe=""))
    if page_id is not None:
        head += header("X-Page-ID", page_id)
    head += header("WARC-Payload-Digest", f"sha256:{digest}")
    if revisit:
        head += header("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest") + header("X-Refers-To-Page-ID", refers_to)
    return head + header("Content-Type", "application/http; msgtype=response") + header("Content-Length", len(block)) + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields and payload of a record; a response's payload must have the digest it claims."""
    from urllib.parse import unquote

    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a record's payload is not what its header says")
    number = lambda name: int(fields[name]) if name in fields else None
    url = unquote(fields["X-Target-URI-Original"]) if "X-Target-URI-Original" in fields else None
    return {"page_id": number("X-Page-ID"), "url": url, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"), "payload_bytes": size, "payload_digest": digest, "payload": payload if fields["WARC-Type"] == "response" else None}


def marked(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest and refers_to of every row."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    shared = base.filter(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select(F.col("digest").alias("same"), "first")
    shared = written(shared, "payloads")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return base.join(shared, base.digest == shared.same, "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(rows: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives under ``path``; key, file, offset and length of every capture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(path)
        store.create_dir(root, recursive=True)
        name, out, at = None, None, 0
        for batch in batches:
            found: list[tuple[str, str, int, int]] = []
            for page_id, url, payload, digest, refers_to in zip(*(c for c in batch.columns), strict=True):
                if out is None or at >= file_bytes:
                    if out:
                        out.close()
                    name, at = f"{path}/archive-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name.rsplit('/', 1)[1]}", compression=None)
                pack = zlib.compressobj(5, zlib.DEFLATED, 31)
                member = pack.compress(record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py())) + pack.flush()
                out.write(member)
                found.append((capture_key(url.as_py(), page_id.as_py()), name, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "file", "offset", "length"])
        if out:
            out.close()

    return written(rows.mapInArrow(run, CAPTURES), "captures")


def write_index(captures: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write both index levels under ``path``; first key, last key, index file and directory file of every range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(path)
        store.create_dir(root, recursive=True)
        name = f"cdx-{uuid.uuid4().hex}"
        out, at, lines, directory, first, last = None, 0, [], [], None, None

        def close_block() -> None:
            nonlocal at, lines
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = pack.compress("\n".join(lines).encode()) + pack.flush()
            out.write(member)
            directory.append(f"{lines[0].split('\t', 1)[0]}\t{at}\t{len(member)}")
            at, lines = at + len(member), []

        for batch in batches:
            for key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out, first = store.open_output_stream(f"{root}/{name}.gz", compression=None), key
                last = key
                lines.append(f"{key}\t{file}\t{offset}\t{length}")
                if len(lines) == block_lines:
                    close_block()
        if out:
            if lines:
                close_block()
            out.close()
            with store.open_output_stream(f"{root}/{name}.dir", compression=None) as side:
                side.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (first, last, f"{path}/{name}.gz", f"{path}/{name}.dir")], names=["first", "last", "file", "directory"])

    dealt = captures.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return written(dealt.mapInArrow(run, "first string, last string, file string, directory string"), "directory")


def look_up(index: DataFrame, keys: DataFrame) -> DataFrame:
    """The captures of the given keys: by binary search, then range reads."""
    spark = index.sparkSession
    ranges = sorted(index.select("first", "last", "file", "directory").toLocalIterator())  # as many as range partitions
    shared = spark.sparkContext.broadcast(ranges)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [r[0] for r in shared.value]
        for batch in batches:
            wanted, place_of = [], []
            for key in batch.column(0).to_pylist():
                k = max(0, bisect.bisect_left(firsts, key) - 1)
                while k < len(firsts) and firsts[k] <= key:  # a key may fill more than one file
                    if key <= shared.value[k][1]:
                        wanted.append(key)
                        place_of.append(k)
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.string()), pa.array(place_of, pa.int32())], names=["key", "range"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, store, source, firsts, spans, block_no, block_keys, block = None, None, None, [], [], None, [], []
        for batch in batches:
            found: list[list[str]] = []
            for key, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != here:
                    here, block_no = k, None
                    _, _, file, side = shared.value[k]
                    store, at = store_of(side)
                    with store.open_input_stream(at, compression=None) as stream:
                        entries = [line.split("\t") for line in stream.read().decode().split("\n")]
                    firsts, spans = [e[0] for e in entries], [(int(e[1]), int(e[2])) for e in entries]
                    source = store.open_input_file(store_of(file)[1])
                b = max(0, bisect.bisect_left(firsts, key) - 1)
                while b < len(firsts) and firsts[b] <= key:
                    if b != block_no:
                        block_no, raw = b, source.read_at(spans[b][1], spans[b][0])
                        block = [line.split("\t") for line in zlib.decompress(raw, 31).decode().split("\n")]
                        block_keys = [line[0] for line in block]
                    i = bisect.bisect_left(block_keys, key)
                    while i < len(block) and block_keys[i] == key:
                        found.append(block[i])
                        i += 1
                    b += 1
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([int(f[2]) for f in found], pa.int64()), pa.array([int(f[3]) for f in found], pa.int64())], names=["key", "file", "offset", "length"])

    return keys.select("key").distinct().mapInArrow(place, "key string, range int").repartition("range").sortWithinPartitions("range", "key").mapInArrow(find, CAPTURES)


def read_records(captures: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records at the captures' ranges, read in file and offset order."""
    schema = RECORDS + (", payload binary" if with_payload else "")
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, source = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            found, k = [], 0
            while k < len(rows):
                file, start, end, j = rows[k][0], rows[k][1], rows[k][1] + rows[k][2], k + 1
                while j < len(rows) and rows[j][0] == file and rows[j][1] == end and end - start < READ_BYTES:
                    end += rows[j][2]
                    j += 1
                if file != here:
                    store, at = store_of(file)
                    here, source = file, store.open_input_file(at)
                raw = source.read_at(end - start, start)
                found += [parse(zlib.decompress(raw[o - start : o - start + n], 31)) for _, o, n in rows[k:j]]
                k = j
                if len(found) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], kinds.get(n, pa.string())) for n in names], names=names)
                    found = []
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], kinds.get(n, pa.string())) for n in names], names=names)

    return captures.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write archives and index of all pages, then read every record back through the index."""
    path = shared_path(pages.sparkSession, "warc")
    captures = write_archives(marked(pages, min_revisit), path)
    index = write_index(captures, f"{path}/index")
    return read_records(look_up(index, captures.select("key")))
