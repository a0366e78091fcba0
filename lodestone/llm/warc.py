"""WARC archives: a writer, the normaliser that gives every record its own gzip member, and a reader by index."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, remove

#: Inflated bytes after which a writing task begins another archive.
ARCHIVE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 18


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:lodestone:page:{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    tail = name.rstrip(">").rpartition(":")[2]
    return int(tail) if tail else None


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, revisit: bool) -> bytes:
    """One response or revisit record; a revisit keeps the HTTP head, which tells the payload's length, without the payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and block of one record; a field may go on in lines that begin with a blank."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields: dict[str, str] = {}
    name = ""
    for line in head.decode(errors="replace").split("\r\n")[1:]:
        if line[:1] in " \t" and name:
            fields[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields, rest[: int(fields["content-length"])]


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, piece by piece."""
    z, fed = zlib.decompressobj(31), False
    while piece := source.read(_CHUNK):
        while piece:
            out = z.decompress(piece)
            fed = True
            if out:
                yield out
            if not z.eof:
                break
            piece, z, fed = z.unused_data, zlib.decompressobj(31), False
    if fed and not z.eof:
        raise ValueError("the gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a WARC byte stream, holding one record at a time."""
    buffer = bytearray()

    def need(test) -> int:
        while (found := test()) < 0:
            piece = next(pieces, None)
            if piece is None:
                return -1
            buffer.extend(piece)
        return found

    while True:
        end = need(lambda: buffer.find(b"\r\n\r\n"))
        if end < 0:
            if buffer.strip():
                raise ValueError("the archive ends within a record")
            return
        head = bytes(buffer[:end]).decode(errors="replace")
        if not head.startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        length = next((int(x.partition(":")[2]) for x in head.split("\r\n") if x.partition(":")[0].strip().lower() == "content-length"), None)
        if length is None:
            raise ValueError("a WARC record does not tell its length")
        whole = end + 4 + length + 4
        if need(lambda n=whole: n if len(buffer) >= n else -1) < 0:
            raise ValueError("the archive ends within a record")
        yield bytes(buffer[:whole])
        del buffer[:whole]


def normalise(source: str, archive: str, index: str) -> int:
    """Inflates a whole-file stream once and rewrites each record as its own gzip member; the sidecar index holds a
    JSON line for each record: offset and length of its member, record id, type and payload digest, null where a record
    has none (warcinfo, request, metadata and others are kept like any record)."""
    store, path = _store(source)
    out_store, out_path = _store(archive)
    _, index_path = _store(index)
    at = count = 0
    with store.open_input_stream(path, compression=None) as src, out_store.open_output_stream(out_path, compression=None) as out, out_store.open_output_stream(index_path, compression=None) as side:
        for raw in records(inflated(src)):
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = z.compress(raw) + z.flush()
            fields, _ = parse(raw)
            line = {"offset": at, "length": len(member), "id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "digest": fields.get("warc-payload-digest")}
            out.write(member)
            side.write((json.dumps(line) + "\n").encode())
            at += len(member)
            count += 1
    return count


def read(archive: str, index: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Each record of a normalised archive, fetched by its index entry."""
    store, path = _store(archive)
    _, index_path = _store(index)
    rest = b""
    with store.open_input_file(path) as src, store.open_input_stream(index_path, compression=None) as side:
        while True:
            piece = side.read(_CHUNK)
            *lines, rest = (rest + piece).split(b"\n")
            for line in lines:
                entry = json.loads(line)
                src.seek(entry["offset"])
                yield parse(zlib.decompress(src.read(entry["length"]), 31))
            if not piece:
                return


def _write(folder: str, archive_bytes: int):
    """Batches of (page_id, url, html, sha1 hex, first page) to monolithic archives; a row (file, records) for each.

    Names hold a random part, and only the rows of committed tasks are read later: a task that is run twice,
    or lost on the way, leaves at most a file that nobody reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        done, out, z, size, count, name = [], None, None, 0, 0, ""

        def close() -> None:
            nonlocal out
            out.write(z.flush())
            out.close()
            done.append((f"{folder}/{name}", count))
            out = None

        for batch in batches:
            for page_id, url, html, sha, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    store.create_dir(path, recursive=True)
                    out, z = store.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                payload = (html or "").encode()
                raw = record(page_id, url, payload, base64.b32encode(bytes.fromhex(sha)).decode(), first, first is not None and page_id != first)
                out.write(z.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= archive_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["file", "records"])

    return run


def _normalise(folder: str):
    def run(batches):
        for batch in batches:
            rows = []
            for source in batch.column(0).to_pylist():
                store, path = _store(folder)
                store.create_dir(path, recursive=True)
                name = f"{folder}/{uuid.uuid4().hex}"
                rows.append((f"{name}.warc.gz", f"{name}.idx", normalise(source, f"{name}.warc.gz", f"{name}.idx")))
            yield pa.RecordBatch.from_pylist([{"archive": a, "idx": i, "records": n} for a, i, n in rows], pa.schema([("archive", pa.string()), ("idx", pa.string()), ("records", pa.int64())]))

    return run


def _read(batches):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            for fields, block in read(archive, index):
                kind = fields.get("warc-type")
                if kind not in ("response", "revisit"):
                    continue
                head, _, payload = block.partition(b"\r\n\r\n")
                size = int(head.rpartition(b"Content-Length: ")[2])
                sha = fields["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload) != size or digest(payload) != sha):
                    raise ValueError(f"{fields['warc-record-id']}: the payload does not match its digest")
                rows.append((_page(fields["warc-record-id"]), size, sha, kind, _page(fields["warc-refers-to"]) if kind == "revisit" else None))
                if len(rows) == 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as normalised archives below `folder`; a row (archive, idx, records) for each.

    Of pages with equal payloads of at least min_bytes the one with the smallest page_id is a response and the
    others revisit it; smaller payloads are all responses. Null html is an empty payload; a null page_id never
    is the one revisited; rows that repeat the response's page_id are responses too. No rows give no archive."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    src = src.withColumn("sha", F.sha1(F.encode("html", "UTF-8"))).withColumn("long_enough", F.octet_length("html") >= min_bytes)
    first = src.where("long_enough").groupBy("sha").agg(F.min("page_id").alias("first"))
    rows = src.join(first, "sha", "left").select("page_id", "url", "html", "sha", F.when(F.col("long_enough"), F.col("first")).alias("first"))
    tables = Scratch(spark, "warc")
    whole = tables.cut(rows.mapInArrow(_write(f"{folder}/monolithic", archive_bytes), "file string, records long"), "monolithic")
    files = whole.count()
    spread = whole.repartition(max(1, min(files, spark.sparkContext.defaultParallelism * 4)))
    out = tables.cut(spread.mapInArrow(_normalise(f"{folder}/archives"), "archive string, idx string, records long"), "archives")
    remove(spark, f"{folder}/monolithic")
    return out


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; a response whose payload does
    not match its digest is an error."""
    n = max(1, archives.sparkSession.sparkContext.defaultParallelism * 2)
    return archives.select("archive", "idx").repartition(n).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
