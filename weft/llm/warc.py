"""WARC archives with a Zstandard dictionary.

Each task writes archives (``.warc.zst``): a skippable frame that holds a dictionary built from a spread sample of the archive's own
records, then one Zstandard frame per record, so any record can be read by its offset. An archive is closed at ``max_bytes`` of raw
records, which bounds a task's memory. A file's name holds its attempt's number and the committed listing says which attempts count, so a
repeated task can't touch what another one wrote; files go through Arrow's file systems to whatever store the folder is in.

Of records with equal payloads of at least ``min_revisit`` bytes that with the largest page_id is a response, others revisit it. Ties:
rows that repeat the largest page_id are all responses. Nulls: a null html is an empty payload; a null page_id is no candidate for the
largest and is a revisit of its group's response (a response if the group has no id); a null url leaves the target header out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import ROW, by_row, cut, fresh_path, numbered, small_batches

DATE = "2024-01-01T00:00:00Z"
MAX_BYTES, DICT_BYTES, LEVEL, SAMPLES = 16 << 20, 64 << 10, 6, 400
SKIPPABLE = 0x184D2A5D


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def classify(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """page_id, url, html (null as empty) and refers_to: the response's page_id for revisits, else null.

    Rows are numbered and put at rest. Digests alone are grouped (a partial aggregation) and joined back, so all copies of a payload meet as
    short rows that a skewed join can split; what they refer to returns to the pages by row number, and no payload is dealt by its digest.
    """
    rows, _ = numbered(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")), "pages")
    keys = cut(rows.filter(F.octet_length("html") >= min_revisit).select(ROW, "page_id", F.unhex(F.sha1(F.encode("html", "utf-8"))).alias("sha")), "digests")
    many = keys.groupBy("sha").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND top IS NOT NULL").select("sha", "top")
    again = cut(keys.join(many, "sha").filter(~F.coalesce(F.col("page_id") == F.col("top"), F.lit(False))).select(ROW, F.col("top").alias("refers_to")), "revisits")
    return by_row(rows, again, "left").select("page_id", "url", "html", "refers_to")


def _urn(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: object, url: str | None, payload: bytes, refers_to: object, serial: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(serial)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICT_BYTES, samples: int = SAMPLES):
    """A Zstandard dictionary from a spread sample of records (each up to 16 KB of it), or None when there is too little to learn from."""
    import zstandard

    step = max(1, len(records) // samples)
    part = [r[:16384] for r in records[::step]]
    total = sum(map(len, part))
    if len(part) < 8 or total < 8192:
        return None
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 8)), part, k=200, d=8)
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes], level: int = LEVEL) -> Iterator[bytes]:
    """The parts of one archive file: the dictionary in a skippable frame (if one could be built), then a frame per record."""
    import zstandard

    d = build_dictionary(records)
    if d is not None:
        raw = d.as_bytes()
        yield SKIPPABLE.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw
    packer = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=True)
    for r in records:
        yield packer.compress(r)


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else re.sub("^file:/+", "file:///", uri) if uri.startswith("file:") else f"file://{uri}")


def write_archives(classified: DataFrame, folder: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Write the records; returns (archive, records, bytes) of every file, already at rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        store, base = _file_system(folder)
        store.create_dir(base, recursive=True)
        held: list[bytes] = []
        size, number = 0, 0

        def flush():
            nonlocal held, size, number
            name = f"part-{ctx.partitionId():06d}-{number:05d}-{ctx.taskAttemptId()}.warc.zst"
            own = f"{base}/.{name}"
            written = 0
            with store.open_output_stream(own, compression=None) as out:
                for p in archive(held):
                    out.write(p)
                    written += len(p)
            store.move(own, f"{base}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([f"{base}/{name}"]), pa.array([len(held)], pa.int64()), pa.array([written], pa.int64())], ["archive", "records", "bytes"])
            held, size, number = [], 0, number + 1
            return row

        row = 0
        for b in batches:
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                serial = str(page_id) if refers is None and page_id is not None else f"{page_id}/{ctx.partitionId()}/{row}"
                held.append(record(page_id, url, html.encode("utf-8", "replace"), refers, serial))
                row += 1
                size += len(held[-1])
                if size >= max_bytes:
                    yield flush()
        if held:
            yield flush()

    spark = classified.sparkSession
    small_batches(spark)
    files = classified.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, records bigint, bytes bigint")
    files.write.parquet(listing := fresh_path(spark, "warc-files"))
    return spark.read.parquet(listing)


def frames(stream) -> Iterator[bytes]:
    """The records of an archive opened for reading, one at a time."""
    import zstandard

    head = stream.read(8)
    d, start = None, head
    if int.from_bytes(head[:4], "little") == SKIPPABLE:
        d, start = zstandard.ZstdCompressionDict(stream.read(int.from_bytes(head[4:8], "little"))), b""
    unpacker = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()
    obj, out, chunk = unpacker.decompressobj(), [], start + stream.read(1 << 20)
    while chunk:
        out.append(obj.decompress(chunk))
        if obj.eof:
            yield b"".join(out)
            chunk, out, obj = obj.unused_data or stream.read(1 << 20), [], unpacker.decompressobj()
        else:
            chunk = stream.read(1 << 20)
    if any(out):
        raise ValueError("archive ends inside a record")


def parse(raw: bytes) -> dict:
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = body[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return {"type": fields["WARC-Type"], "page_id": fields.get("X-Page-ID"), "refers_to": fields.get("X-Refers-To-Page-ID"), "url": fields.get("WARC-Target-URI"), "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "length": length, "payload": payload}


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, archive. A response's digest is computed from its payload again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _file_system(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive"]

        def out(rows):
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                with store.open_input_stream(path, compression=None) as stream:
                    for raw in frames(stream):
                        r = parse(raw)
                        if r["type"] == "response" and (digest(r["payload"]) != r["digest"] or len(r["payload"]) != r["length"]):
                            raise ValueError(f"record {r['page_id']} of {path} doesn't match its digest")
                        rows.append((int(r["page_id"]) if r["page_id"] is not None else None, r["length"], r["digest"], r["type"], int(r["refers_to"]) if r["refers_to"] is not None else None, path))
                        if len(rows) >= 4096:
                            yield out(rows)
                            rows = []
                if rows:
                    yield out(rows)

    n = files.count()
    return files.select("archive").repartition(max(1, min(n, 10_000))).mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string")


def archive_pages(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Write all pages as archives in the shared folder and read them back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(classify(pages, min_revisit), folder), folder)
