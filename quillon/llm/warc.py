"""WARC archives: monolithic writer, gzip normaliser with an offset index, reader.

Archives live in tables (one row an archive: name, bytes), so any store that
Spark writes holds them; :func:`export_archives` also lays them out as files.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize, steady_memory

#: Bytes of records, before compression, after which an archive is closed.
ARCHIVE_BYTES = 8 << 20
#: Shared payloads up to which their table goes to all tasks: 72 bytes each.
BROADCAST_PAYLOADS = 200_000
GZIP = 31  # zlib's window bits for a gzip header
ARCHIVE = "archive string, content binary"
NORMALISED = (
    "archive string, content binary,"
    " record_index array<struct<offset:bigint,length:bigint,record_id:string,record_type:string>>"
)
RECORDS = (
    "record_id string, page_id bigint, url string, payload_bytes bigint, payload_digest string,"
    " record_type string, refers_to bigint, archive string, offset bigint, length bigint, payload binary"
)


def assign_types(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Of rows with equal payloads of ``min_bytes`` or more, the one with the
    smallest page_id is the response.  Rows that repeat page_id and payload
    share their type; rows without a page_id are revisits of those with one.
    The table of shared payloads has a row for each payload seen twice, made by
    partial sums.  While it is small (counted first) all tasks get it, so the
    html is not dealt at all; beyond that, rows meet it by digest, and the
    engine splits a digest that holds many of them.
    """
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)}
    )
    shared = (
        base.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id"))
        .filter("n > 1")
        .select(F.col("payload_digest").alias("d"), "first_id")
    )
    if shared.count() <= BROADCAST_PAYLOADS:
        shared = F.broadcast(shared)
    out = base.join(shared, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") >= min_bytes), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return out.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def format_record(page_id, url, payload, n_bytes, digest, kind, refers_to) -> bytes:
    """One WARC record.  A revisit has an empty block and names its response."""
    block = (payload or b"") if kind == "response" else b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.encode("unicode_escape").decode("ascii"))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n_bytes}"]
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    lines += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES, level: int = 1) -> DataFrame:
    """Archives of one gzip stream each, written as the rows come: at most one archive is in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        gz, out, size = zlib.compressobj(level, zlib.DEFLATED, GZIP), [], 0

        def close() -> pa.RecordBatch:
            out.append(gz.flush())
            return pa.RecordBatch.from_pydict({"archive": [f"pages-{part:06d}-{n:05d}"], "content": [b"".join(out)]})

        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                record = format_record(*(c[i].as_py() for c in cols))
                out.append(gz.compress(record))
                size += len(record)
                if size >= archive_bytes:
                    yield close()
                    gz, out, size, n = zlib.compressobj(level, zlib.DEFLATED, GZIP), [], 0, n + 1
        if size:
            yield close()

    cols = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.select(*cols).mapInArrow(run, ARCHIVE)


def split_stream(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The records of a gzip file, of one member or many, inflated once from front to back."""
    gz, buf, at = zlib.decompressobj(GZIP), bytearray(), 0
    need = -1
    while True:
        while True:  # records that the buffer holds whole
            if need < 0:
                end = buf.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 8 + int(parse_head(bytes(buf[:end]))["Content-Length"])
            if len(buf) < need:
                break
            yield bytes(buf[:need])
            del buf[:need]
            need = -1
        if gz.eof:
            if gz.unused_data or at < len(content):
                rest = gz.unused_data
                gz = zlib.decompressobj(GZIP)
                buf += gz.decompress(rest) if rest else b""
                if rest:
                    continue
            else:
                break
        if at >= len(content):
            if not gz.eof:
                raise ValueError("the gzip stream is cut off")
            continue
        buf += gz.decompress(content[at : at + step])
        at += step
    if buf:
        raise ValueError("the archive ends inside a record")


def normalise_archives(archives: DataFrame, level: int = 1) -> DataFrame:
    """Every record as a gzip member of its own, and the sidecar index of their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                out, index, at = [], [], 0
                for record in split_stream(content.as_py()):
                    gz = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                    member = gz.compress(record) + gz.flush()
                    head = parse_head(record[: record.index(b"\r\n\r\n")])
                    index.append(
                        {"offset": at, "length": len(member), "record_id": head["WARC-Record-ID"], "record_type": head["WARC-Type"]}
                    )
                    out.append(member)
                    at += len(member)
                yield pa.RecordBatch.from_pydict(
                    {"archive": [name], "content": [b"".join(out)], "record_index": [index]},
                    schema=pa.schema(
                        {
                            "archive": pa.string(),
                            "content": pa.binary(),
                            "record_index": pa.list_(
                                pa.struct({"offset": pa.int64(), "length": pa.int64(), "record_id": pa.string(), "record_type": pa.string()})
                            ),
                        }
                    ),
                )

    return archives.mapInArrow(run, NORMALISED)


def read_record(member: bytes) -> dict:
    """A record from its member's bytes; a response's digest and length are those of the bytes read."""
    record = zlib.decompress(member, GZIP)
    end = record.index(b"\r\n\r\n")
    head = parse_head(record[:end])
    block = record[end + 4 : end + 4 + int(head["Content-Length"])]
    ident = head["WARC-Record-ID"][len("<urn:page:") : -1]
    uri, kind = head.get("WARC-Target-URI"), head["WARC-Type"]
    out = {
        "record_id": head["WARC-Record-ID"],
        "page_id": int(ident) if ident else None,
        "url": None if uri is None else uri.encode("ascii").decode("unicode_escape"),
        "record_type": kind,
        "refers_to": None,
        "payload_bytes": int(head["X-Payload-Length"]),
        "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload": None,
    }
    if kind == "response":
        digest = hashlib.sha256(block).hexdigest()
        if digest != out["payload_digest"]:
            raise ValueError(f"{out['record_id']}: the payload does not have its digest")
        out |= {"payload": block, "payload_bytes": len(block), "payload_digest": digest}
    else:
        out["refers_to"] = int(head["WARC-Refers-To"][len("<urn:page:") : -1])
    return out


def read_archives(normalised: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of normalised archives, each read by its offset; without ``payloads`` that column is null."""
    fields = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        schema = pa.schema(
            {k: pa.binary() if k == "payload" else pa.int64() if k in ("page_id", "payload_bytes", "refers_to", "offset", "length") else pa.string() for k in fields}
        )
        for batch in batches:
            for name, content, index in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                view, rows, held = memoryview(content.as_buffer()), [], 0
                for e in index.as_py():
                    row = read_record(view[e["offset"] : e["offset"] + e["length"]])
                    row |= {"archive": name, "offset": e["offset"], "length": e["length"]}
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    held += row["payload_bytes"] if payloads else 200
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return normalised.mapInArrow(run, RECORDS)


def export_archives(normalised: DataFrame, folder: str) -> list[str]:
    """Writes ``name.warc.gz`` and ``name.idx`` files to a folder, one archive in memory at a time."""
    import json
    import os

    os.makedirs(folder, exist_ok=True)
    out = []
    for row in normalised.toLocalIterator():
        with open(f"{folder}/{row.archive}.warc.gz", "wb") as f:
            f.write(row.content)
        with open(f"{folder}/{row.archive}.idx", "w") as f:
            f.writelines(json.dumps(x.asDict()) + "\n" for x in row.record_index)
        out.append(f"{folder}/{row.archive}.warc.gz")
    return out


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Writes the archives, normalises them, and reads each record back by its offset.

    An empty table gives no rows; a null html is an empty payload; extra columns are ignored.
    """
    archives = materialize(write_archives(assign_types(pages)), "warc", codec="uncompressed")
    normalised = materialize(normalise_archives(archives), "warc-members", codec="uncompressed")
    return read_archives(normalised, payloads)
