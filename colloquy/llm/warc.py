"""WARC archives with an index made first: write, then read chosen records by coalesced byte ranges.

Every task writes archive files of its own (a gzip member per record) and gives, per
record, file, offset, length, URL, digest and kind: the index, a Parquet table. Reading
starts from rows of the index. They are sorted by file and offset, neighbouring ranges
become one read, and every payload is held against its digest.

Of records with equal payloads of at least `least` bytes the one with the largest page_id
is a response, the others are revisits of it and hold no payload.

Results in special cases: null html is an empty payload; a null URL is left out of the
record; a null page_id is below all others, and a group without any page_id has responses
alone; rows that share the largest page_id of their group are responses each. Repeated
rows are a record each. An empty table gives an empty index. Other columns are passed over.
A task that is run again writes new files; the index names only those of the attempt that
counted. Memory per task: one Arrow batch, and one read of at most `READ` bytes, or one
record if that is longer.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.ship import ship
from colloquy.session import materialise, scratch_path

SEGMENT = 64 << 20  # a file is closed once it has grown past this
READ = 8 << 20  # a coalesced read ends before this
GAP = 64 << 10  # bytes between two records that are read over
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def _name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """The bytes of one record; a revisit keeps the HTTP header, which has the payload's length."""
    revisit = refers_to is not None
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _name(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", _name(refers_to, digest) if revisit else None),
        ("Page-ID", page_id),
        ("Refers-To-Page-ID", refers_to),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Header fields, body, and length of the whole payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    return fields, body, length


def write(pages: DataFrame, folder: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes archives of `pages` (page_id, url, html) into `folder` and returns the index."""
    ship(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("_sha"), F.octet_length(html).alias("_bytes"))
    # One row per group of copies; a group of any size is added up before the shuffle, and
    # the join beside it is one whose large partitions Spark splits.
    first = (
        rows.where(F.col("_bytes") >= least).groupBy("_sha", "_bytes")
        .agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_copies"))
        .where("_copies > 1 AND _first IS NOT NULL").drop("_copies")
    )
    other = F.col("page_id").isNull() | (F.col("page_id") < F.col("_first"))
    decided = rows.join(first, ["_sha", "_bytes"], "left").select(
        "page_id", "url", "html", "_sha", F.when(other, F.col("_first")).alias("_refers")
    )

    def put(batches):
        system, path = _filesystem(folder)
        system.create_dir(path, recursive=True)
        out, at, name, made = None, 0, "", []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, at = system.open_output_stream(f"{path}/{name}", compression=None), 0
                payload = row["html"].encode()
                digest = base64.b32encode(bytes.fromhex(row["_sha"])).decode()
                raw = gzip.compress(record(row["page_id"], row["url"], payload, digest, row["_refers"], date), 1, mtime=0)
                out.write(raw)
                kind = "response" if row["_refers"] is None else "revisit"
                made.append((row["page_id"], row["url"], f"{folder}/{name}", at, len(raw), len(payload), digest, kind, row["_refers"]))
                at += len(raw)
                if at >= SEGMENT:
                    out.close()
                    out = None
            if len(made) >= 10_000:
                yield _index(made)
                made = []
        if out is not None:
            out.close()
        yield _index(made)

    return materialise(decided.mapInArrow(put, INDEX), "warc-index")


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [pa.field(name, _TYPES[kind]) for name, kind in (x.split() for x in schema.split(", "))]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def _index(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, INDEX)


def read(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records that rows of the index name: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload if asked for.

    All but the place of a record comes out of the archive. A revisit's payload is null.
    """
    ship(index.sparkSession)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema += ", payload binary" if payload else ""

    def records(batches):
        pending: list[tuple[int, int, str]] = []
        system, where, handle, path = None, None, None, ""

        def fetch():
            start = pending[0][0]
            handle.seek(start)
            data = handle.read(pending[-1][0] + pending[-1][1] - start)
            for offset, length, digest in pending:
                fields, body, size = parse(gzip.decompress(data[offset - start : offset - start + length]))
                kind = fields["WARC-Type"]
                said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != said or said != digest:
                    raise ValueError(f"{where}, {offset}: the payload does not have the digest of the index")
                number = lambda k: int(fields[k]) if k in fields else None
                row = (number("Page-ID"), fields.get("WARC-Target-URI"), size, said, kind, number("Refers-To-Page-ID"))
                yield (*row, body if kind == "response" else None) if payload else row

        for batch in batches:
            made = []
            for file, offset, length, digest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                last = pending[-1][0] + pending[-1][1] if pending else 0
                if pending and (file != where or offset - last > GAP or offset + length - pending[0][0] > READ):
                    made.extend(fetch())
                    pending = []
                if file != where:
                    if handle is not None:
                        handle.close()
                    system, path = _filesystem(file)
                    where, handle = file, system.open_input_file(path)
                pending.append((offset, length, digest))
                if len(made) >= 1_000:
                    yield _batch(made, schema)
                    made = []
            if pending:  # a batch ends here, so its rows can leave
                made.extend(fetch())
                pending = []
            if made:
                yield _batch(made, schema)
        if handle is not None:
            handle.close()

    places = index.select("file", "offset", "length", "payload_digest")
    dealt = places.repartition("file", F.expr(f"offset div {READ}")).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(records, schema)


def archive_and_read(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Writes all pages, and reads every record back through the index."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return read(write(pages, folder, least), payload=False)
