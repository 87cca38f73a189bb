"""WARC archives with one Zstandard dictionary each (.warc.zst): writer and reader."""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernspark.llm.common import slices, written

#: Fixed values of the format: the magic number of the skippable frame that holds the dictionary, and the profile of revisits.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of an archive, about; bytes of a dictionary; bytes of the archive's own records that it is trained on, at about.
ARCHIVE_BYTES, DICTIONARY_BYTES, TRAIN_BYTES = 16 << 20, 64 << 10, 4 << 20
#: A record counts for training in parts of this size, and for at most this share of the training bytes.
PART_BYTES, RECORD_SHARE = 8 << 10, 1 / 16
#: Digests of repeated payloads that are broadcast at most; more are joined by a shuffle.
BROADCAST_DIGESTS = 200_000
LEVEL = 3
DATE = "2020-01-01T00:00:00Z"


def record(row: dict) -> bytes:
    """One record. A revisit has the same HTTP header as a response, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    payload = b"" if row["record_type"] == "revisit" else row["payload"]
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {name(row['page_id'])}", f"WARC-Date: {DATE}"]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in row["url"]))
    head.append(f"WARC-Payload-Digest: sha256:{row['payload_digest']}")
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(row['refers_to'])}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def samples(records: list[bytes]) -> list[bytes]:
    """Parts of the records for training, about ``TRAIN_BYTES`` together, evenly spaced; a long record has evenly spaced parts too, so it can't take the place of the others."""
    parts: list[bytes] = []
    most = int(TRAIN_BYTES * RECORD_SHARE)
    for r in records:
        step = PART_BYTES * max(1, -(-len(r) // most))
        parts += [r[i : i + PART_BYTES] for i in range(0, len(r), step)]
    step = max(1, -(-sum(map(len, parts)) // TRAIN_BYTES))
    return parts[::step]


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict | None:
    """Trained on the archive's records; None where they are too few or too small to train on, as the library finds. :func:`archives` tells which archives have none."""
    some = samples(records)
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, records)) // 8)), some, k=512, d=8)
    except zstandard.ZstdError:
        if sum(map(len, some)) > PART_BYTES * 16:  # enough of both
            raise
        return None


def write_archive(records: list[bytes]) -> tuple[bytes, int]:
    """The dictionary in a leading skippable frame, then a frame per record; and the dictionary's size. Without a dictionary the first frame is left out."""
    d = dictionary(records)
    out = []
    if d:
        raw = d.as_bytes()
        out.append(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        d.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(dict_data=d, write_checksum=True, level=LEVEL)
    else:
        packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
    out += map(packer.compress, records)
    return b"".join(out), len(d.as_bytes()) if d else 0


def read_records(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame after another."""
    view, at, known = memoryview(data), 0, None
    if len(data) >= 8:
        magic, size = struct.unpack_from("<II", data)
        if magic == DICTIONARY_FRAME:
            known, at = zstandard.ZstdCompressionDict(bytes(view[8 : 8 + size])), 8 + size
    unpacker = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(data):
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("an archive ends inside a record")
            piece = view[at : at + (1 << 15)]
            parts.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """Fields and payload of a record; its payload must have the digest that the header states."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    fields = {k.lower().decode(): v.strip().decode("utf-8", "surrogatepass") for k, _, v in (x.partition(b":") for x in lines[1:])}
    size = int(fields["content-length"])
    if not lines[0].startswith(b"WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != stated or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} differs from its digest")
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    return {
        "page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": stated, "payload_digest": digest,
        "refers_to": number(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None,
    }


def with_revisits(pages: DataFrame, *, least_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` of each row; payloads of revisits are null.

    Of rows with equal payloads of at least ``least_bytes`` bytes that with the smallest id is a response and the others revisit it; rows that
    repeat the smallest id are responses too, and so are all rows of a payload where every id is null. A null html is an empty payload.
    Only digests and ids are aggregated, with map-side minima. Payloads aren't shuffled unless over ``BROADCAST_DIGESTS`` of them are repeated; then a digest with very many rows is split by the
    join's skew handling, as both of its sides come straight from a shuffle. An empty table gives an empty table; other columns aren't read, whatever their names.
    """
    text = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text.alias("payload"), F.octet_length(text).cast("long").alias("payload_bytes"), F.sha2(text, 256).alias("payload_digest")
    )
    firsts = written(
        rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("payload_digest", "first")
    )
    later = (F.col("first").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_DIGESTS else firsts, "payload_digest", "left").select(
        "page_id", "url", F.when(~later, F.encode("payload", "UTF-8")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(later, "revisit").otherwise("response").alias("record_type"), F.when(later, F.col("first")).alias("refers_to"),
    )


def archives(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``name string, records long, dictionary_bytes long, archive binary``: the rows of :func:`with_revisits` as .warc.zst files of bounded size.

    Records are written in the order in which a task reads them, repeated ones each; an archive ends once it has ``archive_bytes``, so a very long payload makes one
    larger archive, in one task's memory. An archive too small for a dictionary has 0 as its size. An empty table gives no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made, part = [], 0, 0, TaskContext.get().partitionId()

        def done() -> pa.RecordBatch:
            data, size = write_archive(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([f"part-{part:06d}-{made:06d}.warc.zst"]), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["name", "records", "dictionary_bytes", "archive"]
            )

        for batch in batches:
            for piece in slices(batch, "payload"):
                for row in piece.to_pylist():
                    held.append(record(row))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        yield done()
                        held, size, made = [], 0, made + 1
        if held:
            yield done()

    return rows.mapInArrow(run, "name string, records long, dictionary_bytes long, archive binary")


def read(stored: DataFrame) -> DataFrame:
    """The records of a table with a column ``archive``: ``page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload``."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive"):
                held, size = [], 0
                for data in read_records(archive.as_py()):
                    held.append(parse(data))
                    size += len(data)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return stored.select("archive").mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def save(stored: DataFrame, folder: str) -> None:
    """Writes each archive as a file into a folder that all executors mount; a repeated task writes the same file again."""

    def run(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            path = os.path.join(folder, r["name"])
            with open(f"{path}.{os.getpid()}", "wb") as f:
                f.write(r["archive"])
            os.replace(f"{path}.{os.getpid()}", path)

    stored.select("name", "archive").foreachPartition(run)
