"""WARC archives: one gzip member per record, written by tasks and read in sequence.

Writer: each task writes one archive. A record's payload is the page's HTML in UTF-8 in
an HTTP response; of equal payloads the one with the smallest ``page_id`` is a response
record, the others are revisit records, which carry the HTTP header alone (profile
identical-payload-digest). Equal payloads are found by their SHA-256 and length with a
group-by that combines in each task first, and joined back; Spark splits a skewed join.

Reader: inflates one gzip member after another as the file comes in, takes the header up
to its blank line, then as many bytes as ``Content-Length`` says, then the closing blank
lines, and checks block and payload digests. It never looks ahead by more than a read.

Defined cases: null HTML is an empty payload; a null ``page_id`` writes a record without
that field (never one that others refer to, unless all of its group are so); rows that
repeat the winner's id and payload are responses too; a null URL writes ``urn:page:<id>``;
line ends in a URL are percent-coded; an empty table gives no files and no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, fresh_folder, local_rows, small_batches

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ, LEVEL, DATE = 1 << 16, 1, "2024-01-01T00:00:00Z"
RECORDS = "page_id long, record_type string, uri string, payload binary, payload_bytes long, payload_digest string, refers_to long"
ARROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("uri", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


class WarcError(ValueError):
    pass


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _line(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in value)


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, revisit: bool, level: int = LEVEL, date: str = DATE) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date), ("WARC-Target-URI", _line(uri) if uri else f"urn:page:{page_id}")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
        if refers_to is not None:
            fields.append(("Refers-To-Page-ID", str(refers_to)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


class _Members:
    """Bytes of a stream's gzip members, one member at a time, inflated as they are asked for."""

    def __init__(self, stream, step: int = READ):
        self.stream, self.step, self.raw, self.out, self.z = stream, step, b"", bytearray(), None

    def begin(self) -> bool:
        """Go to the next member; False at the end of the file."""
        if not self.raw:
            self.raw = self.stream.read(self.step)
        self.z = zlib.decompressobj(31)
        return bool(self.raw)

    def _more(self) -> bool:
        if self.z.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(self.step)
            if not self.raw:
                raise WarcError("the archive ends inside a record")
        try:
            self.out += self.z.decompress(self.raw, self.step)
        except zlib.error as e:
            raise WarcError(f"not a whole gzip member: {e}") from e
        self.raw = self.z.unconsumed_tail or self.z.unused_data
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.out.find(mark)) < 0:
            if not self._more():
                raise WarcError("a header does not end")
        found = bytes(self.out[:at])
        del self.out[: at + len(mark)]
        return found

    def take(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self._more():
                raise WarcError("a record is shorter than its Content-Length")
        found = bytes(self.out[:n])
        del self.out[:n]
        return found

    def end(self) -> None:
        while self._more():
            if self.out:
                break
        if self.out or not self.z.eof:
            raise WarcError("a gzip member holds more than one record")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith(("WARC/", "HTTP/")):
        raise WarcError(f"not a header: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_records(stream, step: int = READ) -> Iterator[dict]:
    """The records of an archive in order, digests checked: the fields of ``RECORDS``."""
    members = _Members(stream, step)
    while members.begin():
        f = _fields(members.until(b"\r\n\r\n"))
        block = members.take(int(f["content-length"]))
        if members.take(4) != b"\r\n\r\n":
            raise WarcError("a record does not end with two line ends")
        members.end()
        if f["warc-block-digest"] != f"sha1:{digest(block)}":
            raise WarcError(f"block digest differs in {f['warc-record-id']}")
        head, _, payload = block.partition(b"\r\n\r\n")
        size, revisit = int(_fields(head)["content-length"]), f["warc-type"] == "revisit"
        if not revisit and (len(payload) != size or f["warc-payload-digest"] != f"sha1:{digest(payload)}"):
            raise WarcError(f"payload digest differs in {f['warc-record-id']}")
        number = lambda k: int(f[k]) if k in f else None
        yield {"page_id": number("page-id"), "record_type": f["warc-type"], "uri": f["warc-target-uri"], "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": f["warc-payload-digest"].removeprefix("sha1:"), "refers_to": number("refers-to-page-id")}


def write_warc(pages: DataFrame, folder: str | None = None, *, min_revisit_bytes: int = 0, level: int = LEVEL) -> list:
    """Write a record for each row of ``pages`` (page_id, url, html); a row (uri, n_records) for each archive."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or fresh_folder(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload")).withColumn("sha", F.unhex(F.sha2("payload", 256)))
    slim = rows.select("sha", "size", "page_id")
    least = slim.groupBy("sha", "size").agg(F.min("page_id").alias("refers_to"))
    rows = rows.join(least, ["sha", "size"])
    revisit = (F.col("size") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    rows = rows.select("page_id", "url", "payload", "refers_to", revisit.alias("revisit")).sortWithinPartitions("page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stream, n = TaskContext.get().partitionId(), None, 0
        fs, path = filesystem(folder)
        own = f"{path}/.writing-{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            for page_id, url, payload, refers_to, again in zip(*(batch.column(i).to_pylist() for i in range(5))):
                stream = stream or fs.open_output_stream(own, compression=None)
                stream.write(record(page_id, url, payload, refers_to, again, level))
                n += 1
        if n:
            stream.close()
            fs.move(own, f"{path}/part-{part:06d}.warc.gz")
            yield pa.RecordBatch.from_pydict({"uri": [f"{folder}/part-{part:06d}.warc.gz"], "n_records": pa.array([n], pa.int64())})

    return sorted(rows.mapInArrow(run, "uri string, n_records long").collect())


def read_warc(spark: SparkSession, uris: list[str]) -> DataFrame:
    """The records of archives: ``RECORDS``. Each archive is read by one task, in sequence."""
    if not uris:
        return spark.createDataFrame([], RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = filesystem(uri)
                with fs.open_input_stream(path, compression=None) as stream:
                    out, held = [], 0
                    for r in read_records(stream):
                        out.append(r)
                        held += len(r["payload"] or b"")
                        if held > 4_000_000 or len(out) >= 1000:
                            yield pa.RecordBatch.from_pylist(out, ARROW)
                            out, held = [], 0
                    yield pa.RecordBatch.from_pylist(out, ARROW)

    return local_rows(spark, [(u,) for u in uris], "uri string").mapInArrow(run, RECORDS)
