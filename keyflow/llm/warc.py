"""WARC files: one gzip member a record; a sequential reader that decompresses incrementally and checks digests."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyflow.llm import common as C
from keyflow.llm.components import by_root

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 16
_LEVEL = 4


def _urn(page_id, copy: int = 0) -> str:
    """A record's name; further rows with the same id, and all without one, have a number of their own."""
    return "<urn:page:" + ("none" if page_id is None else str(page_id)) + (f":{copy}" if copy else "") + ">"


def _page(urn: str):
    name = urn.strip("<>").split(":")[2]
    return None if name == "none" else int(name)


def record(page_id, url: str, payload: bytes, size: int, digest: str, refers_to=None, copy: int = 0, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A gzip member with a response, or with a revisit of refers_to, which has no payload but tells its size and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    url = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page_id, copy)), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    head.append(("Content-Length", str(len(block))))
    z = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return z.compress(VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + z.flush()


class _Members:
    """Bytes of the gzip members of a stream, decompressed as they are asked for."""

    def __init__(self, stream):
        self.stream, self.left, self.out = stream, b"", bytearray()
        self.z = None

    def more(self) -> bool:
        """Decompresses some more of the member that was begun; False at its end."""
        while True:
            if self.z.eof:
                self.left = self.z.unused_data
                return False
            data = self.left or self.z.unconsumed_tail or self.stream.read(_CHUNK)
            self.left = b""
            if not data:
                raise ValueError("the file ends inside a gzip member")
            if got := self.z.decompress(data, _CHUNK * 4):
                self.out += got
                return True

    def begin(self) -> bool:
        """The next member; False at the end of the file."""
        self.left = self.left or self.stream.read(_CHUNK)
        self.z, self.out = zlib.decompressobj(31), bytearray()
        return bool(self.left)

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (i := self.out.find(mark, at)) < 0:
            at = max(0, len(self.out) - len(mark) + 1)
            if not self.more():
                raise ValueError("a record's head has no end")
        got = bytes(self.out[:i])
        del self.out[: i + len(mark)]
        return got

    def exactly(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self.more():
                raise ValueError("a record is shorter than its Content-Length")
        got = bytes(self.out[:n])
        del self.out[:n]
        return got


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(head, block) of each record, in order. Raises ValueError where framing or a digest is wrong."""
    members = _Members(stream)
    while members.begin():
        version, _, lines = members.until(b"\r\n\r\n").partition(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError("a member doesn't begin with a record")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n"))}
        block = members.exactly(int(head["content-length"]))
        if members.exactly(4) != b"\r\n\r\n" or members.out or members.more():
            raise ValueError("a member holds more than its record")
        if "warc-block-digest" in head and head["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"the block of {head['warc-record-id']} isn't what its digest says")
        yield head, block


def write_warcs(pages: DataFrame, least_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes an archive for each partition to the shared folder; gives (path, records).

    Of rows with equal payloads of at least ``least_bytes``, those with the smallest id are responses and the others
    revisit it; a row without id is a response. Null payload: empty. Null url: empty. No rows: no records.
    """
    folder = C.new_folder(pages.sparkSession, "warc")
    body = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("body")).select(
        "id", "url", "body", F.octet_length("body").alias("size"), F.sha2("body", 256).alias("digest")
    )
    copies = rows.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # payloads aren't dealt by digest: only ids and digests of what has copies are, and a common payload's are spread
    refers = by_root(rows.filter(F.col("id").isNotNull()).select("id", "digest"), copies, "digest", "id").filter(F.col("first") < F.col("id")).select("id", "digest", F.col("first").alias("refers")).distinct()
    told = rows.join(refers, ["id", "digest"], "left").select("id", "url", "body", "size", "digest", "refers")

    def write(batches):
        import os

        from pyspark import TaskContext

        task = TaskContext.get()
        fs, at = C.filesystem(folder)
        fs.create_dir(at, recursive=True)
        name = f"part-{task.partitionId():06d}.warc.gz"
        mine = f"{at}/.{name}.{task.taskAttemptId()}.{os.getpid()}"
        n, seen = 0, set()
        with fs.open_output_stream(mine) as out:
            for batch in batches:
                for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    page_id, url, payload, size, digest, refers = r
                    copy = (task.partitionId() << 32) + n + 1 if page_id is None or page_id in seen else 0
                    seen.add(page_id)
                    out.write(record(page_id, url, payload, size, digest, refers, copy))
                    n += 1
        fs.move(mine, f"{at}/{name}")
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n]}, pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return C.settle(told.mapInArrow(write, "path string, records long"), "warc-list")


def read_warcs(files: DataFrame) -> DataFrame:
    """The records of archives (path): page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for a revisit).

    A response's size and digest are those of the payload that was read; a revisit's are those that it states.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def rows(path: str):
        fs, at = C.filesystem(path)
        with fs.open_input_stream(at, compression=None) as stream:
            for head, block in read_records(stream):
                http, _, payload = block.partition(b"\r\n\r\n")
                kind, digest = head["warc-type"], head["warc-payload-digest"].partition(":")[2]
                if kind == "response":
                    if (found := hashlib.sha256(payload).hexdigest()) != digest:
                        raise ValueError(f"the payload of {head['warc-record-id']} isn't what its digest says")
                    size, digest = len(payload), found
                else:
                    size, payload = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None
                refers = head.get("warc-refers-to")
                yield _page(head["warc-record-id"]), head["warc-target-uri"], kind, _page(refers) if refers else None, size, digest, payload

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += len(row[-1] or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    ddl = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.filter("records > 0").select("path").repartition(n).mapInArrow(read, ddl)
