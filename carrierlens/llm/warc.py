"""WARC archives: writing, normalising monolithic gzip to one member a record, and reading back by offset.

Each task writes its rows as one archive: a single gzip stream around all its records, as careless crawlers leave it.
The normaliser inflates such a stream once, front to back, writes every record as a gzip member of its own and notes
its place in a sidecar index (JSON lines), with one record in memory at a time. Readers then seek by the index.

Archives lie in the shared folder and are reached through its file system (local, HDFS, object stores), never through
a machine's own disk. A task writes under a name of its own attempt and moves the finished file into place; the names
that are read are those its rows report, so a task that runs again or twice does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierlens.llm.common import as_batch, cut, scratch_path, small_batches

DATE = "2024-01-01T00:00:00Z"
#: Bytes that are read, inflated or copied at once; payload bytes of one archive, about.
STEP, ARCHIVE_BYTES = 1 << 18, 64 << 20


def base32(sha1: str) -> str:
    """A hexadecimal SHA-1 in upper-case base32, as WARC-Payload-Digest has it."""
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def digest(payload: bytes) -> str:
    return base32(hashlib.sha1(payload).hexdigest())


def _record_id(page_id: int | None, url: str | None, payload_digest: str) -> str:
    """The id of a page's record: what a revisit knows of the response tells it; only pages without an id need the URL."""
    page = f"url {url}" if page_id is None else page_id
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {payload_digest}')}>"


def _line(value: object) -> str:
    """A header value: no line ends."""
    return " ".join(str(value).split())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, payload_digest: str) -> bytes:
    """One response record with the payload in it, or a revisit record that has its digest, length and target only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = {
        "WARC-Type": "revisit" if is_revisit else "response",
        "WARC-Record-ID": _record_id(page_id, url, payload_digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": _line(url or ""),
        "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "X-Page-ID": "" if page_id is None else page_id,
        "X-Payload-Length": len(payload),
    }
    if is_revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _record_id(refers_to, None, payload_digest), "X-Refers-To-Page-ID": refers_to}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


class _Inflated:
    """The inflated bytes of a stream of one or many gzip members, with a small window to look ahead in."""

    def __init__(self, stream):
        self.stream, self.inflate, self.held, self.ended, self.raw = stream, None, bytearray(), False, b""

    def _more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.stream.read(STEP)
                if not self.raw:
                    if self.inflate is not None and not self.inflate.eof:
                        raise ValueError("gzip stream ends within a member")
                    return False
            if self.inflate is None or self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            out = self.inflate.decompress(self.raw, STEP)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if out:
                self.held += out
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with mark; None at the clean end of the stream."""
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise ValueError("stream ends within a record's header")
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("stream ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


@dataclass
class Record:
    headers: dict[str, str]
    head: bytes
    block: bytes

    def raw(self) -> bytes:
        return self.head + self.block + b"\r\n\r\n"

    def payload(self) -> bytes:
        """What follows the HTTP header in the block."""
        at = self.block.find(b"\r\n\r\n")
        return self.block[at + 4 :] if at >= 0 else b""


def records(stream):
    """The records of a gzip stream, in order, however its members are cut."""
    source = _Inflated(stream)
    while True:
        head = source.until(b"\r\n\r\n")
        if head is None:
            return
        lines = head.lstrip(b"\r\n").decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:] if x)
        block = source.take(int(headers["Content-Length"]))
        if source.take(4) != b"\r\n\r\n":
            raise ValueError("record without its closing line ends")
        yield Record(headers, head.lstrip(b"\r\n"), block)


def normalise(source, target, index, level: int = 6) -> int:
    """Rewrites a gzip WARC stream member by member; writes a line per record to index; returns the number of records."""
    offset = n = 0
    for r in records(source):
        c = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = c.compress(r.raw()) + c.flush()
        target.write(member)
        h = r.headers
        index.write((json.dumps({"offset": offset, "length": len(member), "record_id": h.get("WARC-Record-ID"), "type": h.get("WARC-Type"), "uri": h.get("WARC-Target-URI"), "digest": h.get("WARC-Payload-Digest")}) + "\n").encode())
        offset += len(member)
        n += 1
    return n


def read_member(stream, offset: int, length: int) -> Record:
    """The one record of the gzip member at offset."""
    stream.seek(offset)
    found = list(records(io.BytesIO(stream.read(length))))
    if len(found) != 1:
        raise ValueError(f"the index is off at {offset}")
    return found[0]


def _at(folder: str):
    """The file system of a folder URI and the folder's path in it."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system, path


def _write(folder: str):
    """Rows of pages to monolithic archives; a row for each archive."""

    def run(batches):
        system, path = _at(folder)
        name = out = own = deflate = None
        held = rows = 0

        def close():
            out.write(deflate.flush())
            out.close()
            system.move(own, f"{path}/{name}")
            return as_batch({"archive": pa.array([name]), "n": pa.array([rows], pa.int64())})

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("page_id", "url", "html", "sha1", "is_revisit", "refers_to")]
            for page_id, url, html, sha1, is_revisit, refers_to in zip(*columns, strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    own = f"{path}/_{name}"
                    out, deflate, held, rows = system.open_output_stream(own), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                raw = record(page_id, url, html or b"", refers_to, is_revisit, base32(sha1))
                out.write(deflate.compress(raw))
                held, rows = held + len(raw), rows + 1
                if held >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def _normalise(folder: str):
    """Archives to normalised archives with their sidecar indexes; a row for each."""

    def run(batches):
        system, path = _at(folder)
        for batch in batches:
            for name, n in zip(batch["archive"].to_pylist(), batch["n"].to_pylist(), strict=True):
                base = f"{name.removesuffix('.warc.gz')}.{uuid.uuid4().hex}"
                ours, index = f"{path}/_{base}", f"{path}/_{base}.idx"
                with system.open_input_stream(f"{path}/{name}") as source, system.open_output_stream(ours) as target, system.open_output_stream(index) as lines:
                    done = normalise(source, target, lines)
                if done != n:
                    raise ValueError(f"{name}: {done} of {n} records")
                system.move(index, f"{path}/{base}.idx")
                system.move(ours, f"{path}/{base}.norm.warc.gz")
                yield as_batch({"archive": pa.array([f"{base}.norm.warc.gz"]), "index": pa.array([f"{base}.idx"]), "n": pa.array([n], pa.int64())})

    return run


def _read(folder: str):
    """Every record of normalised archives, through their indexes."""
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "archive": pa.string(), "offset": pa.int64(), "length": pa.int64()}

    def run(batches):
        system, path = _at(folder)
        for batch in batches:
            for name, index in zip(batch["archive"].to_pylist(), batch["index"].to_pylist(), strict=True):
                out = {k: [] for k in kinds}
                with system.open_input_stream(f"{path}/{index}") as lines, system.open_input_file(f"{path}/{name}") as stream:
                    for line in lines.read().splitlines():
                        at = json.loads(line)
                        r = read_member(stream, at["offset"], at["length"])
                        h, payload = r.headers, r.payload()
                        if r.headers["WARC-Type"] == "response" and (digest(payload) != h["WARC-Payload-Digest"].removeprefix("sha1:") or len(payload) != int(h["X-Payload-Length"])):
                            raise ValueError(f"{name}: a payload differs from its digest at {at['offset']}")
                        number = lambda k: int(h[k]) if h.get(k) else None  # noqa: B023, E731
                        for k, v in (("page_id", number("X-Page-ID")), ("payload_bytes", int(h["X-Payload-Length"])), ("payload_digest", h["WARC-Payload-Digest"].removeprefix("sha1:")), ("record_type", h["WARC-Type"]), ("refers_to", number("X-Refers-To-Page-ID")), ("archive", name), ("offset", at["offset"]), ("length", at["length"])):
                            out[k].append(v)
                        if len(out["page_id"]) >= 5000:
                            yield as_batch({k: pa.array(out[k], t) for k, t in kinds.items()})
                            out = {k: [] for k in kinds}
                if out["page_id"]:
                    yield as_batch({k: pa.array(out[k], t) for k, t in kinds.items()})

    return run


def archive(pages: DataFrame, at_least: int = 0, folder: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, archive, offset, length as read back from the archives.

    Of pages(page_id, url, html) with equal payloads of at least `at_least` bytes, that with the smallest page_id is a
    response, the others are revisits of it; smaller payloads are all responses. Null html: an empty payload. Null
    page_id: a response where all ids of its payload are null, else a revisit. Rows that repeat the smallest id of a
    payload: a response each. Null url: an empty target. No rows: no archives, no rows. Other columns are not read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or scratch_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").cast("binary").alias("html"))
    own = rows.withColumn("sha1", F.sha1(F.coalesce("html", F.lit(b""))))
    # digests alone find equal payloads; the table of those that repeat is joined as its size demands, and AQE splits a hot one
    sized = own.select("page_id", "sha1", F.coalesce(F.octet_length("html"), F.lit(0)).alias("n")).where(F.col("n") >= at_least)
    repeated = sized.groupBy("sha1").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1 and least is not null")
    repeated = cut(repeated.select("sha1", "least"), "payloads")
    own = own.join(repeated, "sha1", "left")
    revisit = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    own = own.select("page_id", "url", "html", "sha1", revisit.alias("is_revisit"), F.when(revisit, F.col("least")).alias("refers_to"))
    written = cut(own.mapInArrow(_write(folder), "archive string, n long"), "archives")
    many = max(1, written.count())  # archives are of ARCHIVE_BYTES or a task's share
    made = cut(written.repartition(many).mapInArrow(_normalise(folder), "archive string, index string, n long"), "indexes")
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
    return made.repartition(many).mapInArrow(_read(folder), kinds)
