"""WARC records in ZIP-packaged archives.

The writer packs gzip-compressed WARC members and a line index into ZIP files whose members are stored, not deflated,
so every record is one byte range of the ZIP file. The reader parses the end record, the ZIP64 records and the central
directory, locates the stored archive and index members through their local headers, and reads each record by its
range; nothing is extracted. Paths may be of any store that ``pyarrow.fs`` opens, and must be shared by all executors.

Null payloads are empty; equal payloads of at least ``LEAST`` bytes are stored by the record of the smallest id, and
those of other ids are revisits of it. Rows that repeat an id each become a record: those that have the smallest id of
their payload are all responses, and no record revisits its own id. Rows without an id become records without one, and
revisits like others where a row with an id stores their payload.
Payloads of any length are one record; reader and writer hold one payload at a time. A package may hold several stored
archives and indexes; a line of an index names its archive. An empty table gives no archive and an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialize, partitions, shared_dir, trim

LEAST = 100
MEMBER = "data.warc.gz"
SALTS = 8
HELD = 16_000_000  # bytes of payloads that a batch of read records holds
_STORED, _END, _CENTRAL, _LOCAL, _END64, _LOCATOR = 0, b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04", b"PK\x06\x06", b"PK\x06\x07"
_DATE = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


class ZipWriter:
    """Writes stored members one after the other to a stream; sizes are known only at a member's end, so each local
    header announces a data descriptor. ZIP64 records are written where a number needs them or ``zip64`` asks for it."""

    def __init__(self, out, zip64: bool = False) -> None:
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def _put(self, b: bytes) -> None:
        self.out.write(b)
        self.at += len(b)

    def begin(self, name: str) -> None:
        self.name, self.start = name.encode(), self.at
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<4s5H3L2H", _LOCAL, 45, 0x0808, _STORED, 0, 33, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(self.name), len(extra)) + self.name + extra)
        self.crc, self.size = 0, 0

    def write(self, b: bytes) -> int:
        """Appends to the open member; returns the offset within it."""
        at = self.size
        self.crc, self.size = zlib.crc32(b, self.crc), self.size + len(b)
        self._put(b)
        return at

    def end(self) -> None:
        self._put(struct.pack("<4sLQQ", b"PK\x07\x08", self.crc, self.size, self.size))
        self.members.append((self.name, self.crc, self.size, self.start))

    def close(self) -> None:
        begin = self.at
        for name, crc, size, start in self.members:
            big = self.zip64 or max(size, start) >= 0xFFFFFFFF
            extra = struct.pack("<HHQQQ", 1, 24, size, size, start) if big else b""
            small = (0xFFFFFFFF,) * 2 if big else (size, size)
            self._put(struct.pack("<4s6H3L5H2L", _CENTRAL, 45, 45, 0x0808, _STORED, 0, 33, crc, *small, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if big else start) + name + extra)
        size, n = self.at - begin, len(self.members)
        if self.zip64 or max(size, begin) >= 0xFFFFFFFF or n >= 0xFFFF:
            at = self.at
            self._put(struct.pack("<4sQ2H2L4Q", _END64, 44, 45, 45, 0, 0, n, n, size, begin))
            self._put(struct.pack("<4sLQL", _LOCATOR, 0, at, 1))
            n, size, begin = 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF
        self._put(struct.pack("<4s4H2LH", _END, 0, 0, n, n, size, begin, 0))


def zip_members(file) -> dict[str, tuple[int, int]]:
    """name -> (offset of the data, size) of the stored members of an open random-access ZIP file."""
    total = file.size()
    tail_at = max(0, total - 22 - 65535 - 20)
    tail = file.read_at(total - tail_at, tail_at)
    at = tail.rfind(_END)
    if at < 0:
        raise ValueError("no end-of-central-directory record")
    n, size, begin = struct.unpack_from("<HLL", tail, at + 10)
    if n == 0xFFFF or size == 0xFFFFFFFF or begin == 0xFFFFFFFF:
        if at < 20 or tail[at - 20 : at - 16] != _LOCATOR:
            raise ValueError("no ZIP64 locator")
        (end64,) = struct.unpack_from("<Q", tail, at - 12)
        record = file.read_at(56, end64)
        if record[:4] != _END64:
            raise ValueError("no ZIP64 end record")
        n, size, begin = struct.unpack_from("<QQQ", record, 32)
    directory, out, p = file.read_at(size, begin), {}, 0
    for _ in range(n):
        if directory[p : p + 4] != _CENTRAL:
            raise ValueError("bad central directory")
        method, (packed, plain), (a, b, c), start = *struct.unpack_from("<H", directory, p + 10), struct.unpack_from("<LL", directory, p + 20), struct.unpack_from("<HHH", directory, p + 28), struct.unpack_from("<L", directory, p + 42)[0]
        name, extra = directory[p + 46 : p + 46 + a].decode(), directory[p + 46 + a : p + 46 + a + b]
        q = 0
        while q + 4 <= len(extra):  # the ZIP64 field holds, in this order, those values that are all ones above
            kind, width = struct.unpack_from("<HH", extra, q)
            if kind == 1:
                r = q + 4
                for key in ("plain", "packed", "start"):
                    if (value := {"plain": plain, "packed": packed, "start": start}[key]) == 0xFFFFFFFF:
                        (value,) = struct.unpack_from("<Q", extra, r)
                        r += 8
                        plain, packed, start = (value if key == "plain" else plain, value if key == "packed" else packed, value if key == "start" else start)
            q += 4 + width
        if method == _STORED:
            local = file.read_at(30, start)
            if local[:4] != _LOCAL:
                raise ValueError("bad local header")
            out[name] = (start + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
        p += 46 + a + b + c
    return out


def warc_record(page_id, url, payload: bytes, digest: str, refers_to, refers_url=None, stored: bool = True) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the response's HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if stored else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if stored else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {url}"] if url and not any(c in url for c in "\r\n") else []), f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([] if stored else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record; its block digest, its payload digest and its lengths are verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if not version.startswith("WARC/") or len(block) != int(fields["content-length"]) or hashlib.sha256(block).hexdigest() != fields["warc-block-digest"].removeprefix("sha256:"):
        raise ValueError("damaged record")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().lower().split("\r\n") if x.startswith("content-length:")).split(":")[1])
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    stored = fields["warc-type"] == "response"
    if stored and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("damaged payload")
    own, other = (fields.get(k, "<urn:page:>")[len("<urn:page:") : -1] for k in ("warc-record-id", "warc-refers-to"))
    return {"page_id": int(own) if own else None, "payload_bytes": length, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": int(other) if other else None, "url": fields.get("warc-target-uri"), "payload": payload if stored else None}


def _open(path: str):
    store, name = fs.FileSystem.from_uri(path)
    return store, name


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", records: int = 20_000, zip64: bool = False) -> DataFrame:
    """Writes a record per row to ZIP files below ``folder``; returns their manifest (path, records). Every attempt of
    a task writes files of its own name, and only those of the attempt that counted are in the manifest."""
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(F.encode(pages[payload_col].cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    big = rows.where((F.octet_length("payload") >= LEAST) & F.col("id").isNotNull())
    first = big.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # copies of one payload may be a third of all rows
    dealt = rows.join(first, ["digest", "salt"], "left").select("id", "url", "payload", "digest", "first")

    def write(batches):
        state: dict = {}

        def finish():
            z, sink = state["zip"], state["sink"]
            z.end()
            z.begin("indexes/index.cdxj")
            z.write("".join(state["lines"]).encode())
            z.end()
            z.close()
            sink.close()
            return state["path"], len(state["lines"])

        done = []
        for b in batches:
            for row in range(b.num_rows):  # one payload at a time is a Python object
                i, url, payload, digest, first = (c[row].as_py() for c in b.columns)
                if not state:
                    path = f"{folder}/{uuid.uuid4().hex}.wacz"
                    store, name = _open(path)
                    store.create_dir(name.rpartition("/")[0], recursive=True)
                    sink = store.open_output_stream(name)
                    state.update(path=path, sink=sink, zip=ZipWriter(sink, zip64), lines=[])
                    state["zip"].begin(f"archive/{MEMBER}")
                stored = first is None or first == i or len(payload) < LEAST
                raw = gzip.compress(warc_record(i, url, payload, digest, first, stored=stored), 1, mtime=0)
                at = state["zip"].write(raw)
                state["lines"].append(json.dumps({"id": i, "filename": MEMBER, "offset": at, "length": len(raw)}) + "\n")
                if len(state["lines"]) >= records:
                    done.append(finish())
                    state = {}
        if state:
            done.append(finish())
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    return materialize(dealt.mapInArrow(write, "path string, records long"), "manifest")


def read_archives(paths: DataFrame, payloads: bool = False, block: int = 512) -> DataFrame:
    """Reads every record of the ZIP files in column ``path``: first their directories and indexes, then, spread over
    all tasks, blocks of neighbouring records by byte range."""

    def locate(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = _open(path)
                with store.open_input_file(name) as file:
                    members = zip_members(file)
                    archives = {k.removeprefix("archive/"): at for k, (at, _) in members.items() if k.startswith("archive/")}
                    lines = [json.loads(x) for k, (at, size) in members.items() if k.startswith("indexes/") for x in file.read_at(size, at).decode().splitlines()]
                for i in range(0, len(lines), block):
                    part = lines[i : i + block]
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([[archives[x["filename"]] + x["offset"] for x in part]], pa.list_(pa.int64())), pa.array([[x["length"] for x in part]], pa.list_(pa.int64()))], ["path", "offsets", "lengths"])

    def fetch(batches):
        for b in batches:
            for path, offsets, lengths in zip(*(c.to_pylist() for c in b.columns)):
                store, name = _open(path)
                out, held = [], 0
                with store.open_input_file(name) as file:
                    for at, n in zip(offsets, lengths):
                        record = parse_record(gzip.decompress(file.read_at(n, at)))
                        out.append({k: record[k] for k in types.names})  # payloads stay only where they are asked for
                        held += len(out[-1].get("payload") or b"")
                        if held >= HELD:
                            yield pa.RecordBatch.from_pylist(out, schema=types)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=types)
        trim()

    types = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())] + [("payload", pa.binary())] * payloads)
    blocks = paths.select("path").mapInArrow(locate, "path string, offsets array<long>, lengths array<long>").repartition(partitions(paths.sparkSession))
    return blocks.mapInArrow(fetch, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads)


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/blockwise/archives-{uuid.uuid4().hex}"
