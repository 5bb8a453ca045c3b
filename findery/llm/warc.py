"""Web archives (operator 11): a converter from the legacy ARC format to WARC, with a writer and readers for both.

An ARC file begins with a `filedesc:` block that names its version; version 1 describes a record by five fields
in one line, version 2 by ten, the last of which is the length of what follows. The converter reads those lines
and lengths and makes what WARC wants beside them: an identifier (a UUID of the archive's name, the place in it, the
URL and the date, so that a second conversion gives the same), an ISO timestamp, a type (response for HTTP, resource
for anything else, warcinfo for the file's description) and SHA-1 digests of block and payload.

Records with equal payloads of at least `min_bytes` are stored once: the one with the smallest key is the response, the
others are revisits, which keep their HTTP header and name the response. Conversion is two passes over the archives
with Spark between them: the first gives a narrow row a record, digests held more than once are joined to the records
by digest and a salt, and the second is told which records of each archive are revisits.

Archives are real files, gzip a record, in a folder that driver and executors share; tasks reach it through
pyarrow's file systems. A task writes files of its own names, and only names of tasks that ended are stored and read,
so that a lost executor or a second attempt leaves no half of an archive in a result. Archives are closed at a size and
a number of records, which bounds what is known of one at a time; records are read one by one.

Defined results: a null text is an empty payload, a null URL is `unknown:`, blanks in a URL are percent-encoded;
records without a key come after all others by date and identifier, and carry a null key; repeated rows of one key and
payload are all response if the key is the smallest; a record that ends early, a line that fits no version and a WARC
response whose digest does not fit are errors; an empty table gives an empty result; other columns are ignored
whatever their names.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, small_batches, stored, stored_dir, table

#: An archive is closed at so many bytes before compression, or records.
FILE_BYTES, FILE_RECORDS = 64 << 20, 20_000
LEVEL = 1  # of gzip
SALTS = 16
MOST_TASKS = 20_000
#: The fields of a record's line in the two versions of ARC.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_HEAD = rb"(?P<url>.*) (?P<ip>[0-9A-Fa-f.:]+|-) (?P<date>[0-9]{8,14}|-) (?P<type>.*)"
ARC_LINE = {
    1: re.compile(_HEAD + rb" (?P<length>[0-9]+)"),
    2: re.compile(_HEAD + rb" (?P<code>[0-9]+|-) (?P<sum>\S+) (?P<location>\S+) (?P<offset>[0-9]+|-) (?P<file>\S+) (?P<length>[0-9]+)"),
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
KEY, REFERS_KEY, LENGTH = "X-Record-Key", "X-Refers-To-Key", "X-Payload-Length"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_split(block: bytes) -> tuple[bytes, bytes]:
    """The header with its empty line, and the payload; all is payload where there is no HTTP header."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [i + len(e) for e in (b"\r\n\r\n", b"\n\n") if (i := block.find(e)) >= 0]
    return (block, b"") if not ends else (block[: min(ends)], block[min(ends) :])


def header_value(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)[ \t\r]*$", head)
    return m[1].decode(errors="replace") if m else None


def iso_date(digits: str, fallback: str) -> str:
    """An ARC date of 8 to 14 digits as WARC writes it; what is missing is zero, what is no date is the fallback."""
    d = (digits if digits.isdigit() else "") or fallback
    d = d.ljust(14, "0")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


@dataclass(frozen=True)
class ArcRecord:
    """position counts an archive's records; the file's description is 0."""

    position: int
    url: str
    ip: str
    date: str
    type: str
    block: bytes


def arc_line(version: int, url: str, ip: str, date: str, kind: str, length: int, name: str, code: str = "-", checksum: str = "-", offset: int = 0) -> bytes:
    fields = [url, ip, date, kind] if version == 1 else [url, ip, date, kind, code, checksum, "-", str(offset), name]
    return " ".join([*fields, str(length)]).encode() + b"\n"


def arc_description(version: int, name: str, date: str) -> bytes:
    """The block that begins an archive."""
    body = f"{version} 0 findery\n{ARC_FIELDS[version]}\n".encode()
    return arc_line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body), name) + body + b"\n"


def read_arc(stream) -> Iterator[ArcRecord]:
    """The records of an archive from its first byte, by the lines of its version and the lengths they declare."""
    version, position = None, 0
    while True:
        line = stream.readline()
        if not line:
            return
        line = line.rstrip(b"\r\n")
        if not line:  # records are set apart by one line end or more
            continue
        tried = [version] if version else [2, 1]
        found = next((m for v in tried if (m := ARC_LINE[v].fullmatch(line))), None)
        if found is None:
            raise ValueError(f"no ARC record line: {line[:200]!r}")
        length = int(found["length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"an ARC record declares {length} bytes and has {len(block)}")
        if version is None:
            said = re.match(rb"([12]) ", block) if found["url"].startswith(b"filedesc:") else None
            version = int(said[1]) if said else 2 if "code" in found.groupdict() else 1
        text = {k: found[k].decode(errors="replace") for k in ("url", "ip", "date", "type")}
        yield ArcRecord(position, text["url"], text["ip"], text["date"], text["type"], block)
        position += 1


def record_id(archive: str, record: ArcRecord) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{record.position} {record.date} {record.url}')}>"


def warc_record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def converted(archive: str, record: ArcRecord, described: str, refers: dict | None = None) -> bytes:
    """One ARC record as WARC; with refers (id, key, uri, date) a revisit of that record."""
    head, payload = http_split(record.block)
    date = iso_date(record.date, described)
    common = [("WARC-Record-ID", record_id(archive, record)), ("WARC-Date", date)]
    if record.url.startswith("filedesc:"):
        info = f"description: converted from {archive}\r\nformat: WARC File Format 1.0\r\n".encode() + record.block
        return warc_record([("WARC-Type", "warcinfo"), *common, ("WARC-Filename", archive), ("Content-Type", "application/warc-fields")], info)
    common += [("WARC-Target-URI", record.url), ("WARC-IP-Address", record.ip if record.ip not in ("-", "0.0.0.0") else None)]
    common += [("WARC-Payload-Digest", f"sha1:{sha1(payload)}"), (LENGTH, str(len(payload))), (KEY, header_value(head, KEY))]
    kind = "application/http; msgtype=response" if head else record.type
    if refers:
        block = head
        named = [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", refers["id"]), ("WARC-Refers-To-Target-URI", refers["uri"])]
        named += [("WARC-Refers-To-Date", refers["date"]), (REFERS_KEY, None if refers["key"] is None else str(refers["key"]))]
    else:
        block, named = record.block, [("WARC-Type", "response" if head else "resource")]
    return warc_record([*named, *common, ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Type", kind)], block)


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of an archive; names of headers are in lower case."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:100]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode(errors="replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"a WARC record declares {length} bytes and has {len(block)}")
        yield headers, block


def _at(folder: str) -> tuple[fs.FileSystem, str]:
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    return where, path


class Writer:
    """One archive: a gzip member a record, under a draft's name until it is closed."""

    def __init__(self, folder: str, ending: str) -> None:
        self.name, self.records, self.size = f"{uuid.uuid4().hex}.{ending}.gz", 0, 0
        self._fs, path = _at(folder)
        self._draft, self._final = f"{path}/.{self.name}", f"{path}/{self.name}"
        self._out = self._fs.open_output_stream(self._draft)

    def write(self, record: bytes) -> None:
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self._out.write(packer.compress(record) + packer.flush())
        self.records, self.size = self.records + 1, self.size + len(record)

    def full(self) -> bool:
        return self.size >= FILE_BYTES or self.records >= FILE_RECORDS

    def close(self) -> None:
        self._out.close()
        self._fs.move(self._draft, self._final)


@contextlib.contextmanager
def opened(folder: str, name: str):
    """An archive's bytes without compression, as a stream."""
    where, path = _at(folder)
    with where.open_input_stream(f"{path}/{name}") as raw, gzip.GzipFile(fileobj=raw) as stream:
        yield stream


def _spread(names: DataFrame) -> DataFrame:
    """Archives dealt to as many tasks; adaptive execution would put such short rows into one."""
    return names.repartition(max(1, min(names.count(), MOST_TASKS)))


def write_arc(pages: DataFrame, folder: str, *, key_col: str = "page_id", url_col: str = "url", text_col: str = "html", date: str = "20000101000000") -> DataFrame:
    """(name): archives of the pages, stored as HTTP responses; tasks of even and odd number write versions 1 and 2."""
    small_batches(pages.sparkSession)
    url = F.coalesce(F.col(url_col).cast("string"), F.lit("unknown:"))
    rows = pages.select(F.col(key_col).cast("long").alias("key"), url.alias("url"), F.col(text_col).cast("string").cast("binary").alias("body"), F.spark_partition_id().alias("task"))

    def run(batches):
        out, names, version = None, [], 1
        for batch in batches:
            for key, url, body, task in zip(*batch.columns):
                if out is None:
                    version, out = 1 + task.as_py() % 2, Writer(folder, "arc")
                    out.write(arc_description(version, out.name, date))
                payload = body.as_py() or b""
                named = f"{KEY}: {key.as_py()}\r\n" if key.is_valid else ""
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n{named}\r\n".encode() + payload
                place = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url.as_py())
                line = arc_line(version, place, "0.0.0.0", date, "text/html", len(block), out.name, "200", "-", out.size)
                out.write(line + block + b"\n")
                if out.full():
                    out.close()
                    names.append(out.name)
                    out = None
        if out is not None:
            out.close()
            names.append(out.name)
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string())})

    return stored(rows.mapInArrow(releasing(run), "name string"))


INDEX = "name string, position int, id string, key long, uri string, date string, digest string, payload_bytes long"


def index_arc(names: DataFrame, folder: str) -> DataFrame:
    """INDEX of every record in the archives but their descriptions."""

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, described = [], ""
                with opened(folder, name) as stream:
                    for r in read_arc(stream):
                        if r.url.startswith("filedesc:"):
                            described = r.date
                            continue
                        head, payload = http_split(r.block)
                        key = header_value(head, KEY)
                        rows.append((name, r.position, record_id(name, r), int(key) if key else None, r.url, iso_date(r.date, described), sha1(payload), len(payload)))
                kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in INDEX.split(", ")])

    return _spread(names).mapInArrow(releasing(run), INDEX)


def revisits(index: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(name, position, refers): the records whose payload another record comes first with."""
    keyless = F.col("key").isNull()
    order = F.struct(keyless.alias("keyless"), "key", F.when(keyless, F.col("date")).alias("date"), F.when(keyless, F.col("id")).alias("id"))
    rows = index.where(F.col("payload_bytes") >= min_bytes).select("name", "position", "digest", order.alias("order"), F.struct("id", "key", "uri", "date").alias("self"))
    held = rows.groupBy("digest").agg(F.min(F.struct("order", "self")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # one digest may be a third of all records: its first one is laid down for every salt
    held = held.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("name", "position"), F.lit(SALTS)).cast("int"))
    found = salted.join(held, ["digest", "salt"]).where(~F.col("order").eqNullSafe(F.col("first.order")))
    return found.select("name", "position", F.col("first.self").alias("refers"))


def convert(names: DataFrame, folder: str, target: str, again: DataFrame) -> DataFrame:
    """(name): one WARC file for each ARC file; again are the revisits among their records."""
    of_file = again.groupBy("name").agg(F.collect_list(F.struct("position", "refers")).alias("again"))  # no more than a file's records
    told = names.join(of_file, "name", "left").select("name", "again")

    def run(batches):
        for batch in batches:
            made = []
            for name, again in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                refers, described, out = {x["position"]: x["refers"] for x in again or []}, "", Writer(target, "warc")
                with opened(folder, name) as stream:
                    for r in read_arc(stream):
                        described = r.date if r.url.startswith("filedesc:") else described
                        out.write(converted(name, r, described, refers.get(r.position)))
                out.close()
                made.append(out.name)
            yield pa.RecordBatch.from_pydict({"name": pa.array(made, pa.string())})

    return stored(_spread(told).mapInArrow(releasing(run), "name string"))


RECORDS = "id string, type string, uri string, date string, key long, payload_bytes long, payload_digest string, refers_to_id string, refers_to_key long"


def records(names: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """RECORDS of WARC files but their warcinfo, and with_payload a column payload (null in revisits). Digests of stored payloads are checked."""
    fields = RECORDS + (", payload binary" if with_payload else "")
    kinds = [*[pa.string()] * 4, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

    def batch_of(rows):
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in fields.split(", ")])

    def run(batches):
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with opened(folder, name) as stream:
                    for h, block in read_warc(stream):
                        kind = h["warc-type"]
                        if kind == "warcinfo":
                            continue
                        digest, payload = h["warc-payload-digest"].removeprefix("sha1:"), None
                        if kind != "revisit":
                            payload = http_split(block)[1]
                            if sha1(payload) != digest or len(payload) != int(h[LENGTH.lower()]):
                                raise ValueError(f"{h['warc-record-id']} has another payload than its digest says")
                        row = (h["warc-record-id"], kind, h.get("warc-target-uri"), h["warc-date"], number(h.get(KEY.lower())), int(h[LENGTH.lower()]), digest)
                        rows.append((*row, h.get("warc-refers-to"), number(h.get(REFERS_KEY.lower())), *([payload] if with_payload else [])))
                        held += len(payload or b"") if with_payload else 0
                        if len(rows) == 1000 or held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    return _spread(names).mapInArrow(releasing(run), fields)


def archive(pages: DataFrame, *, min_bytes: int = 0, with_payload: bool = False, **columns) -> DataFrame:
    """The pages as legacy archives, converted to WARC and read back: see records."""
    base = f"{stored_dir(pages.sparkSession)}/archives-{uuid.uuid4().hex}"
    legacy = write_arc(pages, f"{base}/arc", **columns)
    again = revisits(stored(index_arc(legacy, f"{base}/arc")), min_bytes)
    return records(convert(legacy, f"{base}/arc", f"{base}/warc", again), f"{base}/warc", with_payload)


def op11_warc(spark, sf_dir: str) -> DataFrame:
    found = archive(table(spark, sf_dir, "pages"))
    return found.select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_key").alias("refers_to"),
    )


ORACLE = """
WITH held AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
hashed AS (SELECT *, sha1(html) AS hex FROM held)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM hashed
"""
