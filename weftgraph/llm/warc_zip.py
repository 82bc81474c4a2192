"""WARC records in ZIP-packaged archives, read back by ranges without extraction.

An archive is a ZIP file with stored members: ``archive/data.warc.gz`` (a gzip member per
record) and ``indexes/index.cdxj`` (a line per record with its offset and length).  The
reader finds the central directory from the end of the file, by ZIP64 records where they
are present, locates the two members and reads every record by its range.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.lineage import lineage_dir, materialize
from weftgraph.skew import SALT, join_salted

#: Fixed values of the ZIP format.
LOCAL, CENTRAL, DESCRIPTOR, END, END64, LOCATOR64 = (
    b"PK\x03\x04", b"PK\x01\x02", b"PK\x07\x08", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07")
#: Fixed values of the WARC format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
LEAST_BYTES = 100
#: An archive is closed after this many record bytes or records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 256 << 20, 100_000
DATE = "2024-01-01T00:00:00Z"
DOS_DATE = (2024 - 1980) << 9 | 1 << 5 | 1


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


class StoredZip:
    """Writes stored members one after the other to a stream that cannot seek."""

    def __init__(self, out):
        self.out, self.at, self.members, self.open = out, 0, [], None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw, extra = name.encode(), struct.pack("<HHQQ", 1, 16, 0, 0)
        self.open = [name, self.at, 0, 0]
        self._put(LOCAL + struct.pack("<5H3I2H", 45, 0x808, 0, 0, DOS_DATE, 0, 0xFFFFFFFF, 0xFFFFFFFF,
                                      len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> int:
        """Adds data to the open member; the offset of the data in it."""
        start = self.open[3]
        self.open[2] = zlib.crc32(data, self.open[2])
        self.open[3] += len(data)
        self._put(data)
        return start

    def end(self) -> None:
        name, header, crc, size = self.open
        self._put(DESCRIPTOR + struct.pack("<IQQ", crc, size, size))
        self.members.append(Member(name, 0, crc, size, size, header))

    def close(self) -> None:
        start = self.at
        for m in self.members:
            raw, extra = m.name.encode(), struct.pack("<HHQQQ", 1, 24, m.size, m.packed, m.header)
            self._put(CENTRAL + struct.pack("<6H3I5H2I", 45, 45, 0x808, 0, 0, DOS_DATE, m.crc, 0xFFFFFFFF, 0xFFFFFFFF,
                                            len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + raw + extra)
        size, end, n = self.at - start, self.at, len(self.members)
        self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(LOCATOR64 + struct.pack("<IQI", 0, end, 1))
        self._put(END + struct.pack("<4H2IH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), 0xFFFFFFFF, 0xFFFFFFFF, 0))


def read_range(f, start: int, length: int) -> bytes:
    f.seek(start)
    data = f.read(length)
    if len(data) != length:
        raise ValueError("the archive ends before its directory says")
    return data


def read_directory(f, size: int) -> list[Member]:
    """Members of a ZIP file, by its central directory; ZIP64 records where present."""
    tail_at = max(0, size - (1 << 16) - 22)
    tail = read_range(f, tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no ZIP directory at the end of the file")
    n, length, start = struct.unpack_from("<H2I", tail, at + 10)
    if n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = read_range(f, tail_at + at - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("the ZIP64 locator is missing")
        record = read_range(f, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != END64:
            raise ValueError("the ZIP64 directory record is missing")
        n, length, start = struct.unpack_from("<3Q", record, 32)
    table, out, p = read_range(f, start, length), [], 0
    for _ in range(n):
        if table[p:p + 4] != CENTRAL:
            raise ValueError("bad entry in the ZIP directory")
        method, = struct.unpack_from("<H", table, p + 10)
        crc, packed, full, n_name, n_extra, n_note = struct.unpack_from("<3I3H", table, p + 16)
        header, = struct.unpack_from("<I", table, p + 42)
        name = table[p + 46:p + 46 + n_name].decode("utf-8", "replace")
        extra = table[p + 46 + n_name:p + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, width = struct.unpack_from("<HH", extra)
            if kind == 1:  # only the fields that did not fit, in this order
                wide = list(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                full = wide.pop(0) if full == 0xFFFFFFFF and wide else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF and wide else packed
                header = wide.pop(0) if header == 0xFFFFFFFF and wide else header
            extra = extra[4 + width:]
        out.append(Member(name, method, crc, packed, full, header))
        p += 46 + n_name + n_extra + n_note
    return out


def data_start(f, m: Member) -> int:
    """Where a stored member's bytes begin."""
    if m.method != 0:
        raise ValueError(f"{m.name} is not stored")
    head = read_range(f, m.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header of {m.name}")
    return m.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def warc_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A record; a revisit keeps the HTTP header and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}",
                 f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def decide(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``page_id, url, html, digest, refers_to``: payloads of ``least_bytes`` or more that
    an earlier page has refer to the smallest page id with the same payload."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"))
    long = F.octet_length("html") >= least_bytes
    firsts = (rows.where(long).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
              .where("_n > 1 and _first is not null").select(F.col("digest").alias("_same"), "_first"))
    # short payloads are never joined: their key is null, spread by the page id's salt
    keyed = rows.withColumn("_same", F.when(long, F.col("digest")))
    out = join_salted(keyed, firsts, ["_same"], ["page_id", "digest"], "left", salt=SALT)
    other = ~F.col("page_id").eqNullSafe(F.col("_first"))
    return out.select("page_id", "url", "html", "digest", F.when(other, F.col("_first")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the decided rows as archives below ``folder``, which all executors share.

    ``path, records, bytes`` per archive.  The table is written before it is returned, so
    it names the files of the tasks that succeeded; a repeated task writes new files.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        archive = None

        def close():
            path, stream, z, lines = archive
            z.end()
            z.begin(INDEX)
            z.write("".join(sorted(lines)).encode())
            z.end()
            z.close()
            stream.close()
            return pd.DataFrame({"path": [path], "records": [len(lines)], "bytes": [z.at]})

        for b in batches:
            for page_id, url, html, digest, refers in zip(b["page_id"], b["url"], b["html"], b["digest"], b["refers_to"]):
                page_id, refers = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                if archive is None:
                    path = f"{base}/part-{uuid.uuid4().hex}.wacz"
                    stream = store.open_output_stream(path)
                    archive = (path, stream, StoredZip(stream), [])
                    archive[2].begin(DATA)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = warc_record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers)
                data = pack.compress(raw) + pack.flush()
                at = archive[2].write(data)
                note = {"digest": f"sha256:{digest}", "filename": DATA.rpartition("/")[2], "offset": at, "length": len(data)}
                key = (url or "-").translate({10: "%0A", 13: "%0D"})
                archive[3].append(f"{key} {re.sub('[^0-9]', '', DATE)} {json.dumps(note)}\n")
                if archive[2].at >= archive_bytes or len(archive[3]) >= ARCHIVE_RECORDS:
                    yield close()
                    archive = None
        if archive is not None:
            yield close()

    return materialize(rows.mapInPandas(write, "path string, records bigint, bytes bigint"), "warc-archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record.

    A response's payload is hashed again and has to match its digest; a revisit states
    digest and length of the payload it leaves out.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b["path"]:
                with store.open_input_file(path) as f:
                    members = {m.name: m for m in read_directory(f, f.size())}
                    index, start = members[INDEX], data_start(f, members[DATA])
                    lines = read_range(f, data_start(f, index), index.size).decode().split("\n")[:-1]
                    notes = sorted((json.loads(x[x.rindex(" {") + 1:]) for x in lines), key=lambda x: x["offset"])
                    yield pd.DataFrame([_row(zlib.decompress(read_range(f, start + x["offset"], x["length"]), 31))
                                        for x in notes], columns=["page_id", "payload_bytes", "payload_digest",
                                                                  "record_type", "refers_to"]).astype(
                        {"page_id": "Int64", "refers_to": "Int64"})

    # a task for each archive, whatever the size of the table that names them
    spread = archives.repartition(max(1, archives.count()), "path")
    return spread.select("path").mapInPandas(
        read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def _row(data: bytes) -> tuple:
    fields, http, payload = parse_record(data)
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
    return (None if page is None else int(page), int(http["Content-Length"]), digest, kind,
            None if refers is None else int(refers))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write a record for every page and read the archives back.

    A null html is an empty payload, a null url leaves the field out.  A null id is
    larger than any other: such pages are revisits where a page with an id has the same
    payload.  Rows that repeat the smallest id are all responses.  An empty table gives
    an empty result; other columns are not read.
    """
    folder = f"{lineage_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(decide(pages), folder), folder)


ORACLE = """
WITH p AS (SELECT page_id, html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first FROM p)
SELECT page_id, payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""
