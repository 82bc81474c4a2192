"""Archives: exact round trip, other ZIP readers and writers, ZIP64, revisits."""

import hashlib
import io
import random
import struct
import zipfile
import zlib

import pytest

from weftgraph.lineage import lineage_dir
from weftgraph.llm import warc_zip

SCHEMA = "page_id long, url string, html string, digest string, record_type int"


def plain(rows):
    out = []
    for i, _, h, *_ in rows:
        data = (h or "").encode()
        same = [j for j, _, g, *_ in rows if (g or "") == (h or "") and j is not None]
        first = min(same) if same and len(data) >= 100 else i
        other = first != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if other else "response", first if other else None))
    return sorted(out, key=str)


def rows_of_all_kinds():
    long = "é" * 60
    return [(5, "http://a/", long, "", 0), (3, "http://b/\nx y", long, "", 0), (9, None, long, "", 0), (3, "http://b/", long, "", 0),
            (7, "http://c/{}", "short", "", 0), (8, "http://c/ {\"digest\"", "short", "", 0), (1, "u", None, "", 0),
            (2, "u", "", "", 0), (None, "u", long, "", 0), (None, "v", "z" * 100, "", 0), (11, "v", "\r\n\r\nWARC/1.1\r\n" * 20, "", 0),
            (12, "big", "".join(random.Random(1).choices("abc \n<>", k=300_000)), "", 0)]


def test_round_trip(spark):
    rows = rows_of_all_kinds()
    got = warc_zip.archive_round_trip(spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
    assert warc_zip.archive_round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_small_archives_and_another_zip_reader(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * 30, "", 0) for i in range(120)]
    folder = f"{lineage_dir(spark)}/warc-test-{random.random()}"
    archives = warc_zip.write_archives(warc_zip.decide(spark.createDataFrame(rows, SCHEMA)), folder, 4000)
    made = archives.collect()
    assert len(made) > 5 and sum(r["records"] for r in made) == 120
    assert sorted((tuple(r) for r in warc_zip.read_archives(archives, folder).collect()), key=str) == plain(rows)
    with zipfile.ZipFile(made[0]["path"]) as z:
        assert z.testzip() is None and z.namelist() == [warc_zip.DATA, warc_zip.INDEX]
        assert all(m.compress_type == zipfile.ZIP_STORED for m in z.infolist())
        plainly = zlib.decompressobj(31)
        assert plainly.decompress(z.read(warc_zip.DATA)).startswith(b"WARC/1.1\r\n")


def test_directories_of_another_writer():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("archive/data.warc.gz", b"x" * 1000)
        z.writestr("packed", b"y" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06 inside"
    members = {m.name: m for m in warc_zip.read_directory(raw, len(raw.getvalue()))}
    m = members["archive/data.warc.gz"]
    assert warc_zip.read_range(raw, warc_zip.data_start(raw, m) + 10, 5) == b"xxxxx" and m.size == 1000
    with pytest.raises(ValueError):
        warc_zip.data_start(raw, members["packed"])
    with pytest.raises(ValueError):
        warc_zip.read_directory(io.BytesIO(b"no archive" * 10), 100)


class Sparse(io.RawIOBase):
    """A file of which only some ranges hold bytes."""

    def __init__(self, parts):
        self.parts, self.at = parts, 0

    def seek(self, at, how=0):
        self.at = at
        return at

    def read(self, n=-1):
        out = bytearray(n)
        for start, data in self.parts:
            a, b = max(start, self.at), min(start + len(data), self.at + n)
            if a < b:
                out[a - self.at:b - self.at] = data[a - start:b - start]
        return bytes(out)


def test_zip64_offsets_beyond_four_gigabytes():
    far, size = 5 << 30, 6 << 30
    name = b"indexes/index.cdxj"
    local = warc_zip.LOCAL + struct.pack("<5H3I2H", 45, 0, 0, 0, 0, 0, 0, 0, len(name), 0) + name
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, far)
    entry = warc_zip.CENTRAL + struct.pack("<6H3I5H2I", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra),
                                           0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end = (warc_zip.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), size)
           + warc_zip.LOCATOR64 + struct.pack("<IQI", 0, size + len(entry), 1)
           + warc_zip.END + struct.pack("<4H2IH", 0, 0, 1, 1, len(entry), 0xFFFFFFFF, 0))
    f = Sparse([(far, local + b"hello"), (size, entry + end)])
    m, = warc_zip.read_directory(f, size + len(entry) + len(end))
    assert (m.name, m.header, m.size) == (name.decode(), far, 5)
    assert warc_zip.read_range(f, warc_zip.data_start(f, m), 5) == b"hello"
