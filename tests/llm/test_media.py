import hashlib
import tarfile
import zlib

import pytest
from pyarrow import fs as pafs

from terracell.llm.common import scratch_path, table
from terracell.llm.media import ArchiveReader, decode_png, encode_png, feature_of, media_digests, payload_of, read_archives, write_archives


def want(text):
    raw = (text or "").encode()
    payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])


def test_digests(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    rows += [(900, None), (901, ""), (None, "nameless"), (902, "é" * 96), (902, "é" * 96), (903, "long " * 300_000), (904, "tail  ")]
    got = media_digests(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, media int").repartition(4)).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got), key=key) == sorted(((i, *want(t)) for i, t in rows), key=key)
    twice = [tuple(r) for r in got if r["doc_id"] == 902]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert media_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ranges_cover_every_member_once(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    path = write_archives(docs, scratch_path(spark, "media"))
    for size in (1000, 50_000, 1 << 30):
        read = read_archives(spark, path, range_bytes=size)
        assert sorted(r["doc_id"] for r in read.select("doc_id").collect()) == list(range(200))
    local = path.removeprefix("file://")
    name = next(f.base_name for f in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(local)) if f.base_name.endswith(".tar"))
    with tarfile.open(f"{local}/{name}") as tar:  # any tar reader finds the members
        member = tar.next()
        assert decode_png(tar.extractfile(member).read())[0]


class _Flaky:
    """A file that gives wrong bytes or fails on its first reads."""

    def __init__(self, good, problems):
        self.good, self.problems = good, problems

    def read_at(self, n, at):
        problem = self.problems.pop() if self.problems else None
        if problem == "fail":
            raise OSError("lost")
        return self.good[at : at + n] if problem is None else b"\0" * n

    def close(self):
        pass

    def open_input_file(self, path):
        return self


def test_members_are_retried_by_offset():
    media = encode_png(payload_of(b"text"), 4)
    flaky, reader = _Flaky(b"xx" + media, ["fail", "wrong"]), ArchiveReader("", 1, 3)
    assert reader.member(flaky, "p", flaky, 2, len(media), zlib.crc32(media))[0] == media
    bad = _Flaky(b"xx" + media, ["wrong"] * 9)
    with pytest.raises(OSError, match="checksum"):
        reader.member(bad, "p", bad, 2, len(media), zlib.crc32(media))
    assert decode_png(media) == (payload_of(b"text"), 4) and feature_of(payload_of(b"")).startswith("1:32.000:0.000:")


class _Lost:
    """A file system whose first openings and reads fail."""

    def __init__(self, data, failures):
        self.data, self.left = data, failures

    def open_input_file(self, path):
        self._fail()
        return self

    def read_at(self, length, offset):
        self._fail()
        return self.data[offset : offset + length]

    def _fail(self):
        if self.left:
            self.left -= 1
            raise OSError("lost")

    def close(self):
        pass


def test_failed_openings_are_tried_again():
    data = bytes(range(256))
    reader = ArchiveReader("file:///nowhere", 1 << 20, 3)
    for failures in range(4):
        files = _Lost(data, failures)
        media, archive = reader.member(files, "a", None, 10, 20, zlib.crc32(data[10:30]))
        assert media == data[10:30] and archive is files
    with pytest.raises(OSError):
        reader.member(_Lost(data, 4), "a", None, 10, 20, zlib.crc32(data[10:30]))
    with pytest.raises(OSError, match="checksum"):
        reader.member(_Lost(data, 0), "a", None, 10, 20, 1)
