import glob
import gzip
import hashlib
import zlib

import duckdb
import pytest

from fieldcohort.llm import common, registry, warc

SCHEMA = "page_id long, url string, html string, digest string, size long, top long"


def pages(spark):
    big = "a" * 1500
    rows = [(1, "u v", big), (2, None, big), (3, "x", None), (4, "x", "é" * 700), (5, "y", "é" * 700), (5, "y", "é" * 700), (None, "z", big), (6, "x", ""), (7, "q", "b" * 999), (8, "q", "b" * 999), (9, "long", "ab" * 400_000)]
    # columns of the names that the operator uses inside
    return spark.createDataFrame([(*r, "d", 1, 2) for r in rows], SCHEMA)


def test_round_trip_and_revisits(spark):
    path = common.scratch(spark, "warc-test")
    warc.write_archives(pages(spark), path, most=2000)
    got = warc.read_archives(spark, path).collect()
    key = lambda v: (v is None, v)
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=lambda r: (key(r[0]), r[1]))
    assert kinds == [(1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "revisit", 5), (5, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "response", None), (9, "response", None), (None, "revisit", 2)]
    by = {r.page_id: r for r in got}
    assert by[4].payload_bytes == 1400 and by[4].payload_digest == hashlib.sha1(("é" * 700).encode()).hexdigest()
    assert by[3].payload_bytes == 0 and by[9].payload_bytes == 800_000
    # each archive is a chain of gzip members that any reader takes
    text = b"".join(gzip.open(f).read() for f in glob.glob(path.removeprefix("file://") + "/part*"))
    assert text.count(b"WARC/1.1\r\n") == len(got)


def test_empty_table(spark):
    path = common.scratch(spark, "warc-test")
    warc.write_archives(pages(spark).limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def member(payload=b"hello", refers_to=None):
    return warc.member(1, "http://x/", payload, refers_to)


@pytest.mark.parametrize("step", [1, 7, 1 << 16])
def test_pieces_of_any_size(step):
    raw = member(b"x" * 5000) + warc.EMPTY_MEMBER + member() + member(b"q", 9)
    got = list(warc.read_archive((raw[k : k + step] for k in range(0, len(raw), step)), payloads=True))
    assert [r["payload"] for r in got] == [b"x" * 5000, b"hello", None] and got[2]["refers_to"] == "<urn:page:9>" and got[2]["payload_bytes"] == 1


def broken(change):
    text = zlib.decompress(member(), 31)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(change(text)) + packer.flush()


@pytest.mark.parametrize(
    "raw",
    [broken(lambda t: t.replace(b"hello", b"jello")), broken(lambda t: t + b"more"), broken(lambda t: t[:-10]), broken(lambda t: t.replace(b"WARC/1.1", b"XARC/1.1")), member()[:-20]],
)
def test_broken_archives(raw):
    with pytest.raises(warc.WarcError):
        list(warc.read_archive([raw]))


def test_query_matches_sql(spark, sf):
    got = sorted(map(tuple, registry.op1_warc(spark, sf).collect()))
    duckdb.sql(f"create or replace view pages as select * from '{sf}/pages.parquet'")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert got == sorted(duckdb.sql(f"select {', '.join(names)} from ({registry.OP1_SQL})").fetchall())


READ_LARGE = r"""
import os, re, sys
from fieldcohort.llm import common, warc
path, times = sys.argv[1], int(sys.argv[2])
one = warc.member(1, "http://x/", os.urandom(1 << 20), None) + warc.EMPTY_MEMBER
with open(path, "wb") as f:
    for _ in range(times):
        f.write(one)
n = 0
with common.open_file("file:" + path) as f:
    for r in warc.read_archive(iter(lambda: f.read(warc.PIECE), b"")):
        n += r["payload_bytes"]
assert n == times << 20
# of this program alone; the usage that the system reports begins with the parent's
print(int(re.search(r"VmHWM:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024)
"""


def test_large_archives_are_read_in_pieces(tmp_path):
    import os
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", READ_LARGE, str(tmp_path / "big.warc.gz"), "200"], capture_output=True, text=True, timeout=200, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert float(done.stdout) < 250


def test_an_archive_has_many_rows(spark):
    # a task's records make one archive of several rows, or several archives
    rows = [(k, "u", f"{k} " * 300) for k in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for most, least, archives in ((1 << 30, 1, 1), (20_000, 2, 100)):
        path = common.scratch(spark, "warc-test")
        warc.write_archives(df, path, most=most, row=5000)
        files = glob.glob(path.removeprefix("file://") + "/part*")
        assert least <= len(files) <= archives
        assert sorted(r.page_id for r in warc.read_archives(spark, path).collect()) == list(range(200))
        assert sum(gzip.open(f).read().count(b"WARC/1.1\r\n") for f in files) == 200
    assert max(open(f, "rb").read().count(warc.EMPTY_MEMBER) for f in files) > 1
