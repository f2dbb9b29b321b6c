import base64
import gzip
import hashlib
import io
import zlib

import pytest

from paperloom.llm import warc
from paperloom.llm.common import shared_dir

SCHEMA = "page_id long, url string, html string, uid string, first string, payload string"
PAGES = [(5, "http://a/\n1", "<p>x</p>"), (3, "http://a/2", "<p>x</p>"), (3, "http://a/2", "<p>x</p>"), (9, None, None), (7, "http://b", ""), (None, "http://c", "<p>ü</p>"), (11, "http://d", "<p>ü</p>"), (12, "http://e", "z" * 300_000), (13, "http://f", "WARC/1.1\r\n\r\n\x1f\x8b"), (4, "http://g", "<p>x</p>")]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame([(*p, "u", "f", "p") for p in PAGES], SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def wanted(least):
    groups, out = {}, []
    for i, _, html in PAGES:
        groups.setdefault(html or "", []).append(i)
    for html, ids in groups.items():
        ids, data = sorted(ids, key=lambda i: (i is None, i or 0)), html.encode()
        for k, i in enumerate(ids):
            again = k > 0 and len(data) >= least
            out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 8, 10**6])
@pytest.mark.parametrize("split", [50, 1000, 64 << 20])
def test_round_trip(spark, pages, least, split):
    archives = warc.write_archives(pages, shared_dir(spark, "w"), least_bytes=least, archive_bytes=700)
    got = warc.read_archives(archives, split_bytes=split)
    assert sorted((tuple(r)[:1] + tuple(r)[3:5] + (r.record_type, r.refers_to) for r in got.collect()), key=repr) == wanted(least)
    texts = {(r.page_id, bytes(r.payload).decode()) for r in got.filter("record_type = 'response'").collect()}
    assert texts <= {(i, h or "") for i, _, h in PAGES}


def test_archives_are_plain_gzip(spark, pages):
    archives = warc.write_archives(pages, shared_dir(spark, "w")).collect()
    for a in archives:
        data = gzip.open(a.path.removeprefix("file:").replace("//", "/", 1) if a.path.startswith("file:") else a.path).read()
        assert data.count(b"WARC/1.1\r\nWARC-Type: ") >= a.records and data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_false_magic_is_no_record():
    noise = b"\x1f\x8b\x08" + b"no gzip at all" + gzip.compress(b"not a record") + zlib.compress(b"x")
    record = warc.member([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:" + warc.sha1_base32(b"p"))], b"HTTP/1.1 200 OK\r\n\r\np")
    data = noise + record + b"\x1f\x8b\x08tail" + record
    found = [block for _, block in warc.records_from(io.BytesIO(data), 0, len(data), len(data))]
    assert found == [b"HTTP/1.1 200 OK\r\n\r\np"] * 2
    for cut in range(len(data)):
        first = list(warc.records_from(io.BytesIO(data), 0, cut, len(data)))
        assert len(first) + len(list(warc.records_from(io.BytesIO(data), cut, len(data), len(data)))) == 2


def test_damaged_payload_is_refused():
    with pytest.raises(ValueError, match="digest"):
        warc.page_row({"warc-type": "response", "warc-payload-digest": "sha1:AAAA"}, b"h\r\n\r\nbody", True)


def test_no_pages(spark, pages):
    archives = warc.write_archives(pages.limit(0), shared_dir(spark, "w"))
    assert warc.read_archives(archives).count() == 0
