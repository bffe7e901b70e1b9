import gzip
import hashlib

from markbook.llm import warc as W

SCHEMA = "page_id long, url string, html string, record_type string, offset string"


def test_round_trip(spark):
    same, small = "<p>" + "é" * 80, "<p>s"
    rows = [(7, "u7", same), (3, "u3", same), (9, "u9\r\nX: y", same), (4, "u4", small), (5, "u5", small), (None, "n", same), (8, None, None), (10, "u10", ""),
            (3, "u3", same), (11, "big", "<p>" + "long text \r\n\r\n" * 60000)]
    folder, index = W.write(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA))
    assert index.count() == len(rows)
    got = W.read(folder, index, index.archives).collect()
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = len(raw) >= 100 and html == same and i != 3
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None, None if revisit else html or ""))
    key = lambda r: (r[0] or 0, r[1:3])
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in got), key=key) == sorted(want, key=key)
    some = index.where("page_id IN (4, 11)")
    assert sorted(r.page_id for r in W.read(folder, some, index.archives).collect()) == [4, 11]


def test_an_archive_is_gzip_members_of_whole_records(spark):
    import glob

    folder, index = W.write(spark.createDataFrame([(i, f"u{i}", f"<p>{i}") for i in range(20)], "page_id long, url string, html string"))
    (name,) = glob.glob(folder.removeprefix("file:") + "/*.warc.gz")
    raw = open(name, "rb").read()
    rows = index.orderBy("offset").collect()
    assert [r.offset for r in rows] == [sum(x.length for x in rows[:i]) for i in range(20)] and sum(r.length for r in rows) == len(raw)
    assert all(gzip.decompress(raw[r.offset: r.offset + r.length]).startswith(b"WARC/1.1\r\n") for r in rows)


def test_empty_table(spark):
    folder, index = W.write(spark.createDataFrame([], SCHEMA))
    assert W.read(folder, index, index.archives).count() == 0
