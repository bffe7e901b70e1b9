"""WARC archives read by their index.

A row per page is planned first, without its html: which archive holds it, and whether it is a response or revisits one.
Pages then meet their plan by archive; the task that holds an archive compresses each record as its own gzip member, writes
the archive under a passing name, renames it when it is whole, and returns the index: archive, offset, length, URL and
digest per record.  A task that runs twice writes the same bytes under the same name.  Reading takes index rows, sorts
them by offset and joins near ranges into one read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.llm.common import discard, lookup_join, query, stored, table, travels
from markbook.session import fresh_path

travels(__name__)

ARCHIVE_BYTES = 16 << 20  # payload aimed at per archive
LEAST_REVISIT = 100  # smaller payloads are always stored as responses
GAP_BYTES = 64 << 10  # ranges nearer than this are one read
READ_BYTES = 8 << 20  # and a read grows no further than this
END = b"\r\n\r\n"


def _measured(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, place): ``place`` is a hash of the row that orders an archive."""
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2("html", 256))
    return pages.withColumn("place", F.xxhash64("page_id", "url", "payload_digest"))


def planned(pages: DataFrame) -> DataFrame:
    """(archive, place, page_id, url, payload_bytes, payload_digest, record_type, refers_to), one row per page.

    A null html is an empty payload, a null url an empty one.  Of equal payloads of at least 100 bytes the smallest
    page_id is the response (rows with a null page_id never are, unless all are); a repeated page row repeats its record.
    No step here moves an html."""
    slim = stored(_measured(pages).drop("html"), "warc-pages")
    totals = slim.agg(F.count("*").alias("n"), F.sum("payload_bytes").alias("b")).first()
    same = slim.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(
        F.count("*").alias("copies"), F.min("page_id").alias("first_id")).where("copies > 1")
    rows = lookup_join(slim, stored(same, "warc-copies"), "payload_digest", "copies", totals.n, F.col("place").cast("string"))
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    rows = rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_id"))).drop("first_id")
    archives = max(1, -(-(totals.b or 0) // ARCHIVE_BYTES))
    plan = stored(rows.withColumn("archive", _archive(archives)), "warc-plan")
    discard(slim)
    plan.archives = archives
    return plan


def _archive(archives: int) -> Column:
    return F.pmod(F.xxhash64("place"), F.lit(archives)).cast("int").alias("archive")


def _record(r) -> bytes:
    """One record, its header and body, uncompressed."""
    text = lambda v: "-" if pd.isna(v) else str(int(v))
    body = r.html.encode() if r.record_type == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {r.record_type}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{text(r.page_id)} {r.url} {r.payload_digest}')}>",
            "WARC-Date: 1970-01-01T00:00:00Z", "WARC-Target-URI: " + r.url.replace("\r", "%0D").replace("\n", "%0A"),
            f"WARC-Payload-Digest: sha256:{r.payload_digest}", f"X-Page-ID: {text(r.page_id)}", f"X-Payload-Length: {r.payload_bytes}"]
    if r.record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To: {text(r.refers_to)}"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + END


def _file(folder: str, archive: int) -> str:
    return f"{folder}/{archive:08d}.warc.gz"


def write(pages: DataFrame) -> tuple[str, DataFrame]:
    """(folder of the archives, index).  The one step that moves an html is the meeting of pages and plan by archive.

    The shared folder must be in a store that pyarrow opens by its address (file, hdfs, s3, gs)."""
    plan = planned(pages)
    keys = ["place", "page_id", "url", "payload_digest"]
    rows = _measured(pages).withColumn("archive", _archive(plan.archives))
    folder = fresh_path(pages.sparkSession, "warc")
    index_columns = ["archive", "offset", "length", "page_id", "url", "payload_digest"]

    def save(pages: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        # Both sides hold the same rows, so in one order they stand side by side.
        pages, plan = (x.sort_values(keys, kind="stable", ignore_index=True) for x in (pages, plan))
        pages[["record_type", "refers_to"]] = plan[["record_type", "refers_to"]]
        archive = int(pages["archive"].iloc[0])
        store, name = fs.FileSystem.from_uri(_file(folder, archive))
        store.create_dir(name.rsplit("/", 1)[0], recursive=True)
        passing, offsets, lengths, at = f"{name}.{uuid.uuid4().hex}", [], [], 0
        with store.open_output_stream(passing, compression=None) as out:
            for r in pages.itertuples():
                member = gzip.compress(_record(r), compresslevel=6, mtime=0)
                out.write(member)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
        store.move(passing, name)
        return pages.assign(offset=offsets, length=lengths)[index_columns].astype({"page_id": "Int64"})

    filed = rows.groupBy("archive").cogroup(plan.groupBy("archive")).applyInPandas(
        save, "archive int, offset long, length long, page_id long, url string, payload_digest string")
    index = stored(filed, "warc-index")
    index.archives = plan.archives
    discard(plan)
    return folder, index


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def _runs(rows: pd.DataFrame):
    """Index rows of one file, sorted by offset, in groups that one read fetches."""
    run, start, end = [], 0, 0
    for r in rows.sort_values("offset").itertuples():
        if run and (r.offset > end + GAP_BYTES or r.offset + r.length > start + READ_BYTES):
            yield start, end, run
            run = []
        if not run:
            start, end = r.offset, r.offset
        run.append(r)
        end = max(end, r.offset + r.length)
    if run:
        yield start, end, run


def read(folder: str, selected: DataFrame, archives: int) -> DataFrame:
    """Records of the selected index rows (archive, offset, length), parsed and checked against their digest."""

    def fetch(rows: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(_file(folder, int(rows["archive"].iloc[0])))
        out = []
        with store.open_input_file(name) as f:
            for start, end, run in _runs(rows):
                data = f.read_at(end - start, start)
                for r in run:
                    record = gzip.decompress(data[r.offset - start: r.offset - start + r.length])
                    head, _, body = record.partition(b"\r\n\r\n")
                    field, body = _fields(head), body[: -len(END)]
                    response = field["WARC-Type"] == "response"
                    digest = field["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not record.endswith(END) or len(body) != int(field["Content-Length"]) or response and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"the record at {r.offset} of {name} is not the one written")
                    number = lambda k: None if field.get(k, "-") == "-" else int(field[k])
                    out.append((number("X-Page-ID"), int(field["X-Payload-Length"]), digest, field["WARC-Type"], number("X-Refers-To"),
                                field["WARC-Target-URI"], body.decode() if response else None))
        frame = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])
        return frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    rows = selected.select("archive", "offset", "length").repartition(archives, "archive")
    return rows.groupBy("archive").applyInPandas(fetch, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string")


OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


@query("op9_warc", OP9_SQL)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page into archives and read all of them back by their index."""
    folder, index = write(table(spark, sf_dir, "pages"))
    return read(folder, index, index.archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
