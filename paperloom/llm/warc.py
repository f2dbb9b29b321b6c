"""WARC archives: a writer with revisit records and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, bounded, qualified, removed, row_ids, shared_dir, stable, store, written

#: Bytes of payload from which equal payloads are revisited.
LEAST_BYTES = 0
#: Bytes of an archive after which a task begins another, of a split, and of a block that the reader fetches.
ARCHIVE_BYTES, SPLIT_BYTES, BLOCK_BYTES = 1 << 30, 64 << 20, 1 << 20
#: Bits of a row number below those of its scan task, and of a scan task's number below those of a folder of decisions.
TASK_BITS, TOGETHER_BITS = 33, 4
#: Compressed bytes handed to the decoder at once.
FEED = 16 << 10
GZIP_MAGIC = b"\x1f\x8b\x08"
GZIP_LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
RECORDS = "page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def one_line(text: str | None) -> str:
    """A header value: control characters are percent-encoded."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in text or "").strip()


def record_id(page_id: int | None, uid: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}/{uid}')}>"


def page_record(uid: int, page_id: int | None, url: str | None, payload: bytes, first: dict | None) -> bytes:
    """A page's record: a response, or a revisit of the page ``first``, whose block has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", record_id(page_id, uid)), ("WARC-Date", DATE), ("WARC-Target-URI", one_line(url)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}")]
    if page_id is not None:
        headers.append(("Page-Id", str(page_id)))
    if first:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first["page_id"], first["uid"])), ("WARC-Refers-To-Target-URI", one_line(first["url"]))]
        if first["page_id"] is not None:
            headers.append(("Refers-To-Page-Id", str(first["page_id"])))
    return member(headers, http if first else http + payload)


def revisits_of(decided: str, task: int) -> dict[int, dict]:
    """What the rows of a scan task revisit, by row number."""
    files, place = store(f"{decided}/tasks={task >> TOGETHER_BITS}")
    out = {}
    for info in files.get_file_info(pafs.FileSelector(place, allow_not_found=True)):
        if info.base_name.startswith("part-"):
            own = pq.read_table(info.path, filesystem=files, partitioning=None, filters=[("uid", ">=", task << TASK_BITS), ("uid", "<", (task + 1) << TASK_BITS)])
            out |= {r["uid"]: {"page_id": r["page_id"], "uid": r["first_uid"], "url": r["url"]} for r in own.to_pylist()}
    return out


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row of ``pages`` into ``path`` and returns the archives: ``path, size, records``.

    Of equal payloads of ``least_bytes`` or more, the row with the least id (of several, the first) is the response and
    the others revisit it. Payloads are equal when their SHA-256 and length are. Only digests meet for this: the first
    row of each repeated payload is found with partial sums and written, so that the join of the digests to it has no
    aggregate under it and the adaptive planner can split a payload with very many copies. What each row revisits is
    written by scan task and picked up there, so payloads go from the scan straight to their archive. A task writes
    archives under names of its own and renames them when complete, so a repeated task leaves the same files; readers use
    the returned table, which lists complete ones only.

    Null and empty payloads are equal; a very long one is one record. A null id sorts last and is left out of the record;
    a null url is ''. Repeated rows have a record each, all but the first a revisit. Without rows there are no archives.
    """
    spark = pages.sparkSession
    rows = row_ids(stable(pages), [key, url, html]).toDF("uid", "page_id", "url", "html")
    rows = rows.select("uid", F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    keys = rows.select("uid", "page_id", "url", F.length("payload").alias("size"), F.sha2("payload", 256).alias("digest")).filter(F.col("size") >= least_bytes)
    folder, decided = qualified(spark, path), qualified(spark, shared_dir(spark, "revisits"))
    with Scratch(spark) as held:
        first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "uid", "url")).alias("first")
        repeated = held.written(keys.groupBy("digest", "size").agg(first, F.count("*").alias("n")).filter("n > 1").drop("n"), "repeated-payloads")
        revisits = keys.select("uid", "digest", "size").join(repeated, ["digest", "size"]).filter("uid <> first.uid").select("uid", "first.page_id", F.col("first.uid").alias("first_uid"), "first.url")
        of_task = revisits.withColumn("tasks", F.shiftright("uid", TASK_BITS + TOGETHER_BITS))
        of_task.repartition("tasks").sortWithinPartitions("tasks", "uid").write.partitionBy("tasks").parquet(decided)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = store(folder)
        files.create_dir(place, recursive=True)
        context, revisited = TaskContext.get(), None
        out, number, done = None, 0, []

        def opened():
            draft = f"{place}/.draft-{context.partitionId():06d}-{number}-{context.taskAttemptId()}"
            file = files.open_output_stream(draft)
            file.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, (context.partitionId() << 20) + number)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            return [draft, file, 0]

        def closed() -> None:
            name = f"{place}/part-{context.partitionId():06d}-{number}.warc.gz"
            size = out[1].tell()
            out[1].close()
            files.move(out[0], name)
            done.append((f"{folder}/{name.rsplit('/', 1)[1]}", size, out[2]))

        for part in parts:
            for row in part.to_pylist():
                out = out or opened()
                revisited = revisits_of(decided, row["uid"] >> TASK_BITS) if revisited is None else revisited
                out[1].write(page_record(row["uid"], row["page_id"], row["url"], row["payload"], revisited.get(row["uid"])))
                out[2] += 1
                if out[1].tell() >= archive_bytes:
                    closed()
                    out, number = None, number + 1
        if out:
            closed()
        names, sizes, counts = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["path", "size", "records"])

    archives = written(rows.mapInArrow(run, "path string, size long, records long"), "archives")
    removed(spark, decided)
    return archives


class Blocks:
    """Bytes of a file, fetched in blocks of which two are kept."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.held = file, size, {}

    def block(self, number: int) -> bytes:
        if number not in self.held:
            if len(self.held) > 1:
                self.held.pop(min(self.held))
            self.file.seek(number * BLOCK_BYTES)
            self.held[number] = self.file.read(BLOCK_BYTES)
        return self.held[number]

    def at(self, place: int, most: int) -> bytes:
        """Up to ``most`` bytes from ``place``, as many as its block has."""
        offset = place % BLOCK_BYTES
        return self.block(place // BLOCK_BYTES)[offset : offset + most]

    def magic(self, place: int, end: int) -> int:
        """The first gzip magic that starts in ``[place, end)``, or -1."""
        while place < min(end, self.size):
            here = self.at(place, BLOCK_BYTES)
            joint = here + self.at(place + len(here), 2) if place + len(here) < self.size else here
            found = joint.find(GZIP_MAGIC)
            if found >= 0:
                return place + found if place + found < end else -1
            place += len(here)
        return -1


def decoded(blocks: Blocks, place: int) -> tuple[bytes, int] | None:
    """A member's content and the place after it; None where no WARC record starts."""
    unpacker, out, at = zlib.decompressobj(31), [], place
    while not unpacker.eof:
        feed = blocks.at(at, FEED) if at < blocks.size else b""
        if not feed:
            return None
        try:
            out.append(unpacker.decompress(feed))
        except zlib.error:
            return None
        at += len(feed)
        if len(out) == 1 and out[0] and not out[0].startswith(b"WARC/"[: len(out[0])]):
            return None
    return b"".join(out), at - len(unpacker.unused_data)


def parsed(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers by lower-case name and the block; None unless the header is whole and the lengths agree."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not mark or not version.startswith(b"WARC/"):
        return None
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.decode("utf-8", "replace").partition(":") for line in lines)}
    length = headers.get("content-length", "")
    if not length.isdigit() or "warc-type" not in headers or len(rest) != int(length) + 4:
        return None
    return headers, rest[: int(length)]


def records_from(file, start: int, end: int, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records that start in ``[start, end)``, each whole even where it goes on after ``end``.

    From ``start`` on every gzip magic is a candidate; it is one only if it decodes to a WARC header with a block of the
    stated length. After a record the next one is expected at once; if there is none, the search goes on.
    """
    blocks, place = Blocks(file, size), start
    while (place := blocks.magic(place, end)) >= 0:
        got = decoded(blocks, place)
        record = parsed(got[0]) if got else None
        if record is None:
            place += 1
            continue
        yield record
        place = got[1]


def page_row(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    page_id, refers_to = (int(headers[k]) if k in headers else None for k in ("page-id", "refers-to-page-id"))
    if headers["warc-type"] == "response":
        if (found := sha1_base32(payload)) != digest:
            raise ValueError(f"the payload of {headers.get('warc-record-id')} has digest {found}, not {digest}")
        size = len(payload)
    else:
        size = next((int(line.partition(b":")[2]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")), 0)
    return page_id, headers.get("warc-target-uri"), headers["warc-type"], size, digest, refers_to, payload if payloads and headers["warc-type"] == "response" else None


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """The response and revisit records of ``archives(path, size)``, split by byte ranges.

    An archive is cut into splits of ``split_bytes`` without looking inside; each task owns the records that start in
    its range, so every record is read once wherever the cuts fall. The digest of every response is verified.
    ``payloads=False`` leaves the payload column null. No archives, or empty ones, give no rows; repeated archives are
    read as often as they are listed, and records without an id have a null ``page_id``.
    """
    spark = archives.sparkSession
    bounded(spark)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long")))
    splits = archives.filter("size > 0").select("path", "size", starts.alias("start"))
    splits = splits.repartition(max(1, splits.count()))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for part in parts:
            for split in part.to_pylist():
                files, place = store(split["path"])
                rows, size = [], 0
                with files.open_input_file(place) as file:
                    for headers, block in records_from(file, split["start"], split["start"] + split_bytes, split["size"]):
                        if headers["warc-type"] in ("response", "revisit"):
                            rows.append(page_row(headers, block, payloads))
                            size += 200 + len(rows[-1][-1] or b"")
                        if len(rows) >= 2000 or size >= 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return splits.mapInArrow(run, RECORDS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_dir(spark, "warc"))
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id) AS k,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id, sha1(coalesce(html, '')) AS hex
  FROM pages
)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k = 1 THEN NULL ELSE first_id END AS refers_to
FROM p
"""
