"""WARC archives: pages are written as records, and archives read by byte ranges."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.llm.shared import at, publish
from lumigrid.llm.words import slices

#: Payloads of fewer bytes are stored again rather than referred to.
LEAST_REVISIT = 100
#: Bytes of an archive that a reading task takes.
SPLIT = 64 << 20
#: A new archive is begun beyond this size.
ARCHIVE = 1 << 30
MAGIC = b"\x1f\x8b\x08"
READ = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- writing -----------------------------------------------------------------------


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """A row for each page: page_id, url, html (null in revisits), payload_bytes,
    payload_digest, record_type, refers_to. Of equal payloads of at least `least` bytes
    the page of smallest id (nulls last, then by url) is the response; of repeated rows of
    that page one is. A null html is empty, a null url stays null. An empty table gives no
    rows; other columns are not read. Payloads go through one aggregate by digest, combined before the
    shuffle, so a payload that fills a third of the table is moved once for each task."""
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    p = p.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2("html", 256)})
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url")
    large = p.where(F.col("payload_bytes") >= least)
    first = large.groupBy("payload_digest").agg(F.min(rank).alias("first"), F.first("html").alias("html"), F.first("payload_bytes").alias("payload_bytes"))
    fields = ["page_id", "url", "html", "payload_bytes", "payload_digest"]
    none = F.lit(None).cast("long").alias("refers_to")
    kind = lambda x: F.lit(x).alias("record_type")
    whole = first.select(F.col("first.page_id"), F.col("first.url"), *fields[2:], kind("response"), none)
    small = p.where(F.col("payload_bytes") < least).select(*fields, kind("response"), none)
    copies = large.groupBy("payload_digest", "page_id", "url", "payload_bytes").agg(F.count("*").alias("n"))
    again = copies.join(first.select("payload_digest", "first"), "payload_digest")
    again = again.withColumn("n", (F.col("n") - F.when(rank == F.col("first"), 1).otherwise(0)).cast("int")).where("n > 0")
    again = again.select("page_id", "url", F.lit(None).cast("string").alias("html"), "payload_bytes", "payload_digest", kind("revisit"), F.col("first.page_id").alias("refers_to"), F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    return whole.unionByName(small).unionByName(again.drop("copy"))


def _record(row: dict, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    url = row["url"]
    target = None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    block = http + (row["html"].encode() if row["record_type"] == "response" else b"")
    urn = lambda page: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page}')}>"
    head = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": urn(row["page_id"]),
        "WARC-Date": date,
        "WARC-Target-URI": target,
        "X-Page-URL": None if url is None or target == url == url.strip() else json.dumps(url),
        "WARC-Payload-Digest": f"sha256:{row['payload_digest']}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
        "X-Page-ID": row["page_id"],
    }
    if row["record_type"] == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": urn(row["refers_to"]), "X-Refers-To-Page-ID": row["refers_to"]}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def write(rows: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z", archive: int = ARCHIVE) -> list[tuple[str, int]]:
    """Writes records() rows as gzip archives, a member for each record, and returns path
    and size of each. A file gets its name when it is whole, so a task can run again. No
    rows give no archives; a url that a header cannot hold as it is stands beside it too."""
    at(folder)[0].create_dir(at(folder)[1], recursive=True)

    def run(batches):
        part, k, out, size, name = TaskContext.get().partitionId(), 0, None, 0, ""

        def close():
            out.close()
            publish(path := f"{folder}/part-{part:06d}-{k:04d}.warc.gz", name)
            return pa.RecordBatch.from_pylist([{"path": path, "n_bytes": size}])

        for piece in slices(batches, "html"):
            for row in piece.to_pylist():
                if out is None:
                    name, size = f"{folder}/.{uuid.uuid4().hex}", 0
                    store, local = at(name)
                    out = store.open_output_stream(local)
                gz = zlib.compressobj(6, wbits=31)
                member = gz.compress(_record(row, date)) + gz.flush()
                out.write(member)
                size += len(member)
                if size >= archive:
                    yield close()
                    out, k = None, k + 1
        if out is not None:
            yield close()

    # a row for each archive comes to the driver
    return sorted(tuple(r) for r in rows.mapInArrow(run, "path string, n_bytes long").collect())


# ---- reading -----------------------------------------------------------------------


class _Tail:
    """A growing view of a file from `begin`, with what was passed given back. Bytes are
    read in order, each once."""

    def __init__(self, file, begin: int, size: int):
        self.file, self.begin, self.size, self.data = file, begin, size, bytearray()

    def to(self, end: int) -> bool:
        """Whether bytes up to `end` are held now."""
        while self.begin + len(self.data) < min(end, self.size):
            at_ = self.begin + len(self.data)
            self.data += self.file.read_at(min(max(READ, end - at_), self.size - at_), at_)
        return self.begin + len(self.data) >= end

    def get(self, start: int, n: int) -> bytes:
        self.to(start + n)
        return bytes(self.data[start - self.begin : start - self.begin + n])

    def free(self, upto: int) -> None:
        if upto - self.begin >= READ:
            del self.data[: upto - self.begin]
            self.begin = upto


def _member(tail: _Tail, start: int) -> tuple[bytes, int] | None:
    """The gzip member at `start` and where it ends; None if there is none."""
    gz, out, pos = zlib.decompressobj(31), [], start
    try:
        while not gz.eof and pos < tail.size:
            chunk = tail.get(pos, READ >> 2 if out else 1 << 14)
            out.append(gz.decompress(chunk))
            pos += len(chunk)
            if len(out) == 1 and not out[0].startswith(b"WARC/1."):
                return None
    except zlib.error:
        return None
    return (b"".join(out), pos - len(gz.unused_data)) if gz.eof else None


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}, rest


def _owned(file, size: int, start: int, end: int):
    """Records that begin in [start, end). The first is looked for: gzip magic whose
    member decodes to a record's header and is followed by another member or the file's
    end. From there on each member ends where the next begins."""
    tail, pos = _Tail(file, start, size), start
    while pos < end:
        tail.free(pos)
        tail.to(pos + READ)
        found = tail.data.find(MAGIC, pos - tail.begin)
        if found < 0:
            if tail.begin + len(tail.data) >= min(size, end + len(MAGIC)):
                return
            pos = tail.begin + len(tail.data) - len(MAGIC) + 1
            continue
        pos = tail.begin + found
        if pos >= end:
            return
        member = _member(tail, pos)
        if member and (member[1] == size or tail.get(member[1], len(MAGIC)) == MAGIC):
            while member:
                yield member[0]
                pos = member[1]
                if pos >= min(end, size):
                    return
                tail.free(pos)
                member = _member(tail, pos)
            if tail.get(pos, len(MAGIC)) == MAGIC:
                raise ValueError(f"the archive is damaged at byte {pos}")
        else:
            pos += 1


def read(spark: SparkSession, archives: list[tuple[str, int]], split: int = SPLIT, payload: bool = True) -> DataFrame:
    """The records of archives of known sizes: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, payload (null in revisits). Digests of
    responses are computed again from the bytes; one that differs from the record's header
    is an error. A task reads one byte range of one archive, in order, each byte once but
    for what a record that begins in it has beyond its end. No archives give no rows."""
    ranges = [(path, size, a, min(a + split, size)) for path, size in archives for a in range(0, size, split)]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    if not ranges:
        return spark.createDataFrame([], schema)

    sent = spark.sparkContext.broadcast(ranges)  # a line for each 64 MB of archives

    def run(batches):
        for name, size, low, high in (sent.value[k] for b in batches for k in b.column(0).to_pylist()):
            store, path = at(name)
            rows, held = [], 0
            with store.open_input_file(path) as file:
                for data in _owned(file, size, low, high):
                    head, block = _headers(data)
                    if head["warc-type"] not in ("response", "revisit"):
                        continue
                    http, body = _headers(block[: int(head["content-length"])])
                    digest = head["warc-payload-digest"].partition(":")[2]
                    whole = head["warc-type"] == "response"
                    if whole and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"the payload of page {head.get('x-page-id')} does not have its digest")
                    number = lambda k, head=head: int(head[k]) if k in head else None
                    row = {"page_id": number("x-page-id"), "url": json.loads(head["x-page-url"]) if "x-page-url" in head else head.get("warc-target-uri"), "payload_bytes": len(body) if whole else int(http["content-length"]), "payload_digest": digest, "record_type": head["warc-type"], "refers_to": number("x-refers-to-page-id")}
                    rows.append(row | ({"payload": body if whole else None} if payload else {}))
                    held += len(data)
                    if held >= 8 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=types)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=types)

    types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *[("payload", pa.binary())] * payload])
    return spark.range(0, len(ranges), 1, len(ranges)).mapInArrow(run, schema)


def archives_in(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """Path and size of the archives that a path or glob names, listed by Spark."""
    return sorted(tuple(r) for r in spark.read.format("binaryFile").load(pattern).select("path", "length").collect())
