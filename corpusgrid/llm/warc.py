"""WARC archives: writing with segments, revisits and chunked framing; reading with segment reassembly."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgrid.llm.common import bounded, documents, open_store, scratch, slices, small, table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of a chunk in chunked transfer framing, of a segment, and of an archive before the next one begins.
CHUNK, SEGMENT, ROLL = 8192, 32_768, 64 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked framing; chunk extensions are skipped, a short or unended body is an error."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        chunk = body[end + 2 : end + 2 + n]
        if len(chunk) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(chunk)
        at = end + 4 + n


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response, its transfer framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record as a gzip member of its own."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + c.flush()


def records_of(page_id, url: str | None, payload: bytes, refers_to, is_revisit: bool, copy: int = 0) -> Iterator[bytes]:
    """A page's records: a revisit without payload, or a response, cut into segments if it is long. copy: the number among rows
    of equal key and payload, which tells their record ids apart."""
    d = digest(payload)
    name = lambda i, copy=0: f"<urn:page:{'' if i is None else i}:{d}{f'.{copy}' if copy else ''}>"
    own = name(page_id, copy)
    uri = (url or "").replace("\r", "").replace("\n", "")
    head = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{d}"), ("Content-Type", "application/http; msgtype=response")]
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if is_revisit:
        yield record([("WARC-Type", "revisit"), *head, ("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))], status + b"\r\n")
        return
    block = status + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= SEGMENT:
        yield record([("WARC-Type", "response"), *head], block)
        return
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    yield record([("WARC-Type", "response"), *head, ("WARC-Segment-Number", "1")], parts[0])
    for i, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(parts) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{i}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(i)), *last], part)


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, broadcast_rows: int = 100_000) -> DataFrame:
    """Writes a record per row (long ones in segments) and returns the manifest of archives: uri, n_records.

    Of rows with equal payloads of at least least_bytes bytes, those with the smallest key (nulls last) are responses and the
    others revisit it. Groups of equal payloads are found on digests alone, summed map-side; the few that repeat are broadcast
    if they were counted to be few, else joined by shuffle, where AQE splits a hot payload. Payloads stay in their tasks.
    Rows equal in key and payload are numbered, so that each record has an id of its own; revisits refer to the first. Only of these
    rows payloads are moved: one of each (key, payload, url) a task, and its copies.
    Each task writes archives under its attempt's name; only those of attempts that succeeded are in the manifest. Null html is
    empty, a null url is empty. An empty table gives an empty manifest."""
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"d": F.sha1("html"), "n": F.octet_length("html")})
    keys = table(rows.groupBy("d", "n", "id").agg(F.count("*").alias("c")), "keys")
    groups = keys.where(F.col("n") >= least_bytes).groupBy("d", "n").agg(F.sum("c").alias("c"), F.min("id").alias("first")).where("c > 1").select("d", "n", "first")
    groups = table(groups, "payloads")
    again = keys.where("c > 1").select(F.struct("d", "n", "id").alias("key"))
    rows = rows.withColumn("copy", F.lit(0).cast("long"))
    if again.limit(1).count():
        again = small(again, broadcast_rows)
        rows = rows.withColumn("key", F.struct("d", "n", "id"))
        several = rows.join(again, "key", "left_semi").groupBy("d", "n", "id", "url").agg(F.count("*").alias("c"), F.first("html").alias("html"))
        before = F.sum("c").over(Window.partitionBy("d", "n", "id").orderBy("url")) - F.col("c")
        several = several.withColumn("to", before).withColumn("copy", F.explode(F.expr("sequence(to, to + c - 1)"))).repartition("d", "id", "copy")
        rows = rows.join(again, "key", "left_anti").drop("key").unionByName(several.select("id", "url", "html", "d", "n", "copy"))
    rows = rows.join(small(groups, broadcast_rows), ["d", "n"], "left")
    rows = rows.select("id", "url", "html", "first", "copy", F.coalesce(~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)).alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, at, n, files = TaskContext.get(), None, 0, 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for part in slices(batch, "html"):
                for i, u, h, first, again, copy in zip(*[part.column(c).to_pylist() for c in ("id", "url", "html", "first", "again", "copy")]):
                    if out is None or at > ROLL:
                        if out is not None:
                            out.close()
                            done.append((uri, n))
                        uri, at, n = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{files:04d}.warc.gz", 0, 0
                        files += 1
                        fs, path = open_store(uri)
                        fs.create_dir(path.rpartition("/")[0], recursive=True)
                        out = fs.open_output_stream(path, compression=None)
                    for r in records_of(i, u, h.encode(), first, again, copy):
                        out.write(r)
                        at += len(r)
                        n += 1
        if out is not None:
            out.close()
            done.append((uri, n))
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["uri", "n_records"])

    return table(bounded(rows).mapInArrow(run, "uri string, n_records long"), "archives")


def parse(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record, one in memory at a time."""
    fs, path = open_store(uri)
    with fs.open_input_file(path) as raw, gzip.GzipFile(fileobj=raw) as f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{uri}: no record where one should begin")
            head = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                k, _, v = line.decode().partition(":")
                head[k.strip().lower()] = v.strip()
            block = f.read(int(head["content-length"]))
            if len(block) != int(head["content-length"]) or f.read(4) != b"\r\n\r\n":
                raise ValueError(f"{uri}: a record is cut short")
            yield head, block


RECORDS = "record_id string, record_type string, refers_to string, digest string, payload_bytes long, payload_digest string, segment int, total long, block binary"


def checked(block: bytes, said: str | None) -> tuple[int, str]:
    payload = payload_of(block)
    d = digest(payload)
    if said and said != d:
        raise ValueError(f"payload digest {d}, the record says {said}")
    return len(payload), d


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record that isn't a continuation: record_id, record_type, refers_to (a record id), payload_bytes and
    payload_digest of the full payload, decoded and checked. Segments of one origin are brought together by a shuffle, of
    segmented records alone, ordered by number and checked against the total length; missing or repeated segments are errors.
    Revisits have the payload of the record that they refer to, null if the archives don't hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                rows, held = [], 0
                for head, block in parse(uri):
                    said = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    kind, origin = head["warc-type"], head.get("warc-segment-origin-id")
                    if origin or "warc-segment-number" in head:
                        total = head.get("warc-segment-total-length")
                        rows.append((origin or head["warc-record-id"], kind, None, said, None, None, int(head["warc-segment-number"]), total and int(total), block))
                        held += len(block)
                    elif kind == "revisit":
                        rows.append((head["warc-record-id"], kind, head.get("warc-refers-to"), said, None, None, None, None, None))
                    else:
                        rows.append((head["warc-record-id"], kind, None, said, *checked(block, said), None, None, None))
                    if len(rows) == 5000 or held > 8 << 20:
                        yield arrow(rows)
                        rows, held = [], 0
                if rows:
                    yield arrow(rows)

    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def arrow(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def joined(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("segment")
        block = b"".join(parts["block"])
        total = parts["total"].dropna()
        if parts["segment"].tolist() != list(range(1, len(parts) + 1)) or total.tolist() != [len(block)]:
            raise ValueError(f"{key[0]}: segments are missing, repeated or of another length")
        n, d = checked(block, parts["digest"].iloc[0])
        return pd.DataFrame({"record_id": [key[0]], "record_type": [parts["record_type"].iloc[0]], "refers_to": [None], "payload_bytes": [n], "payload_digest": [d]})

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    records = table(manifest.select("uri").repartition(n, "uri").mapInArrow(run, RECORDS), "records")
    columns = ["record_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    whole = records.where("segment is null").select(*columns)
    segments = records.where("segment is not null").select("record_id", "record_type", "digest", "segment", "total", "block")
    whole = whole.unionByName(segments.groupBy("record_id").applyInPandas(joined, "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string"))
    whole = table(whole, "payloads")  # without blocks; read for both sides below
    revisits, responses = whole.where("record_type = 'revisit'"), whole.where("record_type <> 'revisit'")
    target = responses.select(F.col("record_id").alias("refers_to"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to"])
    return responses.unionByName(revisits.drop("payload_bytes", "payload_digest").join(target, "refers_to", "left"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    records = read_archives(write_archives(documents(spark, sf_dir, "pages"), scratch(spark, "warc")))
    page = lambda c: F.split_part(F.col(c), F.lit(":"), F.lit(3)).try_cast("long")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


OP8_SQL = """
with p as (select page_id, coalesce(html, '') h from pages),
g as (select page_id, octet_length(encode(h)) payload_bytes, sha1(h) d, min(page_id) over (partition by h) f from p)
select page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(d, ((j // 4) * 5 + 1)::int, 5))::bigint >> (15 - 5 * (j % 4))::int) & 31) + 1)::int, 1)), '') as payload_digest,
       case when page_id = f then 'response' else 'revisit' end as record_type,
       case when page_id <> f then f end as refers_to
from g
"""
