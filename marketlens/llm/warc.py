"""WARC archives written and read by Spark, through an index of records.

Writing: equal payloads of at least LEAST_BYTES are one response (of the smallest page) and revisits without payload.
Which pages are special is found on ids and digests alone; these few columns and the pages come together in one shuffle
by page and digest, whatever their number, and each row becomes one gzipped record. A gzip member ends with a zero byte
if its content is below 16 MB (longer records get an empty member after them); Spark's text writer puts just that byte
after each record, so archives are valid .gz files that are committed like any Spark output, and lost tasks are run
again. Indexing: each archive's members are walked once, giving offset, length, URL and digest of each record. Reading:
the selected records of an archive, sorted by offset, are read in coalesced byte ranges of bounded length, and their
payloads hashed again.

Archives in a store that pyarrow's file systems do not know are read whole by Spark, one archive at a time.

Defined cases: a null html is an empty payload; a null url is written without a target; rows that repeat page and
payload keep their own URLs, the smallest one's is the response and the others revisit it; rows without page_id are kept
and never name a response unless no page of that payload has one; an empty table gives an empty archive; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, load, new_path, settled

#: Fixed value: shorter payloads are never revisits.
LEAST_BYTES = 100
#: Line end of the headers, end of headers and records, last byte of a gzip member below 16 MB.
LINE, END, LAST = "\r\n", "\r\n\r\n", "\0"
#: Size of a stretch of an archive that one task reads; gap that a coalesced read spans, and its greatest length (single longer records are read whole).
ARCHIVE_BYTES, MOST_GAP, MOST_SPAN = 64 << 20, 64 << 10, 8 << 20
INDEX = "path string, offset long, length long, record_type string, page_id string, url string, payload_digest string, payload_bytes long, refers_to string"


def _keyed(pages: DataFrame) -> DataFrame:
    """(k, page_id, url, payload, digest, bytes): k tells pages and payloads apart, null ids included."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    return rows.select(F.md5(F.concat_ws("|", F.coalesce(F.concat(F.lit("i"), F.col("page_id").cast("string")), F.lit("n")), "digest").cast("binary")).alias("k"), "*")


def decisions(rows: DataFrame) -> DataFrame:
    """(k, low, own) of the pages that are not the lone response of their payload: low is the page that they refer to, own
    whether that is the page itself, so that its first row is the response."""
    narrow = rows.groupBy("k", "digest", "page_id").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes")).where(F.col("bytes") >= LEAST_BYTES)
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("low"), F.count(F.lit(1)).alias("ids"), F.max("n").alias("most")).where("ids > 1 or most > 1")
    special = narrow.join(first.select("digest", "low"), "digest").where("n > 1 or not page_id <=> low")
    return special.select("k", "low", F.col("page_id").eqNullSafe(F.col("low")).alias("own"))


def gzipped(data: bytes) -> bytes:
    """data as gzip members, the last one of which ends with a zero byte."""
    parts = []
    for part in [data] if len(data) < 1 << 24 else [data, b""]:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        parts.append(packer.compress(part) + packer.flush())
    return b"".join(parts)


def _record(date: str, page_id, url, payload: bytes, digest: str, size: int, copy: int, revisit: bool, refers_to) -> bytes:
    """One record, without the separator after it."""
    block = f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: {size}{END}".encode() + (b"" if revisit else payload)
    name = uuid.UUID(hashlib.md5(f"{page_id}|{digest}|{copy}".encode()).hexdigest())
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {date}",
        None if url is None else "WARC-Target-URI: " + url.replace("\r", " ").replace("\n", " "),
        f"WARC-Payload-Digest: sha256:{digest}",
        None if page_id is None else f"X-Page-Id: {page_id}",
        None if refers_to is None else f"X-Refers-To-Page: {refers_to}",
        "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return LINE.join(x for x in lines if x is not None).encode("utf-8", "surrogatepass") + END.encode() + block


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row of pages (page_id, url, html) to gzipped archives below path."""
    by_batches(pages.sparkSession)
    rows = _keyed(pages)
    # Decisions go with the pages' own rows, before them, so that one shuffle serves both and no side is broadcast.
    both = rows.select("k", F.lit(1).alias("place"), F.col("page_id").cast("string"), "url", F.col("payload").cast("binary"), "digest", "bytes", F.lit(None).cast("string").alias("low"), F.lit(False).alias("own"))
    marks = decisions(rows).select("k", F.lit(0), *[F.lit(None).cast(t) for t in ("string", "string", "binary", "string", "long")], F.col("low").cast("string"), "own").toDF(*both.columns)

    def records(batches):
        last, mark, copy = None, None, 0
        for batch in batches:
            out = []
            for k, place, page_id, url, payload, digest, size, low, own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != last:
                    last, mark, copy = k, None, 0
                if place == 0:
                    mark = low, own
                    continue
                copy += 1
                revisit = mark is not None and not (mark[1] and copy == 1)
                out.append(gzipped(_record(date, page_id, url, payload, digest, size, copy, revisit, mark[0] if revisit else None))[: -len(LAST)])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    dealt = both.unionByName(marks).repartition("k").sortWithinPartitions("k", "place", F.col("url").asc_nulls_last())
    dealt.mapInArrow(records, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", LAST).text(path)


def _headers(data: bytes) -> tuple[dict[str, str], int]:
    """Headers at the start of data, and where they end."""
    end = data.index(END.encode())
    lines = [x.partition(b":") for x in data[:end].split(LINE.encode())]
    return {name.decode().strip().lower(): value.decode("utf-8", "surrogatepass").strip() for name, _, value in lines}, end + len(END)


def opened(path: str):
    """An archive for reads at any place, or None where pyarrow knows no file system for it."""
    scheme, _, rest = path.partition("://")
    try:
        fs, inner = pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + "://" + rest)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return None
    except OSError:
        if scheme in ("", "file"):
            raise
        return None  # the scheme is known, but its library is not there
    return fs.open_input_file(inner)


def _members(chunks):
    """(offset, length, content) of the records of an archive: a member of 16 MB or more and the empty one after it are one."""
    at = begin = 0
    packer, parts = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            parts.append(packer.decompress(chunk))
            rest = packer.unused_data
            at += len(chunk) - len(rest)
            if not packer.eof:
                break
            content, chunk, packer = b"".join(parts), rest, zlib.decompressobj(31)
            if sum(map(len, parts)) < 1 << 24 or not parts[-1]:
                yield begin, at - begin, content
                begin, parts = at, []
            else:
                parts = [content, b""]


def _indexed(batches):
    for batch in batches:
        contents = batch.column(1) if batch.num_columns > 1 else None
        for i, path in enumerate(batch.column(0).to_pylist()):
            file = opened(path) if contents is None else pa.BufferReader(contents[i].as_buffer())
            rows = []
            with file:
                for offset, length, content in _members(iter(lambda: file.read(1 << 20), b"")):
                    head, body = _headers(content)
                    http, _ = _headers(content[body:])
                    rows.append((path, offset, length, head["warc-type"], head.get("x-page-id"), head.get("warc-target-uri"), head["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"]), head.get("x-refers-to-page")))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            names = [x.split()[0] for x in INDEX.split(", ")]
            table = pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            yield from table.to_batches(10_000)


def index(spark, path: str) -> DataFrame:
    """The index of the archives below path, written to the shared folder: one row per record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    paths = files.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    if (first := paths.head()) and opened(first["path"]) is None:
        return settled(files.select("path", "content").mapInArrow(_indexed, INDEX), "warc-index")
    paths = paths.repartition(max(1, paths.count()))  # an archive per task
    return settled(paths.mapInArrow(_indexed, INDEX), "warc-index")


def _ranges(rows: list[tuple[int, int]]):
    """(first row, end row) of runs of sorted (offset, length) that one read takes."""
    first = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i][0] > sum(rows[i - 1]) + MOST_GAP or sum(rows[i]) - rows[first][0] > MOST_SPAN:
            yield first, i
            first = i


FOUND = "record_type string, page_id string, url string, payload_digest string, payload_bytes long, refers_to string, payload binary, found_digest string"


def _read(batches, content: bytes | None = None):
    """Records of index rows that come sorted by path and offset; content, if given, is the one archive that they are in."""
    file = at = None
    for batch in batches:
        table = batch.to_pydict()
        paths, places = table["path"], list(zip(table["offset"], table["length"], strict=True))
        payloads = []
        starts = [i for i in range(len(paths)) if i == 0 or paths[i] != paths[i - 1]] + [len(paths)]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if paths[a] != at:
                if file:
                    file.close()
                file = opened(paths[a]) if content is None else pa.BufferReader(content)
                at = paths[a]
            for i, j in _ranges(places[a:b]):
                low = places[a + i][0]
                data = file.read_at(sum(places[a + j - 1]) - low, low)
                for offset, length in places[a + i : a + j]:
                    record = next(_members([data[offset - low : offset - low + length]]))[2]
                    _, body = _headers(record)
                    _, inner = _headers(record[body:])
                    payloads.append(record[body + inner :])
        full = [t == "response" for t in table["record_type"]]
        found = [hashlib.sha256(p).hexdigest() if f else None for p, f in zip(payloads, full, strict=True)]
        names = ["record_type", "page_id", "url", "payload_digest", "payload_bytes", "refers_to"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array([p if f else None for p, f in zip(payloads, full, strict=True)], pa.binary()), pa.array(found, pa.string())], [*names, "payload", "found_digest"])
    if file:
        file.close()


def _read_whole(rows: pa.Table, files: pa.Table) -> pa.Table:
    """Records of one archive's index rows from its content, which stands once beside them."""
    kinds = [("record_type", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary()), ("found_digest", pa.string())]
    if not rows.num_rows:
        return pa.schema(kinds).empty_table()
    batches = rows.sort_by("offset").combine_chunks().to_batches()
    return pa.Table.from_batches(list(_read(batches, files.column("content")[0].as_buffer()))).cast(pa.schema(kinds))


def read(selected: DataFrame) -> DataFrame:
    """The records of the index rows selected, with payload (null for revisits) and the digest of what was read."""
    spark = selected.sparkSession
    first = selected.select("path").head()
    stretch = F.floor(F.col("offset") / ARCHIVE_BYTES)
    rows = selected.repartition("path", stretch).sortWithinPartitions("path", "offset")
    if first and opened(first["path"]) is None:
        folder = first["path"].rsplit("/", 1)[0]
        whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path", "content")
        # An archive is as large as one task should read, and goes to the task of its rows once.
        return selected.groupBy("path").cogroup(whole.groupBy("path")).applyInArrow(_read_whole, FOUND)
    return rows.mapInArrow(_read, FOUND)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder, index them, and read every record back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path)
    found = read(index(spark, path))
    kind = pages.schema["page_id"].dataType
    bytes_ = F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes"))
    return found.select(F.col("page_id").cast(kind).alias("page_id"), bytes_.alias("payload_bytes"), F.coalesce("found_digest", "payload_digest").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(load(spark, sf_dir, "pages"))


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS low FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.low IS NULL OR f.low = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.low <> d.page_id THEN f.low END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""
