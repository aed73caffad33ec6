"""WARC records in ZIP-packaged archives: a writer for page tables, and a reader by byte ranges.

An archive is a ZIP file with two stored (uncompressed) members: archive/data.warc.gz, one gzip member
for each record, and indexes/index.cdxj, one line for each record with its offset and length in the
former.  The reader parses the ZIP's directory itself (ZIP64 forms too), reads the index by a range and
then each record by a range; nothing is extracted and no archive is read whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelframe.llm.common import map_batches, shared_folder, written

# Member names, record fields and signatures of the formats.
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, END64_PLACE, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
# An archive is closed when it has so many bytes.
ARCHIVE_BYTES = 256 << 20

RECORD = T.StructType(
    [T.StructField(n, k) for n, k in (("archive", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()), ("record_type", T.StringType()), ("page_id", T.StringType()), ("url", T.StringType()), ("refers_to", T.StringType()), ("payload_digest", T.StringType()), ("payload_bytes", T.LongType()), ("payload", T.BinaryType()), ("intact", T.BooleanType()))]
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _store(path: str):
    """The Arrow file system and path of a URI (local, HDFS or object store)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else "file://" + path)


# Writing


def classify(pages: DataFrame, id_col: str, least_bytes: int) -> DataFrame:
    """(id, digest, first): first is the smallest id with an equal payload of at least least_bytes."""
    payload = F.coalesce(F.col("_html"), F.lit("")).cast("binary")
    narrow = written(pages.select("_id", F.sha1(payload).alias("_sha1"), F.length(payload).alias("_bytes")), "warc-digests")
    # Counts and minima are combined before the shuffle, so a payload of many pages is a few rows there.
    groups = narrow.where(F.col("_bytes") >= least_bytes).groupBy("_sha1").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return written(groups.where("_n > 1").select("_sha1", "_first"), "warc-first")


def record(page_id: str, url: str | None, payload: bytes, mark: str, first: str | None, date: str) -> bytes:
    """One WARC record, as a gzip member. first: the id of the response that this record revisits."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{mark}/{i}')}>"
    target = urllib.parse.quote(url or f"urn:page:{page_id}", safe="%/:=&?~#+!$,;'@()*[]")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    fields = {"WARC-Type": "response" if first is None else "revisit", "WARC-Record-ID": name(page_id), "WARC-Target-URI": target, "WARC-Date": date, "WARC-Payload-Digest": f"sha1:{mark}", "Page-Id": urllib.parse.quote(page_id)}
    if first is not None:
        fields |= {"WARC-Profile": REVISIT, "WARC-Refers-To": name(first), "Refers-To-Page-Id": urllib.parse.quote(first)}
    fields |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(head.encode() + block + b"\r\n\r\n") + packed.flush()


class ArchiveWriter:
    """Writes records to one archive under a temporary name; close() gives it its final name."""

    def __init__(self, path: str):
        self.fs, self.path = _store(path)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.stream = self.fs.open_output_stream(self.temporary)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, packed: bytes, page_id: str, mark: str) -> None:
        self.data.write(packed)
        self.lines.append(json.dumps({"id": page_id, "digest": mark, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> None:
        self.data.close()
        with self.zip.open(INDEX, "w") as f:
            f.write("".join(x + "\n" for x in self.lines).encode())
        self.zip.close()
        self.stream.close()
        self.fs.move(self.temporary, self.path)


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a WARC record for every row; returns (archive, records, bytes) of the archives written.

    Of the rows with equal payloads of at least least_bytes, those with the smallest id become responses
    and the others revisits of it; smaller payloads are all responses.  A null html is an empty payload;
    a null url gets a urn of the page; a null id is written as the empty id and never revisits; repeated
    rows each give a record; an empty table gives no archive; other columns are not read.
    folder is a URI that all executors share (default: a new folder in spark.checkpoint.dir).  An archive
    gets its name only when it is whole, and a task that runs again writes the same names anew.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").cast("string").alias("_url"), F.col(f"`{html_col}`").cast("string").alias("_html"))
    first = classify(rows, id_col, least_bytes)
    payload = F.coalesce(F.col("_html"), F.lit("")).cast("binary")
    marked = rows.withColumn("_sha1", F.when(F.length(payload) >= least_bytes, F.sha1(payload))).join(first, "_sha1", "left")
    revisits = F.col("_id").isNotNull() & (F.col("_id") != F.col("_first"))
    columns = marked.select(F.col("_id").cast("string"), "_url", payload.alias("_payload"), F.when(revisits, F.col("_first").cast("string")).alias("_of"))

    def write(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, out = [], None
        fs, base = _store(folder)
        fs.create_dir(base, recursive=True)

        def done():
            out.close()
            return out.name, len(out.lines), out.at

        for batch in source:
            for page_id, url, body, of in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{len(made):04d}.wacz"
                    out = ArchiveWriter(name)
                    out.name = name
                mark = digest(body)
                out.add(record(page_id or "", url, body, mark, of, date), page_id or "", mark)
                if out.at >= archive_bytes:
                    made.append(done())
                    out = None
        if out is not None:
            made.append(done())
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], names=["archive", "records", "bytes"])

    return written(map_batches(columns, write, "archive string, records long, bytes long"), "warc-archives")


# Reading


def members(source, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (offset of its bytes, stored size, compression method), from a ZIP's own directory.

    The end record is sought in the last 64 KiB; where its fields are all ones the ZIP64 end record
    holds them, and where an entry's fields are all ones its ZIP64 extra field does.
    """

    def at(start: int, n: int) -> bytes:
        source.seek(start)
        return source.read(n)

    tail_at = max(0, size - 65557)
    tail = at(tail_at, size - tail_at)
    k = tail.rfind(END)
    if k < 0:
        raise ValueError("not a ZIP file: it has no end record")
    count, length, start = struct.unpack_from("<HII", tail, k + 10)
    place = tail_at + k - 20
    if place >= 0 and (locator := at(place, 20))[:4] == END64_PLACE:
        end64 = at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != END64:
            raise ValueError("the ZIP64 end record is not where its locator says")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    table, found, p = at(start, length), {}, 0
    for _ in range(count):
        if table[p : p + 4] != ENTRY:
            raise ValueError("the ZIP directory is broken")
        method = struct.unpack_from("<H", table, p + 10)[0]
        packed, plain, names, extras, comment = struct.unpack_from("<IIHHH", table, p + 20)
        header = struct.unpack_from("<I", table, p + 42)[0]
        name = table[p + 46 : p + 46 + names].decode("utf-8", "replace")
        extra, q = table[p + 46 + names : p + 46 + names + extras], 0
        while q + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, q)
            if tag == 1:  # ZIP64: 8 bytes for each field of all ones, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                plain, packed, header = (next(wide, v) if v == 0xFFFFFFFF else v for v in (plain, packed, header))
            q += 4 + n
        local = at(header, 30)
        if local[:4] != LOCAL:
            raise ValueError(f"member {name} is not where the directory says")
        found[name] = header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed, method
        p += 46 + names + extras + comment
    return found


def locate(archives: DataFrame) -> DataFrame:
    """(archive, offset, length, id, digest) of every record that the archives' indexes list; offset counts from the file's start."""

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for path in batch.column(0).to_pylist():
                fs, p = _store(path)
                with fs.open_input_file(p) as f:
                    have = members(f, f.size())
                    for name in (DATA, INDEX):
                        if have[name][2]:
                            raise ValueError(f"{path}: member {name} is compressed, so it can't be read by ranges")
                    f.seek(have[INDEX][0])
                    lines = [json.loads(x) for x in f.read(have[INDEX][1]).splitlines()]
                for k in range(0, len(lines), 10_000):
                    part = lines[k : k + 10_000]
                    yield pa.RecordBatch.from_pydict({"archive": [path] * len(part), "offset": [have[DATA][0] + x["offset"] for x in part], "length": [x["length"] for x in part], "id": [x["id"] for x in part], "digest": [x["digest"] for x in part]})

    return map_batches(archives.select("archive"), read, "archive string, offset long, length long, id string, digest string")


def parse_record(packed: bytes) -> dict:
    """The fields of one gzip-compressed record."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, body = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    sizes = [x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")]
    kind, mark = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    unquote = urllib.parse.unquote
    whole = kind == "response"
    return {
        "record_type": kind, "page_id": unquote(fields["Page-Id"]), "url": fields["WARC-Target-URI"], "refers_to": unquote(fields["Refers-To-Page-Id"]) if "Refers-To-Page-Id" in fields else None,
        "payload_digest": mark, "payload_bytes": len(body) if whole else int(sizes[0].split(":")[1]), "payload": body if whole else None, "intact": not whole or digest(body) == mark,
    }


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives (a table with their URIs in column archive), read by byte ranges.

    Columns: see RECORD; payload is null for revisits, or without payloads; intact tells whether a response's bytes have the digest
    that its header names.  Records are dealt over tasks by place in their archive, so one large archive
    is read by many tasks; each task opens an archive once and reads in order of offset.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(RECORD)
    places = locate(archives).select("archive", "offset", "length")
    # Neighbours in an archive stay together: a stretch of 4 MiB goes to one task.
    dealt = places.repartition("archive", F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("archive", "offset")

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in source:
            rows, held = [], 0
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if path != name:
                    if f is not None:
                        f.close()
                    fs, p = _store(path)
                    name, f = path, fs.open_input_file(p)
                f.seek(offset)
                x = parse_record(f.read(length))
                if not payloads:
                    x["payload"] = None
                rows.append({"archive": path, "offset": offset, "length": length} | x)
                held += len(x["payload"] or b"")
                if held > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        if f is not None:
            f.close()

    return map_batches(dealt, read, RECORD)


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder, listed by Spark."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wacz").load(folder).select(F.col("path").alias("archive"))
