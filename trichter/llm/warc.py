"""WARC archives: write pages, normalise monolithic gzip files to one member per record, read records back."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from trichter.llm.common import fresh_path, remove_path, written

_CHUNK = 1 << 20
_LEVEL = 6
_SALTS = 16

FILES = "path string, n_records long, n_bytes long"


def mark_revisits(pages: DataFrame, *, id_col: str = "page_id", min_bytes: int = 0) -> DataFrame:
    """``id, url, html, refers_to``: the page that a page repeats byte for byte, else null.

    Of equal payloads of at least ``min_bytes`` bytes the one with the smallest id is the original.
    Null html is an empty payload. Null ids come last: they repeat the smallest id that is not
    null, and where a group has none, none of its rows is a repetition. Rows that repeat the
    original's id together with its payload are originals too.

    The smallest id per digest is aggregated before the shuffle. Rows meet it under (digest,
    salt), the few digests that occur twice being copied to every salt, so that one hot payload
    is spread over several tasks.
    """
    rows = pages.select(
        pages[id_col].alias("page_id"),
        pages["url"].cast("string").alias("url"),
        F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    repeated = (
        rows.filter(F.octet_length("html") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select("digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(_SALTS)).cast("int"))
    return salted.join(repeated, ["digest", "salt"], "left").select(
        "page_id",
        "url",
        "html",
        F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"),
    )


def write_archives(
    marked: DataFrame, folder: str, *, date: str = "2000-01-01T00:00:00Z", file_bytes: int = 1 << 30
) -> DataFrame:
    """Write one WARC record per row of ``mark_revisits`` into monolithic gzip files below ``folder``.

    A file is one gzip stream over many records, as plain compressors write it; a task starts the
    next file after ``file_bytes`` bytes of records. Files carry the attempt in their names, so a
    repeated task never touches a file of another, and only files named in the returned table
    count. Returns their ``path``, ``n_records`` and ``n_bytes``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}" if task else f"{folder}/0-0"
        number = 0
        sink = None
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for row in batch.slice(start, 64).to_pylist():
                    if sink is None:
                        sink = MemberWriter(f"{name}-{number:04d}.warc.gz")
                    sink.write(_record(row, date, f"{name}:{number}:{sink.records}"))
                    if sink.size >= file_bytes:
                        yield _file_row(*sink.close())
                        sink, number = None, number + 1
        if sink is not None:
            yield _file_row(*sink.close())

    return written(marked.mapInArrow(run, FILES), "warc-files")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite every record of monolithic gzip WARC files as a gzip member of its own.

    Each file is inflated once, as a stream: a gzip stream cannot be entered in the middle, so one
    task takes one file, but never holds more than one record. Beside every rewritten archive a
    sidecar ``.cdxj`` file lists offset, length, record id and type of each member. Returns
    ``path`` (of the archive), ``n_records`` and ``n_bytes``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        attempt = task.taskAttemptId() if task else 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                stem = path.rsplit("/", 1)[1].removesuffix(".warc.gz")
                target = f"{folder}/{stem}-{attempt}.warc.gz"
                sink = MemberWriter(target)
                with _create(target + ".cdxj") as index:
                    for head, block, fields in records(inflated(path)):
                        offset = sink.end_member()
                        sink.write(head + block + b"\r\n\r\n")
                        length = sink.end_member() - offset
                        entry = {
                            "offset": offset,
                            "length": length,
                            "id": fields.get("warc-record-id"),
                            "type": fields.get("warc-type"),
                            "url": fields.get("warc-target-uri"),
                        }
                        index.write((json.dumps(entry) + "\n").encode())
                yield _file_row(*sink.close())

    return written(_one_task_each(files).mapInArrow(run, FILES), "warc-records")


def read_records(files: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row per record of archives made by ``normalise``, found through their sidecar index.

    ``page_id, url, record_type, refers_to, payload_bytes, payload_digest`` and ``html``. For a
    response, length and digest are taken from the payload read; a revisit holds no payload and
    names those of the response in its headers, and its ``html`` is null.
    """
    schema = StructType(
        [
            StructField("page_id", StringType()),
            StructField("url", StringType()),
            StructField("record_type", StringType()),
            StructField("refers_to", StringType()),
            StructField("payload_bytes", LongType()),
            StructField("payload_digest", StringType()),
            StructField("html", StringType()),
        ]
    )
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _open(path) as data:
                    for entry in _lines(path + ".cdxj"):
                        place = json.loads(entry)
                        data.seek(place["offset"])
                        member = zlib.decompress(data.read(place["length"]), 31)
                        rows.append(_parsed(member))
                        held += len(member)
                        if held > 8 * _CHUNK or len(rows) == 1000:
                            yield batch_of(rows)
                            rows, held = [], 0
        if rows:
            yield batch_of(rows)

    found = _one_task_each(files).mapInArrow(run, schema)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive_pages(pages: DataFrame, *, id_col: str = "page_id", min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (id, ``url``, ``html``) as WARC archives in the shared folder, normalise them and read them back.

    Returns the rows of ``read_records``, the ids with their own type. Other columns are ignored,
    and an empty table gives no rows. Record ids come from page ids: rows that repeat a page id
    write records of the same id, rows without one get a generated id.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    whole = write_archives(mark_revisits(pages, id_col=id_col, min_bytes=min_bytes), f"{folder}/whole")
    records_of = normalise(whole, f"{folder}/records")
    remove_path(spark, f"{folder}/whole")
    return read_records(records_of, pages.schema[id_col].dataType.simpleString())


def _one_task_each(files: DataFrame) -> DataFrame:
    count = max(1, files.count())
    return files.select("path").repartitionByRange(count, "path")


def _file_row(path: str, n_records: int, n_bytes: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([path]), pa.array([n_records], pa.int64()), pa.array([n_bytes], pa.int64())],
        ["path", "n_records", "n_bytes"],
    )


# Files: any file system that has a URI, and plain paths.


def _create(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner, compression=None)


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _lines(path: str) -> Iterator[bytes]:
    rest = b""
    with _open(path) as source:
        while chunk := source.read(_CHUNK):
            *whole, rest = (rest + chunk).split(b"\n")
            yield from whole


class MemberWriter:
    """A gzip file; ``end_member`` closes the current member and says where the next one starts."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.records = 0
        self.size = 0
        self._file = _create(path)
        self._offset = 0
        self._gzip = None

    def write(self, record: bytes) -> None:
        if self._gzip is None:
            self._gzip = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
        self._put(self._gzip.compress(record))
        self.records += 1
        self.size += len(record)

    def end_member(self) -> int:
        if self._gzip is not None:
            self._put(self._gzip.flush())
            self._gzip = None
        return self._offset

    def close(self) -> tuple[str, int, int]:
        self.end_member()
        self._file.close()
        return self.path, self.records, self._offset

    def _put(self, data: bytes) -> None:
        if data:
            self._file.write(data)
            self._offset += len(data)


def inflated(path: str) -> Iterator[bytes]:
    """The bytes of a gzip file in bounded chunks, over all of its members."""
    with _open(path) as source:
        stream = zlib.decompressobj(31)
        data = source.read(_CHUNK)
        while data:
            yield stream.decompress(data, _CHUNK)
            data = stream.unconsumed_tail
            if stream.eof:
                data, stream = stream.unused_data, zlib.decompressobj(31)
            if not data:
                data = source.read(_CHUNK)
        yield stream.flush()


def records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes, dict[str, str]]]:
    """Head, block and header fields of every WARC record in a stream of bytes."""
    held = bytearray()
    chunks = iter(chunks)

    def more() -> bool:
        chunk = next(chunks, None)
        if chunk is None:
            return False
        held.extend(chunk)
        return True

    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                if held.strip():
                    raise ValueError("the archive ends inside a record head")
                return
            while held[:2] == b"\r\n":
                del held[:2]
                seen = 0
        head = bytes(held[: end + 4])
        fields = _fields(head)
        whole = end + 4 + int(fields["content-length"])
        while len(held) < whole:
            if not more():
                raise ValueError("the archive ends inside a record")
        block = bytes(held[end + 4 : whole])
        del held[:whole]
        yield head, block, fields


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {name.decode().strip().lower(): value.decode().strip() for name, _, value in pairs if name}


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), text)


def _page(page_id: object) -> str:
    return f"<urn:page:{quote(str(page_id), safe='')}>"


def _record(row: dict, date: str, place: str) -> bytes:
    payload = row["html"].encode("utf-8", "surrogatepass")
    revisit = row["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    known = row["page_id"] is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_page(row['page_id']) if known else f'<{uuid.uuid5(uuid.NAMESPACE_URL, place).urn}>'}",
        f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_uri(row['url'])}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {_page(row['refers_to'])}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parsed(member: bytes) -> tuple:
    from urllib.parse import unquote

    def page(value: str | None) -> str | None:
        found = re.fullmatch(r"<urn:page:(.*)>", value or "")
        return unquote(found[1]) if found else None

    head, block, fields = next(records(iter([member])))
    http, _, payload = block.partition(b"\r\n\r\n")
    common = (page(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"])
    if fields["warc-type"] == "revisit":
        length = int(_fields(http + b"\r\n")["content-length"])
        return (*common, page(fields["warc-refers-to"]), length, fields["warc-payload-digest"].removeprefix("sha1:"), None)
    return (*common, None, len(payload), payload_digest(payload), payload.decode("utf-8", "surrogatepass"))
