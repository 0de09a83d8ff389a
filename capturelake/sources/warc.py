"""A Python data source for WARC files: ``spark.read.format("warc")`` and ``df.write.format("warc")``."""

from __future__ import annotations

import fnmatch
import gzip
import io
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "url string, timestamp string, status_code int, http_headers map<string,string>, body binary, warc_file string, warc_offset bigint"


def split_response(block: bytes) -> tuple[int, dict[str, str], bytes]:
    """Status, headers and body of an HTTP response; a block without a head is a body, with status 200."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"HTTP/"):
        return 200, {}, block
    lines = head.decode("utf-8", "replace").split("\r\n")
    parts = lines[0].split(None, 2)
    status = int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else 200
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            headers[name.strip()] = value.strip()
    return status, headers, body


def slice_body(data: bytes) -> str:
    """Body text of a stored slice: record head, HTTP head, body; gzip if it is, and whatever parts there are."""
    try:
        data = gzip.decompress(data)
    except (OSError, EOFError):
        pass
    return data.split(b"\r\n\r\n", 2)[-1].decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def slice_text(data: pd.Series) -> pd.Series:
    """Body texts of stored slices, as ``slice_body`` reads them; NULL for NULL."""
    return data.map(lambda b: None if b is None else slice_body(bytes(b)))


def records(stream, start: int = 0) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of a stream; a broken end is ignored."""
    offset = start
    while True:
        line = stream.readline()
        if not line:
            return
        at = offset
        offset += len(line)
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            return
        headers: dict[str, str] = {}
        while line := stream.readline():
            offset += len(line)
            if not line.strip():
                break
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        try:
            size = int(headers.get("content-length", ""))
        except ValueError:
            return
        block = stream.read(size)
        offset += len(block)
        if len(block) < size:
            return
        yield at, headers, block


def compact_time(text: str) -> str:
    return text.translate(str.maketrans("", "", "-:TZ"))[:14]


def file_system(path: str):
    """(file system, path on it) of a folder or file name: any that pyarrow knows, as HDFS, S3 or a mounted folder."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    """Each file is a partition: records of a compressed file can only be read in order."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from pyarrow import fs

        system, path = file_system(self.path)
        folder, name = (posixpath.dirname(path), posixpath.basename(path)) if "*" in posixpath.basename(path) else (path, "*")
        if system.get_file_info(folder).type == fs.FileType.File:
            return [_File(folder)]
        found = sorted(i.path for i in system.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File)
        return [_File(p) for p in found if fnmatch.fnmatch(posixpath.basename(p), name) and not posixpath.basename(p).startswith(("_", "."))] or [_File("")]

    def read(self, partition):
        if not partition.path:
            return
        system, _ = file_system(self.path)
        with system.open_input_file(partition.path) as probe:
            packed = probe.read(2) == b"\x1f\x8b"
        with system.open_input_file(partition.path) as raw, (gzip.open(raw) if packed else io.BufferedReader(raw)) as f:
            for offset, headers, block in records(f):
                if headers.get("warc-type") != "response":
                    continue
                status, http, body = split_response(block)
                yield (headers.get("warc-target-uri", "").strip("<>"), compact_time(headers.get("warc-date", "")), status, http, body, posixpath.basename(partition.path), offset)


@dataclass
class _Written(WriterCommitMessage):
    path: str
    records: int


class _Writer(DataSourceWriter):
    """One compressed file per task, a member per record; rows without a body are skipped. Files get their names when all are written."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def write(self, rows):
        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        name = posixpath.join(path, f"_{uuid.uuid4().hex}")
        n = 0
        with system.open_output_stream(name, compression=None) as f:
            for row in rows:
                r = dict(zip(self.names, row))
                if r.get("body") is None:
                    continue
                n += 1
                f.write(gzip.compress(response_record(r["url"], r.get("timestamp") or "", r.get("status_code") or 200, r.get("http_headers") or {}, bytes(r["body"]))))
        return _Written(name, n)

    def commit(self, messages):
        system, path = file_system(self.path)
        for k, m in enumerate(x for x in messages if x is not None):
            if m.records:
                system.move(m.path, posixpath.join(path, f"part-{k:05d}.warc.gz"))
            else:
                system.delete_file(m.path)

    def abort(self, messages):
        from pyarrow import fs

        system, _ = file_system(self.path)
        for m in messages:
            if m is not None and system.get_file_info(m.path).type == fs.FileType.File:
                system.delete_file(m.path)


def response_record(url: str, timestamp: str, status: int, headers: dict[str, str], body: bytes) -> bytes:
    """A response record; its date is that of the capture."""
    t = timestamp.ljust(14, "0")
    date = f"{t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:14]}Z"
    http = f"HTTP/1.1 {status} OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in sorted(headers.items())) + "\r\n"
    block = http.encode() + body
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, url + timestamp)}>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
