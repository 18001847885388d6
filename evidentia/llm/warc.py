"""WARC archives: a deterministic sharded writer and its reader, as a data source of Spark.

Records are dealt to shards by ranges of the id and sorted within them, so that the archives one after
the other are in order. The bounds of the ranges come from a sample of the ids by hash, in proportion to
bytes: they follow from the rows alone, not from how the input is cut, and a second run gives the same
bytes. A shard's task streams its records: it regenerates every header and digest, compresses each
record as a gzip member of its own, and rolls to the next file when the compressed size passes a limit.

Files are written under temporary names of one attempt. Only what successful attempts report is renamed,
and the manifest, renamed last, makes the whole visible: readers follow the manifest and nothing else, so
a lost executor, a repeated attempt or a broken commit leaves no half archive in sight.

Equal payloads of at least ``LEAST`` bytes are kept once: the record of the smallest id is a response, the
others revisit it. Which ones do is decided on ids and digests; the decisions are sorted in among the
records, ahead of those that they are for, so that payloads are shuffled once.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .spark_io import BATCH_BYTES, cut_lineage

#: Payloads of fewer bytes are never revisited.
LEAST = 100
#: Bytes of payload a shard, most shards, and sampled ids a shard from which the bounds are taken.
SHARD_BYTES, MOST_SHARDS, SAMPLED = 16 << 20, 20_000, 40
#: Compressed bytes after which a file is closed.
ROLL_BYTES = 1 << 30
MANIFEST = "_manifest.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_IN = "shard int, page_id bigint, digest binary, kind int, url string, payload binary, first bigint"
_OUT = "page_id bigint, url string, record_type string, record_id string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, file string"


def _store(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI that executors share, as pyarrow reaches it (local or mounted, HDFS, object stores)."""
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else f"file://{path}")


# --- records --------------------------------------------------------------------------------------------


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def record_id(page_id: int | None, digest: str, n: int) -> str:
    """The n-th record of an id and payload: the same in every run, and computable from a record that revisits it."""
    return f"<urn:uuid:{uuid.UUID(_sha(f'{page_id}:{digest}:{n}'.encode())[:32])}>"


def _field(text: str) -> str:
    """A header's value on one line: controls and the escape itself as %XX."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", text)


def _unfield(text: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), text)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"WARC-Block-Digest: sha256:{_sha(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, n: int, date: str) -> bytes:
    """A response with its payload, or, with first, the id of the response that it revisits, the HTTP headers alone."""
    digest = _sha(payload)
    headers = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest, n)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", _field(url)))
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if first is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, digest, 0)), ("X-Refers-To-Page-ID", str(first))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(headers, http if first is not None else http + payload)


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream; a broken or cut record raises an error."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record here: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) != b"\r\n":
            if not line.endswith(b"\r\n"):
                raise ValueError("a record's header is cut")
            k, _, v = line[:-2].decode().partition(": ")
            headers[k] = v
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha256:{_sha(block)}":
            raise ValueError(f"record {headers.get('WARC-Record-ID')} is damaged")
        yield headers, block


# --- the data source -------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    """Of each file of a task: temporary name, last name, records, bytes, digest."""

    files: list[tuple[str, str, int, int, str]]


class _Roll:
    """Files of one task under temporary names; a file takes records until its compressed size passes the limit."""

    def __init__(self, store: arrow_fs.FileSystem, folder: str, limit: int, date: str):
        self.store, self.folder, self.limit, self.date = store, folder, limit, date
        self.shard, self.n, self.out, self.files = None, 0, None, []

    def add(self, shard: int, record: bytes) -> None:
        if shard != self.shard or self.size >= self.limit:
            self.close()
            self.n = self.n + 1 if shard == self.shard else 0
            self.shard, self.size, self.records, self.sum = shard, 0, 0, hashlib.sha256()
            self.name = f"records-{shard:06d}-{self.n:04d}.warc.gz"
            self.temporary = f"{self.folder}/{uuid.uuid4().hex}"
            self.out = self.store.open_output_stream(self.temporary, compression=None)
            about = f"software: evidentia\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
            self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(_sha(about)[:32])}>"), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], about))
        self._put(record)
        self.records += 1

    def _put(self, record: bytes) -> None:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without a time
        data = pack.compress(record) + pack.flush()
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.append((self.temporary, self.name, self.records, self.size, self.sum.hexdigest()))
            self.out = None


class Writer(DataSourceArrowWriter):
    """Takes rows of _IN, each task's sorted by shard, page_id, digest and kind; a row of kind 0 says what records of its id and digest revisit."""

    def __init__(self, options: dict[str, str]):
        self.path, self.limit, self.date = options["path"], int(options.get("roll", ROLL_BYTES)), options.get("date", "2024-01-01T00:00:00Z")
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        folder = f"{root}/{self.job}"
        store.create_dir(folder, recursive=True)
        roll, key, first, n = _Roll(store, folder, self.limit, self.date), None, None, 0
        for batch in iterator:
            shard, page, digest, kind, url, payload, to = (batch.column(c) for c in ("shard", "page_id", "digest", "kind", "url", "payload", "first"))
            for r in range(batch.num_rows):
                own = (page[r].as_py(), digest[r].as_py())
                if own != key:
                    key, first, n = own, None, 0
                if kind[r].as_py() == 0:
                    first = to[r].as_py()
                    continue
                roll.add(shard[r].as_py(), page_record(own[0], url[r].as_py(), payload[r].as_py() or b"", first, n, self.date))
                n += 1
        roll.close()
        return Written(roll.files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f[1])
        store.create_dir(f"{root}/{self.job}", recursive=True)
        for temporary, name, *_ in files:
            store.move(temporary, f"{root}/{name}")
        manifest = {"files": [{"name": name, "records": records, "bytes": size, "sha256": digest} for _, name, records, size, digest in files]}
        with store.open_output_stream(f"{root}/{self.job}/manifest", compression=None) as out:
            out.write(json.dumps(manifest, indent=1).encode())
        store.move(f"{root}/{self.job}/manifest", f"{root}/{MANIFEST}")
        store.delete_dir(f"{root}/{self.job}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        if store.get_file_info(f"{root}/{self.job}").type == arrow_fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")


class Reader(DataSourceReader):
    """A partition is a file of the manifest. Digests of blocks, payloads and the count of records are checked as they are read."""

    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], options.get("payload", "true") == "true"

    def partitions(self) -> Sequence[InputPartition]:
        store, root = _store(self.path)
        with store.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
            return [InputPartition((x["name"], x["records"])) for x in json.loads(f.read())["files"]] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        name, expected = partition.value
        store, root = _store(self.path)
        names = [c.split()[0] for c in _OUT.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        schema, rows, held, seen = pa.schema(list(zip(names, kinds, strict=True))), [], 0, 0
        with store.open_input_stream(f"{root}/{name}", compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw)) as stream:
            for headers, block in read_records(stream):
                if headers["WARC-Type"] == "warcinfo":
                    continue
                http, _, body = block.partition(b"\r\n\r\n")
                size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), headers["WARC-Payload-Digest"].removeprefix("sha256:")
                if headers["WARC-Type"] == "response" and (len(body) != size or _sha(body) != digest):
                    raise ValueError(f"the payload of {headers['WARC-Record-ID']} is damaged")
                own, to, url = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID"), headers.get("WARC-Target-URI")
                keep = self.payload and headers["WARC-Type"] == "response"
                rows.append((own and int(own), None if url is None else _unfield(url), headers["WARC-Type"], headers["WARC-Record-ID"], to and int(to), size, digest, body if keep else None, name))
                held, seen = held + 400 + len(body) * keep, seen + 1
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
                    rows, held = [], 0
        if seen != expected:
            raise ValueError(f"{name} holds {seen} records, its manifest says {expected}")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)


class WarcSource(DataSource):
    """format("warc"): options path, roll (compressed bytes a file), date (of all records), payload (false: without it)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _OUT

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


# --- the operator ------------------------------------------------------------------------------------------


@contextmanager
def _batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches bounded by bytes for the length of an action; the session's own setting is put back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shard_bounds(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """The first ids of all shards but the first one: those that cut a sample of the ids, by hash and in proportion to bytes, into even parts.

    The driver takes about SAMPLED ids a shard, and shards are MOST_SHARDS at most. sizes: (page_id, n).
    """
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).first()
    shards = min(MOST_SHARDS, -(-total.bytes // shard_bytes))
    if shards < 2:
        return []
    step = max(1, total.bytes // (SAMPLED * shards))  # an id of n bytes is taken with a chance of n / step and stands for step bytes
    taken = F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)).cast("double") * step < F.col("n").cast("double") * (1 << 20)
    some = sizes.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.sum("n").alias("n")).where(taken).select("page_id", F.greatest("n", F.lit(step)).alias("n")).orderBy("page_id").collect()
    if not some:
        return []
    done = np.cumsum([r.n for r in some])
    cuts = np.searchsorted(done, done[-1] * np.arange(1, shards) / shards, side="left")
    return sorted({some[int(c) + 1].page_id for c in cuts if c + 1 < len(some)})


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record a row in archives at path, which executors share and which holds no archives yet.

    Null html is an empty payload, null URLs have no header, other columns are ignored. Rows without an id
    come first, are responses where no other row has their payload, and revisit it otherwise. Rows that
    share the smallest id of a payload are all responses; repeated rows are records of their own, with
    ids of their own. A row's id is taken as unique enough to sort by: records of one id and payload are
    streamed by one task, in constant memory. No rows give a manifest without files.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    store, root = _store(path)
    if store.get_file_info(f"{root}/{MANIFEST}").type != arrow_fs.FileType.NotFound:
        raise FileExistsError(f"{path} holds archives already")
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.unhex(F.sha2(payload, 256)).alias("digest"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    sizes = cut_lineage(page.select("page_id", "digest", F.octet_length("payload").cast("long").alias("n")))
    bounds = shard_bounds(sizes, shard_bytes)
    long = sizes.where(F.col("n") >= LEAST)
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1 and first is not null").drop("rows")
    revisits = long.join(first, "digest").where("page_id is null or page_id > first").select("page_id", "digest", "first").distinct()
    records = page.select("page_id", "digest", F.lit(1).alias("kind"), "url", F.col("payload").cast("binary").alias("payload"), F.lit(None).cast("long").alias("first"))
    decided = revisits.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "first")
    every = records.unionByName(decided).withColumn("shard", _shard_of(bounds)(F.coalesce("page_id", F.lit(-(1 << 63)))) if bounds else F.lit(0))
    dealt = every.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "digest", "kind", F.asc_nulls_first("url"))
    with _batches(spark):
        dealt.select(*[c.split()[0] for c in _IN.split(", ")]).write.format("warc").option("roll", roll_bytes).option("date", date).mode("append").save(path)


def _shard_of(bounds: list[int]):
    """The number of bounds up to an id; none of the ids is null."""
    at = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def shard(page: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, page.to_numpy(), side="right").astype(np.int32))

    return shard


def read_archives(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """The records of all archives of a manifest: id, URL, type, what a revisit refers to, size and digest of the full payload, and the payload of responses."""
    spark.dataSource.register(WarcSource)
    df = spark.read.format("warc").option("payload", str(payload).lower()).load(path)
    return df if payload else df.drop("payload")
