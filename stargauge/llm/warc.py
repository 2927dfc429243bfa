"""Sharded WARC archives: written in a fixed order, committed through a manifest, read back."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stargauge.llm.common import bounded_sample, small_batches
from stargauge.sources.scratch import scratch_path
from stargauge.sources.staging import stage

REVISIT_BYTES = 1000
SHARD_BYTES = 32 * 1024 * 1024
ROLL_BYTES = 8 * 1024 * 1024
MAX_SHARDS = 20_000
BOUNDARY_ROWS = 200_000
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
READ_BYTES = 1 << 20

VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

MANIFEST = "shard int, file int, name string, temporary string, records bigint, bytes bigint"
RECORDS = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint, target_uri string, file string"
)


# ---- which records revisit others ---------------------------------------------------------


def revisits(pages: DataFrame, key: str, payload: str, least: int = REVISIT_BYTES) -> DataFrame:
    """Key, digest and the key of the response, for every page that repeats a payload of at least
    ``least`` bytes. Of equal payloads the greatest key is the response; where none of the pages
    has a key, all are responses, as there is no key to refer to. Digests are counted before the
    shuffle; the join back starts from two staged tables, so that a digest with a third of all
    pages is split at run time."""
    bytes_ = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    keys = stage(
        pages.select(F.col(key).alias("page_id"), F.sha1(bytes_).alias("digest"),
                     F.octet_length(bytes_).alias("size"))
        .where(F.col("size") >= least)
        .drop("size"),
        "warc-digests",
    )
    groups = keys.groupBy("digest").agg(
        F.max("page_id").alias("refers_to"), F.count("*").alias("copies")
    )
    groups = stage(groups.where("copies > 1 AND refers_to IS NOT NULL").drop("copies"), "warc-copies")
    return keys.join(groups, "digest").where("page_id IS NULL OR page_id <> refers_to").distinct()


# ---- order and shards ---------------------------------------------------------------------


def shard_bounds(pages: DataFrame, key: str, payload: str, shard_bytes: int) -> list[int]:
    """Keys at which shards begin. They depend on the data alone: a hash picks at most about
    ``BOUNDARY_ROWS`` keys, with the bytes they stand for. This decides sizes, not contents."""
    size = F.coalesce(F.octet_length(payload), F.lit(0)).cast("bigint")
    sized = pages.where(F.col(key).isNotNull()).select(F.col(key).alias("page_id"), size.alias("size"))
    totals = sized.agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).first()
    if not totals["rows"]:
        return []
    sample = bounded_sample(sized, F.col("page_id"), totals["rows"], BOUNDARY_ROWS)
    frame = sample.groupBy("page_id").agg(F.sum("size").alias("size")).toPandas()
    if frame.empty:
        return []
    frame = frame.sort_values("page_id")
    step = max(shard_bytes, totals["bytes"] / MAX_SHARDS)
    shards = int(max(1, round(totals["bytes"] / step)))
    reached = np.cumsum(frame["size"].to_numpy() + 1.0)
    goals = reached[-1] * np.arange(1, shards) / shards
    places = np.searchsorted(reached, goals)
    return sorted(set(frame["page_id"].to_numpy()[places].tolist()))


# ---- records ------------------------------------------------------------------------------


def _digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(raw).decode()


def _record_id(key: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{key} {digest.hex()}')}>"


def _uri(url: str | None, key: int | None) -> str:
    """The address with everything escaped that could end or split a header line."""
    return quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else f"urn:page:{key}"


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None,
           revisit: bool) -> bytes:
    """One WARC record; headers and digests are made from the payload, never copied."""
    sha1 = hashlib.sha1(payload).digest()
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(key, sha1)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url, key)),
        ("WARC-Payload-Digest", _digest(sha1)),
        ("WARC-Block-Digest", _digest(hashlib.sha1(block).digest())),
        ("X-Page-Id", "" if key is None else str(key)),
    ]
    if revisit:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, sha1)),
                  ("X-Refers-To-Page-Id", str(refers_to))]
    lines += [("Content-Type", "application/http; msgtype=response"),
              ("Content-Length", str(len(block)))]
    head = "".join(f"{name}: {value}\r\n" for name, value in lines).encode()
    return VERSION + head + b"\r\n" + block + b"\r\n\r\n"


def _file_info(shard: int, file: int) -> bytes:
    body = b"software: stargauge\r\nformat: WARC File Format 1.1\r\n"
    head = (
        f"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMES, f'{shard}/{file}')}>\r\n"
        f"WARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\n"
        f"Content-Length: {len(body)}\r\n"
    ).encode()
    return VERSION + head + b"\r\n" + body + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member without a time stamp, so that equal records give equal bytes."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# ---- writing ------------------------------------------------------------------------------


class _Files:
    """Archives of one task attempt under names of their own, rolled by compressed size."""

    def __init__(self, root: str, attempt: str, roll: int) -> None:
        self.store, self.root = fs.FileSystem.from_uri(root)
        self.attempt, self.roll = attempt, roll
        self.sink = None
        self.shard = self.file = -1
        self.done: list[dict] = []

    def add(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.file = shard, -1
        if self.sink is None:
            self._open()
        member = _member(data)
        self.sink.write(member)
        self.bytes += len(member)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def _open(self) -> None:
        self.file += 1
        self.temporary = f"_temporary/{self.attempt}/{self.shard:06d}-{self.file:05d}.part"
        path = f"{self.root}/{self.temporary}"
        self.store.create_dir(path.rpartition("/")[0], recursive=True)
        self.sink = self.store.open_output_stream(path, compression=None)
        first = _member(_file_info(self.shard, self.file))
        self.sink.write(first)
        self.bytes, self.records = len(first), 0

    def close(self) -> None:
        if self.sink is None:
            return
        self.sink.close()
        self.sink = None
        self.done.append(
            {"shard": self.shard, "file": self.file,
             "name": f"{self.shard:06d}-{self.file:05d}.warc.gz", "temporary": self.temporary,
             "records": self.records, "bytes": self.bytes}
        )


_MANIFEST_TYPES = pa.schema(
    [("shard", pa.int32()), ("file", pa.int32()), ("name", pa.string()),
     ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]
)


def _writer(root: str, roll: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files = _Files(root, f"{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}", roll)
        # Decisions sort before the pages they are about.
        decided: tuple | None = None
        for batch in batches:
            for row in batch.to_pylist():
                about = (row["shard"], row["page_id"], row["digest"])
                if row["kind"] == 0:
                    decided = (about, row["refers_to"])
                    continue
                payload = (row["payload"] or "").encode("utf-8", "surrogatepass")
                same = decided is not None and decided[0] == about
                made = record(row["page_id"], row["url"], payload,
                              decided[1] if same else None, same)
                files.add(row["shard"], made)
        files.close()
        if files.done:
            yield pa.RecordBatch.from_pylist(files.done, schema=_MANIFEST_TYPES)

    return write


def _commit(root: str):
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                final = f"{base}/{row['name']}"
                # A repeated attempt finds the file in place.
                if store.get_file_info(final).size != row["bytes"]:
                    store.move(f"{base}/{row['temporary']}", final)
            yield batch

    return move


def write_archives(
    pages: DataFrame,
    root: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Write one record per page below ``root``; returns the manifest.

    Pages are sorted by key and payload digest. Shards are ranges of keys that depend on the data
    alone, and within a shard files are rolled once their compressed size passes ``roll_bytes``,
    so the same pages give the same files on any cluster. A task attempt writes under a name of
    its own; the manifest, written by Spark, names the attempts that counted, and only those files
    are then moved to their final names. Readers go by the manifest.

    A null payload counts as empty, a null url is written as ``urn:page:<key>``, null keys come
    first. Rows that repeat key and payload are all written: if another key has the payload too,
    as revisits or responses alike. Payloads go through one shuffle, whole. Other columns are not
    read. No rows give an empty manifest.
    """
    spark = pages.sparkSession
    bounds = np.array(shard_bounds(pages, key, payload, shard_bytes), np.int64)

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, keys.fillna(np.iinfo(np.int64).min).astype("int64"), "right")
        return pd.Series(at.astype(np.int32))

    bytes_ = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(key).alias("page_id"),
        F.sha1(bytes_).alias("digest"),
        F.lit(1).alias("kind"),
        F.lit(None).cast("bigint").alias("refers_to"),
        F.col(url).alias("url"),
        F.col(payload).alias("payload"),
    )
    decisions = revisits(pages, key, payload).select(
        "page_id",
        "digest",
        F.lit(0).alias("kind"),
        "refers_to",
        F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("payload"),
    )
    placed = rows.unionByName(decisions).withColumn("shard", shard_of("page_id"))
    # One task per shard.
    dealt = placed.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(
        "shard", "page_id", "digest", "kind"
    )
    written = small_batches(dealt).mapInArrow(_writer(root, roll_bytes), MANIFEST)
    written.write.parquet(f"{root}/_pending", mode="error")
    pending = spark.read.schema(MANIFEST).parquet(f"{root}/_pending")
    pending.mapInArrow(_commit(root), MANIFEST).write.parquet(f"{root}/_manifest", mode="error")
    store, base = fs.FileSystem.from_uri(root)
    for leftover in ("_temporary", "_pending"):
        if store.get_file_info(f"{base}/{leftover}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{leftover}")
    return spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")


# ---- reading ------------------------------------------------------------------------------


class _Stream:
    """Records of a file of gzip members, a bounded part of it in memory at a time."""

    def __init__(self, source) -> None:
        self.source = source
        self.unpacker = zlib.decompressobj(31)
        self.buffer = bytearray()
        self.at = 0

    def _more(self) -> bool:
        data = self.unpacker.unused_data if self.unpacker.eof else b""
        if self.unpacker.eof:
            self.unpacker = zlib.decompressobj(31)
        data = data or self.source.read(READ_BYTES)
        if not data:
            return False
        if self.at > READ_BYTES:
            del self.buffer[: self.at]
            self.at = 0
        self.buffer += self.unpacker.decompress(data)
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (end := self.buffer.find(mark, self.at)) < 0:
            if not self._more():
                return None
        found = bytes(self.buffer[self.at : end])
        self.at = end + len(mark)
        return found

    def take(self, size: int) -> bytes:
        while len(self.buffer) - self.at < size:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        found = bytes(self.buffer[self.at : self.at + size])
        self.at += size
        return found


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {name.lower(): value for name, _, value in (x.partition(": ") for x in lines)}


def _parsed(stream: _Stream) -> Iterator[dict]:
    """Response and revisit records, their block and payload digests checked."""
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = _fields(head.lstrip(b"\r\n"))
        block = stream.take(int(fields["content-length"]))
        stream.take(4)
        if fields["warc-type"] not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        declared = fields["warc-payload-digest"].removeprefix("sha1:")
        if _digest(hashlib.sha1(block).digest()) != fields["warc-block-digest"]:
            raise ValueError(f"block digest of {fields['warc-record-id']} does not hold")
        size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
        is_response = fields["warc-type"] == "response"
        if is_response and (_digest(hashlib.sha1(payload).digest()) != f"sha1:{declared}"
                            or len(payload) != size):
            raise ValueError(f"payload of {fields['warc-record-id']} does not hold")
        refers_to = fields.get("x-refers-to-page-id")
        yield {
            "page_id": int(fields["x-page-id"]) if fields["x-page-id"] else None,
            "payload_bytes": size,
            "payload_digest": base64.b32decode(declared).hex(),
            "record_type": fields["warc-type"],
            "refers_to": int(refers_to) if refers_to else None,
            "target_uri": fields["warc-target-uri"],
        }


_RECORD_TYPES = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()),
     ("file", pa.string())]
)


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """All response and revisit records of the archives that the manifest names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held: list[dict] = []
                with store.open_input_stream(f"{base}/{name}", compression=None) as source:
                    for found in _parsed(_Stream(source)):
                        held.append(found | {"file": name})
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_pylist(held, schema=_RECORD_TYPES)
                            held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_RECORD_TYPES)

    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")
    files = manifest.count()
    # One file per task: it can only be read from its start.
    names = manifest.select("name").repartition(max(1, files), "name")
    return names.mapInArrow(read, RECORDS)


def archive_root(spark: SparkSession) -> str:
    root = scratch_path(spark, "warc")
    return root if "://" in root or root.startswith("file:") else f"file://{root}"
