"""WARC archives: a deterministic sharded writer, and a reader (operator 10).

Writing takes three steps.

1. A narrow table (key, sizes, digests) decides which record of equal payloads
   is the response: the largest key; the others revisit it. Groups of copies
   are combined before the shuffle.
2. The narrow table, sorted by key and digest over all partitions, gives running
   totals of what records will hold (revisits hold headers only), and these the
   first record of each shard. They depend on the data only, not on partitions,
   so every run writes the same shards.
3. Records travel once, one shard to a task, are sorted and written to gzip
   members, one per record. A file rolls once its compressed size passes
   ``roll_bytes``; shards are several times that, so compressed size decides the
   files. Headers and digests are made anew. Files are written under a
   temporary name of the attempt; the driver then renames the files of the
   attempts that succeeded, and writes the manifest last: an archive without a
   manifest is not committed, and a lost executor leaves only temporary files.

Unless told otherwise, a shard holds a ``SHARDS``-th of all bytes, within
``SHARD_BYTES``; the driver holds an entry for each shard and file.

Defined cases: a null payload counts as empty; null keys sort first, and are
read back as null; rows that repeat the response's key are all responses; rows
of equal key and payload share a shard; a shard without records has no file; an
empty table gives an empty archive; control characters in a URL are
percent-encoded; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_table, scratch_path, slices

#: Shards that an archive has at least, if they hold enough; fewest and most bytes of a shard; files of a full one if nothing compressed.
SHARDS, SHARD_BYTES, ROLLS = 64, (16 << 20, 1 << 30), 8
#: Bytes of a record's headers, about.
HEADERS = 600
#: A key that stands before all, for null.
FIRST = -(1 << 63)
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY_URN = "urn:x-key:"
#: A dataset has no capture times; one fixed date keeps archives reproducible.
DATE = "1970-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of ``path``: a mounted folder (file:) or any scheme that pyarrow opens."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _clean(url: str | None) -> str | None:
    if url is None:
        return None
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_response: bool) -> bytes:
    """One record: WARC headers, HTTP headers of the full payload, and for a response the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if is_response else http
    lines = [VERSION, f"WARC-Type: {'response' if is_response else 'revisit'}", f"WARC-Record-ID: <{KEY_URN}{'' if key is None else key}>", f"WARC-Date: {DATE}"]
    if (target := _clean(url)) is not None:
        lines.append(f"WARC-Target-URI: {target}")
    if not is_response:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{KEY_URN}{'' if refers_to is None else refers_to}>"]
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    """A gzip member without time or name, so equal data give equal bytes."""
    coder = zlib.compressobj(level, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


def plan(pages: DataFrame, *, key_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """``key, bytes, sum`` (SHA-256 of the payload), ``is_response, refers_to`` of each row."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key_col).cast("long").alias("key"), F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("sum"))
    first = rows.where(F.col("bytes") >= min_bytes).groupBy("sum", "bytes").agg(F.max("key").alias("response"))
    rows = rows.join(first, ["sum", "bytes"], "left")
    alone = (F.col("bytes") < min_bytes) | F.col("key").eqNullSafe(F.col("response"))
    return rows.select("key", "bytes", "sum", alone.alias("is_response"), F.when(~alone, F.col("response")).alias("refers_to"))


def _size() -> Column:
    return F.when(F.col("is_response"), F.col("bytes")).otherwise(F.lit(0)) + HEADERS


def shard_starts(decided: DataFrame, shard_bytes: int) -> list[tuple[int, str]]:
    """First (key, digest) of the shards after the first, of what ``plan`` gives.

    Two passes: totals of sorted partitions, then running totals inside them.
    The list has one entry per shard.
    """
    parts = int(decided.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = decided.groupBy(F.coalesce("key", F.lit(FIRST)).alias("key"), "sum").agg(F.sum(_size()).alias("bytes"))
    ordered = cut(sizes.repartitionByRange(parts, "key", "sum").sortWithinPartitions("key", "sum"))
    totals = dict(ordered.groupBy(F.spark_partition_id().alias("part")).agg(F.sum("bytes")).collect())
    base, bases = 0, {}
    for part in sorted(totals):
        bases[part] = base
        base += totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = bases.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            size = batch.column(2).to_numpy()
            before = at + np.cumsum(size) - size
            at += int(size.sum())
            begins = np.flatnonzero((before // shard_bytes != (before + size) // shard_bytes) & (before > 0))
            yield batch.take(pa.array(begins)).select(["key", "sum"])

    return sorted(tuple(r) for r in ordered.mapInArrow(run, "key long, sum string").collect())


def write(
    pages: DataFrame,
    path: str,
    *,
    key_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    shard_bytes: int | None = None,
    roll_bytes: int | None = None,
    level: int = 3,
) -> list[dict]:
    """Write and commit the archive at ``path``; returns its manifest (one entry per file)."""
    spark = pages.sparkSession
    decided = cut(plan(pages, key_col=key_col, payload_col=payload_col, min_bytes=min_bytes))
    if shard_bytes is None:
        least, most = SHARD_BYTES
        shard_bytes = min(most, max(least, int(decided.agg(F.sum(_size())).first()[0] or 0) // SHARDS))
    roll_bytes = roll_bytes or max(1, shard_bytes // ROLLS)
    starts = shard_starts(decided, shard_bytes)
    keys, sums = np.array([k for k, _ in starts], np.int64), [d for _, d in starts]
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    verdicts = decided.select("key", "sum", "is_response", "refers_to").distinct()
    bodies = pages.select(F.col(key_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("sum"))

    @F.pandas_udf("int")
    def shard_of(key: pd.Series, digest: pd.Series) -> pd.Series:
        low, high = (np.searchsorted(keys, key.to_numpy(), side=side) for side in ("left", "right"))
        # Several shards begin with this key.
        for i in np.flatnonzero(low < high).tolist():
            low[i] = bisect.bisect_right(sums, digest.iat[i], int(low[i]), int(high[i]))
        return pd.Series(low.astype(np.int32))

    shard = shard_of(F.coalesce("key", F.lit(FIRST)), "sum")
    sharded, verdicts = bodies.withColumn("shard", shard), verdicts.withColumn("shard", shard)
    # Both sides travel by shard; the verdicts of a shard are narrow and meet its records in the writer.
    rows = sharded.select("shard", "key", "sum", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("boolean").alias("is_response"), F.lit(None).cast("long").alias("refers_to"))
    rows = rows.unionByName(verdicts.select("shard", "key", "sum", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "is_response", "refers_to"))
    rows = rows.repartitionById(len(starts) + 1, "shard").sortWithinPartitions(F.col("shard"), F.col("key").asc_nulls_first(), "sum", "kind", "url")
    stage = f"{path}/_temporary-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(stage)
        store.create_dir(root, recursive=True)
        attempt, made = uuid.uuid4().hex[:12], []
        out, name, written, records, current, roll = None, "", 0, 0, None, 0
        is_response, refers_to = True, None

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                made.append((name, f"{name}.{attempt}", written, records))
            out = None

        for batch in slices(batches):
            for row in batch.to_pylist():
                if not row["kind"]:
                    # It comes before the records of its key and payload.
                    is_response, refers_to = row["is_response"], row["refers_to"]
                    continue
                if row["shard"] != current:
                    close()
                    current, roll = row["shard"], 0
                elif out is not None and written >= roll_bytes:
                    close()
                    roll += 1
                if out is None:
                    name, written, records = f"shard-{current:06d}-{roll:04d}.warc.gz", 0, 0
                    out = store.open_output_stream(posixpath.join(root, f"{name}.{attempt}"), compression=None)
                data = row["payload"]
                member = gzip_member(record(row["key"], row["url"], data, sha1_base32(data), refers_to, is_response), level)
                out.write(member)
                written += len(member)
                records += 1
        close()
        yield pa.record_batch(
            [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["name", "temporary", "bytes", "records"]
        )

    files = sorted(tuple(r) for r in rows.mapInArrow(run, "name string, temporary string, bytes long, records long").collect())
    store, root = _filesystem(path)
    _, temporary = _filesystem(stage)
    for name, made, _, _ in files:
        store.move(posixpath.join(temporary, made), posixpath.join(root, name))
    manifest = [{"name": n, "bytes": b, "records": r} for n, _, b, r in files]
    store.create_dir(root, recursive=True)
    with store.open_output_stream(posixpath.join(root, "manifest.json.tmp"), compression=None) as f:
        f.write(json.dumps(manifest).encode())
    store.move(posixpath.join(root, "manifest.json.tmp"), posixpath.join(root, "manifest.json"))
    if store.get_file_info(temporary).type == pafs.FileType.Directory:
        store.delete_dir(temporary)
    return manifest


def _records(stream: pa.NativeFile) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a (member-wise) gzip file, read in pieces."""
    raw, data = zlib.decompressobj(31), bytearray()
    ended = False

    def more() -> bool:
        nonlocal raw, ended
        while not ended:
            chunk = raw.unused_data if raw.eof else b""
            if raw.eof:
                raw = zlib.decompressobj(31)
            chunk = chunk or stream.read(1 << 18)
            if not chunk:
                ended = True
                return False
            if got := raw.decompress(chunk):
                data.extend(got)
                return True
        return False

    while True:
        while (end := data.find(b"\r\n\r\n")) < 0:
            if not more():
                if data.strip():
                    raise ValueError("truncated WARC record")
                return
        lines = bytes(data[:end]).decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        stop = end + 4 + int(headers["Content-Length"]) + 4
        while len(data) < stop:
            if not more():
                raise ValueError("truncated WARC record")
        yield headers, bytes(data[end + 4 : stop - 4])
        del data[:stop]


def _key(urn: str) -> int | None:
    text = urn.strip("<>").removeprefix(KEY_URN)
    return int(text) if text else None


def read(spark: SparkSession, path: str, *, key_col: str = "page_id") -> DataFrame:
    """Records of a committed archive: key, ``url``, ``payload`` (null for revisits), ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    Digests of responses are computed from the payload read, and both stored
    digests are verified.
    """
    store, root = _filesystem(path)
    with store.open_input_stream(posixpath.join(root, "manifest.json"), compression=None) as f:
        manifest = json.loads(f.read())
    schema = "key long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [part.split()[0] for part in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    files = spark.createDataFrame([(m["name"], m["bytes"]) for m in manifest], "name string, bytes long")
    files = files.repartition(max(1, len(manifest)), "name") if len(manifest) > 1 else files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(path)
        for batch in slices(batches):
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with store.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                    for headers, block in _records(stream):
                        if headers["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
                            raise ValueError(f"block digest differs in {name}")
                        head, _, payload = block.partition(b"\r\n\r\n")
                        http = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                        size, digest = int(http["Content-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = headers["WARC-Type"] == "response"
                        if response and (len(payload), sha1_base32(payload)) != (size, digest):
                            raise ValueError(f"payload digest differs in {name}")
                        refers = headers.get("WARC-Refers-To")
                        rows.append((_key(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), payload if response else None, size, digest, headers["WARC-Type"], _key(refers) if refers else None))
                        if len(rows) >= 256:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.select("name").mapInArrow(run, schema).withColumnRenamed("key", key_col)


def round_trip(pages: DataFrame, **options: object) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder, and read it back: all but the payloads, of which digests are verified.

    The archive is deleted after.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, **options)
    out = cut(read(spark, path, key_col=str(options.get("key_col", "page_id"))).drop("payload"))
    drop_table(spark, path)
    return out
