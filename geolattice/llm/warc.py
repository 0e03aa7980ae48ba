"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by page id; each range (its ends follow from exact counts
of ids, not from a sample) is written by one task as files that roll over by
compressed size. Headers, record ids and digests are made from the records alone,
so that a task or a job that runs again writes the same bytes. A file
gets its name only when it is whole, and the manifest, written last, names the
files that count. Of equal payloads from MIN_REVISIT bytes on, the one with the
largest page id is kept as a response and the others become revisits to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_folder

MIN_REVISIT = 1000
ROLL_BYTES = 16 << 20
LEVEL = 2
# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE_OF_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, digest: str, more: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE_OF_IDS, f'{page_id}/{digest}{more}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, more: str = "") -> bytes:
    """One uncompressed record; a revisit (``refers_to`` is given) has no payload but states its size and digest. ``more`` tells records of equal id and payload apart."""
    digest = _digest(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, digest, more)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", _digest(block)),
        ("X-Payload-Bytes", str(len(payload))),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    headers.append(("Content-Length", str(len(block))))
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _zipped(data: bytes) -> bytes:
    """One gzip member, without time and name."""
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31, 8)
    return pack.compress(data) + pack.flush()


class _Roll:
    """Files of one shard, each written under a temporary name."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.shard, self.roll_bytes = shard, roll_bytes
        self.number, self.out = 0, None

    def add(self, member: bytes, page_id: int | None) -> dict | None:
        """Write a member; returns the manifest row of a file that this one filled."""
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.part = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.part, compression=None)
            self.sum, self.size, self.records, self.first = hashlib.sha256(), 0, 0, page_id
            self.number += 1
        self.out.write(member)
        self.sum.update(member)
        self.size += len(member)
        self.records += 1
        self.last = page_id
        return self.close() if self.size >= self.roll_bytes else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        self.fs.move(self.part, f"{self.folder}/{self.name}")
        return {"file": self.name, "records": self.records, "bytes": self.size, "sha256": self.sum.hexdigest(), "first_id": self.first, "last_id": self.last}


_MANIFEST = "file string, records long, bytes long, sha256 string, first_id long, last_id long"
_SPLIT = 256


def shard_bounds(ids: DataFrame, shards: int) -> list[int]:
    """First ids of all shards but the first, so that shards hold about equally many of the ``id``s; the same for equal ids in any order.

    Ranges with more than a quarter of a shard are divided into 256 and counted
    again, until none is left or a single id is; at most 1024 counts a shard come
    to the driver each time.
    """
    low, high, total = ids.agg(F.min("id"), F.max("id"), F.count("id")).first()
    if not total:
        return []
    most = max(1, total // (4 * shards))
    ranges = [(low, high, total)]
    while True:
        large = sorted(r for r in ranges if r[2] > most and r[1] > r[0])
        if not large:
            break
        starts, steps = [a for a, _, _ in large], [max(1, -(-(b - a + 1) // _SPLIT)) for a, b, _ in large]
        at = _place(F.col("id"), starts)
        own = ids.where(F.col("id").isNotNull()).withColumn("at", at).where("at >= 0")
        first = F.get(F.lit(starts), F.col("at"))
        own = own.where(F.col("id") <= F.get(F.lit([b for _, b, _ in large]), F.col("at")))
        # Differences may pass the largest long, so they are taken as decimals.
        part = F.floor((F.col("id").cast("decimal(20,0)") - first.cast("decimal(20,0)")) / F.get(F.lit(steps), F.col("at")).cast("decimal(20,0)")).cast("int")
        counts = own.select("at", part.alias("part")).groupBy("at", "part").agg(F.count("*").alias("n")).collect()
        ranges = [r for r in ranges if not (r[2] > most and r[1] > r[0])]
        for r in counts:
            a, b, step = *large[r["at"]][:2], steps[r["at"]]
            ranges.append((a + r["part"] * step, min(b, a + (r["part"] + 1) * step - 1), r["n"]))
    bounds, before = [], 0
    for a, _, n in sorted(ranges):
        if before * shards >= total * (len(bounds) + 1):
            bounds.append(a)
        before += n
    return bounds[: shards - 1]


def _place(value: Column, sorted_: list[int]) -> Column:
    """Index of the last of ``sorted_`` that is not above ``value``, by bisection; -1 if none is."""
    if not sorted_:
        return F.lit(-1)
    steps = [1 << k for k in reversed(range(len(sorted_).bit_length()))]
    own = F.lit(sorted_)
    found = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when((at + step <= len(sorted_)) & (F.get(own, at + step - 1) <= value), at + step).otherwise(at))
    return found - 1


def write_archives(pages: DataFrame, folder: str, shards: int | None = None, roll_bytes: int = ROLL_BYTES, date: str = "1970-01-01T00:00:00Z", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to ``folder``, a URI that all executors reach; returns the manifest.

    A null html is an empty payload, a null url an empty target. Rows without
    page_id are responses and never referred to; they are dealt to the shards by
    hash. Of repeated rows with the largest page_id of their payload one is the
    response and the others revisit it. Other columns are ignored. The manifest
    is a Parquet table in ``folder``/manifest, written after all files are in
    place; files of attempts that failed go then.
    """
    spark = pages.sparkSession
    datetime.fromisoformat(date.replace("Z", "+00:00")).astimezone(timezone.utc)
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    prints = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html).alias("sha"), F.octet_length(html).alias("size"))
    prints = prints.where(F.col("size") >= min_revisit)
    kept = prints.groupBy("sha").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").select("sha", "kept")
    # An order to revisit travels with the page's row through one shuffle, sorted before it.
    orders = prints.join(kept, "sha").groupBy("page_id", "sha").agg(F.max("kept").alias("kept"))
    none = F.lit(None).cast("string")
    both = own.select("page_id", F.lit(1).alias("kind"), "url", "html", none.alias("sha"), F.lit(None).cast("long").alias("kept"))
    both = both.unionByName(orders.select("page_id", F.lit(0).alias("kind"), none.alias("url"), none.alias("html"), "sha", "kept"))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = shard_bounds(own.select(F.col("page_id").alias("id")), shards)
    shard = F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64("url", "html"), F.lit(shards))).otherwise(_place(F.col("page_id"), bounds) + 1).cast("int")
    sorted_ = both.repartitionById(shards, shard).sortWithinPartitions("page_id", "kind", "url", "html")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        roll = _Roll(folder, TaskContext.get().partitionId(), roll_bytes)
        done: list[dict] = []
        current, known, seen = object(), {}, {}
        for batch in batches:
            for page_id, kind, url, html, sha, kept in zip(*(c.to_pylist() for c in batch.columns)):
                one = page_id if page_id is not None else (url, html)
                if one != current:
                    current, known, seen = one, {}, {}
                if kind == 0:
                    known[sha] = kept
                    continue
                payload = html.encode("utf-8", "surrogatepass")
                own_sha = hashlib.sha1(payload).hexdigest()
                again = seen[own_sha] = seen.get(own_sha, -1) + 1
                refers_to = known.get(own_sha)
                if refers_to == page_id and not again:
                    refers_to = None
                more = ("" if page_id is not None else f"/{url}") + (f"/{again}" if again else "")
                done.append(roll.add(_zipped(record(page_id, url, payload, refers_to, date, more)), page_id))
        done.append(roll.close())
        yield pa.RecordBatch.from_pylist([d for d in done if d], pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _MANIFEST.split(", ")]))

    sorted_.mapInArrow(write, _MANIFEST).write.parquet(f"{folder}/manifest")
    for left in fs.get_file_info(pafs.FileSelector(path)):
        if left.base_name.startswith(".shard-"):
            fs.delete_file(left.path)
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def parse_records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzipped archive's bytes; checks the block digest."""
    pack, data, rest = zlib.decompressobj(31), bytearray(), b""
    for chunk in stream:
        rest = chunk
        while rest:
            data += pack.decompress(rest)
            if not pack.eof:
                break
            rest = pack.unused_data
            yield _parse(bytes(data))
            pack, data = zlib.decompressobj(31), bytearray()
    if data:
        raise ValueError("the archive ends within a record")


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0].encode() != VERSION:
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if _digest(block) != headers["WARC-Block-Digest"]:
        raise ValueError(f"digest of {headers['WARC-Record-ID']} differs")
    return headers, block


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the files in the manifest: page_id, url, record_type, refers_to, payload_bytes, payload_digest (hex SHA-1), payload (null for revisits).

    Size and digest of a response are taken from its payload, those of a revisit from its headers.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").select("file").repartition(tasks, "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as source:
                    for headers, block in parse_records(iter(lambda: source.read(1 << 20), b"")):
                        payload = block.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else None
                        sha = hashlib.sha1(payload).hexdigest() if payload is not None else base64.b32decode(headers["WARC-Payload-Digest"][5:]).hex()
                        n = len(payload) if payload is not None else int(headers["X-Payload-Bytes"])
                        to = headers.get("X-Refers-To-Page-ID")
                        own = headers.get("X-Page-ID")
                        rows.append((int(own) if own else None, headers["WARC-Target-URI"], headers["WARC-Type"], int(to) if to else None, n, sha, payload))
                        size += n
                        if size > 8 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))


def fresh_folder(spark: SparkSession, label: str = "warc") -> str:
    """A new folder in the cluster's shared one."""
    base = shared_folder(spark)
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/{label}-{uuid.uuid4().hex}"
