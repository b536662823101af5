"""Deterministic sharded WARC archives and their reader.

Pages are dealt to ranges of ``page_id`` whose bounds depend on the rows alone
(a byte histogram over steps of the id, finer where it is heavy), each range is written by one
task in id order, and files roll once their compressed size reaches a limit, so
any cluster writes the same bytes.  Every record is a gzip member of its own.
Files are written under temporary names and renamed; the manifest, a Parquet
table of the files with their sizes and digests, is committed last, and only
files that it lists belong to the archive.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import common

RANGES, RANGE_BYTES, STEPS = 64, 512 << 20, 8
ROLL_BYTES = 128 << 20
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, shard long, roll int, records long, bytes long, sha256 string"
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    return int(x) if (x := uri.rpartition(":")[2].rstrip(">")) else None


def make_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """One record as a gzip member: a response, or a revisit where ``refers_to`` is given."""
    digest = hashlib.sha256(payload).hexdigest()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", "".join(url.split()) or "urn:none")]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    data = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def members(stream, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpacker, parts = zlib.decompressobj(31), []
    while data := stream.read(step):
        while data:
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the archive ends within a record")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block, with length and digest checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    if headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"block digest of {headers['warc-record-id']} differs")
    return headers, block


def read_page(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    headers, block = parse_record(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].partition(":")[2]
    if kind == "response":
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload digest of {headers['warc-record-id']} differs")
        size, refers_to = len(payload), None
    else:
        size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).partition(b":")[2])
        refers_to = page_of(headers["warc-refers-to"])
    return page_of(headers["warc-record-id"]), size, digest, kind, refers_to


def in_ranges(pages: DataFrame, ranges: int = RANGES, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, int]:
    """``pages`` with a shard for each row, and the number of shards.

    Ids are counted in equal steps; a step with more than its share of the bytes
    is cut into equal steps again, until it is light or of one id.  Each round brings at
    most ``STEPS`` steps for each shard to the driver, and no more rounds than an id has digits
    in that base are needed.
    """
    spark, size, number = pages.sparkSession, F.octet_length(F.coalesce("html", F.lit(""))) + 200, "decimal(20,0)"
    low, high, total = pages.agg(F.min("page_id"), F.max("page_id"), F.sum(size)).first()
    low, high, total = low or 0, high or 0, total or 0
    n = max(ranges, -(-total // range_bytes))
    # Each row knows the part of the ids that it is in, until a light step of one takes it for its leaf.
    parts = {0: (low, -(-(high - low + 1) // (n * STEPS)))}  # first id, ids in a step
    placed = pages.withColumns({"leaf": F.lit(None).cast("long"), "part": F.when(F.col("page_id").isNotNull(), F.lit(0)), "first": F.lit(low).cast(number), "width": F.lit(parts[0][1]).cast(number)})
    leaves: list[tuple[int, int, int]] = []  # first id, bytes, number
    while parts:
        placed = placed.withColumn("step", F.floor((F.col("page_id").cast(number) - F.col("first")) / F.col("width")).cast("long"))
        found = sorted(placed.filter("part IS NOT NULL").groupBy("part", "step").agg(F.sum(size).alias("bytes")).collect())
        heavy = {(part, step): i for i, (part, step) in enumerate((p, k) for p, k, weight in found if parts[p][1] > 1 and weight * n > 2 * total)}
        rows, new = [], {}
        for part, step, weight in found:
            first, width = parts[part][0] + step * parts[part][1], parts[part][1]
            if (i := heavy.get((part, step))) is None:
                rows.append((part, step, len(leaves), None, None, None))
                leaves.append((first, weight, len(leaves)))
            else:
                new[i] = first, -(-width // max(2, n * STEPS // len(heavy)))
                rows.append((part, step, None, i, *map(Decimal, new[i])))
        into = F.broadcast(spark.createDataFrame(rows, f"part int, step long, to_leaf long, to_part int, to_first {number}, to_width {number}"))
        placed = placed.join(into, ["part", "step"], "left").withColumn("leaf", F.coalesce("leaf", "to_leaf")).drop("part", "first", "width", "step", "to_leaf").withColumnsRenamed({"to_part": "part", "to_first": "first", "to_width": "width"})
        parts = new
    seen, shards = 0, []
    for _, weight, leaf in sorted(leaves):
        shards.append((leaf, min(n - 1, seen * n // max(1, total))))
        seen += weight
    into = F.broadcast(spark.createDataFrame(shards, "leaf long, shard int"))
    return placed.join(into, "leaf", "left").withColumn("shard", F.coalesce("shard", F.lit(0))).drop("leaf", "part", "first", "width"), n


def write_archives(pages: DataFrame, folder: str, least: int = 100, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html); returns the manifest.

    A null html or url counts as empty, a null page_id goes to the first shard and
    has the id ``urn:page:``.  Of rows with equal payloads of at least ``least``
    bytes those with the smallest page_id are responses (all of them, where a row
    is repeated), the others revisit that id; a payload known by null ids only has
    no smallest id, and its records are responses.  A payload of any length is one
    record; rows of one id are ordered by payload; an empty table gives an empty
    manifest.  Other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    dealt, n = in_ranges(rows)
    text = F.coalesce("html", F.lit(""))
    known = dealt.select("shard", "page_id", F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).alias("size")).filter(F.col("size") >= least).drop("size")
    first = known.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    # Only ids and digests are joined; the payloads meet their role in the writer, dealt by id.
    roles = known.join(first, "digest").filter("page_id IS NULL AND refers_to IS NOT NULL OR page_id > refers_to").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    both = roles.select("shard", "page_id", F.lit(0).alias("kind"), none("string").alias("url"), none("binary").alias("payload"), "digest", "refers_to").unionByName(
        dealt.select("shard", "page_id", F.lit(1).alias("kind"), F.coalesce("url", F.lit("")).alias("url"), text.cast("binary").alias("payload"), none("string").alias("digest"), none("long").alias("refers_to"))
    )

    def write(batches):
        files, path = common.filesystem(folder)
        files.create_dir(path, recursive=True)
        shard, roll, stream, state = None, 0, None, None
        of, role = None, {}

        def finish():
            stream.close()
            name = f"pages-{shard:06d}-{roll:04d}.warc.gz"
            files.move(temporary, f"{path}/{name}")
            return pa.RecordBatch.from_pydict({"file": [name], "shard": [shard], "roll": pa.array([roll], pa.int32()), "records": [state[0]], "bytes": [state[1]], "sha256": [state[2].hexdigest()]})

        for batch in batches:
            for own, page_id, kind, url, payload, digest, refers_to in zip(*(batch.column(k).to_pylist() for k in ("shard", "page_id", "kind", "url", "payload", "digest", "refers_to")), strict=True):
                if page_id != of:
                    of, role = page_id, {}
                if not kind:
                    role[digest] = refers_to
                    continue
                if stream and (own != shard or state[1] >= roll_bytes):
                    yield finish()
                    stream, roll = None, roll + 1 if own == shard else 0
                shard = own
                if stream is None:
                    temporary, state = f"{path}/.{uuid.uuid4().hex}.tmp", [0, 0, hashlib.sha256()]
                    stream = files.open_output_stream(temporary, compression=None)
                data = make_record(page_id, url, payload, role.get(hashlib.sha256(payload).hexdigest()) if role else None)
                stream.write(data)
                state[0] += 1
                state[1] += len(data)
                state[2].update(data)
        if stream:
            yield finish()

    order = [F.col("shard"), F.col("page_id").asc_nulls_first(), F.col("kind"), F.col("payload")]
    files = both.repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions(*order).mapInArrow(write, MANIFEST)
    return common.written(files, f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record of the files that the manifest lists: none for an empty one; repeated pages come back as often as they were written, null ids as null."""

    def read(batches):
        files, path = common.filesystem(folder)
        for batch in batches:
            for name, digest in zip(batch.column("file").to_pylist(), batch.column("sha256").to_pylist(), strict=True):
                seen, rows = hashlib.sha256(), []

                def through(stream):
                    class Through:
                        def read(self, n):
                            data = stream.read(n)
                            seen.update(data)  # noqa: B023
                            return data

                    return Through()

                with files.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for data in members(through(stream)):
                        rows.append(read_page(data))
                        if len(rows) == 10_000:
                            yield rows_of(rows)
                            rows = []
                if seen.hexdigest() != digest:
                    raise ValueError(f"{name} differs from the manifest")
                if rows:
                    yield rows_of(rows)

    def rows_of(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    manifest = spark.read.parquet(f"{folder}/manifest")
    return manifest.select("file", "sha256").repartition(max(1, min(manifest.count(), 100_000))).mapInArrow(read, PAGE)
