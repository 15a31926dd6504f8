"""Deterministic sharded WARC archives: sorted records, files rolled by compressed size, commit by manifest."""

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vacantia.llm.common import tidy
from vacantia.session import cut_lineage

# Payload bytes of a shard on average: what one task writes.
SHARD_BYTES = 32 << 20
# A file is closed once it has this many compressed bytes.
ROLL_BYTES = 32 << 20
# Payloads below this size are never revisits.
LEAST_BYTES = 100
# Sampled records per shard that choose the bounds of the shards.
SAMPLES = 32
DATE = "2000-01-01T00:00:00Z"

_TYPES = {"response": b"application/http;msgtype=response", "revisit": b"application/http;msgtype=response"}
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 16


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", folder))


def _record_id(*parts) -> bytes:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>".encode()


def _address(url: str | None, key) -> bytes:
    """A target that fits on one header line."""
    if not url:
        return f"urn:page:{key}".encode()
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode())


def record(key, url: str | None, payload: bytes | None, digest: str, size: int, refers_to, serial: int, date: str) -> bytes:
    """A gzip member with one record; headers and digests are made from the payload, or for revisits from its facts.

    ``serial`` tells apart records that are equal in key and payload.
    """
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    kind = "response" if payload is not None else "revisit"
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + _record_id(kind, key, digest, serial),
             b"WARC-Date: " + date.encode(), b"WARC-Target-URI: " + _address(url, key)]
    if key is not None:
        lines.append(b"Page-Id: " + str(key).encode())
    if kind == "revisit":
        lines += [b"WARC-Profile: " + _PROFILE, b"WARC-Refers-To: " + _record_id("response", refers_to, digest, 0),
                  b"Refers-To-Page-Id: " + str(refers_to).encode()]
    else:
        block += payload
    lines += [b"WARC-Payload-Digest: sha256:" + digest.encode(),
              b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode(),
              b"Content-Type: " + _TYPES[kind], b"Content-Length: %d" % len(block)]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _information(shard: int, number: int, date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    lines = [b"WARC/1.1", b"WARC-Type: warcinfo", b"WARC-Record-ID: " + _record_id("warcinfo", shard, number),
             b"WARC-Date: " + date.encode(), b"WARC-Filename: " + file_name(shard, number).encode(),
             b"Content-Type: application/warc-fields", b"Content-Length: %d" % len(block)]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def file_name(shard: int, number: int) -> str:
    return f"shard-{shard:06d}-{number:05d}.warc.gz"


class _Writer:
    """The files of one task, under temporary names that no other attempt uses."""

    def __init__(self, folder: str, roll: int, date: str):
        self.system, self.root = _open(folder)
        self.attempt, self.roll, self.date = uuid.uuid4().hex, roll, date
        self.shard, self.number, self.out = None, 0, None
        self.done: list[tuple] = []

    def _begin(self):
        self.temporary = f"_temporary/{self.attempt}-{self.shard}-{self.number}"
        self.out = self.system.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
        self.bytes, self.records, self.hash = 0, 0, hashlib.sha256()
        self._put(_information(self.shard, self.number, self.date))

    def _put(self, member: bytes):
        self.out.write(member)
        self.hash.update(member)
        self.bytes += len(member)

    def close(self):
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.number, self.temporary, file_name(self.shard, self.number), self.records,
                              self.bytes, self.hash.hexdigest()))
            self.out, self.number = None, self.number + 1

    def add(self, shard: int, member: bytes):
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        if self.out is None:
            self._begin()
        self._put(member)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()


_MANIFEST = "shard long, number long, temporary string, name string, records long, bytes long, sha256 string"


def _written(rows: DataFrame, folder: str, roll: int, date: str) -> DataFrame:
    """Write the sorted rows of each task and return the manifest rows of its files."""
    def run(batches):
        writer, last, other, serial = _Writer(folder, roll, date), None, None, 0
        for batch in batches:
            for shard, key, url, html, digest, size, refers_to, page in zip(*(c.to_pylist() for c in batch.columns)):
                serial = serial + 1 if last == (key, digest) else 0
                if last != (key, digest):
                    last, other = (key, digest), None
                if not page:
                    other, serial = refers_to, -1
                    continue
                writer.add(shard, record(key, url, html if other is None else None, digest, size, other, serial, date))
        writer.close()
        if writer.done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*writer.done)],
                                             names=[f.split()[0] for f in _MANIFEST.split(", ")])
    return rows.mapInArrow(tidy(run), _MANIFEST)


def _moved(manifest: DataFrame, folder: str) -> DataFrame:
    """Give the files of the manifest their names; a file that has its name already is left, so a repeat does no harm."""
    def run(batches):
        system, root = _open(folder)
        for batch in batches:
            for temporary, name, size in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist()
                                               for c in ("temporary", "name", "bytes"))):
                there = system.get_file_info(f"{root}/{temporary}").type != fs.FileType.NotFound
                if there:
                    system.move(f"{root}/{temporary}", f"{root}/{name}")
                if system.get_file_info(f"{root}/{name}").size != size:
                    raise OSError(f"{name} is not the file of its manifest row")
            yield batch
    return manifest.mapInArrow(tidy(run), manifest.schema)


def _shard(place: Column, bounds: list) -> Column:
    """How many bounds lie at or below a place, by two short scans of the sorted bounds."""
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    if not blocks:
        return F.lit(0)

    def literal(bound):
        return F.struct(F.lit(bound[0]).alias("key"), F.lit(bound[1]).alias("digest"))
    heads = F.array(*(literal(b[0]) for b in blocks))
    rows = F.array(*(F.array(*(literal(x) for x in b)) for b in blocks))
    block = F.size(F.filter(heads, lambda b: b <= place))
    inside = F.size(F.filter(F.element_at(rows, block), lambda b: b <= place))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * F.lit(step) + inside)


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html",
          shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Write one record per page to an empty folder that all executors reach; returns the manifest.

    Of pages with equal payloads of at least 100 bytes, the smallest key is a response and the others revisit it; rows
    that repeat that key and payload are responses too. Without any key in such a group all are responses. Null pages are
    empty payloads. Records are sorted by (key, payload digest), nulls first; shard bounds come from a sample that the
    records' hashes choose, so equal tables give equal bytes, file for file, however they are partitioned.

    Tasks write files under names of their own below ``_temporary``. The manifest rows of the attempts that count decide
    which get their final names; the manifest is written last, and its _SUCCESS marks the archive as whole.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    base = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("html"),
                        F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    narrow = cut_lineage(base.select("key", "digest", "size"))
    count, total = narrow.agg(F.count("*"), F.sum("size")).first()
    shards = max(1, -(-(total or 0) // shard_bytes))
    first = (narrow.where(F.col("size") >= LEAST_BYTES).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n"))
             .where("n > 1").select("digest", "first"))
    bounds = []
    if shards > 1:
        apart = max(1, count // (shards * SAMPLES))
        sample = sorted((tuple(r) for r in narrow.where(F.pmod(F.xxhash64("key", "digest"), F.lit(apart)) == 0)
                         .select("key", "digest").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        bounds = list(dict.fromkeys(sample[len(sample) * i // shards] for i in range(1, shards))) if sample else []
    shard = _shard(F.struct(F.col("key"), F.col("digest")), bounds).cast("int").alias("shard")
    # what a revisit refers to is a row of its own just before the pages it holds for, so that pages move only once
    facts = narrow.join(first, "digest").where(~F.col("key").eqNullSafe(F.col("first"))).where("first IS NOT NULL").select(
        shard, "key", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "digest", "size",
        F.col("first").alias("refers_to"), F.lit(0).alias("page")).distinct()
    rows = base.select(shard, "key", "url", F.col("html").cast("binary").alias("html"), "digest", "size",
                       F.lit(None).cast(narrow.schema["key"].dataType).alias("refers_to"), F.lit(1).alias("page"))
    system, root = _open(folder)
    system.create_dir(f"{root}/_temporary", recursive=True)
    sorted_rows = (rows.union(facts).repartitionById(shards, F.col("shard"))
                   .sortWithinPartitions("shard", "key", "digest", "page", "url"))
    manifest = cut_lineage(_written(sorted_rows, folder, roll_bytes, date))
    _moved(manifest, folder).drop("temporary").write.parquet(f"{folder}/manifest")
    system.delete_dir(f"{root}/_temporary")
    return manifest.sparkSession.read.parquet(f"{folder}/manifest")


def members(data: bytes) -> Iterator[bytes]:
    """The decompressed gzip members of a file, one at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("the file ends inside a member")
            chunk = view[at:at + _CHUNK]
            parts.append(unpack.decompress(chunk))
            at += len(chunk) - len(unpack.unused_data)
        yield b"".join(parts)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, with its length and block digest checked."""
    head, _, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != b"WARC/1.1":
        raise ValueError(f"not a record: {version[:20]!r}")
    headers = {k.decode(): v.decode() for k, _, v in (line.partition(b": ") for line in lines)}
    size = int(headers["Content-Length"])
    block = rest[:size]
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    digest = headers.get("WARC-Block-Digest")
    if digest and digest != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError("a block does not match its digest")
    return headers, block


def read(spark: SparkSession, folder: str, key_type: str = "long") -> DataFrame:
    """The records of an archive: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    Only files that the manifest names are read. A file that is missing or has another length is refused at once; lengths,
    digests and numbers of records are checked as files are read, and a mismatch fails the job. Revisits have a null
    payload and the size and digest of the payload they stand for.
    """
    manifest = spark.read.parquet(f"{folder}/manifest").select("name", "records", "bytes", "sha256")
    found = (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
             .withColumn("name", F.element_at(F.split("path", "/"), -1)))
    wrong = manifest.join(found.select("name", "length"), "name", "left").where("NOT length <=> bytes").limit(5).collect()
    if wrong:
        raise ValueError("not the files of the manifest: " + ", ".join(
            f"{r.name} (missing)" if r.length is None else f"{r.name} ({r.length} bytes for {r.bytes})" for r in wrong))
    files = found.select("name", "content").join(manifest, "name").select("name", "records", "sha256", "content")
    kind = to_arrow_type(spark.createDataFrame([], f"k {key_type}").schema["k"].dataType)

    def cast(value):
        return None if value is None else int(value) if pa.types.is_integer(kind) else value

    def run(batches):
        for batch in batches:
            for name, records, sha256, content in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                rows, held, count = [], 0, 0
                if hashlib.sha256(content.as_buffer()).hexdigest() != sha256:
                    raise ValueError(f"{name} does not match its digest in the manifest")
                for member in members(content.as_buffer()):
                    headers, block = parse(member)
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    count += 1
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    whole = headers["WARC-Type"] == "response"
                    if whole and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError("a payload does not match its headers")
                    rows.append((cast(headers.get("Page-Id")), size, digest, headers["WARC-Type"],
                                 cast(headers.get("Refers-To-Page-Id")), headers["WARC-Target-URI"], payload if whole else None))
                    held += len(block)
                    if held > 4 << 20:
                        yield table(rows)
                        rows, held = [], 0
                if count != records:
                    raise ValueError(f"{name} has {count} records and not {records} as in the manifest")
                if rows:
                    yield table(rows)

    def table(rows):
        types = [kind, pa.int64(), pa.string(), pa.string(), kind, pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[
            "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])
    return files.mapInArrow(tidy(run), f"page_id {key_type}, payload_bytes long, payload_digest string, record_type string,"
                                 f" refers_to {key_type}, url string, payload binary")
