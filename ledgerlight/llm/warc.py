"""WARC archives: a deterministic sharded writer and a streaming reader.

Records are sorted by id over shards of near equal payload. The id ranges come from exact byte
sums over id intervals, not from a sample, so the same rows give the same files whatever the
partitioning. Shards and files grow with the input between fixed bounds; within a shard, files roll
at a compressed size, so a shard is several files. Every record is a gzip member with
headers and digests made anew. A file is written under a temporary name in the target folder and
moved to its own when complete; a task that runs again moves the same bytes to the same names.
The manifest, written last by Spark's own commit, says which files belong to the archive.

A payload of at least ``REVISIT_BYTES`` that other records repeat is stored once, by the record
with the largest id; the others are ``revisit`` records that refer to it.
"""

import base64
import hashlib
import itertools
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlight.llm.common import arrow_map

REVISIT_BYTES = 1000
#: A shard holds a 1,024th of all payload bytes, but at least and at most so many: tens of shards
#: for hundreds of megabytes, tens of thousands for 100 TB.
SHARES = 1024
LEAST_SHARD = 8 << 20
MOST_SHARD = 4 << 30
#: A file is closed at this part of its shard's payload bytes, counted compressed.
FILES = 16
#: Id intervals that are summed up for each shard at first, and how finely heavy ones are divided (bits).
INTERVALS = 8
DIVIDED = 6
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, sha1 string"
RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, "
           "record_type string, refers_to long, payload binary")
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace of URLs


def record_id(page_id, digest, copy=0):
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{digest}/{copy}')}>"


def _member(kind, headers, block, level):
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers,
                                               ("Content-Length", len(block))])
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def _base32(hex_digest):
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _clean(url):
    """A header value on one line; white space and control bytes become escapes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:unknown")


def page_record(page_id, url, payload, digest, refers_to, copy, date, level):
    """A response record, or a revisit where the payload stands in another one."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    headers = [("WARC-Record-ID", record_id(page_id, digest, copy)), ("WARC-Date", date),
               ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", _base32(digest)),
               ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("WARC-Page-ID", page_id))
    if url is None:
        headers.append(("WARC-No-Target", "true"))
    if refers_to is None:
        block = http + payload
        headers.append(("WARC-Block-Digest", _base32(hashlib.sha1(block).hexdigest())))
        return _member("response", headers, block, level)
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)),
                ("WARC-Refers-To-Page-ID", refers_to), ("WARC-Truncated", "length")]
    return _member("revisit", headers, http, level)


class _Roll:
    """The files of one shard, one after another."""

    def __init__(self, store, folder, shard, roll, date, level):
        self.store, self.folder, self.shard, self.roll = store, folder, shard, roll
        self.date, self.level, self.serial, self.out = date, level, 0, None

    def add(self, member):
        if self.out is None:
            self.name = f"shard-{self.shard:05d}-{self.serial:05d}.warc.gz"
            self.temporary = f"{self.folder}/_temporary-{self.name}-{uuid.uuid4().hex}"
            self.out = self.store.open_output_stream(self.temporary, compression=None)
            self.records, self.bytes, self.hash = -1, 0, hashlib.sha1()
            self.serial += 1
            self.add(_member("warcinfo", [
                ("WARC-Record-ID", record_id("file", self.name)), ("WARC-Date", self.date),
                ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")],
                b"format: WARC File Format 1.1\r\n", self.level))
        self.out.write(member)
        self.hash.update(member)
        self.records += 1
        self.bytes += len(member)

    def full(self):
        return self.out is not None and self.bytes >= self.roll

    def close(self):
        """The manifest row of the open file, if there is one."""
        if self.out is None:
            return []
        self.out.close()
        self.out = None
        self.store.move(self.temporary, f"{self.folder}/{self.name}")
        return [{"file": self.name, "records": self.records, "bytes": self.bytes,
                 "sha1": self.hash.hexdigest()}]


def _manifest(rows):
    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()),
                        ("sha1", pa.string())])
    return pa.RecordBatch.from_pylist(rows, schema)


def _write(folder, roll, date, level):
    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        files, origin, before, copy = None, {}, None, 0
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for shard, page_id, is_page, digest, url, payload, refers_to in zip(
                    *(c.to_pylist() for c in columns)):
                if files is None or files.shard != shard:
                    if files is not None:
                        yield _manifest(files.close())
                    files, origin, before = _Roll(store, path, shard, roll, date, level), {}, None
                if not is_page:  # stands before the pages of its id
                    if origin.get("id", ...) != page_id:
                        origin = {"id": page_id}
                    origin[digest] = refers_to
                    continue
                copy = copy + 1 if before == (page_id, digest) else 0
                before = page_id, digest
                other = origin.get(digest) if origin.get("id", ...) == page_id else None
                files.add(page_record(page_id, url, payload, digest, other, copy, date, level))
                if files.full():
                    yield _manifest(files.close())
        if files is not None:
            yield _manifest(files.close())
    return run


def shard_size(payload_bytes: int) -> int:
    return min(MOST_SHARD, max(LEAST_SHARD, payload_bytes // SHARES))


def id_ranges(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """First ids of the shards after the first, from exact sums over id intervals.

    ``sizes`` has page_id and bytes. Intervals are ids with the same leading bits. All those that
    hold more than a shard are divided by one more job, until they hold less or a single id. The
    driver receives a few sums for each shard.
    """
    whole = sizes.agg(F.min("page_id").alias("a"), F.max("page_id").alias("b"),
                      F.sum("bytes").alias("n")).first()
    if whole.a is None or not whole.n:
        return []
    shards = -(-whole.n // shard_bytes)
    bits = max(0, (whole.b - whole.a).bit_length() - (INTERVALS * shards).bit_length())
    done, open_ = [], sizes.where("page_id IS NOT NULL")
    while True:
        sums = open_.groupBy(F.shiftright("page_id", bits).alias("cell")).agg(F.sum("bytes").alias("n")).collect()
        heavy = [r.cell for r in sums if bits and r.n > shard_bytes]
        done += [(r.cell << bits, r.n) for r in sums if not bits or r.n <= shard_bytes]
        if not heavy:
            break
        # fewer cells than there are shards: each holds more than a shard's bytes
        cells = sizes.sparkSession.createDataFrame([(c,) for c in heavy], "cell long")
        open_ = sizes.withColumn("cell", F.shiftright("page_id", bits)).join(cells, "cell", "left_semi")
        bits = max(0, bits - DIVIDED)
    starts, held = [], 0
    for low, n in sorted(done):
        if held and held + n > shard_bytes:
            starts.append(low)
            held = 0
        held += n
    return starts


def shard_of(page_id: str, starts: list[int]) -> Column:
    """How many of the sorted ``starts`` are at most the id, by binary search; 0 for a null id."""
    if not starts:
        return F.lit(0)
    bounds = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")  # one folded literal
    top = 1 << (len(starts).bit_length() - 1)
    steps = F.transform(F.sequence(F.lit(0), F.lit(len(starts).bit_length() - 1)),
                        lambda k: F.call_function("shiftright", F.lit(top), k))
    found = F.aggregate(steps, F.lit(0), lambda held, step: F.when(
        F.coalesce(F.get(bounds, held + step - 1) <= F.col(page_id), F.lit(False)), held + step).otherwise(held))
    return F.when(F.col(page_id).isNull(), 0).otherwise(found)


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url",
                   payload: str = "html", shard_bytes: int | None = None,
                   roll_bytes: int | None = None, date: str = DATE, level: int = LEVEL) -> DataFrame:
    """Writes the archive and returns its manifest: file, records, bytes, sha1.

    Without ``shard_bytes`` the size of a shard follows from that of all payloads (``shard_size``),
    without ``roll_bytes`` the compressed size of a file from the shard's.

    A null payload is empty, a null url is marked as such, a null id comes first. Rows with the
    largest id of a repeated payload are all responses, also when the row itself is repeated.
    Repeated payloads whose ids are all null are all responses. Further columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    heads = rows.select("page_id", "digest", F.octet_length("payload").alias("bytes"))
    long_ = heads.where(F.col("bytes") >= REVISIT_BYTES)
    first = long_.groupBy("digest").agg(
        F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = long_.join(first, "digest").where(
        F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to"))).where(
        F.col("refers_to").isNotNull()).select("page_id", "digest", "refers_to").distinct()
    sizes = heads.select("page_id", (F.col("bytes") + 1).cast("long").alias("bytes"))
    shard_bytes = shard_bytes or shard_size(sizes.agg(F.sum("bytes")).first()[0] or 0)
    roll_bytes = roll_bytes or shard_bytes // FILES
    starts = id_ranges(sizes, shard_bytes)
    shard = shard_of("page_id", starts)
    order = ["shard", "page_id", "is_page", "digest", "url", "payload", "refers_to"]
    pages_part = rows.withColumn("shard", shard).withColumn("is_page", F.lit(True)).withColumn(
        "refers_to", F.lit(None).cast("long"))
    notes = revisits.withColumn("shard", shard).withColumn("is_page", F.lit(False)).withColumn(
        "url", F.lit(None).cast("string")).withColumn("payload", F.lit(None).cast("binary"))
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(
        spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    sorted_ = pages_part.select(*order).unionByName(notes.select(*order)).repartition(
        4 * (len(starts) + 1), "shard").sortWithinPartitions(*order[:5])
    arrow_map(sorted_, _write(folder, roll_bytes, date, level), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _members(stream, chunk=1 << 20):
    """Decompressed bytes of each gzip member, one at a time."""
    unpacker, out = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            out.append(unpacker.decompress(data))
            data = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(out)
                unpacker, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("the archive ends inside a record")


def parse_record(raw: bytes) -> tuple[dict, bytes]:
    """Headers and block of a record, lengths and digests checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    n = int(headers["Content-Length"])
    block = rest[:n]
    if not version.startswith("WARC/1.") or len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    said = headers.get("WARC-Block-Digest")
    if said and said != _base32(hashlib.sha1(block).hexdigest()):
        raise ValueError(f"wrong digest in {headers['WARC-Record-ID']}")
    return headers, block


def _page(raw, with_payload):
    headers, block = parse_record(raw)
    kind = headers["WARC-Type"]
    if kind == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
    said = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (n != len(payload) or hashlib.sha1(payload).hexdigest() != said):
        raise ValueError(f"wrong payload in {headers['WARC-Record-ID']}")
    ids = [int(x) if (x := headers.get(k)) else None for k in ("WARC-Page-ID", "WARC-Refers-To-Page-ID")]
    return {"page_id": ids[0],
            "url": None if "WARC-No-Target" in headers else headers["WARC-Target-URI"],
            "payload_bytes": n, "payload_digest": said, "record_type": kind, "refers_to": ids[1],
            "payload": payload if with_payload and kind == "response" else None}


def _read(folder, with_payload):
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload", pa.binary())])

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        for name in itertools.chain.from_iterable(b.column(0).to_pylist() for b in batches):
            with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                pages = (page for raw in _members(stream) if (page := _page(raw, with_payload)))
                while some := [*itertools.islice(pages, 256)]:
                    yield pa.RecordBatch.from_pylist(some, schema)
    return run


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The page records of the files a manifest names; revisits carry no payload."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    files = manifest.select("file").repartition(spark.sparkContext.defaultParallelism, "file")
    return arrow_map(files, _read(folder, with_payload), RECORDS)
