"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id into shards of a fixed number of records, whose bounds come from an
exact global numbering; a shard is written by one task, in order, and rolled into files by compressed
size.  So the files depend on the pages alone, not on partitions, executors or retries.  Every attempt
writes under temporary names of its own; the manifest lists the files of the attempts that Spark
accepted, and only those are renamed to their final names.

A payload is the page's html in UTF-8; null is an empty payload.  Among equal payloads of at least
``revisit_bytes`` the record with the largest page id is the response, the others revisit it; rows that
share that largest page id are all responses, and so is a group of rows without page id.  Null page ids
sort first; a null url becomes a ``urn:page`` name.  Further columns of the table are not archived.  No
pages give an empty manifest and no records.
"""

import base64
import bisect
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.llm.common import kept, new_folder, small
from fleetspan.shared import numbered

RECORDS_PER_SHARD = 5_000
ROLL_BYTES = 64 << 20
REVISIT_BYTES = 1000
CHUNK = 1 << 20
# Pages carry no fetch time.
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "shard int, seq int, temporary string, name string, bytes long, records long, sha1 string"
RECORDS = "page_id long, record_type string, refers_to long, target_uri string, payload_bytes long, payload_digest string, file string"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def _uri(url, page_id) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _member(headers: list, block: bytes) -> bytes:
    """One gzip member with one record; no time stamp, so equal records give equal bytes."""
    head = "".join(f"{name}: {value}\r\n" for name, value in [*headers, ("Content-Length", len(block))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id, url, payload: bytes, digest_hex: str, refers_to, refers_url) -> bytes:
    """The record of one page; a revisit keeps the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id("page", page_id, url, digest_hex)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url, page_id)),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Block-Digest", _digest(block)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode()),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", page_id))
    if revisit:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id("page", refers_to, refers_url, digest_hex)),
            ("WARC-Refers-To-Target-URI", _uri(refers_url, refers_to)),
            ("X-Refers-To-Page-Id", refers_to),
        ]
    return _member(headers, block)


def _file_head(name: str) -> bytes:
    block = b"software: sharded WARC writer\r\nformat: WARC File Format 1.1\r\n"
    return _member(
        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id("file", name)), ("WARC-Date", DATE),
         ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def _store(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else f"file://{folder}")


def _writer(folder: str, roll_bytes: int):
    def write(batches):
        store, root = _store(folder)
        store.create_dir(f"{root}/temporary", recursive=True)
        attempt, made, state = uuid.uuid4().hex, [], {}

        def close():
            if state:
                state["out"].close()
                made.append((state["shard"], state["seq"], state["temporary"], state["name"], state["bytes"], state["records"], state["sha1"].hexdigest()))
                state.clear()

        def put(data: bytes, records: int):
            state["out"].write(data)
            state["sha1"].update(data)
            state["bytes"] += len(data)
            state["records"] += records

        def begin(shard: int, seq: int):
            name = f"pages-{shard:07d}-{seq:05d}.warc.gz"
            temporary = f"temporary/{name}.{attempt}"
            state.update(shard=shard, seq=seq, name=name, temporary=temporary, bytes=0, records=0, sha1=hashlib.sha1(), out=store.open_output_stream(f"{root}/{temporary}", compression=None))
            put(_file_head(name), 0)

        for batch in batches:
            for shard, member in zip(batch.column("shard").to_pylist(), batch.column("member")):
                data = member.as_buffer().to_pybytes()
                if not state or state["shard"] != shard:
                    close()
                    begin(shard, 0)
                elif state["bytes"] + len(data) > roll_bytes and state["records"]:
                    seq = state["seq"] + 1
                    close()
                    begin(shard, seq)
                put(data, 1)
        close()
        columns = list(zip(*made)) if made else [[]] * 7
        types = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        names = ("shard", "seq", "temporary", "name", "bytes", "records", "sha1")
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    return write


def _members(bounds: list):
    """Compress records and find their shards by the shards' first keys."""

    def build(batches):
        for batch in batches:
            rows = batch.to_pydict()
            shards, members = [], []
            for page_id, tie, url, html, digest, refers_to, refers_url in zip(*(rows[n] for n in ("page_id", "_tie", "url", "html", "_digest", "_refers", "_refers_url"))):
                key = (page_id is not None, page_id or 0, tie)
                shards.append(max(0, bisect.bisect_right(bounds, key) - 1))
                members.append(page_record(page_id, url, (html or "").encode("utf-8"), digest, refers_to, refers_url))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int32()), batch.column("page_id"), batch.column("_tie"), pa.array(members, pa.binary())],
                names=["shard", "page_id", "_tie", "member"])

    return build


def _commit(folder: str):
    """Rename accepted files; a second attempt finds them in place already."""

    def rename(batches):
        from pyarrow.fs import FileType

        store, root = _store(folder)
        for batch in batches:
            for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("name").to_pylist()):
                if store.get_file_info(f"{root}/{temporary}").type == FileType.File:
                    store.move(f"{root}/{temporary}", f"{root}/{name}")
                elif store.get_file_info(f"{root}/{name}").type != FileType.File:
                    raise OSError(f"{name}: neither written nor committed")
            yield batch

    return rename


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = REVISIT_BYTES,
               records_per_shard: int = RECORDS_PER_SHARD) -> DataFrame:
    """Archive ``pages`` (``page_id, url, html``) into ``folder`` and return the manifest, also kept there.

    One key per shard travels to the driver, which is one per ``records_per_shard`` pages.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(html).alias("_digest"), F.xxhash64("url", "html").alias("_tie"))
    groups = (
        pages.where((F.octet_length(html) >= revisit_bytes) & F.col("page_id").isNotNull())
        .groupBy("_digest").agg(F.max(F.struct("page_id", "url")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
        .select(F.col("_digest").alias("_key"), F.col("_first.page_id").alias("_to"), F.col("_first.url").alias("_refers_url"))
    )
    groups = kept(groups, "warc-groups")
    keys = numbered(pages.select("page_id", "_tie"), [F.col("page_id").asc_nulls_first(), F.col("_tie").asc()])
    firsts = keys.where(F.col("_index") % records_per_shard == 0).select("page_id", "_tie").collect()
    bounds = sorted((row[0] is not None, row[0] or 0, row[1]) for row in firsts)
    revisit = (F.octet_length(html) >= revisit_bytes) & (F.coalesce(F.col("page_id") != F.col("_to"), F.col("_to").isNotNull()))
    joined = pages.join(small(groups, 160), F.col("_digest") == F.col("_key"), "left").select(
        "page_id", "url", "html", "_digest", "_tie", F.when(revisit, F.col("_to")).alias("_refers"), F.when(revisit, F.col("_refers_url")).alias("_refers_url"))
    members = joined.mapInArrow(_members(bounds), "shard int, page_id long, _tie long, member binary")
    count = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = members.repartition(max(1, min(count, len(bounds))), "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "_tie", "member")
    written = kept(shards.select("shard", "member").mapInArrow(_writer(folder, roll_bytes), MANIFEST), "warc-written")
    manifest = written.repartition(8, "name").mapInArrow(_commit(folder), MANIFEST)
    manifest.write.parquet(f"{folder.rstrip('/')}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")


def records_of(chunks):
    """Decompressed records of a stream of gzip members, one at a time."""
    unpacker, parts = zlib.decompressobj(31), []
    for data in chunks:
        while data:
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts = zlib.decompressobj(31), []
            else:
                break
    if any(parts):
        raise OSError("the archive ends within a record")


def parse_record(record: bytes) -> tuple[dict, bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    return headers, rest[: int(headers["Content-Length"])]


def _reader(folder: str):
    def read(batches):
        store, root = _store(folder)

        def chunks(name):
            with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                while data := stream.read(CHUNK):
                    yield data

        def rows(name):
            for record in records_of(chunks(name)):
                headers, block = parse_record(record)
                if headers["WARC-Type"] == "warcinfo":
                    continue
                if _digest(block) != headers["WARC-Block-Digest"]:
                    raise OSError(f"{name}: a block does not match its digest")
                http, _, payload = block.partition(b"\r\n\r\n")
                wanted = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if headers["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != wanted:
                    raise OSError(f"{name}: a payload does not match its digest")
                length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                own, to = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                yield (own and int(own), headers["WARC-Type"], to and int(to), headers["WARC-Target-URI"], length, wanted, name)

        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
        names = ("page_id", "record_type", "refers_to", "target_uri", "payload_bytes", "payload_digest", "file")

        def pack(found):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), types)], names=names)

        for batch in batches:
            for name in batch.column("name").to_pylist():
                found = []
                for row in rows(name):
                    found.append(row)
                    if len(found) == 5000:
                        yield pack(found)
                        found = []
                if found:
                    yield pack(found)

    return read


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files that the manifest in ``folder`` lists, with every digest verified.

    ``payload_bytes`` and ``payload_digest`` describe the full payload, also for revisits.
    """
    files = spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest").select("name")
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(count, "name").mapInArrow(_reader(folder), RECORDS)


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` into a fresh folder of the shared one and read them back."""
    folder = new_folder(pages.sparkSession, "warc")
    write_warc(pages, folder, **options)
    return read_warc(pages.sparkSession, folder)
