"""WARC archives with an index that is written first.

The index (archive, offset, length, url, digest per record) follows from the records' sizes, so it is computed and
stored before any archive is written. Every record is a gzip member of its own. Page bodies are compressed where they
are read and move once, to the task that writes their archive; the index alone is shuffled by digest. Archives are read
back by sorted byte ranges, neighbouring ranges being read at once.
"""

from __future__ import annotations

import collections
import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

END = b"\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
LEVEL = 2  # of compression
BLOCK = 65535  # bytes of a stored block of a gzip member at most
MEMBER = 10 + 5 + len(END) + 8  # a member's own bytes: head, last block, checksum and size
HELD = 16 << 20  # bytes of payloads that a reader hands on at once
INDEX_SCHEMA = "archive int, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long, payload_bytes long"
_ORDER = ("archive", "page_id", "url", "digest")


def deflated(payload: bytes) -> bytes:
    """``payload`` as deflate blocks that end on a byte and aren't the last ones."""
    work = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    return work.compress(payload) + work.flush(zlib.Z_SYNC_FLUSH) if payload else b""


def member(head: bytes, packed: bytes) -> bytes:
    """A gzip member of ``head``, the payload that ``packed`` holds and the record's end."""
    payload = zlib.decompressobj(-15).decompress(packed) if packed else b""
    stored = [struct.pack("<BHH", 0, len(x), len(x) ^ BLOCK) + x for at in range(0, len(head), BLOCK) for x in [head[at : at + BLOCK]]]
    last = struct.pack("<BHH", 1, len(END), len(END) ^ BLOCK) + END
    check = zlib.crc32(END, zlib.crc32(payload, zlib.crc32(head)))
    return b"".join([b"\x1f\x8b\x08\0\0\0\0\0\0\xff", *stored, packed, last, struct.pack("<II", check, (len(head) + len(payload) + len(END)) % 2**32)])


def _plain(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\r\n]+", " ").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    )


def _bodies(pages: DataFrame, sizes: bool) -> DataFrame:
    """page_id, url, digest and either the sizes of the payload, plain and compressed, or the compressed payload."""

    def work(batches):
        for batch in batches:
            digest, plain, packed = [], [], []
            for x in batch.column(2):
                raw = x.as_buffer().to_pybytes()
                digest.append(hashlib.sha256(raw).hexdigest())
                plain.append(len(raw))
                z = deflated(raw)
                packed.append(len(z) if sizes else z)
            more = [pa.array(plain, pa.int64()), pa.array(packed, pa.int64())] if sizes else [pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.string()), *more], names=["page_id", "url", "digest", *(["payload_bytes", "packed"] if sizes else ["body"])])

    return _plain(pages).mapInArrow(common.returning(work), "page_id long, url string, digest string, " + ("payload_bytes long, packed long" if sizes else "body binary"))


def _archive(archives: int):
    return F.pmod(F.xxhash64("page_id", "url", "digest"), F.lit(archives)).cast("int")


def _sized(pages: DataFrame, archive_bytes: int) -> tuple[DataFrame, int]:
    known = common.stored(_bodies(pages, True), "warc-sizes")
    total = known.agg(F.sum(F.col("packed") + 600)).first()[0] or 0
    return known, max(1, -(-total // archive_bytes))


def _placed(base: DataFrame, archives: int, least: int) -> DataFrame:
    first = base.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = base.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    known = known.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    end = END.decode()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(end))
    response = F.col("record_type") == "response"
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), name("page_id"),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(response, F.lit("")).otherwise(F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name("refers_to"))),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(response, F.col("payload_bytes")).otherwise(0)).cast("string"), F.lit(end), http,
    )
    size = F.octet_length("head")
    length = MEMBER + size + 5 * F.ceil(size / BLOCK) + F.when(response, F.col("packed")).otherwise(0)
    sized = known.withColumn("head", head).withColumn("length", length.cast("long")).withColumn("archive", _archive(archives))
    order = Window.partitionBy("archive").orderBy("page_id", "url", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0))).select(*[c.split()[0] for c in INDEX_SCHEMA.split(", ")], "head")


def index(pages: DataFrame, least: int = 100, archive_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``, with the record's head in ``head``.

    Of equal payloads (UTF-8 of html, null: empty) of at least ``least`` bytes, the smallest page_id is the response and
    the others are revisits of it; shorter payloads are all responses. Rows that repeat a page_id are told apart
    by url and payload; a repeated response row stays a response. A null page_id counts as the largest, so it is a
    response only where all of its payload are null. An empty table gives an empty index. Other columns are ignored.
    Lengths are those of compressed records, so all executors must run one version of zlib; writing fails otherwise.
    """
    known, archives = _sized(pages, archive_bytes)
    return _placed(known, archives, least)


def _file(path: str, archive: int) -> str:
    return f"{path}/archives/{archive:07d}.warc.gz"


def write(pages: DataFrame, path: str, least: int = 100, archive_bytes: int = 32 << 20) -> DataFrame:
    """Write the index and then the archives under ``path``; returns the stored index.

    A task writes whole archives under names of its own and renames them when they are complete; what they hold follows
    from the index, so a task that is run again, or twice, leaves the same files.
    """
    spark = pages.sparkSession
    known, archives = _sized(pages, archive_bytes)
    _placed(known, archives, least).write.parquet(f"{path}/index")
    common.drop(known)
    stored = spark.read.schema(f"{INDEX_SCHEMA}, head string").parquet(f"{path}/index")
    heads = stored.select(*_ORDER, F.lit(0).alias("kind"), "offset", "length", "record_type", "head", F.lit(None).cast("binary").alias("body"))
    bodies = _bodies(pages, False).withColumn("archive", _archive(archives))
    none = F.lit(None)
    bodies = bodies.select(*_ORDER, F.lit(1).alias("kind"), none.cast("long").alias("offset"), none.cast("long").alias("length"), none.cast("string").alias("record_type"), none.cast("string").alias("head"), "body")

    def put(batches):
        system, now, out, at, sizes = None, None, None, 0, []
        attempt = TaskContext.get().taskAttemptId()
        due: collections.deque = collections.deque()

        def close():
            out.close()
            if due:
                raise ValueError(f"archive {now}: records without pages")
            name, own = _path(_file(path, now)), _path(f"{_file(path, now)}.{attempt}")
            try:
                system.move(own, name)
            except OSError:  # some stores don't replace files
                if system.get_file_info(name).size != at:
                    raise
                system.delete_file(own)
            sizes.append((now, at))

        for batch in batches:
            archive, kind, offset, length, record_type, head = (batch.column(i).to_pylist() for i in (0, 4, 5, 6, 7, 8))
            for i in range(batch.num_rows):
                if archive[i] != now:
                    if out is not None:
                        close()
                    now, at = archive[i], 0
                    system = _system(path)
                    system.create_dir(_path(f"{path}/archives"), recursive=True)
                    out = system.open_output_stream(_path(f"{_file(path, now)}.{attempt}"))
                if kind[i] == 0:  # the index's rows of equal pages stand before these
                    due.append((offset[i], length[i], record_type[i], head[i]))
                    continue
                start, size, sort, text = due.popleft()
                record = member(text.encode(), batch.column(9)[i].as_py() if sort == "response" else b"")
                if (start, size) != (at, len(record)):
                    raise ValueError(f"archive {now}: a record of {len(record)} bytes at {at}; the index has {size} at {start}")
                out.write(record)
                at += size
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in sizes], pa.int32()), pa.array([s for _, s in sizes], pa.int64())], names=["archive", "bytes"])

    rows = heads.unionByName(bodies).repartition(2 * archives, "archive").sortWithinPartitions(*_ORDER, "kind")
    written = rows.mapInArrow(common.returning(put), "archive int, bytes long").agg(F.sum("bytes")).first()[0] or 0
    wanted = stored.agg(F.sum("length")).first()[0] or 0
    if written != wanted:
        raise ValueError(f"{written} bytes of archives; the index has {wanted}")
    return stored.drop("head")


def _uri(path: str) -> str:
    return path.replace(":/", ":///", 1) if "://" not in path and ":/" in path else path


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(_uri(path))[0]


def _path(path: str) -> str:
    from pyarrow import fs

    return fs.FileSystem.from_uri(_uri(path))[1]


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = record.partition(END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, block[: int(fields["Content-Length"])]


def read(selected: DataFrame, path: str, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """Records of the rows of an index, by byte ranges of the archives.

    Ranges of an archive are sorted; those at most ``gap`` bytes apart are read at once, up to ``most`` bytes.
    Returns page_id, url, record_type, refers_to, digest (as in the record), payload_bytes, payload (bytes; null for
    revisits). Null page_ids and urls come back as null and empty; a row selected twice gives its record twice; no rows
    give none. A payload that doesn't match its digest raises an error.
    """
    parts = max(1, -(-(selected.agg(F.sum("length")).first()[0] or 0) // (4 * most)))
    sort = selected.select("archive", "offset", "length").repartition(parts, "archive", F.floor(F.col("offset") / most)).sortWithinPartitions("archive", "offset")
    names = ["page_id", "url", "record_type", "refers_to", "digest", "payload_bytes", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    own = lambda x: int(x[10:-1]) if len(x) > 11 else None

    def record(data: bytes, where: str) -> tuple:
        fields, block = _parse(zlib.decompress(data, 31))
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
        payload = block.partition(END)[2] if kind == "response" else None
        if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{where}: payload doesn't match its digest")
        length = int(block.partition(b"Content-Length: ")[2].partition(b"\r\n")[0])
        return own(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, own(fields.get("WARC-Refers-To", "")), digest, length, payload

    def take(batches):
        system, file, now, out, held = _system(path), None, None, [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            where, at, size = (batch.column(i).to_pylist() for i in range(3))
            i = 0
            while i < len(where):
                j, end = i + 1, at[i] + size[i]
                while j < len(where) and where[j] == where[i] and at[j] - end <= gap and at[j] + size[j] - at[i] <= most:
                    end, j = max(end, at[j] + size[j]), j + 1
                if where[i] != now:
                    if file is not None:
                        file.close()
                    now, file = where[i], system.open_input_file(_path(_file(path, where[i])))
                file.seek(at[i])
                data = file.read(end - at[i])
                for k in range(i, j):
                    out.append(record(data[at[k] - at[i] : at[k] - at[i] + size[k]], f"archive {now} at {at[k]}"))
                    held += len(out[-1][-1] or b"") + 200
                    if held > HELD:
                        yield made()
                        out, held = [], 0
                i = j
        if file is not None:
            file.close()
        if out:
            yield made()

    return sort.mapInArrow(common.returning(take), "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "warc")
    stored = write(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read(stored, path).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first IS NOT NULL AND d.page_id <> f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first IS NOT NULL AND d.page_id <> f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
