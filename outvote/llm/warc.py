"""WARC archives with a two-level capture index.

Tasks write WARC 1.1 files of one gzip member a record. Captures are range-partitioned and sorted by
their reversed-host URL key; each partition is an index file of compressed blocks of ``BLOCK`` captures,
ended by a sparse directory (the first key of each block and where it lies). The driver knows the first and last
key of each index file, one row a file; a lookup deals its keys to the files they can be in, and a task
binary-searches the directory, reads only the blocks it needs by byte range, and
binary-searches in them. Records are then read by byte range, in the order of their place.

Files lie below ``spark.checkpoint.dir`` and are reached through pyarrow's file systems (local and shared
mounts, HDFS, object stores). A task that is run again writes files of other names; the list of files
is the staged result of the attempts that succeeded, so lost executors leave at most unused files.
"""

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import new_path, stage, written
from .url_cascade import host_and_path

BLOCK = 1000  # captures a block of an index file
INDEX_ROWS = 1_000_000  # captures an index file, about
ROLL_BYTES = 1 << 30  # a task begins a new WARC file beyond
READ_BYTES = 128 << 20  # of archives a reading task, about
_JOINED = 4 << 20  # neighbouring records are read together up to this size
_CRLF = b"\r\n"


def url_key(url: Column) -> Column:
    """``com,example,blog)/path?query``: host labels reversed, fragment dropped; empty for null or odd urls."""
    host, path = host_and_path(url)
    behind = F.regexp_extract(F.substr(url, F.instr(url, "://") + 3), r"^[^?#]*(\?[^#]*)", 1)
    labels = F.concat_ws(",", F.reverse(F.split(host, r"\.")))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.concat(labels, F.lit(")"), path, behind)).otherwise("")


def _record_id(page_id):
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(record_id: str):
    number = record_id.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def record(page_id, url, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record, not compressed; a revisit holds no payload but its size and digest."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "text/html; charset=utf-8"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        fields += [("WARC-Refers-To", _record_id(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    body = b"" if revisit else payload
    fields.append(("Content-Length", str(len(body))))
    head = b"".join(f"{k}: {v}".encode() + _CRLF for k, v in fields)
    return b"WARC/1.1" + _CRLF + head + _CRLF + body + _CRLF * 2


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; raises if it is not whole."""
    head, _, rest = data.partition(_CRLF * 2)
    version, *lines = head.split(_CRLF)
    if not version.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    fields = {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
    n = int(fields["content-length"])
    if rest[n:] != _CRLF * 2:
        raise ValueError("a record is cut short")
    return fields, rest[:n]


def _file_system(base: str):
    return fs.FileSystem.from_uri(base)


def _gzip(data: bytes) -> bytes:
    made = zlib.compressobj(4, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``page_id, digest, refers_to`` of the records that repeat a payload of at least ``least_bytes``.

    The record with the largest page_id of a payload is the response (rows that share that id with the
    payload all are); a null id is never the largest. Only ids and digests are shuffled.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), _digest().alias("digest"), F.octet_length(_payload()).alias("size"))
    rows = rows.filter(F.col("size") >= least_bytes)
    last = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null")
    found = rows.join(last.select("digest", "refers_to"), "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return found.select("page_id", "digest", "refers_to").distinct()


def _payload():
    return F.coalesce(F.col("html").cast("string"), F.lit(""))


def _digest():
    return F.sha2(_payload().cast("binary"), 256)


@dataclass
class Archive:
    """WARC files and index files below ``base``; ``files`` has one ``(name, first key, last key)`` an index file."""

    base: str
    files: list[tuple[str, str, str]]

    def lookup(self, queries: DataFrame) -> DataFrame:
        """``key, page_id, warc, offset, length`` of every capture of the urls in ``queries`` (column ``url``).

        Equal queries count once; urls that were not captured give nothing; null and odd urls have the empty key.
        """
        base, files = self.base, sorted(self.files, key=lambda f: (f[1], f[2]))
        lasts = [f[2] for f in files]  # ascending as well: files are ranges of one order

        def route(batches):
            for batch in batches:
                names, keys = [], []
                for key in batch.column(0).to_pylist():
                    i = bisect.bisect_left(lasts, key)
                    while i < len(files) and files[i][1] <= key:
                        names.append(files[i][0])
                        keys.append(key)
                        i += 1
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys, pa.string())], names=["file", "key"])

        def search(batches):
            system, top = _file_system(base)
            name = index = None
            for batch in batches:
                found = []
                for file, key in zip(batch.column("file").to_pylist(), batch.column("key").to_pylist()):
                    if file != name:
                        name, index = file, IndexFile(system, f"{top}/{file}")
                    found += index.captures(key)
                columns = list(zip(*found)) if found else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page_id", "warc", "offset", "length"])

        keys = queries.select(url_key(F.col("url").cast("string")).alias("key")).distinct()
        routed = keys.mapInArrow(route, "file string, key string")
        # the number of partitions is left to the session: files are whole ranges of keys
        dealt = routed.repartition(F.col("file")).sortWithinPartitions("file", "key")
        out = dealt.mapInArrow(search, "key string, page_id long, warc string, offset long, length long")
        return out.select(F.lit(base).alias("base"), "*")


class IndexFile:
    """Reads one index file: its directory once, then single blocks by byte range."""

    def __init__(self, system, path):
        self.file = system.open_input_file(path)
        size = self.file.size()
        length = int.from_bytes(self.file.read_at(8, size - 8), "big")
        self.directory = json.loads(zlib.decompress(self.file.read_at(length, size - 8 - length)))
        self.firsts = [d[0] for d in self.directory]
        self.held = None, None

    def _block(self, i):
        if self.held[0] != i:
            _, offset, length = self.directory[i]
            self.held = i, json.loads(zlib.decompress(self.file.read_at(length, offset)))
        return self.held[1]

    def captures(self, key: str):
        """All captures of a key: from the last block that begins before it, as far as blocks begin with it."""
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.firsts) and self.firsts[i] <= key:
            block = self._block(i)
            at = bisect.bisect_left(block, key, key=lambda c: c[0])
            while at < len(block) and block[at][0] == key:
                yield tuple(block[at])
                at += 1
            i += 1


def _write_records(base):
    def run(batches):
        system, top = _file_system(base)
        system.create_dir(top, recursive=True)
        sink, name, at = None, None, 0
        for batch in batches:
            rows = []
            for page, url, html, key, refers, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "key", "refers_to", "revisit"))):
                if sink is None or at > ROLL_BYTES:
                    if sink is not None:
                        sink.close()
                    name, at = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
                    sink = system.open_output_stream(f"{top}/{name}", compression=None)
                data = _gzip(record(page, url, html.encode(), refers, revisit))
                sink.write(data)
                rows.append((key, page, name, at, len(data)))
                at += len(data)
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page_id", "warc", "offset", "length"])
        if sink is not None:
            sink.close()

    return run


def _write_index(base):
    def run(batches):
        system, top = _file_system(base)
        name = f"index-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.idx"
        sink, directory, block, at, last = None, [], [], 0, None

        def put():
            nonlocal sink, block, at
            if sink is None:
                sink = system.open_output_stream(f"{top}/{name}", compression=None)
            data = zlib.compress(json.dumps(block).encode())
            sink.write(data)
            directory.append((block[0][0], at, len(data)))
            at += len(data)
            block = []

        for batch in batches:
            for capture in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "warc", "offset", "length"))):
                block.append(capture)
                last = capture[0]
                if len(block) == BLOCK:
                    put()
        if block:
            put()
        if sink is not None:
            data = zlib.compress(json.dumps(directory).encode())
            sink.write(data + len(data).to_bytes(8, "big"))
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (name, directory[0][0], last)], names=["file", "first", "last"])

    return run


def write_archive(pages: DataFrame, least_bytes: int = 0) -> Archive:
    """Writes one record for each row of ``pages`` (``page_id, url, html``) and the index over them.

    The payload is the html in UTF-8, null as empty. Of records with equal payloads of at least
    ``least_bytes`` the one with the largest page_id is a response, the others are revisits of it; see ``revisits``
    for null and repeated ids. Pages have no capture time, so WARC-Date is the epoch. Repeated rows are records of their own. Other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _payload().alias("html"))
    repeat = stage(revisits(rows, least_bytes)).withColumnsRenamed({"page_id": "p", "digest": "d"})
    rows = rows.withColumn("key", url_key(F.col("url"))).withColumn("digest", _digest())
    rows = rows.join(repeat, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    rows = rows.select("page_id", "url", "html", "key", "refers_to", F.col("d").isNotNull().alias("revisit"))
    base = new_path(spark)
    captures = stage(rows.mapInArrow(_write_records(base), "key string, page_id long, warc string, offset long, length long"))
    written(spark, base)
    parts = max(spark.sparkContext.defaultParallelism, -(-captures.count() // INDEX_ROWS))
    order = ["key", "page_id", "warc", "offset"]
    ordered = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    files = stage(ordered.mapInArrow(_write_index(base), "file string, first string, last string"))
    return Archive(base, [tuple(r) for r in files.collect()])  # one row an index file


def read_records(spark: SparkSession, captures: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each capture, read from its WARC file.

    Responses are hashed anew; a digest or size that differs from the header is an error. ``captures`` is staged first, and read
    in ranges of files and offsets by one task for each READ_BYTES of records.
    """

    def run(batches):
        name = file = None
        pending: list = []

        def read():
            begin = pending[0][0]
            data = file.read_at(pending[-1][0] + pending[-1][1] - begin, begin)
            rows = [_record_row(data[at - begin : at - begin + n]) for at, n in pending]
            pending.clear()
            return rows

        for batch in batches:
            rows = []
            for base, warc, at, n in zip(*(batch.column(c).to_pylist() for c in ("base", "warc", "offset", "length"))):
                if pending and ((base, warc) != name or at != sum(pending[-1]) or at + n - pending[0][0] > _JOINED):
                    rows += read()
                if (base, warc) != name:
                    system, top = _file_system(base)
                    name, file = (base, warc), system.open_input_file(f"{top}/{warc}")
                pending.append((at, n))
            if pending:
                rows += read()
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    captures = stage(captures.select("base", "warc", "offset", "length"))
    size = captures.agg(F.sum("length")).first()[0] or 0
    # a number of its own, as rows of some bytes stand for whole records and would be joined into few partitions
    parts = max(spark.sparkContext.defaultParallelism, -(-size // READ_BYTES))
    dealt = captures.repartitionByRange(parts, "warc", "offset").sortWithinPartitions("warc", "offset")
    return dealt.select("base", "warc", "offset", "length").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def _record_row(data: bytes):
    fields, body = parse(zlib.decompress(data, 31))
    digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
    refers = fields.get("warc-refers-to")
    if fields["warc-type"] == "response" and (base64.b32encode(hashlib.sha1(body).digest()).decode() != digest or len(body) != size):
        raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
    return _page_of(fields["warc-record-id"]), size, digest, fields["warc-type"], _page_of(refers) if refers else None
