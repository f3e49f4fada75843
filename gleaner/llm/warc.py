"""WARC archives: a writer of gzipped records and a PySpark data source.

Every record is a gzip member of its own, so that common readers take the files
and any record can be read from its offset. Members carry the skip-lengths field
that the WARC standard describes: a reader inflates a record's headers and leaves
the rest where it is, if nothing asks for it. Payloads are never shuffled to be
written: which pages repeat is found on digests alone.

The reader plans a partition for each group of files, takes predicates on record
type and headers, parses the headers of a record first and skips payloads that
nothing asks for.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from gleaner.llm.common import cut, file_system, publish, scratch, ship, small_batches, tidy

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes of files that one partition reads; of one read of a file; and inflated at
#: once while headers are looked for, or while a payload is read.
PARTITION_BYTES, FILE_READ = 32 << 20, 256 << 10
HEADER_READ, PAYLOAD_READ = 2 << 10, 1 << 20
LEVEL = 6
#: Repeated payloads whose digests are sent to every task at most; beyond, pages are
#: joined with them by a shuffle that carries the payloads.
MOST_REPEATED = 500_000

#: Column -> header line; predicates may name any of them.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_length": "X-Payload-Length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_length bigint, block_length bigint, verified boolean, payload binary"
_ARROW = pa.schema([*((c, pa.string()) for c in ("record_type", "record_id", "target_uri", "payload_digest", "refers_to")), ("payload_length", pa.int64()), ("block_length", pa.int64()), ("verified", pa.bool_()), ("payload", pa.binary())])


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary or string column."""
    hexed = F.upper(F.sha1(data))
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def rated(pages: DataFrame, least_bytes: int = 0, most_repeated: int = MOST_REPEATED) -> DataFrame:
    """(id, url, html, digest, size, best) of each row of ``pages``; ``best`` is the
    largest id of the rows with this payload, if there are several.

    Digests are grouped as narrow rows, pre-aggregated, so a page that a third of all
    rows repeat costs a row for each task. The few that repeat go to every task up
    to ``most_repeated`` of them; beyond, a shuffle join that adaptive execution
    splits where one digest is hot.
    """
    html = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].cast("long").alias("id"), pages["url"].cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("html")), "size": F.octet_length("html").cast("long")})
    groups = rows.groupBy("digest", "size").agg(F.max("id").alias("best"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("size") >= least_bytes))
    best = cut(groups.select(F.col("digest").alias("d"), F.col("size").alias("z"), "best"), "warc-repeated")
    known = F.broadcast(best) if best.count() <= most_repeated else best
    joined = rows.join(known, (rows["digest"] == best["d"]) & (rows["size"] == best["z"]), "left")
    return joined.select("id", "url", "html", "digest", "size", "best", best["d"].isNotNull().alias("repeated"))


def gzip_member(data: bytes) -> bytes:
    """One gzip member with the skip-lengths field: its own and its content's length."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + struct.pack("<IBB", 0, 0, 255) + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, whole, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, record_id: str, date: str, url: str, digest: str, payload: bytes, refers_to: str | None = None, size: int | None = None) -> bytes:
    """One record. Responses hold an HTTP header and the payload; revisits the header alone."""
    n = len(payload) if size is None else size
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_urn(page_id: int) -> str:
    return f"urn:page:{page_id}"


def _writer(base: str, date: str, run_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name, out, n = f"part-{part:06d}.warc.gz", None, 0
        store, root = file_system(base)
        temporary = f"{root}/.{name}-{attempt}"
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("id", "url", "digest", "size", "best", "repeated")]
            for k, (page, url, digest, size, best, repeated) in enumerate(zip(*columns, strict=True)):
                if out is None:
                    out = store.open_output_stream(temporary)
                revisit = repeated and page != best
                # Pages without id have records of their own all the same.
                own = page_urn(page) if page is not None else uuid.uuid5(uuid.NAMESPACE_URL, f"{run_id}/{part}/{n}").urn
                url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
                refers_to = (page_urn(best) if best is not None else None) if revisit else None
                payload = b"" if revisit else b.column("html")[k].as_buffer().to_pybytes()
                out.write(gzip_member(record("revisit" if revisit else "response", own, date, url, digest, payload, refers_to, size)))
                n += 1
        if out is not None:
            out.close()
            publish(store, temporary, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["records"])

    return run


def write_warc(pages: DataFrame, path: str | None = None, least_bytes: int = 0, date: datetime.datetime | None = None, most_repeated: int = MOST_REPEATED) -> str:
    """Write a record for each row of ``pages`` (page_id, url, html); return the folder.

    Among rows with equal payloads of ``least_bytes`` or more, the one with the
    largest page_id is the response and the others revisit it without payload
    (rows that repeat this id too are responses; where all ids are null, all are).
    Null html is an empty payload; null ids count as smallest, and their records
    have a UUID; line ends in a URL are percent-encoded. Very long pages are one
    record. Other columns are not read. An empty table gives files without records,
    or none. ``date`` is that of all records, else now. Files are whole or absent.
    """
    spark = pages.sparkSession
    small_batches(spark)
    path = path or scratch(spark, "warc")
    store, root = file_system(path)
    store.create_dir(root, recursive=True)
    stamp = (date or datetime.datetime.now(datetime.UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    rated(pages, least_bytes, most_repeated).mapInArrow(tidy(_writer(path, stamp, uuid.uuid4().hex)), "records long").agg(F.sum("records")).collect()
    return path


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class Inflated:
    """The content of a file, inflated as far as it is read, member by member.

    ``left`` is the content of the current member that is not read yet, where the
    member says so; ``skip`` goes on to the next one without inflating that.
    ``inflated`` counts the bytes that were."""

    def __init__(self, file):
        self.file, self.held, self.inflated = file, b"", 0
        self.packer, self.left, self.rest = None, None, None
        self.plain = not self._fill(2) or self.held[:2] != b"\x1f\x8b"

    def _fill(self, n: int) -> bool:
        while len(self.held) < n:
            data = self.file.read(FILE_READ)
            if not data:
                return False
            self.held += data
        return True

    def _open(self) -> bool:
        """Begin the next member."""
        if not self._fill(1):
            return False
        if not self._fill(18) or self.held[:2] != b"\x1f\x8b":
            raise ValueError("a WARC file ends inside a gzip member")
        self.left = self.rest = None
        if self.held[3] == 4 and self.held[10:14] == b"\x0c\x00sl":
            self._fill(24)
            whole, self.left = struct.unpack_from("<II", self.held, 16)
            self.rest = whole
        self.packer = zlib.decompressobj(31)
        return True

    def _take(self, n: int) -> None:
        """Drop ``n`` bytes of the file."""
        drop = min(n, len(self.held))
        self.held, n = self.held[drop:], n - drop
        if n:
            self.file.seek(n, 1)

    def read(self, n: int) -> bytes:
        """Up to ``n`` bytes, within one member; none at the end of the file."""
        if self.plain:
            data = self.held[:n] if self.held else self.file.read(n)
            self.held = self.held[n:] if self.held else b""
            self.inflated += len(data)
            return data
        while True:
            if self.packer is None and not self._open():
                return b""
            if not self.packer.unconsumed_tail and not self.held and not self._fill(1):
                raise ValueError("a WARC file ends inside a gzip member")
            given = self.held
            data = self.packer.decompress(given, n)
            used = len(given) - len(self.packer.unconsumed_tail) - len(self.packer.unused_data)
            self.held = self.packer.unused_data if self.packer.eof else self.packer.unconsumed_tail
            if self.rest is not None:
                self.rest -= used
                self.left -= len(data)
            if self.packer.eof:
                self.packer = self.left = self.rest = None
            self.inflated += len(data)
            if data:
                return data

    def skip(self) -> None:
        """On to the next member; only where ``left`` is known."""
        self._take(self.rest)
        self.packer = self.left = self.rest = None


class Archive:
    """Records of one file, in order: headers, then the payload on demand."""

    def __init__(self, file):
        self.file, self.held, self.at = file if isinstance(file, Inflated) else Inflated(file), b"", 0

    def _more(self, n: int) -> bool:
        data = self.file.read(n)
        self.held = self.held[self.at :] + data
        self.at = 0
        return bool(data)

    def _lines(self) -> list[str] | None:
        while (end := self.held.find(b"\r\n\r\n", self.at)) < 0:
            if not self._more(HEADER_READ):
                return None
        lines = self.held[self.at : end].decode("utf-8").split("\r\n")
        self.at = end + 4
        return lines

    def headers(self) -> dict[str, str] | None:
        lines = self._lines()
        if lines is None:
            if self.held[self.at :].strip():
                raise ValueError("a WARC file ends inside a header")
            return None
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record starts with {lines[0][:40]!r}")
        out: dict[str, str] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            out[name.strip().lower()] = value.strip()
        return out

    def block(self, n: int, want: bool) -> bytes | None:
        """The next ``n`` bytes and the two line ends after them; without ``want``
        the rest of a member that they fill is not inflated."""
        need, parts = n, []
        while True:
            if not want and self.file.left and need + 4 == len(self.held) - self.at + self.file.left:
                self.file.skip()
                self.held, self.at = b"", 0
                return None
            have = self.held[self.at : self.at + need]
            if want and have:
                parts.append(have)
            self.at += len(have)
            need -= len(have)
            if not need:
                break
            if not self._more(min(PAYLOAD_READ, need + 4)):
                raise ValueError("a WARC file ends inside a payload")
        while len(self.held) - self.at < 4 and self._more(4):
            pass
        if self.held[self.at : self.at + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record does not end with two line ends")
        self.at += 4
        return b"".join(parts) if want else None


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block, without the HTTP header where there is one."""
    if headers.get("content-type", "").startswith("application/http"):
        head, ends, body = block.partition(b"\r\n\r\n")
        return body if ends else b""
    return block


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.listing = options.get("path", "")
        self.verify = options.get("verify", "false").lower() == "true"
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.tests = [(c, set(v)) for c, v in json.loads(options.get("predicates", "{}")).items()]
        self.inflated = 0  # bytes, for tests of what is skipped
        if unknown := {c for c, _ in self.tests} - set(HEADERS):
            raise ValueError(f"no header columns: {sorted(unknown)}")

    def partitions(self) -> list[InputPartition]:
        store, root = file_system(self.listing)
        found = store.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((f for f in found if f.type == pafs.FileType.File and f.size and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        out: list[_Files] = []
        held = self.partition_bytes + 1
        for f in files:
            if held + f.size > self.partition_bytes:
                out.append(_Files([]))
                held = 0
            out[-1].paths.append(f.path)
            held += f.size
        return out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.listing)
        rows: list[list] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

        for path in partition.paths:
            with store.open_input_file(path) as f:
                archive = Archive(f)
                while (h := archive.headers()) is not None:
                    n = int(h.get("content-length", "0"))
                    own = {c: h.get(name.lower()) for c, name in HEADERS.items()}
                    for c in ("record_id", "refers_to"):
                        own[c] = own[c].strip("<>") if own[c] else None
                    if own["payload_digest"]:
                        own["payload_digest"] = own["payload_digest"].removeprefix("sha1:")
                    if not all(own[c] in v for c, v in self.tests):
                        archive.block(n, False)
                        continue
                    check = self.verify and own["record_type"] == "response"
                    want = self.with_payload or check or own["payload_length"] is None
                    data = archive.block(n, want)
                    good = None
                    if want:
                        data = payload_of(h, data)
                    if check:
                        good = base64.b32encode(hashlib.sha1(data).digest()).decode() == own["payload_digest"]
                        if not good:
                            raise ValueError(f"{own['record_id']}: the payload has another digest")
                    length = int(own["payload_length"]) if own["payload_length"] is not None else len(data)
                    data = data if self.with_payload else None
                    rows.append([own["record_type"], own["record_id"], own["target_uri"], own["payload_digest"], own["refers_to"], length, n, good, data])
                    held += 500 + len(data or b"")
                    if len(rows) >= 2000 or held >= 8 << 20:
                        yield batch()
                        rows, held = [], 0
                self.inflated += archive.file.inflated
        if rows:
            yield batch()


class PushingReader(WarcReader):
    """Takes equality tests of Catalyst's on header columns, too."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in HEADERS and column != "payload_length":
                self.tests.append((column, set(f.value) if isinstance(f, In) else {f.value}))
            else:
                yield f


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; options: ``predicates``, JSON
    of column -> permitted values, tested on headers before the payload is
    touched; ``verify`` compares response payloads with their digests;
    ``payload`` false leaves payloads out; ``partitionBytes`` bounds the files of
    a partition; ``pushdown`` takes Catalyst's filters.

    Spark 4.1 makes one reader for all queries on a DataFrame and keeps in it the
    filters pushed last, so that a second filter changes results of the first (a
    test shows it). So ``pushdown`` is for DataFrames that a single query reads, and
    ``predicates`` serve all others.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        options = dict(self.options)
        return PushingReader(options) if options.get("pushdown", "false").lower() == "true" else WarcReader(options)


def read_warc(spark: SparkSession, path: str, verify: bool = False, payload: bool = True, pushdown: bool = False, **predicates: str | list[str]) -> DataFrame:
    """Records of all files below ``path`` (any store that pyarrow opens), gzipped or not.

    ``predicates`` name header columns with the value or values wanted, such as
    ``record_type="response"``; they are tested inside the source. With ``pushdown``
    filters of the one query on this DataFrame are, too. Headers are parsed first;
    payloads that nothing asks for are skipped, and not inflated where their gzip
    member gives its length. A folder without records gives no rows.
    """
    ship(spark)
    spark.dataSource.register(WarcSource)
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # concerns sources that take filters only
    wanted = {c: [v] if isinstance(v, str) else list(v) for c, v in predicates.items()}
    reader = spark.read.format("warc").option("verify", str(verify).lower()).option("payload", str(payload).lower()).option("pushdown", str(pushdown).lower())
    return reader.option("predicates", json.dumps(wanted)).load(path)


def page_id_of(record_id: Column) -> Column:
    """The id in ``urn:page:N``; null for other names."""
    return F.regexp_extract(record_id, r"^urn:page:(.*)$", 1).try_cast("long")
