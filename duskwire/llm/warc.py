"""WARC archives as a Spark data source, read and written with header push-down."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from duskwire.llm.common import broadcast_if_small, staged

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, content_type string, payload_digest string, refers_to string, payload_length long, headers map<string,string>, payload binary"
WRITE_SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_length long, payload binary"
#: Columns that stand for one header each.
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "content_type": "content-type",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
LENGTH_HEADER = "WARC-X-Payload-Length"
MANIFEST = "_manifest.json"
SPLIT_BYTES = 64 << 20
CHUNK = 1 << 20


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _clean(value: str) -> str:
    """A header's value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row) -> bytes:
    """One WARC/1.1 record. A response's block is an HTTP message; a revisit has none."""
    body = b""
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["warc_date"]), ("WARC-Target-URI", row["target_uri"]), ("WARC-Refers-To", row["refers_to"])]
    if row["payload_digest"] is not None:
        head.append(("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"))
    if row["payload_length"] is not None:
        head.append((LENGTH_HEADER, str(row["payload_length"])))
    if row["record_type"] == "revisit":
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    else:
        raw = bytes(row["payload"] or b"")
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(raw) + raw
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    lines = "".join(f"{k}: {_clean(v)}\r\n" for k, v in head if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + body + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    name: str = ""
    cuts: tuple[int, ...] = ()
    size: int = 0


class WarcWriter(DataSourceWriter):
    """One file per task, a gzip member per record. Only files that the manifest
    names are read, and it is written at commit, so what a lost or repeated task
    leaves behind is never seen."""

    def __init__(self, path: str, level: int):
        self.path, self.level = path, level

    def write(self, iterator):
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        cuts, at, last = [0], 0, 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for row in iterator:
                if at - last >= SPLIT_BYTES:
                    cuts.append(at)
                    last = at
                z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                raw = z.compress(record_bytes(row)) + z.flush()
                out.write(raw)
                at += len(raw)
        return Written(name, tuple(cuts), at)

    def abort(self, messages):
        """Files of the tasks that did finish; those of failed tasks are never named by a manifest."""
        fs, root = _fs(self.path)
        for m in messages:
            if m is not None and fs.get_file_info(f"{root}/{m.name}").is_file:
                fs.delete_file(f"{root}/{m.name}")

    def commit(self, messages):
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        files = [{"name": m.name, "cuts": list(m.cuts), "size": m.size} for m in messages if m is not None and m.size]
        if fs.get_file_info(f"{root}/{MANIFEST}").is_file:
            with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
                files = json.loads(f.read()) + files
        with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(files).encode())


@dataclass
class Split(InputPartition):
    file: str
    start: int
    end: int

    def __post_init__(self):
        super().__init__(f"{self.file}:{self.start}")


class _Stream:
    """Sequential reader over one split, plain or gzip; what is skipped is not kept."""

    def __init__(self, f, start: int, end: int, packed: bool):
        self.f, self.at, self.end, self.packed = f, start, end, packed
        self.buf, self.z = b"", None
        f.seek(start)

    def _more(self) -> bool:
        if not self.packed:
            raw = self.f.read(min(CHUNK, self.end - self.at))
            self.at += len(raw)
            self.buf += raw
            return bool(raw)
        while True:
            left = self.z.unused_data if self.z is not None and self.z.eof else b""
            if self.z is None or self.z.eof:
                self.z = zlib.decompressobj(31)
            raw = left
            if not raw:
                raw = self.f.read(min(CHUNK, self.end - self.at))
                self.at += len(raw)
                if not raw:
                    return False
            got = self.z.decompress(raw)
            if got:
                self.buf += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        scan = 0
        while (k := self.buf.find(mark, scan)) < 0:
            scan = max(0, len(self.buf) - len(mark))
            if not self._more():
                return None
        out, self.buf = self.buf[:k], self.buf[k + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [], 0
        while have + len(self.buf) < n:
            parts.append(self.buf)
            have += len(self.buf)
            self.buf = b""
            if not self._more():
                raise EOFError("a record is cut short")
        parts.append(self.buf[: n - have])
        self.buf = self.buf[n - have :]
        return b"".join(parts)

    def skip(self, n: int) -> None:
        """Pass over ``n`` bytes: by a seek in a plain file, by inflating and dropping in a packed one."""
        while n > len(self.buf):
            n -= len(self.buf)
            self.buf = b""
            if not self.packed and n > CHUNK:
                self.at += n
                self.f.seek(self.at)
                return
            if not self._more():
                raise EOFError("a record is cut short")
        self.buf = self.buf[n:]


def _header_map(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    key = None
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and key:  # a folded line
            out[key] += " " + line.strip()
        elif ":" in line:
            key, _, value = line.partition(":")
            key = key.strip().lower()
            out[key] = value.strip()
    return out


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, verify: bool):
        self.path, self.payload, self.verify = path, payload, verify
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Take predicates on header columns; they are tested before a block is read."""
        for f in filters:
            col = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if col not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((col, "in", frozenset([f.value])))
            elif isinstance(f, In):
                self.tests.append((col, "in", frozenset(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((col, "starts", f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append((col, "set", None))
            else:
                yield f

    def partitions(self):
        """A split per stretch of records that the manifest marks, or per file where there is none."""
        fs, root = _fs(self.path)
        info = fs.get_file_info(root)
        if info.is_file:
            return [Split(root, 0, info.size)]
        if fs.get_file_info(f"{root}/{MANIFEST}").is_file:
            with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
                files = json.loads(f.read())
            return [Split(f"{root}/{x['name']}", s, e) for x in files for s, e in zip(x["cuts"], [*x["cuts"][1:], x["size"]], strict=True)]
        from pyarrow.fs import FileSelector

        found = [x for x in fs.get_file_info(FileSelector(root, recursive=True)) if x.is_file and x.path.endswith((".warc", ".warc.gz"))]
        return [Split(x.path, 0, x.size) for x in sorted(found, key=lambda x: x.path)]

    def _wanted(self, columns: dict) -> bool:
        for col, kind, arg in self.tests:
            v = columns[col]
            if v is None or (kind == "in" and v not in arg) or (kind == "starts" and not v.startswith(arg)):
                return False
        return True

    def _columns(self, head: dict[str, str]) -> dict:
        out = {c: head.get(h) for c, h in HEADERS.items()}
        if out["payload_digest"]:
            out["payload_digest"] = out["payload_digest"].removeprefix("sha1:")
        n = head.get(LENGTH_HEADER.lower())
        out["payload_length"] = int(n) if n and n.isdigit() else None
        return out

    def _records(self, part: Split):
        fs, _ = _fs(self.path)
        with fs.open_input_file(part.file) as f:
            s = _Stream(f, part.start, part.end, part.file.endswith(".gz"))
            while (raw := s.until(b"\r\n\r\n")) is not None:
                raw = raw.lstrip(b"\r\n")
                if not raw.startswith(b"WARC/"):
                    raise ValueError(f"{part.file}: no record where one should start")
                head = _header_map(raw)
                if not head.get("content-length", "").isdigit():
                    raise ValueError(f"{part.file}: a record without Content-Length")
                size = int(head["content-length"])
                row = self._columns(head)
                if not self._wanted(row):
                    s.skip(size + 4)
                    continue
                row |= {"headers": head, "payload": None}
                if self.payload and row["record_type"] != "revisit":
                    block = s.take(size)
                    s.skip(4)
                    row["payload"] = block.partition(b"\r\n\r\n")[2] if "application/http" in (row["content_type"] or "") else block
                    row["payload_length"] = len(row["payload"])
                    if self.verify and row["payload_digest"] is not None and base32_sha1(row["payload"]) != row["payload_digest"]:
                        raise ValueError(f"{part.file}: {row['record_id']} doesn't have its digest")
                else:
                    s.skip(size + 4)
                yield row

    def read(self, partition):
        if partition is None:  # what Spark passes where there is no partition
            return
        schema = pa.schema([(c, pa.string()) for c in HEADERS] + [("payload_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([list(r[f.name].items()) if f.name == "headers" else r[f.name] for r in rows], f.type) for f in schema], schema=schema)

        for row in self._records(partition):
            rows.append(row)
            held += len(row["payload"] or b"") + 500
            if held > 8 << 20 or len(rows) >= 5000:
                yield batch()
                rows, held = [], 0
        yield batch()


class WarcDataSource(DataSource):
    """``format("warc")``. Options: ``path`` (a file, or a folder of ``.warc`` and
    ``.warc.gz``), ``payload`` (false: blocks are passed over unread), ``verify``
    (true: a payload that doesn't have its recorded SHA-1 raises), ``level`` (of gzip)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        on = lambda k, d: str(self.options.get(k, d)).lower() == "true"
        return WarcReader(self.options["path"], on("payload", "true"), on("verify", "false"))

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("archives are appended to")
        return WarcWriter(self.options["path"], int(self.options.get("level", 3)))


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """Records of the archives at ``path``. Equality, IN, prefix and not-null
    predicates on the header columns are tested on parsed headers, before a block is
    read; ``payload=False`` reads no block at all and leaves ``payload`` null."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).load(path)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """A WARC record for every row of ``pages``.

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes, the one
    with the smallest id is the response and the others revisit it. Only ids and
    digests are shuffled to find the revisits: the smallest id of a digest is an
    aggregate, combined before the shuffle and written down, so that the digests of all
    rows meet it by a broadcast or by a join that adaptive execution can split where
    many rows share a digest. The payloads then meet the revisits on (id, digest), which
    no group of copies shares: by a broadcast where the revisits are few enough, and
    else in a shuffle that such keys deal out evenly. A revisit's payload goes no
    further. A null html counts as empty; a null url leaves out its header; repeated
    rows stay repeated, and rows that repeat the smallest id are all responses; a null
    id is never the smallest unless its group has no other.
    """
    raw = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), raw.alias("payload")).withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    ids = staged(rows.where(F.col("n") >= min_revisit_bytes).select("page_id", "sha"), "digests")
    shared = ids.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("rows")).where("rows > 1 and first_id is not null").drop("rows")
    again = ids.join(broadcast_if_small(staged(shared, "shared")), "sha").where(~F.col("page_id").eqNullSafe(F.col("first_id"))).distinct()
    again = staged(again.select(F.col("page_id").alias("again_id"), F.col("sha").alias("again_sha"), "first_id"), "revisits")
    both = rows.join(broadcast_if_small(again), rows.page_id.eqNullSafe(F.col("again_id")) & (rows.sha == F.col("again_sha")), "left")
    revisit = F.col("first_id").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return both.select(
        name(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("warc_date"),
        _base32(F.col("sha")).alias("payload_digest"),
        F.when(revisit, name(F.col("first_id"))).alias("refers_to"),
        F.col("n").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def _base32(hex_sha1):
    """Upper-case base32 of a 40-digit hexadecimal string: two stretches of 80 bits, as 4 times 20 bits each."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for k in range(8):
        bits = F.conv(F.substring(hex_sha1, 1 + 5 * k, 5), 16, 10).cast("int")
        parts += [F.substring(letters, F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def write_warc(records: DataFrame, path: str, level: int = 3) -> None:
    """Write records (columns of ``WRITE_SCHEMA``) as gzip archives under ``path``."""
    spark = records.sparkSession
    spark.dataSource.register(WarcDataSource)
    records.write.format("warc").mode("append").option("level", level).save(path)


def roundtrip(pages: DataFrame, path: str) -> DataFrame:
    """Archive ``pages`` under ``path`` and read the archives back.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri``.
    A response's payload is read and its digest verified; a revisit's figures are
    those of its headers.
    """
    write_warc(page_records(pages), path)
    back = read_warc(pages.sparkSession, path, verify=True)
    return back.select(
        F.expr("try_cast(regexp_extract(record_id, '<urn:page:(-?[0-9]+)>', 1) as long)").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.expr("try_cast(regexp_extract(refers_to, '<urn:page:(-?[0-9]+)>', 1) as long)").alias("refers_to"),
        "target_uri",
    )
