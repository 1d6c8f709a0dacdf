"""WARC archives: writing captures, reading records, assembling transactions.

A capture is a request, a response (or a revisit of an earlier, equal payload) and a metadata
record.  They are tied by WARC-Concurrent-To, in whichever direction a writer put it; assembly
joins records through those identifiers and emits one nested row per capture.  Archives are gzip
files with one member a record; every file is written under a temporary name and moved when whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pfor import file_system
from .shared import materialise, scratch_path

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, http_headers string, payload binary"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _record(kind: str, rid: str, body: bytes, fields: dict) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{rid}>", "WARC-Date": DATE} | fields | {"Content-Length": str(len(body))}
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None).encode() + b"\r\n" + body + b"\r\n\r\n"
    return gzip.compress(raw, 1, mtime=0)


def record_id(kind: str, key: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{key}')}"


def base32_digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _one_line(value: str | None) -> str | None:
    return None if value is None else "".join(" " if c in "\r\n" else c for c in value)


def _write(folder):
    def run(batches):
        part = TaskContext.get().partitionId()
        path, out, n = f"{folder}/part-{part:06d}.warc.gz", None, 0
        for batch in batches:
            for key, uri, payload, digest, first, single in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if out is None:
                    fs, local = file_system(path)
                    fs.create_dir(local.rpartition("/")[0], recursive=True)
                    tmp = f"{local}.{uuid.uuid4().hex}.tmp"
                    out = fs.open_output_stream(tmp)
                    out.write(_record("warcinfo", record_id("warcinfo", path), b"format: WARC File Format 1.1\r\n", {"Content-Type": "application/warc-fields"}))
                uri, here = _one_line(uri), f"{path}#{n}"
                # what others refer to is named by its content, all else by its place: ids that repeat or are null name no record twice
                main = record_id("main", f"{key}:{digest}" if single and first is None else here)
                host = (uri or "").split("://")[-1].split("/")[0]
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                shared = {"WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response", "X-Capture-Key": None if key is None else str(key)}
                if first is None:
                    out.write(_record("response", main, http + payload, shared))
                else:
                    out.write(_record("revisit", main, http, shared | {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{record_id('main', f'{first}:{digest}')}>" if single else None, "X-Refers-To-Key": str(first)}))
                out.write(_record("request", record_id("request", here), f"GET {uri or '/'} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(), {"WARC-Target-URI": uri, "WARC-Concurrent-To": f"<{main}>", "Content-Type": "application/http; msgtype=request"}))
                out.write(_record("metadata", record_id("metadata", here), (b"" if key is None else f"captureKey: {key}\r\n".encode()), {"WARC-Target-URI": uri, "WARC-Concurrent-To": f"<{main}>", "Content-Type": "application/warc-fields"}))
                n += 1
        if out is not None:
            out.close()
            fs.move(tmp, local)
            yield pa.RecordBatch.from_pydict({"path": [path], "captures": [n]})

    return run


def write_archives(df: DataFrame, folder: str, id_col="page_id", url_col="url", html_col="html", least_bytes: int = 0) -> DataFrame:
    """Write a capture per row; the manifest (``path, captures``).

    Of rows with equal payloads of at least ``least_bytes`` bytes, the one with the least id becomes
    a response and the others revisit it.  Ids are integers.  Null payloads are empty; null urls leave
    the target out; a null id leaves the capture's key out, and is never a response others refer to
    unless all equal payloads' ids are null, and then each is its own response.  Rows that repeat the
    least id of their payload are responses each; revisits of them name the key, not a record.  Every
    capture has record ids of its own.  Other columns are ignored; an empty table writes no archive.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).alias("uri"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    by_key = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha", "key").agg(F.count(F.lit(1)).alias("m"))
    groups = by_key.groupBy("sha").agg(F.min("key").alias("first"), F.min_by("m", "key").alias("heads"), F.sum("m").alias("n")).where("n > 1")
    groups = materialise(groups.select("sha", "first", (F.col("heads") == 1).alias("single")), "warc-groups")
    hexed = F.col("sha")
    digest = F.concat(*[_base32_of(hexed, k) for k in range(32)])
    met = rows.join(groups, "sha", "left")
    first = F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first"))
    out = met.select("key", "uri", "payload", digest.alias("digest"), first.alias("first"), F.coalesce("single", F.lit(False)).alias("single"))
    return materialise(out.mapInArrow(_write(folder), "path string, captures long"), "warc-manifest")


def _base32_of(hexed, k):
    """Digit k of the base32 form of 160 bits in hexadecimal: bits 5k to 5k + 4."""
    byte = (5 * k) // 4
    pair = F.conv(F.substring(hexed, byte + 1, 2), 16, 10).cast("int")
    return F.substring(F.lit(_BASE32), F.shiftright(pair, 8 - 5 - (5 * k - 4 * byte)).bitwiseAND(F.lit(31)) + 1, F.lit(1))


def parse_records(raw):
    """(headers, block) of each record of a gzip archive given as a stream of bytes."""
    held, machine = bytearray(), None  # machine: of the member that has begun
    while data := raw.read(1 << 20):
        while data:
            machine = machine or zlib.decompressobj(31)
            held += machine.decompress(data)
            data = machine.unused_data
            if machine.eof:
                yield _split(bytes(held))
                held, machine = bytearray(), None
    if machine is not None:
        raise ValueError("archive ends inside a record")


def _split(record: bytes):
    head, _, block = record.partition(b"\r\n\r\n")
    fields: dict = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.decode("utf-8", "replace").partition(": ")
        fields.setdefault(k, []).append(v)
    return fields, block[: int(fields["Content-Length"][0])]


def _read(with_payload):
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("http_headers", pa.string()), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, local = file_system(path)
                rows, held = [], 0
                with fs.open_input_stream(local, compression=None) as raw:
                    for fields, block in parse_records(raw):
                        get = lambda k, f=fields: f.get(k, [None])[0]
                        kind, http, payload, size, digest = get("WARC-Type"), None, block, None, get("WARC-Payload-Digest")
                        if get("Content-Type") and get("Content-Type").startswith("application/http"):
                            http, _, payload = block.partition(b"\r\n\r\n")
                            http = http.decode("utf-8", "replace")
                        if kind == "response":
                            size, digest = len(payload), base32_digest(payload)
                            if get("WARC-Payload-Digest") not in (None, f"sha1:{digest}"):
                                raise ValueError(f"{path}: payload of {get('WARC-Record-ID')} does not have its digest")
                        elif kind == "revisit":
                            payload, digest = None, (digest or "").removeprefix("sha1:")
                            size = next((int(x.split(":")[1]) for x in (http or "").split("\r\n") if x.lower().startswith("content-length:")), None)
                        rows.append({
                            "record_id": get("WARC-Record-ID").strip("<>"), "type": kind, "target_uri": get("WARC-Target-URI"), "date": get("WARC-Date"),
                            "concurrent_to": [x.strip("<>") for x in fields.get("WARC-Concurrent-To", [])], "refers_to": (get("WARC-Refers-To") or "").strip("<>") or None,
                            "payload_digest": digest, "payload_bytes": size, "headers": [(k, v[0]) for k, v in fields.items()], "http_headers": http, "payload": payload if with_payload else None,
                        })
                        held += len(block)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives whose paths are in ``files.path``; a task reads whole files as streams."""
    n = max(1, files.count())
    return files.select("path").repartition(n).mapInArrow(_read(with_payload), RECORD)


def assemble_transactions(records: DataFrame) -> DataFrame:
    """One row per capture: ``capture_id, target_uri, response, request, metadata``.

    ``response`` is the response or revisit record; ``request`` and ``metadata`` are those whose
    concurrent-to names it, or that it names itself; ``metadata`` is an array in order of record id.
    Records tied to no response give no capture; a response without partners has null and an empty
    array; records that repeat an id count once for each tie.
    """
    record = F.struct(*[c for c in records.columns])
    main = records.where(F.col("type").isin("response", "revisit"))
    other = records.where(F.col("type").isin("request", "metadata"))
    forth = other.select(F.explode("concurrent_to").alias("main_id"), F.col("record_id").alias("other_id"))
    back = main.select(F.col("record_id").alias("main_id"), F.explode("concurrent_to").alias("other_id"))
    ties = forth.unionByName(back).distinct()
    partners = (
        ties.join(other.select(F.col("record_id").alias("other_id"), F.struct(*[F.col(c) for c in other.columns if c != "payload"]).alias("rec"), "type"), "other_id")
        .groupBy("main_id")
        .agg(F.min(F.when(F.col("type") == "request", F.struct(F.col("rec.record_id"), F.to_json("rec").alias("json")))).alias("request"), F.sort_array(F.collect_list(F.when(F.col("type") == "metadata", F.to_json("rec")))).alias("metadata"))
    )
    out = main.select("record_id", record.alias("response")).join(partners, F.col("record_id") == F.col("main_id"), "left")
    plain = ", ".join(x for x in RECORD.split(", ") if not x.startswith("payload binary"))
    return out.select(
        F.col("record_id").alias("capture_id"),
        F.col("response.target_uri").alias("target_uri"),
        "response",
        F.from_json("request.json", plain).alias("request"),
        F.transform(F.coalesce("metadata", F.array().cast("array<string>")), lambda x: F.from_json(x, plain)).alias("metadata"),
    )


def archive_pages(df: DataFrame, folder: str | None = None, least_bytes: int = 0, with_payload: bool = True, **columns) -> DataFrame:
    """Write ``df`` as archives, read them back and assemble the captures.  An empty table gives no rows."""
    folder = folder or scratch_path(df.sparkSession, "warc")
    return assemble_transactions(read_archives(write_archives(df, folder, least_bytes=least_bytes, **columns), with_payload))
