"""Web archives: writing transactions, reading records, assembling captures.

A transaction is a request, a response (or revisit) and a metadata record
that name each other through ``WARC-Concurrent-To``.  Archives are written
by Spark's text writer, whose line separator is the blank lines that end a
record, as gzip files of a bounded number of transactions and bytes, and read by
Spark's binary file reader: tasks only decompress and cut records by their
``Content-Length``, one record in memory at a time.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redress.llm.common import attach, ship, stored
from redress.llm.components import connected_components

EOL = "\r\n"
END = EOL * 2
#: Transactions in one archive file at most, and bytes of payload in one, about:
#: a file is one value in its reader's memory.
PER_FILE, FILE_BYTES = 5000, 1 << 26
_DATE = "2024-01-01T00:00:00Z"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORDS = (
    "record_id string, type string, concurrent_to array<string>, target_uri string, refers_to string, "
    "payload_digest string, fields string, payload_bytes long, computed_digest string"
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string's UTF-8 bytes."""
    digest = F.sha1(payload)
    # 8 parts of 5 hex digits, each 4 base32 digits
    parts = [F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    digit = lambda p, k: F.substr(F.lit(_BASE32), F.shiftright(p, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[digit(p, k) for p in parts for k in range(4)])


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1" + EOL)]
    for name, value in [*headers, ("Content-Length", F.octet_length(block).cast("string"))]:
        lines.append(F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(EOL)), F.lit("")))
    return F.concat(*lines, F.lit(EOL), block)


def _numbered(src: DataFrame, slim: DataFrame) -> DataFrame:
    """``src`` with a ``mark`` on all but one of the rows of a ``name``: the
    number of the row in ``slim``, which has the same rows without bodies.  A
    name stands for one body, so repeated ones are taken once and dealt to
    the rows of ``slim``."""
    seen = slim.groupBy("name").agg(F.min("n").alias("least"), F.count("*").alias("_n")).where("_n > 1")
    seen = stored(seen, "repeated-names")
    if seen.isEmpty():
        return src
    told = attach(src, seen, "name", "_n")
    bodies = stored(told.where("_n IS NOT NULL").select("name", "body", "_n").dropDuplicates(["name"]), "repeated-bodies")
    rows = attach(slim, seen.withColumnRenamed("_n", "_m"), "name", "_m").where("_m IS NOT NULL")
    mark = F.when(F.col("n") == F.col("least"), "").otherwise(F.concat(F.lit(":"), F.col("n").cast("string")))
    rows = attach(stored(rows.select("name", "order", "id", "url", "digest", mark.alias("mark")), "repeated-rows"), bodies, "name", "_n")
    return told.where("_n IS NULL").select(*src.columns).unionByName(rows.select(*src.columns))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_revisit_bytes: int = 0, every_row: bool = False) -> None:
    """Write one transaction per row of ``pages`` under ``path``.

    Record ids are made of the row's id and payload digest; rows that share
    both get the same ids and are read back as one capture.  With
    ``every_row`` all but one of such rows have a number in theirs, and every
    row is read back as a capture of its own.

    Of rows with equal payloads (SHA-1 and length) of at least
    ``min_revisit_bytes`` bytes, those with the smallest id are written as
    response, the others as revisit that refers to it; smaller payloads are
    all response.  A null payload is empty, a null url has no target header,
    line ends in a url are percent-encoded.  A row with a null id is
    never the smallest of a group that has an id.
    """
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    src = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), body.alias("body"),
                       F.col(id_col).alias("order"))
    digest = base32_sha1(F.col("body"))
    sums = src.select("order", digest.alias("digest"), F.octet_length("body").alias("size"),
                      *(["id", "url", F.monotonically_increasing_id().alias("n")] if every_row else []))
    slim = stored(sums, "payloads")
    groups = stored(
        slim.where(F.col("size") >= min_revisit_bytes).groupBy("digest", "size").agg(
            F.min("order").alias("first"), F.count("*").alias("_n")
        ).where("_n > 1 AND first IS NOT NULL").select("digest", "first", "_n"), "payload-groups",
    )
    marked = attach(slim, groups, "digest", "_n").where("first IS NOT NULL AND NOT (order <=> first)")
    revisits = marked.select(F.col("order").alias("_o"), F.col("digest").alias("_d"), "first").distinct()
    src = src.withColumn("digest", digest).withColumn("mark", F.lit(""))
    name = F.concat(F.coalesce("id", F.lit("null")), F.lit(":"), F.col("digest"))
    if every_row:
        src = _numbered(src.withColumn("name", name), slim.withColumn("name", name)).drop("name")
    src = src.join(revisits, src["order"].eqNullSafe(revisits["_o"]) & (src["digest"] == revisits["_d"]), "left")

    name = F.concat(name, F.col("mark"))
    ref = lambda who, kind: F.concat(F.lit("<urn:x-page:"), who, F.lit(f":{kind}>"))
    capture = ref(name, "capture")
    first = F.concat(F.col("first").cast("string"), F.lit(":"), F.col("digest"))
    target = ("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")))
    again = F.col("first").isNotNull()
    date = ("WARC-Date", F.lit(_DATE))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + EOL + "Content-Type: text/html; charset=utf-8" + EOL + "Content-Length: "),
                    F.octet_length("body").cast("string"), F.lit(END))
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", ref(name, "request")), date, target,
         ("WARC-Concurrent-To", capture), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.lit("GET / HTTP/1.1" + END),
    )
    response = _record(
        [("WARC-Type", F.when(again, "revisit").otherwise("response")), ("WARC-Record-ID", capture), date, target,
         ("WARC-Refers-To", F.when(again, ref(first, "capture"))),
         ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
         ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
         ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.when(again, http).otherwise(F.concat(http, F.col("body"))),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", ref(name, "metadata")), date, target,
         ("WARC-Concurrent-To", ref(name, "request")), ("Content-Type", F.lit("application/warc-fields"))],
        F.coalesce(F.concat(F.lit("page-id: "), F.col("id"), F.lit(EOL)), F.lit("")),
    )
    rows, held = slim.agg(F.count("*"), F.sum("size")).first()
    per_file = max(1, min(PER_FILE, FILE_BYTES * rows // max(held or 0, 1)))
    src.select(F.concat_ws(END, request, response, metadata).alias("value")).write.option("lineSep", END).option(
        "compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


class _Stream:
    """Lines and blocks of a gzip or plain file held as bytes, decompressed
    piece by piece (any number of gzip members)."""

    def __init__(self, raw: bytes, piece: int = 1 << 20):
        self.raw, self.at, self.buf, self.piece = memoryview(raw), 0, bytearray(), piece
        self.z = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        part = self.raw[self.at : self.at + self.piece]
        self.at += len(part)
        if self.z is None:
            self.buf += part
            return True
        data = bytes(part)
        while data:
            self.buf += self.z.decompress(data)
            data = self.z.unused_data if self.z.eof else b""
            if self.z.eof:
                self.z = zlib.decompressobj(31)
        return True

    def line(self) -> bytes | None:
        start = 0
        while (k := self.buf.find(b"\n", start)) < 0:
            start = len(self.buf)
            if not self._more():
                if not self.buf:
                    return None
                k = len(self.buf) - 1
                break
        out = bytes(self.buf[: k + 1])
        del self.buf[: k + 1]
        return out

    def block(self, n: int) -> bytes:
        while len(self.buf) < n and self._more():
            pass
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out


def parse(raw: bytes):
    """(headers, block) of every record of an archive file.  Header names are
    lower-cased, a name that occurs several times has all its values."""
    s = _Stream(raw)
    while (line := s.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers: dict[str, list[str]] = {}
        while (line := s.line()) is not None and line.strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(k.strip().lower(), []).append(v.strip())
        yield headers, s.block(int(headers.get("content-length", ["0"])[0]))


def _rows(headers: dict, block: bytes) -> dict:
    kind = headers.get("warc-type", [""])[0]
    payload, fields = None, None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
    elif kind == "metadata":
        fields = block.decode("utf-8", "replace")
    one = lambda k: headers.get(k, [None])[0]
    return {
        "record_id": one("warc-record-id"), "type": kind, "concurrent_to": headers.get("warc-concurrent-to", []),
        "target_uri": one("warc-target-uri"), "refers_to": one("warc-refers-to"),
        "payload_digest": one("warc-payload-digest"), "fields": fields,
        "payload_bytes": None if payload is None else len(payload),
        "computed_digest": None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        "payload": payload,
    }


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives under ``path``; ``payload_bytes``
    and ``computed_digest`` are taken from the payload that was read, which
    is returned too (binary) if ``with_payload``."""
    schema = RECORDS + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for df in batches:
            for raw in df["content"]:
                rows, held = [], 0
                for headers, block in parse(raw):
                    rows.append(_rows(headers, block))
                    held += len(block) if with_payload else 200
                    if len(rows) >= 2000 or held > 1 << 24:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(run, schema)


#: Members of one kind that a nested row shows; rounds of plain joins that follow links.
NESTED, ROUNDS = 100, 3


def _linked(links: DataFrame, captures: DataFrame) -> DataFrame:
    """(id, capture_id): every other record with every capture that its links
    reach, one step after another while there are new pairs."""
    first = links.join(captures, links["to"] == captures["capture_id"]).select("id", "capture_id").distinct()
    found = front = stored(first, "warc-members")
    for _ in range(ROUNDS):
        step = front.select(F.col("id").alias("_via"), "capture_id")
        new = links.join(step, F.col("to") == F.col("_via")).select("id", "capture_id").distinct()
        front = stored(new.join(found, ["id", "capture_id"], "left_anti"), "warc-members")
        if front.isEmpty():
            return found
        found = found.unionByName(front)
    # longer chains: whatever holds together without a capture reaches the same captures
    others = links.join(captures, links["to"] == captures["capture_id"], "left_anti").select("id", "to")
    group = connected_components(others, "id", "to")
    known = links.select("id").distinct().join(group.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("id", F.coalesce("component", "id").alias("group"))
    reach = known.join(first, "id").select("group", "capture_id").distinct()
    return known.join(reach, "group").select("id", "capture_id")


def _slim(records: DataFrame) -> DataFrame:
    return stored(records.where("record_id IS NOT NULL").dropDuplicates(["record_id"]), "warc-records")


def _members(slim: DataFrame) -> DataFrame:
    main = F.col("type").isin("response", "revisit")
    named = slim.select("record_id", main.alias("main"), F.explode("concurrent_to").alias("to"))
    heads = slim.where(main).select(F.col("record_id").alias("capture_id"))
    # links of the other records to whatever they name or are named by
    out = named.where("NOT main").select(F.col("record_id").alias("id"), "to")
    back = named.select(F.col("to").alias("id"), F.col("record_id").alias("to"))
    links = out.unionByName(back).distinct().join(heads, F.col("id") == F.col("capture_id"), "left_anti")
    found = _linked(stored(links, "warc-links"), heads)
    rest = slim.where(~main).select("record_id", "type", "target_uri", "fields")
    return rest.join(found, rest["record_id"] == found["id"]).select("capture_id", *rest.columns)


def members(records: DataFrame) -> DataFrame:
    """(capture_id, record_id, type, target_uri, fields): every record that is
    no response or revisit, once for each capture that it belongs to.

    A record belongs to the captures that it names in ``concurrent_to``, that
    name it, or that a record linked to it in one of these ways belongs to,
    over any number of steps.  Records without an id, or that lead to no
    capture, are in no row.  Records repeated under one id count once."""
    return _members(_slim(records))


def assemble(records: DataFrame, lists: bool = True) -> DataFrame:
    """One nested row per capture: (capture_id, capture, request, metadata,
    n_requests, n_metadata, requests, metadatas, page).

    A capture is a response or revisit record; its members are those of
    :func:`members`.  ``request`` and ``metadata`` are the ones with the
    smallest ids (null if none), the counts say how many there are, and
    ``requests`` and ``metadatas`` list them by id.  A capture with more than
    ``NESTED`` members shows about so many of them there, drawn by hash, so
    that its row stays small: all of them are rows of :func:`members`.
    ``page`` is the ``page-id`` that any of the metadata records has (the
    smallest).  Without ``lists`` those two columns are left out."""
    slim = _slim(records)
    rest = stored(_members(slim), "warc-members-of-captures")
    part = F.struct("record_id", "target_uri", "fields")
    page = F.regexp_extract("fields", r"(?m)^page-id: (.*?)\r?$", 1)
    of = lambda kind, x: F.when(F.col("type") == kind, x)
    sides = stored(rest.groupBy("capture_id").agg(
        F.min(of("request", part)).alias("request"), F.min(of("metadata", part)).alias("metadata"),
        F.count(of("request", F.lit(1))).alias("n_requests"), F.count(of("metadata", F.lit(1))).alias("n_metadata"),
        F.min(of("metadata", F.nullif(page, F.lit("")))).alias("page"), F.count("*").alias("_n"),
    ), "warc-sides")
    inner = [c for c in slim.columns if c not in ("concurrent_to", "fields")]
    heads = slim.where(F.col("type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), F.struct(*inner).alias("capture"))
    out = heads.join(sides, "capture_id", "left")
    shown = ["capture_id", "capture", "request", "metadata", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_requests", "n_metadata")]]
    if not lists:
        return out.select(*shown, "page")
    told = attach(rest, sides.select("capture_id", "_n"), "capture_id", "_n")
    drawn = told.where(F.pmod(F.xxhash64("record_id"), F.lit(1 << 31)) * F.col("_n") < F.lit(NESTED << 31))
    listed = drawn.groupBy("capture_id").agg(
        F.array_sort(F.collect_list(of("request", part))).alias("requests"),
        F.array_sort(F.collect_list(of("metadata", part))).alias("metadatas"),
    )
    none = F.array().cast("array<struct<record_id:string,target_uri:string,fields:string>>")
    return out.join(listed, "capture_id", "left").select(
        *shown, F.coalesce("requests", none).alias("requests"), F.coalesce("metadatas", none).alias("metadatas"), "page")


def captures(records: DataFrame) -> DataFrame:
    """Assembled captures with revisits resolved: ``payload_bytes`` and
    ``payload_digest`` (bare) of the full payload, and ``refers_page``, the
    page id of the response that a revisit refers to."""
    done = stored(assemble(records, lists=False), "captures")
    flat = done.select(
        "capture_id", F.col("capture.type").alias("record_type"), F.col("capture.refers_to").alias("ref"),
        F.col("capture.payload_bytes").alias("size"), F.col("capture.computed_digest").alias("digest"),
        "page", F.col("capture.target_uri").alias("url"),
    )
    # responses that are referred to, with the number of rows that do
    asked = flat.where("ref IS NOT NULL").groupBy("ref").agg(F.count("*").alias("_n"))
    known = flat.where("ref IS NULL").select(
        F.col("capture_id").alias("ref"), F.col("size").alias("f_size"), F.col("digest").alias("f_digest"), F.col("page").alias("f_page")
    )
    firsts = stored(known.join(asked, "ref"), "referred")
    return attach(flat, firsts, "ref", "_n").select(
        "capture_id", "page", "url", "record_type", F.coalesce("f_size", "size").alias("payload_bytes"),
        F.coalesce("f_digest", "digest").alias("payload_digest"), F.col("f_page").alias("refers_page"),
    )
