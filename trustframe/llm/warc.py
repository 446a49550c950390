"""WARC archives with a two-level capture index.

Captures are sorted by reversed-host URL key and page id.  Every range of keys is one archive (a member per
record) with its index file: lines ``key, page id, offset, length`` in compressed blocks, and a directory
with the first key and the byte range of every block.  A lookup finds the archive among the first keys of
all archives, searches its directory, then one block, and reads the record's byte range.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored, table, up_to
from .hashing import small_batches
from .shared import attempt_name, make_folder, partition_id, place

BLOCK_LINES = 500
BROADCAST_ROWS = 200_000
PART_BYTES = 4_000_000
READ_AHEAD = 1 << 20
MIN_REVISIT_BYTES = 0
CRLF = "\r\n"


def url_key(url: Column) -> Column:
    """Sort key: host parts reversed, then ``)`` and the path with its query; empty for NULL."""
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^#]*)", 1)
    full = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.when(host == "", u).otherwise(full)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def order_of(key: str, page: str | None) -> tuple:
    """The order that Spark sorts (key, page) in, NULL ids first; ids are written out, so any type passes exactly."""
    return (key.encode(), page is not None, (page or "").encode())


def record(page: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record; a revisit names its response and keeps the payload's digest and size only."""
    kind = "response" if refers_to is None else "revisit"
    body = b"" if refers_to is not None else payload
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}".encode() + body
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page{'' if page is None else ':' + quote(page, safe='')}>",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:page:{quote(refers_to, safe='')}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(f"Content-Length: {len(http)}")
    return (CRLF.join(head) + CRLF * 2).encode() + http + (CRLF * 2).encode()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and HTTP payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split(CRLF)[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["payload-bytes"] = next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length")).decode()
    return fields, payload


def owners(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(sha, size, owner): payloads that several captures share, with the smallest page id."""
    some = pages.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("owner"), F.count(F.lit(1)).alias("n"))
    return some.where("n > 1").drop("n")


def page_rows(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    d = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), url_key(F.col(url)).alias("key"), payload.alias("payload"))
    return d.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write all captures; returns one row per archive: first key, files and the number of captures.

    NULL html is an empty payload, a NULL url has an empty key and no target field.  Of equal payloads of at
    least ``min_bytes`` bytes the capture with the smallest page id is the response (all rows with that id, if
    it repeats; all rows, if the ids are NULL), the others are revisits.  An empty table writes nothing.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    make_folder(folder)
    d = page_rows(pages, page_id, url, html)
    own = stored(owners(d, min_bytes), "warc-owners")
    d = d.join(F.broadcast(own) if up_to(own, BROADCAST_ROWS) else own, ["sha", "size"], "left")
    later = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    d = d.select("key", F.col("page_id").cast("string").alias("page"), "url", "payload", F.when(later, F.col("owner")).cast("string").alias("refers_to"))
    d = d.repartitionByRange("key", "page", F.xxhash64("url")).sortWithinPartitions("key", "page")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = place(folder)
        name = attempt_name(f"part-{partition_id():06d}")
        lines, directory, at, total, first = [], [], 0, 0, None
        warc = index = None

        def close_block():
            packed = gzip.compress(("\n".join(json.dumps(x) for x in lines) + "\n").encode(), mtime=0)
            directory.append([*lines[0][:2], index.tell(), len(packed)])
            index.write(packed)
            lines.clear()

        for batch in batches:
            for part in small_batches(batch, "payload", PART_BYTES):
                for key, page, link, payload, ref in zip(part["key"], part["page"], part["url"], part["payload"], part["refers_to"]):
                    if warc is None:
                        warc, index = (system.open_output_stream(f"{root}/{name}.{x}", compression=None) for x in ("warc.gz", "cdx.gz"))
                        first = (key, page)
                    packed = gzip.compress(record(page, link, payload, ref), 6, mtime=0)
                    warc.write(packed)
                    lines.append([key, page, at, len(packed)])
                    at, total = at + len(packed), total + 1
                    if len(lines) >= BLOCK_LINES:
                        close_block()
        if warc is None:
            return
        if lines:
            close_block()
        where = index.tell()
        index.write(zlib.compress(json.dumps(directory).encode()))
        index.close()
        warc.close()
        yield pd.DataFrame({"key": [first[0]], "page": [first[1]], "path": [f"{folder}/{name}"], "dir_at": [where], "captures": [total]})

    return stored(d.mapInPandas(run, "key string, page string, path string, dir_at long, captures long"), "warc-archives")


class CaptureIndex:
    """Reader of one task: directories and blocks are read when a search needs them; a few are remembered."""

    def __init__(self, archives: list[tuple]):
        """``archives``: (key, page, path, dir_at) of all archives."""
        self.archives = sorted(archives, key=lambda a: order_of(a[0], a[1]))
        self.first = [order_of(a[0], a[1]) for a in self.archives]
        self.memo: OrderedDict = OrderedDict()
        self.reads = 0

    def _remember(self, name, make):
        if name not in self.memo:
            self.memo[name] = make()
            if len(self.memo) > 64:
                self.memo.popitem(last=False)
        self.memo.move_to_end(name)
        return self.memo[name]

    def _file(self, path: str):
        def open_it():
            system, local = place(path)
            return system.open_input_file(local)

        return self._remember(("file", path), open_it)

    def _range(self, path: str, offset: int, length: int) -> bytes:
        held_at, held = self.memo.get(("ahead", path), (0, b""))
        if not (held_at <= offset and offset + length <= held_at + len(held)):
            f = self._file(path)
            f.seek(offset)
            held_at, held = offset, f.read(max(length, READ_AHEAD))
            self.memo[("ahead", path)] = (held_at, held)
            self.reads += 1
        return held[offset - held_at : offset - held_at + length]

    def _directory(self, a: tuple):
        def load():
            f = self._file(a[2] + ".cdx.gz")
            f.seek(a[3])
            rows = json.loads(zlib.decompress(f.read()))
            return [order_of(r[0], r[1]) for r in rows], rows

        return self._remember(("dir", a[2]), load)

    def _block(self, a: tuple, row: list):
        def load():
            f = self._file(a[2] + ".cdx.gz")
            f.seek(row[2])
            lines = [json.loads(x) for x in gzip.decompress(f.read(row[3])).decode().splitlines()]
            return [order_of(x[0], x[1]) for x in lines], lines

        return self._remember(("block", a[2], row[2]), load)

    def lines(self, low: tuple, inside) -> Iterator[tuple]:
        """Index lines from ``low`` on while ``inside(line)`` holds, as (archive, line)."""
        k = max(0, bisect.bisect_left(self.first, low) - 1)
        while k < len(self.archives) and (self.first[k] <= low or inside(self.archives[k])):
            keys, rows = self._directory(self.archives[k])
            b = max(0, bisect.bisect_left(keys, low) - 1)
            while b < len(rows) and (keys[b] <= low or inside(rows[b])):
                at, lines = self._block(self.archives[k], rows[b])
                for x in lines[bisect.bisect_left(at, low) :]:
                    if not inside(x):
                        return
                    yield self.archives[k], x
                b += 1
            k += 1

    def capture(self, key: str, page: str | None) -> list[tuple[dict, bytes]]:
        """Records with this key and written-out id."""
        return [parse(self.fetch(a, x)) for a, x in self.lines(order_of(key, page), lambda x: x[0] == key and x[1] == page)]

    def captures(self, key: str) -> list[tuple[dict, bytes]]:
        """All records with this key, by page id."""
        return [parse(self.fetch(a, x)) for a, x in self.lines(order_of(key, None), lambda x: x[0] == key)]

    def fetch(self, archive: tuple, line: list) -> bytes:
        return gzip.decompress(self._range(archive[2] + ".warc.gz", line[2], line[3]))


def lookup(keys: DataFrame, archives: DataFrame) -> DataFrame:
    """Records of the distinct (key, page_id) rows of ``keys``, found through the index.

    Keys are sorted into ranges, so that a task's searches walk few blocks.  The first keys of the archives
    go to every task: one row per archive, of which there are as many as write tasks.  Page ids of any type
    that text can hold come back as they went in; a NULL id finds the captures without id, a key without
    captures gives no row, repeated rows of ``keys`` count once and each repeated capture is returned.
    """
    spark = keys.sparkSession
    known = spark.sparkContext.broadcast([tuple(r) for r in archives.select("key", "page", "path", "dir_at").collect()])
    kind = keys.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = CaptureIndex(known.value)
        for batch in batches:
            rows = []
            for key, page in zip(batch["key"], batch["page"]):
                for fields, payload in index.capture(key, page):
                    ref = fields.get("WARC-Refers-To")
                    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if ref is None and digest(payload) != stated:
                        raise ValueError(f"payload digest differs: {key}")
                    size = int(fields["payload-bytes"]) if ref is not None else len(payload)
                    rows.append((key, page, size, stated, fields["WARC-Type"], unquote(ref[10:-1]) if ref else None))
            yield pd.DataFrame(rows, columns=["key", "page", "payload_bytes", "payload_digest", "record_type", "refers"]).astype({"payload_bytes": "int64"})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # keys are small, their searches are not: no fewer tasks
    k = keys.select("key", F.col("page_id").cast("string").alias("page")).distinct().repartitionByRange(n, "key", "page").sortWithinPartitions("key", "page")
    out = k.mapInPandas(run, "key string, page string, payload_bytes long, payload_digest string, record_type string, refers string")
    ident = lambda c, name: F.col(c).cast(kind).alias(name)
    return out.select("key", ident("page", "page_id"), "payload_bytes", "payload_digest", "record_type", ident("refers", "refers_to"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives = write_archives(pages)
    return lookup(pages.select(url_key(F.col("url")).alias("key"), "page_id"), archives).drop("key")


SQL = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(b), (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest FROM p),
o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS owner FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM owner THEN owner END AS refers_to FROM o"""
