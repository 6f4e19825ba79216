"""WARC archives of pages and a merged capture index.

``write_archives``: one record per page, payload the html. Of equal payloads the one with the
smallest page_id is a response, the others are revisits that refer to it: they hold the HTTP head
without the payload, as the format has it. The archives are gzip files written by Spark's text
writer (a record's end, CRLF CRLF, is the line separator), so they can be in any store.

``read_archives``: each file is read as a stream, a record at a time, by the records' lengths.
Digests of payloads are checked. A file's captures, sorted by URL key and timestamp, are a run.

``merge_runs``: the runs are dealt out by range of (URL key, timestamp, page_id) and every range
merges its slices of the runs with a loser tree: partitions in order are one ordered index, so a
URL's captures are a history in order of time. The composite key splits a hot URL or host.

Defined cases: null html is an empty payload, null url an empty one; among equal payloads null
page_ids come last, and rows with the same smallest page_id are all responses; a page's capture
time is its page_id in seconds after 2020-01-01 (null: 0); repeated rows are repeated records; an
empty table gives empty archives and an empty index; a payload of any length is read whole, one at
a time; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ratinglab.llm.common import project, written
from ratinglab.session import scratch_path, ship_package

SEP = b"\r\n\r\n"
RECORDS_PER_FILE = 20_000
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EPOCH = 1_577_836_800  # 2020-01-01
INDEX = ("url_key string, captured string, page_id bigint, file string, offset bigint, payload_bytes bigint, "
         "payload_digest string, record_type string, refers_to bigint")


def base32_sha1(c: Column) -> Column:
    """Upper-case base32 of a SHA-1: 5 hex digits are 20 bits are 4 symbols."""
    out = []
    for g in range(8):
        n = F.conv(F.substring(F.sha1(c), 5 * g + 1, 5), 16, 10).cast("int")
        for k in (15, 10, 5, 0):
            out.append(F.substring(F.lit(ALPHABET), F.shiftright(n, k).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*out)


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest, first (the response's page_id), revisit."""
    p = project(pages, page_id=F.col("page_id").cast("long"), url=F.coalesce(F.col("url"), F.lit("")),
                html=F.coalesce(F.col("html"), F.lit("")))
    p = p.withColumn("digest", F.sha1("html"))
    first = p.groupBy("digest").agg(F.min("page_id").alias("first"))
    p = p.join(first, "digest", "left")
    again = ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= min_bytes)
    return p.withColumn("revisit", again).withColumn("digest", base32_sha1(F.col("html")))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    r = records(pages, min_bytes)
    line = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts], F.lit("\r\n"))
    uid = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(line("HTTP/1.1 200 OK"), line("Content-Type: text/html; charset=utf-8"),
                    line("Content-Length: ", F.octet_length("html").cast("string")), F.lit("\r\n"))
    block = F.concat(http, F.when(F.col("revisit"), "").otherwise(F.col("html")))
    when = F.date_format(F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) + EPOCH), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        line("WARC/1.1"), line("WARC-Type: ", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID: ", uid(F.col("page_id"))),
        line("WARC-Target-URI: ", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        line("WARC-Date: ", when), line("WARC-Payload-Digest: sha1:", F.col("digest")),
        F.when(F.col("revisit"), F.concat(
            line("WARC-Refers-To: ", uid(F.col("first"))),
            line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        line("Content-Type: application/http; msgtype=response"),
        line("Content-Length: ", F.octet_length(block).cast("string")))
    (r.select(F.concat(head, F.lit("\r\n"), block).alias("value")).write
     .option("lineSep", SEP.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, then the path and query in lower case."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)(:\d+)?([^#]*)", url, re.I)
    if not m:
        return url.lower()
    host = m[1].lower().rstrip(".")
    host = host[4:] if host.startswith("www.") else host
    return ",".join(reversed(host.split("."))) + (m[2] or "") + ")" + (m[3] or "/").lower()


def _header(raw: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in raw.decode().split("\r\n")[1:])


def _page_id(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def _capture(file: str, offset: int, head: bytes, block: bytes) -> tuple:
    h = _header(head)
    http, _, payload = block.partition(SEP)
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    n = int(_header(http)["Content-Length"])
    if h["WARC-Type"] == "response":
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != n:
            raise ValueError(f"{file}: the payload at {offset} doesn't have its digest")
    return (url_key(h["WARC-Target-URI"]), h["WARC-Date"], _page_id(h["WARC-Record-ID"]), file, offset, n, digest,
            h["WARC-Type"], _page_id(h.get("WARC-Refers-To")))


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4]


def _table(rows: list[tuple]) -> list[pa.RecordBatch]:
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [pa.int64() if x.endswith("bigint") else pa.string() for x in INDEX.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)]


def _runs(batches):
    """Rows (file, piece of it up to a separator) in file order -> a sorted run for each file."""
    file, buffer, offset, run = None, bytearray(), 0, []
    need = None

    def close():
        if buffer:
            raise ValueError(f"{file} ends inside a record")
        return _table(sorted(run, key=_order))
    for b in batches:
        for name, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if name != file:
                if file is not None:
                    yield from close()
                file, offset, run = name, 0, []
            buffer += piece + SEP
            while buffer:
                if need is None:
                    cut = buffer.find(SEP)
                    if cut < 0:
                        break
                    need = cut, cut + 4 + int(_header(bytes(buffer[:cut]))["Content-Length"])
                cut, end = need
                if len(buffer) < end + 4:
                    break
                run.append(_capture(file, offset, bytes(buffer[:cut]), bytes(buffer[cut + 4:end])))
                del buffer[:end + 4]
                offset, need = offset + end + 4, None
    if file is not None:
        yield from close()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of every archive, those of one file sorted and together: the runs."""
    ship_package(spark)
    pieces = spark.read.option("lineSep", SEP.decode()).text(path)
    return pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(_runs, INDEX)


class LoserTree:
    """k-way merge: inner nodes hold the loser of their match, node 0 the winner."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.k = runs, [0] * len(runs), max(1, len(runs))
        self.keys = [_order(r[0]) if r else None for r in runs] or [None]
        self.tree = [-1] * self.k
        for s in range(self.k):
            self._play(s)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _play(self, s: int) -> None:
        node = (s + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0:  # first match of this node: wait for the opponent
                self.tree[node] = s
                return
            if self._beats(other, s):
                self.tree[node], s = s, other
            node //= 2
        self.tree[0] = s

    def __iter__(self):
        while (s := self.tree[0]) >= 0 and self.keys[s] is not None:
            run = self.runs[s]
            yield run[self.at[s]]
            self.at[s] += 1
            self.keys[s] = _order(run[self.at[s]]) if self.at[s] < len(run) else None
            self._play(s)


def _merge(batches):
    runs: dict[str, list[tuple]] = {}
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            runs.setdefault(row[3], []).append(row)
    for run in runs.values():  # slices of a run keep its order unless a shuffle split them anew
        if any(_order(a) > _order(b) for a, b in zip(run, run[1:])):
            run.sort(key=_order)
    out: list[tuple] = []
    for row in LoserTree([runs[f] for f in sorted(runs)]):
        out.append(row)
        if len(out) == 10_000:
            yield from _table(out)
            out = []
    yield from _table(out)


def merge_runs(runs: DataFrame) -> DataFrame:
    """The ordered index. A range's captures (no payloads) are held by one task at a time."""
    ship_package(runs.sparkSession)
    return runs.repartitionByRange("url_key", "captured", "page_id").mapInArrow(_merge, INDEX)


def capture_index(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives to the shared scratch folder, read them back, merge the runs."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return merge_runs(written(read_archives(spark, path), "warc-runs"))


def _symbol(g: int, k: int) -> str:
    return f"substr('{ALPHABET}', (((('0x' || substr(h, {5 * g + 1}, 5))::INT >> {k}) & 31) + 1)::BIGINT, 1)"


ORACLE = f"""
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
  {' || '.join(_symbol(g, k) for g in range(8) for k in (15, 10, 5, 0))} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM (SELECT page_id, t, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first
      FROM (SELECT page_id, coalesce(html, '') AS t FROM pages))
"""


def query(spark, sf_dir):
    from ratinglab.llm.common import table
    index = capture_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
