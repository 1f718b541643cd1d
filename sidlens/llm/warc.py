"""WARC archives: writing with revisits, reading, and one index of all captures in order.

Archives are written by Spark's text writer: a record is its row, and the line
separator is the CRLF CRLF that ends each record. So they reach any store that
Spark writes to. Each archive is one gzip stream.

Each archive's captures, sorted by URL key and time, are a run. Runs are cut at
common borders, and each range's pieces are merged by a tree of losers.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, saved, shared_dir

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: Bytes of a record up to which an archive has so many of them; an archive is read as a whole, so larger records are in archives of fewer.
ARCHIVE_RECORDS = {1 << 15: 2000, 1 << 20: 64, 1 << 62: 1}
#: Entries of a range of the index, which is merged by one task.
RANGE = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages have no time of capture; the page of id n counts as captured n seconds after this one.
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
ENTRY = "url_key string, captured string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string, record int"


# ---------------------------------------------------------------- writing


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload, of LEAST_BYTES or more, a page of smaller id has too."""
    payload = F.coalesce("html", F.lit(""))
    meta = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= LEAST_BYTES)
    first = meta.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").drop("c")
    return meta.join(first, "digest").where(F.col("page_id") > F.col("refers_to")).select("page_id", "digest", "refers_to").distinct()


def records(pages: DataFrame, which: Column | None = None) -> DataFrame:
    """One `value` per page, or per page of which a condition holds: the WARC record without the CRLF CRLF at its end."""
    payload = F.coalesce("html", F.lit(""))
    rows = (pages if which is None else pages.where(which)).select("page_id", "url", "html", F.sha2(payload, 256).alias("digest")).join(revisits(pages), ["page_id", "digest"], "left")
    size = F.octet_length(payload)
    crlf = "\r\n"
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    # What can't stand in a header goes percent-encoded, the percent sign first.
    url = F.col("url")
    for c in ("%", "\r", "\n"):
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    date = F.date_format(F.timestamp_seconds(F.lit(int(EPOCH.timestamp())) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), size.cast("string"), F.lit(crlf * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, payload))
    head = F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{crlf}WARC-Record-ID: "),
        urn(F.col("page_id")),
        F.lit(f"{crlf}WARC-Date: "),
        date,
        F.coalesce(F.concat(F.lit(f"{crlf}WARC-Target-URI: "), url), F.lit("")),
        F.lit(f"{crlf}Content-Type: application/http; msgtype=response{crlf}WARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.coalesce(F.when(revisit, F.concat(F.lit(f"{crlf}WARC-Profile: {PROFILE}{crlf}WARC-Refers-To: "), urn(F.col("refers_to")))), F.lit("")),
        F.lit(f"{crlf}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(crlf * 2),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str) -> str:
    """Archives of at most as many records as ARCHIVE_RECORDS tells for their sizes, in a folder for each size. Null payloads are empty, null URLs are left out; repeated rows have a record each."""
    spark = pages.sparkSession
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        size = F.octet_length(F.coalesce("html", F.lit("")))
        counts = pages.agg(*[F.count_if((size > lo) & (size <= hi)) for lo, hi in zip([-1, *ARCHIVE_RECORDS], ARCHIVE_RECORDS)]).first()  # noqa: B905
        least, first = -1, True
        for (most, n), count in zip(ARCHIVE_RECORDS.items(), counts, strict=True):
            if count or (first and most == 1 << 62):
                records(pages, (size > least) & (size <= most)).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", n).text(f"{path}/of-{n}")
                first = False
            least = most
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    return path


# ---------------------------------------------------------------- reading


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record. Lengths decide where a block ends, not what it holds."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield headers, raw[start:stop]
        at = stop + 4


def url_key(url: str | None) -> str:
    """The URL with its host turned around, lower-case, without scheme, user and fragment; what can't be split stays as it is."""
    if not url:
        return ""
    try:
        u = urlsplit(url)
        host = ",".join(reversed((u.hostname or "").lower().split("."))) + (f":{u.port}" if u.port else "")
    except ValueError:
        return url.lower()
    return f"{host}){u.path or '/'}{'?' + u.query if u.query else ''}".lower()


def _page(urn: str | None) -> int | None:
    n = urn[len("<urn:page:") : -1] if urn else "none"
    return None if n == "none" else int(n)


def entry(headers: dict[str, str], block: bytes) -> dict:
    """The index entry of a record. A response's digest is that of the payload read, and must be the one stated."""
    http, payload = block.split(b"\r\n\r\n", 1)
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    stated = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if headers["WARC-Type"] == "response":
        found = hashlib.sha256(payload).hexdigest()
        if found != stated or size != len(payload):
            raise ValueError(f"the payload of {headers['WARC-Record-ID']} isn't the one stated")
    url = headers.get("WARC-Target-URI")
    url = None if url is None else unquote_header(url)
    return {"url_key": url_key(url), "captured": headers["WARC-Date"], "page_id": _page(headers["WARC-Record-ID"]), "url": url, "record_type": headers["WARC-Type"], "payload_digest": stated, "payload_bytes": size, "refers_to": _page(headers.get("WARC-Refers-To"))}


def unquote_header(url: str) -> str:
    for c in ("\n", "\r", "%"):
        url = url.replace(f"%{ord(c):02X}", c)
    return url


def _order(e: dict) -> tuple:
    return (e["url_key"], e["captured"], e["page_id"] is not None, e["page_id"] or 0)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """An entry per record: each archive's sorted by URL key, time and page, with its place in that run."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    names = [c.split()[0] for c in ENTRY.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = zlib.decompress(content.as_buffer(), 31) if content.as_py() else b""
                found = sorted((entry(h, block) for h, block in parse(raw)), key=_order)
                columns = [[e[n] for e in found] for n in names[:-2]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([*columns, [name] * len(found), list(range(len(found)))], types, strict=True)], names=names)

    return mapped(files, run, ENTRY)


# ---------------------------------------------------------------- merging


class LoserTree:
    """Merges sorted iterators: inner nodes keep the loser of the match below them, so the next winner meets one loser on each level."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        self.winner = self._build(1) if self.k else -1

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's head goes before run b's; a run that is used up goes last, equal heads go by run."""
        if b < 0 or (a >= 0 and self.heads[b] is None and self.heads[a] is not None):
            return True
        if a < 0 or self.heads[a] is None:
            return False
        return (self.heads[a], a) < (self.heads[b], b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            node = (w + self.k) // 2
            while node:
                if self._less(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def merged_index(runs: DataFrame) -> DataFrame:
    """All entries in the order of URL key, time and page: by `range`, and in it by `place`. `history` numbers the captures of a URL key.

    Ranges have about RANGE entries whatever a URL's captures are, so their
    number grows with the input; a task merges one range.
    """
    order = ["url_key", "captured", F.col("page_id").asc_nulls_first()]
    dealt = runs.repartitionByRange(max(1, -(-runs.count() // RANGE)), *order).sortWithinPartitions("archive", "record")
    names = [*(c.split()[0] for c in ENTRY.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks() if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        key, when, page, archive = (t[c].to_pylist() for c in ("url_key", "captured", "page_id", "archive"))
        cuts = [0, *(i for i in range(1, len(archive)) if archive[i] != archive[i - 1]), len(archive)]
        pieces = [((key[i], when[i], page[i] is not None, page[i] or 0, i) for i in range(a, z)) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        at, history, last = [], [], None
        for x in LoserTree(pieces):
            at.append(x[4])
            history.append(history[-1] + 1 if history and x[0] == last else 1)
            last = x[0]
        place = TaskContext.get().partitionId()
        out = t.take(pa.array(at)).select(names).append_column("range", pa.array([place] * len(at), pa.int32())).append_column("place", pa.array(range(len(at)), pa.int64()))
        yield from out.append_column("history", pa.array(history, pa.int64())).to_batches(max_chunksize=10_000)

    merged = saved(mapped(dealt, run, f"{ENTRY}, range int, place long, history long"), "merged")
    # A URL key that goes on from one range to the next goes on being counted: it is the first or last key of several.
    ends = merged.groupBy("range").agg(F.array_distinct(F.array(F.min("url_key"), F.max("url_key"))).alias("keys")).select("range", F.explode("keys").alias("url_key"))
    across = ends.groupBy("url_key").agg(F.count("*").alias("n")).where("n > 1").select("url_key")
    each = merged.join(across, "url_key", "left_semi").groupBy("url_key", "range").agg(F.count("*").alias("n"))
    before = each.withColumn("before", F.sum("n").over(Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).where("before > 0").drop("n")
    return merged.join(before, ["url_key", "range"], "left").withColumn("history", F.col("history") + F.coalesce("before", F.lit(0))).drop("before")


def capture_index(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) as archives, reads them back and gives the merged index, written too.

    Of equal payloads of LEAST_BYTES or more, that of the smallest page_id is a
    response, others revisit it. Rows of a null id are responses, as are
    repetitions of a response's row. Of rows that share an id each refers by its
    own payload. An empty table gives an empty index; other columns are ignored.
    Ids are whole numbers.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return merged_index(saved(read_runs(spark, path), "runs"))
