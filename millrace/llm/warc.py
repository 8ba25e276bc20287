"""Operator 3: WARC archives, written with segments and read back whole.

Writing: a page is an HTTP response in chunked transfer framing. One longer than
a segment goes on in continuation records, which name their origin and their
number; the last tells the total length. So no record is longer than a segment,
and with a number of records for each file no file is larger than a bound. Of
pages with equal payloads one is a response, the others are revisits that give
its digest and its record. Which page is what is settled on ids and digests
alone; payloads are not shuffled, but for a set of revisits too large to be
broadcast.

Reading: files are read piece by piece, a piece being what stands between record
marks, and never as a whole. A block that holds a mark itself comes in several
pieces, which are put together by its Content-Length. A record whose length is
not its Content-Length is reported, not guessed. Segments are grouped by the
identifier of their origin, put in order, joined and held against the total
length; then the chunks are decoded. Records of one segment are not shuffled.

Archives are written and read by Spark's own text source, so any file system
that Spark knows will do.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, checkpoint, delete_path, fresh_path, key_text, small_batches, table

VERSION = "WARC/1.1"
#: What stands between records, as far as all versions have it in common.
MARK = "\r\n\r\nWARC/"
SEGMENT = 32 << 10
#: Records a file; with segments as above, 32 MB at most before compression.
RECORDS = 1024
CHUNK = 8 << 10
#: A block that claims more bytes than this is reported and not put together: it would not fit in a task's memory.
LONGEST = 256 << 20
BASE16, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(sha1_hex: Column) -> Column:
    """A SHA-1 in hex digits as bare base32: four times 40 bits are eight digits."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), BASE16, BASE32)


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked framing."""
    parts = (payload[at : at + size] for at in range(0, len(payload), size))
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken or not ended."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0].strip(), 16)
        at = line + 2 + size
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it says")
        out.append(body[line + 2 : at])
        at += 2


def segments_of(record: str, head: str, payload: bytes, segment: int) -> list[bytes]:
    """The records of one response, from the line after the version on; head has the first one's own lines, date the last of them."""
    block = HTTP + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = []
    for n, part in enumerate(parts, 1):
        own = ["WARC-Type: response", f"WARC-Record-ID: <{record}>", head] if n == 1 else ["WARC-Type: continuation", f"WARC-Record-ID: <{record}:segment:{n}>", f"WARC-Segment-Origin-ID: <{record}>", head.rpartition("\r\n")[2]]
        own += [f"WARC-Segment-Number: {n}"] if len(parts) > 1 else []
        own += [f"WARC-Segment-Total-Length: {len(block)}"] if n == len(parts) > 1 else []
        out.append("\r\n".join([*own, "Content-Type: application/http;msgtype=response", f"Content-Length: {len(part)}"]).encode() + b"\r\n\r\n" + part)
    return out


def write(pages: DataFrame, path: str, segment: int = SEGMENT, records: int = RECORDS, least_bytes: int = 0, page: str = "page_id", url: str = "url", html: str = "html", date: str | None = None) -> None:
    """Write the pages as gzipped archives below path.

    Of equal payloads of `least_bytes` or more, that with the largest page_id
    is a response; so are rows that repeat this page_id, and all rows where
    every page_id is null. The others are revisits of it. A null payload is an
    empty one. Line ends within an url are left out. `date` (like
    2001-02-03T04:05:06Z) stands for the time of writing. Rows equal in all
    three columns are records of their own, each with its own identifier.
    """
    if segment < len(HTTP):
        raise ValueError("a segment must hold the HTTP head")
    small_batches(pages.sparkSession)
    raw = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), r"[\r\n]", "").alias("url"), raw.alias("payload"))
    rows = rows.withColumn("digest", base32(F.sha1("payload")))
    rows = rows.withColumn("record", F.concat_ws(":", F.lit("urn:x-page"), key_text("page_id"), F.md5(F.concat_ws("|", "digest", "url"))))
    when = F.lit(date or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))
    slim = checkpoint(rows.groupBy("page_id", "url", "digest", "record", (F.octet_length("payload") >= least_bytes).alias("counts")).agg(F.count("*").alias("n")).withColumn("date", when))
    # One page for each payload that is there more than once; of pages with one id the one with the greatest url.
    most = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "record")))
    first = checkpoint(slim.where("counts").groupBy("digest").agg(most.alias("w"), F.count("*").alias("pages")).where("pages > 1 AND w IS NOT NULL").select("digest", "w"))
    again = slim.where("counts").join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("w.page_id")))
    again = checkpoint(again)

    def numbered(of: DataFrame, *keep: str) -> DataFrame:
        """A row for each of the n, the first with the record as it is; very many of one row are dealt out to the tasks."""
        parts = of.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(RECORDS).cast("long"))).alias("from"))
        parts = parts.repartition(int(of.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rows = parts.select("*", F.explode(F.sequence(F.col("from"), F.least(F.col("n"), F.col("from") + RECORDS - 1))).alias("nth"))
        name = F.when(F.col("nth") == 1, F.col("record")).otherwise(F.concat_ws(":", F.col("record"), F.col("nth").cast("string")))
        return rows.select(*keep, name.alias("record"))

    own = F.concat(F.lit("WARC-Target-URI: "), "url", F.lit("\r\nWARC-Payload-Digest: sha1:"), "digest", F.lit("\r\nX-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    revisit = F.concat(
        F.lit("WARC-Type: revisit\r\nWARC-Record-ID: <"), "record", F.lit(">\r\n"), own, F.lit("\r\nWARC-Date: "), "date", F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <"), F.col("w.record"), F.lit(">\r\nWARC-Refers-To-Target-URI: "), F.col("w.url"),
        F.lit("\r\nWARC-Refers-To-Date: "), "date", F.lit("\r\nX-Refers-To-Page-ID: "), F.col("w.page_id").cast("string"), F.lit("\r\nContent-Length: 0\r\n\r\n"),
    )
    revisits = numbered(again, "page_id", "url", "digest", "w", "date").select(revisit.alias("r"))

    @F.pandas_udf("array<binary>")
    def responses(record: pd.Series, head: pd.Series, payload: pd.Series) -> pd.Series:
        return pd.Series([segments_of(r, h, p, segment) for r, h, p in zip(record, head, payload, strict=True)])

    whole = rows.join(bounded(again.select("record")), "record", "left_anti").withColumn("date", when)
    repeated = checkpoint(slim.where("n > 1").select("record", "n").join(again.select("record"), "record", "left_anti"))
    if not repeated.isEmpty():
        repeated = bounded(repeated)
        several = numbered(whole.join(repeated, "record").dropDuplicates(["record"]), *(c for c in whole.columns if c != "record"))
        whole = whole.join(repeated, "record", "left_anti").select(*several.columns).union(several)
    whole = whole.select(F.explode(responses("record", F.concat(own, F.lit("\r\nWARC-Date: "), "date"), "payload")).alias("r")).select(F.col("r").cast("string").alias("r"))
    both = whole.union(revisits)
    both.select(F.concat(F.lit(f"{VERSION}\r\n"), "r", F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


_LENGTH = re.compile(rb"(?i)\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r\n")
_VERSION = re.compile(rb"\d\.\d+\r\n")


def whole_records(pieces: Iterator[tuple[bytes, bool]]) -> Iterator[tuple[bytes, bytes, str | None]]:
    """Head, block and error of each record; a piece comes with whether it is the first of its file."""
    waiting: list[bytes] = []  # pieces of one file from the start of a record on
    used = have = 0  # how many of them the first one's block takes so far, and their bytes

    def judged(end: bool) -> Iterator[tuple[bytes, bytes, str | None]]:
        """What is settled; with `end`, no piece comes any more."""
        nonlocal used, have
        while waiting:
            mark, taken = MARK.encode(), 1
            head, blank, block = waiting[0].partition(b"\r\n\r\n")
            if not blank and _VERSION.match(waiting[0]):  # a block that begins like a record has made a mark of the blank line
                if len(waiting) > 1:
                    taken = 2
                    head, _, block = mark.join(waiting[:2]).partition(b"\r\n\r\n")
                elif not end:
                    return
            found = _LENGTH.search(b"\r\n" + head + b"\r\n")
            length, error = int(found[1]) if found else 0, None
            if not _VERSION.match(waiting[0]):
                error = "no record"
            elif not found:
                error = "no Content-Length"
            elif length > LONGEST:
                error = "a block too long to read"
            else:
                if not used:
                    used, have = taken, len(block)
                while have < length and used < len(waiting):
                    have += len(mark) + len(waiting[used])
                    used += 1
                if have < length and not end:
                    return
                block = mark.join([block, *waiting[taken:used]])
                spare = block[length:]
                if have < length or spare and not (end and used == len(waiting) and spare in (b"\r\n", b"\r\n\r\n")):
                    error = "a block that is not as long as its Content-Length"
            yield head, b"" if error else block[:length], error
            del waiting[: 1 if error else used]  # after an error, the next piece may be a record of its own
            used = have = 0

    for piece, starts in pieces:
        if starts:
            yield from judged(True)
            if not piece.strip(b"\r\n"):
                continue
            piece = piece.removeprefix(b"WARC/")
        waiting.append(piece)
        if len(waiting) > 1:  # the last of a file may have line ends to spare
            held = waiting.pop()
            yield from judged(False)
            waiting.append(held)
    yield from judged(True)


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of archives: type, id, origin, number, total, digest, page_id, refers_to, uri, block, error.

    Records of any version are read, and blocks that hold record marks. Of
    archives that Spark splits (those not compressed), a block that goes over
    the border of a split is whole only if it holds no mark.
    """
    text = spark.read.option("lineSep", MARK).text(path).select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[bytes, bool]]:
            before = None
            for b in batches:
                for piece, *file in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    yield piece, file != before
                    before = file

        out, size = [], 0
        for head, block, error in whole_records(pieces()):
            out.append((head, block, error))
            size += len(block)
            if size > 4 << 20 or len(out) > 500:
                yield told(out)
                out, size = [], 0
        if out:
            yield told(out)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())], names=["head", "block", "error"])

    rows = text.mapInArrow(put_together, "head binary, block binary, error string").withColumn("head", F.col("head").cast("string"))

    def field(name: str) -> Column:
        """A header field's value without the angle brackets around it; null where there is none."""
        said = F.trim(F.regexp_extract(F.concat(F.lit("\r\n"), "head"), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1))
        return F.nullif(F.regexp_replace(said, "^<(.*)>$", "$1"), F.lit(""))

    return rows.select(
        field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("id"), field("WARC-Segment-Origin-ID").alias("origin"), field("WARC-Segment-Number").try_cast("long").alias("number"), field("WARC-Segment-Total-Length").try_cast("long").alias("total"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"), field("X-Page-ID").try_cast("long").alias("page_id"), field("X-Refers-To-Page-ID").try_cast("long").alias("refers_to"), field("WARC-Target-URI").alias("uri"), "block", "error",
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each response or revisit: page_id, uri, record_type, refers_to, digest (as the record gives it), payload, error.

    payload is null for revisits and for records with an error: a length that
    is not as told, a segment missing or twice, a broken chunk. An origin
    missing for its continuations is a row of its own with an error. Other
    record types are passed over. An archive without records gives no rows.
    """
    small_batches(spark)
    rows = records(spark, path).where(F.col("type").isin("response", "continuation", "revisit") | F.col("error").isNotNull())
    alone = rows.where("number IS NULL").select("type", "page_id", "uri", "refers_to", "digest", "block", "error")
    parts = rows.where("number IS NOT NULL").groupBy(F.coalesce("origin", "id").alias("id")).agg(
        *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("type", "page_id", "uri", "refers_to", "digest")],
        F.max("total").alias("total"), F.count("*").alias("n"), F.max("error").alias("error"), F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),  # the segments of one page
    )
    in_order = F.forall(F.arrays_zip(F.sequence(F.lit(1), F.col("n").cast("int")).alias("i"), F.col("parts.number").alias("k")), lambda x: x["i"] == x["k"])
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    wrong = F.when(F.col("type").isNull(), "no first segment").when(~in_order, "segments missing or twice").when(~F.octet_length("block").cast("long").eqNullSafe(F.col("total")), "segments are not as long as their total")
    joined = parts.withColumn("in_order", in_order).withColumn("block", block).select("type", "page_id", "uri", "refers_to", "digest", "block", F.coalesce("error", wrong).alias("error"))

    @F.pandas_udf("struct<payload: binary, error: string>")
    def decoded(blocks: pd.Series) -> pd.DataFrame:
        out = []
        for b in blocks:
            if b is None:
                out.append((None, None))
                continue
            try:
                head, _, body = b.partition(b"\r\n\r\n")
                framed = b"\r\ntransfer-encoding: chunked" in head.lower()
                out.append((dechunked(body) if framed else body, None))
            except ValueError as e:
                out.append((None, f"chunked framing: {e}"))
        return pd.DataFrame(out, columns=["payload", "error"])

    sound = (F.col("type") == "response") & F.col("error").isNull()
    every = alone.union(joined).withColumn("d", decoded(F.when(sound, F.coalesce("block", F.lit(b"")))))
    return every.select("page_id", "uri", F.col("type").alias("record_type"), "refers_to", "digest", F.col("d.payload").alias("payload"), F.coalesce("error", "d.error").alias("error"))


def resolved(rows: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, error of what read() gives; revisits have the length of the payload with their digest.

    A revisit whose digest no response has is an error, as is a payload with
    another digest than its record tells; a response without a digest is none.
    Repeated rows come out as often as they went in, no rows give none.
    """
    own = rows.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(F.col("payload").isNotNull(), base32(F.sha1("payload"))).alias("own_digest"), "record_type", "refers_to", "digest", "error")
    own = checkpoint(own)
    known = own.where("record_type = 'response' AND error IS NULL").groupBy(F.col("own_digest").alias("of")).agg(F.max("payload_bytes").alias("bytes"))
    known = checkpoint(known)  # kept apart from the join, so that Spark can split a payload that very many revisit
    again = own.where("record_type = 'revisit' AND error IS NULL").join(known, F.col("digest") == F.col("of"), "left")
    again = again.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", F.when(F.col("of").isNull(), "no response has its payload").alias("error"))
    rest = own.where("record_type <> 'revisit' OR record_type IS NULL OR error IS NOT NULL")
    off = F.when(F.col("own_digest") != F.col("digest"), "the payload has another digest")
    return again.union(rest.select("page_id", "payload_bytes", F.col("own_digest").alias("payload_digest"), "record_type", "refers_to", F.coalesce("error", off).alias("error")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    back = checkpoint(resolved(read(spark, path)))
    delete_path(spark, path)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


#: What writing and reading must give: each five bits of the SHA-1 are a digit, eight digits to ten of its hex digits.
ORACLE = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 1 + 10 * CAST(k // 8 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (k % 8) AS BIGINT)) & 31 AS BIGINT) + 1, 1) for k in range(32)], '') AS payload_digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS largest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to, CAST(NULL AS VARCHAR) AS error FROM w
"""

QUERIES = {"op3_warc": op3_warc}
ORACLES = {"op3_warc": ORACLE}
