"""WARC records, and resolution of not-modified revisits.

A revisit record of the profile server-not-modified holds the headers of a 304 answer and no payload. It is resolved
by an as-of join: among the full responses for the same canonical URL the latest earlier one, by (time, record id),
is taken; the revisit's validators are checked against it (entity tag first, compared weakly; else Last-Modified; else
the payload digest), and of the 304's headers those that the HTTP standard lets a 304 update replace the stored ones.

The join shuffles headers and digests, never payloads. Records are dealt by URL and stretch of time, so that a URL with
a third of all captures is many small windows; what a stretch inherits from earlier ones is carried along a table with
one row per URL and stretch.

Defined results: a revisit without an earlier full response has status `no_response`; one whose validators differ has
`validator_mismatch` and no payload; a revisit with no validator at all is accepted; null or unparsable URLs resolve
with nothing (`no_url`), and so do records whose date can't be read; repeated records are resolved each; records of equal
time go by (source, record); a damaged record or gzip member ends its file with one row that has `error` set, after the
records before it; null or empty content gives no rows; an empty table gives an empty result. A header field that is
repeated has its values joined by ", ", Set-Cookie, whose values may hold commas, by line ends. Other columns are ignored.

A file is one value in a worker, so files must be smaller than 2 GB each, as web archives by custom are.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import map_batches
from kindred.plans.session import cut

#: Header fields that a 304 answer may update (RFC 9110, 15.4.5; RFC 9111, 4.3.4 without Content-* of the body).
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that don't change what is fetched.
TRACKING = r"^(utm_[^=]*|fbclid|gclid|msclkid|ref|sessionid|phpsessid|sid)(=.*)?$"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: Seconds of a stretch of time.
STRETCH = 3600

RECORD_SCHEMA = "source long, record int, type string, url string, date string, digest string, profile string, status int, headers map<string,string>, payload_sha256 string, payload_bytes long, error string"


def record_bytes(kind: str, url: str, date: str, http: bytes, extra: dict[str, str] | None = None) -> bytes:
    """One WARC/1.1 record around an HTTP message."""
    fields = {"WARC-Type": kind, "WARC-Target-URI": url, "WARC-Date": date, "Content-Type": "application/http; msgtype=response", **(extra or {}), "Content-Length": str(len(http))}
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items()) + b"\r\n" + http + b"\r\n\r\n"


def _fields(block: bytes) -> dict[str, str]:
    """Fields by name in lower case; values of a repeated one are joined."""
    rows: list[list[str]] = []
    for line in block.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and rows:
            rows[-1][1] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if colon:
            rows.append([name.strip().decode("latin-1").lower(), value.strip().decode("utf-8", "replace")])
    out: dict[str, str] = {}
    for name, value in rows:
        out[name] = value if name not in out else out[name] + ("\n" if name == "set-cookie" else ", ") + value
    return out


def _members(data: bytes):
    """The plain bytes, and the error that ended them."""
    plain = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            plain.append(member.decompress(data))
        except zlib.error as e:
            return b"".join(plain), f"a gzip member is damaged: {e}"
        if not member.eof:
            return b"".join(plain), "a gzip member is cut off"
        data = member.unused_data
    return b"".join(plain), None


def parse_records(data: bytes):
    """(warc fields, http status, http headers, payload) of each record; raises ValueError at the first damaged one."""
    error = None
    if data[:2] == b"\x1f\x8b":
        data, error = _members(data)
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC version at byte {at}")
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError(f"the record at byte {at} has no end of its head")
        head = _fields(data[data.find(b"\r\n", at) + 2 : end])
        length = head.get("content-length", "")
        if not length.isdigit() or end + 4 + int(length) > len(data):
            raise ValueError(f"the record at byte {at} is cut off")
        block = data[end + 4 : end + 4 + int(length)]
        status, headers, payload = None, {}, block
        if head.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            first, _, rest = top.partition(b"\r\n")
            words = first.split(b" ", 2)
            status = int(words[1]) if len(words) > 1 and words[1].isdigit() else None
            headers = _fields(rest)
        yield head, status, headers, payload
        at = end + 4 + int(length)
        while data[at : at + 2] == b"\r\n":
            at += 2
    if error:
        raise ValueError(error)


def parse_warc(files: DataFrame, id_col: str = "source", content_col: str = "content") -> DataFrame:
    """A row per record of the WARC bytes in `content_col`: RECORD_SCHEMA. Payloads stay behind as digest and length."""
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.string()] * 5, pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64(), pa.string()]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            k = 0
            try:
                for head, status, headers, payload in parse_records(data or b""):
                    rows.append((source, k, head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-payload-digest"), head.get("warc-profile"), status, list(headers.items()), hashlib.sha256(payload).hexdigest(), len(payload), None))
                    k += 1
            except ValueError as e:
                rows.append((source, k, *[None] * 6, [], None, None, str(e)))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return map_batches(files.select(F.col(f"`{id_col}`").cast("long").alias("source"), F.col(f"`{content_col}`").cast("binary").alias("content")), RECORD_SCHEMA, work)


def read_warc(spark, path: str) -> DataFrame:
    """Records of the WARC files under `path`; files are told apart by the hash of their path."""
    return parse_warc(spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("source"), "content"))


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path, and sorted query without tracking parameters; no scheme, no fragment."""
    bare = F.regexp_replace(url, "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored headers, with the permitted ones of the update in their place."""
    allowed = F.map_filter(update, lambda k, v: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def resolve_revisits(records: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Each revisit (source, record, url, date) with canonical_url, status, the response it stands for and its merged headers."""
    named = records.where("type IN ('response', 'revisit') AND error IS NULL").select(
        "source", "record", "type", "url", "date", "digest", F.col("status").alias("http_status"), "headers", "payload_sha256", "payload_bytes", canonical_url(F.col("url")).alias("canonical_url"), F.try_to_timestamp("date").alias("at")
    )
    named = named.withColumn("_stretch", F.floor(F.unix_timestamp("at") / stretch))
    named = cut(named)
    known = named.where("canonical_url IS NOT NULL AND at IS NOT NULL")
    full = F.when((F.col("type") == "response") & (F.col("http_status") == 200), F.struct("source", "record", "at", "digest", "headers", "payload_sha256", "payload_bytes"))
    order = ["at", "source", "record"]
    # what each stretch hands on: the last full response in it, then the last over all earlier stretches of the URL
    last = known.where((F.col("type") == "response") & (F.col("http_status") == 200)).groupBy("canonical_url", "_stretch").agg(F.max_by(full, F.struct(*order)).alias("_last"))
    stretches = known.select("canonical_url", "_stretch").distinct().join(last, ["canonical_url", "_stretch"], "left")
    earlier = Window.partitionBy("canonical_url").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select("canonical_url", "_stretch", F.last("_last", ignorenulls=True).over(earlier).alias("_inherited"))
    before = Window.partitionBy("canonical_url", "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = known.withColumn("_own", F.last(full, ignorenulls=True).over(before)).where("type = 'revisit'")
    found = found.join(stretches, ["canonical_url", "_stretch"]).withColumn("_from", F.coalesce("_own", "_inherited"))
    lost = named.where("type = 'revisit' AND (canonical_url IS NULL OR at IS NULL)")
    tag, stored_tag = F.element_at("headers", "etag"), F.element_at(F.col("_from.headers"), "etag")
    since, stored_since = F.element_at("headers", "last-modified"), F.element_at(F.col("_from.headers"), "last-modified")
    same = F.when(tag.isNotNull(), F.coalesce(_weak(tag) == _weak(stored_tag), F.lit(False))).when(since.isNotNull(), F.coalesce(since == stored_since, F.lit(False)))
    same = same.when(F.col("digest").isNotNull(), F.coalesce(F.col("digest") == F.col("_from.digest"), F.lit(False))).otherwise(F.lit(True))
    status = F.when(F.col("_from").isNull(), "no_response").when(same, "resolved").otherwise("validator_mismatch")
    ok = F.col("status") == "resolved"
    out = found.withColumn("status", status).select(
        "source", "record", "url", "canonical_url", "date", "status",
        F.when(ok, F.col("_from.source")).alias("response_source"), F.when(ok, F.col("_from.record")).alias("response_record"), F.when(ok, F.col("_from.payload_sha256")).alias("payload_sha256"), F.when(ok, F.col("_from.payload_bytes")).alias("payload_bytes"),
        F.when(ok, merged_headers(F.col("_from.headers"), F.col("headers"))).alias("headers"),
    )
    none = lost.select("source", "record", "url", "canonical_url", "date", F.lit("no_url").alias("status"), *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in out.columns[6:]])
    return out.unionByName(none)


def header_lines(headers: Column) -> Column:
    """Headers as sorted lines `name: value`."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def pages_as_warc(pages: DataFrame) -> DataFrame:
    """(source, content): each page as a WARC file of its capture and of a later not-modified revisit.

    Times and validators follow from page_id: captures are ten seconds apart, a revisit comes up to six hours later, so
    that other captures of the same canonical URL may lie between; some revisits carry a weak tag, some Last-Modified only.
    """
    from datetime import UTC, datetime, timedelta

    start = datetime(2024, 1, 1, tzinfo=UTC)
    stamp = lambda s: (start + timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for page, url, html in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            body, n = (html or "").encode(), page or 0
            tag, since = f'"{hashlib.md5(body).hexdigest()[:16]}"', f"day {n % 365}"
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\nETag: {tag}\r\nLast-Modified: {since}\r\nCache-Control: max-age={n % 100}\r\nX-Page: {n}\r\n\r\n".encode() + body
            if n % 11 == 0:
                validator = f"Last-Modified: {since}"
            else:
                validator = f"ETag: {'W/' if n % 13 == 0 else ''}{tag}"
            again = f"HTTP/1.1 304 Not Modified\r\n{validator}\r\nCache-Control: max-age={n % 1000}\r\nX-Again: {n}\r\n\r\n".encode()
            late = 10 * n + 5 + 3600 * (n % 7)
            out.append(record_bytes("response", url or "", stamp(10 * n), http) + record_bytes("revisit", url or "", stamp(late), again, {"WARC-Profile": PROFILE}))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["source", "content"])

    return map_batches(pages.select("page_id", "url", "html"), "source long, content binary", work)
