"""WARC records and the resolution of not-modified revisits.

A revisit says that the server answered "not modified": its content is that of an earlier full response of the same
URL. Resolution is an as-of join: by canonical URL, the latest response strictly before the revisit in (ts, record_id),
whose validators are then compared, and whose headers take over those a 304 answer may update. A revisit that names the
record it refers to (refers_to_url, refers_to_ts) looks there: by that URL, at that time or before.

The as-of join holds no URL in one task: records are cut into time chunks of about `chunk_rows` records, at quantiles
of the time, a URL's last response of each chunk is found by a grouping with map-side combine and carried to its later
chunks, and only the records of one URL in one chunk are ordered together. Bodies don't take part; they are joined by
record_id at the end.

status of a revisit: `resolved` (a validator is on both sides and none differs; entity tags compare weakly),
`mismatch` (one differs), `unverified` (none on both sides), `orphan` (no earlier response).

Definitions: records without a URL or time are orphans and never a base; null headers are empty; of records with the
same ts the smaller record_id is earlier, and a null record_id is before all others and never a base; repeated rows
are resolved each, and a base that is repeated counts once (its smallest body). Bodies are bytes, and whole. An empty
table gives an empty result, further columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, batch, materialize

CHUNK_ROWS = 1_000_000
#: Header fields that a 304 answer may replace in the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
RECORD = "record_id bigint, url string, ts bigint, kind string, headers map<string,string>, body binary"
#: Columns a table of records may have besides: what WARC-Refers-To-Target-URI and WARC-Refers-To-Date say.
REFERS = {"refers_to_url": "string", "refers_to_ts": "bigint"}


def canonical_url(url: Column) -> Column:
    """What names a resource: without scheme, leading www., default port, fragment, tracking parameters and the slash of
    an empty path; the host is lowered. Path, other hosts and other parameters stay as they are."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(u, r"^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_replace(u, r"^[^/?]*", "")
    rest = F.regexp_replace(rest, r"([?&])((utm_[a-z]*|ref)=[^&]*(&|$))+", "$1")
    rest = F.regexp_replace(rest, r"[?&]$", "")
    return F.concat(host, F.when(rest == "/", "").otherwise(rest))


def quantiles(records: DataFrame, chunk_rows: int) -> list[int]:
    """Times that cut records into chunks of about chunk_rows."""
    chunks = max(1, -(-records.count() // chunk_rows))
    if chunks == 1:
        return []
    found = records.agg(F.percentile_approx("ts", [i / chunks for i in range(1, chunks)], 100 * chunks)).first()[0]
    return sorted(set(found or []))


def chunked(records: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """records with chunk, the number of quantiles up to their ts; equal ts share one."""
    cuts = quantiles(records, chunk_rows)
    if not cuts:
        return records.withColumn("chunk", F.lit(0))
    step = max(1, int(len(cuts) ** 0.5))
    heads, parts = cuts[::step], [cuts[i : i + step] for i in range(0, len(cuts), step)]
    # two short scans in place of one over all cuts
    part = F.size(F.filter(F.array(*map(F.lit, heads)), lambda x: x <= F.col("ts")))
    within = F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in parts)), F.greatest(part, F.lit(1)))
    return records.withColumn("chunk", F.when(part == 0, 0).otherwise((part - 1) * step + F.size(F.filter(within, lambda x: x <= F.col("ts")))))


def latest_responses(records: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(record_id, key, ts, base_id) of the revisits of records (record_id, key, ts, kind): the as-of join.

    With a column `upto` (boolean) responses at the very ts of a revisit that has it set count as earlier too."""
    rows = chunked(records.where("key is not null and ts is not null"), chunk_rows)
    place = F.when(F.col("kind") == "response", F.when(F.col("record_id").isNotNull(), F.struct("ts", "record_id")))
    last = rows.groupBy("key", "chunk").agg(F.max(place).alias("last"))
    carried = last.select("key", "chunk", F.last("last", True).over(Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    order = [*(["_late"] if "upto" in records.columns else []), "record_id"]
    rows = rows.withColumn("_late", F.coalesce("upto", F.lit(False)) & (F.col("kind") == "revisit")) if len(order) > 1 else rows
    inside = Window.partitionBy("key", "chunk").orderBy("ts", *order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("own", F.last(place, True).over(inside)).where(F.col("kind") == "revisit")
    base = F.coalesce("own", "carried")["record_id"]
    return found.join(carried, ["key", "chunk"], "left").select("record_id", "key", "ts", base.alias("base_id"))


def weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^[Ww]/", "")


def lowered(headers: Column) -> Column:
    """headers with names in lower case; of names that then agree the last in order stays."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    clean = F.transform(entries, lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    alone = F.filter(clean, lambda e, i: ~F.exists(F.slice(clean, i + 2, F.greatest(F.size(clean) - i - 1, F.lit(0))), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(alone)


def merged_headers(base: Column, revisit: Column) -> Column:
    """The base's headers with the permitted ones of the revisit in their place."""
    own = F.map_filter(revisit, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)


def resolve_revisits(records: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """record_id, url (canonical), ts, base_id, status, headers, body of every revisit of records (see RECORD)."""
    for name, kind in REFERS.items():
        if name not in records.columns:
            records = records.withColumn(name, F.lit(None).cast(kind))
    revisit = F.col("kind") == "revisit"
    key, at = F.when(revisit, canonical_url(F.col("refers_to_url"))), F.when(revisit, F.least("refers_to_ts", "ts"))
    own = records.select(
        "record_id", canonical_url(F.col("url")).alias("url"), F.coalesce(key, canonical_url(F.col("url"))).alias("key"), "ts", F.when(F.col("ts").isNotNull(), F.coalesce(at, "ts")).alias("at"),
        F.col("refers_to_ts").isNotNull().alias("upto"), "kind", lowered(F.col("headers")).alias("headers"), F.col("body").cast("binary").alias("body"),
    )
    slim = own.select("record_id", "key", F.col("at").alias("ts"), "kind", "upto")
    found = materialize(latest_responses(slim, chunk_rows).distinct(), "asof").where("base_id is not null")
    revisits = own.where(revisit).select("record_id", "url", "key", "ts", "at", F.col("headers").alias("told"))
    on = [revisits["record_id"].eqNullSafe(found["record_id"]), revisits["key"] == found["key"], revisits["at"] == found["ts"]]
    placed = revisits.join(found, on, "left").select(revisits["record_id"], "url", revisits["ts"], "told", "base_id")
    wanted = found.select("base_id").distinct()
    base = own.where(F.col("kind") == "response").join(wanted, F.col("record_id") == wanted["base_id"], "left_semi").groupBy("record_id").agg(F.min(F.struct("body", F.map_entries("headers").alias("h"))).alias("r")).select(F.col("record_id").alias("base_id"), F.map_from_entries("r.h").alias("had"), F.col("r.body").alias("body"))
    base = materialize(base, "bases", "zstd")  # the join's sides are then two exchanges, between which Spark splits a base with many revisits
    joined = placed.join(base, "base_id", "left")
    same = [(told.isNotNull() & had.isNotNull(), told == had) for told, had in ((weak(F.col("told")["etag"]), weak(F.col("had")["etag"])), (F.col("told")["last-modified"], F.col("had")["last-modified"]))]
    differs = F.lit(False)
    both = F.lit(False)
    for there, equal in same:
        both, differs = both | there, differs | (there & ~equal)
    status = F.when(F.col("base_id").isNull(), "orphan").when(differs, "mismatch").when(both, "resolved").otherwise("unverified")
    taken = status.isin("resolved", "unverified")
    return joined.select(
        "record_id", "url", "ts", "base_id", status.alias("status"),
        F.when(taken, merged_headers(F.col("had"), F.col("told"))).otherwise(F.col("told")).alias("headers"), F.when(taken, F.col("body")).alias("body"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """A crawl history (see RECORD) of pages (page_id, url, html), which has one capture of each page.

    Each page is a full response at time 10 * page_id and is asked for again at 10 * page_id + 5 with the validators it
    gave; every seventh page by then answers for another version, every eleventh without a validator. Every thirteenth
    page was met as a revisit only."""
    i = F.col("page_id")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    first = pages.where(i % 13 != 0).select(
        (i * 2).alias("record_id"), "url", (i * 10).alias("ts"), F.lit("response").alias("kind"),
        F.create_map(F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), (i * 10).cast("string")).alias("headers"), F.col("html").cast("binary").alias("body"),
    )
    told = F.when(i % 7 == 0, F.lit('"other"')).when(i % 11 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("W/"), tag))
    again = pages.select(
        (i * 2 + 1).alias("record_id"), "url", (i * 10 + 5).alias("ts"), F.lit("revisit").alias("kind"),
        F.create_map(F.lit("etag"), told, F.lit("date"), (i * 10 + 5).cast("string"), F.lit("content-type"), F.lit("text/plain")).alias("headers"), F.lit(None).cast("binary").alias("body"),
    )
    return first.union(again)


# Reading and writing WARC files.


#: Bytes of bodies that one batch of read records holds.
BATCH_BYTES = 16 << 20


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC fields, HTTP headers, body) of the records of a WARC file, plain or gzipped, one after another: no more than
    a record is unpacked at a time. A broken end is left out."""
    stream = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            fields = read_fields(stream)
            size = int(fields.get("content-length", "0") or 0)
            block = stream.read(size)
            if len(block) < size:
                return
            head: dict[str, str] = {}
            if block.startswith(b"HTTP/"):
                part = io.BytesIO(block)
                part.readline()
                head = read_fields(part)
                block = part.read()
            yield fields, head, block
    except (EOFError, gzip.BadGzipFile, zlib.error):
        return


def read_fields(stream: io.BytesIO) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def format_record(fields: dict[str, str], head: dict[str, str], body: bytes) -> bytes:
    block = body
    if head or fields.get("WARC-Type") in ("response", "revisit"):
        block = b"HTTP/1.1 200 OK\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + body
    fields = fields | {"Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items()) + b"\r\n" + block + b"\r\n\r\n"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records (see RECORD, with REFERS) of WARC files; record_id is a hash of WARC-Record-ID, ts seconds of WARC-Date.

    A file is a row of bytes, so it is 2 GB at most, as Spark's binary reader has it; its records are unpacked one by one."""
    raw = spark.read.format("binaryFile").load(path).select("content")
    fields = {"id": "warc-record-id", "url": "warc-target-uri", "date": "warc-date", "kind": "warc-type", "other_url": "warc-refers-to-target-uri", "other_date": "warc-refers-to-date"}
    names = [*fields, "headers", "body"]

    def pack(rows: list) -> pa.RecordBatch:
        columns = [pa.array([f.get(k) for f, _, _ in rows], pa.string()) for k in fields.values()]
        return batch(names, [*columns, pa.array([list(h.items()) for _, h, _ in rows], pa.map_(pa.string(), pa.string())), pa.array([x for *_, x in rows], pa.binary())])

    def factory():
        def step(b: pa.RecordBatch):
            for data in b.column(0):
                rows, held = [], 0
                for record in parse_warc(data.as_buffer().to_pybytes()):
                    if record[0].get("warc-type") in ("response", "revisit"):
                        rows.append(record)
                        held += len(record[2])
                    if held > BATCH_BYTES:
                        yield pack(rows)
                        rows, held = [], 0
                yield pack(rows)

        return step

    rows = arrow_map(raw, ", ".join(f"{n} string" for n in fields) + ", headers map<string,string>, body binary", factory, rows=1)
    seconds = lambda c: F.unix_timestamp(F.to_timestamp(c))
    return rows.select(F.xxhash64("id").alias("record_id"), "url", seconds("date").alias("ts"), "kind", "headers", "body", F.col("other_url").alias("refers_to_url"), seconds("other_date").alias("refers_to_ts"))
