"""Packing of tokenized documents into sequences by shortest-pack-first over the length histogram.

Documents are cut into full sequences and one remainder. The histogram of piece lengths (at most `limit` entries)
comes to the driver, where lengths are placed longest first, each into the shortest open patterns, those with the most
space; patterns carry counts, so the work there depends on the limit alone. Pieces then get a rank among those of
their length and find the pattern, the sequence and the offset of that rank by a join with the patterns' intervals.

Ranks are counted in two steps, so that no task holds all pieces of a length: the n pieces of a length are dealt over
about sqrt(n) hash buckets, numbered there, and each bucket's first rank is the sum of the buckets before it. So a
length has as many buckets as a bucket has pieces, and both steps grow with the root of the input.

Definitions: a null or empty text is one piece, the end id alone; a repeated row is packed as a row of its own; null
doc_ids are kept. An empty table gives an empty result, further columns are ignored.
"""

from __future__ import annotations

import base64
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, batch, materialize, strings

LIMIT, END_ID = 1024, 0
#: Code points that the fast path knows by class; texts with others go to the tokenizer whole.
KNOWN = 0x250
CACHE = 1 << 18


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(KNOWN) if unicodedata.category(chr(c))[0] == kind)


def pieces_pattern() -> re.Pattern:
    """The pre-tokenizer's pattern, for code points under KNOWN."""
    letters, numbers, space = _class("L"), _class("N"), "\\t-\\r \\x85\\xa0"
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


class ByteBPE:
    """Ids of byte-level BPE, as tokenizers gives them: pre-tokens are looked up in a bounded cache.

    tokens_path: a tokenizers file. ranks_path: the same vocabulary for tiktoken, which encodes a single pre-token
    faster; without it tokenizers does that too."""

    def __init__(self, tokens_path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokens_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.other = re.compile(f"[^\x00-{chr(KNOWN - 1)}]" + "".join(f"|{re.escape(t)}" for t in self.special))
        self.find, self.cache = pieces_pattern().findall, self.Cache()
        if ranks_path:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
            self.cache.one = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            self.cache.one = lambda s: self.whole.encode(s, add_special_tokens=False).ids

    class Cache(dict):
        def __missing__(self, piece: str) -> bytes:
            if len(self) >= CACHE:
                self.clear()
            ids = np.array(self.one(piece), "<u4").tobytes()
            if len(piece) <= 64:
                self[piece] = ids
            return ids

    def ids(self, text: str) -> np.ndarray:
        if self.other.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        cache = self.cache
        return np.frombuffer(b"".join([cache[p] for p in self.find(text)]), "<u4")


def pieces(docs: DataFrame, tokens_path: str, ranks_path: str | None, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens) of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def factory():
        bpe, end = ByteBPE(tokens_path, ranks_path), np.array([end_id], "<u4")

        def step(b: pa.RecordBatch):
            rows: list[tuple[int, int, int, int, int]] = []
            for i, text in enumerate(strings(b.column(1))):
                ids = np.concatenate([bpe.ids(text), end])
                rows += [(i, at, len(x := ids[at : at + limit]), zlib.crc32(x.tobytes()), len(ids)) for at in range(0, len(ids), limit)]
            own = np.array(rows, np.int64).reshape(-1, 5)
            yield batch(names, [b.column(0).take(pa.array(own[:, 0].copy())), *(pa.array(own[:, k].copy()) for k in range(1, 5))])

        return step

    return arrow_map(docs.select("doc_id", "text"), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint", factory)


def patterns(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """Shortest-pack-first: (lengths of a pattern, number of sequences that have it).

    Lengths come longest first. Each goes into the shortest of the open patterns, those with the most space, then the
    next ones; a pattern that took it can take it again. What fits into none opens patterns with as many copies of it
    as a sequence holds."""
    by_space: list[Counter] = [Counter() for _ in range(limit + 1)]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for space in range(limit - 1, length - 1, -1):
            if not left:
                break
            for pattern in sorted(by_space[space]):
                if not left:
                    break
                n = min(left, by_space[space][pattern])
                by_space[space][pattern] -= n
                if not by_space[space][pattern]:
                    del by_space[space][pattern]
                by_space[space - length][(*pattern, length)] += n
                left -= n
        for copies, n in ((limit // length, left // (limit // length)), (left % (limit // length), 1)):
            if copies and n:
                by_space[limit - copies * length][(length,) * copies] += n
    return sorted((p, n) for group in by_space for p, n in group.items())


def intervals(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """For ranks of a length: (length, first rank, ranks, first sequence, offset); sequences count from 0."""
    next_rank: Counter = Counter()
    out, sequence = [], 0
    for pattern, n in found:
        offset = 0
        for length in pattern:
            out.append((length, next_rank[length], n, sequence, offset))
            next_rank[length] += n
            offset += length
        sequence += n
    return out


def ranked(rows: DataFrame, lengths: DataFrame, bucket_rows: int | None = None) -> DataFrame:
    """rows with rank, from 0 among those of their length, and the places that ranks of its bucket can have.

    lengths (length, total, places) is a row for each length: a length's rows are dealt to as many buckets as its own
    number asks for (bucket_rows: rows of one, about; by default the root of the number), numbered within them, and a
    bucket starts where those before it end."""
    buckets = F.ceil(F.col("total") / bucket_rows if bucket_rows else F.sqrt("total"))
    dealt = rows.join(F.broadcast(lengths.select("length", "total")), "length")
    dealt = dealt.withColumn("_b", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), buckets).cast("int")).drop("total")
    sizes = dealt.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a bucket takes over the few places that its ranks meet, so that no row looks through all places of its length
    meets = F.filter("places", lambda x: (x["lo"] < F.col("_first") + F.col("_n")) & (x["lo"] + x["n"] > F.col("_first")))
    before = before.join(F.broadcast(lengths), "length").select("length", "_b", "_first", meets.alias("_places"))
    own = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    numbered = dealt.withColumn("_own", own - 1).join(before, ["length", "_b"])
    return numbered.withColumn("rank", F.col("_first") + F.col("_own")).drop("_b", "_own", "_first")


def pack(rows: DataFrame, limit: int = LIMIT, bucket_rows: int | None = None) -> DataFrame:
    """rows (with length, doc_id, start, ids_crc32, doc_tokens) with sequence_id and offset."""
    spark = rows.sparkSession
    histogram = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}
    places = defaultdict(list)
    for length, *place in intervals(patterns(histogram, limit)):
        places[length].append(tuple(place))
    # this table's size depends on the limit alone: at most limit lengths, a few thousand places
    kind = "length bigint, total bigint, places array<struct<lo:bigint,n:bigint,first:bigint,offset:bigint>>"
    lengths = spark.createDataFrame([(k, n, sorted(places[k])) for k, n in sorted(histogram.items())], kind)
    place = F.element_at(F.filter("_places", lambda x: x["lo"] <= F.col("rank")), -1)
    return ranked(rows, lengths, bucket_rows).withColumn("_p", place).select(*rows.columns, (F.col("_p.first") + F.col("rank") - F.col("_p.lo")).alias("sequence_id"), F.col("_p.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokens_path: str, ranks_path: str | None = None, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of docs (doc_id, text)."""
    cut = materialize(pieces(docs, tokens_path, ranks_path, limit, end_id), "pieces")
    return pack(cut, limit)
