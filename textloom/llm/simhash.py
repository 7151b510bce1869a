"""SimHash near-dedup with Pigeonring filtering.

A fingerprint has 64 bits, laid out as a ring of five segments (13, 13, 13, 13, 12 bits). With a budget of two
differing bits a chain that starts at some segment keeps within its proportional share at every length: none in the
first and the second segment, one at most through the third and the fourth, two through the fifth. So two linked
fingerprints agree on two neighbouring segments, and equi-grouping on those 26 bits finds every candidate; the rest
of the chain is checked before the full Hamming distance.

Within a bucket, links are followed breadth first: each member is compared once with those not yet reached, so a
bucket of near copies gives a spanning tree, not all its pairs. Buckets of more than `bucket_limit` fingerprints are
taken out and their members look up all 2,080 fingerprints within two bits by an equi-join instead, which is linear.

Definitions: null and empty texts have no words and fingerprint 0, linked like any other; a repeated row or doc_id is
its own row; a null doc_id is never a component's name unless the component has no other. An empty table gives an
empty result, further columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, components, first_row, keep_first, materialize, raw

BITS, BUDGET = 64, 2
WIDTHS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)
BLOCK = 1 << 15
#: Fingerprints in a bucket that one task compares; they fit in half a megabyte.
BUCKET_LIMIT = 1 << 16


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """The SimHash of the word shingles of a UTF-8 text, unsigned; A-Z count as lower case."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(begins[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return vote(np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - size + 1))


def vote(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have set."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs and fp (long, the fingerprint's bit pattern)."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = [*keep, "fp"]

    def factory():
        def step(b: pa.RecordBatch):
            fp = np.array([fingerprint(t, size) for t in raw(b.column(len(keep)))], np.uint64).view(np.int64)
            yield batch(names, [*(b.column(i) for i in range(len(keep))), pa.array(fp)])

        return step

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "fp bigint"])
    return arrow_map(docs.select(*keep, "text"), schema, factory)


def segment(fps: np.ndarray, i: int) -> np.ndarray:
    i %= len(WIDTHS)
    return (fps >> np.uint64(STARTS[i])) & np.uint64((1 << WIDTHS[i]) - 1)


def bucket_keys(fps: np.ndarray) -> np.ndarray:
    """For each chain start i, the key (i, segments i and i + 1) of each fingerprint: shape (5, n)."""
    return np.array([(np.uint64(i) << np.uint64(26)) | (segment(fps, i) << np.uint64(13)) | segment(fps, i + 1) for i in range(len(WIDTHS))])


def buckets(fps: DataFrame) -> DataFrame:
    """(key, fp): the five buckets of each distinct fingerprint."""

    def factory():
        def step(b: pa.RecordBatch):
            own = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch(["key", "fp"], [pa.array(bucket_keys(own).view(np.int64).ravel()), pa.array(np.tile(own.view(np.int64), len(WIDTHS)))])

        return step

    return arrow_map(fps.select("fp"), "key bigint, fp bigint", factory, rows=20_000)


def chain_links(one: np.uint64, rest: np.ndarray, start: int) -> np.ndarray:
    """Which of rest link with one, given that both segments at the chain's start agree."""
    diff = rest ^ one
    third = np.bitwise_count(segment(diff, start + 2))
    near = np.flatnonzero(third <= BUDGET * 3 // 5)
    if not len(near):
        return near
    cumulative = third[near] + np.bitwise_count(segment(diff[near], start + 3))
    near = near[cumulative <= BUDGET * 4 // 5]
    return near[np.bitwise_count(diff[near]) <= BUDGET]


def spanning_links(members: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links that connect the members of a bucket as all its links do, at most one less than members."""
    links, rest = [], members
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            one = todo.pop()
            found = chain_links(one, rest, start)
            if len(found):
                reached = rest[found]
                links += [(int(one), int(x)) for x in reached]
                todo += list(reached)
                rest = np.delete(rest, found)
    return links


def links_in_buckets(groups: DataFrame) -> DataFrame:
    """(a, b): links between the fingerprints of each row (key, members)."""

    def factory():
        def step(b: pa.RecordBatch):
            found = []
            members = b.column(1)
            values, ends = members.values.to_numpy(zero_copy_only=False).view(np.uint64), members.offsets.to_numpy()
            for i, key in enumerate(b.column(0).to_pylist()):
                found += spanning_links(np.sort(values[ends[i] : ends[i + 1]]), key >> 26)
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield batch(["a", "b"], [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())])

        return step

    return arrow_map(groups, "a bigint, b bigint", factory)


def neighbours() -> np.ndarray:
    one = [np.uint64(1) << np.uint64(i) for i in range(BITS)]
    return np.array(one + [a | b for a, b in itertools.combinations(one, 2)], np.uint64)


def links_by_lookup(members: DataFrame, fps: DataFrame) -> DataFrame:
    """(a, b): links of each member (fp) with any fingerprint, by looking up all that are within the budget."""

    def factory():
        masks = neighbours()

        def step(b: pa.RecordBatch):
            own = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch(["a", "b"], [pa.array(np.repeat(own.view(np.int64), len(masks))), pa.array((own[:, None] ^ masks[None, :]).ravel().view(np.int64))])

        return step

    return arrow_map(members.select("fp"), "a bigint, b bigint", factory, rows=64).join(fps.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b")


def links(fps: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints fps (fp) as all links within two bits do."""
    rows = materialize(buckets(fps), "buckets")
    sizes = rows.groupBy("key").count()
    hot = materialize(sizes.where(F.col("count") > bucket_limit).select("key"), "hot")
    within = rows
    found = None
    if not hot.isEmpty():
        within = rows.join(hot, "key", "left_anti")
        found = links_by_lookup(rows.join(hot, "key", "left_semi").select("fp").distinct(), fps)
    groups = within.groupBy("key").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    inside = links_in_buckets(groups)
    return inside.union(found) if found is not None else inside


def linked(prints: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """prints (doc_id, th, fp, ...) with component_id, the smallest doc_id that links reach, and first, th of that row."""
    distinct = materialize(prints.groupBy("fp").agg(first_row().alias("least")), "fps")
    roots = components(links(distinct, bucket_limit))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("least"))
    name = named.select("fp", "root").join(least, "root").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.th").alias("first"))
    return prints.join(name, "fp")


def components_of(docs: DataFrame, size: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id, th (a hash of the text), fp, component_id, first of every row of docs (doc_id, text)."""
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return linked(materialize(fingerprints(own, size, ("doc_id", "th")), "prints"), bucket_limit)


def near_duplicates(docs: DataFrame, size: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs (doc_id, text)."""
    return components_of(docs, size, bucket_limit).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """The row of docs that names each component, all columns; rows of the same doc_id and text stay or go together."""
    return keep_first(docs, components_of(docs, size, bucket_limit))
