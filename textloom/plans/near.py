"""MinHash search for near copies and phonetic name search: blocking by equi-joins, then the exact test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import phonetic as P
from ..functions import text as T
from ..operators import sketch
from ..operators.arrow import list_parts, vectorized
from ..operators.phonetic import lk82
from .storage import materialize

BANDS, ROWS = 32, 4
#: Tokens and pairs that a worker holds at once.
TOKENS, PAIRS = 1 << 16, 64
SHINGLE, LEAST = 5, 0.8


def signatures(docs: DataFrame, k: int = BANDS * ROWS, words: int = SHINGLE, seed: int = 1) -> DataFrame:
    """(doc_id, node, n, signature) of the word shingles of each text: node tells equal word sequences, n counts distinct
    shingles; a text without words has the empty signature."""
    maker = sketch.MinHash(k, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in list_parts(batches, TOKENS, 2):
            shingles = [sketch.word_shingles(tokens, words) if tokens else [] for tokens in b.column(2).to_pylist()]
            out = [maker.signature(s).tolist() if s else [] for s in shingles]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in shingles], pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "node", "n", "signature"])

    tokens = F.coalesce(T.lower_words(F.col("text")), F.array().cast("array<string>"))
    own = docs.select(F.col("doc_id").cast("bigint"), tokens.alias("tokens")).select("doc_id", F.xxhash64("tokens").alias("node"), "tokens")
    return own.mapInArrow(run, "doc_id bigint, node bigint, n bigint, signature array<bigint>")


def shingle_sets(docs: DataFrame, nodes: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(node, hashes): the ascending 64-bit hashes of the shingles of the given nodes, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash  # here, so that the other queries stay where it is missing

        for b in list_parts(batches, TOKENS, 1):
            sets = [np.unique(np.array([xxhash.xxh64_intdigest(s) for s in sketch.word_shingles(tokens, words)], np.uint64)).tobytes() for tokens in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "hashes"])

    tokens = F.coalesce(T.lower_words(F.col("text")), F.array().cast("array<string>"))
    own = docs.select(tokens.alias("tokens")).select(F.xxhash64("tokens").alias("node"), "tokens")
    return own.join(nodes, "node", "left_semi").dropDuplicates(["node"]).mapInArrow(run, "node bigint, hashes binary")


def jaccard_of(pairs: DataFrame) -> DataFrame:
    """(query_node, node, similarity) of pairs with their packed hashes x and y: exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, PAIRS) for whole in batches for at in range(0, whole.num_rows, PAIRS)):
            out = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                out.append(both / max(1, (len(x) + len(y)) // 8 - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["query_node", "node", "similarity"])

    return pairs.select("query_node", "node", "x", "y").mapInArrow(run, "query_node bigint, node bigint, similarity double")


def exact_pairs(sets: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, c, n, m): pairs of queries and sets (doc_id, n, s: an array of n distinct numbers) with c members in common,
    c at least 0.8 of the union.

    Such sets share one of the first n - ceil(0.8 n) + 1 members of each in any common order, so only these are joined."""
    first = lambda rows: rows.select("doc_id", "n", F.explode(F.slice(F.array_sort("s"), F.lit(1), (F.col("n") - F.expr("(4 * n + 4) div 5") + 1).cast("int"))).alias("k"))
    left, right = (first(x) for x in (queries, sets))
    left = left.select(F.col("doc_id").alias("query_id"), F.col("n").alias("m"), "k")
    pairs = left.join(right, "k").where(F.least("n", "m") >= F.greatest("n", "m") * F.lit(LEAST)).select("query_id", "doc_id").distinct()
    asked = queries.select(F.col("doc_id").alias("query_id"), F.col("n").alias("m"), F.col("s").alias("q"))
    both = pairs.join(sets, "doc_id").join(asked, "query_id").select("query_id", "doc_id", "n", "m", F.size(F.array_intersect("q", "s")).alias("c"))
    return both.where(F.col("c") >= LEAST * (F.col("n") + F.col("m") - F.col("c")))


def similar(docs: DataFrame, queries: DataFrame, least: float = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(query_id, class_id, similarity): for each query the classes of documents that are like it.

    Documents of equal word sequences are a class under its smallest doc_id (`classes` names each document's), so
    copies never meet as pairs. Candidates share a band (32 bands of 4: a pair at 0.8 shares none with a probability of
    0.00000005); the exact similarity of their shingle sets decides."""
    signed = materialize(signatures(docs, bands * rows).where("n > 0"), "signatures")
    named = signed.groupBy("node").agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    asked = materialize(signatures(queries, bands * rows).where("n > 0").select(F.col("doc_id").alias("query_id"), F.col("node").alias("query_node"), F.col("n").alias("m"), "signature"), "asked")
    keys = vectorized(lambda s: sketch.band_keys(np.asarray(s), bands), "array<bigint>")
    left = materialize(asked.dropDuplicates(["query_node"]).select("query_node", "m", F.posexplode(keys("signature")).alias("band", "key")), "query-bands")
    right = materialize(named.select("node", "n", F.posexplode(keys("signature")).alias("band", "key")), "bands")
    # sets of n and m members are at most as alike as the ratio of their sizes
    near = left.join(right, ["band", "key"]).where(F.least("n", "m") >= F.greatest("n", "m") * F.lit(least)).select("query_node", "node").distinct()
    pairs = materialize(near, "pairs")
    sets = materialize(shingle_sets(docs.select("text").union(queries.select("text")), pairs.select("node").union(pairs.select("query_node")).distinct()), "sets")
    both = pairs.join(sets.select("node", F.col("hashes").alias("y")), "node").join(sets.select(F.col("node").alias("query_node"), F.col("hashes").alias("x")), "query_node")
    good = jaccard_of(both).where(F.col("similarity") >= least)
    return good.join(named.select("node", "class_id"), "node").join(asked.select("query_id", "query_node"), "query_node").select("query_id", "class_id", "similarity")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) by equal word sequence."""
    tokens = F.coalesce(T.lower_words(F.col("text")), F.array().cast("array<string>"))
    own = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(tokens).alias("node"))
    return own.join(own.groupBy("node").agg(F.min("doc_id").alias("class_id")), "node").select("doc_id", "class_id")


def name_keys(names: DataFrame) -> DataFrame:
    """names (…, name) with a row for each of its phonetic keys."""
    code = vectorized(lk82, "string")
    return names.where(F.char_length("name") <= P.MOST_CHARS).select("*", F.explode(P.keys(F.col("name"), code("name"))).alias("key"))


def sound_lookup(names: DataFrame, aliases: DataFrame, queries: DataFrame, least: float = 0.0, alias_score: float = 2.0) -> DataFrame:
    """(query_id, entity_id, score): names (entity_id, name) that share a key with a query (query_id, name), by similarity.

    An exact alias (entity_id, name) scores above them all, so it ranks first; with alias_score 1 it scores like an equal name. The largest score of an entity counts."""
    hits = name_keys(queries.withColumnRenamed("name", "name")).withColumnRenamed("name", "asked").join(name_keys(names), "key")
    by_sound = hits.select("query_id", "entity_id", P.similarity(F.col("asked"), F.col("name")).alias("score")).where((F.col("score") > 0) & (F.col("score") >= least))
    by_alias = queries.join(aliases, "name").select("query_id", "entity_id", F.lit(alias_score).alias("score"))
    return by_sound.unionByName(by_alias).groupBy("query_id", "entity_id").agg(F.max("score").alias("score"))
