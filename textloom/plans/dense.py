"""Dense retrieval: vector codes, exact search of a query set in blocks, rescoring, product quantization.

All tasks have the queries; each scores its rows block by block, a matrix product each, and keeps the best k of each
query. Queries of more than BROADCAST_BYTES are packed into blocks, and so are the rows; each pair of blocks is then one
product, and neither side has to fit in one place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import DIGITS, best
from .storage import spread

ROWS = 4096
#: Rows and queries that a task scores at once, scores that it holds beyond the best k, and bytes of queries that are sent to
#: all tasks; more queries meet the rows as pairs of blocks.
BLOCK, QUERIES, HELD, BROADCAST_BYTES = 2048, 256, 1 << 20, 128 << 20
#: Scores of queries (m, d) against rows (n, d): an (m, n) matrix.
Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(v: Column) -> Column:
    """v with length 1; a zero vector stays."""
    size = F.sqrt(dot(v, v))
    return F.when(size == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / size))


def cosine(a: Column, b: Column) -> Column:
    return dot(l2_normalized(a), l2_normalized(b))


def sign_words(v: Column, dim: int, symmetric: bool = False) -> Column:
    """The sign bits of v, 32 to a long; a zero counts as set if symmetric."""
    def word(at: int) -> Column:
        bits = [F.when((v[i] >= 0) if symmetric else (v[i] > 0), F.lit(1 << (i - at))).otherwise(F.lit(0)).cast("bigint") for i in range(at, min(dim, at + 32))]
        return sum(bits[1:], bits[0])

    return F.array(*[word(at) for at in range(0, dim, 32)])


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def cosine_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return unit(q) @ unit(x).T


def binary_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """1 - 2 h / dim for Hamming distance h of the sign bits: from the product of the signs."""
    s, t = np.where(q > 0, 1.0, -1.0), np.where(x > 0, 1.0, -1.0)
    return (s @ t.T) / q.shape[1]


def scalar8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes 0..255 of unit vectors, with the minimum and the step of each."""
    x = unit(x)
    low = x.min(1, keepdims=True)
    step = (x.max(1, keepdims=True) - low) / 255
    codes = np.floor(np.divide(x - low, step, out=np.zeros_like(x), where=step > 0) + 0.5)
    return codes, low, step


def scalar8_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    codes, low, step = scalar8(x)
    q = unit(q)
    return q.sum(1, keepdims=True) * low.T + (q @ codes.T) * step.T


def signs(x: np.ndarray) -> np.ndarray:
    return np.where(x >= 0, 1.0, -1.0)


def binary_sym_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """dim - 2 h for Hamming distance h of codes on both sides; a zero counts as positive."""
    return signs(q) @ signs(x).T


def signed8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes -127..127 of vectors by each one's largest absolute value, halves away from zero, and the step of each."""
    step = np.abs(x).max(1, keepdims=True) / 127
    step = np.where(step == 0, 1.0, step)
    return np.clip(np.sign(x) * np.floor(np.abs(x) / step + 0.5), -127, 127), step


def scalar8_sym_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The product of signed 8-bit codes, scaled by the steps of both."""
    (a, s), (b, t) = signed8(unit(q)), signed8(unit(x))
    return (a @ b.T) * s * t.T


SCORERS: dict[str, Scorer] = {
    "cosine": cosine_scores, "binary": binary_scores, "scalar8": scalar8_scores, "binary_sym": binary_sym_scores, "scalar8_sym": scalar8_sym_scores,
}


def packed(rows: DataFrame, id_: str, vector: str, prefix: str, block: int = ROWS) -> DataFrame:
    """(prefix_ids, prefix_vectors): blocks of rows; float64 vectors, one after the other."""
    names = [f"{prefix}_ids", f"{prefix}_vectors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                listed = part.column(1)
                keep = [i for i, ok in enumerate(listed.is_valid().to_pylist()) if ok and len(listed[i])]
                part = part.take(pa.array(keep, pa.int64())) if len(keep) < part.num_rows else part
                if not part.num_rows:
                    continue
                values = np.array([np.asarray(v, np.float64) for v in part.column(1).to_numpy(zero_copy_only=False)])
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([values.tobytes()], pa.binary())], names=names)

    return rows.select(F.col(id_).cast("bigint"), vector).mapInArrow(run, f"{names[0]} array<bigint>, {names[1]} binary")


def matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


class Best:
    """The k best ids of each of n queries, from scores that come block by block."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.floor = n, k, np.full(n, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, first: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores of queries first, first + 1 and so on with ids."""
        q, i = np.nonzero(scores >= self.floor[first : first + len(scores), None])
        if len(q):
            self.held.append((first + q, ids[i], scores[q, i]))
            if sum(len(x[0]) for x in self.held) > 4 * self.k * self.n + HELD:
                self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, ids, scores = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids, -scores, q))
        first = np.flatnonzero(np.append(True, q[order][1:] != q[order][:-1]))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        kth = order[rank == self.k - 1]
        self.floor[q[kth]] = scores[kth]
        order = order[rank < self.k]
        self.held = [(q[order], ids[order], scores[order])]
        return self.held[0]


def search(rows: DataFrame, queries: DataFrame, k: int = 10, scorer: str | Scorer = "cosine", id_: str = "vec_id", vector: str = "embedding", digits: int = DIGITS) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best rows for each query; both have (id_, vector)."""
    function = SCORERS[scorer] if isinstance(scorer, str) else scorer
    kept = lambda df: df.select(F.col(id_).cast("bigint").alias(id_), vector).where(F.size(vector) > 0)
    asked, schema = kept(queries), f"query_id bigint, {id_} bigint, score double"
    if (size := asked.agg(F.sum(F.size(vector).cast("bigint") * 8)).first()[0] or 0) > BROADCAST_BYTES:
        pairs = packed(rows, id_, vector, "row").crossJoin(packed(queries, id_, vector, "query", block=QUERIES))
        return best(pairs.mapInArrow(_pairs(function, k, id_, digits), schema), k, item=id_, digits=digits)
    table = asked.toArrow().combine_chunks()
    shared = rows.sparkSession.sparkContext.broadcast((np.array(table.column(0).to_pylist(), np.int64), matrix(table.column(1).combine_chunks())) if size else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is None:
            return
        qids, q = shared.value
        found = Best(len(qids), k)
        for b in (whole.slice(at, BLOCK) for whole in batches for at in range(0, whole.num_rows, BLOCK)):
            ids, x = b.column(0).to_numpy(), matrix(b.column(1))
            for at in range(0, len(q), QUERIES):
                found.add(at, ids, np.round(function(q[at : at + QUERIES], x), digits) + 0.0)
        n, ids, scores = found.best()
        yield pa.RecordBatch.from_arrays([pa.array(qids[n]), pa.array(ids), pa.array(scores)], names=["query_id", id_, "score"])

    return best(spread(kept(rows), id_).mapInArrow(run, schema), k, item=id_, digits=digits)


def _pairs(function: Scorer, k: int, id_: str, digits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores pairs of blocks, see packed, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 1) for whole in batches for at in range(whole.num_rows)):
            ids, x, qids, q = (b.column(i).to_pylist()[0] for i in range(4))
            x, q = np.frombuffer(x).reshape(len(ids), -1), np.frombuffer(q).reshape(len(qids), -1)
            found = Best(len(qids), k)
            found.add(0, np.array(ids), np.round(function(q, x), digits) + 0.0)
            n, own, scores = found.best()
            yield pa.RecordBatch.from_arrays([pa.array(np.array(qids)[n]), pa.array(own), pa.array(scores)], names=["query_id", id_, "score"])

    return run


def rescore(candidates: DataFrame, rows: DataFrame, queries: DataFrame, k: int = 10, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The exact cosine of candidates (query_id, id_) and the best k of each query; unknown ids drop out."""
    asked = queries.select(F.col(id_).alias("query_id"), F.col(vector).alias("_q"))
    pairs = candidates.select("query_id", id_).join(rows.select(id_, vector), id_).join(asked, "query_id")
    return best(pairs.select("query_id", id_, cosine(F.col("_q"), F.col(vector)).alias("score")), k, item=id_)


def k_means(x: np.ndarray, k: int, rounds: int = 25, seed: int = 1) -> np.ndarray:
    """Centres by Lloyd's rounds; an empty cluster takes a row at random."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
        centres = np.array([x[near == c].mean(0) if (near == c).any() else x[rng.integers(len(x))] for c in range(len(centres))])
    return centres


class ProductQuantizer:
    """Codebooks of `parts` subspaces, trained on a bounded sample; every row is coded and scored by table lookup."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books

    @staticmethod
    def fit(rows: DataFrame, parts: int = 8, bits: int = 8, sample: int = 20_000, vector: str = "embedding", seed: int = 1) -> ProductQuantizer:
        """Fits on the `sample` rows with the lowest hash of their vector."""
        drawn = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(vector)).limit(sample).select(vector).toPandas()[vector]
        x = unit(np.array([np.asarray(v, np.float64) for v in drawn]))
        return ProductQuantizer([k_means(part, 1 << bits, seed=seed) for part in np.split(x, parts, axis=1)])

    def encode(self, x: np.ndarray) -> np.ndarray:
        parts = np.split(unit(x), len(self.books), axis=1)
        return np.stack([((c * c).sum(1) - 2 * p @ c.T).argmin(1) for p, c in zip(parts, self.books, strict=True)], axis=1)

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        codes, parts = self.encode(x), np.split(unit(q), len(self.books), axis=1)
        return sum((p @ c.T)[:, codes[:, i]] for i, (p, c) in enumerate(zip(parts, self.books, strict=True)))
