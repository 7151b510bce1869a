"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct words of a text (runs of a-z, 0-9 and non-ASCII, A-Z lowered), hashed to 2^20 slots. The score
is the logistic of w0 + sum w_i + sum_{i<j} <v_i, v_j> over a text's terms: w is what a term says alone, the factors v
what it says beside another (an insult next to a mention of a group), which additive weights cannot hold.

The model is fitted on the driver from at most `train_rows` rows of labelled documents, taken by lowest hash of doc_id
among those whose crc32(doc_id) mod 5 is not 0 (rows that share a doc_id count each); a term takes part if `min_docs` of them have it, at most `terms` of them by
chi-square. All documents are then scored whole, in one pass without a shuffle.

Definitions: a null or empty text has no terms and gets the logistic of w0; a null doc_id counts as held out; a doc_id
labelled more than once is toxic if any of its labels is; null labels are ignored. Without labels, or with labels of
one class only, every score is that class's share (0.5 without any). An empty table gives an empty result, further
columns are ignored by score_documents and kept by drop_toxic.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, free_name, raw
from .decontam import words_of

SLOT_BITS = 20
TRAIN_ROWS = 12_000
CACHE = 1 << 18


class Slots(dict):
    """Word to slot, for the words met last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = slot = zlib.crc32(word) & ((1 << SLOT_BITS) - 1)
        return slot


def slots_of(text: bytes, slots: Slots) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(slots.__getitem__, words), np.int32, len(words))


@dataclass
class Model:
    """index: slot to term number or -1; w, v: weights and factors of the terms."""

    index: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def terms(self, slots: np.ndarray) -> np.ndarray:
        at = self.index[slots]
        return np.unique(at[at >= 0])

    def score(self, each: list[np.ndarray]) -> np.ndarray:
        """Scores of texts given as their terms."""
        return logistic(margins(self.w0, self.w, self.v, *ragged(each))[0])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def ragged(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Terms of all texts, the text of each, number of texts."""
    return np.concatenate([*each, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(each)), [len(x) for x in each]), len(each)


def sums(owner: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(owner, values[:, k], n) for k in range(values.shape[1])], 1)


def margins(w0: float, w: np.ndarray, v: np.ndarray, terms: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    own = v[terms]
    s = sums(owner, n, own)
    pairs = 0.5 * ((s**2).sum(1) - np.bincount(owner, (own**2).sum(1), n))
    return w0 + np.bincount(owner, w[terms], n) + pairs, s


def fit(texts: list[np.ndarray], toxic: np.ndarray, *, terms: int = 8192, min_docs: int = 4, least_chi: float = 10.0, rank: int = 4, epochs: int = 30, rate: float = 0.03, l1: float = 2e-3, l2: float = 1e-2, seed: int = 1) -> Model:
    """A model of texts (distinct slots each) and their labels (0/1), by Adam with a proximal step for w."""
    index, share = np.full(1 << SLOT_BITS, -1, np.int32), float(toxic.mean()) if len(toxic) else 0.5
    bias = float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0 if not len(toxic) else 500.0 * (2 * share - 1)
    if not 0 < share < 1 or not len(toxic):
        return Model(index, bias, np.zeros(1), np.zeros((1, rank)))
    slots, owner, n = ragged(texts)
    seen = np.bincount(slots, minlength=len(index)).astype(float)
    bad = np.bincount(slots, toxic[owner].astype(float), len(index))
    expected = seen * share
    chi = (bad - expected) ** 2 / np.maximum(expected * (1 - seen / n), 1e-9) / (1 - share)
    often = np.flatnonzero((seen >= min(min_docs, max(1, n // 50))) & (chi >= least_chi))
    chosen = np.sort(often[np.lexsort((often, -chi[often]))[:terms]])
    index[chosen] = np.arange(len(chosen))
    each = [index[x] for x in texts]
    each = [x[x >= 0].astype(np.int64) for x in each]
    rng = np.random.default_rng(seed)
    size = max(1, len(chosen))
    p = {"w0": np.array([bias]), "w": np.zeros(size), "v": rng.normal(0, 0.01, (size, rank))}
    m1, m2, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    weight = np.where(toxic == 1, min(4.0, (1 - share) / share), 1.0)
    block = max(32, n // 32)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, block):
            own = order[at : at + block]
            ids, who, k = ragged([each[i] for i in own])
            z, s = margins(p["w0"][0], p["w"], p["v"], ids, who, k)
            g = weight[own] * (logistic(z) - toxic[own]) / k
            grad_v = sums(ids, size, g[who, None] * (s[who] - p["v"][ids])) + l2 * p["v"] * 0.1
            grads = {"w0": np.array([g.sum()]), "w": np.bincount(ids, g[who], size), "v": grad_v}
            t += 1
            for name, gr in grads.items():
                m1[name] = 0.9 * m1[name] + 0.1 * gr
                m2[name] = 0.99 * m2[name] + 0.01 * gr**2
                p[name] -= rate * (m1[name] / (1 - 0.9**t)) / (np.sqrt(m2[name] / (1 - 0.99**t)) + 1e-4)
            p["w"] = np.sign(p["w"]) * np.maximum(np.abs(p["w"]) - rate * l1, 0)
    return Model(index, float(p["w0"][0]), p["w"], p["v"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, **options) -> Model:
    """A model from at most train_rows of the labelled documents that are not held out."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = labels.select(F.col("doc_id").cast(kind).alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    one = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    # train_rows bounds this side of the join: an id and a label a row
    taken = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)

    def factory():
        slots = Slots()

        def step(b: pa.RecordBatch):
            found = [np.unique(slots_of(t, slots)) for t in raw(b.column(3))]
            yield batch(["doc_id", "toxic", "th", "slots"], [*(b.column(i) for i in range(3)), pa.array(found, pa.list_(pa.int32()))])

        return step

    joined = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("doc_id", "_toxic", F.xxhash64("text"), "text")
    every = arrow_map(joined, f"doc_id {kind}, toxic int, th bigint, slots array<int>", factory)
    rows = every.orderBy(F.xxhash64("doc_id"), "doc_id", "th").limit(train_rows).toArrow().sort_by([("doc_id", "ascending"), ("th", "ascending")])
    slots = rows.column("slots").combine_chunks()
    ends = slots.offsets.to_numpy()
    values = slots.values.to_numpy()
    return fit([values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)] if rows.num_rows else [], rows.column("toxic").to_numpy(), **options)


def scored(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """The columns keep of docs and the score of each text."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    shared = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(model.index >= 0), model.w0, model.w, model.v))
    # a text that is kept goes to Python once
    sent = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias(free_name(docs, "_text")))
    place = keep.index("text") if "text" in keep else len(keep)

    def factory():
        at, w0, w, v = shared.value
        index = np.full(1 << SLOT_BITS, -1, np.int32)
        index[at] = np.arange(len(at))
        own, slots = Model(index, w0, w, v), Slots()

        def step(b: pa.RecordBatch):
            score = own.score([own.terms(slots_of(t, slots)) for t in raw(b.column(place))])
            yield batch([*keep, name], [*(b.column(i) for i in range(len(keep))), pa.array(score)])

        return step

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), f"`{name}` double"])
    return arrow_map(sent, schema, factory)


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text)."""
    found = scored(docs, train(docs, labels, train_rows), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that score under 0.5, all columns."""
    name = free_name(docs, "_score")
    return scored(docs, train(docs, labels, train_rows), list(docs.columns), name).where(F.col(name) < 0.5).drop(name)
