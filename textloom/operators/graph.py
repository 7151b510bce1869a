"""Approximate nearest neighbours by navigable small-world graphs, one for each shard of the rows.

Rows are dealt to shards of bounded size by a hash of their id; each shard's graph is built and searched in one task,
and the best of all shards are merged. Every row is in a graph. Recall is measured against exact search in the tests."""

from __future__ import annotations

import heapq
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dense import signed8
from ..plans.search import best

SHARD_ROWS = 20_000


class Exact:
    """Vectors as they are; similarity is the dot product."""

    def __init__(self, dim: int):
        self.dim = dim

    def encode(self, x: np.ndarray) -> np.ndarray:
        return x

    def similar(self, one: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return codes @ one


class Signs(Exact):
    """A bit for each dimension, 32 times smaller; similarity is dim less twice the differing bits."""

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x >= 0, axis=1, bitorder="little")

    def similar(self, one: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.dim - 2 * np.bitwise_count(codes ^ one).sum(1, dtype=np.int64)


class Bytes(Exact):
    """A float32 step and a signed byte for each dimension, 4 times smaller; similarity is the scaled product of codes."""

    def encode(self, x: np.ndarray) -> np.ndarray:
        codes, step = signed8(x)
        return np.concatenate([step.astype("<f4").view(np.uint8), codes.astype(np.int8).view(np.uint8)], axis=1)

    def similar(self, one: np.ndarray, codes: np.ndarray) -> np.ndarray:
        steps = np.ascontiguousarray(codes[:, :4]).view("<f4")[:, 0]
        product = codes[:, 4:].view(np.int8).astype(np.float32) @ one[4:].view(np.int8).astype(np.float32)
        return steps * one[:4].view("<f4")[0] * product


CODECS = {"exact": Exact, "binary_sym": Signs, "scalar8_sym": Bytes}


class Hnsw:
    """A graph over unit vectors or over codes of them, which then also stand for the queries."""

    def __init__(self, dim: int, links: int = 16, ef_build: int = 200, ef_search: int = 64, seed: int = 1, codes: str = "exact"):
        self.links, self.ef_build, self.ef_search, self.rng = links, ef_build, ef_search, random.Random(seed)
        self.codec = CODECS[codes](dim)
        self.x = np.zeros((0, dim), np.float32)
        self.layers: list[dict[int, list[int]]] = []
        self.entry = -1

    def similar(self, q: np.ndarray, ids: list[int]) -> np.ndarray:
        return self.codec.similar(q, self.x[ids])

    def beam(self, q: np.ndarray, start: list[int], layer: int, width: int) -> list[tuple[float, int]]:
        """The best nodes found on a layer, most similar first."""
        seen = set(start)
        first = [(float(s), i) for s, i in zip(self.similar(q, start), start, strict=True)]
        todo, kept = [(-s, i) for s, i in first], list(first)
        heapq.heapify(todo)
        heapq.heapify(kept)
        while todo:
            s, i = heapq.heappop(todo)
            if len(kept) >= width and -s < kept[0][0]:
                break
            fresh = [j for j in self.layers[layer][i] if j not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for t, j in zip(self.similar(q, fresh).tolist(), fresh, strict=True):
                if len(kept) < width or t > kept[0][0]:
                    heapq.heappush(kept, (t, j))
                    heapq.heappush(todo, (-t, j))
                    if len(kept) > width:
                        heapq.heappop(kept)
        return sorted(kept, reverse=True)

    def chosen(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in varied directions first: one is kept if none before it is closer to it than the base is."""
        kept: list[int] = []
        for s, i in found:
            if len(kept) == most:
                break
            if not kept or float(self.similar(self.x[i], kept).max()) < s:
                kept.append(i)
        rest = [i for _, i in found if i not in kept]
        return kept + rest[: most - len(kept)]

    def build(self, x: np.ndarray) -> Hnsw:
        size = np.linalg.norm(x, axis=1, keepdims=True)
        self.x = self.codec.encode(np.divide(x, size, out=np.zeros_like(x), where=size > 0).astype(np.float32))
        for i in range(len(self.x)):
            self.add(i)
        return self

    def add(self, i: int) -> None:
        level = int(-math.log(1 - self.rng.random()) / math.log(self.links))
        q, start = self.x[i], [self.entry]
        top = len(self.layers) - 1
        for layer in range(top, level, -1):
            start = [self.beam(q, start, layer, 1)[0][1]]
        for layer in range(min(top, level), -1, -1):
            most = self.links * (2 if layer == 0 else 1)
            found = self.beam(q, start, layer, self.ef_build)
            own = self.layers[layer]
            own[i] = self.chosen(found, self.links)
            for j in own[i]:
                own[j].append(i)
                if len(own[j]) > most:
                    ranked = sorted(zip(self.similar(self.x[j], own[j]).tolist(), own[j], strict=True), reverse=True)
                    own[j] = self.chosen(ranked, most)
            start = [j for _, j in found]
        if level > top:
            self.layers += [{i: []} for _ in range(level - top)]
            self.entry = i

    def search(self, q: np.ndarray, k: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        size = float(np.linalg.norm(q))
        q = self.codec.encode((q / size if size else q).astype(np.float32)[None])[0]
        start = [self.entry]
        for layer in range(len(self.layers) - 1, 0, -1):
            start = [self.beam(q, start, layer, 1)[0][1]]
        return self.beam(q, start, 0, max(self.ef_search, k))[:k]


def search(rows: DataFrame, queries: DataFrame, k: int = 10, shards: int | None = None, id_: str = "vec_id", vector: str = "embedding", **options: int | str) -> DataFrame:
    """(query_id, id_, score, rank) of the best rows found in the shards' graphs.

    Queries are sent to each shard beside its rows; they are a set of bounded size, and a larger one is searched in parts."""
    shards = shards or max(1, -(-rows.count() // SHARD_ROWS))
    own = rows.where(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64(id_), F.lit(shards)).alias("shard"), F.col(id_).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.explode(every).alias("shard"), F.col(id_).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def run(part: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(part) and len(q):
            part = part.sort_values("id")
            ids = part["id"].to_numpy()
            x = np.stack(part["v"].to_list())
            graph = Hnsw(x.shape[1], **options).build(x)
            out = [(i, int(ids[j]), float(s)) for i, v in zip(q["id"], q["v"], strict=True) for s, j in graph.search(np.asarray(v, float), k)]
        return pd.DataFrame(out, columns=["query_id", id_, "score"]).astype({"query_id": "int64", id_: "int64", "score": "float64"})

    found = own.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(run, f"query_id bigint, {id_} bigint, score double")
    return best(found, k, item=id_)
