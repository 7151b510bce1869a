"""Sketches and embedders with seeded 64-bit hashes, computed for whole lists of items with numpy."""

from __future__ import annotations

import math

import numpy as np

U = np.uint64
# The constants of FNV-1a, two bases
PRIME, SKETCH_BASIS, EMBED_BASIS = U(1099511628211), U(1469598103934665603), U(14695981039346656037)
P = (1 << 61) - 1
#: Words whose features an embedder remembers.
KNOWN = 50_000


def fnv1a(items: list[bytes], start: np.uint64 | np.ndarray) -> np.ndarray:
    """FNV-1a of each item from its start, all items advancing byte by byte together."""
    h = np.empty(len(items), U)
    h[:] = start
    if not items:
        return h
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    order = np.argsort(-lengths, kind="stable")
    joined = np.frombuffer(b"".join(items), np.uint8)
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
    sizes, out = lengths[order], h[order]
    with np.errstate(over="ignore"):
        for k in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -k, side="left"))
            out[:live] = (out[:live] ^ joined[begins[:live] + k].astype(U)) * PRIME
    h[order] = out
    return h


def finish(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def hashed(items: list[bytes], seed: int = 0) -> np.ndarray:
    return finish(fnv1a(items, SKETCH_BASIS ^ U(seed)))


def splitmix(seed: int):
    state = seed
    while True:
        state = (state + 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
        yield int(finish(np.array([state], U))[0])


def mul_mod(a: np.ndarray, x: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a x + b) mod 2^61 - 1 for operands under 2^61, in limbs of 31 bits that never overflow."""
    low, p = U((1 << 31) - 1), U(P)
    a1, a0, x1, x0 = a >> U(31), a & low, x >> U(31), x & low
    mid = a1 * x0 + a0 * x1
    s = ((a1 * x1) << U(1)) + (mid >> U(30)) + ((mid & U((1 << 30) - 1)) << U(31))
    s = (s & p) + (s >> U(61))
    t = a0 * x0 + b
    t = (t & p) + (t >> U(61))
    s = s + t
    s = (s & p) + (s >> U(61))
    return np.where(s >= p, s - p, s)


class MinHash:
    """Signatures of k minima; the share of equal places estimates the Jaccard similarity."""

    def __init__(self, k: int = 128, seed: int = 1):
        self.k, self.seed = k, seed
        draw = splitmix(seed)
        pairs = [(next(draw) % (P - 1) + 1, next(draw) % P) for _ in range(k)]
        self.a, self.b = (np.array(x, U) for x in zip(*pairs, strict=True))

    def signature(self, items: list[bytes]) -> np.ndarray:
        out = np.full(self.k, P, U)
        x = np.unique(hashed(items, self.seed) % U(P))
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            out = np.minimum(out, mul_mod(self.a[:, None], part[None, :], self.b[:, None]).min(1))
        return out.view(np.int64)


def jaccard_estimate(a, b) -> float:
    a, b = np.asarray(a), np.asarray(b)
    return float((a == b).mean()) if len(a) and len(a) == len(b) else 0.0


def band_keys(signature: np.ndarray, bands: int, seed: int = 1) -> list[int]:
    """A key for each band of rows."""
    rows = len(signature) // bands
    parts = np.asarray(signature, np.int64)[: bands * rows].reshape(bands, rows)
    starts = SKETCH_BASIS ^ (U(seed) + np.arange(bands, dtype=U))
    return finish(fnv1a([part.tobytes() for part in parts], starts)).view(np.int64).tolist()


def word_shingles(tokens: list[str], k: int = 5) -> list[bytes]:
    """Runs of k tokens, joined by NUL; all tokens as one run if there are fewer. Repeats stay."""
    words = [t.encode("utf-8", "surrogatepass") for t in tokens]
    if len(words) <= k:
        return [b"\0".join(words)] if words else []
    return [b"\0".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def lsh_threshold(bands: int, rows: int) -> float:
    return (1 / bands) ** (1 / rows)


def sim_hash(tokens: list[bytes], weights: list[float] | None = None, seed: int = 1) -> int:
    """Each bit by the weighted vote of the tokens' hashes; the bit pattern as a signed long."""
    if not tokens:
        return 0
    bits = np.unpackbits(hashed(tokens, seed).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w = np.ones(len(tokens)) if weights is None else np.asarray(weights, float)
    votes = (np.where(bits, 1.0, -1.0) * w[:, None]).sum(0)
    return int(np.packbits(votes > 0, bitorder="little").view("<i8")[0])


def hamming(a: int, b: int) -> int:
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


class CountMin:
    """Counts that are never too small; two sketches of one shape add up."""

    def __init__(self, epsilon: float = 0.001, delta: float = 0.01, seed: int = 1):
        self.width, self.depth, self.seed = math.ceil(math.e / epsilon), max(1, math.ceil(math.log(1 / delta))), seed
        self.cells = np.zeros((self.depth, self.width), np.int64)

    def columns(self, items: list[bytes]) -> np.ndarray:
        first = hashed(items, self.seed)
        second = finish(fnv1a(items, SKETCH_BASIS ^ U(self.seed) ^ U(0x9E3779B97F4A7C15))) | U(1)
        with np.errstate(over="ignore"):
            return np.stack([(first + U(r) * second) % U(self.width) for r in range(self.depth)]).astype(np.int64)

    def add(self, items: list[bytes], counts=1) -> None:
        for row, at in zip(self.cells, self.columns(items), strict=True):
            np.add.at(row, at, counts)

    def estimate(self, items: list[bytes]) -> np.ndarray:
        return np.min([row[at] for row, at in zip(self.cells, self.columns(items), strict=True)], axis=0)

    def merged(self, other: CountMin) -> CountMin:
        if (self.width, self.depth, self.seed) != (other.width, other.depth, other.seed):
            raise ValueError("the sketches have different shapes")
        out = CountMin.__new__(CountMin)
        out.width, out.depth, out.seed, out.cells = self.width, self.depth, self.seed, self.cells + other.cells
        return out


class HashingEmbedder:
    """Feature hashing of character n-grams and words with signs, L2-normalized."""

    def __init__(self, dim: int = 256, low: int = 2, high: int = 4, seed: int = 0, idf: dict[str, float] | None = None):
        if dim <= 0 or not 0 < low <= high:
            raise ValueError("dim must be over 0 and the n-gram range ascending")
        self.dim, self.low, self.high, self.seed, self.idf = dim, low, high, seed, idf

    def features(self, token: str) -> list[bytes]:
        wrapped = f"\x01{token.lower()}\x02"
        grams = [wrapped[i : i + n].encode() for n in range(self.low, self.high + 1) for i in range(len(wrapped) - n + 1)]
        return [*grams, b"\0" + token.lower().encode()]

    def embed(self, tokens: list[str]) -> np.ndarray:
        items, weights = [], []
        for t in tokens:
            f = self.features(t)
            items += f
            weights += [1.0 if self.idf is None else self.idf.get(t, 0.0)] * len(f)
        out = np.zeros(self.dim, np.float32)
        if items:
            h = fnv1a(items, EMBED_BASIS ^ U(self.seed))
            h = h ^ (h >> U(33))
            sign = np.where((h >> U(40)) & U(1), -1.0, 1.0)
            np.add.at(out, (h % U(self.dim)).astype(np.int64), (sign * np.array(weights)).astype(np.float32))
        size = float(np.sqrt((out.astype(np.float64) ** 2).sum()))
        return out / np.float32(size) if size else out


    def embed_lists(self, words: list[str], at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """embed of several lists of tokens, the first sizes[0] of at and so on; at counts in words. A word's features are hashed
        once, and remembered for up to KNOWN words. Without idf sums are whole numbers, in whatever order."""
        ends = np.cumsum(sizes)
        if self.idf is not None:
            return np.array([self.embed([words[i] for i in at[z - n : z]]) for n, z in zip(sizes, ends, strict=True)], np.float32).reshape(-1, self.dim)
        known = self.__dict__.setdefault("known", {})
        fresh = [w for w in words if w not in known]
        if len(known) + len(fresh) > KNOWN:
            known.clear()
            fresh = words
        features = [self.features(w) for w in fresh]
        h = fnv1a([x for f in features for x in f], EMBED_BASIS ^ U(self.seed))
        h = h ^ (h >> U(33))
        cell = np.repeat(np.arange(len(fresh)), [len(f) for f in features]) * self.dim + (h % U(self.dim)).astype(np.int64)
        rows = np.bincount(cell, np.where((h >> U(40)) & U(1), -1.0, 1.0), len(fresh) * self.dim).astype(np.float32).reshape(-1, self.dim)
        known.update(zip(fresh, rows, strict=True))
        out = np.zeros((len(sizes), self.dim), np.float32)
        if len(at):
            some = sizes > 0
            out[some] = np.add.reduceat(np.array([known[w] for w in words])[at], (ends - sizes)[some], axis=0)
        size = np.sqrt((out.astype(np.float64) ** 2).sum(1))
        return np.divide(out, size.astype(np.float32)[:, None], out=out, where=size[:, None] > 0)


class StaticEmbedder:
    """The mean of word vectors, weighted by idf if given, L2-normalized; a word is looked up as it is, then lowered."""

    def __init__(self, vectors: dict[str, np.ndarray], idf: dict[str, float] | None = None):
        self.vectors, self.idf = vectors, idf
        self.dim = len(next(iter(vectors.values()))) if vectors else 0

    def vector(self, word: str) -> np.ndarray | None:
        return self.vectors.get(word, self.vectors.get(word.lower()))

    def embed(self, tokens: list[str]) -> np.ndarray:
        out = np.zeros(self.dim)
        for t in tokens:
            if (v := self.vector(t)) is not None:
                out += np.asarray(v, float) * (1.0 if self.idf is None else self.idf.get(t, 0.0))
        size = np.sqrt((out * out).sum())
        return out / size if size else out
