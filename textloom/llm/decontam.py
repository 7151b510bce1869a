"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark texts scans each document once.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. The automaton's patterns are the windows
of 10 consecutive words of an item; an item of fewer words is one window. Its letters are word numbers and its states
flat arrays (word, first child, failure link, nearest end of a pattern): 16 bytes a state, about 160 a benchmark word.
A document's words are numbered, places where no two words follow each other in any pattern leave the automaton at or
next to its root and are passed over in one vector operation; the rest is walked state by state. Matches are ranges of
words and are mapped back to code points of the original text.

The automaton goes to the workers as a broadcast. The benchmark's size is checked first: one of more than `max_bytes`
is cut into blocks of whole items, each scanned in a pass of its own, so memory stays bounded.

Definitions: a null text has no words; items without words, null items and null item_ids have no windows; items with
the same item_id count once. An empty documents table gives an empty result; with an empty benchmark nothing is hit.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, materialize, raw

WINDOW = 10
#: Bytes of benchmark text in one automaton, which takes some thirty times as much in each worker.
MAX_BYTES = 8 << 20
FOLD = bytes(c if c >= 0x80 or chr(c).isdigit() or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


class Automaton:
    """Aho-Corasick over word numbers (from 1) of patterns, the rows of a matrix padded with 0.

    States are numbered level by level, root 0, children of a state one after another by word. Per state: word, parent,
    first (its first child), fail, out (itself if a pattern ends there, else the nearest such state by failure links)."""

    def __init__(self, patterns: np.ndarray, words: int):
        n, width = patterns.shape
        order = np.lexsort(patterns.T[::-1])
        rows, self.base = patterns[order], np.int64(words + 1)
        word, parent, self.level = [np.zeros(1, np.int32)], [np.zeros(1, np.int64)], [0, 1]
        state, changed = np.zeros(n, np.int64), np.zeros(n, bool)
        end = np.zeros(n, np.int64)
        for d in range(width):
            changed = changed | np.concatenate((np.ones(min(n, 1), bool), rows[1:, d] != rows[:-1, d]))
            live = rows[:, d] > 0
            new = changed & live
            mine = self.level[-1] + np.cumsum(new) - 1
            word.append(rows[new, d])
            parent.append(state[new])
            state = np.where(live, mine, state)
            end = np.where(live, mine, end)
            self.level.append(self.level[-1] + int(new.sum()))
        self.word, self.parent = np.concatenate(word), np.concatenate(parent)
        total = len(self.word)
        self.first = (np.searchsorted(self.parent[1:], np.arange(total + 1)) + 1).astype(np.int32)
        self.edges = self.parent[1:] * self.base + self.word[1:]
        ends = np.zeros(total, bool)
        ends[end] = n > 0
        self.fail, self.out = np.zeros(total, np.int32), np.zeros(total, np.int32)
        for d in range(1, width + 1):
            own = np.arange(self.level[d], self.level[d + 1])
            if d > 1:
                self.fail[own] = self.failures(own)
            self.out[own] = np.where(ends[own], own, self.out[self.fail[own]])
        #: end: the state in which each pattern of the input ends
        self.end = np.zeros(n, np.int64)
        self.end[order] = end

    def child(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The child of each state by each word, or -1."""
        key = state * self.base + word
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[at] == key, at + 1, -1)

    def failures(self, own: np.ndarray) -> np.ndarray:
        word, at = self.word[own].astype(np.int64), self.fail[self.parent[own]].astype(np.int64)
        out, todo = np.zeros(len(own), np.int64), np.arange(len(own))
        while len(todo):
            found = self.child(at[todo], word[todo])
            out[todo] = np.maximum(found, 0)
            todo = todo[(found < 0) & (at[todo] > 0)]
            at[todo] = self.fail[at[todo]]
        return out

    def depth(self, state: int) -> int:
        return bisect_right(self.level, state) - 1


class Scanner:
    """The automaton of a list of items (item_id as string, text)."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        self.names = sorted({name for name, _ in items})
        number, self.known = {name: i for i, name in enumerate(self.names)}, {}
        parts, owners = [], []
        for name, text in items:
            ids = np.array([self.known.setdefault(w, len(self.known) + 1) for w in words_of(text)], np.int32)
            if len(ids):
                rows = np.lib.stride_tricks.sliding_window_view(np.pad(ids, (0, max(0, size - len(ids)))), size)
                parts.append(rows)
                owners.append(np.full(len(rows), number[name], np.int64))
        self.empty = not parts
        if self.empty:
            return
        patterns = np.concatenate(parts)
        a = Automaton(patterns, len(self.known))
        pairs = np.unique(a.end * len(self.names) + np.concatenate(owners))
        self.owners = pairs % len(self.names)
        self.ends, at = np.unique(pairs // len(self.names), return_index=True)
        self.owner_at = np.append(at, len(pairs))
        self.level, self.base = a.level, a.base
        one, two = np.arange(*a.level[1:3]), np.arange(a.level[2], a.level[-1])
        self.root = np.zeros(len(self.known) + 1, np.int32)
        self.root[a.word[one]] = one
        self.alone = np.zeros(len(self.root), bool)
        self.alone[a.word[one]] = a.out[one] == one
        self.pairs = np.unique(a.word[a.parent[two]].astype(np.int64) * a.base + a.word[two])
        lengths = np.unique((patterns > 0).sum(1))
        self.shortest = int(min(lengths[lengths > 1], default=size + 1))
        self.word, self.first, self.fail, self.out = a.word, a.first, a.fail, a.out

    def steps(self) -> None:
        """Views whose single values are read fast; made in the worker."""
        self.views = tuple(memoryview(x) for x in (self.word, self.first, self.fail, self.out))

    def walk(self, ids: list[int], begin: int, end: int) -> list[tuple[int, int]]:
        """(place, state) of pattern ends between two places, from the root."""
        word, first, fail, out = self.views
        hits, state = [], int(self.root[ids[begin]])
        for i in range(begin + 1, end):
            w = ids[i]
            while True:
                lo, hi = first[state], first[state + 1]
                at = lo if hi - lo < 2 else bisect_left(word, w, lo, hi)
                if at < hi and word[at] == w:
                    state = at
                    break
                if not state:
                    break
                state = fail[state]
            e = out[state]
            while e:
                hits.append((i, e))
                e = out[fail[e]]
        return hits

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, merged ranges of hit words (end exclusive), items found."""
        words = words_of(text)
        if self.empty or not words:
            return len(words), [], []
        ids = np.fromiter(map(self.known.get, words, repeat(0)), np.int64, len(words))
        hits = [(int(i), int(self.root[ids[i]])) for i in np.flatnonzero(self.alone[ids])]
        # places whose word and the next one follow each other in a pattern: after others the automaton is at most one word deep
        begins = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        if len(begins) and len(self.pairs):
            key = ids[begins] * self.base + ids[begins + 1]
            begins = begins[self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] == key]
            cut = np.flatnonzero(np.diff(begins) > 1)
            starts, ends = begins[np.concatenate(([0], cut + 1))] if len(begins) else begins, begins[np.concatenate((cut, [len(begins) - 1]))] if len(begins) else begins
            long = ends - starts + 2 >= self.shortest
            if long.any():
                plain = ids.tolist()
                for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
                    hits += [(i, e) for i, e in self.walk(plain, a, b + 2) if e >= self.level[2]]
        if not hits:
            return len(words), [], []
        ranges = {(i + 1 - (bisect_right(self.level, e) - 1), i + 1) for i, e in hits}
        owners: set[int] = set()
        for at in np.searchsorted(self.ends, np.unique([e for _, e in hits])).tolist():
            owners.update(self.owners[self.owner_at[at] : self.owner_at[at + 1]].tolist())
        return len(words), merged(sorted(ranges)), sorted(self.names[x] for x in owners)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point spans in the original text of ranges of words."""
    if not ranges:
        return []
    at = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    return [(len(text[: at[a][0]].decode()), len(text[: at[b - 1][1]].decode())) for a, b in ranges]


def blocks_of(benchmark: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """benchmark (item_id, text) with a block number; blocks have about max_bytes of text or a single item."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("body")).where("item is not null and body is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    return rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(1, -(-total // max_bytes)))))


SPANS = "array<struct<start:bigint,end:bigint>>"


def scan(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), size: int = WINDOW, max_bytes: int = MAX_BYTES, text: bool = False) -> DataFrame:
    """keep columns of docs, n_words, hits (ranges of words), spans (code points of the original), items; text too if asked for."""
    spark = docs.sparkSession
    blocks = blocks_of(benchmark, max_bytes)
    numbers = [r[0] for r in blocks.select("block").distinct().orderBy("block").collect()] or [0]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    out, now = ["_text", "n_words", "hits", "items"], docs.select(*keep, F.col("text").cast("binary").alias("_text"))
    now = now.withColumns({"n_words": F.lit(0).cast("bigint"), "hits": F.lit(None).cast(SPANS), "items": F.lit(None).cast("array<string>")})
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "_text binary", "n_words bigint", f"hits {SPANS}", "items array<string>"])
    for number in numbers:
        items = [(r["item"], bytes(r["body"])) for r in blocks.where(F.col("block") == number).select("item", "body").collect()]
        shared = spark.sparkContext.broadcast(Scanner(sorted(items), size))

        def factory(shared=shared):
            scanner = shared.value
            if not scanner.empty:
                scanner.steps()

            def step(b: pa.RecordBatch):
                n = len(keep)
                counts, ranges, found = [], [], []
                for body, had, owners in zip(raw(b.column(n)), b.column(n + 2).to_pylist(), b.column(n + 3).to_pylist(), strict=True):
                    words, more, items = scanner.scan(body)
                    counts.append(words)
                    ranges.append([{"start": x, "end": y} for x, y in merged(more + [(r["start"], r["end"]) for r in had or []])])
                    found.append(sorted({*items, *(owners or [])}))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield batch([*keep, *out], [*(b.column(i) for i in range(n + 1)), pa.array(counts, pa.int64()), pa.array(ranges, kind), pa.array(found, pa.list_(pa.string()))])

            return step

        now = arrow_map(now, schema, factory)
        if number != numbers[-1]:
            now = materialize(now, "scanned")
    return now if text else now.drop("_text")


def with_spans(scanned: DataFrame) -> DataFrame:
    """scanned (with its text) with spans, the hit ranges in code points of the original text, and without _text."""
    rest = [c for c in scanned.columns if c != "_text"]
    kinds = {f.name: f.dataType.simpleString() for f in scanned.schema}

    def factory():
        def step(b: pa.RecordBatch):
            at = {n: i for i, n in enumerate(scanned_names)}
            spans = [[{"start": x, "end": y} for x, y in original_spans(t, [(r["start"], r["end"]) for r in h])] for t, h in zip(raw(b.column(at["_text"])), b.column(at["hits"]).to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield batch([*rest, "spans"], [*(b.column(at[c]) for c in rest), pa.array(spans, kind)])

        return step

    scanned_names = list(scanned.columns)
    return arrow_map(scanned, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), f"spans {SPANS}"]), factory)


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs (doc_id, text)."""
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return scan(docs, benchmark, max_bytes=max_bytes).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def brute(text: str | None, items: list[tuple[int, str | None]]) -> tuple[int, int, int, str]:
    """The same by comparing every window with every place; for tests."""
    words = words_of((text or "").encode())
    hit, found = set(), set()
    for item, body in items:
        for window in windows_of(words_of((body or "").encode())):
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of docs in which no benchmark window occurs, all columns."""
    numbered = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in numbered.items()), F.col("text").alias("text"))
    found = scan(plain, benchmark, keep=tuple(numbered.values()), max_bytes=max_bytes)
    return found.where(F.size("hits") == 0).select(*(F.col(n).alias(c) for c, n in numbered.items()))
