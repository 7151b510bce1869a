"""License scans by diagonal voting.

All rolling word 3-grams of all documents are hashed and joined with the grams of the templates. A hit of a document
position on a template position votes for the diagonal, their difference. Diagonals next to each other (words put in or
left out move the rest) are merged where they follow in the text, and a merged span is verified: the share of the
template's grams it holds, in order, must reach `least_share`.

Templates are base phrases, short passages and whole bodies of well-known licenses (license_texts), or what the caller
gives; each gram carries two independent 64-bit hashes, one to join and one to verify. The gram table's size is known
before the join: within `broadcast_bytes` it is broadcast, beyond it the join shuffles. Votes are counted by diagonal
before rows of a text meet, so repeated texts and null doc_ids are reduced first.

A base phrase stands where a single diagonal has all its grams. A label of the method's own is given to a text that
holds a body, at least two passages of it, or a passage that is enough alone. score is 1 for a base place, else the
largest share of a verified span.

Definitions: a null or empty text has no words; a row that repeats doc_id and text gives the same result again; null
doc_ids are kept. An empty table gives an empty result, further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, raw
from .decontam import words_of
from .license_texts import BASE, BODIES, PASSAGES

GRAM = 3
LEAST_SHARE = 0.7
#: Bytes of gram rows that are broadcast.
BROADCAST_BYTES = 16 << 20
#: Labels for which a single one of their passages is enough.
ALONE = frozenset({"gpl", "cc-by", "mpl-2", "isc", "unlicense", "all-rights-reserved"})


class Template(NamedTuple):
    """kind: base, passage (two of a label are needed, or one of ALONE) or body."""

    label: str
    words: tuple[bytes, ...]
    kind: str

    @property
    def slip(self) -> int:
        """Words that the text may have more or fewer than the template between two hits."""
        return max(3, len(self.words) // 10)


def templates_of(texts: Iterable[tuple[str, str, str]]) -> tuple[Template, ...]:
    """Templates of (label, text, kind); each needs GRAM words."""
    out = tuple(Template(label, tuple(words_of(text.encode())), kind) for label, text, kind in texts)
    if any(len(t.words) < GRAM for t in out):
        raise ValueError(f"a template has at least {GRAM} words")
    return out


TEMPLATES = templates_of([(*x, "base") for x in BASE] + [(*x, "passage") for x in PASSAGES] + [(*x, "body") for x in BODIES])

FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
CACHE = 1 << 18


class Hashes(dict):
    """Word to 64-bit hash, for the words met last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def grams(words: list[bytes], known: Hashes, size: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes (signed) of each window of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = []
    for factor in FACTORS:
        x = np.zeros(n, np.uint64)
        for k in range(size):
            x = (x ^ h[k : k + n]) * factor
            x ^= x >> np.uint64(29)
        out.append(x.view(np.int64))
    return out[0], out[1]


def template_rows(templates: tuple[Template, ...] = TEMPLATES) -> list[tuple[int, int, int, int]]:
    known, rows = Hashes(), []
    for t, template in enumerate(templates):
        a, b = grams(list(template.words), known)
        rows += [(int(x), int(y), t, p) for p, (x, y) in enumerate(zip(a, b, strict=True))]
    return rows


def gram_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, gram, check): all grams of all texts, and for each row of docs one with pos -1, its
    number of words as check and, so that these rows are no common key, a hash of the text as gram."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "th", "pos", "gram", "check"]

    def factory():
        known = Hashes()

        def step(b: pa.RecordBatch):
            owner, th, pos, gram, check = [], [], [], [], []
            for i, text in enumerate(raw(b.column(1))):
                words = words_of(text)
                x, y = grams(words, known)
                owner.append(np.full(len(x) + 1, i))
                th.append(np.full(len(x) + 1, xxhash.xxh3_64_intdigest(text), np.uint64))
                pos.append(np.arange(-1, len(x)))
                gram.append(np.concatenate((np.array([xxhash.xxh3_64_intdigest(text)], np.uint64).view(np.int64), x)))
                check.append(np.concatenate(([len(words)], y)))
            at = np.concatenate(owner)
            yield batch(names, [b.column(0).take(pa.array(at)), pa.array(np.concatenate(th).view(np.int64)), pa.array(np.concatenate(pos).astype(np.int32)), pa.array(np.concatenate(gram).astype(np.int64)), pa.array(np.concatenate(check).astype(np.int64))])

        return step

    return arrow_map(docs.select("doc_id", "text"), f"doc_id {kind}, th bigint, pos int, gram bigint, check bigint", factory, rows=200)


def merged_spans(template: Template, diagonals: list[tuple[int, list[int]]]) -> list[list[tuple[int, int]]]:
    """Hits (pos, template pos) in groups, by place: a group's hits go on in text and template, each diagonal within the
    template's slip of the one before.

    The longest chain through each hit is found from those within the template's length before it (of equally long
    ones, that of the nearest diagonal); the longest of all is a group, then the longest of what is left."""
    hits = sorted((diagonal + p, p) for diagonal, votes in diagonals for p in votes)
    length, previous, low = [1.0] * len(hits), [-1] * len(hits), 0
    for i, (pos, p) in enumerate(hits):
        while pos - hits[low][0] > len(template.words) + template.slip:
            low += 1
        for j in range(low, i):
            a, q = hits[j]
            move = abs(pos - p - a + q)
            if a < pos and q < p and move <= template.slip and (n := length[j] + 1 - move / 1000) > length[i]:
                length[i], previous[i] = n, j
    groups, used = [], [False] * len(hits)
    for i in sorted(range(len(hits)), key=lambda i: (-length[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(hits[i])
            i = previous[i]
        if chain:
            groups.append(chain[::-1])
    return sorted(groups)


def judge(diagonals: list[tuple[int, int, list[int]]], least_share: float = LEAST_SHARE, templates: tuple[Template, ...] = TEMPLATES) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
    """Base places (label, first word, end) and verified spans (label, first word, end, share) from (template, diagonal, votes)."""
    base, by_template = [], defaultdict(list)
    for t, diagonal, votes in diagonals:
        template = templates[t]
        distinct = sorted(set(votes))
        if template.kind != "base":
            by_template[t].append((diagonal, distinct))
        elif len(distinct) == len(template.words) - GRAM + 1:
            base.append((template.label, diagonal, diagonal + len(template.words)))
    spans = []
    for t, found in by_template.items():
        for g in merged_spans(templates[t], found):
            share = len({p for _, p in g}) / (len(templates[t].words) - GRAM + 1)
            if share >= least_share:
                spans.append((t, g[0][0], g[-1][0] + GRAM, share))
    passages = defaultdict(set)
    for t, *_ in spans:
        passages[templates[t].label].add(t)
    held = {label for label, ts in passages.items() if len(ts) > 1 or label in ALONE or any(templates[t].kind == "body" for t in ts)} | {label for label, _, _ in base}
    return sorted(base, key=lambda x: x[1:]), [(templates[t].label, a, b, s) for t, a, b, s in spans if templates[t].label in held]


def scan_licenses(docs: DataFrame, least_share: float = LEAST_SHARE, templates: tuple[Template, ...] = TEMPLATES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every row of docs (doc_id, text).

    spans: the verified spans (label, start, end in words, share of the passage)."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = template_rows(templates)
    table = spark.createDataFrame(own, "gram bigint, tcheck bigint, template int, tpos int")
    if 24 * len(own) <= broadcast_bytes:
        table = F.broadcast(table)
    rows = gram_rows(docs).join(table, "gram", "left").where("pos = -1 or check = tcheck")
    voted = rows.withColumn("diagonal", F.when(F.col("pos") >= 0, F.col("pos") - F.col("tpos"))).withColumn("template", F.when(F.col("pos") >= 0, F.col("template")))
    diagonals = voted.groupBy("doc_id", "th", "template", "diagonal").agg(F.collect_set(F.when(F.col("pos") >= 0, F.col("tpos"))).alias("votes"), F.sum(F.when(F.col("pos") < 0, 1)).alias("copies"), F.max(F.when(F.col("pos") < 0, F.col("check"))).alias("n"))
    texts = diagonals.groupBy("doc_id", "th").agg(F.max("n").alias("n_words"), F.sum("copies").alias("copies"), F.collect_list(F.when(F.col("template").isNotNull(), F.struct("template", "diagonal", "votes"))).alias("found"))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def factory():
        def step(b: pa.RecordBatch):
            out = {k: [] for k in names[2:]}
            for found in b.column(3).to_pylist():
                base, spans = judge([(x["template"], x["diagonal"], x["votes"]) for x in found], least_share, templates) if found else ([], [])
                out["n_base"].append(len(base))
                out["first_word"].append(min((a for _, a, _ in base), default=None))
                out["last_word"].append(max((a for _, a, _ in base), default=None))
                labels = {x for x, _, _ in base}
                out["base_labels"].append(",".join(sorted(labels)))
                out["labels"].append(",".join(sorted(labels | {x for x, *_ in spans})))
                out["score"].append(1.0 if base else max((s for *_, s in spans), default=0.0))
                out["spans"].append([{"label": x, "start": a, "end": e, "share": s} for x, a, e, s in sorted(spans, key=lambda x: x[1:])])
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))]
            columns = [b.column(0), b.column(1), *(pa.array(out[k], t) for k, t in zip(names[2:], kinds, strict=True)), b.column(2)]
            yield batch([*names, "copies"], columns)

        return step

    schema = f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,start:bigint,end:bigint,share:double>>, copies bigint"
    judged = arrow_map(texts.select("doc_id", "n_words", "copies", "found"), schema, factory)
    # a text that stands in many rows under one doc_id comes back row by row, not as one batch
    return judged.select(*names, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
