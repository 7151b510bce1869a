"""Sparse retrieval: an inverted index as tables, and top-k search of a batch of queries.

A search goes document by document: the postings of the queries' terms, which grow with the documents alone, are dealt by
doc_id with what the term adds to a score; each task multiplies blocks of documents by the queries' weights, which all
tasks have, and keeps the best k of each query. Pairs of query and document are never rows. Scores are rounded to
`digits` before they are ranked, ties go to the smaller doc_id."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import weighting
from ..functions.weighting import Stats
from . import corpus
from .storage import materialize

DIGITS = 6
BLOCK = 128
MU = 2000.0
#: Query terms that are sent to all tasks; with more, pairs of query and document are grouped by joins.
ENTRIES = 1 << 20
#: Pairs of document and query, and pairs of posting and query, that a task scores at once.
CELLS, PRODUCTS = 1 << 20, 1 << 21


@dataclass
class Index:
    """postings (term, doc_id, tf, dl), terms (term, df, cf) and the corpus's totals."""

    postings: DataFrame
    terms: DataFrame
    totals: corpus.Totals

    def save(self, path: str, buckets: int = 64) -> None:
        """Parquet, postings sorted by term within files dealt by term: a query reads few row groups."""
        spark = self.postings.sparkSession
        self.postings.repartition(buckets, "term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        t = self.totals
        spark.createDataFrame([(t.n, t.avgdl, t.coll_len)], "n bigint, avgdl double, coll_len bigint").write.mode("overwrite").parquet(f"{path}/totals")

    @staticmethod
    def load(spark, path: str) -> Index:
        t = spark.read.parquet(f"{path}/totals").first()
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), corpus.Totals(t.n, t.avgdl, t.coll_len))


def build(arrays: DataFrame, label: str = "") -> Index:
    """The index of (doc_id, terms, dl); with a label its postings are written first. dl travels with each token, so no
    join brings it back."""
    postings = arrays.select("doc_id", "dl", F.explode("terms").alias("term")).groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    postings = materialize(postings, label) if label else postings
    n, length = arrays.count(), postings.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    return Index(postings, corpus.document_frequency(postings), corpus.Totals(n, length / n if n else 0.0, length))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, weight) of queries (query_id, terms); a repeated term weighs more."""
    return queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("weight"))


def stats(t: corpus.Totals, tf: Column | None = None) -> Stats:
    return Stats(tf if tf is not None else F.col("tf"), F.col("dl"), F.col("df"), F.col("cf"), F.lit(float(t.n)), F.lit(t.avgdl), F.lit(float(t.coll_len)))


def matches(index: Index, queries: DataFrame) -> DataFrame:
    """A row for each query term in each document that has it: query_id, term, weight, doc_id, tf, dl, df, cf."""
    asked = query_terms(queries).join(index.terms, "term")
    return index.postings.join(asked, "term")


def scores(index: Index, queries: DataFrame, scheme: str = "bm25", **parameters: float) -> DataFrame:
    """(query_id, doc_id, score) of documents with a query term at least.

    A smoothed scheme scores the terms a document lacks too: what they would add is summed for the query as a whole
    and put right by the terms that are there."""
    function = weighting.SCHEMES[scheme]
    each = F.col("weight") * function(stats(index.totals), **parameters)
    found = matches(index, queries)
    if scheme not in weighting.SMOOTHED:
        return found.groupBy("query_id", "doc_id").agg(F.sum(each).alias("score"))
    mu, total = parameters.get("mu", MU), float(index.totals.coll_len)
    prior = F.log(mu * F.col("cf") / F.lit(total))
    whole = query_terms(queries).join(index.terms, "term").groupBy("query_id").agg(F.sum(F.col("weight") * prior).alias("base"), F.sum("weight").alias("terms"))
    more = found.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * (F.log(F.col("tf") + mu * F.col("cf") / F.lit(total)) - prior)).alias("more"), F.first("dl").alias("dl"))
    return more.join(whole, "query_id").select("query_id", "doc_id", (F.col("base") + F.col("more") - F.col("terms") * F.log(F.col("dl") + mu)).alias("score"))


def best(scored: DataFrame, k: int, group: str = "query_id", item: str = "doc_id", digits: int = DIGITS) -> DataFrame:
    """The k rows of each group with the largest rounded score, and their rank from 1."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), F.asc(item))
    return scored.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


@dataclass
class Batch:
    """A batch of queries: row i of names is (q, query_id), terms (term, t, df, cf); entry i says that query q[i] weighs term t[i] by w[i],
    entries by t. base and size are each query's sums of prior and weight."""

    names: DataFrame
    terms: DataFrame
    t: np.ndarray
    q: np.ndarray
    w: np.ndarray
    base: np.ndarray
    size: np.ndarray


def batch_of(index: Index, queries: DataFrame) -> Batch | None:
    """None if there are more than ENTRIES query terms."""
    spark = queries.sparkSession
    prior = F.log(MU * F.col("cf") / F.lit(float(index.totals.coll_len)))
    asked = materialize(query_terms(queries).join(index.terms, "term").withColumn("prior", prior), "asked")
    if asked.count() > ENTRIES:
        return None
    found = asked.orderBy("term", "query_id").toArrow().combine_chunks()
    coded = [pa.array(found.column(c).to_pylist(), found.schema.field(c).type).dictionary_encode(null_encoding="encode") for c in ("query_id", "term")]
    q, t = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in coded)
    first = np.unique(t, return_index=True)[1]
    w, p = (found.column(c).to_numpy().astype(np.float64) for c in ("weight", "prior"))
    names = pa.table({"q": pa.array(range(len(coded[0].dictionary)), pa.int32()), "query_id": coded[0].dictionary})
    terms = pa.table({"t": pa.array(t[first].astype(np.int32)), **{c: found.column(c).take(pa.array(first)) for c in ("term", "df", "cf")}})
    name_kind, term_kind = (f"{a} {queries.schema['query_id'].dataType.simpleString() if a == 'query_id' else b}" for a, b in (("query_id", ""), ("term", "string")))
    sums = [np.bincount(q, x, len(coded[0].dictionary)) for x in (w * p, w)]
    return Batch(spark.createDataFrame(names, f"q int, {name_kind}"), spark.createDataFrame(terms, f"t int, {term_kind}, df bigint, cf bigint"), t, q, w, *sums)


def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Table]]:
    """(ids, at, rows): the documents of rows that come by their first column, and which of these each row is of; all rows of a document."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        now = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])]).combine_chunks()
        coded = now.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
        at = coded.indices.to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(at, at[-1]))  # the last document may go on
        held = now.slice(cut)
        if cut:
            yield coded.dictionary.slice(0, int(at[-1])), at[:cut], now.slice(0, cut)
    if held is not None and held.num_rows:
        yield held.column(0).combine_chunks().slice(0, 1), np.zeros(held.num_rows, np.int64), held


class Scoring:
    """Scores blocks of documents, in the order of doc_id, and holds the best k of each query. With bounds (what each
    entry can add at most) only documents are scored in full that can reach the k-th score; with width, only runs of so many documents in
    which the largest values of the terms together can. Both need values that are never negative."""

    def __init__(self, t: np.ndarray, q: np.ndarray, w: np.ndarray, base: np.ndarray | None, size: np.ndarray, n_terms: int, k: int, digits: int, bounds: np.ndarray | None = None, width: int = 0):
        self.t, self.q, self.w, self.base, self.size, self.n_terms = t, q, w, base, size, n_terms
        self.k, self.digits, self.width = k, digits, width
        self.floor = np.full(len(size), -np.inf)
        self.held: list[tuple] = []
        self.seen = 0
        self.bounds = bounds
        if bounds is not None:  # of each entry with those of its query that can add less
            order = np.lexsort((t, bounds, q))
            run = np.cumsum(bounds[order])
            new = np.append(True, q[order][1:] != q[order][:-1])
            self.below = np.empty(len(q))
            self.below[order] = run - np.maximum.accumulate(np.where(new, run - bounds[order], 0.0))
        self.deal()

    def deal(self) -> None:
        """Which entries are scored first, and what the others can add."""
        first = np.ones(len(self.q), bool) if self.bounds is None else self.reaches(self.below, self.floor[self.q])
        self.sides = [self.rows_of(first), self.rows_of(~first)]
        self.rest = np.zeros(len(self.size)) if first.all() else np.bincount(self.q[~first], self.bounds[~first], len(self.size))

    def rows_of(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.searchsorted(self.t[some], np.arange(self.n_terms + 1)), self.q[some], self.w[some]

    @staticmethod
    def reaches(score: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Whether a score reaches the floor, with room for rounding."""
        return score * (1 + 1e-12) + 1e-6 >= floor

    def products(self, at: np.ndarray, t: np.ndarray, v: np.ndarray, side: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(cell, value): each posting (document or block at, term t, value v) with each entry of its term."""
        starts, q, w = self.sides[side]
        n = starts[t + 1] - starts[t]
        e = np.repeat(starts[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(at * len(self.size), n) + q[e], np.repeat(v, n) * w[e]

    def add(self, ids: pa.Array, at: np.ndarray, t: np.ndarray, v: np.ndarray, extra: np.ndarray) -> None:
        """ids of some documents; their postings by at, the place in ids; extra: what the document has for each unit of a query's size."""
        each = np.bincount(self.t, minlength=self.n_terms)[t]
        starts = np.append(np.searchsorted(at, np.arange(len(ids))), len(at))
        work = np.append(0, np.cumsum(each))[starts]
        most, a = max(1, CELLS // max(1, len(self.size))), 0
        if self.width:
            most = max(self.width, most // self.width * self.width)
        while a < len(ids):
            z = min(a + most, max(a + 1, int(np.searchsorted(work, work[a] + PRODUCTS, "right")) - 1), len(ids))
            cut = slice(starts[a], starts[z])
            self.block(ids.slice(a, z - a), at[cut] - a, t[cut], v[cut], extra[cut])
            a = z

    def block(self, ids: pa.Array, at: np.ndarray, t: np.ndarray, v: np.ndarray, extra: np.ndarray) -> None:
        d, n = len(ids), len(self.size)
        cell, value = self.products(at, t, v)
        if self.width and np.isfinite(self.floor).any():
            run = at // self.width
            order = np.lexsort((v, t, run))
            last = np.append((run[order][1:] != run[order][:-1]) | (t[order][1:] != t[order][:-1]), True)
            top = order[last]
            most = np.bincount(*self.products(run[top], t[top], v[top]), (d // self.width + 1) * n)
            alive = self.reaches(most, np.tile(self.floor, d // self.width + 1))
            keep = alive[cell // n // self.width * n + cell % n]
            cell, value = cell[keep], value[keep]
        score = np.bincount(cell, value, d * n)
        found = np.zeros(d * n, bool)
        found[cell] = True
        if self.bounds is not None and len(self.sides[1][1]):
            found &= self.reaches(score.reshape(d, n) + self.rest, self.floor).ravel()
            near = found.reshape(d, n).any(1)[at]
            cell, value = self.products(at[near], t[near], v[near], 1)
            keep = found[cell]
            score += np.bincount(cell[keep], value[keep], d * n)
        score = score.reshape(d, n)
        if self.base is not None:
            own = np.zeros(d)
            own[at] = extra
            score = self.base + score - self.size * own[:, None]
        even = np.round(score, self.digits)
        i, q = np.nonzero(found.reshape(d, n) & (even > self.floor))  # of equal scores the first that came stays
        if len(i):
            self.held.append((ids.take(pa.array(i)), self.seen + i, q, score[i, q], even[i, q]))
            if sum(len(x[1]) for x in self.held) > 4 * self.k * n + CELLS // 4:
                self.best()
                self.deal()
        self.seen += d

    def best(self) -> tuple:
        """(ids, places, queries, scores, rounded scores) of the best k of each query so far; their last is its floor."""
        if not self.held:
            return ()
        ids = pa.concat_arrays([x[0] for x in self.held])
        place, q, score, even = (np.concatenate([x[i] for x in self.held]) for i in range(1, 5))
        order = np.lexsort((place, -even, q))
        first = np.flatnonzero(np.append(True, q[order][1:] != q[order][:-1]))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        kth = order[rank == self.k - 1]
        self.floor[q[kth]] = even[kth]
        order = order[rank < self.k]
        self.held = [(ids.take(pa.array(order)), place[order], q[order], score[order], even[order])]
        return self.held[0]


def ranked(index: Index, queries: DataFrame, k: int, scheme: str, prune: bool = False, width: int = 0, digits: int = DIGITS, **parameters: float) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best documents of each query; a smoothed scheme knows no query without id."""
    queries = queries.where(F.col("query_id").isNotNull()) if scheme in weighting.SMOOTHED else queries
    asked = batch_of(index, queries) if k > 0 and not (scheme in weighting.SMOOTHED and parameters) else None
    if asked is None:
        return best(scores(index, queries, scheme, **parameters), k, digits=digits)
    smoothed = scheme in weighting.SMOOTHED
    value, extra = weighting.SCHEMES[scheme](stats(index.totals), **parameters), F.lit(0.0)
    if smoothed:
        prior = MU * F.col("cf") / F.lit(float(index.totals.coll_len))
        value, extra = F.log(F.col("tf") + prior) - F.log(prior), F.log(F.col("dl") + MU)
    found = index.postings.join(F.broadcast(asked.terms), "term").select("doc_id", "t", value.alias("v"), extra.alias("extra"))
    n_terms, bounds = int(asked.t.max()) + 1 if len(asked.t) else 0, None
    if prune:
        found = materialize(found, "matches")
        most = np.zeros(n_terms)
        for r in found.groupBy("t").agg(F.max("v").alias("v")).collect():
            most[r.t] = max(r.v, 0.0)
        bounds = asked.w * most[asked.t]
    shared = queries.sparkSession.sparkContext.broadcast((asked.t, asked.q, asked.w, asked.base if smoothed else None, asked.size, n_terms, k, digits, bounds, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scoring = Scoring(*shared.value)
        for ids, at, rows in by_document(batches):
            scoring.add(ids, at.astype(np.int64), *(rows.column(i).to_numpy() for i in (1, 2, 3)))
        if kept := scoring.best():
            yield pa.RecordBatch.from_arrays([pa.array(kept[2].astype(np.int32)), kept[0], pa.array(kept[3])], names=["q", "doc_id", "score"])

    kind = index.postings.schema["doc_id"].dataType.simpleString()
    dealt = found.repartition("doc_id") if not width else found.repartition(F.floor(F.col("doc_id") / width))
    each = dealt.sortWithinPartitions("doc_id", "t").mapInArrow(run, f"q int, doc_id {kind}, score double")
    return best(each.join(F.broadcast(asked.names), "q").select("query_id", "doc_id", "score"), k, digits=digits)


def search(index: Index, queries: DataFrame, k: int = 10, scheme: str = "bm25", **parameters: float) -> DataFrame:
    """(query_id, doc_id, score, rank)."""
    return ranked(index, queries, k, scheme, **parameters)


def upper_bounds(index: Index, scheme: str = "bm25") -> DataFrame:
    """(term, bound): the most that the term adds to any document, 0 at least."""
    return index.postings.join(index.terms, "term").groupBy("term").agg(F.greatest(F.max(weighting.SCHEMES[scheme](stats(index.totals))), F.lit(0.0)).alias("bound"))


def numbered(postings: DataFrame, width: int = 100_000) -> DataFrame:
    """postings with at, from 0 among those of their term by doc_id, and the term's df and cf: numbered within ranges of
    doc_ids, each of which starts where the ranges before it end, so no task holds all postings of a term."""
    cut = postings.withColumn("_r", F.floor(F.col("doc_id") / width))
    sizes = cut.groupBy("term", "_r").agg(F.count("*").alias("_n"), F.sum("tf").alias("_tf"))
    term = Window.partitionBy("term")
    before = term.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("term", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(term).alias("df"), F.sum("_tf").over(term).alias("cf"))
    own = F.row_number().over(Window.partitionBy("term", "_r").orderBy("doc_id")) - 1
    return cut.withColumn("_own", own).join(first, ["term", "_r"]).withColumn("at", F.col("_first") + F.col("_own")).drop("_r", "_own", "_first")


def block_bounds(index: Index, scheme: str = "bm25", block: int = BLOCK) -> DataFrame:
    """(term, block, bound, last_doc) for each run of `block` postings of a term by doc_id."""
    cut = numbered(index.postings).withColumn("block", F.floor(F.col("at") / block))
    return cut.groupBy("term", "block").agg(F.greatest(F.max(weighting.SCHEMES[scheme](stats(index.totals))), F.lit(0.0)).alias("bound"), F.max("doc_id").alias("last_doc"))


def pruned_search(index: Index, queries: DataFrame, k: int = 10, scheme: str = "bm25") -> DataFrame:
    """What search gives, for schemes that add nothing negative, without looking at all postings of common terms.

    Terms whose bounds together stay below the k-th score so far cannot lift a document over it alone, so only documents
    with one of the other, essential terms are candidates, and of these only those that reach it with all the rest could
    add. The values of the other terms are looked up for these few."""
    return ranked(index, queries, k, scheme, prune=True)


def block_search(index: Index, queries: DataFrame, k: int = 10, scheme: str = "bm25", width: int = 128) -> DataFrame:
    """What search gives, for schemes that add nothing negative, looking only into runs of `width` documents whose bounds
    together reach the k-th score so far."""
    return ranked(index, queries, k, scheme, width=width)
