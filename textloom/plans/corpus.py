"""Corpus statistics, vocabulary and stop words as DataFrames.

tokens: (doc_id, pos, term), one row a token, made from an array column without a shuffle. Null texts have no tokens;
documents without tokens count in n."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import weighting
from .storage import materialize


def token_arrays(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    """(doc_id, terms, dl): the words of each document, lowered, and how many."""
    terms = F.coalesce(tokens if tokens is not None else T.lower_words(F.col("text")), F.array().cast("array<string>"))
    return docs.select("doc_id", terms.alias("terms")).withColumn("dl", F.size("terms").cast("bigint"))


def explode_tokens(arrays: DataFrame) -> DataFrame:
    return arrays.select("doc_id", F.posexplode("terms").alias("pos", "term"))


def term_frequency(arrays: DataFrame) -> DataFrame:
    """(doc_id, term, tf); the groups are partial on the map side."""
    return explode_tokens(arrays).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@dataclass(frozen=True)
class Totals:
    """Numbers of the corpus; one row of an aggregate, so they come to the driver."""

    n: int
    avgdl: float
    coll_len: int


def totals(arrays: DataFrame) -> Totals:
    n, length = arrays.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return Totals(n, length / n if n else 0.0, length)


def idf_table(terms: DataFrame, n: int) -> DataFrame:
    return terms.withColumn("idf", weighting.idf(F.lit(float(n)), F.col("df")))


def vocabulary(arrays: DataFrame) -> DataFrame:
    """(term, id, df): ids from 0 in the order in which terms are first seen, by doc_id, then position.

    Ids are dense, so they are numbered over the sorted terms range by range: each range's first id is the number of
    terms in the ranges before it. The ranges' counts are all that meets in one place."""
    first = explode_tokens(arrays).groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.count_distinct("doc_id").alias("df"))
    return numbered(first, "at").select("term", "id", "df")


def numbered(rows: DataFrame, by: str, name: str = "id") -> DataFrame:
    """rows with their rank from 0 in the order of the column `by`, without putting all rows in one task."""
    dealt = materialize(rows.sort(by).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = {r[0]: r[1] for r in dealt.groupBy("_part").count().collect()}
    before, at = [], 0
    for part in sorted(counts):
        before.append((part, at))
        at += counts[part]
    starts = rows.sparkSession.createDataFrame(before or [(0, 0)], "_part int, _first bigint")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn(name, F.col("_first") + F.col("_own")).drop("_part", "_own", "_first")


def held_out(rows: DataFrame, by: str, share: float = 0.1) -> DataFrame:
    """rows with `held`, true for the first and every further (1 / share)-th in the order of `by`: whole documents, so
    that none is on both sides of the split."""
    stride = max(2, int(1 / share))
    return numbered(rows, by, "_at").withColumn("held", F.col("_at") % stride == 0).drop("_at")


def extend_vocabulary(old: DataFrame, arrays: DataFrame) -> DataFrame:
    """old (term, id, df) with what arrays bring: known terms keep their ids, new ones follow the largest."""
    top = old.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    new = vocabulary(arrays)
    fresh = numbered(new.join(old, "term", "left_anti").select("term", F.col("id").alias("at"), "df"), "at").select("term", (F.col("id") + top + 1).alias("id"), "df")
    kept = old.join(new.select("term", F.col("df").alias("more")), "term", "left").select("term", "id", (F.col("df") + F.coalesce("more", F.lit(0))).alias("df"))
    return kept.unionByName(fresh)


def corpus_stop_words(terms: DataFrame, n: int, fraction: float = 0.5) -> DataFrame:
    """(term, df) of terms in at least that share of the documents."""
    return terms.where(F.col("df") >= F.lit(fraction * n)).select("term", "df")


def without_stop_words(tokens: DataFrame, stop: list[str] | DataFrame) -> DataFrame:
    """tokens whose term is no stop word: a membership test for a list, an anti-join for a table."""
    if isinstance(stop, DataFrame):
        return tokens.join(stop.select("term"), "term", "left_anti")
    return tokens.where(~F.col("term").isin(stop))


def evaluation(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: tp, fp, fn, precision, recall and f1 of 0/1 columns."""
    hit = lambda a, b: F.count_if((F.col(label) == a) & (F.col(predicted) == b))
    counted = rows.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 0.0).otherwise(F.col(a) / (F.col(a) + F.col(b)))
    both = counted.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})
    total = F.col("precision") + F.col("recall")
    return both.withColumn("f1", F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / total))
