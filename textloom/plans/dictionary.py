"""Dictionaries as tables (word, weight): membership, prefixes and overlays as joins.

A dictionary that is small is broadcast by Spark's own measure; a large one meets the texts' candidate pieces by an
equi-join, so neither has to fit into one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contains(tokens: DataFrame, words: DataFrame, column: str = "term") -> DataFrame:
    """The rows of tokens whose column is a word."""
    return tokens.join(words.select(F.col("word").alias(column)), column, "left_semi")


def unknown(tokens: DataFrame, words: DataFrame, column: str = "term") -> DataFrame:
    """The rows of tokens whose column is no word."""
    return tokens.join(words.select(F.col("word").alias(column)), column, "left_anti")


def with_prefix(words: DataFrame, prefix: str) -> DataFrame:
    """The words that begin with prefix, in order; Parquet statistics prune the rest."""
    return words.where(F.col("word").startswith(prefix)).orderBy("word")


def overlaid(base: DataFrame, more: DataFrame) -> DataFrame:
    """The union of two dictionaries; where both have a word the overlay's weight holds."""
    ranked = base.select("word", "weight", F.lit(0).alias("_r")).union(more.select("word", "weight", F.lit(1).alias("_r")))
    return ranked.groupBy("word").agg(F.max_by("weight", "_r").alias("weight"))


def prefix_weights(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, pos, length, weight): the words that stand at each position (from 0) of texts (doc_id, text).

    Only pieces as long as some word are candidates; the lengths of a dictionary are few."""
    lengths = sorted(r[0] for r in words.select(F.char_length("word").alias("n")).where("n > 0").distinct().collect())
    n = F.char_length("text")
    at = texts.where(n > 0).select("doc_id", "text", F.posexplode(F.sequence(F.lit(1), n)).alias("pos", "_from"))
    pieces = F.array(*[F.when(F.col("_from") + k - 1 <= n, F.substring(F.col("text"), F.col("_from"), F.lit(k))) for k in lengths]) if lengths else F.array().cast("array<string>")
    pieces = at.select("doc_id", "pos", F.explode(F.array_compact(pieces)).alias("word"))
    return pieces.join(words, "word").select("doc_id", "pos", F.char_length("word").alias("length"), "weight")


def union_of(*sets: DataFrame) -> DataFrame:
    """(term): the distinct terms of several stop sets."""
    out = sets[0].select("term")
    for s in sets[1:]:
        out = out.union(s.select("term"))
    return out.distinct()


def term_ids(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """tokens (…, term) with the id of each term, null where the vocabulary has none."""
    return tokens.join(vocabulary.select("term", "id"), "term", "left")
