"""Rank fusion: ranked lists (query_id, list, id, score) become one list a query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .search import best


def by_list() -> WindowSpec:
    return Window.partitionBy("query_id", "list")


def adapt(hits: DataFrame, name: str, item: str = "doc_id") -> DataFrame:
    """Hits of one ranker as the common row."""
    return hits.select("query_id", F.lit(name).alias("list"), F.col(item).cast("bigint").alias("id"), F.col("score").cast("double").alias("score"))


def together(*lists: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, lists)


def rrf(hits: DataFrame, k: int = 10, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion: each list adds 1 / (constant + rank)."""
    rank = F.row_number().over(by_list().orderBy(F.desc("score"), "id"))
    summed = hits.withColumn("_rank", rank).groupBy("query_id", "id").agg(F.sum(1 / (constant + F.col("_rank"))).alias("score"))
    return best(summed, k, item="id", digits=9)


def min_max() -> Column:
    low, high = F.min("score").over(by_list()), F.max("score").over(by_list())
    return F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low))


def z_score() -> Column:
    spread = F.stddev_pop("score").over(by_list())
    return F.when(spread == 0, F.lit(0.0)).otherwise((F.col("score") - F.avg("score").over(by_list())) / spread)


def weighted_sum(hits: DataFrame, weights: dict[str, float], normalizer: Column | None = None, k: int = 10) -> DataFrame:
    """The weighted sum of normalized scores; a list that lacks an item adds nothing."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("list")], F.lit(0.0))
    value = normalizer if normalizer is not None else F.col("score")
    summed = hits.withColumn("_v", value).groupBy("query_id", "id").agg(F.sum(F.col("_v") * weight).alias("score"))
    return best(summed, k, item="id")
