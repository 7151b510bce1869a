"""Exact dedup over a persistent digest index: a Parquet table bucketed and sorted by digest.

A batch is reduced to one row per digest first, the index takes what a sort-merge anti-join leaves. DataFrame
functions only. Definitions: a null text is empty; texts are equal when they are after lower-casing A-Z; of equal
texts the row with the largest doc_id stays (rows that tie on that id all stay; a null doc_id stays only where the
whole group has none). An empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WRITTEN, materialize, shared_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """text with A-Z in lower case and nothing else changed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest(text: Column) -> Column:
    """SHA-256 of the folded text, binary."""
    return F.unhex(F.sha2(folded(text).cast("binary"), 256))


class DigestIndex:
    """Rows (digest, keep_id, group_size), bucketed and sorted by digest, under one path.

    The files are all there is to the index: opening the same path again continues it. absorb() can be repeated
    after a failure, since digests that were appended are found and left out."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path or shared_path(spark, "digests"), buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        WRITTEN.append(("table", self.name))
        spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def entries(self) -> DataFrame:
        """The index through its buckets: joins on the digest need no exchange of it."""
        return self.spark.table(self.name)

    def files(self) -> DataFrame:
        """The index as plain files, for joins whose other side is skewed: Spark splits a hot digest only between two exchanges."""
        return self.spark.read.schema(self.entries().schema).parquet(self.path)

    def absorb(self, digests: DataFrame) -> None:
        """Appends the digests (doc_id, digest) that the index doesn't have; a digest's largest doc_id is kept."""
        # written first: else Catalyst moves the anti-join below the grouping, and a hot digest's rows meet in one task
        groups = materialize(digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
        fresh = groups.join(self.entries().select("digest").hint("merge"), "digest", "left_anti")
        fresh.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)

    def judge(self, digests: DataFrame) -> DataFrame:
        """A row for each row of digests: what the index keeps of its group. group_size is what the batch that brought the digest held."""
        joined = digests.hint("merge").join(self.files(), "digest")
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def buckets_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text), which the index absorbs."""
    spark = docs.sparkSession
    index = index or DigestIndex(spark, buckets=buckets_for(spark))
    digests = materialize(docs.select("doc_id", digest(F.col("text")).alias("digest")), "batch")
    index.absorb(digests)
    return index.judge(digests)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact dedup keeps, one of each text even where a doc_id repeats, all columns."""
    spark = docs.sparkSession
    index = DigestIndex(spark, buckets=buckets_for(spark))
    digests = materialize(docs.select("doc_id", digest(F.col("text")).alias("digest")), "batch")
    index.absorb(digests)
    lowest = F.lit(-(1 << 63))
    keep = index.files().select(F.col("digest").alias("_digest"), F.coalesce("keep_id", lowest).alias("_id"))
    own = docs.withColumns({"_digest": digest(F.col("text")), "_id": F.coalesce(F.col("doc_id").cast("bigint"), lowest)})
    # the join's partitioning serves the removal of repeated rows too
    return own.join(keep.hint("merge"), ["_digest", "_id"], "left_semi").dropDuplicates(["_digest", "_id"]).select(*docs.columns)
