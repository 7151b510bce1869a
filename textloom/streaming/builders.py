"""Streams: stateless text functions run as they are; builders merge each micro-batch into tables.

A builder writes what a batch adds under the batch's id, so a batch that is run again replaces its own part and
nothing is counted twice. Reading a table sums the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..plans import corpus


def tokenized(stream: DataFrame) -> DataFrame:
    """A stream with its texts' words; no state."""
    return stream.withColumn("terms", T.lower_words(F.col("text")))


class FrequencyTable:
    """Document and collection frequencies that grow with a stream of (doc_id, text); each document comes once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def absorb(self, batch: DataFrame, batch_id: int) -> None:
        arrays = corpus.token_arrays(batch)
        terms = corpus.document_frequency(corpus.term_frequency(arrays))
        terms.write.mode("overwrite").parquet(f"{self.path}/terms/batch={batch_id}")
        arrays.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("coll_len")).write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.absorb).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    def totals(self) -> corpus.Totals:
        n, length = self.spark.read.parquet(f"{self.path}/totals").agg(F.sum("n"), F.sum("coll_len")).first()
        return corpus.Totals(n, length / n if n else 0.0, length)


class Vocabulary:
    """Ids that stay: one writer appends, batch by batch, the terms it has not seen, numbered after the largest id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def absorb(self, batch: DataFrame, batch_id: int) -> None:
        fresh = corpus.vocabulary(corpus.token_arrays(batch)).select("term", "id")
        known, top = None, -1
        earlier = self.read(before=batch_id)
        if earlier is not None:
            known, top = earlier, earlier.agg(F.max("id")).first()[0]
            top = -1 if top is None else top
            fresh = fresh.join(known.select("term"), "term", "left_anti")
        numbered = corpus.numbered(fresh.withColumnRenamed("id", "at"), "at")
        numbered.select("term", (F.col("id") + top + 1).alias("id")).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, before: int | None = None) -> DataFrame | None:
        try:
            rows = self.spark.read.option("basePath", self.path).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return rows if before is None else rows.where(F.col("batch") < before)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.absorb).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event_windows(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; `late` sets the watermark of a stream."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, n) of sessions that a gap ends."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
