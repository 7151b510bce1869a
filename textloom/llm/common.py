"""What the operators of this subpackage share: table access, shared storage, Arrow maps, components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a map function sees at once; documents can be long, so a batch of them is cut.
SLICE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none (a local run, tests), a local folder serves."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    WRITTEN.append(("path", path))
    return path


#: Paths and tables written for the session's running work, for scratch() to delete.
WRITTEN: list[tuple[str, str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, when the block ends, what operators wrote in the shared folder within it.

    The operators' results are lazy and read those intermediates, so write the result out within the block."""
    began = len(WRITTEN)
    try:
        yield
    finally:
        gone = WRITTEN[began:]
        del WRITTEN[began:]
        for kind, name in gone:
            if kind == "table":
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            else:
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, schema: str, factory: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], rows: int = SLICE) -> DataFrame:
    """mapInArrow with state made once a task (factory) and batches of at most `rows` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = factory()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield from step(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """The strings of a column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores where df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def first_row(text_hash: str = "th") -> Column:
    """An aggregate: the first row (doc_id, th) of a group; a null doc_id only where there is no other."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", text_hash))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that name their group in found (doc_id, th, component_id, first), by doc_id and hash of the text."""
    one, two = free_name(docs, "_lost"), free_name(docs, "_text_hash")
    named = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("first"))
    lost = found.where(~named).select(F.col("doc_id").alias(one), F.col("th").alias(two)).distinct()
    return docs.join(lost, docs["doc_id"].eqNullSafe(lost[one]) & (F.xxhash64(docs["text"]) == lost[two]), "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b: long): a row (node, root) for every node, root the smallest node reachable.

    Alternating large-star and small-star rounds over a table of edges, to the fixed point (their number grows with the
    logarithm of the nodes); each round is written to the shared folder. Work a round is proportional to the edges,
    neither nodes nor edges come to the driver."""
    spark = edges.sparkSession
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    last, at = None, (0, None)
    while at != last:
        last = at
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.where("u <> v"), "large")
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), "small")
        at = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(roots.select(F.col("root").alias("node"), "root").distinct())
