"""Sources and sinks: dictionaries, stop words, word groups, word vectors, CoNLL-U, CSV dialogues, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trimmed


def lines(spark: SparkSession, path: str, comments: bool = False) -> DataFrame:
    """(value): trimmed lines, none empty."""
    rows = spark.read.text(path).select(trimmed(F.col("value")).alias("value")).where("value <> ''")
    return rows.where(~F.col("value").startswith("#")) if comments else rows


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, weight): a word a line; after a tab an integer weight. A line whose weight is none is left out."""
    parts = F.split("value", "\t", 2)
    rows = lines(spark, path).select(trimmed(parts[0]).alias("word"), F.get(parts, F.lit(1)).alias("_w"))
    rows = rows.withColumn("weight", F.expr("try_cast(trim(_w) AS INT)"))
    return rows.where("word <> '' AND (_w IS NULL OR weight IS NOT NULL)").select("word", "weight").dropDuplicates(["word"])


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(term): lines, # begins a comment."""
    return lines(spark, path, comments=True).select(F.col("value").alias("term")).distinct()


def groups(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, pos, form): each line a group of forms."""
    rows = lines(spark, path, comments=True)
    return rows.select(F.xxhash64("value").alias("group_id"), F.posexplode(F.split("value", r"\s+")).alias("pos", "form"))


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec): text vectors under a header `count dim`; a word may hold blanks. A malformed number is an error."""
    head = spark.read.text(path).first()
    if head is None or len(head[0].split()) != 2:
        raise ValueError("the header must be: count dim")
    dim = int(head[0].split()[1])
    parts = F.split(F.rtrim(F.col("value")), " ")
    rows = spark.read.text(path).where((F.col("value") != head[0]) & (F.trim("value") != "")).select(parts.alias("p"))
    word = F.array_join(F.slice("p", F.lit(1), F.size("p") - dim), " ")
    return rows.select(word.alias("word"), F.transform(F.slice("p", -dim, dim), lambda x: x.cast("float")).alias("vec"))


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """(path, sentence, tokens, text): sentences of CoNLL-U files; ranges and empty nodes are skipped."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n\s*\r?\n")).alias("sentence", "block"))
    rows = F.filter(F.split("block", r"\r?\n"), lambda x: x.rlike(r"\A[0-9]+\t"))
    tokens = F.transform(rows, lambda r: F.struct(F.split(r, "\t")[1].alias("form"), (~r.rlike("SpaceAfter=No")).alias("space")))
    text = F.regexp_extract("block", r"(?m)^# text = (.*)$", 1)
    return files.select("path", "sentence", tokens.alias("tokens"), text.alias("text")).where(F.size("tokens") > 0)


def dialogues(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """CSV with a header; rows may be ragged and quotes loose."""
    return spark.read.csv(path, header=True, mode="PERMISSIVE", multiLine=True, escape='"').select(F.col(text).alias("text"))


def crf_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="feature string, w_i double, w_e double", comment="#", quote="")


def char_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="idx bigint, weight float", comment="#")


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)
