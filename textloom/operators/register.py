"""The functions on single texts under SQL names, so that spark.sql reaches them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import normal, segment, sentences
from .arrow import SPANS, vectorized
from .phonetic import lk82

FUNCTIONS = {
    "text_nfc": (normal.nfc, "string"), "text_fold_width": (normal.fold_width, "string"), "text_fold_for_index": (normal.fold_for_index, "string"),
    "text_normalize": (normal.normalize, "string"), "text_canonical": (normal.canonical, "string"), "text_reorder_marks": (normal.reorder, "string"),
    "text_script_runs": (normal.script_runs, "array<struct<script:string,text:string,start:int>>"), "text_sentences": (sentences.heuristic_sentences, "array<string>"),
    "text_paragraphs": (sentences.paragraphs, SPANS), "text_lk82": (lk82, "string"),
}


def register(spark: SparkSession, analyzer: segment.Analyzer | None = None, chunk: sentences.ChunkOptions | None = None) -> list[str]:
    """Registers them; analyzer and chunk set what text_terms, text_segment and text_chunks do. Returns the names."""
    analyzer, chunk = analyzer or segment.Analyzer(), chunk or sentences.ChunkOptions(800)
    found = FUNCTIONS | {"text_terms": (analyzer.terms, "array<string>"), "text_segment": (analyzer.segment, "array<string>"), "text_chunks": (lambda t: sentences.chunks(t, chunk), SPANS)}
    for name, (f, kind) in found.items():
        spark.udf.register(name, vectorized(f, kind))
    return sorted(found)
