"""Wrapping per-text algorithms as vectorized functions: whole Arrow batches cross to Python, never single rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Text = Callable[[str], Any]
#: Characters (or items) of texts whose results a worker holds at once, before they go back; one text may have more.
PART = 1 << 18


def parts(texts: pd.Series) -> Iterator[pd.Series]:
    """The texts in runs of about PART characters, each of one text at least."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += 1 + (len(t) if hasattr(t, "__len__") else 0)
        if held >= PART:
            yield texts.iloc[begin : i + 1]
            begin, held = i + 1, 0
    if begin < len(texts):
        yield texts.iloc[begin:]


def list_parts(batches: Iterator[pa.RecordBatch], items: int, column: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches one column of which is a list, in slices of about so many items of it, each of one row at least."""
    for b in batches:
        ends, at = b.column(column).offsets.to_numpy(), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + items, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def vectorized(function: Text, returns: str) -> Callable[..., Column]:
    """A Column function that applies function to each text; null stays null. Results leave part by part: those of a
    whole Arrow batch of long texts, as Python objects, can be many times the texts."""

    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for part in parts(texts):
                yield pd.Series([None if t is None else function(t) for t in part], dtype=object)

    apply.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(apply, returns)


def vectorized_pair(function: Callable[[Any, Any], Any], returns: str) -> Callable[..., Column]:
    """The same for functions of two columns; null if either is."""

    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    apply.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(apply, returns)


SPANS = "array<struct<text:string,start:int,end:int>>"


def byte_spans(text: str, spans: list[tuple[int, int]]) -> list[dict]:
    """Spans of code points as rows whose offsets count UTF-8 bytes; spans begin in ascending order and may overlap."""
    if text.isascii():
        return [{"text": text[a:b], "start": a, "end": b} for a, b in spans]
    out, at, byte = [], 0, 0
    for a, b in spans:
        byte += len(text[at:a].encode("utf-8", "surrogatepass"))
        piece = text[a:b]
        out.append({"text": piece, "start": byte, "end": byte + len(piece.encode("utf-8", "surrogatepass"))})
        at = a
    return out
