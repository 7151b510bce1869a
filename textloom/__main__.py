"""Splits Thai lines into words.

    python -m textloom --dict words.txt [--overlay a,b] [--keep-ws] < lines > words
    python -m textloom --dict words.txt --input folder --output folder     # the same as a Spark job over text files
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from typing import TextIO

from .operators import segment


def dictionary(path: str, overlay: str = "") -> segment.Dictionary:
    """Words of a file, one a line with a weight after a tab if any, and those of the overlay, comma-separated."""
    words = segment.Dictionary()
    with open(path, encoding="utf-8") as f:
        for line in f:
            word, _, weight = line.strip().partition("\t")
            words.add(word, int(weight) if weight.strip() else None)
    for word in overlay.split(","):
        words.add(word)
    return words


def cutter(words: segment.Dictionary, blanks: bool = False) -> Callable[[str], str]:
    """A line's words, joined by a space; blank ones stay if asked for."""

    def cut(line: str) -> str:
        spans = segment.thai_spans(line, words)
        return " ".join(line[a:b] for a, b in (spans if blanks else segment.without_blanks(line, spans)))

    return cut


def job(spark, source: str, target: str, words: segment.Dictionary, blanks: bool = False) -> None:
    """The lines of text files, cut; a line stays a line."""
    from .operators.arrow import vectorized

    spark.read.text(source).select(vectorized(cutter(words, blanks), "string")("value").alias("value")).write.text(target)


def main(args: list[str] | None = None, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    parser = argparse.ArgumentParser(prog="textloom", description="Splits Thai lines into words.")
    parser.add_argument("--dict", required=True, help="a word a line, an integer weight after a tab")
    parser.add_argument("--overlay", default="", help="further words, comma-separated")
    parser.add_argument("--keep-ws", action="store_true", help="blank tokens stay")
    parser.add_argument("--input", help="text files for a Spark job, instead of standard input")
    parser.add_argument("--output", help="the folder that the job writes")
    o = parser.parse_args(args)
    words = dictionary(o.dict, o.overlay)
    if o.input:
        from pyspark.sql import SparkSession

        job(SparkSession.builder.getOrCreate(), o.input, o.output, words, o.keep_ws)
        return
    cut = cutter(words, o.keep_ws)
    for line in lines:
        out.write(cut(line.rstrip("\n")) + "\n")


if __name__ == "__main__":
    main()
