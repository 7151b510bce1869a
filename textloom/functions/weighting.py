"""Term weighting schemes as Column expressions over tf, df, cf, dl and the corpus's n, avgdl and coll_len.

Each scheme is a function of a Stats of Columns; what a document scores is the sum over its query terms."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stats:
    """tf and dl of a document, df and cf of a term, n, avgdl and coll_len of the corpus; Columns or numbers."""

    tf: Column
    dl: Column
    df: Column
    cf: Column
    n: Column
    avgdl: Column
    coll_len: Column


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def length_norm(dl: Column, avgdl: Column, b: float) -> Column:
    return F.when(avgdl <= 0, F.lit(1.0)).otherwise(1 - b + b * dl / avgdl)


def present(s: Stats, value: Column) -> Column:
    return F.when(s.tf > 0, value).otherwise(F.lit(0.0))


def bm25(s: Stats, k1: float = 1.2, b: float = 0.75) -> Column:
    return present(s, idf(s.n, s.df) * s.tf * (k1 + 1) / (s.tf + k1 * length_norm(s.dl, s.avgdl, b)))


def bm25_plus(s: Stats, k1: float = 1.2, b: float = 0.75, delta: float = 1.0) -> Column:
    return present(s, idf(s.n, s.df) * (s.tf * (k1 + 1) / (s.tf + k1 * length_norm(s.dl, s.avgdl, b)) + delta))


def bm25_l(s: Stats, k1: float = 1.2, b: float = 0.75, delta: float = 0.5) -> Column:
    c = s.tf / length_norm(s.dl, s.avgdl, b)
    return present(s, idf(s.n, s.df) * (k1 + 1) * (c + delta) / (k1 + c + delta))


def dfr_pl2(s: Stats, c: float = 1.0) -> Column:
    """Poisson with Laplace after-effect and normalization 2."""
    dl = F.when(s.dl <= 0, s.avgdl).otherwise(s.dl)
    tfn = s.tf * F.log2(1 + c * s.avgdl / dl)
    lam = s.cf / s.n
    gain = tfn * F.log2(tfn / lam) + (lam + 1 / (12 * tfn) - tfn) * math.log2(math.e) + 0.5 * F.log2(2 * math.pi * tfn)
    return F.when((s.tf <= 0) | (s.cf <= 0) | (s.n <= 0) | (tfn <= 0), F.lit(0.0)).otherwise(gain / (tfn + 1))


def ql_dirichlet(s: Stats, mu: float = 2000.0) -> Column:
    """Query likelihood; a term the document lacks (tf 0) scores too, one the corpus lacks scores 0."""
    return F.when(s.cf <= 0, F.lit(0.0)).otherwise(F.log((s.tf + mu * s.cf / s.coll_len) / (s.dl + mu)))


def tf_idf(s: Stats) -> Column:
    return F.when((s.tf <= 0) | (s.df >= s.n), F.lit(0.0)).otherwise((1 + F.log(s.tf)) * F.log(s.n / s.df))


Scheme = Callable[[Stats], Column]

SCHEMES: dict[str, Scheme] = {"bm25": bm25, "bm25plus": bm25_plus, "bm25l": bm25_l, "dfr_pl2": dfr_pl2, "ql_dirichlet": ql_dirichlet, "tfidf": tf_idf}
#: Schemes that score terms a document lacks.
SMOOTHED = {"ql_dirichlet"}
