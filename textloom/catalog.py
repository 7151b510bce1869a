"""Queries over the driver's tables by name, and SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import golden
from .functions import fixed, phonetic, weighting
from .functions import text as T
from .operators import graph, keywords, normal, segment, sentences, sketch
from .operators.arrow import SPANS, byte_spans, list_parts, vectorized
from .plans import corpus, dense, discover, fusion, near, search
from .plans.storage import materialize, spread
from .streaming import builders

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, over all cores: most queries here spend their time on single texts."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.token_arrays(docs(spark, sf_dir))


W = r"[\p{L}\p{Nd}]+(?:[''-][\p{L}\p{Nd}]+)*"
#: (doc_id, terms) of documents; (doc_id, term, pos); (term, doc_id, dl, tf); (term, df, cf); one row n, avgdl, coll.
A = f"a AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{W}'), lambda x: lower(x)) AS terms FROM documents)"
TOK = f"{A}, t AS (SELECT doc_id, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM a)"
TF = f"{A}, p AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM a) GROUP BY ALL)"
DF = f"{TF}, d AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term), c AS (SELECT count(*)::DOUBLE AS n, avg(len(terms)) AS avgdl, sum(len(terms))::DOUBLE AS coll FROM a)"
Q = f"q AS (SELECT query_id, term, count(*) AS weight FROM (SELECT item_id AS query_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '{W}'), lambda x: lower(x))) AS term FROM benchmark) GROUP BY ALL)"
M = f"{DF}, {Q}, m AS (SELECT p.*, d.df, d.cf, q.query_id, q.weight, c.* FROM p JOIN d USING (term) JOIN q USING (term), c)"
IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"
NORM = "(1 - 0.75 + 0.75 * dl / avgdl)"
TFN = "(tf * log2(1 + avgdl / dl))"
FORMULAS = {
    "bm25": f"{IDF} * tf * 2.2 / (tf + 1.2 * {NORM})",
    "bm25plus": f"{IDF} * (tf * 2.2 / (tf + 1.2 * {NORM}) + 1)",
    "bm25l": f"{IDF} * 2.2 * (tf / {NORM} + 0.5) / (1.2 + tf / {NORM} + 0.5)",
    "dfr_pl2": f"({TFN} * log2({TFN} / (cf / n)) + (cf / n + 1 / (12 * {TFN}) - {TFN}) * log2(exp(1)) + 0.5 * log2(2 * pi() * {TFN})) / ({TFN} + 1)",
    "tfidf": "CASE WHEN df >= n THEN 0 ELSE (1 + ln(tf)) * ln(n / df) END",
}


def topk(scored: str, k: int = 10, item: str = "doc_id", group: str = "query_id", digits: int = 6) -> str:
    return f"SELECT {group}, {item}, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, {item}) AS rank FROM (SELECT {group}, {item}, round(score, {digits}) AS score FROM {scored})) WHERE rank <= {k}"


# Text functions.


@query(f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{W}'))::BIGINT AS n_words FROM documents")
def tok_latin_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.coalesce(F.size(T.words(F.col("text"))), F.lit(0)).cast("bigint").alias("n_words"))


@query(f"WITH {TOK} SELECT term, count(*) AS n FROM t GROUP BY term ORDER BY n DESC, term LIMIT 100")
def tok_latin_top(spark, sf_dir):
    return corpus.explode_tokens(arrays(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(100)


EDGE = r"\t-\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@query(rf"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), ' *\n[ \n]*', chr(10), 'g'), ' +', ' ', 'g'), '\A[{EDGE}]+|[{EDGE}]+\z', '', 'g')) AS text_sha256 FROM documents")
def normalize_spaces(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(T.collapse_spaces(F.coalesce("text", F.lit(""))).cast("binary"), 256).alias("text_sha256"))


@query("SELECT doc_id, sha256(translate(coalesce(text, ''), '๐๑๒๓๔๕๖๗๘๙', '0123456789')) AS text_sha256 FROM documents")
def digits_fold(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(T.arabic_digits(F.coalesce("text", F.lit(""))).cast("binary"), 256).alias("text_sha256"))


@query("SELECT doc_id, sha256(nfc_normalize(coalesce(text, ''))) AS text_sha256 FROM documents")
def nfc(spark, sf_dir):
    form = vectorized(normal.nfc, "string")
    return docs(spark, sf_dir).select("doc_id", F.sha2(form(F.coalesce("text", F.lit(""))).cast("binary"), 256).alias("text_sha256"))


@query()
def normalize_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(T.normalize(F.coalesce("text", F.lit(""))).cast("binary"), 256).alias("text_sha256"))


def _script_sql(name: str) -> str:
    return f"length(regexp_replace(coalesce(text, ''), '[^{T.SCRIPTS[name]}]', '', 'g'))::BIGINT AS n_{name.lower()}"


@query(f"SELECT doc_id, {', '.join(_script_sql(s) for s in T.SCRIPTS)} FROM documents")
def script_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *(T.script_count(F.coalesce("text", F.lit("")), s).alias(f"n_{s.lower()}") for s in T.SCRIPTS))


@query()
def script_runs(spark, sf_dir):
    runs = vectorized(normal.script_runs, "array<struct<script:string,text:string,start:int>>")
    return docs(spark, sf_dir).select("doc_id", F.explode(runs("text")).alias("r")).groupBy("doc_id", "r.script").agg(F.count("*").alias("n"))


@query(r"WITH f AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[\t-\r ]+'), lambda x: x <> '')) AS w FROM benchmark), g AS (SELECT item_id, unnest(CASE WHEN length(w) <= 3 THEN [w] ELSE list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)) END) AS gram FROM f) SELECT gram, count(*) AS n FROM g GROUP BY gram")
def char_ngrams(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.explode(T.char_ngrams(F.coalesce("text", F.lit("")), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(rf"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[{EDGE}]+'), lambda x: x <> ''))::BIGINT AS n FROM documents")
def whitespace_sentences(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(T.fields(F.coalesce("text", F.lit("")))).cast("bigint").alias("n"))


@query("SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(regexp_split_to_array(text, ' +')) END::BIGINT AS n FROM documents")
def space_sentences(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(T.space_fields(F.coalesce("text", F.lit("")))).cast("bigint").alias("n"))


@query(rf"WITH l AS (SELECT doc_id, trim(unnest(regexp_split_to_array(coalesce(text, ''), '[\r\n]'))) AS s FROM documents), x AS (SELECT doc_id, regexp_replace(s, '\A[{EDGE}]+|[{EDGE}]+\z', '', 'g') AS s FROM l) SELECT doc_id, count(*) AS n, sum(length(s))::BIGINT AS chars FROM x WHERE s <> '' GROUP BY doc_id")
def paragraphs(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.explode(vectorized(sentences.paragraphs, SPANS)("text")).alias("p"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.char_length("p.text")).cast("bigint").alias("chars"))


STOP_LIST = ", ".join("'" + w.replace("'", "''") + "'" for w in fixed.STOP_EN)


@query(f"WITH {TOK} SELECT doc_id, count(*) AS n FROM t WHERE term NOT IN ({STOP_LIST}) GROUP BY doc_id")
def stopword_filter(spark, sf_dir):
    return corpus.without_stop_words(corpus.explode_tokens(arrays(spark, sf_dir)), fixed.STOP_EN).groupBy("doc_id").agg(F.count("*").alias("n"))


# Corpus statistics.


@query(f"WITH {TF} SELECT doc_id, term, tf FROM p")
def term_frequency(spark, sf_dir):
    return corpus.term_frequency(arrays(spark, sf_dir))


@query(f"WITH {DF} SELECT term, df, cf FROM d")
def document_frequency(spark, sf_dir):
    return corpus.document_frequency(corpus.term_frequency(arrays(spark, sf_dir)))


@query(f"WITH {A} SELECT count(*) AS n, round(avg(len(terms)), 6) AS avgdl, sum(len(terms))::BIGINT AS coll_len FROM a")
def collection_stats(spark, sf_dir):
    return arrays(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"), F.sum("dl").alias("coll_len"))


@query(f"WITH {DF} SELECT term, df, round({IDF}, 6) AS idf FROM d, c")
def idf(spark, sf_dir):
    own = arrays(spark, sf_dir)
    n = corpus.totals(own).n
    return corpus.idf_table(corpus.document_frequency(corpus.term_frequency(own)), n).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {DF} SELECT term, df FROM d, c WHERE df >= 0.5 * n")
def corpus_stopwords(spark, sf_dir):
    own = arrays(spark, sf_dir)
    return corpus.corpus_stop_words(corpus.document_frequency(corpus.term_frequency(own)), corpus.totals(own).n)


@query(f"WITH {TOK}, f AS (SELECT term, min((doc_id, pos)) AS seen, count(DISTINCT doc_id) AS df FROM t GROUP BY term) SELECT term, row_number() OVER (ORDER BY seen) - 1 AS id, df FROM f")
def vocab_ids(spark, sf_dir):
    return corpus.vocabulary(arrays(spark, sf_dir))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 10 = 0 AS held FROM documents")
def document_split(spark, sf_dir):
    return corpus.held_out(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


# Sparse retrieval.


def index(spark: SparkSession, sf_dir: str) -> search.Index:
    return search.build(arrays(spark, sf_dir), "postings")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as queries."""
    return corpus.token_arrays(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")).withColumnRenamed("doc_id", "query_id")


def _ranking(scheme: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.search(index(spark, sf_dir), asked(spark, sf_dir), scheme=scheme)

    run.__name__ = scheme
    formula = FORMULAS.get(scheme)
    scored = f"s AS (SELECT query_id, doc_id, sum(weight * ({formula})) AS score FROM m GROUP BY 1, 2)"
    if scheme == "ql_dirichlet":
        scored = "b AS (SELECT query_id, sum(weight * ln(2000 * cf / coll)) AS base, sum(weight) AS terms FROM q JOIN d USING (term), c GROUP BY 1), s AS (SELECT query_id, doc_id, any_value(base) + sum(weight * (ln(tf + 2000 * cf / coll) - ln(2000 * cf / coll))) - any_value(terms) * ln(any_value(dl) + 2000) AS score FROM m JOIN b USING (query_id) GROUP BY 1, 2)"
    query(f"WITH {M}, {scored} {topk('s')}")(run)


for _name in weighting.SCHEMES:
    _ranking(_name)


@query(_SQL["bm25"])
def bm25_pruned(spark, sf_dir):
    return search.pruned_search(index(spark, sf_dir), asked(spark, sf_dir))


@query(_SQL["bm25"])
def bm25_blocks(spark, sf_dir):
    return search.block_search(index(spark, sf_dir), asked(spark, sf_dir))


@query(f"WITH {DF} SELECT term, round(greatest(max({FORMULAS['bm25']}), 0), 6) AS bound FROM p JOIN d USING (term), c GROUP BY term")
def postings_upper_bounds(spark, sf_dir):
    return search.upper_bounds(index(spark, sf_dir)).select("term", F.round("bound", 6).alias("bound"))


@query(f"WITH {DF}, b AS (SELECT *, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 128 AS block FROM p JOIN d USING (term), c) SELECT term, block::BIGINT AS block, round(greatest(max({FORMULAS['bm25']}), 0), 6) AS bound, max(doc_id) AS last_doc FROM b GROUP BY term, block")
def block_max(spark, sf_dir):
    return search.block_bounds(index(spark, sf_dir)).select("term", F.col("block").cast("bigint").alias("block"), F.round("bound", 6).alias("bound"), "last_doc")


# Dense retrieval; the queries are the rows whose id is divisible by 20.


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    return rows, rows.where(F.col("vec_id") % 20 == 0)


VEC = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), vq AS (SELECT vec_id AS query_id, e AS q FROM v WHERE vec_id % 20 = 0)"
UNIT = "u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v), uq AS (SELECT vec_id AS query_id, e AS q FROM u WHERE vec_id % 20 = 0)"
SIGNS = "list_transform({0}, lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"
COS = "cs AS (SELECT query_id, vec_id, list_cosine_similarity(q, e) AS score FROM vq, v)"
HAM = f"hs AS (SELECT query_id, vec_id, list_inner_product({SIGNS.format('q')}, {SIGNS.format('e')}) / len(q) AS score FROM vq, v)"


SIGNED8 = "s8 AS (SELECT vec_id, greatest(list_max(e), -list_min(e)) / 127 AS st, list_transform(e, lambda x: round(x / (greatest(list_max(e), -list_min(e)) / 127))) AS e FROM u), s8q AS (SELECT vec_id AS query_id, st AS qt, e AS q FROM s8 WHERE vec_id % 20 = 0)"
SYM8 = "ss AS (SELECT query_id, vec_id, list_inner_product(q, e) * qt * st AS score FROM s8q, s8)"
SYM = f"sy AS (SELECT query_id, vec_id, list_inner_product({SIGNS.format('q').replace('>', '>=')}, {SIGNS.format('e').replace('>', '>=')}) AS score FROM vq, v)"


@query(f"WITH {VEC}, {SYM} {topk('sy', item='vec_id')}")
def binary_sym_topk(spark, sf_dir):
    return dense.search(*vectors(spark, sf_dir), scorer="binary_sym")


@query(f"WITH {VEC}, {UNIT}, {SIGNED8}, {SYM8} {topk('ss', item='vec_id')}")
def scalar8_sym_topk(spark, sf_dir):
    return dense.search(*vectors(spark, sf_dir), scorer="scalar8_sym")


@query(f"WITH {VEC}, {COS} {topk('cs', item='vec_id')}")
def cosine_topk(spark, sf_dir):
    return dense.search(*vectors(spark, sf_dir))


@query(f"WITH {VEC}, {HAM} {topk('hs', item='vec_id')}")
def binary_topk(spark, sf_dir):
    return dense.search(*vectors(spark, sf_dir), scorer="binary")


@query(f"WITH {VEC}, {UNIT}, l AS (SELECT vec_id, e, list_min(e) AS low, (list_max(e) - list_min(e)) / 255 AS step FROM u), s8 AS (SELECT query_id, vec_id, list_sum(q) * low + step * list_inner_product(q, list_transform(e, lambda x: floor((x - low) / step + 0.5))) AS score FROM uq, l) {topk('s8', item='vec_id')}")
def scalar8_topk(spark, sf_dir):
    return dense.search(*vectors(spark, sf_dir), scorer="scalar8")


@query(f"WITH {VEC}, {HAM}, h AS ({topk('hs', 100, 'vec_id')}), r AS (SELECT query_id, vec_id, list_cosine_similarity(q, e) AS score FROM h JOIN vq USING (query_id) JOIN v USING (vec_id)) {topk('r', item='vec_id')}")
def binary_then_rescore(spark, sf_dir):
    rows, queries = vectors(spark, sf_dir)
    return dense.rescore(dense.search(rows, queries, k=100, scorer="binary"), rows, queries)


@query()
def pq_topk(spark, sf_dir):
    rows, queries = vectors(spark, sf_dir)
    return dense.rescore(dense.search(rows, queries, k=200, scorer=dense.ProductQuantizer.fit(rows).scores), rows, queries)


@query()
def hnsw_topk(spark, sf_dir):
    return graph.search(*vectors(spark, sf_dir))


@query()
def hnsw_scalar8_topk(spark, sf_dir):
    return graph.search(*vectors(spark, sf_dir), codes="scalar8_sym")


# Fusion: benchmark items as text queries, the vectors of the same ids as dense ones.

HYBRID = f"""WITH {M}, {VEC}, s AS (SELECT query_id, doc_id, sum(weight * ({FORMULAS['bm25']})) AS score FROM m GROUP BY 1, 2),
    x AS (SELECT vec_id AS query_id, e AS q FROM v WHERE vec_id IN (SELECT item_id FROM benchmark)), xs AS (SELECT query_id, vec_id, list_cosine_similarity(q, e) AS score FROM x, v),
    h AS (SELECT query_id, 'sparse' AS list, doc_id AS id, score FROM ({topk('s', 50)}) UNION ALL SELECT query_id, 'dense', vec_id, score FROM ({topk('xs', 50, 'vec_id')}))"""


def hybrid_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    sparse = search.search(index(spark, sf_dir), asked(spark, sf_dir), k=50)
    rows = table(spark, sf_dir, "embeddings")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    close = dense.search(rows, rows.join(items, "vec_id", "left_semi"), k=50)
    return materialize(fusion.together(fusion.adapt(sparse, "sparse"), fusion.adapt(close, "dense", "vec_id")), "hits")


@query(f"{HYBRID}, n AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY score DESC, id) AS r FROM h) GROUP BY 1, 2) {topk('n', item='id', digits=9)}")
def hybrid_rrf(spark, sf_dir):
    return fusion.rrf(hybrid_hits(spark, sf_dir))


WEIGHTS = {"sparse": 0.6, "dense": 0.4}
WEIGHED = "sum(CASE list WHEN 'sparse' THEN 0.6 ELSE 0.4 END::DOUBLE * x) AS score"


@query(f"{HYBRID}, z AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM h WINDOW w AS (PARTITION BY query_id, list)), n AS (SELECT query_id, id, {WEIGHED} FROM (SELECT *, CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END AS x FROM z) GROUP BY 1, 2) {topk('n', item='id')}")
def weighted_minmax(spark, sf_dir):
    return fusion.weighted_sum(hybrid_hits(spark, sf_dir), WEIGHTS, fusion.min_max())


@query(f"{HYBRID}, z AS (SELECT *, avg(score) OVER w AS mu, stddev_pop(score) OVER w AS sd FROM h WINDOW w AS (PARTITION BY query_id, list)), n AS (SELECT query_id, id, {WEIGHED} FROM (SELECT *, CASE WHEN sd = 0 THEN 0 ELSE (score - mu) / sd END AS x FROM z) GROUP BY 1, 2) {topk('n', item='id')}")
def weighted_zscore(spark, sf_dir):
    return fusion.weighted_sum(hybrid_hits(spark, sf_dir), WEIGHTS, fusion.z_score())


# Sketches.


@query(f"WITH {A}, s AS (SELECT doc_id, unnest(CASE WHEN len(terms) = 0 THEN [] WHEN len(terms) < 5 THEN [array_to_string(terms, ' ')] ELSE list_transform(range(1, len(terms) - 3), lambda i: array_to_string(terms[i : i + 4], ' ')) END) AS s FROM a) SELECT doc_id, count(DISTINCT s) AS n FROM s GROUP BY doc_id")
def word_shingles(spark, sf_dir):
    return arrays(spark, sf_dir).where("dl > 0").select("doc_id", F.size(T.word_shingles(F.col("terms"))).cast("bigint").alias("n"))


@query("WITH s AS (SELECT doc_id, unnest(CASE WHEN length(text) < 5 THEN [text] ELSE list_transform(range(1, length(text) - 3), lambda i: substr(text, i, 5)) END) AS s FROM documents WHERE text <> '') SELECT doc_id, count(DISTINCT s) AS n FROM s GROUP BY doc_id")
def char_shingles(spark, sf_dir):
    return docs(spark, sf_dir).where("text <> ''").select("doc_id", F.size(T.char_shingles(F.col("text"))).cast("bigint").alias("n"))


#: Distinct 5-word shingles by document; a text of fewer words has one.
SHINGLES = f"{A}, sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(terms) < 5 THEN [array_to_string(terms, ' ')] ELSE list_transform(range(1, len(terms) - 3), lambda i: array_to_string(terms[i : i + 4], ' ')) END) AS s FROM a WHERE len(terms) > 0), sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1)"
ALIKE = "pr AS (SELECT x.doc_id AS query_id, y.doc_id, count(*) AS c FROM sh x JOIN sh y USING (s) WHERE x.doc_id % 20 = 0 GROUP BY 1, 2), al AS (SELECT query_id, pr.doc_id, c::DOUBLE / (x.n + y.n - c) AS similarity FROM pr JOIN sz x ON x.doc_id = query_id JOIN sz y ON y.doc_id = pr.doc_id WHERE c >= 0.8 * (x.n + y.n - c))"


@query(f"WITH {SHINGLES}, {ALIKE}, cl AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY terms) AS class_id FROM a) SELECT DISTINCT query_id, class_id, round(similarity, 6) AS similarity FROM al JOIN cl USING (doc_id)")
def minhash_similar(spark, sf_dir):
    rows = docs(spark, sf_dir)
    return near.similar(rows, rows.where(F.col("doc_id") % 20 == 0)).withColumn("similarity", F.round("similarity", 6))


@query()
def simhash_tokens(spark, sf_dir):
    code = vectorized(lambda ts: sketch.sim_hash([t.encode() for t in ts]), "bigint")
    return arrays(spark, sf_dir).select("doc_id", code("terms").alias("fingerprint"))


@query(f"WITH {TOK}, h AS (SELECT ('0x' || substr(md5(term), 1, 15))::BIGINT AS h FROM t), r AS (SELECT unnest(range(4)) AS r, h FROM h) SELECT r, (h // (1 + r * 1000)) % 2719 AS col, count(*) AS n FROM r GROUP BY ALL")
def count_min_cells(spark, sf_dir):
    words = corpus.explode_tokens(arrays(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("c"))
    hashed = words.select("c", F.conv(F.substring(F.md5("term"), 1, 15), 16, 10).cast("bigint").alias("h"))
    rows = hashed.select("c", "h", F.explode(F.array(*[F.lit(r).cast("bigint") for r in range(4)])).alias("r"))
    return rows.groupBy("r", F.expr("(h div (1 + r * 1000)) % 2719").alias("col")).agg(F.sum("c").alias("n"))


@query(f"WITH {SHINGLES}, {ALIKE} SELECT query_id, doc_id, round(similarity, 6) AS similarity FROM al")
def exact_jaccard(spark, sf_dir):
    shingles = arrays(spark, sf_dir).where("dl > 0").select("doc_id", T.word_shingles(F.col("terms")).alias("sh"))
    sets = materialize(shingles.select("doc_id", F.size("sh").alias("n"), F.transform("sh", lambda x: F.xxhash64(x)).alias("s")), "sets")
    found = near.exact_pairs(sets, sets.where(F.col("doc_id") % 20 == 0))
    return found.select("query_id", "doc_id", F.round(F.col("c") / (F.col("n") + F.col("m") - F.col("c")), 6).alias("similarity"))


# Keywords, queries, discovery.


def _keywords(method: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        front = keywords.FrontEnd()
        found = vectorized(lambda t: [{"term": a, "score": b} for a, b in keywords.EXTRACTORS[method](front, t, 10)], "array<struct<term:string,score:double>>")
        rows = docs(spark, sf_dir).select("doc_id", F.explode(found("text")).alias("k"))
        return rows.select("doc_id", "k.term", F.round("k.score", 6).alias("score"))

    run.__name__ = f"keywords_{method}"
    query()(run)


for _name in ("rake", "textrank", "yake"):
    _keywords(_name)


@query(f"WITH {DF}, s AS (SELECT doc_id, term, tf * {IDF} AS score FROM p JOIN d USING (term), c WHERE length(term) >= 2 AND regexp_matches(term, '\\p{{L}}') AND term NOT IN ({STOP_LIST})) {topk('s', item='term', group='doc_id')}")
def keyword_tfidf(spark, sf_dir):
    made = index(spark, sf_dir)
    content = (F.char_length("term") >= 2) & F.col("term").rlike(r"\p{L}") & ~F.col("term").isin(fixed.STOP_EN)
    scored = made.postings.where(content).join(made.terms, "term").select("doc_id", "term", (F.col("tf") * weighting.idf(F.lit(float(made.totals.n)), F.col("df"))).alias("score"))
    return search.best(scored, 10, group="doc_id", item="term")


@query()
def query_parse(spark, sf_dir):
    parser = keywords.Parser()
    parse = vectorized(parser.parse_expand, "array<string>")
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(parse("text"), " ").alias("terms"))


RUNS = "SELECT array_to_string(terms[i : i + k - 1], ' ') AS term, k AS n, CASE WHEN i > 1 THEN terms[i - 1] END AS l, CASE WHEN i + k <= len(terms) THEN terms[i + k] END AS r FROM (SELECT terms, k, unnest(range(1, len(terms) - k + 2)) AS i FROM a, (SELECT unnest([2, 3, 4]) AS k) WHERE len(terms) >= k)"
DISCOVER = f"""WITH {TOK}, g AS ({RUNS}), o AS (SELECT term, n, count(*) AS uses FROM g GROUP BY 1, 2 HAVING count(*) >= 5),
    k AS (SELECT * FROM g SEMI JOIN o USING (term)), one AS (SELECT term AS token, count(*) AS u FROM t GROUP BY 1), tot AS (SELECT count(*)::DOUBLE AS total FROM t),
    hl AS (SELECT term, -sum(c / s * log2(c / s)) AS h_left FROM (SELECT term, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY term)::DOUBLE AS s FROM k WHERE l IS NOT NULL GROUP BY term, l) GROUP BY 1),
    hr AS (SELECT term, -sum(c / s * log2(c / s)) AS h_right FROM (SELECT term, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY term)::DOUBLE AS s FROM k WHERE r IS NOT NULL GROUP BY term, r) GROUP BY 1),
    pm AS (SELECT term, sum(log2(u / total)) AS parts FROM (SELECT term, unnest(string_split(term, ' ')) AS token FROM o) JOIN one USING (token), tot GROUP BY 1),
    f AS (SELECT term, n, uses, coalesce(h_left, 0) AS h_left, coalesce(h_right, 0) AS h_right, log2(uses / total) - parts AS pmi FROM o JOIN pm USING (term) LEFT JOIN hl USING (term) LEFT JOIN hr USING (term), tot)"""


@query(f"{DISCOVER} SELECT term, n::INT AS n, uses, round(h_left, 5) + 0 AS h_left, round(h_right, 5) + 0 AS h_right, round(pmi, 5) AS pmi FROM f")
def discover_candidates(spark, sf_dir):
    found = discover.candidates(arrays(spark, sf_dir))
    return found.select("term", "n", "uses", *((F.round(c, 5) + 0.0).alias(c) for c in ("h_left", "h_right", "pmi")))


@query(f"""{DISCOVER}, j AS (SELECT *, string_split(term, ' ') AS tk FROM f WHERE least(h_left, h_right) >= 1.5 - 1e-9 AND pmi >= 9 - 1e-9),
    w AS (SELECT DISTINCT term, uses, array_to_string(tk[i : i + k - 1], ' ') AS part FROM (SELECT term, uses, tk, k, unnest(range(1, len(tk) - k + 2)) AS i FROM j, (SELECT unnest([2, 3]) AS k) WHERE len(tk) > k)),
    ins AS (SELECT part, sum(uses) AS inside FROM w GROUP BY 1)
    SELECT term, n::INT AS n, uses, round(h_left, 5) AS h_left, round(h_right, 5) AS h_right, round(pmi, 5) AS pmi FROM j LEFT JOIN ins ON term = part WHERE inside IS NULL OR uses - inside >= 0.33 * uses""")
def discover_terms(spark, sf_dir):
    return discover.discover(arrays(spark, sf_dir)).select("term", "n", "uses", *(F.round(c, 5).alias(c) for c in ("h_left", "h_right", "pmi")))


# Segmentation, sentences, chunks, embedding: algorithms on single texts.


@query()
def analyzer_terms(spark, sf_dir):
    own = segment.Analyzer(lower_latin=True, fold_width=True, stop=frozenset(fixed.STOP_EN))
    return docs(spark, sf_dir).select("doc_id", F.size(vectorized(own.terms, "array<string>")("text")).alias("n"))


@query()
def analyzer_tokens(spark, sf_dir):
    own = segment.Analyzer()
    cut = vectorized(lambda t: own.tokens(t)["tokens"], SPANS)
    return docs(spark, sf_dir).select("doc_id", F.explode(cut("text")).alias("t")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("t.end").alias("last"))


@query()
def thai_segment(spark, sf_dir):
    d = segment.Dictionary(fixed.ENDERS + fixed.STARTERS + fixed.MONTHS)
    cut = vectorized(lambda t: byte_spans(t, segment.without_blanks(t, segment.thai_spans(t, d))), SPANS)
    return docs(spark, sf_dir).select("doc_id", F.size(cut("text")).alias("n"))


@query()
def heuristic_sentences(spark, sf_dir):
    cut = vectorized(sentences.heuristic_sentences, "array<string>")
    return docs(spark, sf_dir).select("doc_id", F.size(cut("text")).alias("n"))


@query()
def chunk_split(spark, sf_dir):
    o = sentences.ChunkOptions(800, 100)
    cut = vectorized(lambda t: sentences.chunks(t, o), SPANS)
    return docs(spark, sf_dir).select("doc_id", F.posexplode(cut("text")).alias("pos", "c")).select("doc_id", "pos", "c.start", "c.end")


@query()
def hashing_embed(spark, sf_dir):
    e = sketch.HashingEmbedder(128)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in list_parts(batches, 1 << 14, 1):
            listed = b.column(1)
            words = listed.flatten().dictionary_encode()
            vectors = e.embed_lists(words.dictionary.to_pylist(), words.indices.to_numpy(), np.diff(listed.offsets.to_numpy()))
            ends = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * e.dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()))], names=["doc_id", "vec"])

    own = arrays(spark, sf_dir).select("doc_id", "terms")
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, vec array<float>")


# Names.


@query("SELECT p_partkey, levenshtein(p_name, p_type)::INT AS distance, round(CASE WHEN greatest(length(p_name), length(p_type)) = 0 THEN 1 ELSE 1 - levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type)) END, 6) AS similarity FROM part")
def name_similarity(spark, sf_dir):
    a, b = F.col("p_name"), F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein(a, b).alias("distance"), F.round(phonetic.similarity(a, b), 6).alias("similarity"))


# Evaluation and events.


@query("WITH x AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn FROM labels), y AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS r FROM x) SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM y")
def eval_prf(spark, sf_dir):
    found = corpus.evaluation(table(spark, sf_dir, "labels"), "quality", "toxic")
    return found.select("tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_windows(spark, sf_dir):
    return builders.event_windows(table(spark, sf_dir, "events"))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def events_sessions(spark, sf_dir):
    return builders.event_sessions(table(spark, sf_dir, "events"))


FLAGSHIP = hybrid_rrf


def queries() -> dict[str, Query]:
    return golden.QUERIES | _QUERIES


def oracle_sql() -> dict[str, str]:
    return golden.SQL | _SQL
