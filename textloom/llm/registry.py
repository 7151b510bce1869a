"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact, licenses, linededup, packing, pii, simhash, substring, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def tokenizer_files() -> tuple[str, str | None]:
    """The public tokenizer that the packing query names, and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), *tokenizer_files())


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))), "|")
    return found.select("record_id", "url", "ts", "base_id", "status", listed.alias("headers"), F.sha2(F.coalesce("body", F.lit("").cast("binary")), 256).alias("body_sha256"))


UP, LOW = exact.UPPER, exact.LOWER

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWERED = f"translate(coalesce(text, ''), '{UP}', '{LOW}')"
WORDS = f"list_filter(regexp_split_to_array({LOWERED}, '{NOT_WORD}'), lambda w: w <> '')"

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

TAG = "'\"' || md5(coalesce(html, '')) || '\"'"

ORACLE = {
    "op10_warc_revisits": f"""
        WITH u AS (SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
             h AS (SELECT page_id, html, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), ':(80|443)$', ''), '^www\\.', '') AS host,
                          regexp_replace(regexp_replace(regexp_replace(u, '^[^/?]*', ''), '([?&])((utm_[a-z]*|ref)=[^&]*(&|$))+', '\\1'), '[?&]$', '') AS rest FROM u),
             p AS (SELECT page_id, html, host || CASE WHEN rest = '/' THEN '' ELSE rest END AS key, {TAG} AS tag FROM h),
             r AS (SELECT key, page_id * 10 AS ts, page_id * 2 AS base_id, tag, html FROM p WHERE page_id % 13 <> 0),
             v AS (SELECT key, page_id * 10 + 5 AS ts, page_id * 2 + 1 AS record_id,
                          CASE WHEN page_id % 7 = 0 THEN '\"other\"' WHEN page_id % 11 = 0 THEN NULL ELSE tag END AS bare, page_id % 7 <> 0 AND page_id % 11 <> 0 AS weak FROM p),
             j AS (SELECT v.*, r.base_id, r.tag, r.html FROM v ASOF LEFT JOIN r ON v.key = r.key AND v.ts > r.ts),
             s AS (SELECT *, CASE WHEN base_id IS NULL THEN 'orphan' WHEN bare IS NULL THEN 'unverified' WHEN bare = tag THEN 'resolved' ELSE 'mismatch' END AS status,
                          CASE WHEN weak THEN 'W/' || bare ELSE bare END AS told FROM j)
        SELECT record_id, key AS url, ts, base_id, status,
               CASE WHEN status IN ('orphan', 'mismatch') THEN 'content-type: text/plain|date: ' || ts || '|etag: ' || coalesce(told, '')
                    ELSE 'content-type: text/html|date: ' || ts || '|etag: ' || coalesce(told, tag) END AS headers,
               sha256(CASE WHEN status IN ('orphan', 'mismatch') THEN '' ELSE coalesce(html, '') END) AS body_sha256
        FROM s""",
    "op5_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
             l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
             k AS (SELECT doc_id, i, line, translate(trim(line, {BLANKS}), '{UP}', '{LOW}') AS key FROM l),
             often AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
             j AS (SELECT doc_id, i, line, largest IS NOT NULL AND largest <> doc_id AS gone FROM k LEFT JOIN often USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM j GROUP BY doc_id""",
    "op3_decontamination": f"""
        WITH dw AS (SELECT doc_id, {WORDS} AS w FROM documents),
             bw AS (SELECT item_id::VARCHAR AS item, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
             bi AS (SELECT item, w, len(w) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0),
             win AS (SELECT DISTINCT item, least(n, 10) AS k, array_to_string(w[i : i + least(n, 10) - 1], ' ') AS s FROM bi),
             sizes AS (SELECT DISTINCT k FROM win),
             dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k),
             hit AS (SELECT doc_id, i, dp.k, item FROM dp JOIN win ON dp.k = win.k AND array_to_string(dp.w[i : i + dp.k - 1], ' ') = win.s),
             words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
             items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS n, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
             win AS (SELECT n, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT n, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
             least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
             gone AS (SELECT DISTINCT n, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (h) WHERE doc_id > m),
             u AS (SELECT n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
             kept AS (SELECT n, string_agg(x, ' ' ORDER BY p) AS s, count(*) AS c FROM u ANTI JOIN gone USING (n, p) GROUP BY n)
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(c, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (n)""",
    "op9_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UP}', '{LOW}')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
}


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
