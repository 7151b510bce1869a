"""Queries over literal texts, for operators whose letters the driver's tables lack: Thai, Chinese, Japanese, Korean,
names, trained models. Each has its inputs and the results they must have side by side; the SQL is the latter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixed, phonetic
from .functions import text as T
from .operators import keywords, normal, segment, sentences, sketch, soundex
from .operators.arrow import vectorized
from .operators.phonetic import lk82
from .plans import dictionary, discover, near

Case = tuple[str, str]

THAI = segment.Dictionary("ผม กิน ข้าว ร้าน นี้ ไป โรงเรียน โรง เรียน ตากลม ตา กลม ตาก ลม".split())
CHINESE = segment.Dictionary([("中国", 10), ("人民", 5), ("中国人", 3), ("民", 1)])


def texts(function: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """A function to a list of strings, shown joined by bars."""
    return vectorized(lambda t: "|".join(function(t)), "string")


def spans(cut: Callable, d: segment.Dictionary) -> Callable[[Column], Column]:
    return texts(lambda t: [t[a:b] for a, b in segment.without_blanks(t, cut(t, d))])


def clusters_of(text: str) -> list[str]:
    ends = [i for i, e in enumerate(segment.clusters(text)) if e]
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def char_model() -> sentences.CharModel:
    lines = [("ab cd. ef.", (6, 10)), ("fa. bc de. a b.", (3, 10, 15)), ("cc dd ee. ff.", (9, 13)), ("ac. bd. ce df.", (3, 7, 14))] * 6
    return sentences.CharModel.fit(lines, bits=16, epochs=10)


def crf_model() -> sentences.Crf:
    lines = [("a b end c end", "IIEIE"), ("c end a a b end", "IEIIIE"), ("b end b c a end a end", "IEIIIEIE"), ("a c b end", "IIIE")] * 6
    return sentences.Crf.fit([(t.split(), list(y)) for t, y in lines])


def _shown(scored: list[tuple[str, float]]) -> list[str]:
    return [f"{t}={s:.4f}" for t, s in scored]


FRONT = keywords.FrontEnd()
PARSER = keywords.Parser()

CASES: dict[str, tuple[Callable[[], Callable[[Column], Column]], list[Case]]] = {
    "normalize_rules": (lambda: T.normalize, [("ก\nข", "ก\nข"), ("ก \n ข", "ก\nข"), ("ก\n\nข", "ก\nข"), ("ก \n\n ค", "ก\nค"), ("บรรทัด1\nบรรทัด2", "บรรทัด1\nบรรทัด2"), ("ก\n  \nข", "ก\nข"), ("เเปลก", "แปลก"), ("กา้", "ก้า"), ("น้ํา", "น้ำ"), ("a  b \n c ", "a b\nc"), ("", "")]),
    "arabic_digits": (lambda: T.arabic_digits, [("๐๑๒๓๔๕๖๗๘๙", "0123456789"), ("บทที่ ๕ หน้า ๑๐/25", "บทที่ 5 หน้า 10/25"), ("ปี๒๕๖๗พอดี", "ปี2567พอดี"), ("๑2๓4", "1234"), ("第๑章 中文", "第1章 中文"), ("๏๐๙๚", "๏09๚"), ("chapter 5", "chapter 5")]),
    "fold_width": (lambda: vectorized(normal.fold_width, "string"), [("Ａ", "A"), ("３", "3"), ("　", " "), ("ＡＢＣ", "ABC"), ("ｶ", "カ"), ("A", "A")]),
    "fold_for_index": (lambda: vectorized(normal.fold_for_index, "string"), [("ＡＰＩ", "API"), ("２０２４", "2024"), ("ｶﾀｶﾅ", "カタカナ"), ("한국어", "한국어"), ("ＡＢ　ＣＤ", "AB CD"), ("繁體", "繁體"), ("が", "が"), ("user@example.com", "user@example.com")]),
    "canonical_marks": (lambda: vectorized(normal.canonical, "string"), [("กุ่", "กุ่"), ("กุ่", "กุ่")]),
    "script_runs_mixed": (lambda: texts(lambda t: [f"{r['script']}:{r['text']}" for r in normal.script_runs(t)]), [("สวัสดีHello你好", "Thai:สวัสดี|Latin:Hello|Han:你好"), ("abc 123 def", "Latin:abc 123 def"), ("ราคา 1,234 บาท", "Thai:ราคา 1,234 บาท"), ("เนี่ยลี่ (Nie Li)", "Thai:เนี่ยลี่ (|Latin:Nie Li)"), ("한국어test", "Hangul:한국어|Latin:test"), ("", ""), ("   ", "Other:   ")]),
    "thai_sentences": (lambda: texts(sentences.heuristic_sentences), [("ผมกิน ข้าว ร้านนี้", "ผมกิน ข้าว ร้านนี้"), ("สวัสดีครับ วันนี้อากาศดี", "สวัสดีครับ|วันนี้อากาศดี"), ("เขาจะมา แต่รถติด", "เขาจะมา|แต่รถติด"), ("บรรทัดหนึ่ง\nบรรทัดสอง", "บรรทัดหนึ่ง|บรรทัดสอง"), ("จริงหรือ? ไม่น่าเชื่อ", "จริงหรือ?|ไม่น่าเชื่อ"), ("เขาอยู่กรุงเทพฯ แถวสุขุมวิท", "เขาอยู่กรุงเทพฯ แถวสุขุมวิท"), ("ดีมาก! ไปต่อกันเลย", "ดีมาก!|ไปต่อกันเลย"), ("นาย สมชาย ใจดี มาก", "นาย สมชาย ใจดี มาก"), ("เกิดวันที่ 1 มกราคม 2540 ที่เชียงใหม่", "เกิดวันที่ 1 มกราคม 2540 ที่เชียงใหม่"), ("เขาเดินช้าๆ ผมรีบไป", "เขาเดินช้าๆ|ผมรีบไป")]),
    "chunks_of_ten": (lambda: texts(lambda t: [c["text"] for c in sentences.chunks(t, sentences.ChunkOptions(10, 0))]), [("หนึ่ง สอง สาม", "หนึ่ง สอง|สาม"), ("  hi  ", "hi"), ("ก", "ก"), (" \t \n  \r ", ""), ("a b\r\nc\n\n d ", "a b|c|d")]),
    "korean_words": (lambda: lambda c: F.array_join(T.korean_words(c), "|"), [("서울에서 부산까지", "서울에서|서울|부산까지|부산"), ("집으로 갔다", "집으로|집|갔다"), ("", ""), ("한국어를 배우다", "한국어를|배우다"), ("AI 기술", "AI|기술"), ("친구에게", "친구에게|친구"), ("학교부터", "학교부터|학교"), ("나라보다", "나라보다|나라"), ("사랑", "사랑"), ("사과", "사과"), ("결과", "결과")]),
    "chinese_greedy": (lambda: spans(segment.greedy_spans, CHINESE), [("中国人民 ab12!", "中国人|民|ab|12|!"), ("中国", "中国"), ("", "")]),
    "chinese_best": (lambda: spans(segment.best_spans, CHINESE), [("中国人民", "中国|人民"), ("中国人", "中国人"), ("", "")]),
    "thai_words": (lambda: spans(segment.thai_spans, THAI), [("ผมไปโรงเรียน", "ผม|ไป|โรงเรียน"), ("ตากลม", "ตากลม"), ("กินxyzข้าว 1,000.5", "กิน|xyz|ข้าว|1,000.5"), ("", "")]),
    "thai_clusters": (lambda: texts(clusters_of), [("ประเทศไทย", "ป|ระ|เท|ศ|ไท|ย")]),
    "subword_parts": (lambda: texts(lambda t: segment.subwords(THAI, t)), [("โรงเรียน", "โรง|เรียน")]),
    "metasound_codes": (lambda: phonetic.metasound, [("รถ", "ร000"), ("รัก", "ร100"), ("บูรณะ", "บ550"), ("บูรณการ", "บ551"), ("ปัจจุบัน", "ป223"), ("", "")]),
    "udom83_codes": (lambda: phonetic.udom83, [("รถ", "ร800000"), ("รัก", "ร100000"), ("บูรณะ", "บ930000"), ("บูรณการ", "บ931900"), ("ปัจจุบัน", "ป775300"), ("", "")]),
    "lk82_codes": (lambda: vectorized(lk82, "string"), [("รถ", "ร3000"), ("รัก", "ร1000"), ("บูรณะ", "บE400"), ("บูรณการ", "บE419"), ("ปัจจุบัน", "ป3E54"), ("", "")]),
    "complete_soundex_codes": (lambda: vectorized(soundex.complete_soundex, "string"), [("ก", "กก7M-0-"), ("ขา", "คข1B-0-"), ("บาน", "บบ1Bน0-"), ("เกลือ", "กกBV-0ล"), ("สร้าง", "ซศ1Bง2ร"), ("สาว", "ซซ1Bว0-"), ("ลม", "รร1A-0-มม1A-0-"), ("เริ่ม", "รร2Cม1-"), ("หญ้า", "ฮห1B2น-"), ("ทำ", "ทท1Aม0-"), ("โลก", "รร7Nก0-"), ("แดง", "ดด6Lง0-"), ("", "")]),
    "acronym_fold": (lambda: T.fold, [("HTTP", "HTTP"), ("Http", "http"), ("A", "a"), ("POS", "POS"), ("Café", "café")]),
    "query_terms": (lambda: texts(PARSER.parse), [("it", "IT"), ("pc", "PC"), ("hr", "HR"), ("what is the it policy IT", "IT|policy"), ("", "")]),
    "query_expansion": (lambda: texts(PARSER.expand), [("xyz", "xyz|XYZ"), ("IT", "IT|ไอที|เทคโนโลยีสารสนเทศ"), ("ไอที", "ไอที|IT|เทคโนโลยีสารสนเทศ"), ("HR", "HR|เอชอาร์|ทรัพยากรบุคคล|ฝ่ายบุคคล")]),
    "rake_phrases": (lambda: texts(lambda t: [x for x, _ in keywords.rake(FRONT, t, 1)]), [("Deep learning models need data. Deep learning is fun, and GPU models help.", "Deep learning models need data")]),
    "text_rank_words": (lambda: texts(lambda t: _shown(keywords.text_rank(FRONT, t, 5))), [("data", "data=1.0000"), ("", "")]),
    "char_sentences": (lambda: texts(char_model().split), [("ab ef. cd fa.", "ab ef.|cd fa."), ("", "")]),
    "crf_sentences": (lambda: texts(lambda t: crf_model().labels(t.split())), [("a end b c end", "I|E|I|I|E"), ("c c end", "I|I|E")]),
    "whitespace_labels": (lambda: texts(lambda t: sentences.whitespace_labels(list(t))), [("a b", "E|I|E")]),
    "silver_labels": (lambda: texts(lambda t: sentences.silver_labels(t.split("/"))), [("a/./ /b/“c/d/”/e", "I|E|I|E|I|I|E|E"), ("x/ ", "E|I"), ("他/说/。/「/好/」/ ", "I|I|E|I|I|E|I"), (" / ", "I|I")]),
    "pronounceable_terms": (lambda: lambda c: vectorized(discover.pronounceable, "boolean")(c).cast("string"), [("กมล", "false"), ("กา", "true"), ("ก็อบลิน", "true"), ("ๆ", "false"), ("ช้าๆ", "false"), ("abc", "false"), ("", "false")]),
    "static_vectors": (lambda: texts(lambda t: [f"{x:.4f}" for x in sketch.StaticEmbedder({"a": [1.0, 0.0], "b": [0.0, 1.0]}).embed(t.split()).tolist()]), [("a", "1.0000|0.0000"), ("a b", "0.7071|0.7071"), ("z", "0.0000|0.0000")]),
}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple[str, ...]], *names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) x({', '.join(names)})"


def _case(name: str) -> Callable[[SparkSession, str], DataFrame]:
    make, cases = CASES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.createDataFrame([(t,) for t, _ in cases], "text string")
        return rows.select("text", make()(F.col("text")).alias("result"))

    return run


NAMES = [("nieli", "เนี่ยลี่"), ("somchai", "สมชาย"), ("somjai", "สมใจ")]
ALIASES = [("nieli", "นี่หลี่")]
ASKED = ["เนี่ยลี่", "นี่หลี่", "สมชาย", "แมวน้ำ"]


def sound_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, aliases = (spark.createDataFrame(x, "entity_id string, name string") for x in (NAMES, ALIASES))
    asked = spark.createDataFrame([(x, x) for x in ASKED], "query_id string, name string")
    found = near.sound_lookup(names, aliases, asked, alias_score=1.0)
    return found.select("query_id", "entity_id", F.round("score", 4).cast("string").alias("score"))


def sounds_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame([(a, b) for a, b, _ in ALIKE], "a string, b string")
    return pairs.select("a", "b", phonetic.sounds_like(F.col("a"), F.col("b")).cast("string").alias("alike"))


ALIKE = [("ทองดี", "ทองดา", "true"), ("บ้าน", "บาน", "true"), ("รัก", "ลัก", "true"), ("กา", "มี", "false")]

WORDS = [("the", 3), ("of", 2), ("and", None), ("th", 1), ("an", 7)]
MORE = [("of", 9), ("for", 4)]
WORD_SQL = ", ".join(f"('{w}', {n if n is not None else 'NULL'}::INT)" for w, n in WORDS)
MORE_SQL = ", ".join(f"('{w}', {n})" for w, n in MORE)


def _words(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, "word string, weight int")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text")


def dictionary_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.prefix_weights(_benchmark(spark, sf_dir), _words(spark, WORDS))


def dictionary_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _benchmark(spark, sf_dir).select(F.explode(T.lower_words(F.col("text"))).alias("term"))
    return dictionary.contains(tokens, _words(spark, WORDS)).groupBy("term").agg(F.count("*").alias("n"))


def dictionary_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.overlaid(_words(spark, WORDS), _words(spark, MORE))


def stop_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.union_of(*(spark.createDataFrame([(w,) for w in s], "term string") for s in STOPS))


STOPS = [list(x.split() if isinstance(x, str) else x) for x in (fixed.STOP_EN, fixed.STOP_ZH, fixed.STOP_JA, fixed.STOP_KO)]
LATIN = r"[\p{L}\p{Nd}]+(?:[''-][\p{L}\p{Nd}]+)*"

QUERIES = {n: _case(n) for n in CASES} | {f.__name__: f for f in (sound_index, sounds_alike, dictionary_prefixes, dictionary_members, dictionary_overlay, stop_union)}
SQL = {n: values(cases, "text", "result") for n, (_, cases) in CASES.items()} | {
    "sound_index": values([("เนี่ยลี่", "nieli", "1.0"), ("นี่หลี่", "nieli", "1.0"), ("สมชาย", "somchai", "1.0"), ("สมชาย", "somjai", "0.4")], "query_id", "entity_id", "score"),
    "sounds_alike": values(ALIKE, "a", "b", "alike"),
    "dictionary_prefixes": f"WITH w(word, weight) AS (VALUES {WORD_SQL}), p AS (SELECT item_id AS doc_id, text, unnest(range(length(text))) AS pos FROM benchmark WHERE length(text) > 0) SELECT doc_id, pos::INT AS pos, length(word)::INT AS length, weight FROM p JOIN w ON substr(text, pos + 1, length(word)) = word",
    "dictionary_members": f"WITH w(word, weight) AS (VALUES {WORD_SQL}), t AS (SELECT unnest(list_transform(regexp_extract_all(coalesce(text, ''), '{LATIN}'), lambda x: lower(x))) AS term FROM benchmark) SELECT term, count(*) AS n FROM t WHERE term IN (SELECT word FROM w) GROUP BY term",
    "dictionary_overlay": f"WITH w(word, weight) AS (VALUES {WORD_SQL}), m(word, weight) AS (VALUES {MORE_SQL}) SELECT word, weight FROM m UNION ALL SELECT word, weight FROM w WHERE word NOT IN (SELECT word FROM m)",
    "stop_union": " UNION ".join(values([(w,) for w in s], "term") for s in STOPS),
}
